"""Language-model scores by a weighted backoff automaton over smoothed n-grams.

Smoothing is that of a hierarchical Dirichlet prior (MacKay and Peto): with k the prior's weight and h' the history h
without its first token,
    P(w | h) = (c(h w) + k P(w | h')) / (c(h) + k),    P(w) = (c(w) + 1) / (N + V + 1).
As an automaton: a state for each history that occurs in training; from a state an arc for each n-gram seen there, with
the logarithm of the smoothed probability as weight, to the state of the longest history that goes on from it; and a
failure arc to the state of the shorter history, with weight log(k / (c(h) + k)).  A text is read once from left to right
from the state of an end token.  The state is carried from token to token: at a token without an arc the failure arcs are
followed, their weights added, until there is one; the root has one for every token.

The counts of all n-grams of the training texts grow with the input and are never in one place.  Documents are dealt
into groups; a group sends each n-gram of its texts once, with its own training count, to a bucket by hash; buckets add
up and answer with global counts, aligned to what was asked; so each group builds just the part of the automaton that its
texts can reach.  N-grams are told apart by 64-bit hashes; at 10^13 of them some millions would share counts.

Texts of a group are read side by side.  A long one is cut into lanes for that: a lane starts at the root some tokens
before its own (order - 1), after which it is in the state that the whole text would be in, as a state is the longest
history of at most that many tokens.

Null and empty texts are one end token.  doc_id null counts as training text.  Repeated rows score alike.  A text isn't
split between groups: the task that reads a very long one needs about 30 times its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BUCKET_BYTES, GROUP_BYTES, ask, grouped, groups_for, in_bytes, mixed, spans_of, stored, word_memo
from .substring import ddl

END = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1B54A32D192ED03)
#: Tokens that a lane reads.
LANE = 512
ASKED = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("n", pa.int32()), ("size", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERED = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("n", pa.int32()), ("size", pa.int64()), ("totals", pa.binary()), ("tokens", pa.int64()), ("words", pa.int64())])
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


class Grams:
    """The n-grams, n up to order, that end at each token of the texts of one group.  The lowest two bits of a key are n - 1."""

    def __init__(self, raws: list[bytes], order: int):
        if not 1 <= order <= 4:
            raise ValueError("keys hold orders from 1 to 4")
        memo = word_memo()
        tokens = []
        for raw in raws:
            words = raw.lower().split()
            ids = np.empty(len(words) + 1, np.uint64)
            ids[:-1] = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
            ids[-1] = END
            tokens.append(ids)
        self.order = order
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        #: place of a token in its text; n-grams may start at place -1, an end token before the text
        self.place = np.arange(len(flat)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.keys: list[np.ndarray] = []  # of each order: sorted distinct keys
        self.at: list[np.ndarray] = []  # and which of them ends at each token
        gram = mixed(flat)
        for n in range(1, order + 1):
            if n > 1:
                gram = mixed(gram * STEP + np.where(self.place >= n - 1, np.roll(flat, n - 1), END))
            keys, inverse = np.unique(gram & ~np.uint64(3) | np.uint64(n - 1), return_inverse=True)
            self.keys.append(keys)
            self.at.append(inverse.astype(np.int32))

    def training_counts(self, training: np.ndarray) -> list[np.ndarray]:
        use = np.repeat(training, self.lengths)
        return [np.bincount(at, use & (self.place >= n - 1), len(keys)).astype(np.uint64) for n, (at, keys) in enumerate(zip(self.at, self.keys, strict=True))]


class Automaton:
    """States, arcs and failure arcs that the texts of a group can reach.

    An n-gram is an arc if it occurs in training; one of fewer than `order` tokens that does is also a state, with the
    same number; the last number is the root.  All words are arcs of the root, seen or not.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], n_tokens: int, n_words: int, weight: float):
        self.grams, order = grams, grams.order
        first = np.cumsum([0, *map(len, grams.keys)])
        self.root = int(first[-1])
        size, here = self.root + 1, np.arange(len(grams.place))
        total = np.zeros(size)
        total[:-1] = np.concatenate(counts) if counts else 0
        ends = [at.astype(np.int64) + first[n] for n, at in enumerate(grams.at)]
        self.ends = np.stack(ends) if len(here) else np.zeros((order, 0), np.int64)
        self.depth, self.fail, self.target = np.zeros(size, np.int8), np.full(size, self.root), np.full(size, self.root)
        probability, self.fail_weight = np.zeros(size), np.zeros(size)
        end = int(ends[0][int(grams.lengths[0]) - 1]) if len(here) else self.root
        self.start = end if total[end] > 0 else self.root
        for n in range(order):
            own = np.arange(first[n], first[n + 1])
            example = np.empty(len(own), np.int64)  # a token where the n-gram ends
            valid = here[grams.place >= n - 1] if n else here
            example[:] = -1
            example[ends[n][valid] - first[n]] = valid
            own, example = own[example >= 0], example[example >= 0]
            if n == 0:
                probability[own] = (total[own] + 1) / (n_tokens + n_words + 1)
                suffix = np.full(len(own), self.root)
            else:
                suffix = ends[n - 1][example]
                history = np.where(grams.place[example] > 0, ends[n - 1][example - 1], end)
                probability[own] = (total[own] + weight * probability[suffix]) / (total[history] + weight)
            seen = total[own] > 0
            if n < order - 1:
                states = own[seen]
                self.depth[states], self.fail[states], self.target[states] = n + 1, suffix[seen], states
                self.fail_weight[states] = np.log(weight / (total[states] + weight))
            else:
                self.target[own[seen]] = suffix[seen]
        self.is_arc = total > 0
        self.is_arc[first[0] : first[1]] = True
        with np.errstate(divide="ignore"):
            self.arc_weight = np.log(probability)
        self.known = total[ends[0]] > 0 if len(here) else np.zeros(0, bool)

    def read(self) -> np.ndarray:
        """ln P of each token: one traversal from left to right, the state carried from token to token."""
        grams, warm = self.grams, self.grams.order - 1
        n_lanes = -(-grams.lengths // LANE)
        text = np.repeat(np.arange(len(grams.lengths)), n_lanes)
        part = np.arange(len(text)) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes)
        begins = (np.cumsum(grams.lengths) - grams.lengths)[text]
        own = begins + part * LANE
        stop = np.minimum(own + LANE, begins + grams.lengths[text])
        at = np.maximum(own - warm, begins)
        state = np.where(at == begins, self.start, self.root)
        out = np.zeros(len(grams.place))
        while len(at):
            depth = self.depth[state]
            gram = self.ends[depth, at]
            passed = np.zeros(len(at))
            stuck = np.flatnonzero(~self.is_arc[gram])
            while len(stuck):  # failure arcs
                passed[stuck] += self.fail_weight[state[stuck]]
                state[stuck] = self.fail[state[stuck]]
                gram[stuck] = self.ends[self.depth[state[stuck]], at[stuck]]
                stuck = stuck[~self.is_arc[gram[stuck]]]
            mine = at >= own
            out[at[mine]] = (passed + self.arc_weight[gram])[mine]
            state = self.target[gram]
            at = at + 1
            if (at == stop).any():
                go = at < stop
                at, own, stop, state = at[go], own[go], stop[go], state[go]
        return out

    def unigrams(self) -> np.ndarray:
        """ln P of each token under the root alone."""
        return self.arc_weight[self.ends[0]] if self.ends.size else np.zeros(0)


def squeezed(counts: np.ndarray) -> bytes:
    """Counts in a byte each, those from 255 on in eight more at the end; compressed."""
    data = np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unsqueezed(data: bytes, n: int) -> np.ndarray:
    data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    counts = np.frombuffer(data, np.uint8, n).astype(np.uint64)
    counts[counts == 255] = np.frombuffer(data, "<u8", offset=n)
    return counts


def key_bytes(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, all lowest bytes first, compressed."""
    planes = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def keys_of(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def scores(docs: DataFrame, order: int = 2, weight: float = 8.0, fold: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs(doc_id, text)."""
    n_bytes = in_bytes(docs)
    n_groups = groups_for(docs, n_bytes, GROUP_BYTES // 2)
    n_buckets = max(16, -(-n_bytes * order // BUCKET_BYTES))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == held, F.lit(False))
    base = grouped(docs, n_groups, held_out.alias("held_out"))
    trained = lambda t: ~t.column("held_out").to_numpy()

    def send(texts: pa.Table) -> pa.Table:
        grams, rows = Grams(texts.column("raw").to_pylist(), order), []
        g = texts.column("g")[0].as_py()
        for n, (keys, counts) in enumerate(zip(grams.keys, grams.training_counts(trained(texts)), strict=True)):
            at = spans_of(ask(keys, n_buckets), n_buckets).tolist()
            rows += [(b, g, n, j - i, key_bytes(keys[i:j]), squeezed(counts[i:j])) for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ASKED, strict=True)], schema=ASKED)

    def answer(sent: pa.Table) -> pa.Table:
        sizes = sent.column("size").to_pylist()
        keys = np.concatenate([keys_of(k, n) for k, n in zip(sent.column("keys").to_pylist(), sizes, strict=True)])
        counts = np.concatenate([unsqueezed(c, n) for c, n in zip(sent.column("counts").to_pylist(), sizes, strict=True)])
        order_ = np.argsort(keys, kind="stable")
        new = np.flatnonzero(np.r_[True, keys[order_][1:] != keys[order_][:-1]])
        total = np.add.reduceat(counts[order_], new)
        words = total[(keys[order_[new]] & np.uint64(3)) == 0]
        back = np.empty(len(keys), np.uint64)
        back[order_] = np.repeat(total, np.diff(np.r_[new, len(keys)]))
        once = lambda n: pa.array([int(n)] + [0] * (len(sizes) - 1), pa.int64())
        totals = pa.array([squeezed(b) for b in np.split(back, np.cumsum(sizes)[:-1])], pa.binary())
        return pa.Table.from_arrays([*(sent.column(c) for c in ("bucket", "g", "n", "size")), totals, once(words.sum()), once((words > 0).sum())], schema=ANSWERED)

    sent = base.groupBy("g").applyInArrow(send, ddl(ASKED))
    answers = stored(sent.groupBy("bucket").applyInArrow(answer, ddl(ANSWERED)), "ngram-counts")
    n_tokens, n_words = (int(x or 0) for x in answers.agg(F.sum("tokens"), F.sum("words")).first())

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Grams(texts.column("raw").to_pylist(), order)
        counts = [np.zeros(len(keys), np.uint64) for keys in grams.keys]
        at = [spans_of(ask(keys, n_buckets), n_buckets).tolist() for keys in grams.keys]
        for b, n, totals in zip(*(answers.column(c).to_pylist() for c in ("bucket", "n", "totals")), strict=True):
            counts[n][at[n][b] : at[n][b + 1]] = unsqueezed(totals, at[n][b + 1] - at[n][b])
        automaton = Automaton(grams, counts, n_tokens, n_words, weight)
        starts = np.cumsum(grams.lengths) - grams.lengths
        known = np.add.reduceat(automaton.known.astype(np.int64), starts)
        of_text = lambda x: pa.array(np.add.reduceat(x, starts) / np.log(10))
        return pa.Table.from_arrays([texts.column("doc_id").cast(pa.int64()), texts.column("held_out"), pa.array(grams.lengths), pa.array(known), pa.array(np.full(len(known), n_tokens)), of_text(automaton.unigrams()), of_text(automaton.read())], schema=SCORED)

    return base.groupBy("g").cogroup(answers.select("bucket", "g", "n", "totals").groupBy("g")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
