"""Language of code-switched text, by a linear-chain conditional random field over words.

Features of a word: all its byte strings of length 1 to 4, with marks for its start and end (those with a mark are its
affixes), and the word itself as a lexicon entry, hashed into 2**bits weights a language.  Transition weights between
the languages of neighbouring words are learnt too.  Forward-backward gives each word the probability of each language;
a text's language is the one with the largest sum over its words with letters, its score the mean probability there.

Fitting takes, of each language, at most `sample` rows, those with the smallest hash of doc_id; of texts over `longest`
bytes, 16 runs of words from places that follow from that hash, together about that long (documented bounds).  As whole
texts are labelled, not words, training sequences are cut from texts of several languages at random places, so that
transitions see switches; the switch rate is a parameter of that cutting.

Sequences are computed in chunks: products of transfer matrices of all chunks at once, then along the chunks of each
text, then inside all chunks; the result is that of the plain recursion, for whole texts of any length.

Null texts and texts without a letter are `und` with score 0.0, as is every text if there is nothing to learn from.
Ties go to the first language in order.  Rows with null lang are not learnt from but are predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import looked_up, mixed
from .toxicity import OUTER

GRAMS = 4
CHUNK = 32


def features(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) pairs of all words, as flat arrays in the order of words."""
    marked = [b"\x02" + w + b"\x03" for w in words]
    sizes = np.array([len(w) for w in marked], np.int64)
    data = np.concatenate([np.frombuffer(b"".join(marked), np.uint8), np.zeros(GRAMS, np.uint8)]).astype(np.uint64)
    n = int(sizes.sum())
    owner = np.repeat(np.arange(len(words)), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    found, owners = [], []
    code = np.zeros(n, np.uint64)
    for k in range(1, GRAMS + 1):
        code = code << np.uint64(8) | data[k - 1 : k - 1 + n]
        inside = room >= k
        found.append(mixed(code[inside] << np.uint64(3) | np.uint64(k)))
        owners.append(owner[inside])
    found.append(np.array([xxhash.xxh64_intdigest(w, 5) for w in words], np.uint64))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(found)[order] & np.uint64((1 << bits) - 1)).astype(np.int64), owner[order]


def core(word: bytes) -> bytes:
    """The word in lower case without outer punctuation; empty if it has no letter."""
    text = word.strip(OUTER).decode("utf-8", "replace").lower()
    return text.encode() if any(map(str.isalpha, text)) else b""


@dataclass
class Field:
    languages: list[str]
    bits: int
    w: np.ndarray  # 2**bits x languages
    trans: np.ndarray  # from x to

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """One row a word; zeros for empty words."""
        out = np.zeros((len(words), len(self.languages)))
        some = [i for i, w in enumerate(words) if w]
        for at in range(0, len(some), 20_000):
            part = some[at : at + 20_000]
            f, owner = features([words[i] for i in part], self.bits)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[part] = np.add.reduceat(self.w[f], first) / np.sqrt(np.diff(np.r_[first, len(f)]))[:, None]
        return out


def marginals(e: np.ndarray, a: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probabilities of each label at each place of several sequences, flat as e; a: exp of the transitions."""
    n_labels = e.shape[1]
    e = np.exp(e - e.max(axis=1, keepdims=True))
    n_chunks = -(-lengths // CHUNK)
    total = int(n_chunks.sum())
    # rows of a padded table: chunk x place
    chunk_of = np.repeat(np.cumsum(n_chunks) - n_chunks, lengths)
    place = np.arange(len(e)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, col = chunk_of + place // CHUNK, place % CHUNK
    table = np.ones((CHUNK, total, n_labels))
    live = np.zeros((CHUNK, total, 1), bool)
    table[col, row], live[col, row] = e, True
    product = np.broadcast_to(np.eye(n_labels), (total, n_labels, n_labels)).copy()
    for t in range(CHUNK):
        new = (product.reshape(-1, n_labels) @ a).reshape(total, n_labels, n_labels) * table[t][:, None, :]
        new /= new.sum(axis=(1, 2), keepdims=True)
        product = np.where(live[t][:, :, None], new, product)
    starts = np.cumsum(n_chunks) - n_chunks
    before, after = np.full((total, n_labels), 1 / n_labels), np.full((total, n_labels), 1 / n_labels)
    for k in range(1, int(n_chunks.max(initial=0))):
        at = starts[n_chunks > k] + k
        v = np.einsum("ni,nij->nj", before[at - 1], product[at - 1])
        before[at] = v / v.sum(axis=1, keepdims=True)
    for k in range(int(n_chunks.max(initial=0)) - 2, -1, -1):
        at = starts[n_chunks > k + 1] + k
        v = np.einsum("nij,nj->ni", product[at + 1], after[at + 1])
        after[at] = v / v.sum(axis=1, keepdims=True)
    forward = np.empty((CHUNK, total, n_labels))
    v = before
    for t in range(CHUNK):
        new = (v @ a) * table[t]
        v = forward[t] = np.where(live[t], new / new.sum(axis=1, keepdims=True), v)
    v = after
    for t in range(CHUNK - 1, -1, -1):
        forward[t] *= v
        new = (table[t] * v) @ a.T
        v = np.where(live[t], new / new.sum(axis=1, keepdims=True), v)
    out = forward[col, row]
    return out / out.sum(axis=1, keepdims=True)


def sequences(texts: list[list[bytes]], langs: list[int], n: int, length: int, switch: float, random: np.random.Generator) -> tuple[list[bytes], np.ndarray]:
    """n training sequences of `length` words, and their labels."""
    by = {k: [t for t, g in zip(texts, langs, strict=True) if g == k and t] for k in set(langs)}
    kinds = [k for k in sorted(by) if by[k]]
    words: list[bytes] = []
    labels: list[int] = []
    while kinds and len(words) < n * length:
        k = kinds[random.integers(len(kinds))]
        text = by[k][random.integers(len(by[k]))]
        run = min(int(random.geometric(switch)), len(text))
        at = int(random.integers(len(text) - run + 1))
        words += text[at : at + run]
        labels += [k] * run
    return words[: n * length], np.array(labels[: n * length], np.int64)


def fit(texts: list[bytes], langs: list[str], bits: int = 18, n: int = 6000, length: int = CHUNK, switch: float = 0.05, epochs: int = 3, batch: int = 64, rate: float = 0.3, decay: float = 1e-6, seed: int = 3) -> Field:
    languages = sorted(set(langs))
    k = len(languages)
    field = Field(languages, bits, np.zeros((1 << bits, k)), np.zeros((k, k)))
    random = np.random.default_rng(seed)
    cores = [[c for c in map(core, t.split()) if c] for t in texts]
    words, y = sequences(cores, [languages.index(x) for x in langs], n, length, switch, random)
    if k < 2 or not words:
        return field
    distinct = sorted(set(words))
    index = {w: i for i, w in enumerate(distinct)}
    at = np.array([index[w] for w in words])
    f, owner = features(distinct, bits)
    first = np.searchsorted(owner, np.arange(len(distinct) + 1))
    g2, t2 = np.full(field.w.shape, 1e-6), np.full((k, k), 1e-6)
    n = len(words) // length
    for _ in range(epochs):
        order = random.permutation(n)
        for i in range(0, n, batch):
            pick = order[i : i + batch]
            places = (pick[:, None] * length + np.arange(length)).ravel()
            used, inverse = np.unique(at[places], return_inverse=True)
            counts = first[used + 1] - first[used]
            rows = np.repeat(np.arange(len(used)), counts)
            flat = f[np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[used], counts)]
            scale = 1 / np.sqrt(counts)
            e_word = np.add.reduceat(field.w[flat], np.cumsum(counts) - counts) * scale[:, None]
            e = e_word[inverse]
            a = np.exp(field.trans)
            p = marginals(e, a, np.full(len(pick), length))
            label = y[places]
            wrong = p
            wrong[np.arange(len(p)), label] -= 1
            # expected transitions: from marginals of pairs, by a forward and a backward pass over all sequences
            pair = pair_marginals(e.reshape(len(pick), length, k), a)
            gold = label.reshape(len(pick), length)
            d_trans = pair.copy()
            np.add.at(d_trans, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), -1)
            d_trans /= len(places)
            t2 += d_trans**2
            field.trans -= 0.3 * rate * d_trans / np.sqrt(t2)
            by_word = np.zeros((len(used), k))
            np.add.at(by_word, inverse, wrong / len(places))
            touched, where = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(where, (by_word[:, c] * scale)[rows], len(touched)) for c in range(k)], axis=1) + decay * field.w[touched]
            g2[touched] += grad**2
            field.w[touched] -= rate * grad / np.sqrt(g2[touched])
    return field


def pair_marginals(e: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Expected transitions, summed over sequences of one length (sequences x places x labels)."""
    e = np.exp(e - e.max(axis=2, keepdims=True))
    n, length, k = e.shape
    forward, v = np.empty_like(e), np.full((n, k), 1 / k)
    for t in range(length):
        v = (v @ a) * e[:, t]
        v = forward[:, t] = v / v.sum(axis=1, keepdims=True)
    total, v = np.zeros((k, k)), np.ones((n, k))
    for t in range(length - 1, 0, -1):
        joint = forward[:, t - 1, :, None] * a[None] * (e[:, t] * v)[:, None, :]
        total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        v = (e[:, t] * v) @ a.T
        v /= v.sum(axis=1, keepdims=True)
    return total


def runs(raw: bytes, longest: int, seed: int, parts: int = 16) -> list[bytes]:
    """A text whole, or, over `longest` bytes, runs of its words from `parts` places."""
    if len(raw) <= longest:
        return [raw]
    size, span = longest // parts, len(raw) // parts
    out = []
    for i in range(parts):
        at = i * span + xxhash.xxh64_intdigest(b"%d" % i, seed & (1 << 64) - 1) % (span - size + 1)
        words = raw[at : at + size].split()
        out.append(b" ".join(words[1:-1] or words))  # words at its ends may be cut
    return out


def learnt(docs: DataFrame, fold: int = 3, held: int = 1, sample: int = 400, longest: int = 16_384, **how) -> Field:
    """A field from docs(doc_id, text, lang), without the held-out fold.

    Rows to learn from are first thinned to about twice `sample` a language, by a limit on the hash that follows from
    counts, so that the ranking takes few rows of any language.
    """
    rows = docs.where("lang is not null and text is not null").where(F.crc32(F.col("doc_id").cast("string")) % fold != held)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id").alias("h"), F.col("text").cast("binary").alias("raw"), F.col("lang").cast("string").alias("lang"))
    share = (F.lit(2.0 * sample + 200) / F.count("*")).alias("share")
    few = rows.groupBy("lang").agg(share)
    near = looked_up(rows, few, "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) < F.col("share")).select("doc_id", "h", "raw", "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [runs(raw, longest, h) for raw, h in zip(b.column("raw").to_pylist(), b.column("h").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(found, pa.list_(pa.binary())), b.column("lang")], ["doc_id", "h", "raws", "lang"])

    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("raws")))
    chosen = near.mapInArrow(cut, "doc_id long, h long, raws array<binary>, lang string").withColumn("rank", rank).where(F.col("rank") <= sample)
    got = chosen.select("doc_id", "lang", F.explode("raws").alias("raw")).toPandas()
    got = got.sort_values(["doc_id", "lang", "raw"], kind="stable")
    return fit(list(map(bytes, got["raw"])), got["lang"].tolist(), **how)


class Reader:
    """Words to emission rows, by a table that is kept up to `most` words."""

    def __init__(self, field: Field, most: int = 400_000):
        self.field, self.most = field, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.table = np.zeros((1024, len(self.field.languages)))
        self.lettered = np.zeros(1024, bool)

    def rows(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.index]
        if len(self.index) + len(new) > self.most:
            self.clear()
            new = list(set(words))
        at = len(self.index)
        if new:
            new.sort()
            if at + len(new) > len(self.table):
                grow = max(len(self.table), at + len(new))
                self.table = np.concatenate([self.table, np.zeros((grow, self.table.shape[1]))])
                self.lettered = np.concatenate([self.lettered, np.zeros(grow, bool)])
            cores = [core(w) for w in new]
            self.table[at : at + len(new)] = self.field.emissions(cores)
            self.lettered[at : at + len(new)] = [bool(c) for c in cores]
            self.index |= dict(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


def predict(field: Field, reader: Reader, raws: list[bytes]) -> tuple[list[str], np.ndarray]:
    tokens = [r.split() for r in raws]
    lengths = np.array([len(t) for t in tokens], np.int64)
    names, scores = ["und"] * len(raws), np.zeros(len(raws))
    full = np.flatnonzero(lengths)
    if not field.languages or not len(full):
        return names, scores
    at = reader.rows([w for t in tokens for w in t])
    p = marginals(reader.table[at], np.exp(field.trans), lengths[full])
    lettered = reader.lettered[at]
    starts = (np.cumsum(lengths) - lengths)[full]
    sums = np.add.reduceat(p * lettered[:, None], starts)
    counts = np.add.reduceat(lettered.astype(np.int64), starts)
    best = sums.argmax(axis=1)
    for i, b, s, c in zip(full.tolist(), best.tolist(), sums.max(axis=1).tolist(), counts.tolist(), strict=True):
        if c:
            names[i], scores[i] = field.languages[b], min(1.0, s / c)
    return names, scores


def predicted(docs: DataFrame, field: Field, fold: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs(doc_id, text)."""
    used = np.flatnonzero((field.w != 0).any(axis=1))  # at most 2**bits rows: a fixed bound
    languages, bits, w, trans = field.languages, field.bits, field.w[used], field.trans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((1 << bits, len(languages)))
        weights[used] = w
        own = Field(languages, bits, weights, trans)
        reader = Reader(own)
        for b in batches:
            raws, names, scores = b.column("raw").to_pylist(), [], []
            at = 0
            while at < len(raws):  # about 100,000 words at a time
                to, size = at, 0
                while to < len(raws) and (to == at or size + len(raws[to]) < 600_000):
                    size += len(raws[to])
                    to += 1
                n, s = predict(own, reader, raws[at:to])
                names += n
                scores += s.tolist()
                at = to
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
