"""Substring dedup over words, by level-wise doubling.

A window is `window` consecutive words of one document.  A word goes if a window over it also occurs in a document with
a smaller id; windows are judged on the input.

Level-wise doubling: lengths grow from `first` words, each at most twice the one before, up to `window`.  Each level is
asked for over the whole corpus, and only windows that may still be repeated are extended to the next; the ladder ends
when no candidates survive, or at `window`, as longer levels couldn't change what goes.  Names of sequences are built by
doubling too: that of length 2n (or less, overlapping) is made of those of two sequences of length n.  A level below
`window` need not ask for every place: of each window one sequence inside it stands for it, that with the smallest name
(the first of equals).  Equal windows choose equal ones, so a window stays a candidate only if what stands for it is in
at least two documents.  Sequences are told apart by 64 bits at lower levels, which can only keep a candidate too many,
and by 128 bits at the last.

Texts are split by ASCII white space and compared as bytes.  Null and empty texts have no words.  Rows with one doc_id
don't remove words from each other.  doc_id null is treated as the largest.  A text isn't split between groups: the task
that reads a very long one needs about 25 times its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BUCKET_BYTES, GROUP_BYTES, ask, grouped, groups_for, in_bytes, mixed, spans_of, stored, then_released, word_memo

A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LAST = np.iinfo(np.int64).max
ASKED = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()), ("lows", pa.binary()), ("many", pa.binary())])
ANSWERED = pa.schema([("level", pa.int32()), ("bucket", pa.int32()), ("g", pa.int32()), ("many", pa.binary()), ("earlier", pa.binary()), ("left", pa.int64())])
ddl = lambda schema: ", ".join(f"{f.name} {({'int32': 'int', 'int64': 'long'}.get(str(f.type), str(f.type)))}" for f in schema)


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)])


def ladder(window: int, first: int) -> list[int]:
    """Lengths of the levels: halves of window, rounded up, down to the first of at most `first` words."""
    out = [window]
    while out[0] > max(1, first):
        out.insert(0, (out[0] + 1) // 2)
    return out


class Words:
    """The words of one group's texts, and the levels of their windows."""

    def __init__(self, ids: list, raws: list[bytes], lengths: list[int]):
        self.raws, self.levels, self.window = raws, lengths, lengths[-1]
        memo = word_memo()
        found = []
        for raw in raws:
            words = raw.split()
            found.append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
        self.lengths = np.array([len(f) for f in found], np.int64)
        flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.array([LAST if i is None else i for i in ids], np.int64), self.lengths)
        room = np.repeat(np.cumsum(self.lengths), self.lengths) - np.arange(len(flat))
        self.flat, self.names = flat, self.doubled(mixed(flat), lengths)
        #: places where a window starts
        self.starts = np.flatnonzero(room >= self.window)

    def doubled(self, name: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
        """Names of the sequences of each length from each place on."""
        n, out = 1, []
        for length in lengths:
            while n < length:
                to = min(2 * n, length)
                name, n = mixed(name * A + shifted(name, to - n) * B), to
            out.append(name)
        return out

    def standing(self, level: int, starts: np.ndarray) -> np.ndarray:
        """Where the sequence starts that stands for the window at each of starts."""
        name = self.names[level]
        least, place = name[starts], starts.copy()
        for k in range(1, self.window - self.levels[level] + 1):
            other = name[starts + k]
            better = other < least
            least, place = np.where(better, other, least), np.where(better, starts + k, place)
        return place

    def distinct(self, level: int, places: np.ndarray):
        """Sorted distinct names at places, their check names, the smallest document of each, if it has several, and which each place has."""
        # asked for under another hash: those that stand for windows have small names, which would share a few buckets
        names, checks = mixed(self.names[level][places] ^ A), np.zeros(0, np.uint64)
        if level < len(self.levels) - 1:
            keys, inverse = np.unique(names, return_inverse=True)
        else:
            second = self.doubled(mixed(self.flat ^ B), [self.window])[0][places]
            order = np.lexsort((second, names))
            k, c = names[order], second[order]
            new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])] if len(k) else np.zeros(0, bool)
            inverse = np.empty(len(k), np.int64)
            inverse[order] = np.cumsum(new) - 1
            keys, checks = k[new], c[new]
        low, high = np.full(len(keys), LAST), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, self.doc[places])
        np.maximum.at(high, inverse, self.doc[places])
        return keys, checks, low, low != high, inverse

    def asks(self, level: int, answers: dict[int, dict[int, tuple[bytes, bytes]]], n_buckets: int):
        """What a level asks for, given the answers to those before; leaves the windows that are still candidates."""
        self.candidates = self.starts
        for before in range(level):
            place = self.standing(before, self.candidates)
            places = np.unique(place)
            keys, _, _, _, inverse = self.distinct(before, places)
            many, _ = told(keys, answers.get(before, {}), n_buckets)
            good = np.zeros(len(self.flat) + 1, bool)
            good[places] = many[inverse]
            self.candidates = self.candidates[good[place]]
        return self.distinct(level, np.unique(self.standing(level, self.candidates)))

    def removed(self, answers, n_buckets: int) -> np.ndarray:
        last = len(self.levels) - 1
        if last not in answers and any(level not in answers for level in range(last)):
            return np.zeros(len(self.flat), bool)  # the ladder ended before
        keys, _, low, _, inverse = self.asks(last, answers, n_buckets)
        _, earlier = told(keys, answers.get(last, {}), n_buckets)
        hit = self.candidates[earlier[inverse] | (self.doc[self.candidates] > low[inverse])]
        edge = np.zeros(len(self.flat) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + self.window, -1)
        return np.cumsum(edge)[:-1] > 0


def told(keys: np.ndarray, answers: dict[int, tuple[bytes, bytes]], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Per key, whether it is in several documents, and whether in one before all of this group's."""
    many, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    at = spans_of(ask(keys, n_buckets), n_buckets)
    for b, (m, e) in answers.items():
        i, j = at[b], at[b + 1]
        many[i:j] = np.unpackbits(np.frombuffer(m, np.uint8), count=j - i)
        earlier[i:j] = np.unpackbits(np.frombuffer(e, np.uint8), count=j - i)
    return many, earlier


def by_level(answers: pa.Table | None) -> dict:
    out: dict[int, dict[int, tuple[bytes, bytes]]] = {}
    for row in answers.to_pylist() if answers is not None else []:
        out.setdefault(row["level"], {})[row["bucket"]] = (row["many"], row["earlier"])
    return out


def deduplicated(docs: DataFrame, window: int = 13, first: int = 7, with_text: bool = False, carry: tuple = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept], *carry) of docs(doc_id, text): kept words joined by one space.

    first: words of the lowest level, at most; carry: columns that each row of docs takes along.
    """
    n_bytes, lengths = in_bytes(docs), ladder(window, first)
    n_groups, n_buckets = groups_for(docs, n_bytes, GROUP_BYTES // 2), max(16, -(-n_bytes // BUCKET_BYTES))
    base, last = grouped(docs, n_groups), len(lengths) - 1

    def asking(level: int):
        def send(texts: pa.Table, answers: pa.Table | None = None) -> pa.Table:
            words = Words(texts.column("doc_id").to_pylist(), texts.column("raw").to_pylist(), lengths)
            g = texts.column("g")[0].as_py()
            keys, checks, low, many, _ = words.asks(level, by_level(answers), n_buckets)
            at = spans_of(ask(keys, n_buckets), n_buckets).tolist()
            rows = [(b, g, keys[i:j].tobytes(), checks[i:j].tobytes(), low[i:j].tobytes() if level == last else b"", np.packbits(many[i:j]).tobytes()) for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(ASKED), ASKED, strict=True)], schema=ASKED)

        return (lambda texts: then_released(send, texts)) if level == 0 else (lambda texts, answers: then_released(send, texts, answers))

    def answering(level: int):
        def answer(sent: pa.Table) -> pa.Table:
            keys = [np.frombuffer(k, np.uint64) for k in sent.column("keys").to_pylist()]
            own = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)) for m, k in zip(sent.column("many").to_pylist(), keys, strict=True)]).astype(bool)
            flat, earlier = np.concatenate(keys), np.zeros(len(own), bool)
            if level < last:
                inverse = np.unique(flat, return_inverse=True)[1]
            else:
                check = np.concatenate([np.frombuffer(c, np.uint64) for c in sent.column("checks").to_pylist()])
                order = np.lexsort((check, flat))
                new = np.r_[True, (flat[order][1:] != flat[order][:-1]) | (check[order][1:] != check[order][:-1])] if len(order) else np.zeros(0, bool)
                inverse = np.empty(len(order), np.int64)
                inverse[order] = np.cumsum(new) - 1
                lows = np.concatenate([np.frombuffer(x, np.int64) for x in sent.column("lows").to_pylist()])
                lowest = np.full(int(inverse.max(initial=-1)) + 1, LAST)
                np.minimum.at(lowest, inverse, lows)
                earlier = lowest[inverse] < lows
            many = ((np.bincount(inverse) > 1) | (np.bincount(inverse, own) > 0))[inverse]
            ends = np.cumsum([len(k) for k in keys])[:-1]
            bits = lambda x: pa.array([np.packbits(p).tobytes() for p in np.split(x, ends)], pa.binary())
            left = pa.array([int(p.sum()) for p in np.split(many, ends)], pa.int64())
            return pa.Table.from_arrays([pa.array(np.full(len(keys), level, np.int32)), sent.column("bucket"), sent.column("g"), bits(many), bits(earlier), left], schema=ANSWERED)

        return lambda sent: then_released(answer, sent)

    answers = None
    for level in range(len(lengths)):
        sent = base.groupBy("g").applyInArrow(asking(level), ddl(ASKED)) if answers is None else base.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(asking(level), ddl(ASKED))
        told_ = stored(sent.groupBy("bucket").applyInArrow(answering(level), ddl(ANSWERED)), "windows")
        answers = told_ if answers is None else answers.unionByName(told_)
        if level < last and not told_.agg(F.sum("left")).first()[0]:
            answers = answers.where("false")  # no candidates survive
            break
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: len(names)]

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        raws = texts.column("raw").to_pylist()
        words = Words(texts.column("doc_id").to_pylist(), raws, lengths)
        gone = words.removed(by_level(answers), n_buckets)
        rows, at = [], 0
        for doc, raw, n in zip(texts.column("doc_id").to_pylist(), raws, words.lengths.tolist(), strict=True):
            g = gone[at : at + n]
            at += n
            tokens = raw.split()
            if n_gone := int(g.sum()):
                tokens = [tokens[k] for k in np.flatnonzero(~g).tolist()]
            kept = b" ".join(tokens)
            text = [(kept if n_gone else raw).decode("utf-8", "replace")] * with_text
            rows.append((doc, n, n_gone, hashlib.sha256(kept).hexdigest(), *text))
        found = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)]
        return pa.Table.from_arrays(found + [texts.column(c) for c in carried.names], names + carried.names)

    carried = docs.select(*carry).schema
    out = ", ".join([ddl(pa.schema(list(zip(names, kinds, strict=True)))), *(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)])
    return grouped(docs, n_groups, *carry).groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(lambda texts, answers: then_released(finish, texts, answers), out)
