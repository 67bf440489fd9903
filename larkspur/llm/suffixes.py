"""Removal of repeated byte strings, by longest-previous-factor arrays over bucketed suffixes.

A byte goes if a string of `least` bytes over it also starts at another place, in the same document or another.

The array: with suffixes in order and the common prefixes of neighbours, the longest match of a place at a smaller one is
that with the previous or the next place in suffix order that is smaller (`previous_factors`).  `lpf` takes it for one
sequence; `repeated` for windows of `least` bytes, whose order and common prefixes are cut off there, both for earlier
matches and (with the order of places turned round) for later ones.

For a corpus, suffixes are first brought together that can match at all.  Of the `gram`-byte strings in a window of
`least` bytes, that with the smallest hash (the first of equals) is the window's anchor; equal windows have equal
anchors at equal places.  Every window belongs to one anchor, an anchor to a range of windows, and a range spans a
stretch of bytes.
1. Anchors are counted over the corpus, and so are stretches.  Windows of an anchor that occurs once are unique;
   windows of a stretch that occurs twice are repeats.
2. What is left are stretches at the ends of repeated passages, whose anchor also occurs in other stretches.  These
   distinct stretches go to their anchor's bucket, which puts their windows in order by their bytes and takes the array;
   a window is removed if its longest earlier or later match reaches `least`.
An anchor with more than `hot` different stretches, or more than `crowd` in one group of documents, doesn't meet in one
bucket: its windows are dealt by a 128-bit name of their bytes instead, once per group of documents, which needs no more
than a count.  A group counts an anchor with more than `crowd` stretches as one entry.
Texts are hashed once: a group's anchors are stored (some 0.3 bytes a byte of text) and read again with its texts, which are put in
one order each time.

Null and empty texts have no bytes.  Texts shorter than `least` lose nothing.  Repeated rows are different documents.  A
text isn't split between groups: the task that reads a very long one needs about 25 times its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BUCKET_BYTES, ask, grouped, groups_for, in_bytes, mixed, spans_of, stored
from .substring import ddl, shifted

A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text that are hashed at once: arrays of eight bytes for each stay in a core's cache.
SLICE = 256 << 10
ONCE, REPEATED, MIXED, MIXED_REPEATED, HOT, HOT_REPEATED = range(6)
#: Kind of the row that holds a group's own anchors; rows of kinds 0 to 2 go to buckets.
OWN = 3
ASKED = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("crowded", pa.binary())])
ANSWERED = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("kind", pa.int32()), ("told", pa.binary())])


def suffix_order(text: np.ndarray, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a sequence and the rank of each suffix, by prefix doubling; up to `least` places deep if given (equal ranks then)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    deep = 1
    while n and (least is None or deep < least):
        step = deep if least is None else min(deep, least - deep)
        after = np.concatenate([rank[step:], np.zeros(min(step, n), np.int64)])
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        deep += step
        if least is None and (deep >= n or rank.max() == n):
            break
    return np.argsort(rank, kind="stable"), rank


def previous_factors(place: np.ndarray, common: np.ndarray, floor: int = 0) -> np.ndarray:
    """Per rank in suffix order, its longest common prefix with a suffix at a smaller place; below `floor` any smaller number.

    place: where the suffix of each rank starts; common: its common prefix with the one of the rank before.  For each rank
    the previous and the next rank with a smaller place are found by following those of the ranks passed, all at once.
    """
    n = len(place)
    out = np.zeros(n, np.int64)
    for back in (False, True):
        p = place[::-1] if back else place
        least = np.r_[0, common[1:][::-1]] if back else common.copy()
        if n:
            least[0] = 0
        to = np.arange(n) - 1
        open_ = np.flatnonzero(least >= max(1, floor))
        open_ = open_[p[to[open_]] > p[open_]]
        while len(open_):
            over = to[open_]
            least_now, to_now = np.minimum(least[open_], least[over]), to[over]
            least[open_], to[open_] = least_now, to_now
            open_ = open_[(least_now >= max(1, floor)) & (to_now >= 0)]
            open_ = open_[p[to[open_]] > p[open_]]
        least[to < 0] = 0
        ended = np.where(p[np.maximum(to, 0)] < p, least, 0) if n else least
        out = np.maximum(out, ended[::-1] if back else ended)
    return out


def lpf(text: np.ndarray) -> np.ndarray:
    """For each place the length of the longest string there that also starts earlier."""
    n = len(text)
    order, rank = suffix_order(text)
    common, h = np.zeros(n, np.int64), 0  # of the suffixes at ranks r - 1 and r (Kasai)
    values, rank = text.tolist(), rank - 1
    for p in range(n):
        if rank[p]:
            q = int(order[rank[p] - 1])
            while max(p, q) + h < n and values[p + h] == values[q + h]:
                h += 1
            common[rank[p]] = h
            h = max(0, h - 1)
        else:
            h = 0
    out = np.zeros(n, np.int64)
    out[order] = previous_factors(order, common)
    return out


def window_order(data: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of `least` bytes (by which of starts), in order of their bytes, equal ones by place; and the common prefix of each with the one before.

    Refined from the left: windows that share a prefix are sorted by their next 8 bytes.  Bytes that all of them share
    besides are skipped by names of 16, 32, 64 or 128 bytes at once.  A window that shares its prefix with no other is done.
    """
    eight, steps = packed_bytes(data, 8), [k for k in (16, 32, 64, 128) if k <= least]
    names = dict(zip(steps, window_names(data, tuple(steps)), strict=True))
    order, common = np.arange(len(starts)), np.full(len(starts), least, np.int64)
    if len(starts):
        common[0] = 0
    # open groups: ranks that share a prefix of `deep` bytes, next to each other
    rank, edge = np.arange(len(starts)), np.zeros(min(1, len(starts)), np.int64)
    deep = np.zeros(len(edge), np.int64)
    while len(rank):
        sizes = np.diff(np.r_[edge, len(rank)])
        for step in steps[::-1]:
            can = deep + step <= least
            at = starts[order[rank]] + np.repeat(np.where(can, deep, 0), sizes)
            name = names[step][at]
            deep += step * (can & np.logical_and.reduceat(name == np.repeat(name[edge], sizes), edge))
        key = eight[np.minimum(starts[order[rank]] + np.repeat(deep, sizes), len(data) - 1)]
        left = np.repeat(np.minimum(least - deep, 8), sizes)
        key = np.where(left > 0, key >> (np.uint64(8) * (8 - np.maximum(left, 1)).astype(np.uint64)), np.uint64(0))
        group = np.repeat(np.arange(len(edge)), sizes)
        by = np.lexsort((key, group))
        order[rank], key = order[rank][by], key[by]
        split = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
        inside = np.flatnonzero(split & np.r_[False, group[1:] == group[:-1]])  # a boundary between two of one group
        apart = (key[inside] ^ key[inside - 1]).astype(np.uint64)
        high = np.frexp(apart.astype(np.float64))[1]  # bits up to the first that differs; rounding up a power is put right below
        high = np.where(np.left_shift(np.uint64(1), (high - 1).astype(np.uint64)) > apart, high - 1, high)
        common[rank[inside]] = deep[group[inside]] + left[inside] - -(-high // 8)
        edge = np.flatnonzero(split)
        deep = np.minimum(deep[group[edge]] + 8, least)
        sizes = np.diff(np.r_[edge, len(rank)])
        go = np.repeat((sizes > 1) & (deep < least), sizes)
        kept = (sizes > 1) & (deep < least)
        rank, sizes, deep = rank[go], sizes[kept], deep[kept]
        edge = np.cumsum(sizes) - sizes
    return order, common


def repeated(data: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Per start (rising), whether its longest earlier or later match among the starts has `least` bytes."""
    order, common = window_order(data, starts, least)
    place = starts[order]
    out = np.zeros(len(starts), bool)
    out[order] = (previous_factors(place, common, least) >= least) | (previous_factors(-place, common, least) >= least)
    return out


def repeats(text: np.ndarray, least: int, starts: np.ndarray) -> np.ndarray:
    """repeated() of a sequence of small numbers."""
    return repeated(text.astype(np.uint8), starts, least)


def packed_bytes(data: np.ndarray, step: int) -> np.ndarray:
    """Each place's 8 bytes as one number, in the order of the bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(step):
        out = out << np.uint64(8) | padded[k : k + len(data)]
    return out


def window_names(data: np.ndarray, lengths: tuple[int, ...], seed: int = 0) -> list[np.ndarray]:
    """Names of the strings of each of these lengths (rising, at least 8) at each place, made by doubling; equal strings have equal names."""
    name, n, out = mixed(packed_bytes(data, 8) ^ np.uint64(seed)), 8, []
    for to in lengths:
        while n < to:
            step = min(n, to - n)
            other = shifted(name, step)
            name = name * A + (other ^ (other >> np.uint64(29))) * B
            name ^= name >> np.uint64(32)
            n += step
        out.append(mixed(name))
    return out


class Anchors:
    """Anchors of one group's texts: where they are, their windows' range, and hashes of anchor and stretch."""

    def __init__(self, raws: list[bytes], least: int, gram: int, crowd: int = 256, found: bytes | None = None):
        self.raws, self.least = raws, least
        self.sizes = np.array([len(r) for r in raws], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        cols = self.of_texts(gram) if found is None else self.unpacked(found)
        #: places count through all texts of the group
        self.place, self.first, self.last, self.anchor, self.stretch = cols
        pair = np.empty(len(self.anchor), np.dtype([("a", "<u8"), ("s", "<u8")]))
        pair["a"], pair["s"] = self.anchor, self.stretch
        order = np.lexsort((self.stretch, self.anchor))
        new = np.r_[True, pair[order][1:] != pair[order][:-1]] if len(order) else np.zeros(0, bool)
        self.which = np.zeros(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.example = order[new]  # an occurrence of each distinct (anchor, stretch), sorted
        self.keys, self.stretches = self.anchor[self.example], self.stretch[self.example]
        self.twice = np.bincount(self.which, minlength=len(self.keys)) > 1
        # what is asked for: each (anchor, stretch), but an anchor with more than `crowd` stretches here as one entry
        new_key = np.r_[True, self.keys[1:] != self.keys[:-1]] if len(self.keys) else np.zeros(0, bool)
        of_key = np.cumsum(new_key) - 1
        crowded = np.bincount(of_key, minlength=1)[of_key] > crowd
        entry = new_key | ~crowded
        self.entry_of = np.cumsum(entry) - 1
        self.crowded_pair = crowded
        self.entry_keys, self.entry_stretches = self.keys[entry], np.where(crowded, 0, self.stretches)[entry].astype(np.uint64)
        self.entry_twice, self.entry_crowded = (self.twice & ~crowded)[entry], crowded[entry]

    def of_texts(self, gram: int) -> list[np.ndarray]:
        raws, parts = self.raws, []
        at = 0
        while at < len(raws):
            to, n = at, 0
            while to < len(raws) and (to == at or n + len(raws[to]) <= SLICE):
                n += len(raws[to])
                to += 1
            parts.append(self.of_slice(at, to, gram))
            at = to
        return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2

    def packed(self) -> bytes:
        """What hashing the texts has found, for unpacked(): 26 bytes an anchor."""
        near = [(self.place - self.first).astype(np.uint8), (self.last - self.first).astype(np.uint8)]
        return b"".join(x.tobytes() for x in (self.anchor, self.stretch, self.first, *near))

    @staticmethod
    def unpacked(found: bytes) -> list[np.ndarray]:
        n = len(found) // 26
        anchor, stretch, first = (np.frombuffer(found, t, n, 8 * n * i) for i, t in enumerate((np.uint64, np.uint64, np.int64)))
        place, last = (first + np.frombuffer(found, np.uint8, n, 24 * n + i * n) for i in range(2))
        return [place, first, last, anchor, stretch]

    def of_slice(self, at: int, to: int, gram: int) -> tuple[np.ndarray, ...]:
        least = self.least
        data = np.frombuffer(b"".join(self.raws[at:to]), np.uint8)
        room = np.repeat(self.offsets[at:to] + self.sizes[at:to], self.sizes[at:to]) - self.offsets[at] - np.arange(len(data))
        value, whole = window_names(data, (gram, least))
        low = (value >> np.uint64(32)).astype(np.uint32)
        # the first smallest of `span` values from each place on, by doubling
        span, n = least - gram + 1, 1
        least_of, off = low, np.zeros(len(low), np.uint8)
        while n < span:
            step = min(n, span - n)
            other, other_off = shifted(least_of, step), shifted(off, step) + np.uint8(step)
            take = other < least_of
            least_of, off = np.where(take, other, least_of), np.where(take, other_off, off)
            n += step
        starts = np.flatnonzero(room >= least)
        anchor = starts + off[starts]
        edge = np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)] if len(starts) else np.zeros(0, bool)
        first = starts[edge]
        last = starts[np.r_[edge[1:], True]] if len(starts) else first
        place = anchor[edge]
        # a stretch of first .. last + least is covered by the windows at its ends: they overlap
        shape = ((place - first) << 16 | (last - first)).astype(np.uint64)
        stretch = mixed(mixed(whole[first] + shape * A) + whole[last] * B)
        base = self.offsets[at]
        # dealt by another hash: anchors have small ones, which would share a few buckets
        return place + base, first + base, last + base, mixed(value[place] ^ A), stretch

    def stretch_bytes(self, k: int) -> bytes:
        """Bytes of the stretch of occurrence k."""
        first, last = int(self.first[k]), int(self.last[k])
        doc = int(np.searchsorted(self.offsets, first, side="right")) - 1
        while self.sizes[doc] == 0:
            doc -= 1
        start = first - int(self.offsets[doc])
        return self.raws[doc][start : start + last - first + self.least]

    def codes(self, answers: list[dict], n_buckets: int) -> np.ndarray:
        code = np.zeros(len(self.entry_keys), np.uint8)
        at = spans_of(ask(self.entry_keys, n_buckets), n_buckets)
        for row in answers:
            if row["kind"] == 0:
                code[at[row["bucket"]] : at[row["bucket"] + 1]] = np.frombuffer(row["told"], np.uint8)
        code = code[self.entry_of]
        return np.where(self.crowded_pair, np.where(self.twice, HOT_REPEATED, HOT), code)

    def windows(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct 128-bit names (two numbers) of windows of hot stretches, whether this group has them twice, and which each window is (in order)."""
        hot = np.flatnonzero(code >= HOT)
        found = [self.stretch_bytes(k) for k in self.example[hot].tolist()]
        counts = np.array([len(f) - self.least + 1 for f in found], np.int64)
        first, second = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        at = 0
        while at < len(found):  # a slice at a time
            to, n = at, 0
            while to < len(found) and (to == at or n < SLICE):
                n += len(found[to])
                to += 1
            data = np.frombuffer(b"".join(found[at:to]), np.uint8)
            begins = np.cumsum([0, *map(len, found[at : to - 1])])
            starts = np.repeat(begins - (np.cumsum(counts[at:to]) - counts[at:to]), counts[at:to]) + np.arange(int(counts[at:to].sum()))
            first.append(window_names(data, (self.least,))[0][starts])
            second.append(window_names(data, (self.least,), 0x5851F42D4C957F2D)[0][starts])
            at = to
        name, check = np.concatenate(first), np.concatenate(second)
        order = np.lexsort((check, name))
        new = np.r_[True, (name[order][1:] != name[order][:-1]) | (check[order][1:] != check[order][:-1])] if len(order) else np.zeros(0, bool)
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        weight = np.repeat(np.where(code[hot] == HOT_REPEATED, 2, 1), counts)
        return np.stack([name[order][new], check[order][new]]), np.bincount(inverse, weight, int(new.sum())) > 1, inverse

def rows_of(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(ASKED), ASKED, strict=True)], schema=ASKED)


def cleaned(docs: DataFrame, least: int = 200, gram: int = 32, hot: int = 20_000, crowd: int = 256, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of docs(doc_id, text)."""
    if not 8 <= gram < least or least - gram > 255 or least > 2 * gram + 255:
        raise ValueError("gram must be from 8 to below least, and at most 255 less")
    n_bytes = in_bytes(docs)
    n_groups, n_buckets = groups_for(docs, n_bytes), max(16, -(-n_bytes // BUCKET_BYTES))
    base = grouped(docs, n_groups)

    def in_order(texts: pa.Table) -> pa.Table:
        """Rows of a group in one order at every read of it; those alike in both columns are alike."""
        raws = texts.column("raw").to_pylist()
        ids = [(d is not None, d or 0) for d in texts.column("doc_id").to_pylist()]
        return texts.take(sorted(range(len(raws)), key=lambda i: (ids[i], raws[i])))

    def read(texts: pa.Table, told: list[dict]) -> Anchors:
        own = next(row["told"] for row in told if row["kind"] == OWN)
        return Anchors(texts.column("raw").to_pylist(), least, gram, crowd, own)

    def count(texts: pa.Table) -> pa.Table:
        found, g = Anchors(in_order(texts).column("raw").to_pylist(), least, gram, crowd), texts.column("g")[0].as_py()
        at = spans_of(ask(found.entry_keys, n_buckets), n_buckets).tolist()
        own = [(0, g, OWN, found.packed(), b"", b"")]
        return rows_of(own + [(b, g, 0, found.entry_keys[i:j].tobytes() + found.entry_stretches[i:j].tobytes(), np.packbits(found.entry_twice[i:j]).tobytes(), np.packbits(found.entry_crowded[i:j]).tobytes()) for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i])

    def counted(sent: pa.Table) -> pa.Table:
        data = sent.column("keys").to_pylist()
        sizes = [len(d) // 16 for d in data]
        key = np.concatenate([np.frombuffer(d, np.uint64, n) for d, n in zip(data, sizes, strict=True)])
        stretch = np.concatenate([np.frombuffer(d, np.uint64, n, 8 * n) for d, n in zip(data, sizes, strict=True)])
        bits = lambda c: np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(sent.column(c).to_pylist(), sizes, strict=True)]).astype(bool)
        twice, crowded = bits("more"), bits("crowded")
        order = np.lexsort((stretch, key))
        k, s = key[order], stretch[order]
        new_key = np.r_[True, k[1:] != k[:-1]]
        new_pair = new_key | np.r_[True, s[1:] != s[:-1]]
        of_key, of_pair = np.cumsum(new_key) - 1, np.cumsum(new_pair) - 1
        shapes = (np.bincount(of_key, new_pair) + (hot + 1) * np.bincount(of_key, crowded[order]))[of_key]  # different stretches of the anchor
        again = (np.bincount(of_pair) > 1) | (np.bincount(of_pair, twice[order]) > 0)
        code = np.where(shapes > 1, np.where(shapes > hot, HOT, MIXED), ONCE) + again[of_pair]
        out = np.empty(len(code), np.uint8)
        out[order] = code
        return pa.Table.from_arrays([sent.column("bucket"), sent.column("g"), sent.column("kind"), pa.array([p.tobytes() for p in np.split(out, np.cumsum(sizes)[:-1])], pa.binary())], schema=ANSWERED)

    def send(texts: pa.Table, answers: pa.Table) -> pa.Table:
        told, g = answers.to_pylist(), texts.column("g")[0].as_py()
        found = read(in_order(texts), told)
        code = found.codes(told, n_buckets)
        rows = []
        at = spans_of(ask(found.keys, n_buckets), n_buckets).tolist()
        for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
            mixed_ones = i + np.flatnonzero((code[i:j] == MIXED) | (code[i:j] == MIXED_REPEATED))
            if len(mixed_ones):
                texts_ = [found.stretch_bytes(k) for k in found.example[mixed_ones].tolist()]
                lengths = np.array([len(t) for t in texts_], "<u4")
                rows.append((b, g, 1, lengths.tobytes() + b"".join(texts_), found.keys[mixed_ones].tobytes() + found.stretches[mixed_ones].tobytes(), b""))
        keys, twice, _ = found.windows(code)
        at = spans_of(ask(keys[0], n_buckets), n_buckets).tolist()
        rows += [(b, g, 2, keys[:, i:j].tobytes(), np.packbits(twice[i:j]).tobytes(), b"") for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
        return rows_of(rows)

    def matched(sent: pa.Table) -> pa.Table:
        kind = sent.column("kind")[0].as_py()
        if kind == 2:
            keys = [np.frombuffer(k, np.uint64).reshape(2, -1) for k in sent.column("keys").to_pylist()]
            sizes = [k.shape[1] for k in keys]
            twice = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(sent.column("more").to_pylist(), sizes, strict=True)])
            name, check = np.concatenate(keys, axis=1)
            order = np.lexsort((check, name))
            inverse = np.empty(len(order), np.int64)
            inverse[order] = np.cumsum(np.r_[True, (name[order][1:] != name[order][:-1]) | (check[order][1:] != check[order][:-1])]) - 1
            bits = ((np.bincount(inverse) > 1) | (np.bincount(inverse, twice) > 0))[inverse]
            told = np.split(bits, np.cumsum(sizes)[:-1])
        else:
            pairs, texts, owners = [], [], []
            for row, (data, more) in enumerate(zip(sent.column("keys").to_pylist(), sent.column("more").to_pylist(), strict=True)):
                n = len(more) // 16
                lengths = np.frombuffer(data, "<u4", n)
                ends = 4 * n + np.cumsum(lengths)
                texts += [data[e - x : e] for e, x in zip(ends.tolist(), lengths.tolist(), strict=True)]
                pairs.append(np.frombuffer(more, np.uint64).reshape(2, n).T)
                owners += [row] * n
            pair = np.concatenate(pairs)
            _, example, which = np.unique(pair, axis=0, return_index=True, return_inverse=True)
            which = which.reshape(-1)
            anchor_of = np.unique(pair[example, 0], return_inverse=True)[1]
            # suffixes of different anchors never meet: part of the anchors at a time
            flags: list[np.ndarray] = [np.zeros(0, bool)] * len(example)
            sizes = np.array([len(texts[e]) for e in example.tolist()])
            order = np.argsort(anchor_of, kind="stable")
            at = 0
            while at < len(order):
                to, total = at, 0
                while to < len(order) and (total < SLICE or anchor_of[order[to]] == anchor_of[order[to - 1]]):
                    total += int(sizes[order[to]])
                    to += 1
                part = order[at:to].tolist()
                codes = np.frombuffer(b"".join(texts[example[k]] for k in part), np.uint8)
                begin = np.cumsum(sizes[part]) - sizes[part]
                counts = sizes[part] - least + 1
                starts = np.concatenate([b + np.arange(c) for b, c in zip(begin.tolist(), counts.tolist(), strict=True)])
                hits = repeated(codes, starts, least)
                for k, f in zip(part, np.split(hits, np.cumsum(counts)[:-1]), strict=True):
                    flags[k] = f
                at = to
            by_row: list[list[np.ndarray]] = [[] for _ in range(sent.num_rows)]
            for row, w in zip(owners, which.tolist(), strict=True):
                by_row[row].append(flags[w])
            told = [np.concatenate(f) if f else np.zeros(0, bool) for f in by_row]
        return pa.Table.from_arrays([sent.column("bucket"), sent.column("g"), sent.column("kind"), pa.array([np.packbits(t).tobytes() for t in told], pa.binary())], schema=ANSWERED)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts, told = in_order(texts), answers.to_pylist()
        found = read(texts, told)
        raws, code = found.raws, found.codes(told, n_buckets)
        of = code[found.which]
        edge = np.zeros(int(found.sizes.sum()) + 1, np.int64)
        whole = np.flatnonzero((of == REPEATED) | (of == MIXED_REPEATED) | (of == HOT_REPEATED))
        np.add.at(edge, found.first[whole], 1)
        np.add.at(edge, found.last[whole] + least, -1)
        flags: dict[int, np.ndarray] = {}  # of each distinct stretch that was looked into
        n_windows = found.last - found.first + 1
        at = spans_of(ask(found.keys, n_buckets), n_buckets)
        for row in told:
            if row["kind"] == 1:
                i, j = at[row["bucket"]], at[row["bucket"] + 1]
                ones = i + np.flatnonzero((code[i:j] == MIXED) | (code[i:j] == MIXED_REPEATED))
                n = n_windows[found.example[ones]]
                bits = np.unpackbits(np.frombuffer(row["told"], np.uint8), count=int(n.sum())).astype(bool)
                flags |= dict(zip(ones.tolist(), np.split(bits, np.cumsum(n)[:-1]), strict=True))
        keys, _, inverse = found.windows(code)
        if keys.shape[1]:
            hit, at = np.zeros(keys.shape[1], bool), spans_of(ask(keys[0], n_buckets), n_buckets)
            for row in told:
                if row["kind"] == 2:
                    i, j = at[row["bucket"]], at[row["bucket"] + 1]
                    hit[i:j] = np.unpackbits(np.frombuffer(row["told"], np.uint8), count=j - i)
            ones = np.flatnonzero(code >= HOT)
            flags |= dict(zip(ones.tolist(), np.split(hit[inverse], np.cumsum(n_windows[found.example[ones]])[:-1]), strict=True))
        for k in np.flatnonzero((of == MIXED) | (of == HOT)).tolist():
            starts = found.first[k] + np.flatnonzero(flags[int(found.which[k])])
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + least, -1)
        gone = np.cumsum(edge)[:-1] > 0
        rows = []
        for doc, raw, at_, n in zip(texts.column("doc_id").to_pylist(), raws, found.offsets.tolist(), found.sizes.tolist(), strict=True):
            g = gone[at_ : at_ + n]
            n_gone = int(g.sum())
            kept = np.frombuffer(raw, np.uint8)[~g].tobytes() if n_gone else raw
            spans = int((g[1:] & ~g[:-1]).sum()) + int(g[0]) if n_gone else 0
            rows.append((doc, n, n_gone, spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)

    asked = stored(base.groupBy("g").applyInArrow(count, ddl(ASKED)), "anchors")
    own = asked.where(F.col("kind") == OWN).select("bucket", "g", "kind", F.col("keys").alias("told"))
    first = stored(asked.where(F.col("kind") == 0).groupBy("bucket").applyInArrow(counted, ddl(ANSWERED)), "anchor-codes").unionByName(own)
    sent = base.groupBy("g").cogroup(first.groupBy("g")).applyInArrow(send, ddl(ASKED))
    second = stored(sent.groupBy("kind", "bucket").applyInArrow(matched, ddl(ANSWERED)), "stretches")
    return base.groupBy("g").cogroup(first.unionByName(second).groupBy("g")).applyInArrow(finish, ddl(pa.schema(list(zip(names, kinds, strict=True)))))
