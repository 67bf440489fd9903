"""Benchmark decontamination by a positional inverted index over training documents.

Documents are indexed in shards of bounded bytes: a shard lists, for each term, the places where it stands, in order.
The index is written to the shared folder once; how often each term occurs is summed over all shards.  Test items are
read in blocks of bounded bytes against every shard.  A window of an item is looked for by its terms from the rarest of
the whole corpus on: places of the rarest, moved back by its offset, are candidates for where the window begins; each
next rarer term keeps those that it has a place for at its own offset.  Windows whose two rarest terms are the same, at the
same distance, share that first intersection, as neighbouring windows of an item mostly do.

With `slop`, a term may stand up to that many words away from its offset: proximity matches.

Only terms that items have can match, so only these are indexed while items have few enough (TERMS); then terms are told
apart by themselves.  Beyond that all terms are indexed by 64-bit names.

Words: A-Z lower-cased, then runs of digits, letters and characters beyond ASCII.  Null and empty texts have no words.
Rows with one doc_id, or none, are documents of their own.  Items that share an id count once; an item without id hits
words but isn't counted or listed.  A frequent term is one list a shard, so no task holds more of it than of others.  A
text isn't split: the task that reads a very long one needs about 25 times its bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, in_bytes, stored, then_released, word_hash

#: Bytes of text of a shard, and of a block of items.
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20
#: Distinct terms of items up to which no others are indexed.
TERMS = 1_000_000
#: Candidates that are looked at together.
CHUNK = 1 << 21
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "shard long, doc_ids array<long>, n_words array<long>, terms array<long>, counts array<long>, places binary"
MATCHES = "doc_id long, item_id long, item_start int, start int, length int, exact boolean"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(LETTERS).split()


def term(word: bytes) -> int:
    """A name of 64 bits, as a signed number; 0 is none."""
    return int(np.uint64(word_hash(word) or 1).astype(np.int64))


def runs(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """starts[k], starts[k] + 1, ... (counts[k] of them) for each k, and which k each belongs to."""
    of = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[of], of


class Block:
    """Distinct windows of a block of items: their terms, rarest first, and the items that have them."""

    def __init__(self, ids: list, raws: list[bytes], window: int):
        self.ids = ids
        rows, lengths, items, firsts = [], [], [], []
        for k, raw in enumerate(raws):
            names = np.array([term(w) for w in words_of(raw)], np.int64)
            if not len(names):
                continue
            n = min(window, len(names))
            own = np.zeros((len(names) - n + 1, window), np.int64)
            own[:, :n] = np.lib.stride_tricks.sliding_window_view(names, n)
            rows.append(own)
            lengths.append(np.full(len(own), n))
            items.append(np.full(len(own), k))
            firsts.append(np.arange(len(own)))
        flat = np.concatenate(rows) if rows else np.zeros((0, window), np.int64)
        self.windows, first, inverse = np.unique(flat, axis=0, return_index=True, return_inverse=True)
        self.lengths = np.concatenate(lengths)[first] if rows else np.zeros(0, np.int64)
        inverse = inverse.ravel()
        items, firsts = (np.concatenate(x) if rows else np.zeros(0, np.int64) for x in (items, firsts))
        order = np.lexsort((firsts, items, inverse))
        w, i = inverse[order], items[order]
        once = np.r_[True, (w[1:] != w[:-1]) | (i[1:] != i[:-1])] if len(w) else np.zeros(0, bool)
        #: items of each window and where it first stands in them
        self.items, self.places = i[once], firsts[order][once]
        self.at = np.searchsorted(w[once], np.arange(len(self.windows) + 1))
        self.terms = np.setdiff1d(self.windows.ravel(), [0])
        self.order = np.tile(np.arange(window), (len(self.windows), 1))

    def ranked(self, counts: dict[int, int]) -> Block:
        """With the offsets of each window in order of how often their terms occur in all documents."""
        if len(self.windows):
            n = np.array([counts.get(t, 0) for t in self.terms.tolist()], np.int64)
            often = np.where(self.windows == 0, np.iinfo(np.int64).max, n[np.minimum(np.searchsorted(self.terms, self.windows), len(n) - 1)])
            self.order = np.argsort(often, axis=1, kind="stable")
        return self


class Shard:
    """The lists of one shard.  Places of a document follow those before it after a gap that no window can bridge."""

    def __init__(self, n_words: list, terms: list, counts: list, places: bytes, gap: int):
        self.n_words = np.array(n_words, np.int64)
        before = np.cumsum(self.n_words) - self.n_words
        self.starts = before + gap * np.arange(len(before))
        self.span = int(self.n_words.sum()) + gap * (len(before) + 1)
        self.terms, self.counts = np.array(terms, np.int64), np.array(counts, np.int64)
        self.at = np.cumsum(self.counts) - self.counts
        flat = np.cumsum(np.frombuffer(places, np.int32), dtype=np.int64)
        self.places = flat + gap * (np.searchsorted(before, flat, "right") - 1) if len(before) else flat
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) * self.span + self.places

    def near(self, rank: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
        """Whether each term (by its rank) stands within slop of each place."""
        low = np.maximum(place - slop, 0)
        i = np.searchsorted(self.keys, rank * self.span + low)
        there = self.keys[np.minimum(i, len(self.keys) - 1)]
        return (i < len(self.keys)) & (there <= rank * self.span + place + slop) & (place + slop >= 0)

    def occurrences(self, block: Block, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, where it begins) for each occurrence: exact ones, or with slop those near the places of the rarest term."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(block.windows) or not len(self.terms):
            return none
        rank = np.minimum(np.searchsorted(self.terms, block.windows), len(self.terms) - 1)
        ok = np.flatnonzero(((self.terms[rank] == block.windows) | (block.windows == 0)).all(axis=1))
        if not len(ok):
            return none
        order, lengths = block.order[ok], block.lengths[ok]
        by = np.take_along_axis(rank[ok], order, axis=1)
        second = np.where(lengths > 1, by[:, 1] if order.shape[1] > 1 else 0, by[:, 0])
        apart = np.where(lengths > 1, order[:, 1] - order[:, 0] if order.shape[1] > 1 else 0, 0)
        pairs, inverse = np.unique(np.stack([by[:, 0], second, apart]), axis=1, return_inverse=True)
        inverse = inverse.ravel()
        in_pair = np.argsort(inverse, kind="stable")
        windows_at = np.searchsorted(inverse[in_pair], np.arange(pairs.shape[1] + 1))
        found = [none]
        sizes = self.counts[pairs[0]]
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK, prepend=-1))  # each part is at most CHUNK candidates more than its longest list
        for i, j in zip(cuts, np.r_[cuts[1:], pairs.shape[1]], strict=True):
            index, pair = runs(self.at[pairs[0, i:j]], sizes[i:j])
            place = self.places[index]
            kept = self.near(pairs[1, i:j][pair], place + pairs[2, i:j][pair], slop)
            place, pair = place[kept], pair[kept] + i
            each = windows_at[pair + 1] - windows_at[pair]
            for a in range(0, len(place), CHUNK // 16):  # at most as many windows a pair as a window has words, times repeats in items
                z = a + CHUNK // 16
                index, of = runs(windows_at[pair[a:z]], each[a:z])
                w = in_pair[index]
                begin = place[a:z][of] - order[w, 0]
                for k in range(2, order.shape[1]):
                    more = lengths[w] > k
                    kept = ~more
                    kept[more] = self.near(by[w[more], k], begin[more] + order[w[more], k], slop)
                    w, begin = w[kept], begin[kept]
                row = np.maximum(self.rows(begin), 0)
                kept = (begin >= 0) & (begin - self.starts[row] < self.n_words[row])  # with slop it could begin before its document
                found.append((ok[w[kept]], begin[kept]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def rows(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1

    def exact(self, block: Block, window: np.ndarray, begin: np.ndarray) -> np.ndarray:
        good = np.ones(len(window), bool)
        for k in range(block.windows.shape[1]):
            on = good & (block.lengths[window] > k)
            good[on] = self.near(np.searchsorted(self.terms, block.windows[window[on], k]), begin[on] + k, 0)
        return good


def indexed(docs: DataFrame, terms: dict[bytes, int] | None) -> DataFrame:
    """Shards of docs(doc_id, text): documents, terms, how often each occurs and where; only of `terms`, if given."""
    schema = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("places", pa.binary())])

    def shard(ids: list, raws: list[bytes], names) -> pa.RecordBatch:
        keys, n_words = [], []
        for raw in raws:
            words = words_of(raw)
            n_words.append(len(words))
            keys.append(np.fromiter(names(words), np.int64, len(words)))
        flat = np.concatenate(keys)
        at = np.flatnonzero(flat)
        at = at[np.argsort(flat[at], kind="stable")]
        own, counts = np.unique(flat[at], return_counts=True)
        places = np.diff(at, prepend=0).astype(np.int32)
        row = [uuid.uuid4().int >> 65], [ids], [n_words], [own.tolist()], [counts.tolist()], [places.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema, strict=True)], schema=schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if terms is None:
            memo = Memo(term)
            names = lambda words: map(memo.__getitem__, words)
        else:
            names = lambda words: map(terms.get, words, repeat(0))
        ids, raws, held = [], [], 0
        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw"), strict=True):
                ids.append(doc)
                raws.append(raw.as_py())
                held += len(raws[-1])
                if held >= SHARD_BYTES:
                    yield then_released(shard, ids, raws, names)
                    ids, raws, held = [], [], 0
        if ids:
            yield then_released(shard, ids, raws, names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    return stored(texts.mapInArrow(build, INDEX), "postings")


class Search:
    """An index over docs, and blocks of items to look for."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int):
        self.window, self.n_blocks = window, max(1, -(-in_bytes(items) // BLOCK_BYTES))
        self.items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
        terms: dict[bytes, int] | None = {}
        for b in range(self.n_blocks):
            for raw in self.rows(b)[1]:
                terms.update((w, term(w)) for w in words_of(raw))
            if len(terms) > TERMS:
                terms = None
                break
        if terms is not None and len(set(terms.values())) < len(terms):
            raise ValueError("two terms of the items share a name")
        self.index = indexed(docs, terms)
        each = F.explode(F.arrays_zip("terms", "counts")).alias("t")
        self.counts = stored(self.index.select(each).groupBy("t.terms").agg(F.sum("t.counts").alias("n")), "term-counts")

    def rows(self, b: int) -> tuple[list, list[bytes]]:
        """The items of a block: of bounded bytes, unless one item is longer or has many copies."""
        part = self.items.where(F.pmod(F.xxhash64("raw"), F.lit(self.n_blocks)) == b).toArrow()
        return part.column("item_id").to_pylist(), part.column("raw").to_pylist()

    def blocks(self) -> Iterator[Block]:
        for b in range(self.n_blocks):
            block = Block(*self.rows(b), self.window)
            own = self.items.sparkSession.createDataFrame(pa.table({"terms": block.terms}))
            yield block.ranked({r["terms"]: r["n"] for r in self.counts.join(F.broadcast(own), "terms", "left_semi").toLocalIterator()})

    def each(self, found, schema: str, slop: int) -> DataFrame:
        """found(row of the index, its Shard, block) as Arrow batches, over all shards and blocks."""
        gap = self.window + 2 * slop + 1

        def over(block: Block) -> DataFrame:
            def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for k in range(batch.num_rows):
                        row = batch.slice(k, 1).to_pylist()[0]
                        yield found(row, Shard(row["n_words"], row["terms"], row["counts"], row["places"], gap), block)

            return self.index.mapInArrow(read, schema)

        out = None
        for block in self.blocks():
            out = over(block) if out is None else out.unionByName(over(block))
        return out


def united(edge: np.ndarray) -> np.ndarray:
    """Where edge's running sum is over 0."""
    return np.cumsum(edge)[:-1] > 0


def contaminated(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 0) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids) of every row of docs(doc_id, text): words inside occurrences of windows of
    items(item_id, text), and the items that these are of, in order of their ids as text.

    A window is `window` consecutive words of an item, or all of a shorter one.  With slop, an occurrence's words are taken
    to be those from where it begins to where it would end.
    """
    kinds = pa.schema([("shard", pa.int64()), ("row", pa.int32()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())])))])

    def found(row: dict, shard: Shard, block: Block) -> pa.RecordBatch:
        w, begin = shard.occurrences(block, slop)
        at = shard.rows(begin)
        edge = np.zeros(shard.span + 1, np.int64)
        ends = np.minimum(begin + block.lengths[w], shard.starts[at] + shard.n_words[at])
        np.add.at(edge, begin, 1)
        np.add.at(edge, ends, -1)
        on = united(edge).astype(np.int8)
        a, z = (np.flatnonzero(np.diff(on, prepend=0) == s) for s in (1, -1))
        span_rows = shard.rows(a)
        pairs = np.unique(at * len(block.windows) + w) if len(w) else np.zeros(0, np.int64)
        index, of = runs(block.at[pairs % max(1, len(block.windows))], np.diff(block.at)[pairs % max(1, len(block.windows))]) if len(pairs) else (pairs, pairs)
        item_rows, item = (pairs // max(1, len(block.windows)))[of], block.items[index]
        out, hit = [], np.unique(at)
        cut = lambda x, side: np.searchsorted(x, hit, side).tolist()
        for r, i, j, k, n in zip(hit.tolist(), cut(span_rows, "left"), cut(span_rows, "right"), cut(item_rows, "left"), cut(item_rows, "right"), strict=True):
            own = {block.ids[x] for x in np.unique(item[k:n]).tolist()} - {None}
            spans = zip((a[i:j] - shard.starts[r]).tolist(), (z[i:j] - shard.starts[r]).tolist(), strict=True)
            out.append((row["shard"], r, sorted(own), [{"a": x, "z": y} for x, y in spans]))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], schema=kinds)

    search = Search(docs, items, window)
    hits = search.each(found, "shard long, row int, items array<long>, spans array<struct<a: int, z: int>>", slop)
    hits = hits.groupBy("shard", "row").agg(F.flatten(F.collect_list("items")).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    step = lambda s, x: F.struct((s.n + F.greatest(F.lit(0), x.z - F.greatest(x.a, s.upto))).alias("n"), F.greatest(s.upto, x.z).alias("upto"))
    every = search.index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("row", "d"))
    return every.join(hits, ["shard", "row"], "left").select(
        F.col("d.doc_ids").alias("doc_id"),
        F.col("d.n_words").alias("n_words"),
        F.coalesce(F.aggregate("spans", start, step, lambda s: s.n), F.lit(0).cast("long")).alias("n_hit"),
        F.array_sort(F.transform(F.array_distinct(F.coalesce("items", F.array().cast("array<long>"))), lambda i: i.cast("string"))).alias("item_ids"),
    )


def matches(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 0) -> DataFrame:
    """Phrases that docs share with items: (doc_id, item_id, item_start, start, length, exact), places in words from 0.

    Windows of one item that follow each other in both texts are one match, as long as all of them are exact, or all
    aren't.  Of a window that an item has several times, its first place in the item stands for all.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_start", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("exact", pa.bool_())])

    def found(row: dict, shard: Shard, block: Block) -> pa.RecordBatch:
        w, begin = shard.occurrences(block, slop)
        once = np.unique(np.stack([w, begin]), axis=1)
        w, begin = once[0], once[1]
        exact = shard.exact(block, w, begin) if slop else np.ones(len(w), bool)
        index, of = runs(block.at[w], np.diff(block.at)[w])
        item, place, start, length, good = block.items[index], block.places[index], begin[of], block.lengths[w][of], exact[of]
        order = np.lexsort((place, good, start - place, item))
        item, place, start, length, good = (x[order] for x in (item, place, start, length, good))
        same = (item[1:] == item[:-1]) & (start[1:] - place[1:] == start[:-1] - place[:-1]) & (good[1:] == good[:-1]) & (place[1:] == place[:-1] + 1) if len(item) else np.zeros(0, bool)
        a = np.flatnonzero(np.r_[True, ~same][: len(item)])
        z = np.r_[a[1:], len(item)] - 1
        at = shard.rows(start[a])
        ids = [row["doc_ids"][r] for r in at.tolist()]
        columns = ids, [block.ids[i] for i in item[a].tolist()], place[a], start[a] - shard.starts[at], place[z] - place[a] + length[a], good[a]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return Search(docs, items, window).each(found, MATCHES, slop)
