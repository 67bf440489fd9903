"""Near-duplicates by 64-bit SimHash fingerprints, found through covering-code anchors.

Distinct fingerprints are compared, each standing for all rows that have it.  A fingerprint is three blocks of 23, 23
and 18 bits.  Of two fingerprints at most 4 bits apart, some block differs in at most 1 bit.  The anchors of a block are
the words of the binary Golay code of length 23 (the short block is filled with zeros): every block value is within
covering radius 3 of one, so if two values are 1 bit apart, an anchor within 3 of the first is within 3 + 1 of the
second.  Each fingerprint goes to every anchor within 4 of each of its blocks (about 16 in all), and fingerprints of
one anchor are compared with each other.  Of an anchor's linked sets only a spanning star is kept, not all pairs.

From `PAIRED` distinct fingerprints on, pairs of codewords of two blocks are anchors (`paired_anchors`), as with 3 * 4096
anchors work would grow with the square.  An anchor with more than `chunk` fingerprints is split into chunks and compared
by pairs of chunks, so no task takes more than 2 * chunk of an anchor.  Rows without words have fingerprint 0, which links like any other.  Rows without a
doc_id link to nothing; they get the component of their own fingerprint, null if no row with an id has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, stored
from .components import components

BLOCKS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the binary Golay code.
GOLAY = 0b101011100011
#: Distinct fingerprints from which anchors are pairs of codewords.
PAIRED = 1 << 22


def hashes(text: bytes, width: int) -> np.ndarray:
    """Hashes of the shingles of a text; of all its words together where they are fewer than width."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words), 42)] if words else [], dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-width].tolist()]
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], dtype="<u8")


def fingerprint(text: bytes, width: int) -> int:
    h = hashes(text, width)
    if not len(h):
        return 0
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        count += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x, width) for x in b.column("raw").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw")).mapInArrow(run, "doc_id long, fp long")


@cache
def golay_errors(radius: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: where its error patterns of weight <= radius start, how many there are, and all patterns."""
    one = np.arange(23)
    patterns = [np.zeros(1, np.int64)]
    level = np.array([[0, -1]])  # pattern, highest bit
    for _ in range(radius):
        level = np.array([(p | 1 << b, b) for p, top in level.tolist() for b in one[one > top].tolist()])
        patterns.append(level[:, 0])
    all_ = np.concatenate(patterns)
    s = syndrome(all_)
    order = np.argsort(s, kind="stable")
    count = np.bincount(s, minlength=2048)
    return np.cumsum(count) - count, count, all_[order]


@cache
def syndrome_of_bit() -> np.ndarray:
    """x**i modulo the generator, for each bit i."""
    out, r = [], 1
    for _ in range(23):
        out.append(r)
        r <<= 1
        if r >> 11 & 1:
            r ^= GOLAY
    return np.array(out, dtype=np.int64)


def syndrome(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x), np.int64)
    for i, r in enumerate(syndrome_of_bit().tolist()):
        s ^= np.where(x >> i & 1, r, 0)
    return s


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for all anchors of the fingerprints; an anchor is block << 23 | codeword."""
    start, count, patterns = golay_errors()
    rows, keys = [], []
    for b, (at, width) in enumerate(BLOCKS):
        x = (fp >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)
        s = syndrome(x)
        n = count[s]
        row = np.repeat(np.arange(len(fp)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[s], n)
        rows.append(row)
        keys.append(b << 23 | x[row] ^ patterns[place])
    return np.concatenate(rows), np.concatenate(keys)


def paired_anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) in the product of the codes of two blocks, for each pair of blocks; an anchor is pair << 46 | codeword << 23 | codeword.

    Of two fingerprints at most 4 bits apart some pair of blocks differs in at most 2 bits (the three pairs have each bit
    twice, 8 together).  With a and b bits in its blocks, the nearest codewords of the one fingerprint, both within 3, are
    within 3 + a and 3 + b of the other; so it goes to all pairs of codewords with max(0, r - 3) + max(0, s - 3) <= 2.
    """
    start, count, patterns = golay_errors(5)
    blocks = []
    for at, width in BLOCKS:
        x = (fp >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)
        s = syndrome(x)
        n = count[s]
        row = np.repeat(np.arange(len(fp)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[s], n)
        more = np.maximum(np.bitwise_count(patterns[place]).astype(np.int64) - 3, 0)
        blocks.append((n, np.cumsum(n) - n, x[row] ^ patterns[place], more))
    rows, keys = [], []
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (n_i, _, words_i, more_i), (n_j, first_j, words_j, more_j) = blocks[i], blocks[j]
        row = np.repeat(np.arange(len(fp)), n_i)
        n = n_j[row]
        left = np.repeat(np.arange(len(row)), n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_j[row], n)
        near = more_i[left] + more_j[right] <= 2
        left, right = left[near], right[near]
        rows.append(row[left])
        keys.append(k << 46 | words_i[left] << 23 | words_j[right])
    return np.concatenate(rows), np.concatenate(keys)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each of a and each of b; a fingerprint is a number or a row of numbers."""
    bits = np.bitwise_count(a[:, None] ^ b[None, :])
    return bits if bits.ndim == 2 else bits.sum(axis=2, dtype=np.int16)


def stars(fp: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint the first of its linked set (transitively, among these)."""
    n = len(fp)
    root = np.arange(n)
    left = np.arange(n)
    while len(left):  # grow the set of the first that is left
        found, rest = [left[:1]], left[1:]
        edge = left[:1]
        while len(edge) and len(rest):
            near = np.zeros(len(rest), bool)
            for at in range(0, len(edge), 64):
                near |= (apart(fp[edge[at : at + 64]], fp[rest]) <= distance).any(axis=0)
            edge, rest = rest[near], rest[~near]
            found.append(edge)
        all_ = np.concatenate(found)
        root[all_] = left[0]
        left = rest
    return root


def linked(fp: np.ndarray, distance: int) -> np.ndarray:
    """(i, j) with j the first of i's linked set; as stars(), but fast where links are few."""
    if len(fp) > 4096:
        root = stars(fp, distance)
        return np.stack([np.flatnonzero(root != np.arange(len(fp))), root[root != np.arange(len(fp))]], axis=1)
    near = np.zeros(len(fp), bool)
    for at in range(0, len(fp), 256):
        close = apart(fp[at : at + 256], fp) <= distance
        near[at : at + 256] = close.sum(axis=1) > 1
    few = np.flatnonzero(near)
    root = few[stars(fp[few], distance)] if len(few) else few
    return np.stack([few[root != few], root[root != few]], axis=1)


def links(reps: DataFrame, distance: int, chunk: int, paired: int = PAIRED) -> DataFrame:
    """(u, v): a spanning star of each anchor's linked sets of reps(fp, rep); u and v are values of rep.

    From `paired` fingerprints on, anchors are pairs of codewords: about 200 a fingerprint in place of 16, but 4096 times
    as many in all, so fewer meet.  Links are the same either way.
    """
    if distance > 4:
        raise ValueError("anchors cover distances up to 4")
    deal = paired_anchors if reps.count() >= paired else anchors

    def dealt(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        return *deal(b.column("fp").to_numpy().view(np.uint64)), b.column("fp")

    return compared(reps, dealt, "long", distance, chunk)


def compared(reps: DataFrame, keys_of, kind: str, distance: int, chunk: int) -> DataFrame:
    """links() under keys_of(batch): (row, anchor) and the fingerprints to compare, longs or strings of 64-bit numbers."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4_000):
                part = b.slice(at, 4_000)
                row, key, fp = keys_of(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), fp.take(pa.array(row)), part.column("rep").take(pa.array(row))], ["key", "fp", "rep"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "a", "b", "rep"], ignore_index=True)
        fp, rep = pdf["fp"].to_numpy(), pdf["rep"].to_numpy()
        fp = fp.view(np.uint64) if kind == "long" else np.frombuffer(b"".join(fp), "<u8").reshape(len(fp), -1)
        cell = pdf[["key", "a", "b"]].to_numpy()
        edges = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1), True])
        out = [np.zeros((0, 2), np.int64)]
        for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if stop - start > 1:
                out.append(rep[start + linked(fp[start:stop], distance)])
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["u", "v"])

    dealt = reps.mapInArrow(deal, f"key long, fp {kind}, rep long")
    sizes = dealt.groupBy("key").count().where(F.col("count") > chunk).select(F.col("key").alias("hot"), F.ceil(F.col("count") / chunk).cast("int").alias("m"))
    cells = dealt.join(sizes, F.col("key") == F.col("hot"), "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    cells = cells.withColumn("o", other).select("key", "fp", "rep", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"))
    n_parts = max(cells.sparkSession.sparkContext.defaultParallelism, -(-reps.count() // 6_000))
    cells = cells.withColumn("part", F.pmod(F.xxhash64("key", "a", "b"), F.lit(n_parts)))
    return cells.groupBy("part").applyInPandas(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, chunk: int = 8192, paired: int = PAIRED) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs(doc_id, text); component_id is the smallest doc_id reachable."""
    own = stored(fingerprints(docs, width), "fingerprints")
    reps = stored(own.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-reps")
    parts = components(links(reps, distance, chunk, paired))
    reps = reps.join(parts, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(reps, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Longs of a wide fingerprint, those of them that are compared, and how often its bits are dealt into blocks.
WIDE, SEEN, ORDERS = 12, 2, 2
#: Bits of SEEN apart up to which texts are candidates: four standard deviations more than texts of Jaccard 0.8 are on average.
NEAR = 36


def wide_fingerprint(h: np.ndarray) -> bytes:
    """64 * WIDE bits of SimHash over distinct shingle hashes."""
    one = np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    count = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(h), 255):
        bits = np.unpackbits(mixed(h[at : at + 255, None] ^ one).view(np.uint8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(h), bitorder="little").tobytes()


@cache
def orders() -> np.ndarray:
    """Which bits are in each block of 23."""
    rng = np.random.default_rng(23)
    n = 64 * WIDE // 23
    return np.concatenate([rng.permutation(64 * WIDE)[: n * 23].reshape(n, 23) for _ in range(ORDERS)])


def wide_anchors(fps: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): of each block the one codeword within 3 of it."""
    bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    start, _, patterns = golay_errors(3)
    keys = []
    for k, block in enumerate(orders()):
        x = bits[:, block].astype(np.int64) @ (1 << np.arange(23))
        keys.append(k << 23 | x ^ patterns[start[syndrome(x)]])
    return np.tile(np.arange(len(fps)), len(keys)), np.concatenate(keys)


def jaccard_roots(sets: list[np.ndarray], least: tuple[int, int]) -> np.ndarray:
    """For each set the first of those it is linked with, transitively, by a Jaccard similarity of at least least[0] / least[1]."""
    size = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, token = np.unique(flat, return_inverse=True)
    order = np.argsort(token, kind="stable")
    holders, ends = owner[order], np.cumsum(np.bincount(token))
    at = np.cumsum(size) - size

    def similar(i: int) -> np.ndarray:
        own = token[at[i] : at[i] + size[i]]
        stop = ends[own]
        n = stop - np.where(own > 0, ends[own - 1], 0)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(stop - n, n)
        both = np.bincount(holders[place], minlength=len(sets))
        return least[1] * both >= least[0] * (size + size[i] - both)

    root = np.full(len(sets), -1)
    for first in range(len(sets)):
        if root[first] >= 0:
            continue
        root[first], edge = first, np.array([first])
        rest = np.flatnonzero(root < 0)
        while len(edge) and len(rest):
            inside = np.zeros(len(sets), bool)
            if len(edge) <= len(rest):
                for i in edge.tolist():
                    inside |= similar(i)
                new = rest[inside[rest]]
            else:
                new = np.array([i for i in rest.tolist() if similar(i)[edge].any()], np.int64)
            root[new] = first
            edge, rest = new, np.flatnonzero(root < 0)
    return root


def similar_documents(docs: DataFrame, width: int = 5, least: tuple[int, int] = (4, 5), chunk: int = 8192, cell: int = 1 << 20) -> DataFrame:
    """(doc_id, component_id) of every row of docs(doc_id, text) by exact Jaccard similarity of sets of shingles.

    Texts are linked, transitively, if the similarity of their sets is at least least[0] / least[1]; equal sets are one.
    Candidates come from anchors: SimHash here has 768 bits, dealt into 66 blocks of 23, each of which goes to the one
    codeword within 3 of it.  Two texts of similarity 0.8 share the anchor of a block with probability 0.12, so they
    miss each other in all blocks about once in 5,000 times.  What may be linked by candidates is then compared exactly,
    set by set; candidates with more than `cell` shingles together are dealt into chunks and compared by pairs of chunks,
    so no task takes more than two chunks of them.  Rows without a doc_id link to nothing; they get the component of
    their own set, or null.
    """

    def named(raw: bytes) -> tuple[int, np.ndarray]:
        found = np.unique(hashes(raw, width))
        return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64)), found

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(name, wide_fingerprint(found), len(found)) for name, found in map(named, b.column("raw").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.int64())))], ["doc_id", "rep", "fp", "n"])

    def keys_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        fps = b.column("fp").to_pylist()
        return *wide_anchors(fps), pa.array([f[: 8 * SEEN] for f in fps], pa.binary())

    def confirm(texts: pa.Table) -> pa.Table:
        cells: dict[tuple, list[int]] = {}
        for i, of in enumerate(zip(*(texts.column(c).to_pylist() for c in ("component", "a", "b")), strict=True)):
            cells.setdefault(of, []).append(i)
        found = []
        for rows in cells.values():
            sets: dict[int, np.ndarray] = {}
            for i in rows:
                name = texts.column("rep")[i].as_py()
                if name not in sets and (x := named(texts.column("raw")[i].as_py()))[0] == name:  # a row with the same doc_id may have another text
                    sets[name] = x[1]
            names = sorted(sets)
            root = jaccard_roots([sets[n] for n in names], least) if len(names) > 1 else []
            found += [(n, names[r]) for n, r in zip(names, root) if n != names[r]]
        return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    own = stored(raw.mapInArrow(read, "doc_id long, rep long, fp binary, n long"), "wide-fingerprints")
    reps = stored(own.where("doc_id is not null").groupBy("rep").agg(F.min("doc_id").alias("id"), F.min("fp").alias("fp"), F.min("n").alias("n")), "wide-reps")
    # a text has up to one root an anchor: all but the smallest are linked with that instead, so a large group is about one edge a text
    stars_ = compared(reps.select("rep", "fp"), keys_of, "binary", NEAR, chunk).groupBy("u").agg(F.collect_set("v").alias("vs")).withColumn("m", F.array_min("vs"))
    parts = components(stored(stars_, "stars").select(F.explode(F.array_append("vs", F.col("u"))).alias("u"), F.col("m").alias("v")))
    members = stored(reps.join(parts, F.col("rep") == F.col("node")).select("rep", "component", "id", "n"), "candidates")
    large = members.groupBy("component").agg(F.ceil(F.sum("n") / cell).cast("int").alias("m")).where("m > 1").select(F.col("component").alias("of"), "m")
    dealt = members.join(large, F.col("component") == F.col("of"), "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("m")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("rep", "id", "component", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"))
    total = int(members.agg(F.sum("n")).first()[0] or 0)
    n_parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // (2 * cell)))
    cells = dealt.withColumn("part", F.pmod(F.xxhash64("component", "a", "b"), F.lit(n_parts)).cast("int"))
    texts = cells.join(raw, F.col("id") == F.col("doc_id")).select("part", "rep", "component", "a", "b", "raw")
    confirmed = components(texts.groupBy("part").applyInArrow(confirm, "u long, v long"))
    least_id = confirmed.join(reps.select(F.col("rep").alias("node"), "id"), "node").groupBy("component").agg(F.min("id").alias("component_id"))
    confirmed = confirmed.join(least_id, "component").select(F.col("node").alias("rep"), "component_id")
    found = reps.select("rep", "id").join(confirmed, "rep", "left").select("rep", F.coalesce("component_id", "id").alias("component_id"))
    return own.join(found, "rep", "left").select("doc_id", "component_id")
