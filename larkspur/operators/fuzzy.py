"""Pairs of strings that may be similar by Ratcliff-Obershelp, in blocks that miss none.

The similarity is 2 M / (length a + length b), M the characters in matching blocks.  These follow each other in both
strings, so M is at most the length of a longest common subsequence, and that at most how many characters both share,
repeats counted.  Strings are dealt into blocks of bounded size by first character and hash; each block of one side meets
each of the other that begins alike, in a group of its own.  There the characters shared are one product of matrices, and
the common subsequence of what that leaves is taken bit by bit for all pairs at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings of one first character in a block, and columns of its matrix at most.
BLOCK, WIDTH = 1000, 4096


def counted(texts: list[str], place: dict) -> np.ndarray:
    """A row a text: 1 at the place of each character with how often it came before; places that fall together only raise the bound."""
    rows, columns = [], []
    for i, text in enumerate(texts):
        seen: dict = {}
        for x in text:
            seen[x] = seen.get(x, 0) + 1
            k = place.get((x, seen[x]))
            if k is not None:
                rows.append(i)
                columns.append(k)
    out = np.zeros((len(texts), min(len(place), WIDTH)), np.float32)
    np.add.at(out, (rows, np.array(columns, np.int64) % WIDTH), 1)
    return out


def codes(texts: list[str]) -> np.ndarray:
    """Code points, a row a text, higher by 1 than they are, so that zeros can fill them up."""
    out = np.zeros((len(texts), max(map(len, texts))), np.uint32)
    for i, text in enumerate(texts):
        out[i, : len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    return out


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of a longest common subsequence of rows of a (at most 64 characters) and of b, by addition of bits (Hyyrö)."""
    bits = np.uint64(1) << np.arange(a.shape[1], dtype=np.uint64)
    v = np.full(len(a), ~np.uint64(0))
    for k in range(b.shape[1]):
        met = (((a == b[:, k, None]) & (a > 0)) * bits).sum(axis=1, dtype=np.uint64)
        u = v & met
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def near(left: list[str], t: np.ndarray, right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that the bounds leave."""
    place: dict = {}
    for text in left:
        seen: dict = {}
        for x in text:
            seen[x] = seen.get(x, 0) + 1
            place.setdefault((x, seen[x]), len(place))
    together = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    i, j = np.nonzero(2 * (counted(left, place) @ counted(right, place).T) >= t[:, None] * together - 1e-6)
    a, b, least = codes(left)[:, :64], codes(right), t[i] * together[i, j] - 1e-6
    kept = np.array([len(x) > 64 for x in left])[i]  # these aren't tested by bits
    for k in range(0, len(i), 20_000):
        part = slice(k, k + 20_000)
        kept[part] |= 2 * common(a[i[part]], b[j[part]]) >= least[part]
    return i[kept], j[kept]


def in_blocks(strings: DataFrame, text: str, own: str, others: str, counts: DataFrame, partitions: int) -> DataFrame:
    """strings once for each block of the other side that begins with their character, with the names of both blocks."""
    rows = strings.withColumn("c_", F.substring(text, 1, 1)).join(F.broadcast(counts), "c_")  # a row a first character
    rows = rows.withColumn(own, F.pmod(F.xxhash64(text), F.col(f"n_{own}")))
    return rows.withColumn(others, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{others}") - 1))).drop("n_l_", "n_r_").repartition(partitions, "c_", "l_", "r_")


def candidates(left: DataFrame, right: DataFrame, a: str, b: str, t: str, least: float = 0.0) -> DataFrame:
    """Distinct (a, b, t) of left(a, t) and right(b) whose similarity may be at least t, and `least`.  Only strings that begin with one character meet."""
    left, right = left.select(a, t).where(F.length(a) >= 1).distinct(), right.select(b).where(F.length(b) >= 1).distinct()
    blocks = lambda df, text, n: df.groupBy(F.substring(text, 1, 1).alias("c_")).agg(F.ceil(F.count("*") / BLOCK).alias(n))
    counts = blocks(left, a, "n_l_").join(blocks(right, b, "n_r_"), "c_")
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as small rows are long work
    names = ["c_", "l_", "r_"]
    schema = pa.schema([(a, pa.string()), (b, pa.string()), (t, pa.float64())])

    def met(x: pa.Table, y: pa.Table) -> pa.Table:
        if not (x.num_rows and y.num_rows):
            return schema.empty_table()
        one, other, bound = x[a].to_pylist(), y[b].to_pylist(), x[t].to_numpy()
        i, j = near(one, np.maximum(bound, least), other)
        return pa.table([pa.array([one[k] for k in i], pa.string()), pa.array([other[k] for k in j], pa.string()), pa.array(bound[i])], schema)

    own = in_blocks(left, a, "l_", "r_", counts, partitions).groupBy(*names)
    other = in_blocks(right, b, "r_", "l_", counts, partitions).groupBy(*names)
    return own.cogroup(other).applyInArrow(met, f"`{a}` string, `{b}` string, `{t}` double")
