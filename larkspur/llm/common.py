"""What the operators of this package share: words, table access, the shared folder, groups of documents.

`ask` and `tell` carry one pattern used by several operators.  Documents are dealt into groups of bounded size by a
hash of their id.  Each group sends sorted, distinct 64-bit keys to buckets by key (so a key is sent once per group,
however often it occurs); a bucket answers every group in the order it was asked; the group then goes on with its
answers.  A very frequent key is one entry per group, which keeps buckets even.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that make one group of documents, and for which there is one bucket of keys.
GROUP_BYTES = 12 << 20
BUCKET_BYTES = 12 << 20
#: Rows up to which a table of short rows (a key and some numbers) is broadcast.
SMALL_ROWS = 200_000
#: Whether the shuffle files of a query are removed when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset: a temporary folder for a local master, else an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="larkspur-")
        spark.sparkContext.setCheckpointDir(_own_dir[app])
    return _own_dir[app]


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting within a with statement; afterwards it is what it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: cuts lineage and survives lost executors.

    The shuffles of the write are removed at its end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    with setting(spark, SHUFFLES_GO, "true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Removes what stored() wrote for this application; DataFrames that read it can't be used any more."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        there = hadoop(path)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
    return len(paths)


def in_bytes(df: DataFrame) -> int:
    """Bytes of all texts of df, which sizes of groups follow, however well files are compressed."""
    return int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def groups_for(df: DataFrame, n_bytes: int, size: int = GROUP_BYTES) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // size))


def looked_up(rows: DataFrame, few: DataFrame, key: str | list[str], n_few: int | None = None, how: str = "inner", salts: int = 32) -> DataFrame:
    """rows joined with few by key, n_few rows (counted if not given): by broadcast if these are few, else salted, so that a key of most rows is dealt.

    The salted rows of few are sorted, as Spark takes them for no more bytes than few's files have and would broadcast them.
    """
    if (few.count() if n_few is None else n_few) <= SMALL_ROWS:
        return rows.join(F.broadcast(few), key, how)
    spread = few.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keys = [key] if isinstance(key, str) else key
    salt = F.pmod(F.xxhash64(*(c for c in rows.columns if c not in keys)), F.lit(salts)).cast("int")
    return rows.withColumn("salt_", salt).join(spread.hint("merge"), [*keys, "salt_"], how).drop("salt_")


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't in ids(key): by broadcast if ids are counted as few, else by a shuffle."""
    few = ids.count() <= 5 * SMALL_ROWS
    return rows.join(F.broadcast(ids) if few else ids, key, "left_anti")


def grouped(docs: DataFrame, n_groups: int, *extra) -> DataFrame:
    """(g, doc_id, raw, ...): whole texts as UTF-8 bytes (null: empty), dealt into n_groups by a hash of doc_id and text.

    Two rows with one doc_id are two documents; rows without doc_id, or with one that many have, are dealt by their texts,
    so only rows that are alike in both meet in one group.  A text isn't split: a group holds at least its longest text
    whole, and the task that reads it about fifteen times its bytes.
    """
    return docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)).cast("int").alias("g"),
        "doc_id",
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"),
        *extra,
    )


def ask(key: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket of each key; by its high bits, so sorted keys are also sorted by bucket."""
    return ((key >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def spans_of(bucket: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket starts in a sorted array of buckets; n_buckets + 1 places."""
    return np.searchsorted(bucket, np.arange(n_buckets + 1))


def slices(n: int, most: int) -> list[slice]:
    return [slice(at, min(n, at + most)) for at in range(0, n, most)]


def then_released(f, *args):
    """f(*args).  What it no longer needs goes back to the system: a worker lives on between groups, tasks and stages."""
    out = f(*args)
    release()
    return out


def released_after(run):
    """The function run for mapInArrow; after the last batch, when its locals are gone, memory goes back to the system."""

    def until_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return until_end


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


class Memo(dict):
    """Results by key (a string), emptied when it holds `most` keys or `most_bytes` of them; make(key) fills a gap."""

    def __init__(self, make, most: int = 400_000, most_bytes: int = 16 << 20):
        super().__init__()
        self.make, self.most, self.most_bytes, self.held = make, most, most_bytes, 0

    def __missing__(self, key):
        self.held += len(key)
        if len(self) >= self.most or self.held > self.most_bytes:
            self.clear()
            self.held = len(key)
        value = self[key] = self.make(key)
        return value


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def word_memo(most: int = 400_000) -> Memo:
    return Memo(word_hash, most)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def column(table_: pa.Table | pa.RecordBatch, name: str) -> list:
    return table_.column(name).to_pylist()
