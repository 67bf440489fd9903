"""Readers of the input tables, and the writers for stores."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the checkpoint folder from then on, which survives lost executors and shortens plans.

    The folder is that of spark.checkpoint.dir; where it is unset, a temporary one for a local master, else an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="larkspur-"))
    return df.checkpoint()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many parts as a shuffle has: short rows fill few splits of a file, however long the work on each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def point(df: DataFrame, **keys) -> DataFrame:
    """The row with these key values; many keys at once are a join."""
    for column, value in keys.items():
        df = df.where(F.col(column) == F.lit(value))
    return df.limit(1)


def optional(df: DataFrame, **filters) -> DataFrame:
    """Rows with these values; a filter that is None isn't applied."""
    for column, value in filters.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def snapshot(catalog: DataFrame, n: int, updated: str, created: str, tie: str) -> DataFrame:
    """The n catalog rows that changed last."""
    return catalog.orderBy(F.desc_nulls_last(updated), F.desc_nulls_last(created), tie).limit(n)


def jdbc_snapshot(spark: SparkSession, url: str, table: str, n: int, **options) -> DataFrame:
    """The same from an external database; needs its JDBC driver on the class path."""
    return snapshot(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), n, "updated_at", "created_at", "id")


def contains_search(catalog: DataFrame, column: str, phrase: str, **filters) -> DataFrame:
    """Rows whose column has the phrase, in any case; the phrase is taken literally."""
    return optional(catalog.where(F.contains(F.lower(F.col(column)), F.lower(F.lit(phrase)))), **filters)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str, label: str, now) -> DataFrame:
    """Full replacement of a snapshot; returns its one row of metadata."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).agg(F.lit(label).alias("label"), F.lit(now).alias("last_refresh_at"), F.count("*").alias("item_count"))
