"""A corpus pipeline: documents in, packed sequences out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  All but the last return the columns of documents.

Toxicity and quality judge each row by itself.  Documents whose doc_id is null are never dropped for what another document
holds; rows with one doc_id are dropped together as near-duplicates.
Null and empty texts fail the base rules of quality.  Empty tables stay empty.  Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import packing, quality, simhash, substring, toxicity
from larkspur.llm.common import stored, table, without
from larkspur.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A stage isn't expressible in SQL (a learnt classifier); run() is tested against the operators' brute-force versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are predicted to be toxic, row by row; learns from the labels of the documents it gets."""
    model = toxicity.learnt(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select(COLUMNS), model, carry=tuple(COLUMNS[1:])).where("predicted = 0").select(COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail the base rules or lie outside their language and source, row by row."""
    return quality.judged(docs.select(COLUMNS), "text", "n_chars").where("kept").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by a Jaccard similarity of 0.8 or more, on shingles of five words."""
    found = simhash.similar_documents(docs)
    return without(docs.select(COLUMNS), stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies"), "doc_id").select(COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without words of passages that an earlier document has; texts that lose some are their kept words, joined by one space."""
    carry = ("lang", "source", "n_chars", F.col("text").isNull().alias("no_text"))
    out = substring.deduplicated(docs, with_text=True, carry=carry).withColumn("text", F.when(~F.col("no_text"), F.col("kept")))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its sequence and place."""
    return packing.packed(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
