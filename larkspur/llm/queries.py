"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, contamination, language, ngram_lm, packing, quality, search, sessions, simhash, spelling, sql, substring, suffixes, toxicity
from .common import table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_lm.scores(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learnt(docs, table(spark, sf_dir, "labels")))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.cleaned(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 3).alias("distance"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary())


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), vocabulary())


def op7_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predicted(docs, language.learnt(docs))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), misspelt=199).where("n >= 5"))


def turn_events(conversations: DataFrame) -> DataFrame:
    """(user, s, batch, h) of conversations(conv_id, turn), as the query's contract derives them."""
    c = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    h = F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary"))
    rows = conversations.where("turn is not null and conv_id is not null").select("conv_id", "turn", c.alias("c"), h.alias("h"))
    rows = rows.withColumn("g", F.expr("h div 600")).withColumn("user", 2 * sessions.floored(F.col("conv_id"), 8) + F.col("c") % 2)
    rows = rows.withColumn("s", F.expr("(c div 2) % 7200 + 300 * turn + h % 600"))
    return rows.select("user", "s", (sessions.floored(F.col("s"), 1800) + F.when(F.col("g") % 3 == 0, F.col("g") % 4).otherwise(0)).alias("batch"), "h")


def op13_session_merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.versions(turn_events(table(spark, sf_dir, "conversations")))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_lm_scoring": sql.OP1, "op3_suffix_array_dedup": sql.OP3, "op7_top_k_search": sql.OP7, "op8_substring_dedup": sql.OP8, "op11_decontamination": sql.OP11, "op12_spelling_variants": sql.OP12, "op13_session_merging": sql.OP13}
