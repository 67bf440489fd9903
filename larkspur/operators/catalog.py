"""Catalog search: words in titles, then short exact keys, then similar titles."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import titles
from . import fuzzy

#: How similar titles are at least, and where both are to be one word.
LEAST, LEAST_OF_ONE_WORD = 0.78, 0.82


def fits(queries: DataFrame) -> Column:
    """Whether an item is of the category asked for, where queries have one (`wanted`, null: any)."""
    return F.col("wanted").isNull() | (F.col("category") == F.col("wanted")) if "wanted" in queries.columns else F.lit(True)


def shelved(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """catalog once for queries of any category (shelf: null) and, where queries have a category, once for those of its own."""
    shelf = F.lit(None).cast("string")
    return catalog.withColumn("shelf", F.explode(F.array_distinct(F.array(shelf, F.col("category")))) if "wanted" in queries.columns else shelf)


def distinct_queries(queries: DataFrame) -> DataFrame:
    """(q, wanted): what many queries ask for is searched once."""
    return queries.select("q", (F.col("wanted") if "wanted" in queries.columns else F.lit(None).cast("string")).alias("wanted")).distinct()


def for_each(queries: DataFrame, found: DataFrame) -> DataFrame:
    """found(q, wanted, item_id, ...) for each query that asks for it."""
    wanted = F.col("wanted") if "wanted" in queries.columns else F.lit(None).cast("string")
    found = found.withColumnsRenamed({"q": "q_", "wanted": "wanted_"})
    return queries.join(found, (queries["q"] == found["q_"]) & wanted.eqNullSafe(found["wanted_"])).drop("q_", "wanted_")


def matches(queries: DataFrame, catalog: DataFrame, ok: Column | None = None) -> DataFrame:
    """Rows of catalog(item_id, title, episode_title, title_key, updated) in whose title or episode a query's words are.

    queries(query_id, q): q is a lower-case title query.  Found by the query's rarest word, an equi-join on the words of the
    titles, then tested for the whole phrase; so no pair is made that shares no word.
    ok: which pairs count; those of fits() if not given.
    """
    parts = lambda c: F.array_distinct(F.filter(F.split(c, r"(?U)[^\w]+"), lambda w: w != ""))
    episode = F.lower(titles.title_query(F.coalesce("episode_title", F.lit(""))))
    rows = catalog.withColumn("episode_key", episode)
    rows = rows.withColumn("word", F.explode(F.array_distinct(F.concat(parts(F.col("title_key")), parts(F.col("episode_key"))))))
    # what is found has all words of a phrase, so it is looked up by that of them that fewest rows have
    often = rows.groupBy("word").agg(F.count("*").alias("n"))
    phrases = queries.where(F.length("q") >= 2).select("q").distinct().withColumn("word", F.explode(parts(F.col("q")))).join(often, "word", "left")
    rarest = phrases.groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("x")).select("q", "x.word")
    pattern = F.concat(F.lit("(?U)(?<!\\w)\\Q"), F.col("q"), F.lit("\\E(?!\\w)"))
    # a pattern of a column is compiled for each row, so only where the phrase is there at all
    whole = lambda c: F.when(F.contains(F.col(c), F.col("q")), F.regexp_like(c, pattern)).otherwise(False)
    found = queries.join(rarest, "q").join(rows, "word").where(whole("title_key") | whole("episode_key")).where(fits(queries) if ok is None else ok)
    return found.drop("word", "episode_key")


def ranked(found: DataFrame, limit: int) -> DataFrame:
    """Best `limit` matches of a query: equal titles, titles that start with it, then the newest."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.col("title_key") == F.col("q")), F.desc(F.startswith("title_key", F.col("q"))), F.desc_nulls_last("updated"), "item_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def best_matches(queries: DataFrame, catalog: DataFrame, limit: int) -> DataFrame:
    """(query_id, item_id, rank) of ranked(matches()), by distinct queries and the newest `limit` of equal items only."""
    newest = Window.partitionBy("title_key", "episode_title", "shelf").orderBy(F.desc_nulls_last("updated"), "item_id")
    items = shelved(queries, catalog.select("item_id", "title_key", "episode_title", "updated", *(["category"] if "wanted" in queries.columns else [])))
    items = items.withColumn("n_", F.row_number().over(newest)).where(F.col("n_") <= limit).drop("n_")
    asked = distinct_queries(queries)
    order = Window.partitionBy("q", "wanted").orderBy(F.desc(F.col("title_key") == F.col("q")), F.desc(F.startswith("title_key", F.col("q"))), F.desc_nulls_last("updated"), "item_id")
    found = matches(asked, items, F.col("wanted").eqNullSafe(F.col("shelf"))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return for_each(queries, found.select("q", "wanted", "item_id", "rank")).select("query_id", "item_id", "rank")


def compact_matches(queries: DataFrame, catalog: DataFrame, limit: int) -> DataFrame:
    """For queries of two to four letters and digits: titles that are the same without separators.

    Only the first `limit` items of a key meet queries, so what many items and queries share costs no pairs.
    """
    wanted = F.col("wanted") if "wanted" in queries.columns else F.lit(None).cast("string")
    asked = queries.withColumn("compact", titles.compact_key(F.col("q"))).where((F.length("compact") >= 2) & (F.length("compact") <= 4) & (F.length("q") < 5))
    rows = catalog.withColumn("compact", titles.compact_key(F.col("title_key"))).where((F.length("compact") >= 2) & (F.length("compact") <= 4))
    order = Window.partitionBy("compact", "shelf").orderBy("item_id")
    rows = shelved(queries, rows).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return asked.join(rows, (asked["compact"] == rows["compact"]) & wanted.eqNullSafe(F.col("shelf"))).drop(rows["compact"]).drop("shelf")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, for which there is no built-in function."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def similar(queries: DataFrame, catalog: DataFrame, limit: int, gap: float = 0.03) -> DataFrame:
    """(query_id, item_id, rank, score): titles like a query of five or more characters, by first character and similarity; none if the best two are closer than `gap`.

    Distinct queries and titles meet by fuzzy.candidates(), which misses none that reaches the threshold; similarity is taken
    of what its bounds leave.  Of items with one title only the first `limit` (two at least) are ranked.
    """
    single = F.size(F.split("q", " ")) == 1
    asked = queries.where(F.length("q") >= 5)
    least = asked.select("q", F.when(single, LEAST_OF_ONE_WORD).otherwise(LEAST).alias("least")).distinct()
    both = fuzzy.candidates(least, catalog.select("title_key"), "q", "title_key", "least")
    both = both.where(~(single & (F.size(F.split("title_key", " ")) == 1) & (F.abs(F.length("q") - F.length("title_key")) > 2)))
    scored = both.withColumn("score", ratio("q", "title_key")).where(F.col("score") >= F.col("least")).select("q", "title_key", "score")
    first = Window.partitionBy("title_key", "shelf").orderBy("item_id")
    items = shelved(queries, catalog.select("item_id", "title_key", *(["category"] if "wanted" in queries.columns else [])))
    items = items.withColumn("n_", F.row_number().over(first)).where(F.col("n_") <= max(limit, 2))
    rows = scored.join(distinct_queries(asked), "q").join(items, "title_key").where(F.col("wanted").eqNullSafe(F.col("shelf")))
    order = Window.partitionBy("q", "wanted").orderBy(F.desc("score"), "item_id")
    rows = rows.withColumns({"rank": F.row_number().over(order), "top": F.max("score").over(Window.partitionBy("q", "wanted"))}).where(F.col("rank") <= max(limit, 2))
    whole = F.max(F.when(F.col("rank") == 2, F.col("score"))).over(Window.partitionBy("q", "wanted"))
    clear = rows.withColumn("second", whole).where(F.col("second").isNull() | (F.col("top") - F.col("second") >= gap)).where(F.col("rank") <= limit)
    return for_each(asked, clear.select("q", "wanted", "item_id", "rank", "score")).select("query_id", "item_id", "rank", "score")


def search(queries: DataFrame, catalog: DataFrame, limit: int = 3) -> DataFrame:
    """(query_id, item_id, rank, stage): each stage takes the queries that those before found nothing for.

    queries(query_id, q[, wanted]): with `wanted`, a query finds items of that category only, null: of any.
    """
    words = best_matches(queries, catalog, limit).withColumn("stage", F.lit("words"))
    rest = queries.join(words.select("query_id").distinct(), "query_id", "left_anti")
    short = compact_matches(rest, catalog, limit).select("query_id", "item_id", "rank", F.lit("compact").alias("stage"))
    like = similar(rest, catalog, limit).select("query_id", "item_id", "rank", F.lit("similar").alias("stage"))
    return words.unionByName(short).unionByName(like)


def with_requested_part(matched: DataFrame) -> DataFrame:
    """Matches whose titles name the season and episode asked for."""
    value = F.lower(titles.title_query(F.concat_ws(" ", "title", "episode_title")))
    return matched.where(titles.names_season(value, F.col("season")) & titles.names_episode(value, F.col("episode")))
