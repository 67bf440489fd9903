"""Support messages from intent to answer: one plan in which each message ends at the first stage that answers it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing, text, titles
from ..sources.tables import cut, spread
from . import catalog, merging

INTENT = ["kind", "title", "category", "issue_type", "season", "episode"]


def with_intents(messages: DataFrame, tell: bool = False) -> DataFrame:
    """titles.with_intent() of messages(text, ...), for each text once, however many messages have it."""
    said = titles.with_intent(spread(messages.select("text").distinct()), tell=tell).withColumnRenamed("text", "said_")
    return messages.join(said, F.col("text").eqNullSafe(F.col("said_")), "left").drop("said_")


def with_understood(messages: DataFrame) -> DataFrame:
    """Adds the intent of messages(text, answer): by rules; else by a model's answer, where one is valid and sure; else as a bare title."""
    df = with_intents(messages, tell=True).withColumn("model_", parsing.intent(F.col("answer")))
    modelled = F.col("model_").isNotNull() & (F.col("kind").isNull() | F.col("by_bare_title"))
    return df.withColumns({c: F.when(modelled, F.col(f"model_.{c}")).otherwise(F.col(c)) for c in INTENT}).drop("model_", "by_bare_title")


def key_of(*columns: str) -> Column:
    """One text for several columns, nulls told from empty texts."""
    return F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns))


def found_for(asked: DataFrame, items: DataFrame, limit: int = 3) -> DataFrame:
    """(asked_key, n_matches, matched_id, matched_title) of distinct asked(asked_key, query_id, q, category, season, episode) that have matches.

    What many messages ask for is searched once; of the best `limit` items those that name the part asked for count.
    """
    queries = asked.select("query_id", "q", F.col("category").alias("wanted")).distinct()
    best = catalog.search(queries, items, limit).select("query_id", "item_id", "rank")
    parts = asked.select("asked_key", "query_id", "season", "episode")
    named = items.select("item_id", "title", "episode_title", text.display_title(F.col("title"), F.col("episode_title"), F.col("category"), F.col("year")).alias("shown"))
    met = catalog.with_requested_part(best.join(parts, "query_id").join(named, "item_id"))
    first = F.min_by(F.struct("item_id", "shown"), F.struct("rank", "item_id"))
    return met.groupBy("asked_key").agg(F.count("*").alias("n_matches"), first.alias("x")).select("asked_key", "n_matches", F.col("x.item_id").alias("matched_id"), F.col("x.shown").alias("matched_title"))


def routed(messages: DataFrame, items: DataFrame, availability: DataFrame, today: Column) -> DataFrame:
    """messages(message_id, group_id, sender_id, text, answer) with intent, matches, availability and `outcome`.

    items(item_id, title, episode_title, title_key, category, year, updated); availability(title in lower case, season,
    episode, found, media_type, the dates and *_exists of titles.availability_state), one row a title and part at most.
    outcome: ignored, availability (a title that isn't out answers it), request, issue (both to be merged), or reply.
    """
    df = cut(with_understood(messages)).withColumn("q", F.lower(F.col("title")))
    df = df.withColumns({"query_id": key_of("q", "category"), "asked_key": key_of("q", "category", "season", "episode"), "about": key_of("q", "season", "episode")})
    asked = df.where(F.length("title") >= 2).select("asked_key", "query_id", "q", "category", "season", "episode").distinct()
    df = df.join(found_for(asked, items), "asked_key", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0).cast("long")))
    told = availability.withColumn("q", F.col("title")).select(key_of("q", "season", "episode").alias("about"), titles.availability_state(today).alias("told"))
    asks = F.col("kind").isin("release", "request", "issue") & F.col("title").isNotNull()
    df = df.join(told, "about", "left").withColumn("state", F.when(asks, F.col("told")))
    waits = F.coalesce(titles.blocks_logging(F.col("kind"), F.col("issue_type"), F.col("state")), F.lit(False))
    outcome = F.when(F.col("kind").isNull() | ((F.col("kind") == "bare_title") & (F.col("n_matches") == 0)), "ignored").when(waits, "availability").when((F.col("kind") == "request") & F.col("title").isNotNull(), "request").when(F.col("kind") == "issue", "issue").otherwise("reply")
    return df.withColumn("outcome", outcome).drop("q", "query_id", "asked_key", "about", "told")


def to_merge(routes: DataFrame) -> DataFrame:
    """Requests and issues of routed() as merging takes them; message ids are the order of arrival."""
    request = F.col("outcome") == "request"
    status = F.when(~request, "open").when(F.col("n_matches") > 0, "found").otherwise("open")
    kind = F.when(request, "request").otherwise(F.coalesce("issue_type", F.lit("general")))
    rows = routes.where(F.col("outcome").isin("request", "issue"))
    return rows.select(F.col("message_id").alias("seq"), "group_id", kind.alias("kind"), status.alias("status"), "message_id", "sender_id", "text", titles.with_part(F.col("title"), F.col("season"), F.col("episode")).alias("title_query"), "matched_title", "matched_id", "category")


def handled(messages: DataFrame, items: DataFrame, availability: DataFrame, today: Column, stored: DataFrame | None = None) -> DataFrame:
    """routed() with what became of requests and issues: status, item_id and occurrence_count of the open item each went into.

    Issues without a title stay on their own.  stored: open items of an earlier run.
    """
    routes = cut(routed(messages, items, availability, today))
    rows = to_merge(routes)
    log = merging.merge_log(rows, stored=stored).withColumnRenamed("seq", "message_id")
    df = routes.join(rows.select(F.col("seq").alias("message_id"), "status"), "message_id", "left").join(log, "message_id", "left")
    merges = F.col("status").isNotNull()
    return df.withColumns({"item_id": F.when(merges, F.coalesce("item_id", "message_id")), "occurrence_count": F.when(merges, F.coalesce("occurrence_count", F.lit(1).cast("long")))})
