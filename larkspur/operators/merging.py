"""Merging of repeated requests and issues."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import titles

MERGED = "group_id long, kind string, status string, base string, item_id long, title string, category string, occurrence_count long, first_message long, first_sender long, last_text string, matched_id long"


def keyed(items: DataFrame) -> DataFrame:
    """Adds key, base, season, episode to items(matched_title, title_query, ...)."""
    key = titles.merge_key(F.coalesce(F.nullif("matched_title", F.lit("")), "title_query"))
    items = items.withColumn("key", key)
    return items.withColumns({"base": titles.base_key(F.col("key")), "season": titles.part_of_key(F.col("key"), "season"), "episode": titles.part_of_key(F.col("key"), "episode")})


def counts_by_key(items: DataFrame, *by: str) -> DataFrame:
    """Occurrences of equal keys: first sender and message that are given, last text, last match that is known.

    By seq; items with one seq are in order of `place`, where items have it.
    """
    at = F.struct("seq", "place") if "place" in items.columns else F.col("seq")
    given = lambda c: F.nullif(c, F.lit(0))
    first = lambda c: F.min_by(given(c), F.when(given(c).isNotNull(), at))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    return items.groupBy(*by).agg(F.count("*").alias("occurrence_count"), first("message_id").alias("first_message"), first("sender_id").alias("first_sender"), F.max_by("text", at).alias("last_text"), last("matched_id").alias("matched_id"))


def agree(a: tuple, b: tuple) -> bool:
    """Whether (season, episode) of two items of one base title can be one request."""
    if a == b or a == (None, None) or b == (None, None):
        return True
    shared = [(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None]
    return bool(shared) and all(x == y for x, y in shared)


BY = ["group_id", "kind", "status", "base"]
#: An open item as it is stored: MERGED and the part of its title that it was made with.
STORED = MERGED + ", season int, episode int"
#: What the fold reads of an incoming item.
INCOMING = ["seq", "title_query", "category", "season", "episode", "message_id", "sender_id", "text", "matched_id"]


def taken(records: list[dict], row: dict, window: int) -> dict:
    """The record of records that row is merged into: one with the id matched before, else the first of `window` whose part and category agree, else a new one."""
    part = (row["season"], row["episode"])
    hit = next((r for r in records if row["matched_id"] is not None and r["matched_id"] == row["matched_id"]), None)
    hit = hit or next((r for r in records[:window] if not (row["category"] and r["category"] and row["category"] != r["category"]) and agree(part, (r["season"], r["episode"]))), None)
    if hit is None:
        hit = {k: row[k] for k in (*BY, "category", "matched_id", "season", "episode")}
        hit |= {"item_id": row["seq"], "title": row["title_query"], "occurrence_count": 0, "first_message": None, "first_sender": None}
        records.append(hit)
    hit["occurrence_count"] += 1
    hit["first_message"] = hit["first_message"] or row["message_id"]
    hit["first_sender"] = hit["first_sender"] or row["sender_id"]
    hit["last_text"], hit["matched_id"] = row["text"], row["matched_id"] or hit["matched_id"]
    return hit


def in_order(items: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Open items first, then incoming ones by arrival, sorted within what can meet."""
    rows = keyed(items).where("key <> ''").select(*BY, *INCOMING)
    if stored is not None:
        kept = [c.split()[0] for c in STORED.split(", ") if c.split()[0] not in (*BY, *rows.columns)]
        rows = rows.unionByName(stored.select(*BY, "category", "season", "episode", "matched_id", *kept), allowMissingColumns=True)
    return rows.repartition(*BY).sortWithinPartitions(*BY, F.col("seq").isNotNull(), *(["item_id"] if stored is not None else []), "seq", "matched_id")


def folded(items: DataFrame, stored: DataFrame | None, window: int, schema_: str, told) -> DataFrame:
    """The fold over in_order(): told(row, record) after each incoming row, told(None, record) of each record at its end; None is left out."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema_.split(", "))])
    by, names = BY, schema.names

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, records = None, []
        table = lambda out: pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in out if r is not None], schema)
        for batch in batches:
            out: list[dict | None] = []
            for row in batch.to_pylist():  # Arrow's integers stay integers beside nulls
                key = tuple(row[c] for c in by)
                if key != now:
                    out += [told(None, r) for r in records]
                    now, records = key, []
                if row["seq"] is None:
                    records.append(row)
                else:
                    out.append(told(row, taken(records, row, window)))
            yield table(out)
        yield table([told(None, r) for r in records])

    return in_order(items, stored).mapInArrow(fold, schema_)


def merged(items: DataFrame, window: int = 50, stored: DataFrame | None = None) -> DataFrame:
    """Open items (STORED) after items were folded into them in order of arrival.

    Agreement isn't an equivalence (a title without season agrees with every season), so the fold is sequential within
    what can meet: a group, kind, status and either a matched id or a base title.  Rows with one matched id and one base
    meet there; the fold keeps one open record per distinct (season, episode, category, matched id), whatever the number of
    rows, and rows come sorted, so a hot title needs the memory of its records only.
    items(seq, group_id, kind, status, message_id, sender_id, text, title_query, matched_title, matched_id, category); seq
    isn't null; rows with one seq are in order of matched_id.  stored: the open items of an earlier run; merging a log in two runs gives what one run gives.
    """
    return folded(items, stored, window, STORED, lambda row, record: record if row is None else None)


def merge_log(items: DataFrame, window: int = 50, stored: DataFrame | None = None) -> DataFrame:
    """(seq, item_id, occurrence_count): the open item that each incoming item went into, and its count at that time."""
    return folded(items, stored, window, "seq long, item_id long, occurrence_count long", lambda row, record: row and {"seq": row["seq"], "item_id": record["item_id"], "occurrence_count": record["occurrence_count"]})


def first_compatible(incoming: DataFrame, open_items: DataFrame) -> DataFrame:
    """The open item with the smallest id that each incoming item can be merged into; found by base title, then tested.

    Only distinct keys meet, an open one with its smallest id, so a title that many items have costs no pairs of items.
    """
    by = ["group_id", "status", "base", "key", "category"]
    rows = keyed(incoming).where("key <> ''")
    a = rows.select(*by).distinct().alias("a")
    b = keyed(open_items).where("key <> ''").groupBy(*by).agg(F.min("item_id").alias("item_id")).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("group_id", "status", "base")]
    ok = titles.keys_compatible(F.col("a.key"), F.col("b.key")) & ~F.coalesce(F.col("a.category") != F.col("b.category"), F.lit(False))
    met = a.join(b, same).where(ok).groupBy(*(F.col(f"a.{c}").alias(f"{c}_") for c in by)).agg(F.min("item_id").alias("item_id"))
    own = [rows[c].eqNullSafe(met[f"{c}_"]) if c == "category" else rows[c] == met[f"{c}_"] for c in by]
    return rows.join(met, own).select("seq", met["item_id"])


def latest(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key of an append-only log: upserts and status changes in batch form."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row")).select(*key, "row.*")


def upserted(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """table with changes applied: non-null values of a change win, new keys are added."""
    rest = [c for c in table.columns if c not in key]
    new = changes.select(*key, *(F.col(c).alias(f"new_{c}") for c in rest))
    both = table.join(new, key, "full")
    return both.select(*key, *(F.coalesce(f"new_{c}", c).alias(c) for c in rest))


def without(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def erased(tables: dict[str, DataFrame], groups: DataFrame, events: str = "moderation_events", reviews: str = "pending_reviews", sent: str = "bot_sent_messages") -> dict[str, DataFrame]:
    """All group-scoped tables without the rows of groups(group_id[, chat_id]); reviews go by their event's group, sent messages by its chat."""
    keys = groups.select("group_id").distinct()
    out = {name: without(df, keys, ["group_id"]) for name, df in tables.items() if "group_id" in df.columns}
    if reviews in tables:
        gone = tables[events].join(keys, "group_id", "left_semi").select("event_id")
        out[reviews] = without(tables[reviews], gone, ["event_id"])
    if sent in tables:
        out[sent] = without(tables[sent], groups, ["chat_id"])
    return out


def after_reviews(events: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events with their last review, new examples, violations by sender) that follow from reviews(event_id, verdict, seq)."""
    last = latest(reviews, ["event_id"], "seq").select("event_id", "verdict")
    done = events.join(last, "event_id", "left").withColumnRenamed("verdict", "review_result")
    label = F.when(F.col("verdict").isin("spam", "delete", "ban"), "spam").when(F.col("verdict") == "not_spam", "not_spam")
    examples = events.join(reviews, "event_id").withColumn("label", label).where("label is not null").select("event_id", "group_id", "label", "text")
    hits = done.where("review_result in ('spam', 'delete', 'ban')")
    risk = F.greatest("final_score", F.lit(0.95))
    bumps = hits.groupBy("group_id", "user_id").agg(F.count("*").alias("violation_count"), F.max(risk).alias("risk_score"))
    return done, examples, bumps


def running(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each row of a log with the count and largest score of its key before it."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumns({"violation_count": F.count("*").over(before), "risk_score": F.max("score").over(before)})
