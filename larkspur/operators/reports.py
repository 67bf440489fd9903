"""Counts, recency lists and console figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scoring import reviewable


def counts_with_all(df: DataFrame, column: Column, names: list[str]) -> DataFrame:
    """(label, n) of each of these names, 0 where there is none."""
    counts = df.agg(*(F.count_if(column == n).alias(n) for n in names))
    return counts.unpivot([], names, "label", "n")


def recent(events: DataFrame, n: int, at: str, tie: str, where: Column | None = None) -> DataFrame:
    """The n newest rows, of those that pass a filter."""
    rows = events if where is None else events.where(where)
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(n)


def reviewable_history(events: DataFrame, at: str, tie: str, seen: int = fixed.HISTORY_SEEN, kept: int = fixed.HISTORY_KEPT) -> DataFrame:
    """Of the `seen` newest events those worth a review, at most `kept`: the filter comes after the first limit."""
    return recent(recent(events, seen, at, tie).where(reviewable(events)), kept, at, tie)


def violations(hits: DataFrame) -> DataFrame:
    """Per (group_id, user_id): count, largest score, last action and time, from hits(group_id, user_id, ts, tie, action, score)."""
    last = F.struct("ts", "tie")
    return hits.groupBy("group_id", "user_id").agg(F.count("*").alias("violation_count"), F.max("score").alias("risk_score"), F.max_by("action", last).alias("last_action"), F.max("ts").alias("last_violation_at"))
