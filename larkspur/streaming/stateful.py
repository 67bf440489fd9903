"""Time-driven operators, in batch form and as streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T


def seconds(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def rate_limited(events: DataFrame, key: str, ts: str, tie: str, limit: int, window_s: int) -> DataFrame:
    """Adds `allowed`: whether fewer than `limit` events of the key were allowed in the window before.

    Denied events leave no trace, so this is a fold in time order; sorted partitions are read once, with at most `limit`
    times of the present key in memory.
    """
    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, log = None, deque()
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch["at_"], strict=True):
                if k != now:
                    now, log = k, deque()
                while log and log[0] <= t - window_s:
                    log.popleft()
                out.append(len(log) < limit)
                if out[-1]:
                    log.append(t)
            yield batch.drop(columns="at_").assign(allowed=pd.Series(out, dtype=bool, index=batch.index))

    ordered = events.withColumn("at_", seconds(ts)).repartition(key).sortWithinPartitions(key, "at_", tie)
    return ordered.mapInPandas(fold, schema)


def cached(calls: DataFrame, key: str, ts: str, tie: str, ttl_s: int) -> DataFrame:
    """Adds `fetched_at`, when the answer to each call was fetched, and `fetched`, whether for this call.

    An answer serves its key for ttl_s seconds, the last excluded; 0 keeps none.  The next fetch depends on the one before,
    so this is a fold in time order; sorted partitions are read once, with one time in memory.
    """
    schema = T.StructType([*calls.schema.fields, T.StructField("fetched_at", T.LongType()), T.StructField("fetched", T.BooleanType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = object(), 0
        for batch in batches:
            since, made = [], []
            for k, t in zip(batch[key], batch["at_"], strict=True):
                made.append(k != now or t >= last + ttl_s * 1_000_000)
                if made[-1]:
                    now, last = k, t
                since.append(last)
            yield batch.drop(columns="at_").assign(fetched_at=pd.Series(since, dtype="int64", index=batch.index), fetched=pd.Series(made, dtype=bool, index=batch.index))

    ordered = calls.withColumn("at_", F.unix_micros(F.col(ts).cast("timestamp"))).repartition(key).sortWithinPartitions(key, "at_", tie)
    return ordered.mapInPandas(fold, schema).withColumn("fetched_at", F.timestamp_micros("fetched_at"))


def sender_frequency(events: DataFrame, key: str = "user_id", ts: str = "ts", window_s: int = 3600, many: int = 6) -> DataFrame:
    """Adds recent_count, the sender's messages in the window up to each, itself included, and `frequent`."""
    recent = Window.partitionBy(key).orderBy(F.unix_seconds(F.col(ts).cast("timestamp"))).rangeBetween(-window_s, 0)
    return events.withColumn("recent_count", F.count("*").over(recent)).withColumn("frequent", F.col("recent_count") >= many)


def repeats(messages: DataFrame, group: str, key_hash: str, order: str) -> DataFrame:
    """Adds `repeated`: whether the same text came earlier in the same group."""
    return messages.withColumn("repeated", F.row_number().over(Window.partitionBy(group, key_hash).orderBy(order)) > 1)


def due(messages: DataFrame, now: Column, at: str = "delete_after", purposes: list[str] | None = None) -> DataFrame:
    rows = messages.where(F.col(at).isNotNull() & (F.col(at) <= now))
    return rows if purposes is None else rows.where(F.col("purpose").isin(purposes))


def open_reviews(reviews: DataFrame, now: Column) -> DataFrame:
    return reviews.where((F.col("status") == "pending") & (F.col("expires_at") > now))


def answered(asked: DataFrame, labels: DataFrame, key: str, minutes: int = 15) -> DataFrame:
    """Each submission with the first label of its key within `minutes`; asked(key, asked_id, asked_at), labels(key, label, labelled_at, label_id).  Works on two streams with watermarks up to the choice of the first."""
    a, b = asked.alias("a"), labels.alias("b")
    within = (F.col("b.labelled_at") >= F.col("a.asked_at")) & (F.col("b.labelled_at") <= F.col("a.asked_at") + F.expr(f"interval {minutes} minutes"))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & within).select(F.col(f"a.{key}"), "asked_id", "asked_at", "label_id", "label", "labelled_at")


def refresh_due(now: Column, last: Column, items: Column, interval_s: Column, slot: Column, last_slot: Column) -> Column:
    """Whether a catalog refresh is due: nothing cached, the interval is over, or a new time of day (HH:MM) has come."""
    here = F.concat(F.date_format(now, "yyyy-MM-dd"), F.lit("T"), slot)
    at_slot = (F.date_format(now, "HH:mm") == slot) & (F.coalesce(last_slot, F.lit("")) != here)
    elapsed = (interval_s > 0) & (F.unix_seconds(now) - F.unix_seconds(last) >= interval_s)
    return (items == 0) | F.coalesce(elapsed, F.lit(False)) | F.coalesce(at_slot, F.lit(False))


def violations_fold(scored: DataFrame, threshold: float = 0.88) -> DataFrame:
    """Adds prior (the sender's violation score before each message) and hit, where each hit raises later scores.

    scored(user_id, seq, base): a message is a hit if base + 0.06 * prior reaches the threshold.  A hit depends on hits
    before it, so this is a fold in order over sorted partitions with two numbers of state.
    """
    schema = T.StructType([*scored.schema.fields, T.StructField("prior", T.DoubleType()), T.StructField("hit", T.BooleanType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, count, risk = None, 0, 0.0
        for batch in batches:
            prior, hits = [], []
            for user, base in zip(batch["user_id"], batch["base"], strict=True):
                if user != now:
                    now, count, risk = user, 0, 0.0
                prior.append(min(0.20, count * 0.04 + risk * 0.12) if count else 0.0)
                score = min(1.0, base + 0.06 * prior[-1])
                hits.append(score >= threshold)
                if hits[-1]:
                    count, risk = count + 1, max(risk, score)
            yield batch.assign(prior=prior, hit=pd.Series(hits, dtype=bool, index=batch.index))

    return scored.repartition("user_id").sortWithinPartitions("user_id", "seq").mapInPandas(fold, schema)


class RateLimiter(StatefulProcessor):
    """The same limiter over a stream: a list of allowed times per key."""

    def __init__(self, limit: int, window_s: int):
        self.limit, self.window_s = limit, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        log = deque(r[0] for r in self.log.get()) if self.log.exists() else deque()
        batch = pd.concat(rows).sort_values(["at", "event_id"], ignore_index=True)
        allowed = []
        for t in batch["at"]:
            while log and log[0] <= t - self.window_s:
                log.popleft()
            allowed.append(len(log) < self.limit)
            if allowed[-1]:
                log.append(t)
        self.log.put([(t,) for t in log]) if log else self.log.clear()
        yield pd.DataFrame({"user_id": key[0], "event_id": batch["event_id"], "allowed": allowed})

    def close(self) -> None:
        pass


def rate_limited_stream(events: DataFrame, limit: int, window_s: int) -> DataFrame:
    """events(user_id, event_id, ts) as a stream; needs the RocksDB state store."""
    rows = events.select("user_id", "event_id", seconds().alias("at"))
    return rows.groupBy("user_id").transformWithStateInPandas(RateLimiter(limit, window_s), "user_id long, event_id long, allowed boolean", "Append", "None")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Sessions of each user; a stream emits those that its watermark has closed."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late and events.isStreaming else rows
    grouped = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return grouped.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", "total")


def scored_stream(messages: DataFrame, score, sink, checkpoint: str):
    """Applies `score`, a batch transformation, to each micro-batch, and hands the result to `sink`; edited messages are new rows."""
    return messages.writeStream.foreachBatch(lambda batch, epoch: sink(score(batch), epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
