"""Operators that keep state between micro-batches: merging, submissions that a label consumes once, messages with a last day."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import merging

RECORD = [c for c in merging.STORED.split(", ") if c.split()[0] not in (*merging.BY, "item_id")]
NAMES = [c.split()[0] for c in RECORD]


class Merger(StatefulProcessor):
    """merging.merged() over a stream: the open items of a group, kind, status and base title, by their ids."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item_id long", ", ".join(RECORD))

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        self.items.updateValue((initialState["item_id"],), tuple(initialState[n] for n in NAMES))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        own = dict(zip(merging.BY, key, strict=True))
        records = sorted(({**own, "item_id": k[0], **dict(zip(NAMES, v, strict=True))} for k, v in self.items.iterator()), key=lambda r: r["item_id"]) if self.items.exists() else []
        changed = {}
        for row in sorted((r.asDict() for r in rows), key=lambda r: (r["seq"], r["matched_id"] is not None, r["matched_id"])):
            hit = merging.taken(records, row | own, self.window)
            changed[hit["item_id"]] = hit
        for item, record in changed.items():
            self.items.updateValue((item,), tuple(record[n] for n in NAMES))
            yield Row(**{c.split()[0]: record[c.split()[0]] for c in merging.STORED.split(", ")})

    def close(self) -> None:
        pass


def merged_stream(items: DataFrame, stored: DataFrame | None = None, window: int = 50) -> DataFrame:
    """Open items that each micro-batch of items changes (update mode).  Items come in order of seq from batch to batch; then the
    last row of each item is what merging.merged() gives, however the stream is cut.  stored: open items to begin with.

    State is a map of open items for each group, kind, status and base title; it needs the RocksDB state store.
    """
    rows = merging.keyed(items).where("key <> ''").select(*merging.BY, *merging.INCOMING)
    begin = None if stored is None else stored.select([c.split()[0] for c in merging.STORED.split(", ")]).groupBy(*merging.BY)
    return rows.groupBy(*merging.BY).transformWithState(Merger(window), merging.STORED, "Update", "None", begin)


def consumed(events: DataFrame, key: str, ts: str, tie: str, asks: Column, answers: Column, minutes: int = 15) -> DataFrame:
    """(key, asked_id, asked_at, answer_id, answered_at, outcome) of every submission in events; ids are those of `tie`.

    A submission waits for one answer for so many minutes; a later one of its key takes its place, an answer consumes it.
    outcome: answered, expired (an answer came too late), replaced, or waiting.  So only the next event of the key
    matters.  Events that neither ask nor answer are left out; those at one time are in order of tie.
    """
    kind = F.when(asks, "ask").when(answers, "answer")
    rows = events.select(F.col(key), F.col(ts).alias("at"), F.col(tie).alias("id"), kind.alias("kind")).where("kind is not null")
    after = Window.partitionBy(key).orderBy("at", "id")
    rows = rows.withColumn("next", F.lead(F.struct("at", "id", "kind")).over(after)).where("kind = 'ask'")
    in_time = F.col("next.at") <= F.col("at") + F.expr(f"interval {minutes} minutes")
    outcome = F.when(F.col("next").isNull(), "waiting").when(F.col("next.kind") == "ask", "replaced").when(in_time, "answered").otherwise("expired")
    mine = lambda c: F.when(outcome == "answered", F.col(c))
    return rows.select(key, F.col("id").alias("asked_id"), F.col("at").alias("asked_at"), mine("next.id").alias("answer_id"), mine("next.at").alias("answered_at"), outcome.alias("outcome"))


class Waiting(StatefulProcessor):
    """One submission of a key that waits for an answer, with a timer for the end of its time."""

    def __init__(self, wait_us: int):
        self.wait_us = wait_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.asked = handle, handle.getValueState("asked", "id long, at long")

    def told(self, key: tuple, asked: tuple, outcome: str, answer: Row | None = None) -> Row:
        return Row(key=key[0], asked_id=asked[0], asked_at=asked[1], answer_id=answer and answer["id"], answered_at=answer and answer["us"], outcome=outcome)

    def over(self, asked: tuple) -> int:
        """The first millisecond after a submission's time."""
        return (asked[1] + self.wait_us) // 1000 + 1

    def drop(self, asked: tuple) -> None:
        self.handle.deleteTimer(self.over(asked))
        self.asked.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: (r["us"], r["id"])):
            asked = self.asked.get() if self.asked.exists() else None
            if asked is not None:
                self.drop(asked)
                if row["kind"] == "ask":
                    yield self.told(key, asked, "replaced")
                else:
                    late = row["us"] > asked[1] + self.wait_us
                    yield self.told(key, asked, "expired" if late else "answered", None if late else row)
            if row["kind"] == "ask":
                new = (row["id"], row["us"])
                self.asked.update(new)
                self.handle.registerTimer(self.over(new))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        asked = self.asked.get() if self.asked.exists() else None
        if asked is not None and self.over(asked) <= expiredTimerInfo.getExpiryTimeInMs():
            self.asked.clear()
            yield self.told(key, asked, "expired")

    def close(self) -> None:
        pass


def consumed_stream(events: DataFrame, key: str, ts: str, tie: str, asks: Column, answers: Column, minutes: int = 15, late: str = "10 minutes") -> DataFrame:
    """consumed() over a stream: each submission once, when its answer comes, another replaces it, or the watermark passes its time.

    times are microseconds.  Events of a key come in order from batch to batch; a submission that nothing follows expires
    here, where consumed() says that it waits.  State is one row a key with an open submission.
    """
    kind = F.when(asks, "ask").when(answers, "answer")
    rows = events.withWatermark(ts, late).select(F.col(key).alias("key"), F.col(ts), F.unix_micros(F.col(ts)).alias("us"), F.col(tie).alias("id"), kind.alias("kind")).where("kind is not null and key is not null")
    return rows.groupBy("key").transformWithState(Waiting(minutes * 60_000_000), "key long, asked_id long, asked_at long, answer_id long, answered_at long, outcome string", "Append", "EventTime")


class LastDay(StatefulProcessor):
    """A message that is deleted once, when its time has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.due = handle, handle.getValueState("due", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = max(row["ms"] for row in rows)  # a later one takes the place of an earlier
        now = timerValues.getCurrentWatermarkInMs()
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            last = max(last, self.due.get()[0])
        if last <= now:
            self.due.clear()
            yield Row(message_id=key[0], deleted_for=last)
        else:
            self.due.update((last,))
            self.handle.registerTimer(last)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.due.exists():
            last = self.due.get()[0]
            self.due.clear()
            yield Row(message_id=key[0], deleted_for=last)

    def close(self) -> None:
        pass


def due_stream(messages: DataFrame, ts: str = "ts", delete_after: str = "delete_after", late: str = "10 minutes") -> DataFrame:
    """(message_id, deleted_for in milliseconds), once for each of messages(message_id, ts, delete_after) whose time the watermark has passed."""
    rows = messages.withWatermark(ts, late).where(F.col(delete_after).isNotNull()).select("message_id", F.col(ts), F.unix_millis(delete_after).alias("ms"))
    return rows.groupBy("message_id").transformWithState(LastDay(), "message_id long, deleted_for long", "Append", "EventTime")
