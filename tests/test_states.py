"""Streams with state: the same as their batch forms, however the stream is cut, restarts included."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from larkspur.operators import merging
from larkspur.streaming import states

ITEMS = "seq long, group_id long, kind string, status string, message_id long, sender_id long, text string, title_query string, matched_title string, matched_id long, category string"


def requests(spark, n: int, seed: int = 1):
    random.seed(seed)
    titles = ["Silo", "silo season 1", "Silo S1", "Silo season 2 episode 3", "Silo episode 3", "Dark", "Dark season 1", "dark s01e02", "!!!"]
    rows = [(k + 1, random.randrange(2), random.choice(["request", "broken_link"]), "open", random.choice([None, 0, (1 << 60) + k]), random.choice([None, k]), f"t{k}", random.choice(titles), None, random.choice([None, None, None, 7, 8]), random.choice([None, None, "tv", "movie"])) for k in range(n)]
    return spark.createDataFrame(rows, ITEMS)


def run(stream, path, name: str, mode: str) -> None:
    """One start of a query; what its micro-batches give is appended to a table of files with their numbers."""
    def keep(batch, epoch):  # noqa: E306
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(str(path / name))

    q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", str(path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination(300)


def test_merging_in_two_runs(spark):
    items = requests(spark, 120)
    one = sorted(map(tuple, merging.merged(items).collect()), key=repr)
    for cut in (0, 1, 50, 120):
        stored = merging.merged(items.where(F.col("seq") <= cut))
        assert sorted(map(tuple, merging.merged(items.where(F.col("seq") > cut), stored=stored).collect()), key=repr) == one
        logs = merging.merge_log(items.where(F.col("seq") <= cut)).unionByName(merging.merge_log(items.where(F.col("seq") > cut), stored=stored))
        assert sorted(map(tuple, logs.collect())) == sorted(map(tuple, merging.merge_log(items).collect()))
    log = merging.merge_log(items).groupBy("item_id").agg(F.max("occurrence_count").alias("n"))
    assert {(r["item_id"], r["n"]) for r in log.collect()} == {(r["item_id"], r["occurrence_count"]) for r in merging.merged(items).collect()}


def test_merged_stream(spark, tmp_path):
    """From stored items on, in several micro-batches and two starts."""
    items = requests(spark, 90)
    stored = merging.merged(items.where("seq <= 30"))
    stored.write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    for k, (a, z) in enumerate(((30, 45), (45, 46), (46, 90))):
        items.where(F.col("seq").between(a + 1, z)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run(states.merged_stream(stream, stored), tmp_path, "merged", "update")
    names = stored.columns
    seen = spark.read.parquet(str(tmp_path / "merged"))
    last = seen.groupBy("item_id").agg(F.max_by(F.struct(*names), "epoch").alias("x")).select("x.*")
    untouched = stored.join(last, "item_id", "left_anti").select(names)
    assert sorted(map(tuple, last.unionByName(untouched).collect()), key=repr) == sorted(map(tuple, merging.merged(items).select(names).collect()), key=repr)


def clicks(spark, n: int):
    random.seed(3)
    at, rows = 0, []
    for k in range(n):
        at += random.choice([0, 10, 200, 899, 900, 901, 3000])
        rows.append((k, random.randrange(3), at, random.choice(["view", "view", "click", "other"])))
    return spark.createDataFrame(rows, "id long, key long, s long, kind string").withColumn("ts", F.timestamp_seconds("s"))


def test_consumed_once(spark):
    """Against a dictionary of open submissions."""
    df, open_, expected = clicks(spark, 200), {}, {}
    for r in df.orderBy("s", "id").collect():
        if r["kind"] == "other":
            continue
        was = open_.pop(r["key"], None)
        if was:
            expected[was["id"]] = "replaced" if r["kind"] == "view" else "answered" if r["s"] <= was["s"] + 900 else "expired"
        if r["kind"] == "view":
            open_[r["key"]] = r
    expected |= {r["id"]: "waiting" for r in open_.values()}
    got = states.consumed(df, "key", "ts", "id", F.col("kind") == "view", F.col("kind") == "click").collect()
    assert {r["asked_id"]: r["outcome"] for r in got} == expected and len(got) == len(expected)
    answers = [r["answer_id"] for r in got if r["answer_id"] is not None]
    assert len(answers) == len(set(answers)) == sum(o == "answered" for o in expected.values()) > 5


def test_consumed_stream(spark, tmp_path):
    df = clicks(spark, 90)
    for a in (0, 30, 60):
        df.where(F.col("id").between(a, a + 29)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        run(states.consumed_stream(stream, "key", "ts", "id", F.col("kind") == "view", F.col("kind") == "click"), tmp_path, "waiting", "append")
    got = spark.read.parquet(str(tmp_path / "waiting")).collect()
    batch = {r["asked_id"]: (r["outcome"], r["answer_id"]) for r in states.consumed(df, "key", "ts", "id", F.col("kind") == "view", F.col("kind") == "click").collect()}
    assert len(got) == len({r["asked_id"] for r in got})
    for r in got:
        outcome, answer = batch[r["asked_id"]]
        assert (r["outcome"], r["answer_id"]) in ((outcome, answer), ("expired", None)) and (r["outcome"] == outcome or outcome in ("waiting", "replaced"))
    assert {k for k, (o, _) in batch.items() if o == "answered"} == {r["asked_id"] for r in got if r["outcome"] == "answered"}


def test_due_stream(spark, tmp_path):
    """Each message is deleted once, when the watermark has passed its time; what comes late is due at once."""
    df = spark.createDataFrame([(k, 100 * k, None if k % 5 == 0 else 100 * k + 60 * (k % 7)) for k in range(60)], "message_id long, s long, d long").select("message_id", F.timestamp_seconds("s").alias("ts"), F.timestamp_seconds("d").alias("delete_after"))
    for a in (0, 20, 40):
        df.where(F.col("message_id").between(a, a + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(states.due_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), tmp_path, "due", "append")
    got = spark.read.parquet(str(tmp_path / "due")).collect()
    watermark = 100 * 59 - 600
    assert sorted((r["message_id"], r["deleted_for"] // 1000) for r in got) == [(k, 100 * k + 60 * (k % 7)) for k in range(60) if k % 5 and 100 * k + 60 * (k % 7) <= watermark]
