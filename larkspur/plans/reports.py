"""Reports over stored events, labels, orders: counts, recency, state, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, scoring
from ..operators import merging, reports
from ..sources import tables
from ..sources.tables import read
from ..streaming import stateful, states
from .fixtures import quoted as s
from .moderation import found
from .registry import query

HIT = {"purchase": "delete", "error": "delete_and_ban"}  # fixture: which events stand for which action


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT l.label, coalesce(n, 0) AS n FROM (VALUES ('spam'), ('not_spam')) l(label) LEFT JOIN (SELECT CASE toxic WHEN 1 THEN 'spam' ELSE 'not_spam' END AS label, count(*) AS n FROM labels WHERE quality = 1 GROUP BY 1) USING (label)""")
def label_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "labels").where("quality = 1")
    return reports.counts_with_all(df, F.when(F.col("toxic") == 1, "spam").otherwise("not_spam"), ["spam", "not_spam"])


@query("""SELECT c.c_nationkey AS group_id, count(e.event_id) AS n FROM customer c LEFT JOIN events e ON e.user_id = c.c_custkey GROUP BY 1""")
def event_counts_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each group, groups without any included; events are counted by user before they meet their group."""
    counts = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("k"))
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("group_id"))
    return users.join(counts, "user_id", "left").groupBy("group_id").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))


@query("""SELECT (SELECT count(*) FROM nation) AS groups, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <= '2') AS open_issues, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority > '2') AS open_requests""")
def console_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four figures in one row, of four one-row aggregates."""
    orders = read(spark, sf_dir, "orders").agg(F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") <= "2")).alias("open_issues"), F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") > "2")).alias("open_requests"))
    one = lambda name, alias: read(spark, sf_dir, name).agg(F.count("*").alias(alias))
    return one("nation", "groups").join(one("events", "events")).join(orders)


@query("""SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND user_id % 3 = 0 ORDER BY ts DESC, event_id DESC LIMIT 50""")
def recent_events_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recent(events(spark, sf_dir), 50, "ts", "event_id", (F.col("event_type") == "error") & (F.col("user_id") % 3 == 0)).select("event_id", "user_id", "event_type")


@query("""WITH c AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 250), r AS (SELECT *, CASE event_type WHEN 'error' THEN 'delete' ELSE 'allow' END AS action, value / 1000.0 AS rule_score FROM c)
SELECT event_id, action, round(rule_score, 6) AS rule_score FROM r WHERE action <> 'allow' OR rule_score >= 0.25 ORDER BY ts DESC, event_id DESC LIMIT 10""")
def reviewable_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumns({"action": F.when(F.col("event_type") == "error", "delete").otherwise("allow"), "rule_score": F.col("value") / 1000.0})
    return reports.reviewable_history(df, "ts", "event_id").select("event_id", "action", F.round("rule_score", 6).alias("rule_score"))


@query(f"""SELECT doc_id, {found('text', [fixed.REVIEW_TEXT], '(?i)')} AS by_text, {found('lower(source || lang)', fixed.REVIEW_WORDS)} AS by_reason FROM documents""")
def reviewable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text and reason tests of a review, on document texts."""
    df = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("norm"), F.array(F.concat("source", "lang")).alias("reasons"))
    return df.select("doc_id", scoring.reviewable(df.select("norm")).alias("by_text"), scoring.reviewable(df.select("reasons")).alias("by_reason"))


@query("""SELECT o_custkey % 7 AS group_id, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS resolved, count(*) AS total FROM orders GROUP BY 1""")
def open_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = F.col("o_orderstatus")
    return read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 7).alias("group_id")).agg(F.count_if(st == "O").alias("open"), F.count_if(st == "F").alias("resolved"), F.count("*").alias("total"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.coalesce(*(F.when(F.col("event_type") == t, F.lit(a)) for t, a in HIT.items()))
    rows = events(spark, sf_dir).where(F.col("event_type").isin(list(HIT)))
    return rows.select((F.col("user_id") % 5).alias("group_id"), "user_id", "ts", F.col("event_id").alias("tie"), action.alias("action"), (F.col("value") / 500.0).alias("score"))


HITS_SQL = "h AS (SELECT user_id % 5 AS group_id, user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'delete' ELSE 'delete_and_ban' END AS action, value / 500.0::DOUBLE AS score FROM events WHERE event_type IN ('purchase', 'error'))"


@query(f"""WITH {HITS_SQL} SELECT group_id, user_id, count(*) AS violation_count, round(max(score), 6) AS risk_score, max_by(action, (ts, event_id)) AS last_action, round(least(0.2::DOUBLE, count(*) * 0.04::DOUBLE + max(score) * 0.12::DOUBLE), 6) AS violation_score FROM h GROUP BY ALL""")
def user_violation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reports.violations(hits(spark, sf_dir))
    return df.select("group_id", "user_id", "violation_count", F.round("risk_score", 6).alias("risk_score"), "last_action", F.round(scoring.violation_score(F.col("violation_count"), F.col("risk_score")), 6).alias("violation_score"))


@query(f"""WITH {HITS_SQL}, r AS (SELECT *, count(*) OVER w AS n, max(score) OVER w AS risk FROM h WINDOW w AS (PARTITION BY group_id, user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, user_id, n AS violation_count, CASE WHEN risk IS NULL THEN 0.0::DOUBLE ELSE round(least(0.2::DOUBLE, n * 0.04::DOUBLE + risk * 0.12::DOUBLE), 6) END AS previous_score, CASE WHEN n + 1 > 3 THEN 'silent' WHEN n + 1 = 3 THEN 'last_warning' ELSE 'reply' END AS strike FROM r""")
def previous_violation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of a sender before each of their violations, and what the strike brings."""
    df = merging.running(hits(spark, sf_dir), ["group_id", "user_id"], ["ts", "tie"])
    n = F.col("violation_count")
    score = scoring.violation_score(n, F.col("risk_score"))
    return df.select(F.col("tie").alias("event_id"), "user_id", n, F.round(score, 6).alias("previous_score"), scoring.strike(n + 1, F.lit(3)).alias("strike"))


@query("""SELECT e.event_type, count(*) AS n FROM events e WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c.c_acctbal > 5000) GROUP BY 1""")
def trusted_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    return read(spark, sf_dir, "events").join(trusted, "user_id", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT e.event_type, count(*) AS n FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c.c_acctbal > 5000) GROUP BY 1""")
def untrusted_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    return merging.without(read(spark, sf_dir, "events"), trusted, ["user_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS item_id, p_name AS title, p_type AS category FROM part ORDER BY p_size DESC NULLS LAST, p_retailprice DESC NULLS LAST, p_partkey LIMIT 100""")
def catalog_snapshot_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.snapshot(read(spark, sf_dir, "part"), 100, "p_size", "p_retailprice", "p_partkey")
    return df.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"))


@query("""SELECT p_partkey AS item_id, p_name AS title FROM part WHERE p_name ILIKE '%a%' AND p_size = 10""")
def catalog_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.contains_search(read(spark, sf_dir, "part"), "p_name", "A", p_size=10, p_brand=None)
    return df.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id, user_id FROM events, m WHERE event_type IN ('signup', 'view') AND ts + INTERVAL 7 DAY > now""")
def open_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews within their seven days at the time of the last event."""
    df = events(spark, sf_dir)
    now = df.agg(F.max("ts").alias("now"))
    reviews = df.where(F.col("event_type").isin("signup", "view")).withColumns({"status": F.lit("pending"), "expires_at": F.col("ts") + F.expr("interval 7 days")})
    return stateful.open_reviews(reviews.join(now), F.col("now")).select("event_id", "user_id")


@query("""WITH m AS (SELECT max(ts) AS now FROM events), d AS (SELECT *, CASE WHEN user_id % 4 = 0 THEN NULL ELSE ts + INTERVAL 1 HOUR * (event_id % 48) END AS delete_after FROM events)
SELECT event_id, event_type AS purpose FROM d, m WHERE event_type IN ('click', 'view') AND delete_after <= now""")
def due_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    now = df.agg(F.max("ts").alias("now"))
    after = F.when(F.col("user_id") % 4 != 0, F.col("ts") + F.expr("make_dt_interval(0, cast(event_id % 48 as int))"))
    sent = df.withColumns({"delete_after": after, "purpose": F.col("event_type")}).join(now)
    return stateful.due(sent, F.col("now"), purposes=["click", "view"]).select("event_id", "purpose")


@query("""WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup'), l AS (SELECT user_id, event_id, ts, event_type FROM events WHERE event_type IN ('purchase', 'error')),
j AS (SELECT p.user_id, p.event_id AS asked_id, l.event_id AS label_id, l.event_type AS label, row_number() OVER (PARTITION BY p.event_id ORDER BY l.ts, l.event_id) AS k FROM p JOIN l ON p.user_id = l.user_id AND l.ts >= p.ts AND l.ts <= p.ts + INTERVAL 6 HOUR)
SELECT user_id, asked_id, label_id, label FROM j WHERE k = 1""")
def pending_training_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each submission with its first label inside the time to live (hours here, as fixture events are sparse)."""
    df = events(spark, sf_dir)
    asked = df.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("asked_id"), F.col("ts").alias("asked_at"))
    labels = df.where("event_type in ('purchase', 'error')").select("user_id", F.col("event_id").alias("label_id"), F.col("event_type").alias("label"), F.col("ts").alias("labelled_at"))
    both = stateful.answered(asked, labels, "user_id", minutes=360)
    first = both.groupBy("user_id", "asked_id").agg(F.min_by(F.struct("label_id", "label"), F.struct("labelled_at", "label_id")).alias("l"))
    return first.select("user_id", "asked_id", "l.label_id", "l.label")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, k, event_id, [t] AS log, true AS allowed FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, e.event_id, CASE WHEN len(list_filter(f.log, lambda x: x > e.t - 86400)) < 3 THEN list_append(list_filter(f.log, lambda x: x > e.t - 86400), e.t) ELSE list_filter(f.log, lambda x: x > e.t - 86400) END, len(list_filter(f.log, lambda x: x > e.t - 86400)) < 3
  FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT event_id, user_id, allowed FROM f""")
def rate_limit_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stateful.rate_limited(events(spark, sf_dir).select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3, 86_400)
    return df.select("event_id", "user_id", "allowed")


@query("""SELECT event_id, user_id, count(*) OVER w AS recent_count, count(*) OVER w >= 6 AS frequent FROM (SELECT *, epoch(ts)::BIGINT AS t FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)) WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)""")
def sender_frequency_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.sender_frequency(events(spark, sf_dir).select("event_id", "user_id", "ts"), window_s=86_400).select("event_id", "user_id", "recent_count", "frequent")


@query("""SELECT doc_id, row_number() OVER (PARTITION BY source, sha256(lower(text)) ORDER BY doc_id) > 1 AS repeated FROM documents""")
def repeat_message_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.lower("text"), 256).alias("h"))
    return stateful.repeats(df, "source", "h", "doc_id").select("doc_id", "repeated")


@query("""WITH r AS (SELECT event_id, ts AS now_, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_, event_id % 4 AS items, user_id % 3 * 20000 AS every_s, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%H:%M') ELSE '23:00' END AS slot FROM events),
d AS (SELECT *, CASE WHEN event_id % 6 = 0 THEN strftime(now_, '%Y-%m-%dT') || slot END AS done FROM r)
SELECT event_id, items = 0 OR coalesce(every_s > 0 AND epoch(date_trunc('second', now_)) - epoch(date_trunc('second', last_)) >= every_s, false) OR (strftime(now_, '%H:%M') = slot AND coalesce(done, '') <> strftime(now_, '%Y-%m-%dT') || slot) AS due FROM d""")
def refresh_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a user's catalog is due at each of their events, if the event before was its last refresh."""
    df = read(spark, sf_dir, "events").withColumn("now_", F.col("ts").cast("timestamp"))
    df = df.withColumn("last_", F.lag("now_").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    slot = F.when(F.col("event_id") % 3 == 0, F.date_format("now_", "HH:mm")).otherwise("23:00")
    df = df.withColumn("slot", slot).withColumn("done", F.when(F.col("event_id") % 6 == 0, F.concat(F.date_format("now_", "yyyy-MM-dd"), F.lit("T"), F.col("slot"))))
    return df.select("event_id", stateful.refresh_due(F.col("now_"), F.col("last_"), F.col("event_id") % 4, F.col("user_id") % 3 * 20_000, F.col("slot"), F.col("done")).alias("due"))


@query("""SELECT 'events' AS name, count(*) AS n FROM events WHERE user_id % 5 <> 2 UNION ALL SELECT 'reviews', count(*) FROM events WHERE event_type = 'view' AND user_id % 5 <> 2 UNION ALL SELECT 'requests', count(*) FROM orders WHERE o_custkey % 5 <> 2""")
def erase_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stay in each table after group 2 is erased."""
    logged = read(spark, sf_dir, "events").withColumn("group_id", F.col("user_id") % 5)
    reviews = read(spark, sf_dir, "events").where("event_type = 'view'").select("event_id")
    asked = read(spark, sf_dir, "orders").withColumn("group_id", F.col("o_custkey") % 5)
    left = merging.erased({"moderation_events": logged, "pending_reviews": reviews, "requests": asked}, spark.createDataFrame([(2,)], "group_id long"))
    count = lambda name, df: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return count("events", left["moderation_events"]).unionByName(count("reviews", left["pending_reviews"])).unionByName(count("requests", left["requests"]))


@query("""SELECT user_id, max_by(event_type, (ts, event_id)) AS status, max(ts) AS since FROM events GROUP BY user_id""")
def status_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status after all changes of an append-only log."""
    log = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), F.col("ts").alias("since"), F.struct("ts", "event_id").alias("seq"))
    return merging.latest(log, ["user_id"], "seq").select("user_id", "status", "since")


@query("""WITH n AS (SELECT DISTINCT user_id AS c_custkey, 'seen' AS c_mktsegment FROM events WHERE event_type = 'signup')
SELECT c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_mktsegment ELSE c.c_mktsegment END AS segment FROM customer c FULL JOIN n USING (c_custkey)""")
def upsert_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    changes = read(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("c_custkey")).distinct().withColumn("c_mktsegment", F.lit("seen"))
    return merging.upserted(table, changes, ["c_custkey"]).withColumnRenamed("c_mktsegment", "segment")


@query("""WITH r AS (SELECT event_id, max_by(CASE WHEN value > 50 THEN 'spam' ELSE 'not_spam' END, event_id) AS verdict FROM events WHERE event_id % 3 = 0 GROUP BY 1), d AS (SELECT e.*, r.verdict FROM events e LEFT JOIN r USING (event_id))
SELECT user_id % 5 AS group_id, count(*) FILTER (verdict = 'spam') AS spam_examples, count(*) FILTER (verdict = 'not_spam') AS ham_examples, count(DISTINCT user_id) FILTER (verdict = 'spam') AS senders, round(max(greatest(value / 1000.0, 0.95)) FILTER (verdict = 'spam'), 6) AS risk FROM d GROUP BY 1""")
def review_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reviews add: examples by label, and raised violations, by group."""
    df = read(spark, sf_dir, "events")
    own = df.select("event_id", (F.col("user_id") % 5).alias("group_id"), "user_id", F.col("event_type").alias("text"), (F.col("value") / 1000.0).alias("final_score"))
    log = df.where("event_id % 3 = 0").select("event_id", F.when(F.col("value") > 50, "spam").otherwise("not_spam").alias("verdict"), F.col("event_id").alias("seq"))
    _, examples, bumps = merging.after_reviews(own, log)
    a = examples.groupBy("group_id").agg(F.count_if(F.col("label") == "spam").alias("spam_examples"), F.count_if(F.col("label") == "not_spam").alias("ham_examples"))
    b = bumps.groupBy("group_id").agg(F.count("*").alias("senders"), F.round(F.max("risk_score"), 6).alias("risk"))
    return a.join(b, "group_id", "left").withColumn("senders", F.coalesce("senders", F.lit(0)))


PICKED = f"([{', '.join(map(s, fixed.MODES))}])[(event_id % {len(fixed.MODES)} + 1)::BIGINT]"


@query(f"""WITH l AS (SELECT user_id, max_by({PICKED}, (ts, event_id)) AS mode FROM events GROUP BY user_id)
SELECT user_id, mode, mode IN ('auto_delete', 'silent', 'aggressive') AS auto_delete_enabled, mode = 'silent' AS silent_enabled FROM l""")
def mode_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows from the mode that each user set last."""
    picked = F.element_at(F.array(*map(F.lit, fixed.MODES)), (F.col("event_id") % len(fixed.MODES)).cast("int") + 1)
    log = read(spark, sf_dir, "events").select("user_id", picked.alias("mode"), F.struct("ts", "event_id").alias("seq"))
    return merging.latest(log, ["user_id"], "seq").select("user_id", scoring.mode_flags(F.col("mode")).alias("f")).select("user_id", "f.*")


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n, round(sum(value), 6) AS total FROM k GROUP BY user_id, sid""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stateful.sessions(events(spark, sf_dir), late=None)
    return df.withColumns({"started": F.col("started").cast("timestamp_ntz"), "ended": F.col("ended").cast("timestamp_ntz"), "total": F.round("total", 6)})


@query("""WITH RECURSIVE s AS (SELECT event_id, user_id, least(value, 100.0) / 100.0 AS base, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT event_id, user_id, k, 0.0::DOUBLE AS prior, base >= 0.88 AS hit, (base >= 0.88)::INT AS n, CASE WHEN base >= 0.88 THEN least(1.0, base) ELSE 0.0 END::DOUBLE AS risk FROM s WHERE k = 1
  UNION ALL SELECT event_id, user_id, k, prior, score >= 0.88, n + (score >= 0.88)::INT, CASE WHEN score >= 0.88 THEN greatest(risk, score) ELSE risk END FROM (SELECT *, least(1.0, base + 0.06 * prior) AS score
    FROM (SELECT s.event_id, s.user_id, s.k, s.base, f.n, f.risk, CASE WHEN f.n > 0 THEN least(0.20, f.n * 0.04 + f.risk * 0.12) ELSE 0.0 END::DOUBLE AS prior FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1)))
SELECT event_id, user_id, round(prior, 6) AS prior, hit FROM f""")
def violation_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations that raise a sender's later scores, folded in order."""
    df = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_id").alias("seq"), (F.least(F.col("value"), F.lit(100.0)) / 100.0).alias("base"))
    return stateful.violations_fold(df).select("event_id", "user_id", F.round("prior", 6).alias("prior"), "hit")


@query("""WITH c AS (SELECT click_id, min(client_id) AS client_id, min(ts) AS ts, min(kind) AS kind FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL AND kind IN ('view', 'click', 'buy', 'purchase', 'cart') GROUP BY click_id),
n AS (SELECT *, lead(click_id) OVER w AS next_id, lead(ts) OVER w AS next_at, lead(kind) OVER w AS next_kind FROM c WINDOW w AS (PARTITION BY client_id ORDER BY ts, click_id)),
o AS (SELECT *, CASE WHEN next_id IS NULL THEN 'waiting' WHEN next_kind = 'view' THEN 'replaced' WHEN next_at <= ts + INTERVAL 15 MINUTE THEN 'answered' ELSE 'expired' END AS outcome FROM n WHERE kind = 'view')
SELECT client_id, click_id AS asked_id, CASE WHEN outcome = 'answered' THEN next_id END AS answer_id, outcome FROM o""")
def pending_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as submissions, the client's next event of another kind as their answer: consumed once, within 15 minutes."""
    kinds = ["view", "click", "buy", "purchase", "cart"]
    rows = read(spark, sf_dir, "clicks").where(F.col("client_id").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin(kinds))
    once = rows.groupBy("click_id").agg(F.min("client_id").alias("client_id"), F.min("ts").alias("ts"), F.min("kind").alias("kind"))
    out = states.consumed(once, "client_id", "ts", "click_id", F.col("kind") == "view", F.col("kind") != "view")
    return out.select("client_id", "asked_id", "answer_id", "outcome")
