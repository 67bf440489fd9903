"""Queries of single operators: who may do what, what a message or a reply is made of, the best of some results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import access, parsing, scoring, settings, text, titles
from ..operators import lookups, merging
from ..sources.tables import read
from ..streaming import stateful
from . import fixtures
from .fixtures import values_sql
from .registry import query

ALLOWED, OWNERS = [3], [1, 5]
STATES = ["Administrator", "creator", "member", "left"]


@query(f"""WITH g AS (SELECT * FROM {values_sql(fixtures.GROUPS)} v(group_id, authorized, setup_completed, mode, ban_enabled, scan_admins)), e AS (SELECT event_id, user_id, user_id % 6 AS chat, event_id % 4 AS i FROM events),
a AS (SELECT e.*, chat IN (3) OR coalesce(g.authorized, false) AS authorized FROM e LEFT JOIN g ON g.group_id = e.chat)
SELECT event_id, authorized, authorized OR user_id IN (1, 5) AS may_set_up, user_id = event_id % 7 OR user_id IN (1, 5) OR i < 2 AS may_decide, i < 2 AS is_admin,
  CASE WHEN i >= 2 THEN 'I need to be promoted to group admin before moderation can work.' WHEN event_id % 3 = 0 AND event_id % 5 = 0 THEN 'Missing Telegram permissions: delete messages, ban/restrict users.' WHEN event_id % 3 = 0 THEN 'Missing Telegram permissions: delete messages.' WHEN event_id % 5 = 0 THEN 'Missing Telegram permissions: ban/restrict users.' END AS warning FROM a""")
def access_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event's chat is authorized, its user may set it up or decide a review, and what its bot lacks."""
    df = read(spark, sf_dir, "events").select("event_id", "user_id", (F.col("user_id") % 6).alias("group_id"))
    df = df.join(fixtures.groups(spark).select("group_id", "authorized"), "group_id", "left")
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("event_id") % len(STATES)).cast("int") + 1)
    df = df.withColumns({"ok": access.chat_authorized(F.col("authorized"), F.col("group_id"), ALLOWED), "is_admin": access.is_admin_state(state)})
    warning = access.rights_warning(F.col("is_admin"), can_delete=F.col("event_id") % 3 != 0, can_restrict=F.col("event_id") % 5 != 0)
    decide = access.callback_allowed(F.col("user_id"), F.col("event_id") % 7, F.col("is_admin"), OWNERS)
    return df.select("event_id", F.col("ok").alias("authorized"), access.setup_allowed(F.col("ok"), F.col("user_id"), OWNERS).alias("may_set_up"), decide.alias("may_decide"), "is_admin", warning.alias("warning"))


@query(f"""WITH m AS ({fixtures.MESSAGES_SQL} FROM events e JOIN {values_sql([(i, t, fixtures.NORMAL.get(i, t)) for i, t in enumerate(fixtures.TEMPLATES)])} t(id, template, normal) ON e.event_id % {len(fixtures.TEMPLATES)} = t.id) SELECT message_id, text, substr(text, 1, 60) AS excerpt, story FROM m""")
def message_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, caption and story line of each message, one a line, and an excerpt."""
    return fixtures.messages(spark, sf_dir).select("message_id", "text", text.excerpt(F.col("text"), 60).alias("excerpt"), "story")


@query("""WITH b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND value >= 100 GROUP BY user_id) SELECT event_id, round(CASE WHEN n IS NULL THEN 0.0 ELSE least(0.20, n * 0.04 + least(1.0, n * 0.25) * 0.12) END::DOUBLE, 6) AS violation_score FROM events LEFT JOIN b USING (user_id)""")
def violation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The violation score of each message's sender in its group, 0 without violations."""
    df = read(spark, sf_dir, "events").select("event_id", "user_id", (F.col("user_id") % 5).alias("group_id"))
    return lookups.with_violations(df, fixtures.violations(spark, sf_dir)).select("event_id", F.round("violation_score", 6).alias("violation_score"))


@query("""WITH a AS (SELECT p_brand, split_part(min(lower(p_name)), ' ', 1) AS q FROM part GROUP BY 1), r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY (lower(p_name) = q)::INT * 4 + starts_with(lower(p_name), q)::INT * 2 + (p_size % 2 = 0)::INT DESC, p_retailprice DESC, p_name DESC, p_partkey DESC) AS k FROM part JOIN a USING (p_brand))
SELECT p_brand, p_partkey AS best FROM r WHERE k = 1""")
def best_search_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each brand's parts the best result for the first word of its first name: by rank, price, name."""
    part = read(spark, sf_dir, "part")
    asked = part.groupBy("p_brand").agg(F.split_part(F.min(F.lower("p_name")), F.lit(" "), F.lit(1)).alias("q"))
    rank = parsing.result_rank(F.col("p_name"), F.col("q"), F.col("p_size") % 2 == 0)
    return part.join(asked, "p_brand").groupBy("p_brand").agg(parsing.best_result(rank, F.col("p_retailprice"), F.struct("p_name", "p_partkey"), F.col("p_partkey")).alias("best"))


@query("""WITH e AS (SELECT event_id, event_id % 7 AS id, (event_id % 100) / 100.0 AS sure, user_id % 5 AS n FROM events) SELECT event_id, CASE WHEN sure >= 0.74 AND id BETWEEN 1 AND n THEN id END AS candidate_id FROM e""")
def merge_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate that a model's answer names, if it is one and the answer is sure."""
    df = read(spark, sf_dir, "events")
    answer = F.concat(F.lit('Answer: {"candidate_id": '), (F.col("event_id") % 7).cast("string"), F.lit(', "confidence": '), ((F.col("event_id") % 100) / 100).cast("string"), F.lit(', "reason": "x"}'))
    candidates = F.filter(F.sequence(F.lit(0), F.col("user_id") % 5), lambda i: i > 0)
    return df.select("event_id", parsing.merge_choice(answer, candidates).alias("candidate_id"))


@query("""SELECT p_partkey, p_name || ' Season ' || (p_size % 4 + 1) || CASE WHEN p_partkey % 2 = 0 THEN ' Episode ' || (p_partkey % 9 + 1) ELSE '' END AS asked, 'https://shows.example/?search=' || replace(url_encode(p_name), '%20', '+') AS search, 'https://shows.example/show/' || replace(lower(p_name), ' ', '-') AS item,
  strftime(DATE '2024-01-01' + (p_partkey % 400)::INT, '%B %-d, %Y') AS day FROM part""")
def reply_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building blocks of replies: a title with its part, links, a date."""
    season, episode = F.col("p_size") % 4 + 1, F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 9 + 1)
    base = "https://shows.example/"
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 400).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", titles.with_part(F.col("p_name"), season, episode).alias("asked"), text.search_url(base, F.col("p_name")).alias("search"), text.item_url(F.lit(base), F.replace(F.lower("p_name"), F.lit(" "), F.lit("-"))).alias("item"), text.long_date(day).alias("day"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'spam' WHEN 1 THEN 'not_spam' ELSE 'suspicious' END AS label, (event_id % 100) / 100.0::DOUBLE AS confidence FROM events)
SELECT event_id, label, confidence, CASE WHEN label = 'spam' AND confidence >= 0.95 THEN 'delete' WHEN label = 'not_spam' THEN 'allow' ELSE 'ask_admin' END AS recommended_action, CASE WHEN label <> 'not_spam' THEN 'unknown' END AS lure, label <> 'not_spam' AS needs_review FROM e""")
def conservative_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for a classifier's answer where there is none."""
    label = F.element_at(F.array(F.lit("spam"), F.lit("not_spam"), F.lit("suspicious")), (F.col("event_id") % 3).cast("int") + 1)
    found = scoring.conservative_result(label, (F.col("event_id") % 100) / 100)
    return read(spark, sf_dir, "events").select("event_id", found.alias("f")).select("event_id", "f.*")


@query("""SELECT page_id % 5 AS group_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS domain, CASE WHEN page_id % 3 = 0 THEN 'blocked' ELSE 'allowed' END AS status FROM pages WHERE page_id % 5 = 2 ORDER BY domain, status, page_id LIMIT 50""")
def domains_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of one group, the first 50 by name: a page of a listing."""
    rules = read(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("group_id"), F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("domain"), F.when(F.col("page_id") % 3 == 0, "blocked").otherwise("allowed").alias("status"), "page_id")
    return rules.where("group_id = 2").orderBy("domain", "status", "page_id").limit(50).drop("page_id")


@query("SELECT o_orderkey AS group_id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def list_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups, the newest first."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("group_id"), F.col("o_orderdate").alias("created_at")).orderBy(F.desc("created_at"), "group_id")


@query("""WITH i AS (SELECT l_orderkey AS request_id, p_name AS title, p_size % 4 + 1 AS season FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1), a AS (SELECT p_name AS title, 1 + s AS season, s % 2 = 0 AS listed, arg_max(DATE '2025-07-01' + (p_partkey % 400)::INT, p_partkey) AS air_date FROM part CROSS JOIN range(3) v(s) GROUP BY ALL)
SELECT request_id, CASE WHEN a.title IS NULL THEN 'not_found' WHEN NOT listed THEN 'season_unconfirmed' WHEN air_date > DATE '2026-01-01' THEN 'future_season' ELSE 'aired_season' END AS state, coalesce(a.title IS NOT NULL AND (NOT listed OR air_date > DATE '2026-01-01'), false) AS waits FROM i LEFT JOIN a USING (title, season)""")
def availability_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with what is known of their title and season, and whether they wait for it."""
    part = read(spark, sf_dir, "part")
    asked = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey").select("request_id", F.col("p_name").alias("title"), (F.col("p_size") % 4 + 1).alias("season"))
    known = part.select(F.col("p_name").alias("title"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("s"), "p_partkey").groupBy("title", (F.col("s") + 1).alias("season"), (F.col("s") % 2 == 0).alias("season_exists")).agg(F.max("p_partkey").alias("p"))
    none = lambda kind: F.lit(None).cast(kind)
    known = known.select("title", "season", "season_exists", F.lit(True).alias("found"), F.lit("tv").alias("media_type"), F.date_add(F.lit("2025-07-01").cast("date"), (F.col("p") % 400).cast("int")).alias("season_air_date"))
    df = lookups.with_availability(asked, known, ["title", "season"]).withColumns({"episode": none("int"), "episode_exists": none("boolean"), "episode_air_date": none("date"), "release_date": none("date"), "first_air_date": none("date")})
    state = titles.availability_state(F.lit("2026-01-01").cast("date"))
    return df.withColumn("state", state).select("request_id", "state", titles.blocks_logging(F.lit("request"), none("string"), F.nullif("state", F.lit("not_found"))).alias("waits"))


FLAGS = [" TRUE ", "0", "Yes", "", None, "on", "n", "Y"]
ADDRESSES = ["postgres://ann:pw1@db.example:5432/bot", "postgresql://db.example/bot", "postgresql+psycopg://ann@db.example/bot", "sqlite:///x.db"]


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, f, u FROM events JOIN {values_sql(list(enumerate(FLAGS)))} v(i, f) ON event_id % {len(FLAGS)} = i JOIN {values_sql(list(enumerate(ADDRESSES)))} w(j, u) ON event_id % {len(ADDRESSES)} = j)
SELECT event_id, CASE WHEN f IS NULL THEN true ELSE lower(trim(f)) IN ('1', 'true', 'yes', 'y', 'on') END AS flag, CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS number, event_type || '|' || event_id % 2 AS words,
  array_to_string(list_sort(list_distinct([user_id, event_id % 4, user_id % 3])), '|') AS ids, CASE WHEN u[:8] = 'postgres' THEN 'jdbc:postgresql://' || regexp_extract(u, '(db[.].*)$', 1) ELSE u END AS url, CASE WHEN contains(u, 'ann') THEN 'ann' END AS db_user, CASE WHEN contains(u, 'pw1') THEN 'pw1' END AS db_password FROM e""")
def settings_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of each event's service, given as text."""
    one_of = lambda texts: F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % len(texts)).cast("int") + 1)
    user, event = F.col("user_id").cast("string"), lambda n: (F.col("event_id") % n).cast("string")
    given = settings.number(F.when(F.col("event_id") % 3 == 0, "").otherwise(user), F.lit(7))
    names = settings.words(F.concat(F.lit(" "), F.col("event_type"), F.lit(" ;, "), event(2), F.lit(",")))
    ids = settings.ids(F.concat(user, F.lit(" ; "), event(4), F.lit(",,"), (F.col("user_id") % 3).cast("string")))
    df = read(spark, sf_dir, "events").select("event_id", settings.flag(one_of(FLAGS), True).alias("flag"), given.alias("number"), F.array_join(names, "|").alias("words"), F.array_join(ids.cast("array<string>"), "|").alias("ids"), settings.database(one_of(ADDRESSES)).alias("d"))
    return df.select("event_id", "flag", "number", "words", "ids", "d.url", F.col("d.user").alias("db_user"), F.col("d.password").alias("db_password"))


@query("""WITH RECURSIVE c AS (SELECT event_id, epoch_us(ts) AS t, 'https://api.example/3/search?' || CASE WHEN user_id % 2 = 0 THEN 'page=' || user_id % 5 || '&' ELSE '' END || 'query=' || replace(url_encode(event_type || '/a b&c~*' || user_id % 7), '%2F', '/') AS key FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, event_id) AS k FROM c),
f AS (SELECT key, k, event_id, t AS since, true AS fetched FROM e WHERE k = 1 UNION ALL SELECT e.key, e.k, e.event_id, CASE WHEN e.t >= f.since + 21600000000 THEN e.t ELSE f.since END, e.t >= f.since + 21600000000 FROM f JOIN e ON e.key = f.key AND e.k = f.k + 1)
SELECT event_id, key, since AS fetched_us, fetched FROM f""")
def response_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to a metadata service, and which are answered by what was fetched up to six hours before."""
    query_ = F.concat("event_type", F.lit("/a b&c~*"), (F.col("user_id") % 7).cast("string"))
    params = F.create_map(F.lit("query"), query_, F.lit("year"), F.lit(None).cast("string"), F.lit("page"), F.when(F.col("user_id") % 2 == 0, (F.col("user_id") % 5).cast("string")), F.lit("lang"), F.lit(""))
    calls = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), parsing.request_key("https://api.example/3/", F.lit("/search"), params).alias("key"))
    return stateful.cached(calls, "key", "ts", "event_id", 21_600).select("event_id", "key", F.unix_micros("fetched_at").alias("fetched_us"), "fetched")


#: Tables that name groups: (name, input table, column whose remainder by 5 is the group).
SCOPED = [("support_issues", "lineitem", "l_suppkey"), ("support_requests", "orders", "o_custkey"), ("moderation_events", "events", "user_id"), ("training_examples", "part", "p_partkey"), ("trusted_users", "customer", "c_custkey"), ("domains", "pages", "page_id"), ("admin_bindings", "supplier", "s_suppkey")]


@query(" UNION ALL ".join([f"SELECT '{name}' AS name, count(*) AS n FROM {source} WHERE {'p_size > 25 OR ' if source == 'part' else ''}{column} % 5 <> 2" for name, source, column in SCOPED])
       + """ UNION ALL SELECT 'pending_reviews', count(*) FROM events WHERE event_type = 'view' AND user_id % 5 <> 2 UNION ALL SELECT 'bot_sent_messages', count(*) FROM events WHERE event_type = 'click' AND user_id % 5 <> 2
UNION ALL SELECT 'user_violations', count(DISTINCT user_id) FROM events WHERE event_type = 'error' AND value >= 100 AND user_id % 5 <> 2 UNION ALL SELECT 'group_settings', 4 UNION ALL SELECT 'groups', 4""")
def erase_group_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stay in each of the twelve tables after group 2 is erased; examples without a group stay."""
    tables = {name: read(spark, sf_dir, source).withColumn("group_id", F.col(column) % 5) for name, source, column in SCOPED}
    tables["training_examples"] = tables["training_examples"].withColumn("group_id", F.when(F.col("p_size") <= 25, F.col("group_id")))
    events, groups = read(spark, sf_dir, "events"), fixtures.groups(spark).withColumn("chat_id", -1000 - F.col("group_id"))
    tables |= {"pending_reviews": events.where("event_type = 'view'").select("event_id"), "bot_sent_messages": events.where("event_type = 'click'").select("event_id", (-1000 - F.col("user_id") % 5).alias("chat_id")), "user_violations": fixtures.violations(spark, sf_dir), "group_settings": groups.select("group_id", "mode"), "groups": groups}
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in merging.erased(tables, groups.where("group_id = 2")).items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out
