"""The moderation dataflow and its queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, fixed, scoring, text
from ..operators import feedback, lookups, retrieval
from ..sources.tables import read
from ..streaming import stateful
from . import fixtures
from .fixtures import quoted, values_sql
from .registry import query

TRUSTED, ADMIN = 17, 23  # users whose id is divisible by these are trusted, or admins, in the fixtures


def decided(df: DataFrame, demo: bool = False) -> DataFrame:
    """From features to a decision: one chain of columns, no shuffle."""
    return scoring.with_decision(scoring.with_final_score(scoring.with_rules_label(scoring.with_rule_score(features.with_features(df)))), demo)


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture messages with text columns, group, trust and host rules."""
    df = features.with_text(fixtures.messages(spark, sf_dir), full=True)
    trusted = read(spark, sf_dir, "customer").where(F.col("c_custkey") % TRUSTED == 0).select(F.col("c_custkey").alias("user_id"))
    df = lookups.with_trust(lookups.with_group(df, fixtures.groups(spark)), trusted, ["user_id"])
    return lookups.with_host_rules(df.withColumn("is_admin", F.col("user_id") % ADMIN == 0), fixtures.rules(spark))


def followed(df: DataFrame) -> DataFrame:
    """With what came before each message: its sender's rate, the same text in its group."""
    df = stateful.sender_frequency(df, window_s=86_400)
    return stateful.repeats(df.withColumn("hash_", text.text_hash(F.col("norm"))), "group_id", "hash_", "message_id").drop("hash_", "frequent")


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with all that is known: placed(), followed() and violations from a finished table."""
    return followed(lookups.with_violations(placed(spark, sf_dir), fixtures.violations(spark, sf_dir)))


def compared(spark: SparkSession, df: DataFrame) -> DataFrame:
    """With similarities to the examples of each message's group."""
    takers = fixtures.groups(spark).select("group_id", F.lit(True).alias("global_enabled"))
    return retrieval.with_similarities(df, retrieval.newest(lookups.in_scope(fixtures.examples(spark), takers)), "norm")


# SQL counterparts of the column chains.
ZW = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}]"
s = quoted


def found(column: str, patterns: list[str], flags: str = "") -> str:
    return f"regexp_matches({column}, {s(flags + '|'.join(f'(?:{p})' for p in patterns))})"


def contains(column: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {s(p)})" for p in phrases) + ")"


def count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {s(pattern)}))"


def unique(values: str) -> str:
    return f"list_filter({values}, lambda x, i: x <> '' AND list_position(list_transform({values}, lambda y: lower(y)), lower(x)) = i)"


CHAT = "(contains(lower(u), 't.me/') OR contains(lower(u), 'telegram.me/'))"
TEXT_SQL = f"""
m AS ({fixtures.MESSAGES_SQL} FROM events e JOIN {values_sql([(i, t, fixtures.NORMAL.get(i, t)) for i, t in enumerate(fixtures.TEMPLATES)])} t(id, template, normal) ON e.event_id % {len(fixtures.TEMPLATES)} = t.id),
m1 AS (SELECT *, trim(regexp_replace(regexp_replace(normal, '{ZW}', '', 'g'), '\\s+', ' ', 'g')) AS norm, {count('text', ZW)} AS zero_widths,
       {count('text', '[' + chr(92) + 'p{M}' + chr(92) + 'p{S}]')} - {count('text', '[$+<=>^`|~]')} + {count('text', '[' + chr(92) + 'p{Cf}' + chr(92) + 'p{Co}]')} AS odd FROM m),
m2 AS (SELECT *, list_concat(list_transform(regexp_extract_all(norm, {s('(?i)' + fixed.URL)}, 1), lambda u: regexp_replace(u, {s(fixed.AFTER_LINK)}, '')), CASE WHEN marked THEN [trim(substr(norm, 1, 9))] ELSE [] END, behind) AS urls0,
       list_transform(regexp_extract_all(norm, {s('(?i)' + fixed.CHAT_LINK)}, 1), lambda u: regexp_replace(u, {s(fixed.AFTER_LINK)}, '')) AS links0,
       regexp_replace(translate(lower(norm), {s(fixed.LEET_FROM)}, {s(fixed.LEET_TO)}), '[^a-z0-9+]+', ' ', 'g') AS deob FROM m1),
m3 AS (SELECT *, {unique('urls0')} AS urls, replace(deob, ' ', '') AS compact FROM m2),
m4 AS (SELECT *, list_concat(links0, list_filter(urls, lambda u: {CHAT})) AS links1,
       list_transform(urls, lambda u: regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace(u, '(?i)^[a-z][a-z0-9+.-]*://', ''), '^([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '^www\\.', ''), '\\.+$', '')) AS hosts0 FROM m3),
m5 AS (SELECT *, {unique('links1')} AS links, list_filter(hosts0, lambda h, i: h <> '' AND list_position(hosts0, h) = i) AS hosts FROM m4)"""

KNOWN_SQL = f"""{TEXT_SQL},
viol AS (SELECT user_id, least(0.20::DOUBLE, count(*) * 0.04::DOUBLE + least(1.0::DOUBLE, count(*) * 0.25::DOUBLE) * 0.12::DOUBLE) AS score FROM events WHERE event_type = 'error' AND value >= 100 GROUP BY user_id),
past AS (SELECT message_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) >= 6 AS frequent, row_number() OVER (PARTITION BY group_id, sha256(lower(norm)) ORDER BY message_id) > 1 AS repeated FROM m5),
groups_ AS (SELECT * FROM {values_sql(fixtures.GROUPS)} g(group_id, authorized, setup_completed, mode, ban_enabled, scan_admins)),
rules_ AS (SELECT group_id, coalesce(list(domain) FILTER (status = 'blocked'), []) AS b, coalesce(list(domain) FILTER (status = 'allowed'), []) AS a FROM {values_sql(fixtures.RULES)} r(group_id, domain, status) GROUP BY group_id),
m6 AS (SELECT m5.*, past.frequent, past.repeated, coalesce(viol.score, 0.0::DOUBLE) AS violation_score, g.* EXCLUDE (group_id), user_id % {ADMIN} = 0 AS admin, c.c_custkey IS NOT NULL AS trusted,
       list_filter(hosts, lambda h: list_contains(coalesce(r.b, []), h)) AS blocked_hosts, list_filter(hosts, lambda h: list_contains(coalesce(r.a, []), h)) AS allowed_hosts
       FROM m5 JOIN past USING (message_id) LEFT JOIN viol USING (user_id) JOIN groups_ g USING (group_id) LEFT JOIN rules_ r USING (group_id)
       LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % {TRUSTED} = 0) c ON c.c_custkey = m5.user_id)"""

FEATURES_SQL = f"""{KNOWN_SQL},
f1 AS (SELECT *, len(urls) > 0 AS has_url, len(list_filter(links, lambda u: {CHAT})) > 0 AS chat_link,
  len(list_filter(links, lambda u: {found('u', [fixed.BOT_LINK], '(?i)')} AND {found('u', [fixed.BOT_START], '(?i)')})) > 0 AS bot_start,
  len(list_filter(links, lambda u: {found('u', [fixed.INVITE_LINK], '(?i)')})) > 0 AS invite,
  len(list_filter(hosts, lambda h: h IN ({', '.join(map(s, fixed.SHORTENERS))}))) > 0 AS shortener,
  {found('deob', fixed.PORN_PATTERNS)} OR {contains('compact', fixed.PORN_TERMS)} AS porn_words,
  {found('deob', fixed.ADULT_PATTERNS)} OR {contains('compact', fixed.ADULT_TERMS)} AS adult_words,
  {' + '.join(count('deob', p) for p in fixed.CALL_PATTERNS)} AS calls,
  {found('deob', fixed.URGENCY_PATTERNS)} OR {contains('compact', fixed.URGENCY_TERMS)} AS urgency,
  {contains('deob', fixed.CRYPTO_PHRASES)} AS crypto, {contains('deob', fixed.REWARD_PHRASES)} AS reward, {contains('deob', fixed.LOGIN_PHRASES)} AS login,
  {count('norm', fixed.EMOJI)} >= 10 AS many_emojis, odd > 0 OR {found('lower(norm)', [fixed.OBFUSCATED])} AS obfuscated, zero_widths > 0 AS zero_width,
  {count('norm', fixed.MENTION)} >= 5 AS mentions, {found('deob', [fixed.PROMOTION])} AS promotion,
  violation_score > 0 AS violations, len(blocked_hosts) > 0 AS domain_blocked,
  len(hosts) > 0 AND len(list_filter(hosts, lambda h: NOT (h IN ({', '.join(map(s, fixed.SAFE_HOSTS))}) OR list_contains(allowed_hosts, h)))) = 0 AS domain_allowed FROM m6),
f2 AS (SELECT *, adult_words AND (calls > 0 OR bot_start) AS adult_call FROM f1),
f3 AS (SELECT *, adult_words AND (adult_call OR urgency OR bot_start OR porn_words OR story) AS adult_story FROM f2),
f4 AS (SELECT *, porn_words OR adult_story AS porn_bait FROM f3),
f5 AS (SELECT *, domain_blocked OR bot_start OR invite OR (story AND adult_story) OR (len(hosts) > 0 AND (porn_bait OR adult_call OR urgency OR adult_story OR crypto OR reward OR login OR shortener)) AS high_risk,
  {' + '.join(f'{x}::INT' for x in fixed.SIGNALS)} AS signals FROM f4)"""

TOLD = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> '')"
LONG = "list_filter({0}, lambda w: length(w) > 2)"
TIMES = "len(list_filter({0}, lambda w: w = t))"
SIMILAR_SQL = f"""ex AS (SELECT label, {TOLD.format('t')} AS w, row_number() OVER (PARTITION BY label ORDER BY i DESC) AS age FROM {values_sql([(i, 'spam' if i in fixtures.SPAM_EXAMPLES else 'not_spam', fixtures.TEMPLATES[i]) for i in sorted(fixtures.SPAM_EXAMPLES + fixtures.GOOD_EXAMPLES)])} v(i, label, t)),
mw AS (SELECT message_id, {TOLD.format('norm')} AS w FROM m5),
near AS (SELECT mw.message_id, ex.label, {LONG.format('mw.w')} AS a, {LONG.format('ex.w')} AS b, row_number() OVER (PARTITION BY mw.message_id, ex.label ORDER BY len(list_intersect(list_distinct(list_filter(mw.w, lambda w: length(w) > 3)), list_distinct(ex.w))) DESC, age) AS rank FROM mw CROSS JOIN ex),
sim AS (SELECT message_id, max(CASE WHEN label = 'spam' THEN c END) AS spam_similarity, max(CASE WHEN label = 'not_spam' THEN c END) AS ham_similarity FROM (SELECT message_id, label,
  coalesce(list_sum(list_transform(list_distinct(a), lambda t: {TIMES.format('a')} * {TIMES.format('b')})) / nullif(sqrt(list_sum(list_transform(list_distinct(a), lambda t: {TIMES.format('a')} ** 2))) * sqrt(list_sum(list_transform(list_distinct(b), lambda t: {TIMES.format('b')} ** 2))), 0), 0.0) AS c FROM near WHERE rank <= 4) GROUP BY message_id)"""
EXTREME = f"len(list_filter(links, lambda u: {CHAT} AND (contains(lower(u), 'start=') OR contains(lower(u), 'startapp=') OR contains(lower(u), 'joinchat/')))) > 0"
SKIP = f"norm = '' OR (admin AND NOT scan_admins) OR (trusted AND NOT ({EXTREME}))"

PAIRS = [(n, r) for n, _, r in fixed.RULE_WEIGHTS] + [("has_url AND signals = 1", "contains URL"), ("adult_story AND (bot_start OR chat_link OR has_url)", "adult clickbait with Telegram/link call-to-action"), ("adult_story AND porn_bait", "explicit adult clickbait story"), ("raised", "high-risk link pattern")]
REASONS = lambda pairs: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {s(r)} END" for c, r in pairs) + "], lambda x: x IS NOT NULL)"
SCORE_SQL = f"""{FEATURES_SQL},
{SIMILAR_SQL},
r1 AS (SELECT *, 0.0::DOUBLE {' '.join(f'+ CASE WHEN {n} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END' for n, w, _ in fixed.RULE_WEIGHTS)}
  + CASE WHEN has_url AND signals = 1 THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN domain_allowed THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN admin THEN 0.30::DOUBLE ELSE 0.0::DOUBLE END
  - CASE WHEN trusted AND NOT high_risk THEN 0.55::DOUBLE WHEN trusted THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END AS w0 FROM f5),
r2 AS (SELECT *, CASE WHEN adult_story THEN greatest(w0, 0.96::DOUBLE) ELSE w0 END AS w1 FROM r1),
r3 AS (SELECT *, high_risk AND w1 < 0.72::DOUBLE AS raised FROM r2),
r4 AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN raised THEN 0.72::DOUBLE ELSE w1 END)) AS rule_score, {REASONS(PAIRS)} AS rule_reasons FROM r3),
l1 AS (SELECT *, CASE WHEN domain_blocked THEN greatest(rule_score, 0.97::DOUBLE) ELSE rule_score END AS sc FROM r4),
l2 AS (SELECT *, CASE WHEN sc >= 0.96::DOUBLE AND (high_risk OR (adult_story AND (adult_call OR porn_bait)) OR crypto OR reward OR login) THEN 'spam' WHEN sc >= 0.72::DOUBLE THEN 'suspicious' WHEN sc <= 0.20::DOUBLE THEN 'not_spam' ELSE 'suspicious' END AS label FROM l1),
l3 AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN label = 'not_spam' THEN 1.0::DOUBLE - sc ELSE sc END)) AS confidence,
  CASE WHEN label <> 'not_spam' THEN coalesce({', '.join(f'CASE WHEN {n} THEN {s(k)} END' for n, k, _ in reversed(fixed.LURES) if k)}, 'unknown') END AS lure FROM l2),
b1 AS (SELECT *, rule_score * 0.42::DOUBLE + (CASE label WHEN 'not_spam' THEN 1.0::DOUBLE - confidence WHEN 'suspicious' THEN confidence * 0.78::DOUBLE ELSE confidence END) * 0.40::DOUBLE
  + spam_similarity * 0.12::DOUBLE + violation_score * 0.06::DOUBLE - ham_similarity * 0.22::DOUBLE AS x0 FROM l3 JOIN sim USING (message_id)),
b2 AS (SELECT *, greatest(x0, CASE WHEN domain_blocked THEN 0.94::DOUBLE END, CASE WHEN high_risk AND label = 'spam' THEN least(1.0::DOUBLE, confidence + 0.04::DOUBLE) END,
  CASE WHEN adult_story AND adult_call AND label = 'spam' THEN 0.90::DOUBLE END, CASE WHEN adult_story AND porn_bait THEN 0.91::DOUBLE END) AS x1 FROM b1),
b3 AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, x1, CASE WHEN trusted AND NOT high_risk THEN 0.42::DOUBLE END, CASE WHEN admin THEN 0.45::DOUBLE END)) AS final_score FROM b2)"""


def action_sql(mode: str = "mode", setup: str = "setup_completed", ban: str = "ban_enabled") -> str:
    return f"""CASE WHEN NOT {setup} THEN 'monitor_setup_required' WHEN {mode} = 'monitor_only' THEN 'monitor'
  WHEN final_score >= 0.96::DOUBLE AND high_risk AND {ban} AND label = 'spam' THEN 'delete_and_ban'
  WHEN final_score >= 0.88::DOUBLE AND (label IN ('spam', 'suspicious') OR (adult_story AND porn_bait)) THEN 'delete'
  WHEN {mode} = 'aggressive' AND final_score >= 0.87::DOUBLE THEN 'delete_pending_review'
  WHEN final_score >= 0.55::DOUBLE THEN 'ask_admin' ELSE 'allow' END"""


def swapped(sql: str, *changes: tuple[str, str]) -> str:
    for old, new in changes:
        if old not in sql:
            raise ValueError(f"not in the SQL: {old}")
        sql = sql.replace(old, new)
    return sql


#: The same with each message twice, for a sender without violations and with some; the fold takes one of the two.
BOTH_SQL = swapped(SCORE_SQL, ("coalesce(viol.score, 0.0::DOUBLE) AS violation_score", "z.prior, viol.n AS stored_n, viol.risk AS stored_risk"), ("FROM m5 JOIN past", "FROM m5 CROSS JOIN (VALUES (false), (true)) z(prior) JOIN past"),
    ("least(0.20::DOUBLE, count(*) * 0.04::DOUBLE + least(1.0::DOUBLE, count(*) * 0.25::DOUBLE) * 0.12::DOUBLE) AS score", "count(*) AS n, least(1.0::DOUBLE, count(*) * 0.25::DOUBLE) AS risk"),
    ("violation_score > 0 AS violations", "prior AS violations"), (" + violation_score * 0.06::DOUBLE - ham_similarity * 0.22::DOUBLE AS x0", " AS before, ham_similarity * 0.22::DOUBLE AS less"),
    ("greatest(x0, CASE", "greatest(CASE"), ("END) AS x1 FROM b1", "END) AS floor_ FROM b1"), ("greatest(0.0::DOUBLE, least(1.0::DOUBLE, x1, CASE WHEN trusted AND NOT high_risk THEN 0.42::DOUBLE END, CASE WHEN admin THEN 0.45::DOUBLE END)) AS final_score", "least(CASE WHEN trusted AND NOT high_risk THEN 0.42::DOUBLE END, CASE WHEN admin THEN 0.45::DOUBLE END) AS cap FROM b2), o AS (SELECT *, row_number() OVER (PARTITION BY user_id, prior ORDER BY message_id) AS k"))
NEXT = "least(0.20::DOUBLE, n * 0.04::DOUBLE + risk * 0.12::DOUBLE)"
FOLD_SQL = f"""{BOTH_SQL.rpartition(" FROM b2)")[0]} FROM b3),
s0 AS (SELECT DISTINCT user_id, coalesce(stored_n, 0) AS n, coalesce(stored_risk, 0.0::DOUBLE) AS risk FROM o),
fold AS (SELECT user_id, 0::BIGINT AS k, n, risk, CASE WHEN n > 0 THEN {NEXT} ELSE 0.0::DOUBLE END AS v, 0.0::DOUBLE AS seen FROM s0
  UNION ALL SELECT user_id, k, n_, risk_, CASE WHEN n_ > 0 THEN least(0.20::DOUBLE, n_ * 0.04::DOUBLE + risk_ * 0.12::DOUBLE) ELSE 0.0::DOUBLE END, v FROM (
    SELECT user_id, k, v, n + hit::INT AS n_, CASE WHEN hit THEN greatest(risk, final_score) ELSE risk END AS risk_ FROM (
      SELECT *, NOT skip AND {action_sql()} IN ('delete', 'delete_and_ban', 'delete_pending_review') AS hit FROM (
        SELECT o.*, {SKIP} AS skip, n, risk, v, greatest(0.0::DOUBLE, least(1.0::DOUBLE, cap, greatest(before + v * 0.06::DOUBLE - less, floor_))) AS final_score FROM fold JOIN o ON o.user_id = fold.user_id AND o.k = fold.k + 1 AND o.prior = (v > 0))))),
b4 AS (SELECT o.*, seen AS violation_score, greatest(0.0::DOUBLE, least(1.0::DOUBLE, cap, greatest(before + seen * 0.06::DOUBLE - less, floor_))) AS final_score FROM fold JOIN o ON o.user_id = fold.user_id AND o.k = fold.k AND o.prior = (seen > 0))"""


@query(f"""WITH RECURSIVE {FOLD_SQL}, d AS (SELECT *, {action_sql()} AS action, {SKIP} AS skip FROM b4)
SELECT message_id, user_id, group_id, CASE WHEN skip THEN 'skipped' ELSE 'scored' END AS status, CASE WHEN NOT skip THEN round(rule_score, 6) END AS rule_score, CASE WHEN NOT skip THEN label END AS label, CASE WHEN NOT skip THEN round(confidence, 6) END AS confidence, CASE WHEN NOT skip THEN lure END AS lure,
  CASE WHEN NOT skip THEN round(spam_similarity, 6) END AS spam_similarity, CASE WHEN NOT skip THEN round(ham_similarity, 6) END AS ham_similarity, CASE WHEN NOT skip THEN round(violation_score, 6) END AS violation_score, CASE WHEN NOT skip THEN round(final_score, 6) END AS final_score, CASE WHEN NOT skip THEN action END AS action,
  CASE WHEN NOT skip THEN mode <> 'silent' AND action <> 'allow' AND (action <> 'monitor' OR final_score >= 0.55::DOUBLE) END AS notify, CASE WHEN NOT skip THEN array_to_string(rule_reasons, '; ') END AS reasons FROM d""")
def moderation_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every message assembled, joined with what is known, skipped or scored, compared with examples, labelled and
    decided under its group's settings, in order: a deleted message raises its sender's next scores."""
    out = in_order(spark, sf_dir)
    r = lambda c: F.when(~F.col("skip"), F.round(c, 6)).alias(c)
    own = lambda c, value=None: F.when(~F.col("skip"), F.col(c) if value is None else value).alias(c)
    return out.select("message_id", "user_id", "group_id", F.when(F.col("skip"), "skipped").otherwise("scored").alias("status"), r("rule_score"), own("label"), r("confidence"), own("lure"), r("spam_similarity"), r("ham_similarity"), r("violation_score"), r("final_score"), own("action"), own("notify"), own("reasons", F.concat_ws("; ", "rule_reasons")))


#: What the fold and the decision need of a message.
CARRIED = ["message_id", "user_id", "group_id", "skip", "mode", "setup_completed", "ban_enabled", "high_risk", "adult_story", "porn_bait", "spam_similarity", "ham_similarity", "violation_count", "risk_score", "first", "again"]


def in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages with their outcome, final score and decision, each after those of its sender before it."""
    df = lookups.with_stored_violations(placed(spark, sf_dir), fixtures.violations(spark, sf_dir))
    df = features.with_features(followed(df)).withColumn("skip", features.skipped(F.col("scan_admins")))
    df = feedback.with_outcomes(compared(spark, df)).select(CARRIED)
    df = feedback.with_violations_so_far(df.withColumn("judged", ~F.col("skip")), ["group_id", "user_id"], ["message_id"], "judged")
    return scoring.with_decision(feedback.with_final_outcome(df))


@query(f"WITH {FEATURES_SQL} " + " UNION ALL ".join(f"SELECT {s(x)} AS feature, count(*) FILTER ({x}) AS n FROM f5" for x in fixed.SIGNALS))
def rule_feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.with_features(known(spark, sf_dir))
    sums = df.agg(*(F.count_if(x).alias(x) for x in fixed.SIGNALS))
    return sums.unpivot([], fixed.SIGNALS, "feature", "n")


@query(f"WITH {SCORE_SQL} SELECT reason, count(*) AS n FROM (SELECT unnest(rule_reasons) AS reason FROM b3) GROUP BY reason")
def rule_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scoring.with_rule_score(features.with_features(known(spark, sf_dir)))
    return df.select(F.explode_outer("rule_reasons").alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {SCORE_SQL}, modes AS (SELECT unnest([{', '.join(map(s, fixed.MODES))}]) AS mode_), d AS (SELECT mode_, {action_sql('mode_', 'true', 'true')} AS action FROM b3 CROSS JOIN modes)
SELECT mode_ AS mode, action, count(*) AS n FROM d GROUP BY ALL""")
def action_mix_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions under each mode; scores are taken once and exploded by mode."""
    df = scoring.with_final_score(scoring.with_rules_label(scoring.with_rule_score(compared(spark, features.with_features(known(spark, sf_dir))))))
    df = df.select("final_score", "high_risk", "label", "adult_story", "porn_bait", F.explode(F.array(*map(F.lit, fixed.MODES))).alias("mode"), F.lit(True).alias("ban_enabled"), F.lit(True).alias("setup_completed"))
    return scoring.with_decision(df).groupBy("mode", "action").agg(F.count("*").alias("n"))


@query(f"""WITH {SCORE_SQL}, p AS (SELECT message_id, greatest(rule_score, CASE WHEN {found('norm', [fixed.ABUSE], '(?i)')} THEN 0.72::DOUBLE END, CASE WHEN {found('norm', [fixed.INAPPROPRIATE], '(?i)')} THEN 0.78::DOUBLE END,
  CASE WHEN {found('norm', [fixed.MALICIOUS], '(?is)')} THEN 0.88::DOUBLE END, CASE WHEN has_media AND norm = '' THEN 0.58::DOUBLE END, CASE WHEN high_risk OR adult_call OR adult_story OR crypto OR reward OR login THEN 0.92::DOUBLE END) AS x0, {found('norm', [fixed.MALICIOUS], '(?is)')} AS malicious, has_media AND norm = '' AS media, violation_score FROM b3),
v AS (SELECT *, CASE WHEN violation_score >= 0.12::DOUBLE AND x0 >= 0.50::DOUBLE THEN greatest(x0, 0.72::DOUBLE) ELSE x0 END AS x FROM p)
SELECT message_id, round(x, 6) AS safety_score, CASE WHEN x < 0.55::DOUBLE THEN 'allow' WHEN media THEN 'private_media_rejected' WHEN malicious THEN 'private_malicious_code_ignored' WHEN x >= 0.90::DOUBLE THEN 'private_spam_ignored' ELSE 'private_abuse_warned' END AS safety_action FROM v""")
def private_safety_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scoring.with_private_safety(scoring.with_rule_score(features.with_features(known(spark, sf_dir))))
    return df.select("message_id", F.round("safety_score", 6).alias("safety_score"), F.coalesce("safety_action", F.lit("allow")).alias("safety_action"))


@query(f"""WITH {FEATURES_SQL} SELECT group_id, {SKIP} AS skip,
  CASE WHEN NOT has_url THEN porn_bait OR adult_call OR adult_story OR crypto OR reward OR login ELSE signals > 0 END AS classify, count(*) AS n FROM f5 GROUP BY ALL""")
def ai_gate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many messages of each group are skipped, and how many go to a classifier."""
    df = features.with_features(known(spark, sf_dir))
    return df.groupBy("group_id", features.skipped(F.col("scan_admins")).alias("skip"), features.needs_classifier(F.lit(False), F.lit(True)).alias("classify")).agg(F.count("*").alias("n"))


@query(f"""WITH {KNOWN_SQL} SELECT message_id, user_id, group_id, trusted AS is_trusted, mode, len(hosts) AS n_hosts, array_to_string(list_sort(blocked_hosts), ',') AS blocked, array_to_string(list_sort(allowed_hosts), ',') AS allowed FROM m6""")
def message_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What joins give each message: group, trust, rules on its hosts."""
    none = F.array().cast("array<string>")
    names = lambda c: F.concat_ws(",", F.array_sort(F.coalesce(F.col(c), none)))
    return placed(spark, sf_dir).select("message_id", "user_id", "group_id", "is_trusted", "mode", F.size("hosts").cast("long").alias("n_hosts"), names("blocked_hosts").alias("blocked"), names("allowed_hosts").alias("allowed"))


@query("""WITH h AS (SELECT sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS text_hash, doc_id FROM documents)
SELECT text_hash, count(*) AS n, min(doc_id) AS first_id FROM h GROUP BY text_hash HAVING count(*) > 1""")
def text_hash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").select("doc_id", text.text_hash(text.squeezed(F.col("text"))).alias("text_hash"))
    return df.groupBy("text_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


HOST_SQL = lambda u: f"regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace({u}, '(?i)^[a-z][a-z0-9+.-]*://', ''), '^([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '^www\\.', ''), '\\.+$', '')"


@query(f"SELECT {HOST_SQL('url')} AS host, count(*) AS n, count(*) FILTER (url LIKE 'https:%') AS secure FROM pages GROUP BY 1")
def url_domain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "pages").select(text.host(F.col("url")).alias("host"), F.col("url").startswith("https:").alias("s"))
    return df.groupBy("host").agg(F.count("*").alias("n"), F.count_if("s").alias("secure"))


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']+)["'']', 1)) AS href FROM pages)
SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages FROM h GROUP BY href""")
def href_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found_ = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    return read(spark, sf_dir, "pages").select("page_id", F.explode(found_).alias("href")).groupBy("href").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


ODD_SQL = f"({count('text', '[' + chr(92) + 'p{M}' + chr(92) + 'p{S}]')} - {count('text', '[$+<=>^`|~]')} + {count('text', '[' + chr(92) + 'p{Cf}' + chr(92) + 'p{Co}]')})"


@query(f"""SELECT doc_id, {ODD_SQL}::INT AS odd, {found('lower(text)', [fixed.OBFUSCATED])} AS spaced, {count('text', fixed.EMOJI)}::INT AS emojis FROM documents""")
def obfuscation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", text.odd_characters(t).alias("odd"), F.lower(t).rlike(fixed.OBFUSCATED).alias("spaced"), F.regexp_count(t, F.lit(fixed.EMOJI)).alias("emojis"))


@query(f"""WITH w AS (SELECT unnest(string_split(trim(regexp_replace(translate(lower(text), {s(fixed.LEET_FROM)}, {s(fixed.LEET_TO)}), '[^a-z0-9+]+', ' ', 'g')), ' ')) AS word FROM documents)
SELECT word, count(*) AS n FROM w WHERE length(word) > 2 GROUP BY word""")
def deobfuscated_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.trim(text.deobfuscated(F.col("text"))), " ")
    df = read(spark, sf_dir, "documents").select(F.explode(words).alias("word")).where(F.length("word") > 2)
    return df.groupBy("word").agg(F.count("*").alias("n"))


PAGE_RULES = [("blocked", 3), ("allowed", 5)]


@query(f"""WITH p AS (SELECT page_id, {HOST_SQL('url')} AS host FROM pages), r AS (SELECT DISTINCT host, CASE WHEN length(host) % 3 = 0 THEN 'blocked' WHEN length(host) % 5 = 0 THEN 'allowed' END AS status FROM p)
SELECT coalesce(status, 'unknown') AS status, count(*) AS pages, count(DISTINCT host) AS hosts FROM p JOIN r USING (host) GROUP BY 1""")
def domain_rule_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the rule on their host, one rule a host."""
    pages = read(spark, sf_dir, "pages").select("page_id", text.host(F.col("url")).alias("host"))
    rules = pages.select("host").distinct().withColumn("status", F.coalesce(*(F.when(F.length("host") % n == 0, F.lit(status)) for status, n in PAGE_RULES)))
    return pages.join(rules, "host").groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("pages"), F.count_distinct("host").alias("hosts"))
