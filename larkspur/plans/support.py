"""Support queries: catalog search, titles, availability, intents, merging, classifier output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, parsing, scoring, text, titles
from ..operators import catalog, merging, support
from ..sources.tables import read
from .fixtures import quoted as s
from .fixtures import values_sql
from .registry import query

ASKED = [(1, "blue"), (2, "a"), (3, "blue anvil"), (4, "anvil"), (5, "gizmo"), (6, "old bolt"), (7, "cold bolt"), (8, "no such thing"), (9, "vil")]
TITLES = ["Lioness season 2 ep 5 please fix", "LIONESS S2", "request: Silo - Season 3 Episode 1-7!", "the Show about tv", "e 5 of s 01", "Grey's Anatomy link broken", "series 4 Orchard", "episode 12"]
SPOKEN = [
    "requesting Avatar", "Lioness link expired", "how do I download?", "Severance season 2 please", "S2 E3", "Dark s01e05 missing episode 5", "when will Silo season 3 be released", "Breaking Tide", "please add the movie Dune 2021", "hello",
    "Silo episode 4 not available", "subtitles are off in Night Harbour", "https://example.org/x", "can i get Orchard Keepers anime", "thanks", "Episode 7", "where is Preacher thanks", "the film was banned: Avatar", "next episode of Lioness?", "a very long message that is not a title at all because it has too many words",
]


def catalog_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("episode_title"), titles.catalog_key(F.col("p_name")).alias("title_key"), F.col("p_retailprice").alias("updated"))


def shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients that are their own master, as a catalog: a name, their city as episode, their segment as category."""
    own = read(spark, sf_dir, "clients").where("client_id = master_id and name is not null")
    df = own.groupBy(F.col("client_id").alias("item_id")).agg(F.min("name").alias("title"), F.min("city").alias("episode_title"), F.min("segment").alias("category"))
    return df.withColumns({"year": (F.col("item_id") % 30 + 1990).cast("int"), "title_key": titles.catalog_key(F.col("title")), "updated": F.col("item_id")})


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all other clients, misspelt and shortened ones among them, as searches; the first four letters of every fifth."""
    other = read(spark, sf_dir, "clients").where("client_id <> master_id and name is not null").groupBy(F.col("client_id").alias("query_id")).agg(F.min("name").alias("raw"))
    return other.select("query_id", F.lower(titles.title_query(F.when(F.col("query_id") % 5 == 0, F.substring("raw", 1, 4)).otherwise(F.col("raw")))).alias("q"))


def asked(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "query_id long, raw string").select("query_id", F.lower(titles.title_query(F.col("raw"))).alias("q"))


CLEAN_NAME = lambda v: f"trim(regexp_replace(regexp_replace({v}, '[^\\p{{L}}\\p{{N}}_\\s''&.-]+', ' ', 'g'), '\\s+', ' ', 'g'), ' .-')"
COMPACT = lambda v: f"regexp_replace({v}, '[^a-z0-9]+', '', 'g')"
SHELF_SQL = f"""c AS (SELECT client_id AS item_id, min(name) AS title, min(city) AS episode_title, min(segment) AS category, (client_id % 30 + 1990)::INT AS year, lower({CLEAN_NAME('min(name)')}) AS title_key FROM clients WHERE client_id = master_id AND name IS NOT NULL GROUP BY client_id),
q AS (SELECT query_id, lower({CLEAN_NAME('CASE WHEN query_id % 5 = 0 THEN substr(raw, 1, 4) ELSE raw END')}) AS q FROM (SELECT client_id AS query_id, min(name) AS raw FROM clients WHERE client_id <> master_id AND name IS NOT NULL GROUP BY client_id))"""
#: Ratcliff-Obershelp by its definition: the longest block, first in a, then in b; then what is left and right of it.
RATIO_SQL = """p0 AS (SELECT DISTINCT q AS a, title_key AS b, CASE WHEN contains(q, ' ') THEN 0.78 ELSE 0.82 END AS least FROM q JOIN c ON substr(q, 1, 1) = substr(title_key, 1, 1) WHERE length(q) >= 5 AND NOT (NOT contains(q, ' ') AND NOT contains(title_key, ' ') AND abs(length(q) - length(title_key)) > 2)),
p AS (SELECT * FROM p0 WHERE 2.0 * list_sum(list_transform(list_distinct(string_split(a, '')), lambda x: least(len(list_filter(string_split(a, ''), lambda y: y = x)), len(list_filter(string_split(b, ''), lambda y: y = x))))) / (length(a) + length(b)) >= least - 1e-9),
blocks AS (SELECT a, b, 1 AS i, length(a) + 1 AS j, 1 AS k, length(b) + 1 AS n, 0 AS m FROM p
  UNION ALL SELECT a, b, unnest([i, x + m]) AS i, unnest([x, j]) AS j, unnest([k, y + m]) AS k, unnest([y, n]) AS n, unnest([m, 0]) AS m FROM (
    SELECT a, b, i, j, k, n, arg_max(x, (m, -x, -y)) AS x, arg_max(y, (m, -x, -y)) AS y, max(m) AS m FROM (
      SELECT *, len(list_filter(range(1, least(j - x, n - y) + 1), lambda z: substr(a, x, z) = substr(b, y, z))) AS m FROM (
        SELECT a, b, i, j, k, n, x, unnest(range(k, n)) AS y FROM (SELECT a, b, i, j, k, n, unnest(range(i, j)) AS x FROM blocks WHERE i < j AND k < n)))
    GROUP BY a, b, i, j, k, n HAVING max(m) > 0)),
scored AS (SELECT a, b, 2.0 * sum(m) / (length(a) + length(b)) AS score FROM blocks JOIN p USING (a, b) GROUP BY a, b, least HAVING score >= least),
ranked AS (SELECT query_id, item_id, score, row_number() OVER w AS rank, lead(score) OVER w AS following FROM q JOIN scored ON a = q JOIN c ON title_key = b WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, item_id)),
alike AS (SELECT query_id, item_id, score, rank FROM ranked WHERE rank <= 3 AND query_id NOT IN (SELECT query_id FROM ranked WHERE rank = 1 AND score - following < 0.03))"""


@query(f"""WITH q AS (SELECT * FROM {values_sql(ASKED)} v(query_id, q)), m AS (SELECT query_id, p_partkey AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY (lower(p_name) = q) DESC, starts_with(lower(p_name), q) DESC, p_retailprice DESC NULLS LAST, p_partkey) AS rank
FROM q JOIN part ON regexp_matches(lower(p_name), '(^|[^a-z0-9_])' || q || '($|[^a-z0-9_])') WHERE length(q) >= 2) SELECT * FROM m WHERE rank <= 25""")
def catalog_like_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.ranked(catalog.matches(asked(spark, ASKED), catalog_of_parts(spark, sf_dir)), 25).select("query_id", "item_id", "rank")


@query(f"""WITH {SHELF_SQL} SELECT query_id, item_id, rank FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY item_id) AS rank FROM q JOIN c ON {COMPACT('substr(title_key, 1, 4)')} = {COMPACT('q')} WHERE length({COMPACT('q')}) BETWEEN 2 AND 4 AND length(q) < 5) WHERE rank <= 3""")
def catalog_compact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = shows(spark, sf_dir).withColumn("title_key", F.substring("title_key", 1, 4))
    return catalog.compact_matches(typed(spark, sf_dir), short, 3).select("query_id", "item_id", "rank")


@query(f"WITH RECURSIVE {SHELF_SQL}, {RATIO_SQL} SELECT query_id, item_id, rank, round(score, 6) AS score FROM alike")
def catalog_fuzzy_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar names, with none where the best two are too close."""
    return catalog.similar(typed(spark, sf_dir), shows(spark, sf_dir), 3).select("query_id", "item_id", "rank", F.round("score", 6).alias("score"))


WHOLE = lambda v: f"CASE WHEN contains({v}, q) THEN regexp_matches({v}, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(q) || '($|[^\\p{{L}}\\p{{N}}_])') ELSE false END"
WORDS_SQL = f"""w AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY title_key = q DESC, starts_with(title_key, q) DESC, item_id DESC) AS rank FROM q JOIN c ON {WHOLE('title_key')} OR {WHOLE("lower(coalesce(episode_title, ''))")} WHERE length(q) >= 2)"""


@query(f"""WITH RECURSIVE {SHELF_SQL}, {RATIO_SQL}, {WORDS_SQL}, s AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY item_id) AS rank FROM q JOIN c ON {COMPACT('title_key')} = {COMPACT('q')} WHERE length({COMPACT('q')}) BETWEEN 2 AND 4 AND length(q) < 5)
SELECT query_id, item_id, rank, 'words' AS stage FROM w WHERE rank <= 3 UNION ALL SELECT query_id, item_id, rank, 'compact' FROM s WHERE rank <= 3 AND query_id NOT IN (SELECT query_id FROM w) UNION ALL SELECT query_id, item_id, rank, 'similar' FROM alike WHERE query_id NOT IN (SELECT query_id FROM w)""")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three stages of a search, each for what those before didn't find."""
    return catalog.search(typed(spark, sf_dir), shows(spark, sf_dir))


@query(f"""WITH {SHELF_SQL} SELECT item_id, CASE WHEN category <> 'movie' AND coalesce(episode_title, '') <> '' THEN title || ' - ' || episode_title WHEN year <> 0 THEN title || ' (' || year || ')' ELSE title END AS display_title,
CASE WHEN length(title) <= 18 THEN title ELSE substr(title, 1, 17) || '...' END AS short FROM c""")
def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shows(spark, sf_dir)
    return df.select("item_id", text.display_title(F.col("title"), F.col("episode_title"), F.col("category"), F.col("year")).alias("display_title"), text.shortened(F.col("title"), 18).alias("short"))


@query("""WITH v AS (SELECT p_partkey AS item_id, p_partkey % 4 + 1 AS season, CASE WHEN p_partkey % 6 <> 0 THEN p_size % 9 END AS episode, lower(p_name) || CASE p_partkey % 4 WHEN 0 THEN ' season ' || p_size % 5 || ' episode ' || p_size % 7 || '-' || p_size % 7 + 3 WHEN 1 THEN ' s0' || p_size % 5 || 'e0' || p_size % 7 WHEN 2 THEN ' series ' || p_size % 5 ELSE '' END AS v FROM part),
j AS (SELECT *, regexp_extract_all(v, 'e(?:pisode|p)?\\s*0*([0-9]{1,4})(?:\\s*-\\s*0*([0-9]{1,4}))?', 1) AS a, regexp_extract_all(v, 'e(?:pisode|p)?\\s*0*([0-9]{1,4})(?:\\s*-\\s*0*([0-9]{1,4}))?', 2) AS b FROM v)
SELECT item_id FROM j WHERE regexp_matches(v, '(\\b(season|series)\\s*0?' || season || '\\b|\\bs\\s*0?' || season || '(\\b|e[0-9]{1,4}\\b))') AND (episode IS NULL OR len(list_filter(list_zip(a, b), lambda x: x[1]::INT <= episode AND episode <= coalesce(TRY_CAST(x[2] AS INT), x[1]::INT))) > 0)""")
def episode_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the table whose episode title names the season and episode asked for."""
    size = lambda n: (F.col("p_size") % n).cast("string")
    named = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Season "), size(5), F.lit(" Episode "), size(7), F.lit("-"), (F.col("p_size") % 7 + 3).cast("string")))
    named = named.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("S0"), size(5), F.lit("E0"), size(7))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("Series "), size(5)))
    asked_ = {"season": (F.col("p_partkey") % 4 + 1).cast("int"), "episode": F.when(F.col("p_partkey") % 6 != 0, F.col("p_size") % 9)}
    df = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), named.alias("episode_title"), *(v.alias(k) for k, v in asked_.items()))
    return catalog.with_requested_part(df).select("item_id")


DATED = lambda d, f, p, u: f"CASE WHEN {d}::DATE > DATE '2026-01-01' THEN '{f}' WHEN {d} IS NOT NULL THEN '{p}' ELSE '{u}' END"


THREE = lambda k, n: f"CASE WHEN {k} % {n} = 0 THEN NULL ELSE {k} % {n} > 1 END"


@query(f"""WITH v AS (SELECT p_partkey AS id, p_partkey % 7 > 0 AS found, CASE WHEN p_size % 3 = 0 THEN 'movie' ELSE 'tv' END AS media_type, CASE WHEN p_partkey % 5 > 0 THEN DATE '2025-07-01' + (p_partkey * 7 % 400)::INT END AS release_date, CASE WHEN p_partkey % 11 > 1 THEN DATE '2025-06-01' + (p_partkey * 3 % 400)::INT END AS first_air_date,
  nullif(p_size % 4, 0) AS season, nullif(p_size % 5, 0) AS episode, {THREE('p_partkey', 6)} AS season_exists, {THREE('p_partkey', 9)} AS episode_exists, CASE WHEN p_partkey % 4 > 0 THEN DATE '2025-05-01' + (p_partkey * 11 % 500)::INT END AS season_air_date, CASE WHEN p_partkey % 8 > 1 THEN DATE '2025-05-01' + (p_partkey * 13 % 500)::INT END AS episode_air_date FROM part),
x AS (SELECT id, CASE WHEN NOT found THEN 'not_found' WHEN media_type = 'movie' THEN {DATED('release_date', 'future_movie', 'released_movie', 'unknown_movie_date')}
 WHEN episode IS NOT NULL AND season_exists IS FALSE THEN 'season_unconfirmed' WHEN episode IS NOT NULL AND episode_exists IS FALSE THEN 'episode_unlisted' WHEN episode IS NOT NULL THEN {DATED('episode_air_date', 'future_episode', 'aired_episode', 'unknown_episode_date')}
 WHEN season IS NOT NULL AND season_exists IS FALSE THEN 'season_unconfirmed' WHEN season IS NOT NULL THEN {DATED('season_air_date', 'future_season', 'aired_season', 'unknown_season_date')} ELSE {DATED('first_air_date', 'future_tv', 'released_tv', 'unknown_tv_date')} END AS state FROM v)
SELECT id, state, state IN ({', '.join(map(s, fixed.NOT_READY))}) AS request_waits FROM x""")
def availability_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of titles, seasons and episodes: each part of the table as one that is known, listed and out, or not."""
    p, size = F.col("p_partkey"), F.col("p_size")
    day = lambda start, k, n, on: F.when(on, F.date_add(F.lit(start).cast("date"), (p * k % n).cast("int")))
    three = lambda n: F.when(p % n != 0, p % n > 1)
    df = read(spark, sf_dir, "part").select(p.alias("id"), (p % 7 > 0).alias("found"), F.when(size % 3 == 0, "movie").otherwise("tv").alias("media_type"), day("2025-07-01", 7, 400, p % 5 > 0).alias("release_date"), day("2025-06-01", 3, 400, p % 11 > 1).alias("first_air_date"),
        F.nullif(size % 4, F.lit(0)).alias("season"), F.nullif(size % 5, F.lit(0)).alias("episode"), three(6).alias("season_exists"), three(9).alias("episode_exists"), day("2025-05-01", 11, 500, p % 4 > 0).alias("season_air_date"), day("2025-05-01", 13, 500, p % 8 > 1).alias("episode_air_date"))
    df = df.withColumn("state", titles.availability_state(F.lit("2026-01-01").cast("date")))
    return df.select("id", "state", titles.blocks_logging(F.lit("request"), F.lit(None).cast("string"), F.col("state")).alias("request_waits"))


#: Messages about a part of the table: its name for {t}, a season for {s}, an episode for {e}.
ASKS = [
    "requesting {t}", "{t} link expired", "please add {t} season {s} thanks", "{t} episode {e} not available", "when will {t} season {s} be released", "how do i watch {t}?", "S{s} E{e}", "{t}", "can i get the movie {t} please",
    "{t} s0{s}e0{e} missing", "where is {t} 2019", "subtitles are off in {t} - thanks, please", "looking for {t}, anime", "https://a.example/{e} {t}", "please pls send {t} thank you", "{t} season {s}", "is {t} out, new season {s}", "hi", "@bot {t}", "no episode {e} of {t} series {s}",
]


def rewritten_sql(value: str, rules: list[tuple[str, str]], flags: str = "(?i)") -> str:
    for pattern, to in rules:
        value = f"regexp_replace({value}, {s(flags + pattern)}, {s(to)}, 'g')"
    return value


CLEANED = lambda v: f"substr(trim({rewritten_sql(v, titles.CLEAN, '')}, ' .-'), 1, 120)"
TIDIED = lambda v: f"trim({rewritten_sql(CLEANED(v), titles.POLITE)}, ' .:-')"
NOT_A_TITLE = ", ".join(map(s, fixed.NOT_TITLES))
A_TITLE = lambda v: f"CASE WHEN length({v}) >= 2 AND lower({v}) NOT IN ({NOT_A_TITLE}) THEN {v} END"
SAYS = lambda phrases: f"regexp_matches(lower(text), {s('(^|[^0-9a-z_])(?:' + '|'.join(p.replace(' ', chr(92) + 's+') for p in phrases) + ')($|[^0-9a-z_])')})"
HINT = lambda v: "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(lower({v}), {s('|'.join(w))}) THEN {s(k)} END" for k, w in fixed.CATEGORY_WORDS.items()) + ")"
INT = lambda p, g=1: f"TRY_CAST(nullif(regexp_extract(text, {s('(?i)' + p)}, {g}), '') AS INT)"
PLAUSIBLE = lambda v, n: f"(length({v}) BETWEEN {n} AND 80 AND len(regexp_split_to_array({v}, '\\s+')) <= 6 AND lower({v}) NOT IN ({', '.join(map(s, fixed.NOT_BARE_TITLES + fixed.NOT_TITLES))}) AND regexp_matches({v}, '[0-9A-Za-z]'))"
STEPS = [("n1", "text", titles.CUTS), ("n2", "n1", titles.OPENINGS), ("n3", "n2", titles.KINDS)]
NAMED = lambda v: f"(SELECT {A_TITLE('x')} FROM (SELECT {CLEANED(rewritten_sql('y', titles.ARTICLE))} AS x FROM (SELECT {TIDIED(rewritten_sql('z', titles.KINDS))} AS y FROM (SELECT {TIDIED(rewritten_sql('w', titles.OPENINGS))} AS z FROM (SELECT {TIDIED(rewritten_sql(v, titles.CUTS))} AS w)))))"
SHELL = s(titles.SHELL)
PART = lambda v: f"CASE WHEN regexp_matches({v}, {s('(?i)' + titles.ONLY_PART)}) THEN {v} END"
INTENT_RULES = [
    ("part IS NOT NULL", "clarify", "part", "'tv'", None), (f"named IS NOT NULL AND {SAYS(fixed.RELEASE_PHRASES)}", "release", "named", "coalesce(hint, 'tv')", None), (SAYS(fixed.HOWTO_PHRASES), "howto", "named", "hint", None),
    (f"regexp_matches(lower(text), {s(fixed.MISSING_EPISODE)})", "issue", "named", "coalesce(hint, 'tv')", "missing_episode"), *((SAYS(p), "issue", "named", "hint", k) for k, p in fixed.ISSUE_PHRASES.items()),
    (f"named IS NOT NULL AND {SAYS(fixed.REQUEST_PHRASES)}", "request", "named", "hint", None),
    (f"bare IS NOT NULL AND (of_part OR bare_category IS NOT NULL OR regexp_matches(bare, {s(titles.YEAR)}) OR regexp_matches(text, {s('(?i)' + titles.ASKS)}))", "request", "bare", "bare_category", None), ("bare IS NOT NULL", "bare_title", "bare", "bare_category", None),
]


#: From m(id, text) to r(..., rule) and x, what the first rule that applies says.
INTENTS_SQL = f"""a AS (SELECT id, text, coalesce({INT(fixed.SEASON_EPISODE)}, {INT(fixed.SEASON)}) AS season, coalesce({INT(fixed.SEASON_EPISODE, 2)}, {INT(fixed.EPISODE)}, {INT(fixed.SHORT_EPISODE)}) AS episode, {HINT('text')} AS hint, {CLEANED(f'trim(text, {SHELL})')} AS shelled, {NAMED('text')} AS named, {TIDIED(f'trim(text, {SHELL})')} AS alone FROM m),
b AS (SELECT *, {PART('shelled')} AS part, CASE WHEN {HINT('alone')} IS NOT NULL THEN {NAMED('alone')} END AS inside, season IS NOT NULL OR episode IS NOT NULL AS of_part,
  NOT regexp_matches(text, {s('(?i)' + titles.NO_BARE_TITLE)}) AND lower(alone) NOT IN ({', '.join(map(s, fixed.NOT_BARE_TITLES))}) AND {PART(CLEANED(f'trim(alone, {SHELL})'))} IS NULL AS may FROM a),
c AS (SELECT *, CASE WHEN may THEN coalesce(CASE WHEN {PLAUSIBLE('inside', 2)} THEN inside END, CASE WHEN {PLAUSIBLE('alone', 3)} THEN alone END) END AS own, coalesce(hint, CASE WHEN season > 0 THEN 'tv' END) AS bare_category FROM b),
d AS (SELECT *, CASE WHEN own IS NOT NULL THEN coalesce(CASE WHEN of_part THEN named END, own) END AS bare FROM c),
r AS (SELECT *, CASE {' '.join(f'WHEN {when} THEN {i}' for i, (when, *_) in enumerate(INTENT_RULES))} END AS rule FROM d),
x AS (SELECT id, CASE rule {' '.join(f'WHEN {i} THEN {s(k)}' for i, (_, k, *_) in enumerate(INTENT_RULES))} END AS kind, CASE rule {' '.join(f'WHEN {i} THEN {t}' for i, (_, _, t, _, _) in enumerate(INTENT_RULES))} END AS title, CASE rule {' '.join(f'WHEN {i} THEN {c}' for i, (_, _, _, c, _) in enumerate(INTENT_RULES))} END AS category,
  CASE rule {' '.join(f'WHEN {i} THEN {s(x)}' for i, (*_, x) in enumerate(INTENT_RULES))} END AS issue_type, CASE WHEN rule IS NOT NULL THEN season END AS season, CASE WHEN rule IS NOT NULL THEN episode END AS episode, coalesce(rule >= {len(INTENT_RULES) - 2}, false) AS by_bare_title FROM r)"""


@query(f"""WITH m AS (SELECT * FROM {values_sql(list(enumerate(SPOKEN)))} v(id, text) UNION ALL SELECT 1000 + p_partkey, replace(replace(replace(t, '{{t}}', p_name), '{{s}}', (p_size % 9 + 1)::VARCHAR), '{{e}}', (p_partkey % 12 + 1)::VARCHAR)
  FROM part JOIN {values_sql(list(enumerate(ASKS)))} a(i, t) ON p_partkey % {len(ASKS)} = i), {INTENTS_SQL} SELECT * EXCLUDE (by_bare_title) FROM x""")
def intent_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, title and part of support messages: spoken ones, and one about each part of the table."""
    part = read(spark, sf_dir, "part")
    ask = F.element_at(F.array(*map(F.lit, ASKS)), (F.col("p_partkey") % len(ASKS)).cast("int") + 1)
    for mark, value in (("{t}", F.col("p_name")), ("{s}", (F.col("p_size") % 9 + 1).cast("string")), ("{e}", (F.col("p_partkey") % 12 + 1).cast("string"))):
        ask = F.replace(ask, F.lit(mark), value)
    said = spark.createDataFrame(list(enumerate(SPOKEN)), "id long, text string").unionByName(part.select((F.col("p_partkey") + 1000).alias("id"), ask.alias("text")))
    return support.with_intents(said).drop("text")


KEY_SQL = "substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\b(?:season|series|s)\\s*([0-9]+)\\b', ' season \\1 ', 'g'), '\\b(?:episode|ep|e)\\s*([0-9]+)(?:\\s*(?:-|–)\\s*[0-9]+)?\\b', ' episode \\1 ', 'g'), " + s(fixed.KEY_FILLERS) + ", ' ', 'g'), '[^a-z0-9_\\s]+', ' ', 'g'), '\\s+', ' ', 'g')), 1, 255)"
PART_SQL = lambda k, p: f"TRY_CAST(nullif(regexp_extract({k}, '\\b{p} ([0-9]+)\\b', 1), '') AS INT)"
BASE_SQL = "trim(regexp_replace(regexp_replace({0}, '\\b(?:season|episode)\\s+[0-9]+\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH k AS (SELECT id, {KEY_SQL.format('t')} AS key FROM {values_sql(list(enumerate(TITLES)))} v(id, t) UNION ALL SELECT 1000 + p_partkey, {KEY_SQL.format("p_name || ' season ' || p_size || ' ep ' || p_partkey % 9")} FROM part)
SELECT id, key, {BASE_SQL.format('key')} AS base, {PART_SQL('key', 'season')} AS season, {PART_SQL('key', 'episode')} AS episode FROM k""")
def title_key_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.createDataFrame(list(enumerate(TITLES)), "id long, t string")
    b = read(spark, sf_dir, "part").select((F.col("p_partkey") + 1000).alias("id"), F.concat("p_name", F.lit(" season "), F.col("p_size").cast("string"), F.lit(" ep "), (F.col("p_partkey") % 9).cast("string")).alias("t"))
    df = merging.keyed(a.unionByName(b).select("id", F.lit(None).cast("string").alias("matched_title"), F.col("t").alias("title_query")))
    return df.select("id", "key", "base", "season", "episode")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests: a part's name, in a season that the order's key gives or not.  place: where the table has the order's line."""
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("place")
    lines = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("seq"), F.col("l_partkey").alias("p_partkey"), place)
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 3).alias("group_id"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 5).alias("sender_id"))
    season = F.when(F.col("seq") % 4 != 0, F.concat(F.lit(" season "), (F.col("seq") % 4).cast("string"))).otherwise("")
    df = orders.join(lines, "seq").join(part, "p_partkey")
    null = lambda kind: F.lit(None).cast(kind)
    return df.select("seq", "place", "group_id", F.lit("request").alias("kind"), "status", (F.col("seq") % 6).alias("message_id"), "sender_id", F.concat(F.lit("please "), F.col("p_name")).alias("text"), F.concat("p_name", season).alias("title_query"), null("string").alias("matched_title"), F.when(F.col("seq") % 10 == 0, F.col("p_partkey")).alias("matched_id"), null("string").alias("category"))


@query(f"""WITH r AS (SELECT o_orderkey AS seq, o_custkey % 3 AS group_id, o_orderstatus AS status, nullif(o_orderkey % 6, 0) AS message_id, nullif(o_custkey % 5, 0) AS sender_id, 'please ' || p_name AS text, CASE WHEN o_orderkey % 10 = 0 THEN p_partkey END AS matched_id, {KEY_SQL.format("p_name || CASE WHEN o_orderkey % 4 <> 0 THEN ' season ' || o_orderkey % 4 ELSE '' END")} AS key
FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN part ON p_partkey = l_partkey)
SELECT group_id, status, key, count(*) AS occurrence_count, arg_min(message_id, seq) FILTER (message_id IS NOT NULL) AS first_message, arg_min(sender_id, seq) FILTER (sender_id IS NOT NULL) AS first_sender, arg_max(text, seq) AS last_text, arg_max(matched_id, seq) FILTER (matched_id IS NOT NULL) AS matched_id FROM r GROUP BY ALL""")
def support_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.counts_by_key(merging.keyed(requests(spark, sf_dir)), "group_id", "status", "key")


#: Items merged in order of arrival: a step an item, with the open items of its key as a list.
AGREES = "((x.season IS NOT DISTINCT FROM r.season AND x.episode IS NOT DISTINCT FROM r.episode) OR (x.season IS NULL AND x.episode IS NULL) OR (r.season IS NULL AND r.episode IS NULL) OR ((x.season = r.season OR x.episode = r.episode) AND coalesce(x.season = r.season, true) AND coalesce(x.episode = r.episode, true))) AND coalesce(x.category = r.category, true)"
STEPS_SQL = f"""keyed AS (SELECT *, {BASE_SQL.format('key')} AS base, {PART_SQL('key', 'season')} AS season, {PART_SQL('key', 'episode')} AS episode FROM r0 WHERE key <> ''),
in_turn AS (SELECT *, row_number() OVER (PARTITION BY group_id, kind, status, base ORDER BY seq, matched_id NULLS FIRST) AS k FROM keyed),
steps AS (SELECT group_id, kind, status, base, 0::BIGINT AS k, 0::BIGINT AS seq, 0::BIGINT AS item_id, 0::BIGINT AS n, []::STRUCT(item_id BIGINT, title VARCHAR, category VARCHAR, n BIGINT, message BIGINT, sender BIGINT, txt VARCHAR, matched BIGINT, season INT, episode INT)[] AS items FROM (SELECT DISTINCT group_id, kind, status, base FROM in_turn)
  UNION ALL SELECT group_id, kind, status, base, k, seq, new_items[hit].item_id, new_items[hit].n, new_items FROM (SELECT *, CASE WHEN hit > len(items) THEN list_append(items, {{'item_id': seq, 'title': title, 'category': category, 'n': 1::BIGINT, 'message': message_id, 'sender': sender_id, 'txt': text, 'matched': matched_id, 'season': season, 'episode': episode}})
      ELSE list_transform(items, lambda x, i: CASE WHEN i = hit THEN {{'item_id': x.item_id, 'title': x.title, 'category': x.category, 'n': x.n + 1, 'message': CASE WHEN x.message <> 0 THEN x.message ELSE message_id END, 'sender': CASE WHEN x.sender <> 0 THEN x.sender ELSE sender_id END, 'txt': text, 'matched': CASE WHEN matched_id <> 0 THEN matched_id ELSE x.matched END, 'season': x.season, 'episode': x.episode}} ELSE x END) END AS new_items
    FROM (SELECT r.*, s.items, coalesce(list_filter(list_transform(s.items, lambda x, i: CASE WHEN x.matched = r.matched_id THEN i END), lambda i: i IS NOT NULL)[1], list_filter(list_transform(s.items, lambda x, i: CASE WHEN {AGREES} THEN i END), lambda i: i IS NOT NULL)[1], len(s.items) + 1) AS hit
      FROM steps s JOIN in_turn r ON r.group_id = s.group_id AND r.kind = s.kind AND r.status = s.status AND r.base = s.base AND r.k = s.k + 1)))"""
MERGE_SQL = f"""r0 AS (SELECT o_orderkey AS seq, o_custkey % 3 AS group_id, 'request' AS kind, o_orderstatus AS status, o_orderkey % 6 AS message_id, o_custkey % 5 AS sender_id, 'please ' || p_name AS text, p_name || CASE WHEN o_orderkey % 4 <> 0 THEN ' season ' || o_orderkey % 4 ELSE '' END AS title,
  CASE WHEN o_orderkey % 10 = 0 THEN p_partkey END AS matched_id, NULL::VARCHAR AS category, {KEY_SQL.format("title")} AS key FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN part ON p_partkey = l_partkey), {STEPS_SQL}"""
FOLDED_SQL = f"""WITH RECURSIVE {MERGE_SQL}, last AS (SELECT group_id, kind, status, base, unnest(items) AS x FROM (SELECT group_id, kind, status, base, arg_max(items, k) AS items FROM steps GROUP BY group_id, kind, status, base))
SELECT group_id, kind, status, base, x.item_id AS item_id, x.title AS title, x.category AS category, x.n AS occurrence_count, x.message AS first_message, x.sender AS first_sender, x.txt AS last_text, x.matched AS matched_id FROM last"""
MERGED_NAMES = [c.split()[0] for c in merging.MERGED.split(", ")]


@query(FOLDED_SQL)
def support_merge_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests merged in order of arrival."""
    return merging.merged(requests(spark, sf_dir)).select(MERGED_NAMES)


@query(FOLDED_SQL)
def support_merge_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later half of the requests merged into the open items that the earlier half left."""
    rows = requests(spark, sf_dir)
    half = rows.agg(F.max("seq").alias("top")).select((F.col("top") / 2).alias("half"))
    rows = rows.join(F.broadcast(half))  # one row
    stored = merging.merged(rows.where("seq <= half").drop("half"))
    return merging.merged(rows.where("seq > half").drop("half"), stored=stored).select(MERGED_NAMES)


@query(f"WITH RECURSIVE {MERGE_SQL} SELECT seq, item_id, n AS occurrence_count FROM steps WHERE k > 0")
def support_merge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each request went, and how often it had been asked by then."""
    return merging.merge_log(requests(spark, sf_dir))


KINDS_OF_SHOWS = ["movie", "tv", "anime"]


def asks_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as support messages about their first part: ASKS by the order's key, in lower case; every seventh with a model's answer."""
    lines = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("message_id")).agg(F.min("l_partkey").alias("p_partkey"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("message_id"), (F.col("o_custkey") % 3).alias("group_id"), F.col("o_custkey").alias("sender_id"))
    df = orders.join(lines, "message_id").join(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    said = F.element_at(F.array(*map(F.lit, ASKS)), (F.col("message_id") % len(ASKS)).cast("int") + 1)
    for mark, value in (("{t}", F.col("p_name")), ("{s}", (F.col("message_id") % 4 + 1).cast("string")), ("{e}", (F.col("message_id") % 12 + 1).cast("string"))):
        said = F.replace(said, F.lit(mark), value)
    answer = F.concat(F.lit('{"kind": "request", "confidence": 0.9, "title_query": "'), F.col("p_name"), F.lit('", "category_hint": "movie", "season_number": null}'))
    return df.select("message_id", "group_id", "sender_id", said.alias("text"), F.when(F.col("message_id") % 7 == 0, answer).alias("answer"))


def shelf_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh name as a show with seasons and episodes of its own."""
    p = read(spark, sf_dir, "part").where("p_partkey % 11 < 4")
    season = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Season "), (F.col("p_size") % 4 + 1).cast("string"), F.lit(" Episode 1-"), (F.col("p_size") % 9 + 1).cast("string")))
    kind = F.element_at(F.array(*map(F.lit, KINDS_OF_SHOWS)), (F.col("p_partkey") % 3).cast("int") + 1)
    return p.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), season.alias("episode_title"), titles.catalog_key(F.col("p_name")).alias("title_key"), kind.alias("category"), (F.col("p_size") + 1980).alias("year"), F.col("p_partkey").alias("updated"))


def known_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of names and their first seasons: one row each, listed or not, out or not."""
    names = read(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("title")).agg(F.max("p_partkey").alias("p"))
    df = names.withColumn("season", F.explode(F.array(F.lit(None).cast("int"), F.lit(1), F.lit(2))))
    day = F.date_add(F.lit("2025-07-01").cast("date"), (F.col("p") * 7 % 400 + F.coalesce("season", F.lit(0)) * 60).cast("int"))
    none = lambda kind: F.lit(None).cast(kind)
    listed = F.when(F.col("season").isNotNull(), (F.col("p") + F.col("season")) % 5 > 0)
    return df.where("p % 3 > 0").select("title", "season", none("int").alias("episode"), F.lit(True).alias("found"), F.lit("tv").alias("media_type"), none("date").alias("release_date"), F.when(F.col("season").isNull(), day).alias("first_air_date"), listed.alias("season_exists"), none("boolean").alias("episode_exists"), F.when(F.col("season").isNotNull(), day).alias("season_air_date"), none("date").alias("episode_air_date"))


FLOW_SQL = f"""o AS (SELECT o_orderkey AS id, o_custkey % 3 AS group_id, o_custkey AS sender_id, p_name, replace(replace(replace(t, '{{t}}', p_name), '{{s}}', (o_orderkey % 4 + 1)::VARCHAR), '{{e}}', (o_orderkey % 12 + 1)::VARCHAR) AS text
  FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN {values_sql(list(enumerate(ASKS)))} a(i, t) ON o_orderkey % {len(ASKS)} = i),
m AS (SELECT id, text FROM o), {INTENTS_SQL},
u AS (SELECT o.id, group_id, sender_id, o.text, by_model, CASE WHEN by_model THEN 'request' ELSE kind END AS kind, CASE WHEN by_model THEN p_name ELSE title END AS title, CASE WHEN by_model THEN 'movie' ELSE category END AS category, CASE WHEN by_model THEN NULL ELSE issue_type END AS issue_type, CASE WHEN by_model THEN NULL ELSE season END AS season, CASE WHEN by_model THEN NULL ELSE episode END AS episode
  FROM (SELECT o.*, x.* EXCLUDE (id), o.id % 7 = 0 AND (kind IS NULL OR by_bare_title) AS by_model FROM o JOIN x USING (id)) o),
shelf AS (SELECT p_partkey AS item_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'Season ' || p_size % 4 + 1 || ' Episode 1-' || p_size % 9 + 1 END AS episode_title, lower(p_name) AS title_key, (['movie', 'tv', 'anime'])[p_partkey % 3 + 1] AS category, p_size + 1980 AS year, p_size % 4 + 1 AS own_season, p_size % 9 + 1 AS last_episode FROM part WHERE p_partkey % 11 < 4),
sought AS (SELECT DISTINCT lower(title) AS q, category AS wanted FROM u WHERE length(title) >= 2),
hits AS (SELECT q, wanted, shelf.*, row_number() OVER (PARTITION BY q, wanted ORDER BY title_key = q DESC, starts_with(title_key, q) DESC, item_id DESC) AS rank FROM sought JOIN shelf ON (wanted IS NULL OR category = wanted) AND CASE WHEN contains(title_key, q) THEN regexp_matches(title_key, '(^|[^a-z0-9_])' || regexp_escape(q) || '($|[^a-z0-9_])') ELSE false END),
near AS (SELECT q, title_key AS b FROM (SELECT DISTINCT q FROM sought WHERE length(q) >= 5) JOIN (SELECT DISTINCT title_key FROM shelf) ON substr(q, 1, 1) = substr(title_key, 1, 1) WHERE NOT (NOT contains(q, ' ') AND NOT contains(title_key, ' ') AND abs(length(q) - length(title_key)) > 2)),
p AS (SELECT q AS a, b, CASE WHEN contains(q, ' ') THEN 0.78 ELSE 0.82 END AS least FROM near), {RATIO_SQL[RATIO_SQL.index("blocks AS"):RATIO_SQL.index("ranked AS")].rstrip().rstrip(",")},
ranked AS (SELECT sought.q, sought.wanted, shelf.*, score, row_number() OVER w AS rank, lead(score) OVER w AS following FROM sought JOIN scored ON a = sought.q JOIN shelf ON title_key = b WHERE (wanted IS NULL OR category = wanted) AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.q = sought.q AND h.wanted IS NOT DISTINCT FROM sought.wanted) WINDOW w AS (PARTITION BY sought.q, sought.wanted ORDER BY score DESC, item_id)),
unclear AS (SELECT q, wanted FROM ranked WHERE rank = 1 AND score - following < 0.03),
best AS (SELECT q, wanted, item_id, title, episode_title, category, year, own_season, last_episode, rank FROM hits WHERE rank <= 3 UNION ALL SELECT q, wanted, item_id, title, episode_title, category, year, own_season, last_episode, rank FROM ranked r WHERE rank <= 3 AND NOT EXISTS (SELECT 1 FROM unclear n WHERE n.q = r.q AND n.wanted IS NOT DISTINCT FROM r.wanted)),
f AS (SELECT u.id, count(*) AS n_matches, arg_min(item_id, rank) AS matched_id, arg_min(CASE WHEN best.category <> 'movie' AND episode_title IS NOT NULL THEN best.title || ' - ' || episode_title ELSE best.title || ' (' || year || ')' END, rank) AS matched_title FROM u JOIN best ON lower(u.title) = best.q AND u.category IS NOT DISTINCT FROM best.wanted
  WHERE (u.season IS NULL OR coalesce(episode_title IS NOT NULL AND own_season = u.season, false)) AND (u.episode IS NULL OR coalesce(episode_title IS NOT NULL AND u.episode BETWEEN 1 AND last_episode, false)) GROUP BY u.id),
n AS (SELECT *, DATE '2025-07-01' + (p * 7 % 400 + coalesce(season, 0) * 60)::INT AS day, (p + season) % 5 > 0 AS listed FROM (SELECT lower(p_name) AS t, max(p_partkey) AS p FROM part GROUP BY 1), (VALUES (NULL), (1), (2)) v(season) WHERE p % 3 > 0),
states AS (SELECT u.id, CASE WHEN n.season IS NULL THEN CASE WHEN day > DATE '2026-01-01' THEN 'future_tv' ELSE 'released_tv' END WHEN NOT listed THEN 'season_unconfirmed' WHEN day > DATE '2026-01-01' THEN 'future_season' ELSE 'aired_season' END AS state FROM u JOIN n ON lower(u.title) = t AND u.season IS NOT DISTINCT FROM n.season WHERE u.episode IS NULL AND kind IN ('release', 'request', 'issue')),
g AS (SELECT u.*, coalesce(n_matches, 0) AS n_matches, matched_id, matched_title, state, CASE WHEN kind IS NULL OR (kind = 'bare_title' AND n_matches IS NULL) THEN 'ignored' WHEN state IS NOT NULL AND (kind = 'release' OR ((kind = 'request' OR issue_type = 'missing_episode') AND state IN ('future_tv', 'season_unconfirmed', 'future_season'))) THEN 'availability' WHEN kind IN ('request', 'issue') THEN kind ELSE 'reply' END AS outcome FROM u LEFT JOIN f USING (id) LEFT JOIN states USING (id)),
r0 AS (SELECT *, {KEY_SQL.format("coalesce(matched_title, title, '')")} AS key FROM (SELECT id AS seq, group_id, CASE WHEN outcome = 'request' THEN 'request' ELSE coalesce(issue_type, 'general') END AS kind, CASE WHEN outcome = 'request' AND n_matches > 0 THEN 'found' ELSE 'open' END AS status, id AS message_id, sender_id, text, title || coalesce(' Season ' || season, '') || coalesce(' Episode ' || episode, '') AS title, matched_title, matched_id, category FROM g WHERE outcome IN ('request', 'issue'))), {STEPS_SQL}"""


@query(f"""WITH RECURSIVE {FLOW_SQL} SELECT id AS message_id, g.group_id, g.kind, g.title, g.issue_type, g.season, g.episode, g.n_matches, g.matched_id, state, outcome, r0.status, CASE WHEN r0.seq IS NOT NULL THEN coalesce(steps.item_id, id) END AS item_id, CASE WHEN r0.seq IS NOT NULL THEN coalesce(steps.n, 1) END AS occurrence_count
FROM g LEFT JOIN r0 ON r0.seq = id LEFT JOIN steps ON steps.seq = id AND steps.k > 0""")
def support_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages from intent over search, parts and availability to the open item they are merged into."""
    out = support.handled(asks_of_orders(spark, sf_dir), shelf_of_parts(spark, sf_dir), known_of_parts(spark, sf_dir), F.lit("2026-01-01").cast("date"))
    return out.select("message_id", "group_id", "kind", "title", "issue_type", "season", "episode", "n_matches", "matched_id", "state", "outcome", "status", "item_id", "occurrence_count")


@query(f"""WITH r0 AS (SELECT o_orderkey AS id, o_custkey % 3 AS g, o_orderstatus AS st, {KEY_SQL.format("p_name || CASE WHEN o_orderkey % 4 <> 0 THEN ' season ' || o_orderkey % 4 ELSE '' END")} AS key FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN part ON p_partkey = l_partkey),
p AS (SELECT *, {BASE_SQL.format('key')} AS base, {PART_SQL('key', 'season')} AS s, {PART_SQL('key', 'episode')} AS e FROM r0 WHERE key <> ''), o AS (SELECT g, st, key, base, s, e, min(id) AS id FROM p GROUP BY ALL)
SELECT a.id AS seq, min(b.id) AS item_id FROM (SELECT row_number() OVER () AS rid, * FROM p) a JOIN o b ON a.g = b.g AND a.st = b.st AND a.base = b.base WHERE a.key = b.key OR (a.s IS NULL AND a.e IS NULL) OR (b.s IS NULL AND b.e IS NULL) OR ((a.s = b.s OR a.e = b.e) AND coalesce(a.s = b.s, true) AND coalesce(a.e = b.e, true)) GROUP BY a.rid, a.id""")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first request that each request could be merged into."""
    df = requests(spark, sf_dir)
    return merging.first_compatible(df, df.withColumn("item_id", F.col("seq")))


#: Answers of a classifier about an event: a digit of its id for {d}, its type for {t}.
ANSWERS = [
    '{"label": "spam", "confidence": 0.{d}, "recommended_action": "delete", "needs_training_review": false}', 'Sure, {t}:\n```json\n{"label": "not_spam", "confidence": 0.{d}, "recommended_action": "allow", "needs_training_review": false}\n```',
    '{"label": "{t}", "confidence": 0.{d}, "recommended_action": "allow", "needs_training_review": true}', '{"label": "spam", "confidence": 1.{d}, "recommended_action": "delete", "needs_training_review": true}', "no json about {t}", '{"label": "spam", "conf{d}',
    'text {"label": "suspicious", "confidence": 0.{d}, "recommended_action": "ask_admin", "needs_training_review": true} more', '{"label": "spam", "confidence": 0.{d}, "recommended_action": "{t}", "needs_training_review": true}', '{"label": "spam", "confidence": 0.{d}, "recommended_action": "delete"}',
]


def filled(templates: list[str], key: str, **marks) -> Column:
    """The template that a key picks, its marks replaced by columns."""
    out = F.element_at(F.array(*map(F.lit, templates)), (F.col(key) % len(templates)).cast("int") + 1)
    for mark, value in marks.items():
        out = F.replace(out, F.lit("{" + mark + "}"), value.cast("string"))
    return out


def filled_sql(templates: list[str], key: str, **marks: str) -> str:
    out = f"([{', '.join(map(s, templates))}])[({key} % {len(templates)} + 1)::BIGINT]"
    for mark, value in marks.items():
        out = f"replace({out}, '{{{mark}}}', ({value})::VARCHAR)"
    return out


@query(f"""WITH v AS (SELECT event_id AS id, regexp_extract({filled_sql(ANSWERS, 'event_id', d='event_id // 9 % 10', t='event_type')}, '(\\{{.*\\}})', 1, 's') AS j FROM events), p AS (SELECT id, CASE WHEN j <> '' AND json_valid(j) THEN j END AS j FROM v),
f AS (SELECT id, j ->> 'label' AS label, TRY_CAST(j ->> 'confidence' AS DOUBLE) AS confidence, coalesce(label IN ('spam', 'not_spam', 'suspicious') AND confidence BETWEEN 0 AND 1 AND (j ->> 'recommended_action') IN ('delete', 'delete_and_ban', 'ask_admin', 'allow') AND (j ->> 'needs_training_review') IS NOT NULL, false) AS valid FROM p)
SELECT id, valid, CASE WHEN valid THEN label END AS label, CASE WHEN valid THEN confidence END AS confidence FROM f""")
def llm_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about events, valid or not: fenced, within other text, cut off, out of range."""
    df = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), filled(ANSWERS, "event_id", d=F.expr("event_id div 9 % 10"), t=F.col("event_type")).alias("a"))
    df = df.select("id", parsing.classification(F.col("a")).alias("c"))
    return df.select("id", F.col("c").isNotNull().alias("valid"), "c.label", "c.confidence")


INTENTS = ['{"kind": "request", "confidence": 0.9, "title_query": "{t}!", "category_hint": "Movie", "season_number": "{s}"}', '{"kind": "issue", "confidence": 0.8, "issue_type": "{t}"}', '{"kind": "request", "confidence": 0.{s}, "title_query": "{t}"}', '{"kind": "Request", "confidence": 0.9}', '{"kind": "howto", "confidence": 0.95, "episode_number": "x"}', "oops {t}", '{"kind": "issue", "confidence": 0.7, "title_query": "{t}", "issue_type": "playback", "season_number": 3}']


@query(f"""WITH f AS (SELECT id, lower(j ->> 'kind') AS kind, trim(regexp_replace(j ->> 'title_query', '[^\\w\\s''&.-]+', ' ', 'g'), ' .-') AS title, lower(j ->> 'category_hint') AS category, j ->> 'issue_type' AS issue, TRY_CAST(j ->> 'season_number' AS INT) AS season, TRY_CAST(j ->> 'confidence' AS DOUBLE) AS c FROM (SELECT id, CASE WHEN json_valid(j) THEN j END AS j FROM (SELECT p_partkey AS id, {filled_sql(INTENTS, 'p_partkey', t='p_name', s='p_size % 10')} AS j FROM part)))
SELECT id, kind, CASE WHEN length(title) >= 2 THEN title END AS title, CASE WHEN category IN ('movie', 'tv', 'anime') THEN category END AS category, CASE WHEN kind = 'issue' THEN CASE WHEN issue IN ('broken_link', 'missing_episode', 'banned', 'playback', 'general') THEN issue ELSE 'general' END END AS issue_type, season
FROM f WHERE c >= 0.68 AND (kind IN ('howto', 'issue') OR (kind IN ('request', 'release') AND length(title) >= 2))""")
def llm_intent_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about parts of the table that are sure enough and name a kind."""
    df = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), filled(INTENTS, "p_partkey", t=F.col("p_name"), s=F.col("p_size") % 10).alias("a"))
    df = df.select("id", parsing.intent(F.col("a")).alias("i")).where("i is not null")
    return df.select("id", "i.kind", "i.title", "i.category", "i.issue_type", "i.season")


SEASONS = ['{"seasons": [{"season_number": {s}, "air_date": "2020-01-0{d}"}, {"season_number": 2, "air_date": "bad"}]}', '{"seasons": []}', '{"seasons": [{"season_number": 1, "air_date": null, "episode_count": 3}, {"season_number": {d}, "air_date": "2021-12-1{s}"}]}', '{"name": "{s}{d}"}']


@query(f"""WITH v AS (SELECT p_partkey AS id, (p_partkey % 3 + 1)::INT AS n, {filled_sql(SEASONS, 'p_partkey', s='p_size % 4', d='p_size % 9 + 1')} AS j FROM part),
l AS (SELECT id, list_filter(from_json(j, '{{"seasons": [{{"season_number": "INTEGER", "air_date": "VARCHAR"}}]}}').seasons, lambda x: x.season_number = n) AS l FROM v) SELECT id, coalesce(len(l) > 0, false) AS listed, TRY_CAST(l[1].air_date AS DATE) AS air_date FROM l""")
def season_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a title's details list a season, and since when it is out."""
    df = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3 + 1).cast("int").alias("n"), filled(SEASONS, "p_partkey", s=F.col("p_size") % 4, d=F.col("p_size") % 9 + 1).alias("j")).withColumn("s", parsing.season(F.col("j"), F.col("n")))
    return df.select("id", F.col("s").isNotNull().alias("listed"), F.try_to_date(F.col("s.air_date")).alias("air_date"))


@query(f"""SELECT event_id, regexp_matches(lower(t), 'free porn|leaked video|connect wallet') AS mock_spam, CASE WHEN event_id % 3 = 0 THEN 'spam' WHEN event_id % 2 = 0 THEN 'suspicious' ELSE 'not_spam' END AS label, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'primary failed' ELSE 'primary failed; fallback failed' END AS error
FROM (SELECT event_id, event_type || CASE WHEN user_id % 2 = 0 THEN ' connect wallet' ELSE '' END AS t FROM events)""")
def provider_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first classifier that answers, and the errors of those before."""
    df = read(spark, sf_dir, "events")
    t = F.concat("event_type", F.when(F.col("user_id") % 2 == 0, " connect wallet").otherwise(""))
    first = scoring.first_result((F.when(F.col("event_id") % 3 == 0, "spam"), F.lit("primary failed")), (F.when(F.col("event_id") % 2 == 0, "suspicious"), F.lit("fallback failed")), (F.lit("not_spam"), F.lit(None).cast("string")))
    return df.select("event_id", (scoring.mock_label(t)["label"] == "spam").alias("mock_spam"), first.alias("f")).select("event_id", "mock_spam", "f.label", "f.error")


@query("""SELECT event_id, 'event_type=' || event_type AS fields, CASE WHEN length(props) <= 18 THEN '***configured***' ELSE substr(props, 1, 10) || '...' || right(props, 6) END AS masked FROM events""")
def audit_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit fields without keys that name a token; masked values."""
    fields = text.without_secrets(F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("Api_Token"), F.lit("x")))
    show = F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return read(spark, sf_dir, "events").select("event_id", show.alias("fields"), text.masked(F.col("props")).alias("masked"))
