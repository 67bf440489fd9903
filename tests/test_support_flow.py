"""The support flow, message by message: known messages with the stage that answers each."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from larkspur.functions import titles
from larkspur.operators import merging, support

SHOWS = [(1, "Avatar", None, "movie", 2009), (5, "Silo", "Season 3 Episode 1-7", "tv", None), (7, "Lioness", "S02E05", "tv", None), (9, "The Orchard Keepers", "Season 1", "tv", None)]
KNOWN = [("silo", 4, None, True, "tv", None, True, dt.date(2030, 1, 1)), ("dark", 9, None, True, "tv", None, False, None), ("next of lioness", None, None, True, "movie", dt.date(2031, 5, 5), None, None), ("avatar", None, None, True, "movie", dt.date(2009, 12, 10), None, None)]
SURE = '```json\n{"kind": "request", "confidence": 0.9, "title_query": "Avatar", "category_hint": "movie"}\n```'
SAID = [
    (1, "requesting Avatar", None, "request", 1, "found", 1, 1), (2, "please add the movie Avatar", None, "request", 1, "found", 1, 2), (3, "hello", None, "ignored", None, None, None, None), (4, "how do I download?", None, "reply", None, None, None, None),
    (5, "Silo season 4 please", None, "availability", None, None, None, None), (6, "Silo season 3 episode 5 please", None, "request", 5, "found", 6, 1), (7, "Silo season 3 episode 9 please", None, "request", None, "open", 7, 1), (8, "requesting Silo season 3", None, "request", 5, "found", 6, 2),
    (9, "Lioness link expired", None, "issue", None, "open", 9, 1), (10, "my Lioness link is expired again", None, "issue", None, "open", None, None), (11, "subtitles are off", None, "issue", None, "open", 11, 1), (12, "subtitles are off", None, "issue", None, "open", None, None),
    (13, "the blue people film", SURE, "request", 1, "found", 1, 3), (14, "is Dune out, released when?", '{"kind": "request", "confidence": 0.1}', None, None, None, None, None), (15, "next episode of Lioness", None, "availability", None, None, None, None), (16, "S2 E3", None, "reply", None, None, None, None),
    (17, "Orchard Keepers", None, "reply", 9, None, None, None), (18, "Breaking Tide", None, "ignored", None, None, None, None), (19, "Dark season 9 please", None, "availability", None, None, None, None), (20, "requesting Orchard Keepers", None, "request", 9, "found", 20, 1), (21, None, None, "ignored", None, None, None, None),
]


def tables(spark):
    messages = spark.createDataFrame([(k, 1, 100 + k, text, answer) for k, text, answer, *_ in SAID], "message_id long, group_id long, sender_id long, text string, answer string")
    items = spark.createDataFrame(SHOWS, "item_id long, title string, episode_title string, category string, year int").withColumns({"title_key": titles.catalog_key(F.col("title")), "updated": F.col("item_id")})
    known = spark.createDataFrame(KNOWN, "title string, season int, episode int, found boolean, media_type string, release_date date, season_exists boolean, season_air_date date")
    return messages, items, known.withColumns({"first_air_date": F.lit(None).cast("date"), "episode_exists": F.lit(None).cast("boolean"), "episode_air_date": F.lit(None).cast("date")})


def today():
    return F.lit("2026-01-01").cast("date")


def test_each_message_ends_where_it_is_answered(spark):
    messages, items, known = tables(spark)
    got = {r["message_id"]: r for r in support.handled(messages, items, known, today()).collect()}
    assert len(got) == len(SAID)
    for k, text, _, outcome, matched, status, item, count in SAID:
        r = got[k]
        if outcome is None:
            continue
        assert (r["outcome"], r["status"]) == (outcome, status), (text, r)
        if matched is not None or outcome == "request":
            assert r["matched_id"] == matched, (text, r)
        if item is not None:
            assert (r["item_id"], r["occurrence_count"]) == (item, count), (text, r)
    assert got[12]["item_id"] in (11, 12)


def test_two_runs_are_one(spark):
    """Requests of a second run go into the open items that the first one left."""
    messages, items, known = tables(spark)
    one = {r["message_id"]: (r["item_id"], r["occurrence_count"]) for r in support.handled(messages, items, known, today()).collect()}
    first = messages.where("message_id <= 8")
    stored = merging.merged(support.to_merge(support.routed(first, items, known, today())))
    two = {r["message_id"]: (r["item_id"], r["occurrence_count"]) for r in support.handled(first, items, known, today()).collect()}
    two |= {r["message_id"]: (r["item_id"], r["occurrence_count"]) for r in support.handled(messages.where("message_id > 8"), items, known, today(), stored).collect()}
    assert one == two


def test_a_text_is_understood_once(spark):
    """Messages that repeat texts, null among them, have the intents that each would have alone; texts are dealt into parts."""
    messages = spark.createDataFrame([(k, SAID[k % len(SAID)][1]) for k in range(300)], "id long, text string")
    order = lambda df: sorted(map(str, df.collect()))
    alone = titles.with_intent(messages, tell=True)
    got = support.with_intents(messages, tell=True)
    assert got.columns == alone.columns and order(got) == order(alone)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("regexp_extract") and plan.index("regexp_extract") < plan.index("Aggregate [text")
