"""Cases with known answers, and what SQL can't express against plain loops."""

from __future__ import annotations

import difflib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from larkspur.functions import features, fixed, parsing, scoring, settings, text, titles
from larkspur.operators import catalog, feedback, fuzzy, lookups, merging, retrieval
from larkspur.plans import fixtures, moderation, support
from larkspur.plans.queries import QUERIES
from larkspur.sources import tables
from larkspur.streaming import stateful


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "expected"), [("  a \n b c ", "a b c"), ("Tom &amp; Jerry &lt;3", "Tom & Jerry <3"), ("ｆｕｌｌ​width", "fullwidth"), (None, ""), ("", "")])
def test_normalized(spark, raw, expected):
    assert one(spark, raw, text.normalized) == expected


def test_links(spark):
    message = "See HTTPS://Example.com/A), https://example.com/a and www.Foo.org. or t.me/joinchat/X; (http://u:p@host_x.net:81/y?z)"
    df = spark.createDataFrame([(message,)], "text string")
    r = features.with_text(df).first()
    assert r["urls"] == ["HTTPS://Example.com/A", "www.Foo.org", "t.me/joinchat/X", "http://u:p@host_x.net:81/y?z"]
    assert r["hosts"] == ["example.com", "foo.org", "t.me", "host_x.net"]
    assert r["links"] == ["t.me/joinchat/X"]


def test_marked_urls(spark):
    """Entities mark URLs in a text or hide them behind it; characters beyond the basic plane count once, or twice in UTF-16."""
    message = "🎉 go shop.example/a now, https://b.example"
    at = message.index("shop")
    schema = "text string, entities array<struct<type string, offset int, length int, url string>>"
    marks = [("url", at, 14, None), ("text_link", 0, 2, "https://c.example/x"), ("bold", 0, 3, None), ("text_link", 0, 1, None), ("url", at, 14, None)]
    r = features.with_text(spark.createDataFrame([(message, marks)], schema)).first()
    assert r["urls"] == ["https://b.example", "shop.example/a", "https://c.example/x"] and r["hosts"] == ["b.example", "shop.example", "c.example"]
    df = spark.createDataFrame([(message, [("url", at + 1, 14, None)]), (message, None), ("", [("url", 3, 4, None)])], schema)
    assert [x[0] for x in df.select(text.entity_urls(F.col("text"), F.col("entities"), "utf16")).collect()] == [["shop.example/a"], [], [""]]


def decide(spark, message, mode="normal", setup=True, ban=False, blocked=(), label=None, **more):
    df = spark.createDataFrame([(message, mode, setup, ban, list(blocked))], "text string, mode string, setup_completed boolean, ban_enabled boolean, blocked_hosts array<string>")
    for k, v in more.items():
        df = df.withColumn(k, F.lit(v))
    df = scoring.with_rules_label(scoring.with_rule_score(features.with_features(features.with_text(df))))
    if label:
        df = df.withColumns({"label": F.lit(label[0]), "confidence": F.lit(label[1])})
    return scoring.with_decision(scoring.with_final_score(df)).first()


@pytest.mark.parametrize(
    ("message", "how", "rule", "label", "final", "action"),
    [
        ("hello team", {}, 0.0, "not_spam", 0.0, "allow"),
        ("Patch notes https://github.com/example/project", {}, 0.0, "not_spam", 0.0, "allow"),
        ("login to continue https://t.me/scambot?start=x", {}, 0.88, "suspicious", 0.64416, "ask_admin"),
        ("login to continue https://t.me/scambot?start=x", {"label": ("spam", 0.97)}, 0.88, "spam", 1.0, "delete"),
        ("login to continue https://t.me/scambot?start=x", {"label": ("spam", 0.97), "ban": True}, 0.88, "spam", 1.0, "delete_and_ban"),
        ("claim now https://bad.example", {"blocked": ["bad.example"]}, 0.86, "spam", 1.0, "delete"),
        ("login to continue https://t.me/scambot?start=x", {"setup": False}, 0.88, "suspicious", 0.64416, "monitor_setup_required"),
        ("login to continue https://t.me/scambot?start=x", {"mode": "monitor_only"}, 0.88, "suspicious", 0.64416, "monitor"),
        ("login to continue https://t.me/scambot?start=x", {"is_admin": True}, 0.72, "suspicious", 0.45, "allow"),
    ],
)
def test_worked_examples(spark, message, how, rule, label, final, action):
    r = decide(spark, message, **how)
    assert (round(r["rule_score"], 6), r["label"], round(r["final_score"], 5), r["action"]) == (rule, label, final, action)


@pytest.mark.parametrize(
    ("message", "feature"),
    [("join https://t.me/+abc", "invite"), ("cheap at https://bit.ly/x", "shortener"), ("connect w4llet", "crypto"), ("you w0n", "reward"), ("telegram login", "login"), ("a​b", "zero_width"), ("a.b.c", "obfuscated"), ("🎉" * 10, "many_emojis"), ("@aaa @bbb @ccc @ddd @eee", "mentions"), ("follow my channel", "promotion"), ("last chance to watch", "urgency"), ("view full scene", "porn_words"), ("xxx watch now", "adult_call")],
)
def test_one_feature(spark, message, feature):
    df = spark.createDataFrame([(message,)], "text string")
    assert features.with_features(features.with_text(df)).first()[feature]
    plain = spark.createDataFrame([("see you at lunch",)], "text string")
    assert not features.with_features(features.with_text(plain)).first()[feature]


def test_skip_and_gate(spark):
    rows = [("", False, False), ("hi", True, False), ("hi", False, True), ("go https://t.me/xbot?start=1", False, True), ("hi", False, False)]
    df = spark.createDataFrame(rows, "text string, is_admin boolean, is_trusted boolean")
    got = features.with_features(features.with_text(df)).select(features.skipped(F.lit(False)).alias("s")).collect()
    assert [r["s"] for r in got] == [True, True, True, False, False]


@pytest.mark.parametrize(("message", "expected"), [("rm -rf / now", "private_malicious_code_ignored"), ("you stupid bot", "private_abuse_warned"), ("connect wallet", "private_spam_ignored"), ("hello", None)])
def test_private_safety(spark, message, expected):
    df = spark.createDataFrame([(message,)], "text string")
    assert scoring.with_private_safety(scoring.with_rule_score(features.with_features(features.with_text(df)))).first()["safety_action"] == expected


@pytest.mark.parametrize(
    ("message", "expected"),
    [
        ("requesting Avatar", ("request", "Avatar", None, None, None, None)), ("Lioness link expired", ("issue", "Lioness link", None, "broken_link", None, None)), ("how do I download?", ("howto", None, None, None, None, None)),
        ("Severance season 2 please", ("request", "Severance", "tv", None, 2, None)), ("S2 E3", ("clarify", "S2 E3", "tv", None, 2, 3)), ("Silo missing episode 5", ("issue", "Silo", "tv", "missing_episode", None, 5)),
        ("Breaking Tide", ("bare_title", "Breaking Tide", None, None, None, None)), ("hello", None), ("https://example.org", None), ("next episode of Lioness", ("release", "next of Lioness", "tv", None, None, None)),
    ],
)
def test_intents(spark, message, expected):
    r = titles.with_intent(spark.createDataFrame([(1, message)], "id long, text string")).drop("id", "text").first()
    assert tuple(r) == (expected or (None,) * 6)


def test_intents_without_bare_titles(spark):
    df = spark.createDataFrame([("Breaking Tide",), ("requesting Avatar",), (None,)], "text string")
    assert [r["kind"] for r in titles.with_intent(df, bare=False).collect()] == [None, "request", None]


def test_context_title(spark):
    df = spark.createDataFrame([("Lioness Season 2 Episode 4 download https://x.example",), ("link",), ("Silo thanks please",)], "x string")
    assert [r[0] for r in df.select(titles.replied_title(F.col("x"))).collect()] == ["Lioness", None, "Silo"]


def test_stripping_until_nothing_changes(spark):
    """Openings and polite words in any number and order."""
    cases = [("please pls send Silo - thanks, thank you please", "Silo"), ("can you upload request for Dark pls", "Dark"), ("requesting request for link Silo", "Silo"), ("the movie Dune", "Dune"), ("please", None), ("is it out", "is it")]
    df = spark.createDataFrame([(c,) for c, _ in cases], "x string")
    assert [r[0] for r in df.select(titles.named_title(F.col("x"))).collect()] == [e for _, e in cases]


@pytest.mark.parametrize(
    ("message", "season", "episode", "title"),
    [
        ("s03 e04", 3, 4, "s03 e04"), ("Ep. 5", None, None, "Ep. 5"), ("series 2", 2, None, "series 2"), ("S1E2-4", 1, 2, "S1E2-4"), ("Lioness season 2 ep 5 please fix", 2, 5, "Lioness season 2 ep 5 please fix"), ("e 5 of s 01", 1, None, "e 5 of s 01"),
        ("request: Silo - Season 3 Episode 1-7!", 3, 1, "request Silo - Season 3 Episode 1-7"), ("e05", None, 5, "e05"), ("https://example.org/x @you Dark", None, None, "Dark"),
    ],
)
def test_parts_and_title_queries(spark, message, season, episode, title):
    r = spark.createDataFrame([(message,)], "x string").select(titles.season(F.col("x")).alias("s"), titles.episode(F.col("x")).alias("e"), titles.title_query(F.col("x")).alias("q")).first()
    assert (r["s"], r["e"], r["q"]) == (season, episode, title)


#: A small catalog in which searches by short keys, typos and parts have something to find.
SHOWS = [
    (1, "Avatar", None, "movie", 2009), (2, "E.R.", None, "tv", None), (3, "Grey's Anatomy", None, "tv", None), (4, "Preacher", None, "tv", None),
    (5, "Silo", "Season 3 Episode 1-7", "tv", None), (6, "Silo", "Season 2 Episode 4", "tv", None), (7, "Lioness", "S02E05", "tv", None), (8, "M A S H", None, "tv", None),
    (9, "The Orchard Keepers", "Season 1", "tv", None), (10, "Night Harbour", None, "movie", 2020), (11, "Night Harbor", None, "movie", 2021),
]
TYPED = [(1, "avatar"), (2, "er"), (3, "greys anatomy"), (4, "reacher"), (5, "silo"), (6, "mash"), (7, "the orchard keeper"), (8, "night harbours"), (9, "orchard keepers"), (10, "x")]
PARTS = [(1, 5, 3, 5, True), (2, 5, 3, 8, False), (3, 6, 2, 4, True), (4, 6, 2, 5, False), (5, 7, 2, 5, True), (6, 7, 2, None, True), (7, 9, 1, None, True), (8, 9, 2, None, False), (9, 5, None, 7, True), (10, 1, None, None, True)]


def shelf(spark):
    df = spark.createDataFrame(SHOWS, "item_id long, title string, episode_title string, category string, year int")
    return df.withColumns({"title_key": titles.catalog_key(F.col("title")), "updated": F.col("item_id")})


def alike(asked, shows, limit=3):
    """By comparing all: (query, item, rank)."""
    expected = set()
    for qid, q in asked:
        scored = []
        for i, t in shows:
            if len(q) >= 5 and t and t[0] == q[0] and not (" " not in q and " " not in t and abs(len(q) - len(t)) > 2):
                s = difflib.SequenceMatcher(None, q, t).ratio()
                if s >= (0.82 if " " not in q else 0.78):
                    scored.append((-s, i))
        scored.sort()
        if not (len(scored) > 1 and scored[1][0] - scored[0][0] < 0.03):
            expected |= {(qid, i, k + 1) for k, (_, i) in enumerate(scored[:limit])}
    return expected


def test_fuzzy_search(spark):
    got = catalog.similar(support.asked(spark, TYPED), shelf(spark), 3).collect()
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in got} == alike(TYPED, [(i, t.lower().strip(".")) for i, t, *_ in SHOWS])


def test_fuzzy_candidates(spark):
    """None that is similar enough is missed: typos, repeated and turned parts, few letters; and few others are left."""
    random.seed(4)
    words = ["".join(random.choice("abcde") for _ in range(random.randint(1, 8))) for _ in range(60)]
    strings = [" ".join(random.choices(words, k=random.randint(1, 3))) for _ in range(220)] + ["a" * n for n in (1, 2, 5, 9, 12)] + ["abababab", "babababa", "😀😀ab", "é"]
    for s in strings[:150]:
        k, n = random.randrange(len(s) + 1), random.randrange(3)
        strings.append(random.choice([s[:k] + random.choice("abcde") + s[k + n :], s[k:] + s[:k], s[:k] + s[k + 1 :], s[::-1]]))
    strings = sorted({s for s in strings if s})
    least = {s: 0.82 if " " not in s else 0.78 for s in strings}
    left = spark.createDataFrame(list(least.items()), "a string, t double")
    right = spark.createDataFrame([(s,) for s in strings], "b string")
    got = {(r["a"], r["b"]) for r in fuzzy.candidates(left, right, "a", "b", "t", 0.78).collect()}
    pairs = [(a, b) for a in strings for b in strings if a[0] == b[0]]
    expected = {(a, b) for a, b in pairs if difflib.SequenceMatcher(None, a, b).ratio() >= least[a]}
    assert expected <= got and len(expected) > 400 and len(got) < len(pairs) / 4


def test_fuzzy_candidates_are_few(spark):
    """Names of the same few syllables share most pairs of neighbours; few of them may be alike.  Blocks and long strings miss none."""
    random.seed(5)
    parts = ["ber", "ley", "ren", "son", "kor", "ni", "gu", "vic", "ma", "sa"]
    names = sorted({"el" + "".join(random.choices(parts, k=2)) + " " + "".join(random.choices(parts, k=3)) for _ in range(1300)})
    long = "".join(random.choice("abcdefgh") for _ in range(110))
    names += ["e" + long, "e" + long[:90] + "xy", "e" + "".join(map(chr, range(20_000, 20_080)))]
    left = spark.createDataFrame([(s, 0.78) for s in names[::5] + names[-3:]], "a string, t double")
    got = {(r["a"], r["b"]) for r in fuzzy.candidates(left, spark.createDataFrame([(s,) for s in names], "b string"), "a", "b", "t").collect()}
    asked = set(names[::5] + names[-3:])
    pairs = [(a, b) for a in sorted(asked)[:40] + names[-3:] for b in names]
    assert {(a, b) for a, b in pairs if difflib.SequenceMatcher(None, a, b).ratio() >= 0.78} <= got
    assert len(got) < len(asked) * len(names) / 10


def test_copies_meet_once(spark):
    """Many items of one title and many queries for it: each query has its first items, and pairs don't grow with their product."""
    items = spark.range(600).select(F.col("id").alias("item_id"), F.lit("abcd").alias("title"), F.lit(None).cast("string").alias("episode_title"), F.lit("abcd").alias("title_key"), F.when(F.col("id") % 2 == 0, "tv").otherwise("movie").alias("category"), (-F.col("id")).alias("updated"))
    asked = spark.range(900).select(F.col("id").alias("query_id"), F.lit("ab cd").alias("q"), F.when(F.col("id") % 3 == 0, "movie").when(F.col("id") % 3 == 1, "anime").alias("wanted"))
    firsts = {0: [1, 3, 5], 1: [], 2: [0, 1, 2]}
    for found, q in ((catalog.compact_matches, "abcd"), (catalog.best_matches, "abcd")):
        df = found(asked.withColumn("q", F.lit(q)), items, 3)
        got = defaultdict(list)
        for r in df.orderBy("query_id", "rank").collect():
            got[r["query_id"]].append(r["item_id"])
        assert all(got[k] == firsts[k % 3] for k in range(900))
    assert catalog.similar(asked, items, 3).count() == 0  # the best two are always alike
    alone = items.where("item_id = 0")
    assert {(r["query_id"], r["item_id"]) for r in catalog.similar(asked, alone, 3).collect()} == {(k, 0) for k in range(900) if k % 3 == 2}


def test_nearest_vectors_in_blocks(spark):
    """Against all pairs, over many small blocks: equal vectors by id, vectors that are null or have no length last, a query itself never."""
    random.seed(6)
    vectors = {i: [random.choice([-1.0, 0.0, 1.0]) for _ in range(4)] for i in range(120)} | {200 + i: [3.0, 1.0, 0.0, 2.0] for i in range(40)} | {300: None, 301: [0.0] * 4}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in retrieval.vector_top_k(df.where("vec_id % 5 = 0"), df, 4, block=30).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["similarity"]))

    def cosine(a, b):
        size = lambda v: sum(x * x for x in v or []) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / size(a) / size(b), 6) if size(a) and size(b) else None

    for q in (i for i in vectors if i % 5 == 0):
        pairs = sorted((-s if (s := cosine(vectors[q], v)) is not None else 9, i, s) for i, v in vectors.items() if i != q)
        assert got[q] == [(i, s) for _, i, s in pairs[:4]]


def test_last_of_equal_seq_is_by_place(spark):
    rows = [(7, p, 1, 2, f"text {p}", 100 + p if p % 2 else None) for p in range(40)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "seq long, place int, message_id long, sender_id long, text string, matched_id long").withColumn("key", F.lit("k"))
    r = merging.counts_by_key(df.repartition(5, "text"), "key").first()
    assert (r["occurrence_count"], r["last_text"], r["matched_id"]) == (40, "text 39", 139)


def test_nearest_examples_without_words(spark):
    """An example without a text comes after those that share nothing; a message without a text takes the newest."""
    examples = spark.createDataFrame([(1, "spam", k, text, k) for k, text in ((1, None), (2, "other"), (3, "free money"), (4, "money"))], "scope_group long, label string, example_id long, example_text string, age int")
    said = spark.createDataFrame([(1, 1, "free money here"), (2, 1, None)], "message_id long, group_id long, text string")
    got = [(r["message_id"], r["rank"], r["example_id"], r["overlap"]) for r in retrieval.nearest(said, examples).orderBy("message_id", "rank").collect()]
    assert got[:4] == [(1, 1, 3, 2), (1, 2, 4, 1), (1, 3, 2, 0), (1, 4, 1, None)] and [g[2] for g in got[4:]] == [1, 2, 3, 4]


def test_rules_are_matched_once(spark, sf):
    """No filter that Spark infers repeats the patterns of the features, and messages are dealt into as many parts as a shuffle has."""
    plan = QUERIES["rule_reason_histogram"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") < 20
    assert fixtures.messages(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_search_stages(spark):
    got = defaultdict(list)
    for r in catalog.search(support.asked(spark, TYPED), shelf(spark)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["item_id"], r["stage"]))
    assert got[1] == [(1, "words")] and got[2] == [(2, "compact")] and got[6] == [(8, "compact")] and got[4] == [] and got[10] == []
    assert got[5] == [(6, "words"), (5, "words")] and got[7] == [(9, "similar")]


def test_requested_parts(spark):
    parts = spark.createDataFrame([p[:4] for p in PARTS], "query_id long, item_id long, season int, episode int")
    assert {r["query_id"] for r in catalog.with_requested_part(parts.join(shelf(spark), "item_id")).collect()} == {p[0] for p in PARTS if p[4]}


def test_merge_fold(spark, sf):
    """The fold over sorted partitions against a loop over all rows in order of arrival."""
    rows = merging.keyed(support.requests(spark, sf)).orderBy("seq").collect()
    records = defaultdict(list)
    for r in rows:
        part, own = (r["season"], r["episode"]), records[r["group_id"], r["kind"], r["status"], r["base"]]
        hit = next((x for x in own if r["matched_id"] is not None and x["matched"] == r["matched_id"]), None) or next((x for x in own if merging.agree(part, x["part"])), None)
        if hit:
            hit["n"], hit["matched"] = hit["n"] + 1, r["matched_id"] or hit["matched"]
        else:
            own.append({"id": r["seq"], "n": 1, "part": part, "matched": r["matched_id"]})
    expected = sorted((k[0], k[2], k[3], x["id"], x["n"], x["matched"]) for k, v in records.items() for x in v)
    got = sorted(tuple(r) for r in merging.merged(support.requests(spark, sf)).select("group_id", "status", "base", "item_id", "occurrence_count", "matched_id").collect())
    assert sorted(expected, key=repr) == sorted(got, key=repr)


def test_decisions_in_order(spark):
    """Deleted messages raise their sender's next scores: against taking messages one by one through the columns."""
    said = ["hello", "claim now https://bad.example", "verify your account: https://telegram.me/helpbot?startapp=go", "follow my channel for updates", "claim now https://bad.example/2", "connect w4llet", "hello", "login to continue https://t.me/scambot?start=x"]
    rows = [(k, k % 3, 1, said[(k * 5 + k // 3) % len(said)], ["bad.example"] if k % 2 else [], k % 7 != 6) for k in range(36)]
    df = spark.createDataFrame(rows, "message_id long, user_id long, group_id long, text string, blocked_hosts array<string>, judged boolean").withColumns({"mode": F.lit("aggressive"), "setup_completed": F.lit(True), "ban_enabled": F.lit(True)})
    df = df.withColumns({"violation_count": F.when(F.col("user_id") == 2, 2), "risk_score": F.when(F.col("user_id") == 2, 0.9)})
    df = features.with_features(features.with_text(df))
    out = scoring.with_decision(feedback.with_final_outcome(feedback.with_violations_so_far(feedback.with_outcomes(df), ["group_id", "user_id"], ["message_id"], "judged")))
    got = {r["message_id"]: (r["violation_score"], r["final_score"], r["label"], r["action"]) for r in out.collect()}
    state = {0: (0, 0.0), 1: (0, 0.0), 2: (2, 0.9)}
    seen = {}
    for k, user, *_, judged in rows:
        count, risk = state[user]
        v = min(0.2, count * 0.04 + risk * 0.12) if count else 0.0
        key = (rows[k][3], tuple(rows[k][4]), v)
        if key not in seen:
            one_ = features.with_features(df.where(F.col("message_id") == k).select("message_id", "text", "blocked_hosts", "mode", "setup_completed", "ban_enabled", *[c for c in ("norm", "odd", "zero_widths", "urls", "deob", "hosts", "links", "compact")]).withColumn("violation_score", F.lit(v)))
            seen[key] = scoring.with_decision(scoring.with_final_score(scoring.with_rules_label(scoring.with_rule_score(one_)))).first()
        r = seen[key]
        assert got[k] == (v, r["final_score"], r["label"], r["action"])
        if judged and r["deletes"]:
            state[user] = (count + 1, max(risk, r["final_score"]))
    assert any(c > 2 for c, _ in state.values())


def test_violation_feedback(spark, sf):
    state, expected = defaultdict(lambda: (0, 0.0)), {}
    for r in tables.read(spark, sf, "events").orderBy("event_id").collect():
        n, risk = state[r["user_id"]]
        prior = min(0.2, n * 0.04 + risk * 0.12) if n else 0.0
        score = min(1.0, min(r["value"], 100.0) / 100.0 + 0.06 * prior)
        expected[r["event_id"]] = (round(prior, 6), score >= 0.88)
        if score >= 0.88:
            state[r["user_id"]] = (n + 1, max(risk, score))
    assert {r["event_id"]: (r["prior"], r["hit"]) for r in QUERIES["violation_feedback"](spark, sf).collect()} == expected


def test_tokens(spark):
    good = parsing.signed({"event_id": 1, "admin_user_id": 2, "exp": 100}, "k")
    df = spark.createDataFrame([(good,), (good[:-1] + "x",), ("junk",), (parsing.signed({"event_id": 1, "admin_user_id": 2, "exp": 5}, "k"),), (None,)], "t string")
    got = [r["c"]["event_id"] for r in df.select(parsing.verified("k", 50)("t").alias("c")).collect()]
    assert got == [1, None, None, None, None]


def test_replies(spark):
    assert one(spark, "```text\nHi  \n\n\n\nthere\n```", text.clean_reply) == "Hi\n\nthere"
    keep = lambda x: text.keeps_urls(x, F.array(F.lit("https://a.example/x")))
    assert one(spark, "See https://a.example/x.", keep) and not one(spark, "See https://b.example", keep) and not one(spark, "", keep)


def test_host_rules(spark, sf):
    df = moderation.known(spark, sf).where("group_id = 0 and size(blocked_hosts) > 0")
    assert {tuple(r["blocked_hosts"]) for r in df.select("blocked_hosts").distinct().collect()} == {("bad.example",)}


def test_host_rules_both_ways(spark, sf):
    df = features.with_text(fixtures.messages(spark, sf)).select("message_id", "group_id", "hosts")
    tell = lambda f: sorted((r["message_id"], sorted(r["blocked_hosts"]), sorted(r["allowed_hosts"])) for r in f(df, fixtures.rules(spark)).collect())
    assert tell(lookups.with_host_rules) == tell(lookups.with_many_host_rules)


def test_python_where_nothing_is_built_in(spark, sf):
    plan = QUERIES["moderation_decisions"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "BatchEval" not in plan and plan.count("MapInArrow") == 1  # entities with NFKC, and the fold
    plan = QUERIES["moderation_decisions"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:" in plan or "ReadSchema: struct<event_id:bigint,user_id:bigint" in plan


def test_rate_limit_stream(spark, sf, tmp_path):
    source = tables.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = stateful.rate_limited_stream(stream, 3, 86_400).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    batch = stateful.rate_limited(source.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3, 86_400)
    assert {tuple(r) for r in spark.table("limited").select("event_id", "allowed").collect()} == {tuple(r) for r in batch.select("event_id", "allowed").collect()}


def test_session_stream(spark, sf, tmp_path):
    """A stream gives the sessions that its watermark has closed, the same as the batch form has them."""
    source = tables.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = stateful.sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    end = source.agg(F.max("ts")).first()[0]
    closed = stateful.sessions(source, late=None).where(F.col("ended") <= F.lit(end) - F.expr("interval 10 minutes"))
    assert {tuple(r) for r in spark.table("sessions").collect()} == {tuple(r) for r in closed.collect()}


def test_scored_stream(spark, sf, tmp_path):
    messages = fixtures.messages(spark, sf).select("message_id", "text")
    messages.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = []
    q = stateful.scored_stream(spark.readStream.schema(messages.schema).parquet(str(tmp_path / "in")), lambda b: moderation.decided(features.with_text(b)), lambda b, e: out.extend(b.select("message_id", "action").collect()), str(tmp_path / "c"))
    q.awaitTermination(120)
    expected = moderation.decided(features.with_text(messages)).select("message_id", "action").collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, expected))


def test_store(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    meta = tables.replace(a, str(tmp_path / "t"), "catalog", "2026-01-01").first()
    assert meta["item_count"] == 2
    tables.append(spark.createDataFrame([(3, "z")], "id int, v string"), str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.count() == 3 and tables.point(stored, id=2).first()["v"] == "y" and tables.optional(stored, id=None, v="z").count() == 1


def test_weights_are_complete():
    assert len(fixed.RULE_WEIGHTS) == 21 and len(fixed.SIGNALS) == 23


def test_phrases_are_literal(spark):
    df = spark.createDataFrame([("100% sure",), ("100 percent",), ("a_b",), ("axb",)], "t string")
    assert [r[0] for r in tables.contains_search(df, "t", "100%").collect()] == ["100% sure"]
    assert [r[0] for r in tables.contains_search(df, "t", "A_B").collect()] == ["a_b"]


def test_row_similarities(spark):
    """In a message's row the same as by joins."""
    texts = ["claim your reward now now", "lunch at noon", "reward reward lunch", "", "zzz yyy"]
    messages = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "message_id long, group_id long, text string")
    rows = [(i, g, "spam" if i % 2 else "not_spam", t, i + 1) for g in (0, 1) for i, t in enumerate(["lunch is at noon", "claim a reward", "noon lunch", "reward now", "team lunch now", "connect wallet now", "other words", "claim claim now", "wallet", "big reward claim"])]
    examples = spark.createDataFrame(rows, "example_id long, scope_group long, label string, example_text string, age int")
    expected = {(r["message_id"], r["label"]): round(r["similarity"], 9) for r in retrieval.best_similarities(messages, examples).collect()}
    for r in retrieval.with_similarities(messages, examples).collect():
        assert (round(r["spam_similarity"], 9), round(r["ham_similarity"], 9)) == (expected[r["message_id"], "spam"], expected[r["message_id"], "not_spam"])


def test_merging_keeps_ids(spark):
    """Ids over 2**53 beside rows without one."""
    big = (1 << 60) + 1
    rows = [(1, 5, "request", "open", None, big, "a", "Dark season 1", None, None, None), (2, 5, "request", "open", big + 2, None, "b", "Dark", None, big + 4, None), (3, 5, "request", "open", 7, 8, "c", "Silo", None, None, None)]
    df = spark.createDataFrame(rows, "seq long, group_id long, kind string, status string, message_id long, sender_id long, text string, title_query string, matched_title string, matched_id long, category string")
    got = {r["item_id"]: r for r in merging.merged(df).collect()}
    assert (got[1]["first_message"], got[1]["first_sender"], got[1]["matched_id"], got[1]["occurrence_count"]) == (big + 2, big, big + 4, 2)
    assert (got[3]["first_message"], got[3]["first_sender"], got[3]["matched_id"]) == (7, 8, None)


def test_cache_by_time(spark):
    """A fetch serves its key until its time is over; without a time to live nothing is kept."""
    calls = spark.createDataFrame([(1, "x", 0), (2, "x", 0), (3, "x", 9), (4, "x", 10), (5, "y", 11), (6, None, 1), (7, None, 2), (8, "x", 19), (9, "x", 30)], "id int, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    tell = lambda ttl: {r["id"] for r in stateful.cached(calls, "key", "ts", "id", ttl).where("fetched").collect()}
    assert tell(10) == {1, 4, 5, 6, 9}
    assert tell(0) == set(range(1, 10))
    assert stateful.cached(calls.where("false"), "key", "ts", "id", 10).collect() == []


def test_settings(spark):
    assert one(spark, None, lambda c: settings.flag(c, True)) and not one(spark, "", lambda c: settings.flag(c, True)) and one(spark, "\tOn\n", settings.flag)
    assert one(spark, " 3;1,,3 ", settings.ids) == [1, 3] and one(spark, None, settings.words) == [] and one(spark, "", lambda c: settings.number(c, F.lit(5))) == 5
    assert tuple(one(spark, "postgres://a:b@h:1/d?x=1", settings.database)) == ("jdbc:postgresql://h:1/d?x=1", "a", "b")
