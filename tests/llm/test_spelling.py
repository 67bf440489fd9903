"""Near words, forms and roots, against comparing all pairs."""

from __future__ import annotations

import collections
import random
import re
import zlib

from larkspur.llm import common, spelling


def is_near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words: dict[str, int], ratio: int = 5) -> list[tuple]:
    form, rows = {}, []
    for w, n in words.items():
        near = [x for x in words if is_near(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        rows.append((w, n, len(near)))
    def root(w):  # noqa: E306
        return w if form[w] is None else root(form[w])
    return sorted(((w, form[w], root(w), n, k, words.get(form[w])) for w, n, k in rows), key=repr)


def test_variants(spark):
    random.seed(5)
    words = {}
    for _ in range(700):  # few letters: many near words, anagrams and double letters
        words["".join(random.choice("abb") for _ in range(random.randint(1, 7)))] = random.choice([1, 1, 5, 6, 25, 30, 125, 700])
    for w in ("ñandú", "nandú", "ñandu", "ñnandú", "😀abc", "😁abc", "abc", "ab c", "", "c" * 300, "c" * 301, "c" * 299 + "d"):
        words[w] = random.choice([1, 5, 50])
    df = spark.createDataFrame([*words.items(), (None, 3)], "word string, n long").selectExpr("*", "1 as key", "'x' as letter")
    got = sorted(map(tuple, spelling.variants(df).collect()), key=repr)
    assert got == brute(words) and any(r[1] and r[2] != r[1] for r in got)
    assert spelling.variants(df.where("false")).count() == 0


def test_anagrams_stay_apart(spark):
    """A large class of anagrams and of words that share all letters but one: only letter order tells who is near."""
    random.seed(6)
    words = {"".join(random.sample("abcdefgh", 8)): 5 for _ in range(1500)}
    words |= {w[:7] + "z": 30 for w in list(words)[:500]}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(df).collect()), key=repr) == brute(words)


def test_word_counts(odd, none):
    for misspelt in (0, 3):
        expected = collections.Counter()
        for r in odd.select("doc_id", "text").collect():
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
            for run in re.findall("[A-Za-zÀ-ÿ]+", low):
                h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
                if misspelt and h % misspelt == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 6:
                    expected[run] += 1
        assert {r["word"]: r["n"] for r in spelling.word_counts(odd, misspelt=misspelt).collect()} == expected
    assert spelling.word_counts(none).count() == 0


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    """Small files of many words: Spark would broadcast them through the driver."""
    words = [(w, n) for i in range(300) for w, n in ((f"word{i:05d}", 30), (f"word{i:05d}x", 5), (f"word{i:05d}xy", 1))]
    plans, write = [], spelling.stored
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(spelling, "stored", lambda df, name: write(plan(df), name))
    out = plan(spelling.variants(spark.createDataFrame(words, "word string, n long")))
    assert out.where("root like 'word_____'").count() == len(words)
    assert len(plans) > 4 and not [p for p in plans if "Broadcast" in p]


def test_salted_rows_are_not_broadcast(spark, tmp_path):
    spark.range(1000).selectExpr("id as k", "id as v").write.parquet(str(tmp_path / "few"))
    few = spark.read.parquet(str(tmp_path / "few"))
    found = common.looked_up(spark.range(2000).selectExpr("id as k", "id as x"), few, "k", n_few=common.SMALL_ROWS + 1)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1000
