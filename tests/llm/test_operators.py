"""Operators against brute force, on texts with everything odd in them, and on empty tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import os
import random
import time
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import bpe, common, components, language, ngram_lm, packing, quality, search, simhash, substring, suffixes, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
sha = lambda b: hashlib.sha256(b).hexdigest()


def texts(df) -> list[tuple]:
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


def tokenizer() -> Tokenizer:
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_lm_scores(odd, none):
    got = {}
    for r in ngram_lm.scores(odd, order=3, weight=2.0).collect():
        got.setdefault(r["doc_id"], r)
    tokens = [(d, t.encode().lower().split() + ["END"]) for d, t in texts(odd)]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = collections.Counter()
    for d, t in tokens:
        if not held(d):
            line = ["END", *t]
            c.update((w,) for w in t)
            for n in (2, 3):
                c.update(tuple(line[i : i + n]) for i in range(len(line) - n + 1))
    n_tokens, n_words, k = sum(v for g, v in c.items() if len(g) == 1), sum(len(g) == 1 for g in c), 2.0
    for d, t in tokens:
        base = score = 0.0
        for i, w in enumerate(t):
            line = ["END", *t[: i + 1]]
            p = (c[(w,)] + 1) / (n_tokens + n_words + 1)
            base += math.log10(p)
            for n in (2, 3):
                if len(line) >= n:
                    h = tuple(line[-n:-1])
                    p = (c[(*h, w)] + k * p) / (c[h] + k)
            score += math.log10(p)
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(d), len(t), sum(c[(w,)] > 0 for w in t), n_tokens)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
    assert ngram_lm.scores(none).count() == 0


def test_lm_lanes(monkeypatch):
    """Lanes end in the states that whole texts are in."""
    random.seed(9)
    raws = [" ".join(random.choice("abcd") for _ in range(n)).encode() for n in (0, 1, 2, 40, 41, 42, 200)]
    for order in (1, 2, 3, 4):
        grams = ngram_lm.Grams(raws, order)
        counts = grams.training_counts(np.arange(len(raws)) % 3 > 0)
        automaton = ngram_lm.Automaton(grams, counts, int(counts[0].sum()), int((counts[0] > 0).sum()), 2.0)
        whole = automaton.read()
        for lane in (4, 7, 41):
            monkeypatch.setattr(ngram_lm, "LANE", lane)
            assert np.array_equal(automaton.read(), whole)


def test_automaton_sums_to_one():
    """From any state the arcs of all words, and what an unseen word gets, sum to 1."""
    for order in (1, 2, 3):
        grams = ngram_lm.Grams([b"a b a c", b"a b b"], order)
        table = {k: c for keys, counts in zip(grams.keys, grams.training_counts(np.array([True, True])), strict=True) for k, c in zip(keys.tolist(), counts.tolist(), strict=True)}

        def last(text):
            probe = ngram_lm.Grams([text], order)
            counts = [np.array([table.get(k, 0) for k in keys.tolist()], np.uint64) for keys in probe.keys]
            return ngram_lm.Automaton(probe, counts, 9, 4, 3.0).read()

        for context in (b"", b"a", b"a b", b"b b", b"c c", b"x", b"a x", b"b a"):
            n = len(context.split())
            words = [math.exp(last(context + b" " + w)[n]) for w in (b"a", b"b", b"c", b"unseen")]
            assert sum(words) + math.exp(last(context)[n]) == pytest.approx(1.0)


def test_lm_keys():
    random.seed(3)
    for n in (0, 1, 5, 1000):
        keys = np.unique(np.array([random.getrandbits(64) for _ in range(n)], np.uint64))
        assert np.array_equal(ngram_lm.keys_of(ngram_lm.key_bytes(keys), len(keys)), keys)
        counts = np.array([random.choice([0, 1, 2, 254, 255, 256, 10**12]) for _ in range(n)], np.uint64)
        assert np.array_equal(ngram_lm.unsqueezed(ngram_lm.squeezed(counts), n), counts)


def test_toxicity_learns_pairs():
    """Two terms that mean something only together: additive weights can't tell."""
    random.seed(1)
    noise = [f"w{i}" for i in range(60)]
    data = []
    for _ in range(3000):
        a, b = random.random() < 0.5, random.random() < 0.5
        words = random.sample(noise, 8) + ["insult"] * a + ["group"] * b
        data.append((" ".join(words), float(a and b or not a and not b)))
    x = [toxicity.terms_of(t.encode()) for t, _ in data]
    y = np.array([v for _, v in data])
    model = toxicity.fit(x[:2000], y[:2000])
    right = (model.raw(x[2000:]) > 0) == (y[2000:] > 0.5)
    assert right.mean() > 0.9


def test_toxicity_pair_sum():
    """Scores are those of an explicit sum over pairs."""
    rng = np.random.default_rng(2)
    model = toxicity.Model(0.3, np.arange(0, 40, 2), rng.normal(size=20), rng.normal(size=(20, 4)))
    rows = [np.sort(rng.choice(50, size=n, replace=False)) for n in (0, 1, 2, 7, 30)]
    for row, raw in zip(rows, model.raw(rows), strict=True):
        at = [t // 2 for t in row.tolist() if t % 2 == 0 and t < 40]
        pairs = sum(float(model.v[s] @ model.v[t]) for s, t in itertools.combinations(at, 2))
        assert raw == pytest.approx(0.3 + sum(model.w[s] for s in at) + pairs)


def test_telling_pairs():
    """The score test of all pairs, over several tiles, against a loop."""
    rng = np.random.default_rng(4)
    x = rng.random((600, 30)) < 0.2
    y = (rng.random(600) < np.where(x[:, 3] & x[:, 17], 0.9, 0.2)).astype(float)
    p = np.full(600, y.mean())
    owner, flat = np.nonzero(x)
    limit, expected = np.sqrt(2 * np.log(30 * 29 / 2)) + 1, set()
    for s, t in itertools.combinations(range(30), 2):
        both = x[:, s] & x[:, t]
        if both.sum() >= 5 and abs((p - y)[both].sum()) >= limit * np.sqrt((p * (1 - p))[both].sum()):
            expected |= {s, t}
    assert {3, 17} <= expected
    for tile in (7, 1024):
        assert set(toxicity.telling_pairs(owner, flat, p - y, p, 30, 5, tile).tolist()) == expected


def test_toxicity_table(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/../sf0.01/{n}.parquet") for n in ("documents", "labels"))
    out = toxicity.scored(docs, toxicity.learnt(docs, labels))
    insults = "loser idiot pathetic scum worthless moron clown trash disgusting stupid".split()
    for r in out.join(docs.select("doc_id", "text"), "doc_id").collect():
        words = {w.strip("!%$&#*.,").lower() for w in r["text"].split()}
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if len(words & set(insults)) >= 3:
            assert r["predicted"] == 1, r["doc_id"]
    truth = out.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] for r in truth if r["toxic"] == 0) <= 2


def test_toxicity_reader():
    """The reader of a model finds the terms that terms_of() gives."""
    text = "Idiots! idiots, idiotic idiotish are ALL idiotical (here) ... achlichä achlichö".encode()
    terms = toxicity.terms_of(text)
    for chosen in (terms, terms[::2], terms[1::3], terms[:0]):
        model = toxicity.Model(0.0, chosen, np.ones(len(chosen)), np.zeros((len(chosen), 1)))
        assert chosen[model.reader()(text)].tolist() == chosen.tolist()


def test_toxicity_odd(odd, none, labels):
    model = toxicity.learnt(odd, labels)
    out = toxicity.scored(odd, model)
    assert out.count() == odd.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.scored(none, model).count() == 0
    empty = toxicity.learnt(odd, labels.where("false"))
    assert {r["predicted"] for r in toxicity.scored(odd, empty).collect()} == {0}


def test_toxicity_is_fit_in_a_task(spark, monkeypatch):
    """The driver neither gets the terms of the sample nor fits; the model is that of fit(), whatever order the rows come in."""
    rows = [(i, f"w{i % 7} w{i % 5} some other words " + ("loser idiot" if i % 4 == 0 else "nice people")) for i in range(60)] + [(3, "a second text idiot"), (3, "w1 a third one")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")
    learning = [(i, t) for i, t in sorted(rows) if zlib.crc32(str(i).encode()) % 4 != 2]
    order = sorted(learning, key=lambda r: (r[0], xxhash.xxh64_intdigest(toxicity.terms_of(r[1].encode()).tobytes())))
    expected = toxicity.fit([toxicity.terms_of(t.encode()) for _, t in order], np.array([float(i % 4 == 0) for i, _ in order]))
    here, fitted_to = os.getpid(), toxicity.fitted_to

    def elsewhere(*args, **how):
        assert os.getpid() != here
        return fitted_to(*args, **how)

    monkeypatch.setattr(toxicity, "fitted_to", elsewhere)
    for docs in (rows, rows[::-1]):
        model = toxicity.learnt(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), labels)
        assert model.w0 == expected.w0 and len(model.terms)
        assert all((getattr(model, k) == getattr(expected, k)).all() for k in ("terms", "w", "v"))


def test_toxicity_fit_in_little_memory():
    """The terms are held once, then places of 32 bits; steps read a stretch of them (24 and 28 bytes a pair before)."""
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 4000, 800)) << 20 for _ in range(1500)]
    y, pairs = (rng.random(1500) < 0.2).astype(float), sum(map(len, rows))
    tracemalloc.start()
    try:
        made = toxicity.as_terms(rows, 5)
        first = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        toxicity.fitted_to(*made, y, rounds=2, pair_rows=200)
        assert first < 21 * pairs and tracemalloc.get_traced_memory()[1] < 21 * pairs
    finally:
        tracemalloc.stop()


def test_toxicity_carries_a_text_once(spark, odd):
    """A carried text isn't sent to Python a second time, and scores are those without it."""
    model = toxicity.Model(-1.0, np.unique(np.concatenate([toxicity.terms_of(b"word changed"), toxicity.terms_of(b"line")])), np.ones(0), np.zeros((0, 1)))
    model.w, model.v = np.ones(len(model.terms)), np.zeros((len(model.terms), 1))
    plain, with_text = toxicity.scored(odd, model), toxicity.scored(odd, model, carry=("text", "lang"))
    assert "raw_" not in with_text._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted((tuple(r)[:4] for r in with_text.collect()), key=repr)
    assert sorted(with_text.select("doc_id", "text").collect(), key=repr) == sorted(odd.select("doc_id", "text").collect(), key=repr)


def test_stored_leaves_no_shuffles(spark):
    def left():
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in dirs for f in Path(d).rglob("shuffle_*.data")}

    before = left()
    there = common.stored(spark.range(20_000).repartition(3, "id").groupBy("id").count(), "unshuffled")
    until = time.time() + 20
    while left() - before and time.time() < until:
        time.sleep(0.2)
    assert not left() - before and there.count() == 20_000
    assert spark.conf.get(common.SHUFFLES_GO, "false") == "false"


def brute_repeats(all_texts, least):
    seen = collections.Counter(b[i : i + least] for _, b in all_texts for i in range(len(b) - least + 1))
    out = []
    for d, b in all_texts:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i] += 1
                gone[i + least] -= 1
        g = np.cumsum(gone)[:-1] > 0
        spans = sum(1 for i in range(len(b)) if g[i] and (i == 0 or not g[i - 1]))
        out.append((d, len(b), int(g.sum()), spans, sha(bytes(x for x, y in zip(b, g, strict=True) if not y))))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "gram", "hot", "crowd"), [(200, 32, 20_000, 256), (200, 32, 1, 256), (40, 8, 20_000, 256), (40, 16, 1, 1), (40, 16, 20_000, 1)])
def test_suffix_dedup(odd, none, least, gram, hot, crowd):
    expected = brute_repeats([(d, t.encode()) for d, t in texts(odd)], least)
    assert rows(suffixes.cleaned(odd, least, gram, hot, crowd)) == expected
    assert suffixes.cleaned(none, least, gram, hot, crowd).count() == 0


@pytest.mark.parametrize("crowd", [256, 3])
def test_suffix_dedup_of_crowds(spark, crowd):
    """A passage in many different surroundings, cut at its ends by some bytes, and copies of it."""
    random.seed(8)
    letters = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    passage = letters(300)
    data = [(i, letters(random.randint(0, 120)) + passage[random.randint(0, 60) : 300 - random.randint(0, 60)] + letters(random.randint(0, 120))) for i in range(60)]
    data += [(100 + i, data[i][1]) for i in range(5)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    expected = brute_repeats([(d, t.encode()) for d, t in data], 200)
    assert sum(r[2] for r in expected) > 3000
    assert rows(suffixes.cleaned(df, crowd=crowd)) == expected


def test_anchors_are_found_once(odd):
    """What a group stores of its anchors, read again without hashing, is what hashing gives."""
    raws = [t.encode() for _, t in texts(odd)]
    for some in (raws, [], [b"", b"x"]):
        found = suffixes.Anchors(some, 200, 32)
        again = suffixes.Anchors(some, 200, 0, found=found.packed())  # hashing with this gram would fail
        assert all((getattr(found, k) == getattr(again, k)).all() for k in ("place", "first", "last", "anchor", "stretch", "which", "example", "entry_keys", "entry_twice"))
    assert suffixes.SLICE <= 1 << 20


def test_lpf():
    random.seed(2)
    for _ in range(60):
        n = random.randint(0, 40)
        t = np.array([random.randint(0, 2) for _ in range(n)], np.int64)
        expected = [max([0, *(next((k for k in range(n - i) if t[i + k] != t[j + k]), n - i) for j in range(i))]) for i in range(n)]
        assert suffixes.lpf(t).tolist() == expected
        order, _ = suffixes.suffix_order(t)
        assert order.tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
        least = random.randint(1, 5)
        starts = np.arange(max(0, n - least + 1))
        words = collections.Counter(tuple(t[i : i + least]) for i in starts)
        assert suffixes.repeats(t, least, starts).tolist() == [words[tuple(t[i : i + least])] > 1 for i in starts]


def test_window_order():
    """Windows in order of their bytes, ties by place, and their common prefixes."""
    random.seed(3)
    for _ in range(80):
        n, least = random.randint(0, 400), random.choice([1, 3, 8, 9, 17, 40, 140, 200])
        unit = [random.randint(0, 255) for _ in range(random.choice([1, 2, 7, 150]))]
        data = np.array([unit[i % len(unit)] if random.random() < 0.99 else random.randint(0, 255) for i in range(n)], np.uint8)
        starts = np.array([i for i in range(max(0, n - least + 1)) if random.random() < 0.8], np.int64)
        windows = [data[i : i + least].tobytes() for i in starts]
        order, common = suffixes.window_order(data, starts, least)
        assert order.tolist() == sorted(range(len(windows)), key=lambda i: (windows[i], i))
        for r in range(1, len(order)):
            a, b = windows[order[r - 1]], windows[order[r]]
            assert common[r] == next((k for k in range(least) if a[k] != b[k]), least)


def brute_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, covered = collections.Counter(three), set()
    for i, w in enumerate(three):
        if seen[w] > 1:
            covered |= {i, i + 1, i + 2}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality(spark, sf, odd, none):
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        out = quality.judged(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert rows(out) == sorted(((d, *brute_quality(t)) for d, t in texts(df)), key=repr)
    assert quality.judged(odd).where("base_failed and kept").count() == 0
    assert quality.judged(none).count() == 0


def brute_distances(groups, core=0.75, steps=3, prior=20.0):
    """{vector: squared distance} of each group {(lang, source): vectors}, step by step in numpy."""
    floors = np.diag(np.square(quality.FLOORS))
    factor = core / quality.chi_square_cdf(quality.chi_square_value(core, 4), 6)
    quantile = lambda v, q: np.sort(v)[max(0, math.ceil(q * len(v)) - 1)]

    def far(x, m, c):
        return np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)

    def step(x, m, c):
        d = far(x, m, c)
        inside = x[d <= quantile(d, core) * (1 + 1e-12)]
        return inside.mean(axis=0), np.cov(inside.T, bias=True) * factor + floors

    def estimate(x):
        m = np.array([quantile(v, 0.5) for v in x.T])
        d = np.sqrt((1.4826 * np.array([quantile(np.abs(v - a), 0.5) for v, a in zip(x.T, m, strict=True)])) ** 2 + np.square(quality.FLOORS))
        z = (x - m) / d
        r = (z * z).sum(axis=1)
        sign = np.where(r > 0, 1 / np.where(r > 0, r, 1), 0)[:, None] * z
        found = []
        for shape in (np.eye(4), 4 * sign.T @ z / len(x), np.tanh(z).T @ np.tanh(z) / len(x)):
            now = (m, shape * np.outer(d, d) + floors)
            now = step(x, *step(x, *now))
            found.append((round(0.5 * np.linalg.slogdet(now[1])[1], 9), len(found), now))
        now = min(found, key=lambda f: f[:2])[2]
        for _ in range(steps):
            now = step(x, *now)
        return now

    distinct = lambda rows_: np.array(sorted(set(rows_)))
    mix = lambda n, own, other: tuple((n * a + prior * b) / (n + prior) for a, b in zip(own, other, strict=True))
    whole = estimate(distinct(v for vs in groups.values() for v in vs))
    out = {}
    for (lang, source), vs in groups.items():
        of_lang = distinct(v for (g, _), more in groups.items() for v in more if g == lang)
        own = distinct(vs)
        now = mix(len(own), estimate(own), mix(len(of_lang), estimate(of_lang), whole))
        out[lang, source] = dict(zip(map(tuple, own.tolist()), far(own, *now), strict=True))
    return out


def test_quality_distances(spark, sf):
    """Distances and verdicts against the same estimate in numpy; groups of 1 to some hundred vectors."""
    random.seed(12)
    word = lambda n: "".join(random.choice("abcdefghij") for _ in range(random.randint(n, n + 4)))
    data = []
    for lang, source, many, n in (("en", "a", 90, 3), ("en", "b", 12, 3), ("en", "c", 1, 3), ("de", "a", 40, 6), ("de", "b", 5, 6), (None, "a", 3, 4), ("fr", None, 2, 5)):
        for _ in range(many):
            text = " ".join(word(n) + random.choice(["", "", "", "", "$", "#*"]) for _ in range(random.randint(60, 140)))
            line = word(n) + " " + word(n) + " " + word(n) + " " + word(n)
            data.append((len(data), text + f"\n{line}" * random.choice([0, 0, 0, 2, 3]), lang, source))
    data += [(len(data) + i, "***".join(word(3) + " " for _ in range(90)), "en", "a") for i in range(4)] + data[:6]
    schema = "doc_id long, text string, lang string, source string"
    for df in (spark.createDataFrame(data, schema), spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")):
        got = quality.judged(df).collect()
        rate = lambda r, c: math.log1p(100.0 * r[c] / r["n_words"])
        vector = lambda r: (math.log(r["word_chars"] / r["n_words"]), rate(r, "n_symbols"), rate(r, "n_dup_lines"), rate(r, "n_repeat_words"))
        groups = collections.defaultdict(list)
        for r in got:
            if not r["base_failed"]:
                groups[r["lang"], r["source"]].append(vector(r))
        expected = brute_distances(groups)
        for r in got:
            if r["base_failed"]:
                assert r["distance"] is None and not r["kept"]
            else:
                d = expected[r["lang"], r["source"]][vector(r)]
                assert r["distance"] == pytest.approx(d, rel=1e-6, abs=1e-9)
                assert r["kept"] == (d <= quality.chi_square_value(1 - 1e-9, 4))


def test_quality_outliers(spark):
    """Vectors of one kind and a few far off, with copies; the outliers go, in their group only."""
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randint(3, 7)))
    data = [(i, " ".join(word() for _ in range(120)), "en", "s") for i in range(150)]
    data += [(1000 + i, " ".join(word() + "***" for _ in range(120)), "en", "s") for i in range(12)]
    data += [(2000 + i, data[0][1], "en", "s") for i in range(300)]
    out = quality.judged(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"))
    assert {r["doc_id"] for r in out.where("not kept").collect()} == {1000 + i for i in range(12)}


def test_chi_square():
    assert quality.chi_square_value(0.95, 4) == pytest.approx(9.4877, abs=1e-3)
    assert quality.chi_square_value(0.75, 4) == pytest.approx(5.3853, abs=1e-3)


def check_packing(out, all_texts, size):
    t = tokenizer()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    ids = collections.defaultdict(list)
    for d, text in all_texts:
        ids[d].append([*t.encode(text, add_special_tokens=False).ids, 0])
    for d, lists in ids.items():
        assert sum(r["length"] for r in by_doc[d]) == sum(map(len, lists))
        if len(lists) == 1:
            pieces = sorted(by_doc[d], key=lambda r: r["piece"])
            assert [r["piece"] for r in pieces] == list(range(len(pieces)))
            assert len(pieces) == -(-len(lists[0]) // size)
            at = 0
            for r in pieces:
                part = np.array(lists[0][at : at + r["length"]], "<u4").tobytes()
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part)
                assert r["piece"] == 0 or r["length"] == size
                at += r["length"]
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_sequence), sum(r["length"] for r in out)


def test_packing(odd, none, spark, sf):
    check_packing(packing.packed(odd, PATH, 256).collect(), texts(odd), 256)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    used, total = check_packing(packing.packed(docs, PATH).collect(), texts(docs), 2048)
    assert used <= -(-total // 2048) + 2
    assert packing.packed(none, PATH).count() == 0


def test_packing_tree(odd, monkeypatch):
    """Many parts, merged over several rounds."""
    monkeypatch.setattr(packing, "PART_BYTES", 1)
    monkeypatch.setattr(packing, "in_bytes", lambda df: 30)
    docs = odd.where("doc_id is not null")
    used, total = check_packing(packing.packed(docs, PATH, 512, fan=3, carry=4).collect(), texts(docs), 512)
    assert used <= -(-total // 512) + 2


def test_packing_keeps_ids(spark):
    """Ids over 2**53 beside rows without one."""
    data = [((1 << 60) + 1, "a b c"), (None, "d e"), ((1 << 60) + 3, "f"), (None, None), (-(1 << 60) - 1, "g")]
    out = packing.packed(spark.createDataFrame(data, "doc_id long, text string"), PATH, 16).collect()
    assert sorted((r["doc_id"] for r in out), key=repr) == sorted((d for d, _ in data), key=repr)


def test_packing_rounds(spark, monkeypatch):
    """One bin at most half full in each of many parts: all that can join do, over four rounds, and full bins stay where they are."""
    monkeypatch.setattr(packing, "PART_BYTES", 1)
    monkeypatch.setattr(packing, "in_bytes", lambda df: 40)
    random.seed(5)
    data = [(i, " ".join(random.choice(["the", "of", "and"]) for _ in range(random.choice([5, 9, 14, 30])))) for i in range(200)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for carry in (3, 1000):  # no two sequences that are left would fit into one
        out = packing.packed(df, PATH, 64, fan=3, carry=carry).collect()
        check_packing(out, data, 64)
        held = collections.Counter()
        for r in out:
            held[r["sequence_id"]] += r["length"]
        assert sum(sorted(held.values())[:2]) > 64
    with pytest.raises(ValueError):
        packing.packed(df, PATH, 64, fan=8, carry=7)


def test_best_fit_order():
    bins, offsets, held = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8] and held == [10, 10]


def test_bpe(odd, none):
    t = tokenizer()
    expected = []
    for d, text in texts(odd):
        ids = t.encode(text, add_special_tokens=False).ids
        expected.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())))
    assert rows(bpe.encoded(odd, PATH)) == sorted(expected, key=repr)
    assert bpe.encoded(none, PATH).count() == 0


def test_bpe_remembers():
    """A worker keeps one codec; words of plain letters are one pre-token, long and short ones, as the library has them."""
    assert bpe.codec_for(PATH) is bpe.codec_for(PATH)
    t, codec = tokenizer(), bpe.BpeCodec(PATH)
    assert codec.plain_letters
    for text in ("a plain wordlike thing", "it 's don't ll", " lead", "x " + "ab" * 3000 + " y", "ab cd  ef", "Straße naïve ok", "a endoftext <|endoftext|>b c"):
        for _ in range(2):
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_bpe_random():
    t, codec, fast = tokenizer(), bpe.BpeCodec(PATH, memo=50), packing.FastEncoder(PATH)
    random.seed(4)
    signs = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "ß", "你", "🎉", "'s", "'", "12", ".", "<|endoftext|>", " ", "\x85", "​", "Ⅷ", "٣", "힣"]
    for _ in range(600):
        text = "".join(random.choice(signs) for _ in range(random.randint(0, 14)))
        ids = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids, repr(text)
        assert fast.encode(text).tolist() == ids, repr(text)
        assert codec.decode(codec.encode(text)) == t.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize(("dense_bytes", "segment_bytes"), [(48 << 20, 10 << 20), (0, 10 << 20), (700, 5000)])
def test_search(spark, odd, none, monkeypatch, dense_bytes, segment_bytes):
    monkeypatch.setattr(search, "SEGMENT_BYTES", segment_bytes)
    monkeypatch.setattr(search, "QUERY_BYTES", segment_bytes)
    random.seed(6)
    more = [(100 + i, " ".join(random.choice("abcdefghijkl") + random.choice(["", "1", "2"]) for _ in range(random.randint(1, 60)))) for i in range(120)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    counts = [(d, collections.Counter(w), len(w)) for d, w in ((d, t.encode().lower().split()) for d, t in texts(docs)) if d is not None]
    df = collections.Counter(x for _, c, _ in counts for x in c)
    n, mean = len(counts), sum(x for _, _, x in counts) / len(counts)
    expected = collections.Counter()
    for q, qc, _ in counts:
        if q % 4 == 0:
            scored = [(-round(sum(k * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * x / mean)) for w, k in qc.items() if w in c), 6), d) for d, c, x in counts]
            expected.update((q, rank + 1, d, -s) for rank, (s, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:3]))
    assert collections.Counter(map(tuple, search.top_k(docs, every=4, k=3, dense_bytes=dense_bytes).collect())) == expected
    assert search.top_k(none).count() == 0


def test_search_answers_blocks_in_turn(odd, monkeypatch):
    """Each block of queries is ranked and written before the next, so the disk has the shuffles of one."""
    docs = odd.select("doc_id", "text")
    whole = rows(search.top_k(docs, every=2, k=3))
    blocks, write = [], search.stored

    def kept(df, name):
        out = write(df, name)
        if name == "ranked":
            blocks.append({r[0] for r in out.select("query_id").collect()})
        return out

    monkeypatch.setattr(search, "QUERY_BYTES", 3000)
    monkeypatch.setattr(search, "stored", kept)
    assert rows(search.top_k(docs, every=2, k=3)) == whole
    assert len(blocks) > 2 and sum(map(len, blocks)) == len(set().union(*blocks)) == len({r[0] for r in whole})


def test_substring(odd, none, spark, sf):
    for df, window, first in ((odd, 13, 7), (odd, 13, 2), (odd, 13, 13), (odd, 50, 7), (odd, 3, 2), (odd, 4, 1), (odd, 200, 4), (spark.read.parquet(f"{sf}/documents.parquet"), 13, 7)):
        words = [(d, t.encode().split()) for d, t in texts(df)]
        least = {}
        order = lambda d: math.inf if d is None else d
        for d, w in words:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                least[key] = min(least.get(key, math.inf), order(d))
        expected = []
        for d, w in words:
            gone = [False] * len(w)
            for i in range(len(w) - window + 1):
                if least[tuple(w[i : i + window])] < order(d):
                    gone[i : i + window] = [True] * window
            expected.append((d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
        assert rows(substring.deduplicated(df, window, first)) == sorted(expected, key=repr)
    assert substring.deduplicated(none).count() == 0


def test_ladder(spark):
    assert substring.ladder(13, 7) == [7, 13] and substring.ladder(13, 2) == [2, 4, 7, 13] and substring.ladder(5, 9) == [5] and substring.ladder(1, 0) == [1]
    different = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(6)], "doc_id long, text string")
    out = substring.deduplicated(different, 13, 2).collect()  # no candidates survive the first level
    assert len(out) == 6 and {r["n_removed"] for r in out} == {0}


def brute_fingerprint(text, width):
    import xxhash

    w = text.encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fp):
    ids = sorted(fp)
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fp[a] ^ fp[b]).count("1") <= 4:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: top(i) for i in ids}


@pytest.mark.parametrize(("chunk", "paired"), [(8192, simhash.PAIRED), (2, simhash.PAIRED), (8192, 1), (2, 1)])
def test_simhash(odd, none, chunk, paired):
    docs = odd.where("doc_id is not null")
    fp = {d: brute_fingerprint(t, 4) for d, t in texts(docs)}
    top = brute_components(fp)
    out = simhash.near_duplicates(odd, chunk=chunk, paired=paired)
    assert out.count() == odd.count()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in out.where("doc_id is not null").collect()} == {(d, f"{fp[d]:016x}", top[d]) for d in fp}
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("chunk", "paired"), [(8192, simhash.PAIRED), (8, simhash.PAIRED), (8192, 1), (8, 1)])
def test_simhash_links(spark, chunk, paired):
    """Chains and clusters of fingerprints at distances around the threshold."""
    random.seed(7)
    fp, n = {}, 0
    for _ in range(25):
        x = random.getrandbits(64)
        for _ in range(8):
            fp[n] = x
            n += 1
            for b in random.sample(range(64), random.choice([0, 1, 3, 4, 5])):
                x ^= 1 << b
    reps = {}
    for i, f in fp.items():
        reps.setdefault(f, i)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for f, i in reps.items()], "fp long, rep long")
    found = {r["node"]: r["component"] for r in components.components(simhash.links(df, 4, chunk, paired)).collect()}
    expected = brute_components({i: f for f, i in reps.items()})
    assert {i: found.get(i, i) for i in expected} == expected


def test_golay_covers():
    """Every value is within 3 of just one codeword; values 1 apart share an anchor."""
    random.seed(3)
    x = np.array([random.getrandbits(64) for _ in range(500)], np.uint64)
    y = x ^ np.array([1 << random.randrange(64) for _ in range(500)], np.uint64)
    sets = []
    for v in (x, y):
        row, key = simhash.anchors(v)
        got = collections.defaultdict(set)
        for r, k in zip(row.tolist(), key.tolist(), strict=True):
            got[r].add(k)
        sets.append(got)
    assert all(len({k >> 23 for k in sets[0][i] & sets[1][i]}) == 3 for i in range(500))
    start, count, _ = simhash.golay_errors(3)
    assert count.tolist() == [1] * 2048 and len(start) == 2048


def test_paired_anchors():
    """Fingerprints up to 4 bits apart share an anchor of two blocks, wherever the bits are."""
    random.seed(4)
    x = np.array([random.getrandbits(64) for _ in range(400)], np.uint64)
    y = x.copy()
    for i in range(400):
        at = random.choice([0, 23, 46])  # half of them with all bits in one block
        y[i] ^= np.uint64(sum(1 << b for b in (random.sample(range(64), 4) if i % 2 else random.sample(range(at, min(at + 23, 64)), 4))))
    keys = [collections.defaultdict(set), collections.defaultdict(set)]
    for got, v in zip(keys, (x, y), strict=True):
        for r, k in zip(*(a.tolist() for a in simhash.paired_anchors(v)), strict=True):
            got[r].add(k)
    assert all(keys[0][i] & keys[1][i] for i in range(400))


def test_language(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    field = language.learnt(docs, sample=60, n=1500)
    out = language.predicted(docs, field).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)
    got = {r["doc_id"]: r for r in language.predicted(odd, field).collect()}
    assert {d for d, r in got.items() if r["lang_pred"] == "und"} == {5, 6, 7, 15}
    assert language.predicted(none, field).count() == 0
    nothing = language.learnt(none)
    assert {r["lang_pred"] for r in language.predicted(odd, nothing).collect()} == {"und"}


def test_language_marginals():
    """Chunked forward-backward against sums over all label sequences, and against the plain recursion."""
    random.seed(1)
    rng = np.random.default_rng(0)
    k, lengths = 3, np.array([1, 5, 70, 33])
    e, trans = rng.normal(size=(int(lengths.sum()), k)), rng.normal(size=(k, k))
    got, at = language.marginals(e, np.exp(trans), lengths), 0
    for n in lengths.tolist():
        x, a = np.exp(e[at : at + n]), np.exp(trans)
        forward, backward = np.zeros((n, k)), np.ones((n, k))
        v = np.full(k, 1 / k)
        for t in range(n):
            v = forward[t] = (v @ a) * x[t]
            v = v / v.sum()
            forward[t] = v
        v = np.ones(k)
        for t in range(n - 1, -1, -1):
            backward[t] = v
            v = a @ (x[t] * v)
            v = v / v.sum()
        p = forward * backward
        assert np.allclose(got[at : at + n], p / p.sum(axis=1, keepdims=True))
        at += n


def test_language_marginals_by_enumeration():
    """Marginals of places and of transitions against sums over all label sequences."""
    rng = np.random.default_rng(5)
    k, n = 3, 6
    e, trans = rng.normal(size=(n, k)), rng.normal(size=(k, k))
    single, pair, z = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for labels in itertools.product(range(k), repeat=n):
        weight = math.exp(sum(e[i, a] for i, a in enumerate(labels)) + sum(trans[a, b] for a, b in itertools.pairwise(labels))) * np.exp(trans)[:, labels[0]].sum()
        z += weight
        for i, a in enumerate(labels):
            single[i, a] += weight
        for a, b in itertools.pairwise(labels):
            pair[a, b] += weight
    assert np.allclose(language.marginals(e, np.exp(trans), np.array([n])), single / z)
    assert np.allclose(language.pair_marginals(e[None], np.exp(trans)), pair / z)


def test_language_gradient():
    """Expected less observed features are the slope of the negative log-likelihood."""
    rng = np.random.default_rng(6)
    k, n = 3, 5
    e, trans, gold = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.integers(0, k, n)

    def loss(e, trans):
        v = np.exp(e[0]) * np.exp(trans).sum(axis=0)  # every label stands before the first alike
        for i in range(1, n):
            v = (v @ np.exp(trans)) * np.exp(e[i])
        own = sum(e[i, gold[i]] for i in range(n)) + sum(trans[gold[i], gold[i + 1]] for i in range(n - 1))
        return math.log(v.sum()) - own

    slope = language.marginals(e, np.exp(trans), np.array([n]))
    slope[np.arange(n), gold] -= 1
    for i, a in ((0, 1), (2, 0), (4, 2)):
        up, down = e.copy(), e.copy()
        up[i, a] += 1e-5
        down[i, a] -= 1e-5
        assert (loss(up, trans) - loss(down, trans)) / 2e-5 == pytest.approx(slope[i, a], abs=1e-6)


def test_language_predictions(spark, sf):
    """Labels and scores of texts against the plain recursion, word by word."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    field = language.learnt(docs, sample=40, n=600)
    got = {r["doc_id"]: r for r in language.predicted(docs, field).collect()}
    a = np.exp(field.trans)
    for d, t in texts(docs)[:60]:
        cores = [language.core(w) for w in t.encode().split()]
        if not any(cores):
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
            continue
        x = np.exp(field.emissions(cores))
        forward, v = [], np.full(len(field.languages), 1.0)
        for row in x:
            v = (v @ a) * row
            v = v / v.sum()
            forward.append(v)
        v, sums = np.ones(len(field.languages)), np.zeros(len(field.languages))
        for i in range(len(x) - 1, -1, -1):
            p = forward[i] * v
            sums += p / p.sum() * bool(cores[i])
            v = a @ (x[i] * v)
            v = v / v.sum()
        assert got[d]["lang_pred"] == field.languages[int(sums.argmax())]
        assert got[d]["score"] == pytest.approx(sums.max() / sum(map(bool, cores)))


def test_language_of_long_texts(spark):
    """A language that only has texts over `longest` bytes is learnt, with spaces or without."""
    random.seed(2)
    word = lambda letters: "".join(random.choice(letters) for _ in range(random.randint(2, 8)))
    data = [(i, " ".join(word("abcdefg") for _ in range(50)), "xx") for i in range(40)] + [(100 + i, " ".join(word("rstuvwx") for _ in range(4000)), "yy") for i in range(40)]
    data += [(200 + i, "".join(word("\u3042\u3044\u3046") for _ in range(900)), "zz") for i in range(40)]
    field = language.learnt(spark.createDataFrame(data, "doc_id long, text string, lang string"), sample=20, longest=2000, n=400)
    assert field.languages == ["xx", "yy", "zz"]
    probe = spark.createDataFrame([(1, "gfe abc dab", "xx"), (2, "xwv tuv rst", "yy"), (3, "\u3042\u3044\u3046\u3042", "zz")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.predicted(probe, field).collect()} == {1: "xx", 2: "yy", 3: "zz"}
    assert language.runs(b"a b c", 10, 1) == [b"a b c"] and sum(map(len, language.runs(b"ab " * 9000, 1600, 7))) <= 1600


def test_language_switches():
    """Words of two languages in one text are told apart."""
    en, de = [f"the{i}ing {i}tion" for i in range(40)], [f"die{i}ung {i}keit" for i in range(40)]
    field = language.fit([" ".join(en).encode()] * 4 + [" ".join(de).encode()] * 4, ["en"] * 4 + ["de"] * 4, bits=14, n=600)
    words = (en[3] + " " + en[5] + " " + de[1] + " " + de[2]).encode().split()
    p = language.marginals(field.emissions([language.core(w) for w in words]), np.exp(field.trans), np.array([len(words)]))
    assert [field.languages[i] for i in p.argmax(axis=1)] == ["en"] * 4 + ["de"] * 4


def test_components(spark):
    edges = [(i + 1, i) for i in range(300)] + [(1000, k) for k in range(1001, 1040)] + [(7, 7), (2000, 2001), (2001, 2000)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(301)} | {k: 1000 for k in range(1000, 1040)} | {2000: 2000, 2001: 2000}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_similar(texts_, width=5):
    """The smallest id reachable by exact Jaccard similarities of 0.8 or more, and the pairs under 1."""
    sets = {}
    for d, t in texts_:
        w = t.encode().lower().split()
        sets[d] = frozenset(b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1)) if w)
    first = {}
    for d in sorted(sets):
        first.setdefault(sets[d], d)
    holders = collections.defaultdict(list)
    for s, d in first.items():
        for x in s:
            holders[x].append(d)
    both = collections.Counter(p for h in holders.values() for p in itertools.combinations(sorted(h), 2))
    parent = {d: d for d in first.values()}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = [(a, b) for (a, b), n in both.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]
    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    return {d: top(first[s]) for d, s in sets.items()}, pairs


@pytest.mark.parametrize(("chunk", "cell"), [(8192, 1 << 20), (8, 300)])
def test_similar_documents(spark, odd, none, chunk, cell):
    """Pairs around 0.8 that are many bits apart, a chain, and odd rows."""
    random.seed(5)
    rows_, n = [(r["doc_id"], r["text"]) for r in odd.where("doc_id is not null").collect()], 100
    for changed in [0, 1, 2, 3, 4, 5, 6, 7, 8] * 4:  # of 300 words: similarities of 1 to about 0.75
        w = [f"w{random.randrange(10**6)}" for _ in range(300)]
        for step in range(3):
            rows_.append((n, " ".join(w)))
            n += 1
            for k in range(changed):
                w[20 + 35 * k + step] = f"v{random.randrange(10**6)}"
    expected, pairs = brute_similar([(d, t or "") for d, t in rows_])
    bits = [bin(brute_fingerprint(dict(rows_)[a] or "", 5) ^ brute_fingerprint(dict(rows_)[b] or "", 5)).count("1") for a, b in pairs]
    assert sum(b > 4 for b in bits) > 20
    df = spark.createDataFrame([*rows_, (None, rows_[-1][1])], "doc_id long, text string")
    got = simhash.similar_documents(df, chunk=chunk, cell=cell).collect()
    assert len(got) == len(rows_) + 1
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == expected
    assert simhash.similar_documents(none).count() == 0


def test_similar_documents_of_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    expected, _ = brute_similar([(r["doc_id"], r["text"] or "") for r in docs.collect()])
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()} == expected


def test_quality_of_small_groups(spark):
    """A small group is held against its language before the whole table."""
    random.seed(6)
    prose = lambda n: " ".join("".join(random.choice("abcdefghij") for _ in range(random.randint(n, n + 4))) for _ in range(random.randint(80, 160)))
    data = [(i, prose(3), "en", "s") for i in range(500)] + [(1000 + i, prose(14), "de", "s") for i in range(60)]
    data += [(2000 + i, prose(14), "de", "t") for i in range(10)] + [(3000, prose(3), "de", "t"), (4000, prose(14), "fr", "s")]
    out = quality.judged(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"))
    assert {r["doc_id"] for r in out.where("not kept").collect()} == {3000, 4000}


def test_search_of_repeated_rows(spark):
    """A query row that is there twice has two whole rankings."""
    data = [(16, "a b c d"), (16, "a b c d")] + [(i, " ".join("abcd"[: 1 + i % 4]) + f" x{i}") for i in range(17, 27)]
    got = search.top_k(spark.createDataFrame(data, "doc_id long, text string"), every=16, k=5).collect()
    assert sorted(r["rank"] for r in got) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert sorted((r["rank"], r["doc_id"]) for r in got)[:4] == [(1, 16), (1, 16), (2, 16), (2, 16)]
    assert len({r["doc_id"] for r in got}) == 4


def test_shared_folder(spark, monkeypatch):
    """A machine-local folder is for a local master only; what was stored can be removed."""
    df = common.stored(spark.range(3), "probe")
    path = df.inputFiles()[0]
    assert df.count() == 3 and os.path.exists(path.removeprefix("file:").replace("///", "/"))

    class Elsewhere:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = {}, Elsewhere  # noqa: RUF012

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)


def test_looked_up(spark, monkeypatch):
    """The salted join gives what the broadcast gives."""
    rows_ = spark.createDataFrame([(i % 3, i) for i in range(50)] + [(9, 99)], "k long, x long")
    few = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, y string")
    for how in ("inner", "left"):
        small = rows(common.looked_up(rows_, few, "k", how=how))
        monkeypatch.setattr(common, "SMALL_ROWS", 0)
        assert rows(common.looked_up(rows_, few, "k", how=how)) == small and len(small) == 50 + (how == "left")
        assert rows(common.without(rows_, few.select("k"), "k")) == [(9, 99)]
        monkeypatch.undo()


def test_memo_bytes():
    made = []
    memo = common.Memo(lambda k: made.append(k) or len(k), most=3, most_bytes=10)
    assert [memo[k] for k in ("a", "b", "a", "c", "d", "a", "x" * 9, "yy")] == [1, 1, 1, 1, 1, 1, 9, 2]
    assert len(memo) <= 3 and made == ["a", "b", "c", "d", "a", "x" * 9, "yy"]


def test_groups_without_ids(spark):
    """Rows without doc_id, or with one and the same, are dealt by their texts."""
    docs = spark.range(100_000).selectExpr("if(id % 2 = 0, null, 7) as doc_id", "concat('text ', id) as text")
    sizes = [r["n"] for r in common.grouped(docs, 64).groupBy("g").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * 100_000 / 64
