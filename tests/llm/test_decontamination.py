"""Phrases of test items in documents, against plain loops."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from larkspur.llm import contamination

from .conftest import PASSAGE, prose

ITEMS = [
    (1, PASSAGE), (2, "nothing of this is anywhere at all in these texts, not one word"), (3, " ".join(PASSAGE.split()[5:17])), (3, prose(16, 12)), (4, "word"), (5, "!!! ###"), (6, None), (7, ""),
    (None, prose(1, 30)), (10, "SAME line"), (8, PASSAGE), (9, "é" * 300 + " ñandú"), (11, prose(10, 11) + " " + prose(10, 11)),
]


def words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def windows(items: list[tuple], n: int) -> list[tuple]:
    """(item, words of a window, first place in the item) of each item's distinct windows."""
    out = {}
    for k, (_, text) in enumerate(items):
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            out.setdefault((k, tuple(w[i : i + n])), i)
    return [(k, w, i) for (k, w), i in out.items()]


def brute(docs: list[tuple], items: list[tuple], n: int) -> list[tuple]:
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k, window, _ in windows(items, n):
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(items[k][0])
        out.append((doc, len(w), len(hit), sorted(map(str, found - {None}))))
    return sorted(out, key=repr)


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(i, t, 0, 0) for i, t in ITEMS], "item_id long, text string, raw int, shard int")


def test_contaminated(odd, none, items, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    expected = brute(docs, ITEMS, 10)
    assert sum(r[2] > 0 for r in expected) >= 8
    got = lambda: sorted(map(tuple, contamination.contaminated(odd, items).collect()), key=repr)
    assert got() == expected
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 300)  # several blocks of items, all terms indexed, many shards
    monkeypatch.setattr(contamination, "TERMS", 3)
    monkeypatch.setattr(contamination, "SHARD_BYTES", 500)
    assert got() == expected
    assert contamination.contaminated(none, items).count() == 0
    clean = contamination.contaminated(odd, items.where("false")).collect()
    assert len(clean) == len(docs) and not any(r["n_hit"] or r["item_ids"] for r in clean)


def test_matches(odd, items):
    """Each match is a phrase of both texts, and all windows are within matches."""
    docs = {r["doc_id"]: words(r["text"]) for r in odd.select("doc_id", "text").collect()}
    rows = contamination.matches(odd, items, window=10).collect()
    by_id = {i: [words(t) for k, t in ITEMS if k == i] for i, _ in ITEMS}
    covered = set()
    for r in rows:
        phrase = docs[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert any(w[r["item_start"] : r["item_start"] + r["length"]] == phrase for w in by_id[r["item_id"]]) and r["exact"]
        covered |= {(r["doc_id"], p) for p in range(r["start"], r["start"] + r["length"])}
    assert {d: n for d, _, n, _ in brute(list((d, " ".join(w)) for d, w in docs.items()), ITEMS, 10) if n} == {d: sum(c[0] == d for c in covered) for d in {c[0] for c in covered}}
    assert max(r["length"] for r in rows if r["item_id"] == 1) == 60  # a whole passage is one match


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_near(slop):
    """Occurrences are those of the definition: every term within slop of its place, counted from where the rarest stands."""
    random.seed(slop)
    for window in (1, 2, 4):
        texts = [[random.choice("abcdefgh") for _ in range(random.choice([0, 1, 3, 60]))] for _ in range(6)]
        items = [" ".join(random.choice("abcdefgh") for _ in range(random.choice([1, 2, 4, 7]))).encode() for _ in range(8)]
        block = contamination.Block(list(range(8)), items, window)
        names = [[contamination.term(w.encode()) for w in t] for t in texts]
        flat = np.array([n for t in names for n in t], np.int64)
        at = np.argsort(flat, kind="stable")
        terms, counts = np.unique(flat, return_counts=True)
        block.ranked(dict(zip(terms.tolist(), counts.tolist(), strict=True)))
        shard = contamination.Shard([len(t) for t in texts], terms, counts, np.diff(at, prepend=0).astype(np.int32).tobytes(), window + 2 * slop + 1)
        w, begin = shard.occurrences(block, slop)
        row = shard.rows(begin)
        got = sorted(set(zip(w.tolist(), row.tolist(), (begin - shard.starts[row]).tolist(), strict=True)))
        expected = []
        for k in range(len(block.windows)):
            n = int(block.lengths[k])
            window_, rarest = block.windows[k, :n].tolist(), int(block.order[k, 0])
            for r, t in enumerate(names):
                for i in range(len(t)):
                    if i + rarest < len(t) and t[i + rarest] == window_[rarest] and all(window_[j] in t[max(0, i + j - slop) : i + j + slop + 1] for j in range(n)):
                        expected.append((k, r, i))
        assert got == sorted(expected)
        if not slop:
            assert shard.exact(block, w, begin).all()
