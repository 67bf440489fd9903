"""Small tables with what operators must bear: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """n words that no other seed gives in this order."""
    return " ".join(f"{WORDS[(seed * 7 + i * i * 3 + i) % len(WORDS)]}{(seed * 31 + i * 17) % 97}" for i in range(n))


PASSAGE = prose(99, 60)
ROWS = [
    (1, prose(1, 80), "en", "a"), (2, prose(1, 80), "en", "a"), (3, prose(3, 70) + " " + PASSAGE + " " + prose(4, 20), "en", "b"), (4, prose(5, 60) + "\n" + PASSAGE, "fr", "b"),
    (5, None, None, None), (6, "", "en", None), (7, " \t\n ", None, "a"), (8, "word", "de", "a"), (9, "é" * 300 + " ñandú 你好 " + "é" * 300, "es", "c"),
    (10, prose(10, 4000), "en", "a"), (11, "ab" * 700, "en", "a"), (12, "same line\nsame line\n\nother", "de", "c"), (13, "<|endoftext|> it's  a   test here <|endoftext|>", "en", "a"),
    (14, prose(1, 79) + " changed", "en", "a"), (15, "!!! ### $$$", "en", "a"), (16, prose(16, 55), None, "b"), (16, prose(16, 55), None, "b"), (None, prose(17, 55), "en", "b"), (17, "a\x00b \x85 c\x1cd", "en", "z"),
]
EXTRA = "g int, raw string, fp long, key string, part int, bucket int, w string, t string, k string, x0 double, bin long, held long, toxic_ int, rank int, score double, own string"


@pytest.fixture(scope="session")
def odd(spark):
    """ROWS with columns that operators use names of themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
    extra = (None,) * len(EXTRA.split(", "))
    return spark.createDataFrame([(d, t, lang, s, len(t or ""), *extra) for d, t, lang, s in ROWS], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 0, 1), (8, None, 0), (9, 1, None), (None, 1, 1), (10, 1, 0), (11, 1, 0), (12, 1, 0), (13, 1, 0), (14, 1, 0), (15, 1, 0), (16, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
