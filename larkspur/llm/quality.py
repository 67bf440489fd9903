"""Quality rules: base rules, then robust multivariate outliers, in DataFrame functions only.

Each document gets four statistics of its words (`statistics`).  Those that pass the base rules are held, as a vector of
transformed statistics, against the minimum-covariance-determinant estimate of their language and source.  From each of
three starts (coordinatewise medians with median absolute deviations, with the covariance of spatial signs, and with that
of hyperbolic tangents) two concentration steps keep the share `core` of vectors that are closest in Mahalanobis distance
and take their mean and covariance; the start whose covariance has the smallest determinant goes on with `steps` more.  A
document is rejected when its squared distance under the last estimate passes the chi-square value of `level`.

Estimates are taken over distinct vectors, so that a document copied many times counts once; on each variance stands
a floor (`FLOORS`, squared), as most documents have no symbols or repeated lines at all.  The estimate of a language and
source with n distinct vectors is shrunk towards that of its language as if that were `prior` vectors more, with weights
n / (n + prior) and prior / (n + prior) for mean and covariance, and that of a language likewise towards that of the
whole table; so a group of few vectors is held mostly against its language, at no particular size.

Every row is judged by itself, rows that share a doc_id or have none as well.  A null language or source is a group value
of its own; a null or empty text has no words and fails the base rules.  Ties of distance are on the same side.  An empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, stored

#: Least standard deviations: log mean word length, log1p of symbols, of repeated lines, of repeated words a hundred words.
FLOORS = (0.06, 0.40, 0.40, 0.60)
P = len(FLOORS)
X = [f"x{i}" for i in range(P)]
SPACE = r"[ \t\n\x0B\f\r]"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """How many words are in a window of three words that is found twice or more."""

    def count(triples: Column) -> Column:
        n = F.size(triples)
        placed = F.sort_array(F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            same = lambda k, j: (j >= 0) & (j < n) & (F.get(s, j)["h"] == F.get(s, k)["h"])
            where = F.filter(s, lambda x, k: same(k, k - 1) | same(k, k + 1))
            starts = F.sort_array(F.transform(where, lambda x: x["i"]))
            first = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
            return F.aggregate(starts, first, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

        return F.when(n == F.size(F.array_distinct(triples)), 0).otherwise(let(placed, covered))

    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(let(let(words, windows), count))


def statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, lang, source, *carry, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.trim(text, F.lit(" \t\n\x0b\f\r"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), *carry, text.alias("t"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+")).alias("w"))

    def dup_lines(lines: Column) -> Column:
        return F.size(lines) - F.size(F.array_distinct(lines))

    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    rows = rows.select(
        "doc_id", "lang", "source", *carry,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, dup_lines).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def chi_square_cdf(x: float, k: int) -> float:
    a, x = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 1000):
        term *= x / (a + i)
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a))) if x > 0 else 0.0


def chi_square_value(p: float, k: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, k) < p else (low, mid)
    return low


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
MEAN, COV = [f"m{i}" for i in range(P)], [f"c{i}{j}" for i, j in PAIRS]


def with_root(estimate: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l of the covariance c (lower triangle), a column after the other."""
    for i, j in PAIRS:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        estimate = estimate.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return estimate


def distance() -> Column:
    """Squared Mahalanobis distance of x to m under l, by forward substitution."""
    solved: list[Column] = []
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * solved[j]
        solved.append(rest / F.col(f"l{i}{i}"))
    return sum((s * s for s in solved[1:]), solved[0] * solved[0])


def floored(cov: dict[tuple[int, int], Column]) -> list[Column]:
    return [(cov[i, j] + FLOORS[i] ** 2 if i == j else cov[i, j]).alias(f"c{i}{j}") for i, j in PAIRS]


def starts(vectors: DataFrame, n_groups: int) -> DataFrame:
    """(k, n, start, m0.., c00..): first estimates of each group k of vectors (k, x0..), three a group."""
    median = vectors.groupBy("k").agg(F.count("*").alias("n"), *(F.percentile_approx(x, 0.5, 2000).alias(m) for x, m in zip(X, MEAN, strict=True)))
    median = stored(median, "quality")
    near = looked_up(vectors, median, "k", n_groups)
    spread = near.groupBy("k", "n", *MEAN).agg(*(F.percentile_approx(F.abs(F.col(x) - F.col(m)), 0.5, 2000).alias(f"d{i}") for i, (x, m) in enumerate(zip(X, MEAN, strict=True))))
    spread = spread.select("k", "n", *MEAN, *(F.sqrt(F.pow(F.col(f"d{i}") * 1.4826, 2) + FLOORS[i] ** 2).alias(f"d{i}") for i in range(P)))
    spread = stored(spread, "quality")
    scaled = looked_up(vectors, spread, "k", n_groups).select("k", *(((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"d{i}")).alias(f"z{i}") for i in range(P)))
    size = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0"))
    sign = lambda i, j: F.avg(F.when(F.col("r") > 0, P * F.col(f"z{i}") * F.col(f"z{j}") / F.col("r")).otherwise(0.0))
    flat = lambda i, j: F.avg(F.tanh(f"z{i}") * F.tanh(f"z{j}"))
    shapes = scaled.withColumn("r", size).groupBy("k").agg(*(f(i, j).alias(f"{name}{i}{j}") for name, f in (("s", sign), ("t", flat)) for i, j in PAIRS))
    both = spread.join(shapes, "k")
    d = lambda i, j: F.col(f"d{i}") * F.col(f"d{j}")
    kinds = [
        {(i, j): d(i, i) if i == j else F.lit(0.0) for i, j in PAIRS},
        {(i, j): d(i, j) * F.col(f"s{i}{j}") for i, j in PAIRS},
        {(i, j): d(i, j) * F.col(f"t{i}{j}") for i, j in PAIRS},
    ]
    kinds = F.array(*(F.struct(F.lit(k).alias("start"), *floored(c)) for k, c in enumerate(kinds)))
    return both.select("k", "n", *MEAN, F.explode(kinds).alias("of")).select("k", "n", "of.start", *MEAN, *(f"of.{c}" for c in COV))


def concentrated(vectors: DataFrame, now: DataFrame, n_groups: int, core: float, steps: int) -> DataFrame:
    """now after concentration steps."""
    # what a normal sample loses in variance when only its core is kept
    factor = core / chi_square_cdf(chi_square_value(core, P), P + 2)
    by = ["k", "n", "start"]
    for _ in range(steps):
        at = looked_up(vectors, with_root(now), "k", 3 * n_groups).select(*by, *X, distance().alias("d"))
        edge = at.groupBy(by).agg(F.percentile_approx("d", core, 2000).alias("edge"))
        inside = looked_up(at, edge, by, 3 * n_groups).where("d <= edge")
        sums = inside.groupBy(by).agg(*(F.avg(x).alias(m) for x, m in zip(X, MEAN, strict=True)), *(F.covar_pop(X[i], X[j]).alias(f"v{i}{j}") for i, j in PAIRS))
        now = stored(sums.select(*by, *MEAN, *floored({(i, j): F.col(f"v{i}{j}") * factor for i, j in PAIRS})), "quality")
    return now


def estimates(vectors: DataFrame, n_groups: int, core: float, steps: int) -> DataFrame:
    """(k, n, m0.., c00..) of each of n_groups groups k of distinct vectors (k, x0..): of three starts that with the smallest determinant."""
    now = concentrated(vectors, stored(starts(vectors, n_groups), "quality"), n_groups, core, 2)
    log_det = sum((F.log(f"l{i}{i}") for i in range(1, P)), F.log("l00"))
    best = with_root(now).groupBy("k").agg(F.min_by(F.struct("n", "start", *MEAN, *COV), F.struct(F.round(log_det, 9).alias("det"), "start")).alias("best")).select("k", "best.*")
    return concentrated(vectors, stored(best, "quality"), n_groups, core, steps)


def judged(docs: DataFrame, *carry: str, core: float = 0.75, steps: int = 3, level: float = 1 - 1e-9, prior: float = 20.0) -> DataFrame:
    """statistics() of docs(doc_id, text, lang, source) with `distance` (null where base rules decide) and `kept`."""
    rows = stored(statistics(docs, *carry), "quality-rows")
    rate = lambda c: F.log1p(100.0 * F.col(c) / F.col("n_words"))
    values = [F.log(F.col("word_chars") / F.col("n_words")), rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words")]
    # lengths and letters apart, so that no two pairs of values share a name; that of a language ends in no source
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    tongue = F.concat(F.length(part("lang")).cast("string"), part("lang"))
    with_x = rows.withColumns({"own_": F.concat(tongue, part("source")), "tongue_": tongue} | {x: F.when(~F.col("base_failed"), v) for v, x in zip(values, X, strict=True)})
    distinct = stored(with_x.where(~F.col("base_failed")).select("own_", "tongue_", *X).distinct(), "quality-vectors")
    keyed = lambda k: distinct.select(F.col(k).alias("k"), *X)
    vectors = keyed("own_").unionByName(keyed("tongue_").distinct()).unionByName(distinct.select(F.lit("").alias("k"), *X).distinct())
    vectors = stored(vectors, "quality-vectors")
    groups = stored(distinct.select("own_", "tongue_").distinct(), "quality-groups")
    n_groups = 2 * groups.count() + 1
    found = stored(estimates(vectors, n_groups, core, steps), "quality")
    named = lambda p, key: found.select(F.col("k").alias(key), F.col("n").alias(f"{p}n"), *(F.col(c).alias(p + c) for c in (*MEAN, *COV)))
    judge = groups.withColumn("whole_", F.lit("")).join(named("o", "own_"), "own_").join(named("t", "tongue_"), "tongue_").join(named("w", "whole_"), "whole_")
    mix = lambda n, own, other: (F.col(n) * own + prior * other) / (F.col(n) + prior)
    judge = judge.select("own_", *(mix("on", F.col(f"o{c}"), mix("tn", F.col(f"t{c}"), F.col(f"w{c}"))).alias(c) for c in (*MEAN, *COV)))
    out = looked_up(with_x, with_root(judge), "own_", n_groups, "left").withColumn("distance", F.when(~F.col("base_failed"), distance())).select(*rows.columns, "distance")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square_value(level, P), F.lit(False)))
