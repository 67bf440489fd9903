"""Toxicity scoring with a factorization machine over hashed terms.

Terms of a text are its distinct words in lower case without outer punctuation, and for each word beginning of some
lengths in bytes (`BEGINNINGS`), that at least one, two or three distinct words of the text have it; each is hashed to 40
bits.  With x the set of terms, score = sigmoid(w0 + sum w_t + 1/2 sum_f ((sum v_tf)^2 - sum v_tf^2)): the second part is
the sum of <v_s, v_t> over all pairs of terms, so pairs weigh in that no additive weights see.

Fitting takes at most `sample` labelled rows, those with the smallest hash of doc_id (a documented bound; all rows
while there are fewer), and there only terms in at least `min_docs` of these rows.  One task fits, as the sample is bounded; the
driver gets the finished model only.  Terms are chosen by two kinds of
evidence: for weights of their own, by proximal steps on w alone, in which a term's L1 weight follows from what its
gradient would be by chance (`sure` standard deviations); and for pairs, whatever their own weights, by the score test of
each pair of terms: what its product would add to the additive fit, in standard deviations, against what the largest of
as many chance values would be.  That test takes at most `pair_rows` of the rows, evenly of both classes, and terms in at
least `pair_docs` and a hundredth of them (documented bounds).  Then all of the machine is fitted
together for the terms chosen either way, weights and pairs; terms without evidence stay out, so length alone doesn't
raise a score.  The sample reaches its task in batches of a few MB, each row is kept as 32-bit places of terms, and steps read
`STRETCH` of these at a time: the task holds the terms once (8 bytes each), then the places with their rows (8 bytes).

Null, empty and punctuation-only texts score sigmoid(w0).  Without labelled rows, or with one class only, every text
scores the class rate (0.0 without rows).  Repeated rows score alike; rows with a null label are not learnt from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, released_after, setting, slices, then_released

OUTER = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BEGINNINGS, LEVELS, BITS = (5, 6, 7, 8), 3, 40
#: Pairs of (row, term) that a step of the fit reads at a time, if no row has more.
STRETCH = 1 << 17
#: Rows whose texts or terms a task holds as Python objects.
ROWS = 500
#: Bytes of a batch of the sample's terms on its way to the fit.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def hashed(term: bytes, kind: int) -> int:
    return xxhash.xxh64_intdigest(term, kind) & ((1 << BITS) - 1)


def words_of(text: bytes) -> set[bytes]:
    return {t for w in set(text.lower().split()) if (t := w.strip(OUTER))}


def terms_of(text: bytes) -> np.ndarray:
    """Distinct hashed terms of a text, in order."""
    words = words_of(text)
    found = [hashed(w, 0) for w in words]
    for n in BEGINNINGS:
        for start, times in Counter(w[:n] for w in words if len(w) >= n).items():
            found += [hashed(start, 16 * n + level) for level in range(1, min(times, LEVELS) + 1)]
    return np.unique(np.array(found, dtype=np.int64))


def places_of(terms: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Places of found among sorted terms; those that aren't there are left out."""
    at = np.minimum(np.searchsorted(terms, found), max(0, len(terms) - 1))
    return at[terms[at] == found] if len(terms) else np.zeros(0, np.int64)


def frequent(rows: list[np.ndarray], least: int, parts: int = 16) -> np.ndarray:
    """Terms in at least that many rows, in order; a part of all terms at a time, so that most are never held together."""
    out = []
    for p in range(parts):
        terms, seen = np.unique(np.concatenate([r[r % parts == p] for r in rows]), return_counts=True)
        out.append(terms[seen >= least])
    return np.sort(np.concatenate(out))


@dataclass
class Model:
    w0: float
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def places(self, found: np.ndarray) -> np.ndarray:
        return places_of(self.terms, found)

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores before the sigmoid, of rows of terms."""
        out = np.full(len(rows), self.w0)
        for i, found in enumerate(rows):
            at = self.places(found)
            if len(at):
                v = self.v[at]
                s = v.sum(axis=0)
                out[i] += self.w[at].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
        return out

    def reader(self):
        """terms_of() and places() in one, for many texts: words that lead to no term of the model are known by heart."""
        place = dict(zip(self.terms.tolist(), range(len(self.terms)), strict=True))

        def leads_to(word: bytes) -> tuple | None:
            t = word.strip(OUTER)
            own = place.get(hashed(t, 0)) if t else None
            starts = [t[:n] for n in BEGINNINGS if len(t) >= n and any(hashed(t[:n], 16 * n + k) in place for k in range(1, LEVELS + 1))]
            return (t, own, starts) if own is not None or starts else None

        memo = Memo(leads_to)

        def read(text: bytes) -> np.ndarray:
            seen, found = {}, []
            for hit in map(memo.__getitem__, set(text.lower().split())):
                if hit is not None:
                    seen[hit[0]] = hit
            starts = Counter()
            for _, own, begins in seen.values():
                if own is not None:
                    found.append(own)
                starts.update(begins)
            for start, times in starts.items():
                found += [p for k in range(1, min(times, LEVELS) + 1) if (p := place.get(hashed(start, 16 * len(start) + k))) is not None]
            return np.array(sorted(set(found)), np.int64)

        return read


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def shrunk(x: np.ndarray, slope: np.ndarray, step: np.ndarray, l1: np.ndarray | float) -> np.ndarray:
    moved = x - step * slope
    return np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)


class Problem:
    """Rows as flat (row, term) pairs, in the order of rows, with steps of proximal AdaGrad over all of them."""

    def __init__(self, owner: np.ndarray, flat: np.ndarray, y: np.ndarray, n: int, w0: float, v: np.ndarray):
        """v: factors of all n terms, or of none."""
        self.owner, self.flat, self.y, self.w0, self.w, self.v = owner, flat, y, w0, np.zeros(n), v
        ends = np.searchsorted(owner, np.arange(len(y) + 1))
        self.stretches, at = [], 0
        while at < len(y):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + STRETCH, "right")) - 1)
            self.stretches.append((slice(at, to), slice(ends[at], ends[to])))
            at = to

    def run(self, rounds: int, rate: float, l1: np.ndarray | float, l1_pairs: np.ndarray | float, ridge: float) -> None:
        k = self.v.shape[1] if len(self.v) else 0
        g0, gw, gv = 1e-8, np.full(len(self.w), 1e-8), np.full(self.v.shape, 1e-8)
        for _ in range(rounds):
            raw, sums = np.full(len(self.y), self.w0), np.zeros((k, len(self.y)))
            for rows, pairs in self.stretches:
                owner, flat, n = self.owner[pairs] - rows.start, self.flat[pairs], rows.stop - rows.start
                raw[rows] += np.bincount(owner, self.w[flat], n)
                for f in range(k):
                    x = self.v[flat, f]
                    s = sums[f, rows] = np.bincount(owner, x, n)
                    raw[rows] += 0.5 * (s * s - np.bincount(owner, x * x, n))
            error = (sigmoid(raw) - self.y) / len(self.y)
            g = error.sum()
            g0 += g * g
            self.w0 -= rate * g / np.sqrt(g0)
            weight, by_sums = np.zeros(len(self.w)), np.zeros((k, len(self.v)))
            for _, pairs in self.stretches:
                owner, flat = self.owner[pairs], self.flat[pairs].astype(np.int64)
                np.add.at(weight, flat, error[owner])
                for f in range(k):
                    np.add.at(by_sums[f], flat, (error * sums[f])[owner])
            dw = weight + ridge * self.w
            gw += dw * dw
            self.w = shrunk(self.w, dw, rate / np.sqrt(gw), l1)
            for f in range(k):
                dv = by_sums[f] + self.v[:, f] * (ridge - weight)
                gv[:, f] += dv * dv
                self.v[:, f] = shrunk(self.v[:, f], dv, 0.3 * rate / np.sqrt(gv[:, f]), l1_pairs)


def among(which: np.ndarray, n: int, owner: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of (row, term) with one of the terms `which` of n, by its place there."""
    number = np.full(n, -1, np.int32)
    number[which] = np.arange(len(which), dtype=np.int32)
    inside = number[flat] >= 0
    return owner[inside], number[flat[inside]]


def telling_pairs(owner: np.ndarray, flat: np.ndarray, error: np.ndarray, p: np.ndarray, n: int, pair_docs: int, tile: int = 512) -> np.ndarray:
    """Terms of pairs whose product the fit with errors (p - y) lacks: |sum of error| over its standard deviation, tile by tile of all pairs."""
    seen = np.bincount(flat, minlength=n)
    often = np.flatnonzero(seen >= pair_docs)
    row, term = among(often, n, owner, flat)
    order = np.argsort(term, kind="stable")
    row, term = row[order], term[order]
    ends = np.searchsorted(term, np.arange(0, len(often) + tile, tile))

    def dense(k: int) -> np.ndarray:
        out = np.zeros((len(p), min(tile, len(often) - k * tile)), np.float32)
        part = slice(ends[k], ends[k + 1])
        out[row[part], term[part] - k * tile] = 1
        return out

    n_tiles = -(-len(often) // tile)
    limit = np.sqrt(2 * np.log(max(2, len(often) * (len(often) - 1) // 2))) + 1
    weight = (p * (1 - p)).astype(np.float32)[:, None]
    found = np.zeros(len(often), bool)
    for i in range(n_tiles):
        a = dense(i)
        by_error, by_weight = (a * error.astype(np.float32)[:, None]).T.copy(), (a * weight).T.copy()
        for j in range(i, n_tiles):
            b = a if i == j else dense(j)
            s, t = np.nonzero(np.abs(by_error @ b) >= limit * np.sqrt(np.maximum(by_weight @ b, 1e-3)))
            if i == j:
                s, t = s[s != t], t[s != t]
            for at in range(0, len(s), 512):  # together often enough, and not one term twice
                x, y = s[at : at + 512], t[at : at + 512]
                both = np.einsum("rk,rk->k", a[:, x], b[:, y])
                good = (both >= 5) & (both < seen[often[i * tile + x]]) & (both < seen[often[j * tile + y]])
                found[i * tile + x[good]] = True
                found[j * tile + y[good]] = True
    return often[found]


def pair_sample(y: np.ndarray, raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows for the test of pairs, those of the rarer class first, and probabilities among them of a fit with scores raw."""
    one, other = (np.flatnonzero(y > 0), np.flatnonzero(y <= 0)) if y.mean() <= 0.5 else (np.flatnonzero(y <= 0), np.flatnonzero(y > 0))
    take = [one[: max(size // 2, size - len(other))], other[: max(size // 2, size - len(one))]]
    chosen = np.sort(np.concatenate(take))
    share = [len(t) / max(1, len(of)) for t, of in zip(take, (one, other), strict=True)]
    odds = share[0] / share[1] if y.mean() <= 0.5 else share[1] / share[0]
    return chosen, sigmoid(raw[chosen] + np.log(odds))


def as_terms(rows: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms in at least that many rows, and the rows as flat pairs of (row, term).  Empties `rows`."""
    terms = frequent(rows, least) if rows else np.zeros(0, np.int64)
    for i, r in enumerate(rows):
        rows[i] = places_of(terms, r).astype(np.int32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    flat = np.concatenate([np.zeros(0, np.int32), *rows])
    rows.clear()
    return terms, owner, flat


def fit(rows: list[np.ndarray], y: np.ndarray, min_docs: int = 5, **how) -> Model:
    return fitted_to(*as_terms(list(rows), min_docs), y, **how)


def fitted_to(terms: np.ndarray, owner: np.ndarray, flat: np.ndarray, y: np.ndarray, rank: int = 4, rounds: int = 150, rate: float = 0.3, sure: float = 4.0, pair_docs: int = 25, pair_rows: int = 3000, ridge: float = 1e-4, seed: int = 11) -> Model:
    """The machine for the labels y of rows given as flat pairs of (row, term)."""
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return Model(float(np.log(max(p, 1e-15) / max(1 - p, 1e-15))))
    seen = np.zeros(len(terms), np.int64)
    for part in slices(len(flat), STRETCH):
        seen += np.bincount(flat[part], minlength=len(terms))
    share, p = seen / len(y), float(y.mean())
    l1 = sure * np.sqrt(p * (1 - p) * share / len(y))
    first = Problem(owner, flat, y, len(terms), float(np.log(p / (1 - p))), np.zeros((0, rank)))
    first.run(rounds, rate, l1, 0.0, 0.0)
    nonzero = np.flatnonzero(first.w)
    by_row, of = among(nonzero, len(terms), owner, flat)
    chosen, fitted = pair_sample(y, first.w0 + np.bincount(by_row, first.w[nonzero][of], len(y)), pair_rows)
    of, row = among(chosen, len(y), flat, owner)
    pairs = telling_pairs(row, of, fitted - y[chosen], fitted, len(terms), max(pair_docs, len(chosen) // 100))
    live = np.union1d(nonzero, pairs)
    start = np.random.default_rng(seed).normal(0, 0.01, (len(live), rank))
    last = Problem(*among(live, len(terms), owner, flat), y, len(live), first.w0, start)
    last.w = first.w[live]
    last.run(2 * rounds, rate, 0.0, 0.0, ridge)
    return Model(last.w0, terms[live], last.w, last.v)


def learnt(docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, sample: int = 8000, min_docs: int = 5, **how) -> Model:
    """The model of labelled rows of docs(doc_id, text) with labels(doc_id, toxic), without the held-out fold."""
    rows = labels.where("toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % fold != held)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    rows = rows.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.num_rows, ROWS):
                rows = b.slice(part.start, part.stop - part.start)
                found = [terms_of(x).tobytes() for x in rows.column("raw").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "terms"])

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, toxic, rows = [], [], []
        for b in batches:
            ids += b.column("doc_id").to_pylist()
            toxic += b.column("toxic").to_pylist()
            rows += [np.frombuffer(x.as_buffer(), np.int64).copy() for x in b.column("terms")]
        if rows:
            order = np.lexsort((np.array([xxhash.xxh64_intdigest(x) for x in rows], np.uint64), np.array(ids))).tolist()
            y, rows = (np.array(toxic) > 0).astype(float)[order], [rows[i] for i in order]
            m = fitted_to(*then_released(as_terms, rows, min_docs), y, **how)
            yield pa.RecordBatch.from_pydict({"w0": [m.w0], "rank": pa.array([m.v.shape[1]], pa.int32()), **{k: pa.array([getattr(m, k).tobytes()], pa.binary()) for k in ("terms", "w", "v")}})

    picked = texts.join(chosen, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), "raw")
    fitted = picked.mapInArrow(released_after(run), "doc_id long, toxic int, terms binary").repartition(1).mapInArrow(released_after(fit_all), "w0 double, rank int, terms binary, w binary, v binary")
    with setting(docs.sparkSession, *BATCH):
        found = fitted.first()
    if found is None:
        return fitted_to(*as_terms([], min_docs), np.zeros(0), **how)
    return Model(found["w0"], np.frombuffer(found["terms"], np.int64), np.frombuffer(found["w"]), np.frombuffer(found["v"]).reshape(-1, found["rank"]))


def scored(docs: DataFrame, model: Model, fold: int = 4, held: int = 2, threshold: float = 0.3, carry: tuple = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted, *carry) of every row of docs(doc_id, text); carry: columns that each row takes along."""
    names = ["doc_id", "held_out", "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = model.reader()
        for batch in batches:
            for part in slices(batch.num_rows, ROWS):
                b = batch.slice(part.start, part.stop - part.start)
                rows = [model.terms[read(x or b"")] for x in b.column(raw).cast(pa.binary()).to_pylist()]
                score = sigmoid(model.raw(rows))
                found = [b.column("id_"), b.column("held_"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(found + [b.column(c) for c in carried.names], names + carried.names)

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == held, F.lit(False))
    carried = docs.select(*carry).schema
    raw, own = ("text", ()) if any(isinstance(c, str) and c == "text" for c in carry) else ("raw_", (F.col("text").cast("binary").alias("raw_"),))  # a carried text isn't sent twice
    rows = docs.select(F.col("doc_id").cast("long").alias("id_"), held_out.alias("held_"), *own, *carry)
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in carried)
    return rows.mapInArrow(released_after(run), "doc_id long, held_out boolean, score double, predicted int" + extra)
