"""The pipeline, stage by stage, against brute force; and on empty tables."""

from __future__ import annotations

import math
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .test_operators import brute_quality, brute_similar, check_packing, texts


@pytest.fixture(scope="module")
def folder(odd, labels, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    odd.write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = texts(docs), None if k == 4 else texts(out)
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        if name == "quality_rules":
            assert {d for d, t in after} <= {d for d, t in before if not brute_quality(t)[-1]}
        if name == "simhash_near_dedup":
            top = brute_similar([(d, t) for d, t in before if d is not None])[0]
            assert sorted(after, key=repr) == sorted(((d, t) for d, t in before if d is None or top[d] == d), key=repr)
        if name == "substring_dedup":
            first = {}
            rank = lambda d: math.inf if d is None else d
            for d, t in before:
                w = t.split()
                for i in range(len(w) - 12):
                    first[tuple(w[i : i + 13])] = min(first.get(tuple(w[i : i + 13]), math.inf), rank(d))
            expected = []
            for d, t in before:
                w = t.split()
                gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < rank(d) for j in range(i, i + 13)}
                expected.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t))
            assert sorted(after, key=repr) == sorted(expected, key=repr)
            assert out.where("n_chars <> length(text)").count() == 0
        if k == 4:
            check_packing(out.collect(), before, 2048)
        docs = out
    assert {r["doc_id"] for r in docs.collect()} >= {1, 3, 4, 16, None}


def test_run_is_its_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0


def test_empty(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    spark.read.parquet(f"{folder}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() == 0


def test_rejected_documents_go(spark, folder, monkeypatch):
    """What toxicity predicts takes effect."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    marked = F.when(F.col("doc_id").isin(3, 9), 1).otherwise(0).alias("predicted")
    monkeypatch.setattr(corpus_pipeline.toxicity, "scored", lambda d, m, carry=(): d.select("doc_id", marked, *carry))
    monkeypatch.setattr(corpus_pipeline.toxicity, "learnt", lambda d, lab: None)
    left = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, folder).collect()}
    assert left == {r["doc_id"] for r in docs.collect()} - {3, 9}


def test_repeated_passages_by_row(spark, folder):
    """Rows with one doc_id keep their own texts, whether one of them or both lose words."""
    a, b, own = (" ".join(f"{x}{i}" for i in range(20)) for x in "abo")
    rows = [(1, a, "en", "x", 1), (2, a + " y", "en", "x", 2), (2, a + " z", "de", "y", 3), (3, a + " q", "en", "x", 4), (3, own, "fr", "z", 5), (4, None, None, "x", None), (None, b, "en", None, 6), (None, b, "en", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((tuple(r) for r in corpus_pipeline.drop_repeated_passages(spark, docs, folder).collect()), key=repr)
    assert got == sorted([(1, a, "en", "x", 1), (2, "y", "en", "x", 1), (2, "z", "de", "y", 1), (3, "q", "en", "x", 1), (3, own, "fr", "z", 5), (4, None, None, "x", None), (None, b, "en", None, 6), (None, b, "en", None, 7)], key=repr)


def test_rows_without_id_are_judged(spark, folder, monkeypatch):
    """A row without a doc_id goes for its own verdict, and only for that."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    random.seed(8)
    words = lambda n: " ".join("".join(random.choice("abcdefghij") for _ in range(random.randint(n, n + 4))) for _ in range(random.randint(80, 160)))
    good = [(i, words(3), "en", "s", 1) for i in range(60)]
    alone = [(None, words(3), "en", "s", 1), (None, words(60), "en", "s", 2), (None, "too short", "en", "s", 3), (None, None, "en", "s", 4)]
    docs = spark.createDataFrame(good + alone, schema)
    left = corpus_pipeline.drop_low_quality(spark, docs, folder).where("doc_id is null").collect()
    assert [r["n_chars"] for r in left] == [1]
    monkeypatch.setattr(corpus_pipeline.toxicity, "scored", lambda d, m, carry=(): d.select("doc_id", *carry, F.coalesce(F.col("text").contains("short"), F.lit(False)).cast("int").alias("predicted")))
    monkeypatch.setattr(corpus_pipeline.toxicity, "learnt", lambda d, lab: None)
    out = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert sorted(r["n_chars"] for r in out.where("doc_id is null").collect()) == [1, 2, 4] and out.count() == 63
