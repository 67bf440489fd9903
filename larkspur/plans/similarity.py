"""Retrieval and similarity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookups, retrieval
from ..sources.tables import read
from .registry import query

# Fixture: turns of conversations are messages of group (conv_id mod 4); labelled documents are examples of a group by
# their source, every eleventh of them global, and every thirteenth of none.
WORDS = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> '')"


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "toxic")
    group = F.when(F.col("doc_id") % 13 != 0, F.length("source") % 4)
    rows = docs.join(labels, "doc_id").select(F.col("doc_id").alias("example_id"), group.cast("long").alias("group_id"), F.when(F.col("toxic") == 1, "spam").otherwise("not_spam").alias("label"), F.col("text").alias("example_text"), (F.col("doc_id") % 11 == 0).alias("global_allowed"), F.col("doc_id").alias("created_at"))
    groups = spark.createDataFrame([(g, g != 3) for g in range(4)], "group_id long, global_enabled boolean")
    return retrieval.newest(lookups.in_scope(rows, groups))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), (F.col("conv_id") % 4).alias("group_id"), "text")


EXAMPLES_SQL = """x AS (SELECT d.doc_id AS example_id, CASE WHEN d.doc_id % 13 <> 0 THEN length(d.source) % 4 END AS group_id, CASE WHEN l.toxic = 1 THEN 'spam' ELSE 'not_spam' END AS label, d.text AS example_text, d.doc_id % 11 = 0 AS global_allowed FROM documents d JOIN labels l USING (doc_id)),
g AS (SELECT * FROM (VALUES (0, true), (1, true), (2, true), (3, false)) v(scope_group, enabled)),
sc AS (SELECT g.scope_group, x.*, row_number() OVER (PARTITION BY g.scope_group, x.label ORDER BY x.example_id DESC) AS age FROM x JOIN g ON x.group_id = g.scope_group OR (x.global_allowed AND g.enabled)),
ex AS (SELECT * FROM sc WHERE age <= 100),
ms AS (SELECT conv_id * 1000 + turn AS message_id, conv_id % 4 AS group_id, text FROM conversations WHERE role = 'user')"""
NEAR_SQL = f"""{EXAMPLES_SQL},
o AS (SELECT m.message_id, e.label, e.example_id, e.age, len(list_intersect(list_distinct(list_filter({WORDS.format('m.text')}, lambda w: length(w) > 3)), list_distinct({WORDS.format('e.example_text')}))) AS overlap FROM ms m JOIN ex e ON m.group_id = e.scope_group),
nr AS (SELECT *, row_number() OVER (PARTITION BY message_id, label ORDER BY overlap DESC, age) AS rank FROM o),
near AS (SELECT * FROM nr WHERE rank <= 4)"""


@query(f"WITH {NEAR_SQL} SELECT message_id, label, example_id, overlap, rank FROM near")
def nearest_examples_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest(turns(spark, sf_dir), examples(spark, sf_dir)).select("message_id", "label", "example_id", "overlap", "rank")


@query(f"""WITH {NEAR_SQL}, tl AS (SELECT message_id, term, count(*) AS n FROM (SELECT message_id, unnest({WORDS.format('text')}) AS term FROM ms) WHERE length(term) > 2 GROUP BY ALL),
tr AS (SELECT example_id, term, count(*) AS n FROM (SELECT example_id, unnest({WORDS.format('example_text')}) AS term FROM (SELECT DISTINCT example_id, example_text FROM x)) WHERE length(term) > 2 GROUP BY ALL),
nl AS (SELECT message_id, sqrt(sum(n * n)) AS v FROM tl GROUP BY 1), ne AS (SELECT example_id, sqrt(sum(n * n)) AS v FROM tr GROUP BY 1),
dt AS (SELECT p.message_id, p.label, p.example_id, sum(tl.n * tr.n) AS d FROM near p JOIN tl USING (message_id) JOIN tr ON tr.example_id = p.example_id AND tr.term = tl.term GROUP BY ALL)
SELECT p.message_id, p.label, round(max(coalesce(d / (nl.v * ne.v), 0)), 6) AS similarity FROM near p LEFT JOIN dt USING (message_id, label, example_id) LEFT JOIN nl USING (message_id) LEFT JOIN ne ON ne.example_id = p.example_id GROUP BY ALL""")
def bow_cosine_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = retrieval.best_similarities(turns(spark, sf_dir), examples(spark, sf_dir))
    return df.select("message_id", "label", F.round("similarity", 6).alias("similarity"))


@query("""WITH h AS (SELECT doc_id, sha256(lower(text)) AS h FROM documents), e AS (SELECT h, min(doc_id) AS example_id, count(*) AS copies FROM h WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT h.doc_id AS message_id, e.example_id, e.copies FROM h JOIN e USING (h) WHERE h.doc_id % 2 = 1""")
def exact_example_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages (odd ids) whose text is that of an example (even ids)."""
    df = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.lower("text"), 256).alias("h"))
    seen = df.where("doc_id % 2 = 0").groupBy("h").agg(F.min("doc_id").alias("example_id"), F.count("*").alias("copies"))
    return df.where("doc_id % 2 = 1").join(seen, "h").select(F.col("doc_id").alias("message_id"), "example_id", "copies")


@query(f"""WITH w AS (SELECT conv_id * 1000 + turn AS message_id, unnest({WORDS.format('text')}) AS word FROM conversations), p AS (SELECT message_id, ('0x' || substr(sha256(word), 1, 4))::INT % 64 AS place, CASE WHEN ('0x' || substr(sha256(word), 5, 2))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END AS sg FROM w),
q AS (SELECT message_id, place, sum(sg)::DOUBLE AS v FROM p GROUP BY ALL HAVING sum(sg) <> 0)
SELECT message_id, place, round(v / sqrt(sum(v * v) OVER (PARTITION BY message_id)), 6) AS value FROM q""")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "text")
    return retrieval.hash_embedding(df, "message_id", "text").withColumn("value", F.round("value", 6))


@query("""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, b.v), 6) AS similarity FROM n a JOIN n b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM p)
SELECT * FROM r WHERE rank <= 5""")
def embedding_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each with an id divisible by 50."""
    df = read(spark, sf_dir, "embeddings")
    return retrieval.vector_top_k(df.where("vec_id % 50 = 0"), df, 5).select("query_id", "vec_id", "similarity", "rank")
