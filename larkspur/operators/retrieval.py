"""Nearest labelled examples, bag-of-words similarity, hashed embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


#: Messages that a task compares with the examples of their groups.
IN_A_TASK = 5_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n) of words of more than two characters."""
    return df.select(key, F.explode(F.filter(words(F.col(text)), lambda w: F.length(w) > 2)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def cosine(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs(l, r) with `similarity` of term counts left(l, term, n) and right(r, term, n); 0 without common terms."""
    norm = lambda df, k: df.groupBy(k).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias(f"norm_{k}"))
    dot = pairs.join(left, "l").withColumnRenamed("n", "n_l").join(right.withColumnRenamed("n", "n_r"), ["r", "term"])
    dot = dot.groupBy("l", "r").agg(F.sum(F.col("n_l") * F.col("n_r")).alias("dot"))
    out = pairs.join(dot, ["l", "r"], "left").join(norm(left, "l"), "l", "left").join(norm(right, "r"), "r", "left")
    return out.select("l", "r", F.coalesce(F.col("dot") / (F.col("norm_l") * F.col("norm_r")), F.lit(0.0)).alias("similarity"))


def newest(examples: DataFrame, n: int = fixed.EXAMPLES_SEEN) -> DataFrame:
    """The n newest examples of each scope_group and label; `age` counts from 1.  Ranked before any join with messages."""
    order = Window.partitionBy("scope_group", "label").orderBy(F.desc("created_at"), F.desc("example_id"))
    return examples.withColumn("age", F.row_number().over(order)).where(F.col("age") <= n)


def nearest(messages: DataFrame, examples: DataFrame, kept: int = fixed.EXAMPLES_KEPT) -> DataFrame:
    """Of the newest examples of its group and label, the `kept` that share most words with each message; the newer first.

    messages(message_id, group_id, text), examples(scope_group, label, example_id, example_text, age).  A message meets at
    most the 100 newest of each label, so candidates grow with messages only.
    """
    # short words are left out on both sides; sets are built of a message's few words, not of an example's many
    own, seen = F.array_distinct(numbered(F.col("text"), 3)), F.array_distinct(numbered(F.col("example_text"), 3))
    # pairs are sorted by the tasks that make them, so tasks get few messages each, however many there are
    partitions = max(int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-messages.count() // IN_A_TASK))
    left = messages.repartition(partitions, "message_id").select("message_id", F.col("group_id").alias("scope_group"), own.alias("own"))
    right = examples.select("scope_group", "label", "example_id", "age", seen.alias("seen"))
    both = left.join(right, "scope_group").select("message_id", "label", "example_id", "age", F.size(F.array_intersect("seen", "own")).alias("overlap"))
    order = Window.partitionBy("message_id", "label").orderBy(F.desc("overlap"), "age")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)


def best_similarities(messages: DataFrame, examples: DataFrame) -> DataFrame:
    """(message_id, label, similarity): the best cosine with one of the nearest examples of each label."""
    near = nearest(messages, examples)
    left = term_counts(messages.select(F.col("message_id").alias("l"), "text"), "l", "text")
    right = term_counts(examples.select(F.col("example_id").alias("r"), "example_text").distinct(), "r", "example_text")
    pairs = near.select(F.col("message_id").alias("l"), F.col("example_id").alias("r")).distinct()
    scored = cosine(pairs, left, right)
    near = near.select(F.col("message_id").alias("l"), F.col("example_id").alias("r"), "label")
    return near.join(scored, ["l", "r"]).groupBy(F.col("l").alias("message_id"), "label").agg(F.max("similarity").alias("similarity"))


def numbered(text: Column, over: int) -> Column:
    """Words of more than so many characters, as 64-bit numbers: arrays of them compare without strings."""
    return F.transform(F.filter(words(text), lambda w: F.length(w) > over), lambda w: F.xxhash64(w))


def with_counted_words(df: DataFrame, text: str, own: str, terms: str) -> DataFrame:
    """Adds own, distinct words of more than three characters, and terms, [(term, n)] of those of more than two, as numbers.

    Words and numbers are columns of their own: within the function that counts a term they would be made again for each term.
    """
    long = lambda over: F.transform(F.filter("words_", lambda w: F.length(w) > over), lambda w: F.xxhash64(w))
    df = df.withColumn("words_", words(F.col(text))).withColumns({own: F.array_distinct(long(3)), "long_": long(2)})
    times = lambda t: F.size(F.filter("long_", lambda w: w == t)).cast("double")
    return df.withColumn(terms, F.transform(F.array_distinct("long_"), lambda t: F.struct(t.alias("t"), times(t).alias("n")))).drop("words_", "long_")


def with_similarities(messages: DataFrame, examples: DataFrame, text: str = "text", kept: int = fixed.EXAMPLES_KEPT) -> DataFrame:
    """Adds spam_similarity and ham_similarity: the best cosine with one of the nearest examples of the message's group.

    The same as best_similarities(), for short examples: those of a group, at most 100 a label, are one row, which its
    messages meet in a join by group; all else is done in the message's row, so messages are neither exploded nor sorted.
    """
    length = lambda counts: F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, c: a + c["n"] * c["n"]))
    seen = with_counted_words(examples.select("scope_group", "label", "age", "example_text"), "example_text", "seen", "terms")
    seen = seen.withColumn("length", length(F.col("terms"))).select("scope_group", "label", F.struct("age", "seen", "terms", "length").alias("x"))
    of = lambda label: F.array_sort(F.collect_list(F.when(F.col("label") == label, F.col("x")))).alias(f"{label}_")
    rows = seen.groupBy("scope_group").agg(of("spam"), of("not_spam")).withColumnRenamed("scope_group", "group_id")
    looked = lambda x: F.struct(x["seen"].alias("seen"), F.map_from_entries(x["terms"]).alias("counts"), x["length"].alias("length"))
    rows = rows.withColumns({c: F.transform(c, looked) for c in ("spam_", "not_spam_")})  # once an example, not once a message
    df = with_counted_words(messages.join(rows, "group_id", "left"), text, "own_", "terms_")
    df = df.withColumn("length_", length(F.col("terms_")))

    def best(label: str) -> Column:
        examples_ = F.col(f"{label}_")
        ranked = F.array_sort(F.transform(examples_, lambda x, i: F.struct((-F.size(F.array_intersect(x["seen"], "own_"))).alias("o"), i.alias("i"))))  # by age where overlaps are equal

        def cosine_(y: Column) -> Column:
            x = F.get(examples_, y["i"])
            dot = F.aggregate("terms_", F.lit(0.0), lambda a, c: a + c["n"] * F.coalesce(F.try_element_at(x["counts"], c["t"]), F.lit(0.0)))
            return F.when((F.col("length_") > 0) & (x["length"] > 0), dot / (F.col("length_") * x["length"])).otherwise(0.0)

        return F.coalesce(F.array_max(F.transform(F.slice(ranked, 1, kept), cosine_)), F.lit(0.0))

    return df.withColumns({"spam_similarity": best("spam"), "ham_similarity": best("not_spam")}).drop("spam_", "not_spam_", "own_", "terms_", "length_")


def hash_embedding(df: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """(key, place, value): words hashed to places with a sign, scaled to length 1; zero places are left out."""
    digest = F.sha2("word", 256)
    at = (F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % size).alias("place")
    sign = F.when(F.conv(F.substring(digest, 5, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0).alias("sign")
    sums = df.select(key, F.explode(words(F.col(text))).alias("word")).select(key, at, sign).groupBy(key, "place").agg(F.sum("sign").alias("value")).where("value <> 0")
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(key)))
    return sums.select(key, "place", (F.col("value") / norm).alias("value"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of length 1; those that are null or have no length as NaN."""
    values = column.combine_chunks()
    known = values.is_valid().to_numpy(zero_copy_only=False)
    flat = values.drop_null()
    width = len(flat[0]) if len(flat) else 1
    if len(flat.flatten()) != width * len(flat):
        raise ValueError("vectors must be of one length")
    out = np.full((len(values), width), np.nan)
    out[known] = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(length > 0, length, np.nan)


def best_of_block(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int, rows: int = 128) -> Iterator[tuple]:
    """(query ids, vector ids, similarity in millionths): the k best of a block for each query, smaller ids first where equal; NaN comes last."""
    by_id = np.argsort(v_ids, kind="stable")
    v_ids, v, n = v_ids[by_id], v[by_id], len(v_ids)
    none, own = -2_000_001, -2_000_002  # no cosine; the query itself
    for at in range(0, len(q_ids), rows):
        ids = q_ids[at : at + rows]
        s = np.rint(q[at : at + rows] @ v.T * 1e6)
        s = np.where(np.isnan(s), none, s).astype(np.int64)
        s[ids[:, None] == v_ids[None, :]] = own
        order = np.arange(n) - s * n  # one number for similarity, then id
        best = np.argpartition(order, min(k, n) - 1, axis=1)[:, :k]
        found = np.take_along_axis(s, best, axis=1)
        i, j = np.nonzero(found != own)
        yield ids[i], v_ids[best[i, j]], np.where(found[i, j] == none, np.nan, found[i, j])


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 20_000) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest by cosine, to six decimals, of a stated set of queries; without a cosine (null, length 0) last.

    Exact, so queries times vectors; each block of queries meets each block of vectors in a group of its own, as a product of
    matrices that gives k rows a query.  Blocks bound a task's memory.
    """
    n_q, n_v = max(1, -(-queries.count() * 4 // block)), max(1, -(-vectors.count() // block))
    partitions = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as small rows are long work
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")
    known = F.col(key).isNotNull()
    asked = queries.where(known).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), own(n_q).alias("q_"), each(n_v).alias("v_")).repartition(partitions, "q_", "v_")
    rows = vectors.where(known).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), own(n_v).alias("v_"), each(n_q).alias("q_")).repartition(partitions, "q_", "v_")
    schema = pa.schema([("query_id", pa.int64()), (key, pa.int64()), ("similarity", pa.float64())])

    def met(x: pa.Table, y: pa.Table) -> pa.Table:
        if not (x.num_rows and y.num_rows):
            return schema.empty_table()
        found = best_of_block(x["id"].to_numpy(), matrix(x["v"]), y["id"].to_numpy(), matrix(y["v"]), k)
        q, v, s = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table([pa.array(q), pa.array(v), pa.array(s / 1e6, mask=np.isnan(s))], schema)

    best = asked.groupBy("q_", "v_").cogroup(rows.groupBy("q_", "v_")).applyInArrow(met, f"query_id long, `{key}` long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
