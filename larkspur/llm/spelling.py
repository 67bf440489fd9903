"""Spelling variants of words, by anagram hashing.

A word's key is the sum of the fifth powers of its code points (modulo 2^64), whatever their order.  Adding or removing a
letter changes the key by that letter's power, exchanging one by the difference of two powers.  So each word stands
under its own key and under its key less each of its distinct letters; two words one letter apart meet there: the
longer less a letter at the shorter's own key, or both less the letters that were exchanged.  Keys under which a single
word stands are left.  At the keys that remain letter order is verified: words less that letter at each of its places
must be equal, and for an exchange the place, too.

Words of one remainder and place differ in that letter only, so all are near each other; each gets its count and its
most frequent other from the group in order, without pairs.  Near words are found once: an exchange has one place, and of
equal remainders of one word that with the first place counts.

All joins are by sorted keys: their sides grow with the distinct words, and Spark would broadcast one through the driver
by the compressed bytes of its files.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
KEYS = "word string, n long, key long, letter int"


def word_counts(docs: DataFrame, shortest: int = 6, misspelt: int = 0) -> DataFrame:
    """(word, n): runs of Latin letters of docs(doc_id, text) with A-Z lower-cased, of at least `shortest` code points.

    With misspelt, a run of a document loses the code point h % length if misspelt divides h, the crc32 of
    `<doc_id>:<run>` in UTF-8: a plain way to plant mistakes.  A doc_id that is null is taken as an empty text.  Null and
    empty texts have no words.  Counts are summed before they are shuffled, so a frequent word is a few rows.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    run = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw"), strict=True):
                own = Counter(run.findall(raw.as_py().translate(LOWER).decode("utf-8", "replace")))
                if misspelt:
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word in [w for w in own if zlib.crc32(w.encode(), start) % misspelt == 0]:
                        at = zlib.crc32(word.encode(), start) % len(word)
                        total[word[:at] + word[at + 1 :]] += own.pop(word)
                total.update(own)
                if len(total) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()))], schema=schema)
                    total = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=schema)

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    counted = texts.mapInArrow(count, "word string, n long").where(F.length("word") >= shortest)
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key of each word; word, letter and key of each word less each of its distinct letters)."""
    lengths = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    powers = points**5  # modulo 2^64
    of = np.repeat(np.arange(len(words)), lengths)
    before = np.r_[np.uint64(0), np.cumsum(powers, dtype=np.uint64)]
    ends = np.cumsum(lengths)
    key = before[ends] - before[ends - lengths]
    pair = np.unique((of.astype(np.uint64) << np.uint64(21)) | points)
    word, letter = (pair >> np.uint64(21)).astype(np.int64), pair & np.uint64((1 << 21) - 1)
    return key, word, letter, key[word] - letter**5


def keyed(words: DataFrame) -> DataFrame:
    """words(word, n) under their own keys (letter null) and under those less each of their letters."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("key", pa.int64()), ("letter", pa.int32())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, of, letter, less = keys(batch.column("word").to_pylist())
            rows = pa.array(np.r_[np.arange(len(own)), of])
            letters = pa.array(np.r_[np.zeros(len(own), np.int32), letter.astype(np.int32)], mask=np.r_[np.ones(len(own), bool), np.zeros(len(of), bool)])
            yield pa.RecordBatch.from_arrays([batch.column("word").take(rows), batch.column("n").take(rows), pa.array(np.r_[own, less].view(np.int64)), letters], schema=schema)

    return words.select("word", "n").mapInArrow(emit, KEYS)


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best struct<less long, form string>) of the words that have near words; less is minus form's n."""
    under = stored(keyed(words), "anagrams")
    several = under.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    meet = under.join(several.hint("merge"), "key", "left_semi")
    places = meet.where("letter is not null").select("*", F.explode(F.expr("sequence(1, length(word))")).alias("place")).where("ascii(substring(word, place, 1)) = letter")
    rest = F.expr("concat(substring(word, 1, place - 1), substring(word, place + 1))")
    less = places.select("key", "word", "n", "place", rest.alias("rest"), F.expr("place = 1 or ascii(substring(word, place - 1, 1)) <> letter").alias("first"))
    self_, same = F.struct((-F.col("n")).alias("less"), F.col("word").alias("form")), Window.partitionBy("key", "rest", "place")
    ranked = same.orderBy(F.desc("n"), "word")
    top, following = F.first(self_).over(ranked), F.lead(self_).over(ranked)
    exchanged = less.select("word", (F.count("*").over(same) - 1).alias("n_near"), F.when(F.row_number().over(ranked) > 1, top).otherwise(following).alias("best")).where("n_near > 0")
    whole = meet.where("letter is null").select("key", F.col("word").alias("rest"), F.col("n").alias("short_n"))
    longer = less.where("first").join(whole.hint("merge"), ["key", "rest"])
    one, short = F.lit(1).cast("long").alias("n_near"), F.struct((-F.col("short_n")).alias("less"), F.col("rest").alias("form")).alias("best")
    removed = longer.select("word", one, short)
    added = longer.select(F.col("rest").alias("word"), one, self_.alias("best"))
    found = exchanged.unionByName(removed).unionByName(added)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words(word, n), which has each word once.

    Near words differ by exactly one inserted, deleted or replaced code point.  form: the near word of largest n, of equals
    the first in code-point order, if its n is at least ratio times the word's; else null.  root: what following forms ends
    in.  n grows by the ratio with each form, which bounds the rounds.  Null words are left out.
    """
    words = stored(words.where("word is not null").select("word", "n"), "words")
    found = near(words).select("word", "n_near", F.col("best.form").alias("near_form"), (-F.col("best.less")).alias("near_n"))
    good = F.col("near_n") >= ratio * F.col("n")
    every = words.join(found.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("near_form")).alias("form"), F.when(good, F.col("near_n")).alias("form_n"))
    every = stored(every, "forms")
    steps = every.where("form is not null").select("word", F.col("form").alias("root"))
    top = words.agg(F.max("n")).first()[0] or 1
    longest = 1  # steps from a word to its root at most
    while ratio > 1 and ratio**longest <= top:
        longest += 1
    reach = 1
    while reach < longest:  # each round doubles how far a word's root is followed
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = stored(steps.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        reach *= 2
    return every.join(steps.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
