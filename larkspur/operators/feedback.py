"""Scoring in order: what is decided about a message counts against its sender's next one.

All that doesn't depend on the order is columns, once for a sender without violations and once for one with some: rule
score, label, terms of the final score, and the score from which a message would be deleted.  A fold over partitions
sorted by sender and order then carries two numbers, how many messages of the sender were deleted and the largest score
among them; it reads nothing else, so a hot sender costs time in one task and no memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring

#: What a message's outcome keeps, for either kind of sender.
KEPT = ["rule_score", "rule_reasons", "label", "confidence", "lure", "label_reasons", "before", "less", "floor", "cap", "deletes_from"]
WEIGHT = 0.06


def with_outcomes(df: DataFrame) -> DataFrame:
    """Adds first and again, structs of KEPT: what a message comes to if its sender has no violations, or some.

    Takes with_features() columns without violations, similarities and the group's settings.
    """
    df = df.withColumn("signals_", F.col("signals"))
    for name, prior in (("first", False), ("again", True)):
        have = df.columns
        own = df.withColumns({"violations": F.lit(prior), "signals": F.col("signals_") + int(prior)})
        own = scoring.with_deletes_from(scoring.with_score_terms(scoring.with_rules_label(scoring.with_rule_score(own))))
        df = own.select(*have, F.struct(*KEPT).alias(name))
    return df.drop("signals_", "violations", "signals")


def with_violations_so_far(df: DataFrame, sender: list[str], order: list[str], applies: str) -> DataFrame:
    """Adds violation_score, the sender's before each message, from violation_count and risk_score (what was stored before,
    null: none) and the decisions on the messages before it.  applies: a boolean column; others are neither judged nor counted."""
    terms = [f"{kind}.{c}" for kind in ("first", "again") for c in ("before", "less", "floor", "cap", "deletes_from")]
    narrow = df.withColumns({f"t{k}_": F.col(c) for k, c in enumerate(terms)})
    schema = T.StructType([*df.schema.fields, T.StructField("violation_score", T.DoubleType())])
    have = df.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count, risk = object(), 0, 0.0
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in sender), strict=True)
            columns = [batch.column(c).to_pylist() for c in ("violation_count", "risk_score", applies, *(f"t{k}_" for k in range(len(terms))))]
            out = []
            for key, (stored, stored_risk, on, *t) in zip(keys, zip(*columns, strict=True), strict=True):
                if key != now:
                    now, count, risk = key, stored or 0, stored_risk or 0.0
                prior = min(0.20, count * 0.04 + risk * 0.12) if count else 0.0
                out.append(prior)
                before, less, floor, cap, least = t[5:] if prior > 0 else t[:5]
                if on and least is not None:
                    score = before + prior * WEIGHT - less
                    score = max(score, floor) if floor is not None else score
                    score = max(0.0, min(1.0, min(score, cap) if cap is not None else score))
                    if score >= least:
                        count, risk = count + 1, max(risk, score)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in have), pa.array(out, pa.float64())], names=[*have, "violation_score"])

    return narrow.repartition(*sender).sortWithinPartitions(*sender, *order).mapInArrow(fold, schema)


def with_final_outcome(df: DataFrame) -> DataFrame:
    """The outcome that applies to each message, as columns, with its final score."""
    names = [c for c in df.columns if c not in ("first", "again")]
    x = F.when(F.col("violation_score") > 0, F.col("again")).otherwise(F.col("first"))
    df = df.withColumn("x_", x).select(*names, "x_.*")
    score = F.least(F.greatest(F.col("before") + F.col("violation_score") * WEIGHT - F.col("less"), "floor"), "cap")  # both skip nulls
    return df.withColumn("final_score", scoring.clamped(score)).drop("before", "less", "floor", "cap", "deletes_from")
