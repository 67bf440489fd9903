"""Registered queries of this package against their SQL, over whole tables."""

from __future__ import annotations

import duckdb
import pytest

from larkspur.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf, name, size):
    folder = f"{sf}/../{size}"
    got = queries.queries()[name](spark, folder)
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    expected = db.execute(queries.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(names).collect()), key=repr) == sorted(expected.fetchall(), key=repr)
