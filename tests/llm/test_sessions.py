"""Versions of sessions, against taking the batches one by one."""

from __future__ import annotations

import random
import re

import pytest

from larkspur.llm import queries, sessions

SCHEMA = "user long, s long, batch long, h long"


def brute(rows: list[tuple], gap: int) -> list[tuple]:
    out = []
    for user in {r[0] for r in rows if None not in r[:3]}:
        own = [r for r in rows if r[0] == user and None not in r[:3]]
        standing: list[dict] = []
        for batch in sorted({r[2] for r in own}):
            so_far = sorted((r[1], r[2], r[3] or 0) for r in own if r[2] <= batch)
            found: list[list] = []
            for e in so_far:
                if found and e[0] - found[-1][-1][0] <= gap:
                    found[-1].append(e)
                else:
                    found.append([e])
            for events in found:
                n_new = sum(e[1] == batch for e in events)
                if n_new:
                    v = {"user": user, "batch": batch, "start": events[0][0], "end": events[-1][0], "n": len(events), "new": n_new, "h": sum(e[2] for e in events), "by": (None, None)}
                    old = [x for x in standing if v["start"] <= x["start"] and x["end"] <= v["end"]]
                    for x in old:
                        x["by"] = (batch, v["start"])
                    standing = [x for x in standing if x not in old] + [v]
                    out.append(v | {"old": len(old)})
                    v_out = out[-1]
                    standing[-1] = v_out
    return sorted(((v["user"], v["batch"], v["start"], v["end"], v["n"], v["new"], v["old"], v["h"], *v["by"]) for v in out), key=repr)


def checked(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "'x' as n", "2 as first")
    assert sorted(map(tuple, sessions.versions(df, **how).collect()), key=repr) == brute(rows, how.get("gap", 240))


def events(n: int, users: int, most: int, late: int, batch_s: int) -> list[tuple]:
    out = []
    for _ in range(n):
        s = random.randint(-most // 4, most)
        out.append((random.randrange(users), s, s // batch_s + random.choice([0, 0, 0, *range(late + 1)]), random.choice([None, 0, 7, 1 << 32])))
    return out


@pytest.mark.parametrize("span", [1, 2, 16])
@pytest.mark.parametrize("gap", [0, 7, 45])
def test_versions(spark, span, gap):
    """Sessions within a stretch, over many stretches, with gaps longer than a batch; ties and repeated rows."""
    random.seed(span * 100 + gap)
    rows = events(300, 5, 900, 3, 20) + events(250, 1, 700, 3, 20)
    rows += rows[:40] + [(None, 1, 0, 1), (1, None, 0, 1), (1, 1, None, 1)]
    checked(spark, rows, gap=gap, batch_s=20, late=3, span=span)


def test_sessions_without_end(spark):
    """A session that goes on through many stretches, and one late event that joins two of them."""
    rows = [(1, 10 * k, 10 * k // 20, k) for k in range(400) if k != 200] + [(1, 2000, 102, 1)] + [(2, 5, 0, 1)] + [(3, 10 * k, 10 * k // 20, 1) for k in range(0, 400, 3)]
    checked(spark, rows, gap=10, batch_s=20, late=3, span=2)


def test_matrix_of_many_users(spark, monkeypatch):
    monkeypatch.setattr(sessions, "MOST", 100)
    random.seed(1)
    checked(spark, events(500, 60, 8000, 3, 1800))


def test_too_late_fails(spark):
    with pytest.raises(Exception, match="more batches late than allowed"):
        sessions.versions(spark.createDataFrame([(1, 10, 4, 1)], SCHEMA)).collect()
    assert sessions.versions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_user_in_one_task(spark):
    """A user with all rows is dealt over stretches, repeated rows are summed up before."""
    rows = spark.range(60_000).selectExpr("0L as user", "id * 300 as s", "id * 300 div 1800 as batch", "1L as h")
    plan = sessions.versions(rows)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(user#\d+L, part#\d+L", plan) and not re.search(r"hashpartitioning\(user#\d+L, \d", plan)
    assert sessions.versions(rows).count() == 60_000


def test_turn_events(spark):
    rows = [(3, 2, "user", "x"), (3, None, "user", "x"), (None, 1, "user", "x"), (-9, 0, None, None), (3, 2, "user", "x")]
    got = queries.turn_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    import zlib

    expected = []
    for conv, turn, *_ in rows:
        if conv is not None and turn is not None:
            c, h = zlib.crc32(str(conv).encode()), zlib.crc32(f"{conv}:{turn}".encode())
            g, s = h // 600, c // 2 % 7200 + 300 * turn + h % 600
            expected.append((2 * (conv // 8) + c % 2, s, s // 1800 + (g % 4 if g % 3 == 0 else 0), h))
    assert sorted(map(tuple, got)) == sorted(expected)
