"""Sessions of events that arrive in batches, late ones among them: every version of every session, and what it replaces.

After each batch a user's events so far form sessions: neighbours in time at most `gap` seconds apart share one.  A session
that holds an event of the batch is a new version and retracts the earlier standing sessions that it contains.

The versions come from an activity matrix, batches by events: an entry is active once its event has arrived.  The running
maximum of active times along a row gives the last active time before each event; where an event is further away, a
session begins; cumulative counts of these are session ids, and reduceat sums up the sessions of all snapshots at once.
Events of several users stand side by side in one matrix, further apart than any session reaches.

A user's events are cut into stretches of `span` batches, so no user meets in one task.  What makes this exact: an event is
at most `late` batches late, so before a stretch's first batch everything older than that is settled.  Of the settled past
only the session that reaches up to the stretch matters, and of that its start, last event and sums: it enters the matrix
as one event.  Settled sessions that go on through whole stretches are summed up by doubling, a join at a time.  After
a version, sessions change within `late` + 1 batches (and as many as fit into the gap) or never, so each stretch also
looks that many batches ahead.  Events of one user, second and batch are summed up first: they share every session.  A
matrix has at most MOST entries, or those of one user's stretch, which its seconds and batches bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Entries of a matrix of several users.
MOST = 1 << 18
NEVER = np.iinfo(np.int64).min // 4
VERSION = ["user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s"]


def floored(x: Column, by: int) -> Column:
    """floor(x / by) of whole numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(by).cast("long")), F.lit(by).cast("long"))


def versions_of(part: np.ndarray, s: np.ndarray, first: np.ndarray, batch: np.ndarray, n: np.ndarray, h: np.ndarray, gap: int, own: int, ahead: int) -> dict[str, np.ndarray]:
    """Versions of the batches 0 to own - 1 of stretches that stand side by side, one event an entry, in order of part and s.

    first: s, or where the settled session begins that an event stands for; batch: under 0 if settled before.
    """
    size = len(s)
    new_part = np.r_[True, part[1:] != part[:-1]]
    begins = np.flatnonzero(new_part)
    low = s[begins]
    reach = np.maximum.reduceat(s, begins) - low + gap + 1
    line = s - np.repeat(low - (np.cumsum(reach) - reach), np.diff(np.r_[begins, size]))  # times, parts one after the other
    rows = np.arange(-1, own + ahead)
    active = batch[None, :] <= rows[:, None]
    last = np.maximum.accumulate(np.where(active, line[None, :], NEVER), axis=1)
    before = np.concatenate([np.full((len(rows), 1), NEVER), last[:, :-1]], axis=1)
    begin = active & (line[None, :] - before > gap)
    entry = np.flatnonzero(active)
    row, col = entry // size, entry % size
    ids = np.cumsum(begin.ravel()[entry]) - 1
    starts = np.flatnonzero(np.diff(ids, prepend=-1))
    if not len(starts):
        return {c: np.zeros(0, np.int64) for c in ["col", *VERSION[1:]]}
    ends = np.r_[starts[1:], len(entry)] - 1
    n_events, h_sum = np.add.reduceat(n[col], starts), np.add.reduceat(h[col], starts)
    n_new = np.add.reduceat(np.where(batch[col] == rows[row], n[col], 0), starts)
    at, snapshot, a, z = entry[starts], row[starts], col[starts], col[ends]
    start_s, end_s = first[a], np.maximum.reduceat(s[col], starts)
    keep = np.flatnonzero((n_new > 0) & (snapshot >= 1) & (snapshot <= own))
    r, a, z = snapshot[keep], a[keep], z[keep]
    n_retracted = np.searchsorted(at, (r - 1) * size + z, "right") - np.searchsorted(at, (r - 1) * size + a, "left")
    by_batch, by_start = np.full(len(keep), NEVER), np.full(len(keep), NEVER)
    for k in range(1, ahead + 1):
        there = np.searchsorted(at, (r + k) * size + a, "right") - 1  # the session in a later snapshot
        hit = (by_batch == NEVER) & (n_new[there] > 0)
        by_batch[hit], by_start[hit] = rows[r[hit] + k], start_s[there[hit]]
    return {"col": a, "batch": rows[r], "start_s": start_s[keep], "end_s": end_s[keep], "n_events": n_events[keep], "n_new": n_new[keep], "n_retracted": n_retracted, "h_sum": h_sum[keep], "retracted_batch": by_batch, "retracted_start_s": by_start}


def settled(cells: DataFrame, edge: Column, gap: int) -> DataFrame:
    """(user, part, s, first, n, h): the session of the settled past that reaches up to each part, as one event at its end.

    cells(user, part, s, n, h) are all events by the part before whose stretch they settle; edge: where a part's past ends.
    """
    here = Window.partitionBy("user", "part").orderBy("s")
    begins = F.coalesce(F.col("s") - F.lag("s").over(here) > gap, F.lit(True)).cast("int")
    run = cells.groupBy("user", "part", "s").agg(F.sum("n").alias("n"), F.sum("h").alias("h")).withColumn("new", begins).withColumn("run", F.sum("new").over(here))
    run = run.groupBy("user", "part", "run").agg(F.min("s").alias("first"), F.max("s").alias("s"), F.sum("n").alias("n"), F.sum("h").alias("h"))
    own = run.groupBy("user", "part").agg(F.min("first").alias("cell_first"), F.max("run").alias("runs"), F.max_by(F.struct("first", "s", "n", "h"), "run").alias("x")).select("user", "part", "cell_first", "runs", "x.*")
    now = stored(own.where(edge - F.col("s") <= gap).withColumns({"at": F.col("part"), "open": F.col("runs") == 1}), "settled")
    while True:
        before = now.select("user", (F.col("part") + 1).alias("at"), F.col("at").alias("b_at"), F.col("first").alias("b_first"), F.col("s").alias("b_s"), F.col("n").alias("b_n"), F.col("h").alias("b_h"), F.col("open").alias("b_open"))
        joined = now.where("open").join(before, ["user", "at"]).where(F.col("first") - F.col("b_s") <= gap)
        moved = stored(joined.select("user", "part", F.col("b_at").alias("at"), F.col("b_first").alias("first"), "s", (F.col("n") + F.col("b_n")).alias("n"), (F.col("h") + F.col("b_h")).alias("h"), F.col("b_open").alias("open")), "settled")
        if moved.isEmpty():
            return now.select("user", "part", "s", "first", "n", "h")
        rest = now.join(moved.select("user", "part"), ["user", "part"], "left_anti")
        now = stored(rest.select("user", "part", "at", "first", "s", "n", "h", F.lit(False).alias("open")).unionByName(moved), "settled")


def versions(events: DataFrame, gap: int = 240, batch_s: int = 1800, late: int = 3, span: int = 16) -> DataFrame:
    """All versions of the sessions of events(user, s, batch, h); the columns of VERSION, all long.

    s: seconds, batch: the batch in which an event arrives, h: a number to be summed.  n_retracted: 0 creation, 1
    extension, more merge.  retracted_batch and retracted_start_s tell the version that retracts this one, null if it stands.
    A batch comes at most `late` batches after floor(s / batch_s), and not before it; else the job fails.  Events
    without user, time or batch are left out; h null counts as 0.  Repeated rows are events of their own.
    """
    if gap < 0 or batch_s < 1 or late < 0 or span < 1:
        raise ValueError("gap and late must not be negative, batch_s and span at least 1")
    span = max(span, gap // batch_s + 1)  # so that no gap within a session reaches over a whole stretch
    ahead = late + 1 + max(0, gap - 1) // batch_s
    due = floored(F.col("s"), batch_s)
    bad = F.when((F.col("batch") < due) | (F.col("batch") > due + late), F.raise_error(F.concat(F.lit("more batches late than allowed: batch "), F.col("batch"), F.lit(", second "), F.col("s"))).cast("long")).otherwise(F.col("batch"))
    rows = events.select(*(F.col(c).cast("long").alias(c) for c in ("user", "s", "batch")), F.coalesce(F.col("h").cast("long"), F.lit(0).cast("long")).alias("h")).where("user is not null and s is not null and batch is not null")
    rows = rows.withColumn("batch", bad).groupBy("user", "s", "batch").agg(F.count("*").alias("n"), F.sum("h").alias("h"))
    rows = stored(rows, "session-events")
    # part p has the batches from p * span - ahead on, and all events from batch p * span - ahead - late on
    last = floored(due + ahead + late, span)
    past = settled(rows.select("user", last.alias("part"), "s", "n", "h"), ((F.col("part") + 1) * span - ahead - late) * batch_s, gap)
    dealt = rows.select("user", F.explode(F.sequence(floored(F.col("batch"), span), last)).alias("part"), "s", F.col("s").alias("first"), "batch", "n", "h")
    settled_ = past.select("user", (F.col("part") + 1).alias("part"), "s", "first", F.lit(None).cast("long").alias("batch"), "n", "h")
    lines = dealt.unionByName(settled_)
    schema = pa.schema([(c, pa.int64()) for c in VERSION])

    def found(columns: list[np.ndarray]) -> pa.RecordBatch:
        user, part, s, first, batch, n, h, settled_before = columns
        base = part * span - ahead
        relative = np.where(settled_before, -1, np.maximum(batch - base, -1))
        which = np.cumsum(np.r_[True, (user[1:] != user[:-1]) | (part[1:] != part[:-1])])
        out = versions_of(which, s, first, relative, n, h, gap, span, ahead)
        shift = base[out["col"]]
        out["user"], out["batch"] = user[out["col"]], out["batch"] + shift
        final = out["retracted_batch"] == NEVER
        out["retracted_batch"] = out["retracted_batch"] + shift
        return pa.RecordBatch.from_arrays([pa.array(out[c], mask=final) if c.startswith("retracted") else pa.array(out[c]) for c in VERSION], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, held = max(1, MOST // (span + ahead + 1)), None
        for b in batches:
            absent = b.column("batch").is_null().to_numpy(zero_copy_only=False)
            new = [b.column(c).fill_null(0).to_numpy() for c in ("user", "part", "s", "first", "batch", "n", "h")] + [absent]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            cut = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1  # the last stretch may go on
            at = 0
            while len(cut) and cut[-1] > at:
                fits = cut[(cut > at) & (cut <= at + most)]
                to = int(fits[-1]) if len(fits) else int(cut[cut > at][0])
                yield found([x[at:to] for x in held])
                at = to
            held = [x[at:] for x in held]
        if held is not None and len(held[0]):
            yield found(held)

    return lines.repartition("user", "part").sortWithinPartitions("user", "part", "s", "batch").mapInArrow(read, ", ".join(f"{c} long" for c in VERSION))
