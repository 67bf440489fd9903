"""Best-fit packing of tokenized documents into sequences of a fixed length, by hierarchical residual packing.

1. Documents become ids plus an end id; only those longer than a sequence are cut, the first piece taking the rest.
2. Pieces are dealt by a hash into parts of bounded size and packed best-fit-decreasing in each part.
3. Rounds: every `fan` parts merge.  In each round a part passes on, as items, the `carry` + 1 of its bins with most
   room; all others, full and nearly full ones first of all, are finished.  The merged part packs these items best-fit
   again.  No piece is ever dropped.

The bound `carry` loses no merge.  Two bins at most half full would have been one, so a part has at most one of them.
A bin that joins another is one of the two at most half full, so a merged part has at most `fan` bins that can join
others, and they can use at most `fan` others.  If bins can be found for them at all, they can be found among the `fan`
with most room, and each part passes on at least that many.

Null and empty texts are one piece of one end id; equal lengths are taken in the order of doc_id and piece, rows without
doc_id last; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, BpeCodec
from .common import in_bytes, stored

#: Bytes of text whose pieces one task packs.
PART_BYTES = 48 << 20
#: Characters that every version of Unicode classes alike; other texts go to the tokenizers library itself.
PLAIN = regex.compile(r"[\n\r\t -~À-ɏ]*")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class FastEncoder:
    """encode(text) -> uint32 ids, the same as the tokenizers library gives for the vocabulary in `path`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        codec = BpeCodec(path, memo=0)
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.added = list(codec.added)
        ranks = {codec.strings[i]: i for i in range(len(codec.strings)) if i not in set(codec.added.values())}
        self.in_order = codec.merges_to == sorted(codec.merges_to) and len(ranks) == 256 + len(codec.merges_to)
        self.fast = tiktoken.Encoding("of_file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if self.in_order else None

    def encode(self, text: str) -> np.ndarray:
        if self.in_order and PLAIN.fullmatch(text) and not any(t in text for t in self.added):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def pieces(docs: DataFrame, path: str, size: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = FastEncoder(path)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.concatenate([encoder.encode(text.as_py() or ""), end]).astype("<u4")
                first = len(ids) % size or size
                for k, stop in enumerate(range(first, len(ids) + 1, size)):
                    start = max(0, stop - size) if k else 0
                    part = ids[start:stop].tobytes()
                    for name, value in zip(out, (doc, k, start, stop - start, zlib.crc32(part), part if with_ids else None), strict=True):
                        out[name].append(value)
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
            names = list(out) if with_ids else list(out)[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], kinds[n]) for n in names], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, taken in the given order, and what each bin holds; each goes to the fullest bin with room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    held: list[int] = []
    open_: list[list[int]] = [[] for _ in range(size + 1)]  # bins by room
    rooms = 0  # bit r: a bin with room r is open
    for k, n in enumerate(lengths.tolist()):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                rooms &= ~(1 << room)
        else:
            room, b = size, len(held)
            held.append(0)
        bins[k], offsets[k] = b, held[b]
        held[b] += n
        if room > n:
            open_[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, held


def packed(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, fan: int = 8, carry: int = 64, with_ids: bool = False) -> DataFrame:
    """Pieces of docs with the sequence each is in (`sequence_id`, any numbers) and its place there (`offset`)."""
    if carry < fan:
        raise ValueError("carry must be at least fan")
    n_parts = max(1, -(-in_bytes(docs) // PART_BYTES))

    def going(held: np.ndarray) -> np.ndarray:
        """Which bins of a part are passed on: of those with room, the carry + 1 with most."""
        out = np.zeros(len(held), bool)
        out[np.argsort(held, kind="stable")[: carry + 1]] = True
        return out & (held < size)

    def local(pieces_: pa.Table) -> pa.Table:
        part, doc = pieces_.column("part")[0].as_py(), pieces_.column("doc_id").combine_chunks()
        length = pieces_.column("length").to_numpy()
        order = np.lexsort((pieces_.column("piece").to_numpy(), doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), -length))
        bins, offsets, held = best_fit(length[order], size)
        held = np.array(held, np.int64)
        out = pieces_.drop_columns("part").take(pa.array(order))
        for name, values in (("offset", offsets), ("bin", (part << 32) + bins), ("held", held[bins]), ("goes", going(held)[bins])):
            out = out.append_column(name, pa.array(values))
        return out

    def merge(items: pa.Table) -> pa.Table:
        child, held = items.column("bin").to_numpy(), items.column("held").to_numpy()
        order = np.lexsort((child, -held))
        child, held = child[order], held[order]
        bins, shift, now = best_fit(held, size)
        now = np.array(now, np.int64)
        first = child[np.unique(bins, return_index=True)[1]]  # a bin is named after its first item
        return pa.table({"child": child, "bin": first[bins], "shift": shift, "held": now[bins], "goes": going(now)[bins]})

    schema = PIECES + (", ids binary" if with_ids else "") + ", offset long, bin long, held long, goes boolean"
    dealt = pieces(docs, path, size, end_id, with_ids).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_parts)))
    placed = stored(dealt.groupBy("part").applyInArrow(local, schema), "packing")
    now, together, moves = placed.where("offset = 0 and goes").select("bin", "held"), 1, None
    while together < n_parts:
        together *= fan
        part = F.floor(F.shiftright("bin", 32) / together).cast("long")
        step = stored(now.groupBy(part.alias("part")).applyInArrow(merge, "child long, bin long, shift long, held long, goes boolean"), "packing-round")
        now = step.where("child = bin and goes").select("bin", "held")
        new = step.where("child <> bin").select("child", "bin", "shift")
        if moves is not None:  # bins that moved before move on with the bin they are in
            on = new.select(F.col("child").alias("at"), F.col("bin").alias("to_bin"), F.col("shift").alias("by"))
            new = moves.join(on, F.col("bin") == F.col("at"), "left").select("child", F.coalesce("to_bin", "bin").alias("bin"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift")).unionByName(new)
        moves = stored(new, "packing-moves")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    if moves is None:
        return placed.select(*columns, F.col("bin").alias("sequence_id"), "offset")
    moves = moves.select(F.col("child").alias("at"), F.col("bin").alias("to_bin"), "shift")
    out = placed.join(moves, F.col("bin") == F.col("at"), "left")
    return out.select(*columns, F.coalesce("to_bin", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
