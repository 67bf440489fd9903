"""Byte-pair encoding and decoding with a published vocabulary.

`BpeCodec` holds the vocabulary and its merge ranks.  A pre-token is a doubly linked list of byte symbols; a heap holds
(rank, place) of adjacent pairs.  The lowest pair is merged, its new neighbours are pushed, and entries whose pair has
changed meanwhile are skipped when they come up.  Decoding concatenates vocabulary strings.

Texts are cut at single spaces between two non-space characters first: the pre-token pattern can't match across the
left side of such a space, so pieces encode independently and their ids are kept in a bounded memo.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space that always starts a pre-token: one between two characters that aren't white space.
CUT = regex.compile(r"(?<=\S) (?=\S)")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """Letter of the vocabulary file -> byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class BpeCodec:
    def __init__(self, path: str, memo: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        as_bytes = lambda token: bytes(letter[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.strings[i] = as_bytes(token)
        for token, i in self.added.items():
            self.strings[i] = token.encode()
        byte_id = {b: vocab[c] for c, b in letter.items()}
        self.first = [byte_id[b] for b in range(256)]
        #: by left id: right id -> rank, and by rank the id of what they merge to
        self.ranks: list[dict[int, int]] = [{} for _ in self.strings]
        self.merges_to: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left]][vocab[right]] = rank
            self.merges_to.append(vocab[left + right])
        #: ranks of two bytes, at 256 times the first plus the second; -1: none
        self.byte_ranks = [self.ranks[a].get(b, -1) for a in self.first for b in self.first]
        self.high = [256 * b for b in range(256)]
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.pretokens = regex.compile(PATTERN).findall
        self.of_token = Memo(self.merged, memo)
        self.of_first = Memo(lambda piece: None if not piece or piece[-1].isspace() else self.piece(piece), memo)
        self.of_inner = Memo(self.inner, memo)
        self.spaced = any(" " in t for t in self.added)
        self.plain_letters = not any(t.isascii() and t.isalpha() for t in self.added)

    def merged(self, token: str) -> bytes:
        """Ids of one pre-token, as little-endian 32-bit integers."""
        data = token.encode("utf-8", "replace")
        symbol = list(map(self.first.__getitem__, data))
        n = len(symbol)
        if n == 1:
            return array("I", symbol).tobytes()
        ranks_of, merges_to, push, pop = self.ranks, self.merges_to, heapq.heappush, heapq.heappop
        bits = n.bit_length()
        place = (1 << bits) - 1
        #: the rank of the pair that begins at each place, -1 where there is none (any more): older entries are stale
        now = list(map(self.byte_ranks.__getitem__, map(int.__add__, map(self.high.__getitem__, data), data[1:])))
        heap = [rank << bits | i for i, rank in enumerate(now) if rank >= 0]
        heapq.heapify(heap)
        now.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = pop(heap)
            i, rank = entry & place, entry >> bits
            if now[i] != rank:
                continue  # stale: one of the two has merged with another
            j = after[i]
            symbol[i] = new = merges_to[rank]
            symbol[j] = now[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                now[i] = rank = ranks_of[new].get(symbol[k], -1)
                if rank >= 0:
                    push(heap, rank << bits | i)
            else:
                now[i] = -1
            if (h := before[i]) >= 0:
                now[h] = rank = ranks_of[symbol[h]].get(new, -1)
                if rank >= 0:
                    push(heap, rank << bits | h)
        return array("I", [s for s in symbol if s >= 0]).tobytes()

    def piece(self, piece: str) -> bytes:
        if self.split_added and any(t in piece for t in self.added):
            parts = self.split_added.split(piece)
            return b"".join(np.array([self.added[p]], "<u4").tobytes() if i % 2 else self.plain(p) for i, p in enumerate(parts))
        return self.plain(piece)

    def plain(self, piece: str) -> bytes:
        return b"".join(map(self.of_token.__getitem__, self.pretokens(piece)))

    def inner(self, piece: str) -> bytes | None:
        """Ids of a space and piece; None where that space may not start a pre-token."""
        if self.plain_letters and piece.isascii() and piece.isalpha():
            return self.of_token[" " + piece]  # one pre-token
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        return self.piece(" " + piece)

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian 32-bit integers; strings of special tokens are those tokens."""
        if self.spaced:
            return self.piece(text)
        first, *rest = text.split(" ")
        ids = [self.of_first[first], *map(self.of_inner.__getitem__, rest)]
        try:
            return b"".join(ids)
        except TypeError:
            if None not in ids:
                raise
        first, *rest = CUT.split(text)  # there are runs of white space
        return self.piece(first) + b"".join([self.piece(" " + x) for x in rest])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def codec_for(path: str) -> BpeCodec:
    """The codec of a worker, with what it remembers; a worker lives on between tasks."""
    return BpeCodec(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Per row of docs(doc_id, text): n_tokens, sha256 of the ids and of the decoded text.

    Null and empty texts have no tokens; repeated rows give repeated rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            out = []
            for text in batch.column("text"):
                ids = codec.encode(text.as_py() or "")
                out.append((len(ids) // 4, sha(ids), sha(codec.decode(ids).encode())))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
