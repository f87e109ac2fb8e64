"""Encoding of texts by a public byte-level BPE tokenizer, in numpy.

A text is cut into pieces by the tokenizer's pattern. The distinct pieces of a batch that
are not yet known are put into matrices, one for each length (short ones) or range of
lengths, a row for each piece, a column for each byte, padded at the right. In every round
each row merges its leftmost pair of lowest rank: ranks come from a hashed table of pairs,
the row is closed up behind the merge, and only the two pairs beside it are looked up anew.
Rows without a mergeable pair leave the matrix. Pieces longer than LONG bytes are merged
with a heap instead, in n log n.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.barrier import once

#: Fixed value: the pattern that cuts texts into pieces for byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Default tokenizer file: base64 token and rank on each line.
DEFAULT_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces of more bytes are merged with a heap.
LONG = 64
#: Most pieces whose ids a worker keeps; bounds its memory, not the result.
KEPT_PIECES = 300_000
_NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing hash table from a pair of token ids to the rank of their merge."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        left, right, rank = [], [], []
        get = ranks.get
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a = get(token[:i])
                if a is not None and (b := get(token[i:])) is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys = (np.array(left, dtype=np.int64) << 32) | np.array(right, dtype=np.int64)
        values = np.array(rank, dtype=np.int32)
        bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.mask = (1 << bits) - 1
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, _NONE, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[todo[free]]  # of several that want a slot, the last one gets it
            placed = self.keys[slot] == keys[todo]
            self.values[slot[placed]] = values[todo[placed]]
            todo, slot = todo[~placed], (slot[~placed] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of the merges of two equally shaped arrays of ids; _NONE where there is none. Ids under 0 are padding."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        keys = keys.ravel()
        out = np.full(keys.shape, _NONE, dtype=np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._home(keys[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out.reshape(left.shape)


class ByteEncoder:
    """Byte-level BPE over a table of token ranks, which are the ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.pairs = PairTable(ranks)
        self.find = regex.compile(pattern).findall
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.ranks = ranks
        self.by_id = {r: t for t, r in ranks.items()}
        self.memory: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_lines(cls, data: bytes, pattern: str = PATTERN) -> ByteEncoder:
        """From a file's content with a base64 token and its rank on each line."""
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}, pattern)

    # -- merging --------------------------------------------------------------------------

    def _merge_matrix(self, ids: np.ndarray) -> list[tuple[int, ...]]:
        """The merged ids of every row of a right-padded (-1) matrix of byte ids."""
        result: list[tuple[int, ...]] = [()] * len(ids)
        rows = np.arange(len(ids))
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.empty((len(ids), 0), np.int32)
        while len(rows):
            least = ranks.min(axis=1) if ranks.shape[1] else np.full(len(rows), _NONE)
            done = least == _NONE
            if done.any():
                for r, row in zip(rows[done], ids[done].tolist(), strict=True):
                    result[r] = tuple(i for i in row if i >= 0)
                keep = ~done
                rows, ids, ranks, least = rows[keep], ids[keep], ranks[keep], least[keep]
                if not len(rows):
                    break
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            ids[each, at] = least
            width = ids.shape[1]
            columns = np.arange(width - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
            if width == 2:
                ranks = np.empty((len(rows), 0), np.int32)
                continue
            columns = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            for shift in (-1, 0):
                p = at + shift
                ok = (p >= 0) & (p < width - 2)
                e, q = each[ok], p[ok]
                ranks[e, q] = self.pairs.ranks(ids[e, q], ids[e, q + 1])
        return result

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The merged ids of one long piece: a heap of (rank, place) over a linked list."""
        rank_of, by_id = self.ranks.get, self.by_id
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        alive: list[int | None] = list(ids)

        def rank(i: int) -> int | None:
            j = after[i]
            return None if j < 0 else rank_of(by_id[alive[i]] + by_id[alive[j]])

        heap = [(r, i, alive[i], alive[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] is not None else -1
            if j < 0 or alive[i] != a or alive[j] != b:
                continue
            alive[i], alive[j] = r, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (r2 := rank(k)) is not None:
                    heapq.heappush(heap, (r2, k, alive[k], alive[after[k]]))
        return tuple(x for x in alive if x is not None)

    def learn(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of distinct pieces."""
        out: dict[str, tuple[int, ...]] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "replace")
            n = len(raw)
            if n > LONG:
                out[p] = self._merge_long(self.bytes[np.frombuffer(raw, np.uint8)].tolist())
            else:
                buckets.setdefault(n if n <= 16 else -(-n // 16) * 16, []).append((p, raw))
        for width, members in buckets.items():
            joined = np.frombuffer(b"".join(raw.ljust(width, b"\0") for _, raw in members), np.uint8).reshape(len(members), width)
            ids = self.bytes[joined]
            lengths = np.array([len(raw) for _, raw in members])
            ids[np.arange(width) >= lengths[:, None]] = -1
            out.update(zip((p for p, _ in members), self._merge_matrix(ids), strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; an empty list for NULL and for empty texts."""
        cut = [self.find(t) if t else [] for t in texts]
        known = self.memory
        new = {p for pieces in cut for p in pieces if p not in known}
        if new:
            if len(known) + len(new) > KEPT_PIECES:
                known.clear()
                new = {p for pieces in cut for p in pieces}
            known.update(self.learn(sorted(new)))
        return [list(chain.from_iterable([known[p] for p in pieces])) for pieces in cut]


def _shared_encoder(df: DataFrame, file: str, pattern: str):
    """A function that gives a worker's encoder; the tokenizer's file (bounded: a vocabulary) is broadcast."""
    with open(file, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())
    made: list[ByteEncoder] = []

    def encoder() -> ByteEncoder:
        if not made:
            made.append(ByteEncoder.from_lines(content.value, pattern))
        return made[0]

    return encoder


def _small_batches(part: pd.Series, characters: int = 2_000_000) -> Iterator[pd.Series]:
    """A batch cut where its texts together pass a number of characters, so that memory stays bounded."""
    sizes = part.str.len().fillna(0).cumsum() // characters
    for _, piece in part.groupby(sizes, sort=True):
        yield piece


def with_ids(df: DataFrame, text: str = "text", out: str = "ids", file: str = DEFAULT_FILE, pattern: str = PATTERN) -> DataFrame:
    """Add the token ids of each text, without special tokens, as an array of integers.

    NULL and empty texts get an empty array. Strings of special tokens in a text are ordinary
    text. Whole texts are encoded, of any length. Rows are treated one by one: no shuffle.
    A column named as ``out`` is replaced; others stay.
    """
    encoder = _shared_encoder(df, file, pattern)

    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder()
        for part in parts:
            done = [pd.Series(own.encode(piece.tolist()), dtype=object) for piece in _small_batches(part)]
            yield pd.concat(done, ignore_index=True) if done else pd.Series([], dtype=object)

    return df.withColumn(out, once(encode)(F.col(text).cast("string")))


def with_size(df: DataFrame, text: str = "text", out: str = "tokens", file: str = DEFAULT_FILE, pattern: str = PATTERN) -> DataFrame:
    """Add the number of tokens of each text; 0 for NULL and empty texts."""
    encoder = _shared_encoder(df, file, pattern)

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder()
        for part in parts:
            done = [pd.Series([len(i) for i in own.encode(piece.tolist())], dtype="int64") for piece in _small_batches(part)]
            yield pd.concat(done, ignore_index=True) if done else pd.Series([], dtype="int64")

    return df.withColumn(out, once(count)(F.col(text).cast("string")))
