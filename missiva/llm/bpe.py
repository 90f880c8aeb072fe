"""Encoding of a whole corpus with a public byte-level BPE.

Two tiers. Whole pre-tokens that are in the vocabulary are resolved by a minimal perfect hash (hash, displace): one
slot computation and one comparison, no collisions. The others are merged with a heap over linked bytes: each live
adjacent pair is in the heap by rank, merged pairs relink their neighbours, stale entries are skipped.

Both tables depend on the vocabulary only (a few MB at most, whatever the corpus), so they are broadcast; texts stay
where they are: there is no shuffle.

Defined cases: a null or empty text gives an empty list; strings that look like special tokens are ordinary text;
lone surrogates can't occur in Spark strings; repeated rows stay repeated.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: The published pre-token pattern of this family of vocabularies.
PRETOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens a worker remembers before it forgets them all.
REMEMBERED = 200_000


_M64 = (1 << 64) - 1


def _spread(h: int, d: int, size: int) -> int:
    """Slot of hash h under displacement d."""
    x = (h ^ (d * 0x9E3779B97F4A7C15)) & _M64
    return (((x * 0xD6E8FEB86659FD93) & _M64) >> 32) % size


def _spread_all(h: np.ndarray, d: np.ndarray, size: int) -> np.ndarray:
    """The same for all displacements (rows) and hashes (columns) at once."""
    x = h[None, :] ^ (d[:, None] * np.uint64(0x9E3779B97F4A7C15))
    return ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) % np.uint64(size)


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys in n slots. Large buckets find a displacement that puts all their
    keys in free slots; buckets of one key take any free slot directly (stored as -slot - 1)."""

    def __init__(self, items: dict[bytes, int]):
        self.size, self.buckets = max(1, len(items)), max(1, len(items) // 3)
        self.keys: list[bytes | None] = [None] * self.size
        self.values = np.zeros(self.size, np.int32)
        self.displaced = [0] * self.buckets
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for k in items:
            h = xxhash.xxh64_intdigest(k)
            groups.setdefault(h % self.buckets, []).append((h, k))
        free = np.ones(self.size, bool)
        order = sorted(groups.items(), key=lambda g: (-len(g[1]), g[0]))
        rest = iter(range(self.size))
        for b, group in order:
            if len(group) > 1:
                hashes = np.array([h for h, _ in group], np.uint64)
                for d in range(0, 1 << 40, 512):
                    slots = _spread_all(hashes, np.arange(d, d + 512, dtype=np.uint64), self.size)
                    fits = free[slots].all(1)
                    ordered = np.sort(slots[fits], axis=1)
                    good = np.flatnonzero(fits)[(ordered[:, 1:] != ordered[:, :-1]).all(1)]
                    if len(good):
                        self.displaced[b] = d + int(good[0])
                        break
            else:
                self.displaced[b] = -next(s for s in rest if free[s]) - 1
            for h, k in group:
                s = self._slot(h)
                free[s], self.keys[s], self.values[s] = False, k, items[k]

    def _slot(self, h: int) -> int:
        d = self.displaced[h % self.buckets]
        return -d - 1 if d < 0 else _spread(h, d, self.size)

    def get(self, key: bytes) -> int:
        """The value of key, or -1."""
        s = self._slot(xxhash.xxh64_intdigest(key))
        return int(self.values[s]) if self.keys[s] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: lowest rank first, ties from the left."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here; 0 once merged into an earlier part
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if end[i] != j or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        # Only entries that their own bytes merge to may be taken whole.
        self.whole = PerfectHash({k: v for k, v in ranks.items() if merge(k, ranks) == [v]})
        self._ready()

    def _ready(self) -> None:
        self.split = regex.compile(PRETOKENS).findall
        self.known: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {"ranks": self.ranks, "whole": self.whole}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def piece(self, token: str) -> list[int]:
        raw = token.encode("utf-8", "surrogatepass")
        v = self.whole.get(raw)
        return [v] if v >= 0 else merge(raw, self.ranks)

    def encode(self, text: str | None) -> list[int]:
        known, out = self.known, []
        for token in self.split(text or ""):
            ids = known.get(token)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = self.piece(token)
                if len(token) <= 64:
                    known[token] = ids
            out += ids
        return out


@cache
def encoder(name: str, folder: str = TOKENIZERS) -> Encoder:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return Encoder({base64.b64decode(a): int(b) for a, b in pairs})


def encode_column(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>) of every row; columns that aren't needed are pruned before Python."""
    shared = df.sparkSession.sparkContext.broadcast(encoder(name, folder))
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value
        for batch in batches:
            lists = [enc.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
