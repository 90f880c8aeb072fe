"""Test passages inside a training corpus: rare n-gram seeds, then Smith-Waterman alignment.

1. One pass reads and hashes the words of every document and notes where it has a run of SEED words that some test item
   has. Only documents with such a run are kept, as hashes.
2. The runs are counted (map-side sums; only runs that items have). Of each window of MIN_RUN item words the rarest run
   that the corpus has is a seed. So a document that holds any MIN_RUN consecutive words of an item holds one of the
   item's seeds: nothing is lost. A window whose other runs occur nowhere, as in an edited copy, is sought by what is
   left of it, be that a common phrase.
3. Each (document, item) pair with a seed is aligned. The alignment decides: a copy of MIN_RUN words scores at least
   MATCH x MIN_RUN, and an edited copy is one whose alignment covers enough of the item with equal words.

The test set is a query set: it is split into blocks of BLOCK_ITEMS, each small enough to broadcast (some MB), so that
its size isn't assumed; the corpus is hashed once for all blocks. It is never shuffled nor collected.

Defined cases: null, empty and short items leak nowhere; null and empty documents and rows without id hold nothing; repeated items count
once; items of one id with different texts all count under that id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.llm.words import Hasher, words
from missiva.sources.tables import cut

MIN_RUN, SEED, BLOCK_ITEMS = 12, 5, 20_000
#: Smith-Waterman scores of an equal word, a different word and a gap.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of an item's words that an edited copy keeps, by alignment.
COVER = 0.5
#: Cells of one step of the alignment; bits for the number of equal words and for the first word, beside the score.
CELLS, BITS = 1 << 18, 20


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Best local alignment of each pair of runs of word hashes, many at once: rows of (score, first word and end in a,
    equal words, longest run of equal words). A cell holds its score in the high bits, and in the low ones the equal
    words and the first word of its alignment. Gaps along a row are a running maximum, since each costs the same."""
    out = np.zeros((len(pairs), 5), np.int64)
    order = sorted(range(len(pairs)), key=lambda p: (len(pairs[p][0]), len(pairs[p][1])))
    at = 0
    one = np.int64(1) << (2 * BITS)
    while at < len(order):
        end, widest = at, 1
        while end < len(order):
            widest = max(widest, len(pairs[order[end]][1]))
            if end > at and (end - at + 1) * widest > CELLS:
                break
            end += 1
        block = order[at:end]
        at = end
        n, m = max(len(pairs[p][0]) for p in block), max(1, max(len(pairs[p][1]) for p in block))
        a, b = np.zeros((len(block), n), np.uint64), np.ones((len(block), m), np.uint64)  # no word's hash is 0 or 1
        for r, p in enumerate(block):
            a[r, : len(pairs[p][0])], b[r, : len(pairs[p][1])] = pairs[p]
        h, run = np.zeros((len(block), m + 1), np.int64), np.zeros((len(block), m + 1), np.int32)
        best, stop, longest = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64), np.zeros(len(block), np.int32)
        slope = np.arange(m + 1, dtype=np.int64) * (-GAP * one)
        equal_step, other_step, gap = MATCH * one + (np.int64(1) << BITS), MISMATCH * one, GAP * one
        for i in range(n):
            same = a[:, i, None] == b
            before = np.where(h[:, :-1] >= one, h[:, :-1], i)  # a new alignment begins at word i
            nxt = np.zeros_like(h)
            np.maximum(before + np.where(same, equal_step, other_step), h[:, 1:] + gap, out=nxt[:, 1:])
            nxt[nxt < one] = 0
            h = np.maximum.accumulate(nxt + slope, axis=1) - slope
            h[h < one] = 0
            run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            top = h.max(1)
            better = (top >> (2 * BITS)) > (best >> (2 * BITS))
            best[better], stop[better] = top[better], i + 1
            np.maximum(longest, run.max(1), out=longest)
        mask = (np.int64(1) << BITS) - 1
        out[block] = np.stack([best >> (2 * BITS), best & mask, stop, (best >> BITS) & mask, longest], 1)
    return out


def _runs(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the SEED words from each position; runs over the end of a document are 0."""
    runs = np.zeros(len(h), np.int64)
    r = Hasher.runs(h, SEED)
    runs[: len(r)] = r
    for k in range(1, SEED):
        at = ends[1:] - k
        runs[at[at >= np.maximum(ends[:-1], 0)]] = 0
    return runs


def _hits(runs: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in runs whose value is in the sorted sought, and its index there."""
    if not len(sought):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k = np.searchsorted(sought, runs)
    k[k == len(sought)] = 0
    at = np.flatnonzero(sought[k] == runs)
    return at, k[at]


def hashed(docs: DataFrame, kind: str) -> DataFrame:
    """(doc_id, h): the hashes of a document's words, as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "h": [hasher.words(words(t)).tobytes() for t in b["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, h binary")


def seeds(items: list[tuple[int, np.ndarray]], every: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, item), by index and sorted, distinct: of each window the rarest run that occurs; of equally rare ones the lower hash."""
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, frequency))] = np.arange(len(every))
    absent = frequency == 0
    rank[absent] = len(every)
    by_rank = np.empty(len(every) + 1, np.int64)
    by_rank[rank] = np.arange(len(every))
    width = MIN_RUN - SEED + 1
    parts = [np.empty((0, 2), np.int64)]
    for k, (_, h) in enumerate(items):
        own = rank[np.searchsorted(every, Hasher.runs(h, SEED))]
        least = np.unique(np.lib.stride_tricks.sliding_window_view(own, width).min(1))
        least = by_rank[least[least < len(every)]]
        parts.append(np.stack([least, np.full(len(least), k)], 1))
    both = np.concatenate(parts)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    return both[:, 0], both[:, 1]


def _block(words_of: DataFrame, items: list[tuple[int, np.ndarray]], kind: str) -> DataFrame:
    sc = words_of.sparkSession.sparkContext
    every = np.unique(np.concatenate([np.empty(0, np.int64), *(Hasher.runs(h, SEED) for _, h in items)]))
    shared = sc.broadcast(every)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends = np.cumsum([0, *(len(x) // 8 for x in b["h"])])
            at, k = _hits(_runs(np.frombuffer(b"".join(b["h"]), np.uint64), ends), shared.value)
            first = np.searchsorted(at, ends)
            has = np.flatnonzero(np.diff(first))
            rows = b.iloc[has].copy()
            rows["at"] = [(at[first[d] : first[d + 1]] - ends[d]).astype(np.int32).tobytes() for d in has]
            rows["k"] = [k[first[d] : first[d + 1]].astype(np.int32).tobytes() for d in has]
            yield rows[["doc_id", "h", "at", "k"]]

    marked = cut(words_of.mapInPandas(mark, f"doc_id {kind}, h binary, at binary, k binary"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(shared.value), np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b["k"]), np.int32), minlength=len(total))
        k = np.flatnonzero(total)
        yield pd.DataFrame({"k": k, "n": total[k]})

    frequency = np.zeros(len(every), np.int64)
    # At most the runs of the items of this block.
    for r in marked.select("k").mapInPandas(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():
        frequency[r["k"]] = r["n"]
    table = sc.broadcast((*seeds(items, every, frequency), items))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seed, of, test = table.value
        for b in batches:
            pairs, keys = [], []
            for doc, raw, at, k in b.itertuples(index=False):
                h, at, k = np.frombuffer(raw, np.uint64), np.frombuffer(at, np.int32), np.frombuffer(k, np.int32)
                lo, hi = np.searchsorted(seed, k), np.searchsorted(seed, k, "right")
                near: dict[int, list[int]] = defaultdict(list)
                for p, x, y in zip(at.tolist(), lo.tolist(), hi.tolist()):
                    for item in of[x:y].tolist():
                        near[item].append(p)
                for item, places in near.items():
                    key, query = test[item]
                    # Seeds far from each other are aligned apart: an item reaches no further than twice its length.
                    reach, groups = 2 * len(query), [[places[0], places[0]]]
                    for p in places[1:]:
                        if p - groups[-1][1] <= reach:
                            groups[-1][1] = p
                        else:
                            groups.append([p, p])
                    for x, y in groups:
                        pairs.append((query, h[max(0, x - reach) : y + SEED + reach]))
                        keys.append((doc, key, len(query)))
            found = align(pairs)
            cols = {"doc_id": [x[0] for x in keys], "item_id": [x[1] for x in keys], "score": found[:, 0], "aligned": found[:, 2] - found[:, 1]}
            yield pd.DataFrame(cols | {"matched": found[:, 3], "item_words": [x[2] for x in keys], "run": found[:, 4]})

    return marked.mapInPandas(find, f"doc_id {kind}, item_id bigint, score int, aligned int, matched int, item_words int, run int")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs(doc_id, text), items(item_id, text): one row per document, item and place with a seed of it:
    (doc_id, item_id, score, aligned, matched, item_words, run). aligned is how many of the item's words the best
    alignment spans, matched how many of them are equal, run the longest run of equal words at that place."""
    hasher = Hasher()
    texts = items.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    docs = docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = max(1, -(-texts.count() // BLOCK_ITEMS))
    words_of = hashed(docs, kind)
    if blocks > 1:
        words_of = cut(words_of)
    parts = []
    for b in range(blocks):
        own = texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        block = [(r["item_id"], hasher.words(words(r["text"]))) for r in own]
        parts.append(_block(words_of, [x for x in block if len(x[1]) >= MIN_RUN], kind))
    return reduce(DataFrame.unionByName, parts)


def contained(found: DataFrame) -> DataFrame:
    """(doc_id, item_id) of alignments good enough for MIN_RUN equal words in a row, and that have them."""
    return found.filter((F.col("score") >= MATCH * MIN_RUN) & (F.col("run") >= MIN_RUN)).select("doc_id", "item_id").distinct()


def edited(found: DataFrame) -> DataFrame:
    """(doc_id, item_id, covered, score) of whole and edited copies: the alignment keeps at least COVER of the item's words."""
    covered = F.col("matched") / F.col("item_words")
    best = found.withColumn("covered", covered).filter(F.col("covered") >= COVER).groupBy("doc_id", "item_id")
    return best.agg(F.max("covered").alias("covered"), F.max("score").alias("score"))
