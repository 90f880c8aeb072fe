"""Oversized texts into passages at natural boundaries.

Agglomerative: a text falls into atomic segments (words, with what follows them), each boundary between neighbours has
a strength (paragraph, line, sentence, clause, word). All adjacent pairs wait in a heap; the weakest boundary is merged
first (then the smallest union, then the leftmost) while both together with the overlap still fit. What remains are
pieces whose boundaries were the strongest. A passage is a piece with the tail of the text before it in front.

Defined cases: null, empty and blank texts give no passage; a text within the limit gives itself; a word longer than
fits is cut by code points; lengths are code points once runs of white space are one space and the ends trimmed.
Work per text is n log n in its words, whatever its length.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as in str.split(), for the JVM.
SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}]+"
_WORD = re.compile(r"(\S+)(\s*)")
_SENTENCE = re.compile(r"[.!?…]+[\"'»«”’)\]]*$")
_CLAUSE = re.compile(r"[;:,–—]+[\"'»«”’)\]]*$")
#: Abbreviations and initials that end no sentence.
_SHORT = re.compile(r"^(?:\W*\w{1,2}|\d+|usw|etc|Nr|Bl|Cod|Ms|St|Dr|Mag|vgl|hl|Anm|Fol|fol)\.$")


def strength(word: str, gap: str) -> int:
    """Of the boundary after word: 4 paragraph, 3 line, 2 sentence, 1 clause, 0 between words."""
    lines = gap.count("\n")
    if lines >= 2:
        return 4
    if word[-1].isalnum():  # neither a sentence nor a clause ends here
        return 1 if lines else 0
    if _SENTENCE.search(word) and not _SHORT.match(word):
        return 3 if lines else 2
    if lines:
        return 2 if word.endswith((";", ":")) else 1
    return 1 if _CLAUSE.search(word) else 0


def split(text: str | None, limit: int = 800, overlap: int = 150) -> list[tuple[int, int, int, str]]:
    """(begin, end, overlap, passage) in order: [begin, end) is the new part in the normalised text, overlap how many
    characters before begin stand in front of it. Without the overlaps the passages give the whole text again."""
    return [(b, e, o, p) for b, e, o, _, _, p in split_at(text, limit, overlap)]


def split_at(text: str | None, limit: int = 800, overlap: int = 150) -> list[tuple[int, int, int, int, int, str]]:
    """(begin, end, overlap, source begin, source end, passage): also where the new part stands in the text as it is."""
    words = list(_WORD.finditer(text or ""))
    if not words:
        return []
    room = limit - overlap - 1
    atoms: list[str] = []
    strengths: list[int] = []
    source: list[int] = []
    for m in words:
        word, gap = m.groups()
        s = strength(word, gap)
        cuts = [word[i : i + room] for i in range(0, len(word), room)]
        atoms += cuts
        strengths += [-1] * (len(cuts) - 1) + [s]
        source += range(m.start(), m.end(1), room)
    begin, at = [], 0
    for a, s in zip(atoms, strengths):
        begin.append(at)
        at += len(a) + (s >= 0)
    whole = "".join(a + (" " if s >= 0 else "") for a, s in zip(atoms, strengths)).rstrip(" ")
    if len(whole) <= limit:
        return [(0, len(whole), 0, source[0], source[-1] + len(atoms[-1]), whole)]
    n = len(atoms)
    stop = [b + len(a) for b, a in zip(begin, atoms)]
    last = list(range(n))  # last atom of the piece that begins with this atom
    first = list(range(n))  # first atom of the piece that ends with this atom
    alive = [True] * n
    # Strength, size, first and last atom of a union in one number, so that the heap compares numbers.
    wide = n.bit_length()
    mask = (1 << wide) - 1
    heap: list[int] = []

    def offer(i: int) -> None:
        j = last[i] + 1
        if j < n and (size := stop[last[j]] - begin[i]) <= room:
            heapq.heappush(heap, ((strengths[j - 1] + 1) * (room + 1) + size << 2 * wide) | i << wide | last[j])

    for i in range(n):
        offer(i)
    while heap:
        key = heapq.heappop(heap)
        i, e = key >> wide & mask, key & mask
        j = last[i] + 1
        if not alive[i] or j >= n or last[j] != e or not alive[j]:
            continue
        alive[j], last[i], first[e] = False, e, i
        offer(i)
        if i:
            offer(first[i - 1])
    out, i = [], 0
    while i < n:
        b, e = begin[i], stop[last[i]]
        front = b
        if b:
            front = max(0, b - overlap - 1)
            space = whole.find(" ", max(0, front - 1), b - 1)
            front = space + 1 if 0 <= space and front > 0 else front
        out.append((b, e, b - front, source[i], source[last[i]] + len(atoms[last[i]]), whole[front:e]))
        i = last[i] + 1
    return out


def passages(df: DataFrame, key: str, kinds: list[str], limit: int = 800, overlap: int = 150) -> DataFrame:
    """(key, kind, seq, begin_at, end_at, overlap, source_begin, source_end, passage) of the texts in the columns kinds that
    are over the limit; begin_at and end_at count in the text with single spaces, the source's in the text as stored.
    Oversized texts are chosen in the JVM, so that only they reach Python; repeated rows count once."""
    long = None
    for kind in kinds:
        size = F.length(F.trim(F.regexp_replace(F.col(kind), SPACE, " ")))
        part = df.filter(size > limit).select(F.col(key).cast("string").alias("k"), F.lit(kind).alias("kind"), F.col(kind).alias("text"))
        long = part if long is None else long.unionByName(part)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, kind, seq, *found)
                for k, kind, text in batch.itertuples(index=False)
                for seq, found in enumerate(split_at(text, limit, overlap))
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    schema = "k string, kind string, seq int, begin_at int, end_at int, overlap int, source_begin int, source_end int, passage string"
    return long.distinct().mapInPandas(run, schema).withColumnRenamed("k", key)
