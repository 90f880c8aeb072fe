"""References to records that do not exist: dictionary codes, compressed bitmaps per code range and period, AND-NOT, decode.

1. Every key that is referenced or present gets an integer: a code range (hash of the key, about 16,000 keys each)
   and a position in it.
2. References become one bitmap per range and period, parents one per range and period of their creation. A bitmap is
   kept in the smallest of three containers: sorted positions, runs, or bits. Positions are gathered map-side first, so a
   key that holds a third of all references is one position early.
3. Per range, reference bits AND NOT (bits of parents that lived before the period began) leave the suspects: missing,
   deleted, late, or created within the period. Containers of references are never unpacked to bits for it.
4. Surviving bits are decoded to keys; the exact times decide between them.

Defined cases: a reference without a period (null time) is never late; repeated rows count once; an empty parent
table makes every reference missing; an empty reference table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missiva.sources.tables import cut

#: Keys aimed at in a code range, and positions of one, so that a position fits two bytes.
RANGE_KEYS, POSITIONS = 16_384, 32_768
_ARRAY, _RUNS, _BITS = b"a", b"r", b"b"


def pack(positions: np.ndarray) -> bytes:
    """The smallest container of sorted, distinct positions: two bytes each, four bytes a run, or a bit for every position."""
    p = positions.astype(np.uint16)
    breaks = np.flatnonzero(np.diff(p.astype(np.int32)) != 1) + 1
    if len(p) and 2 * (len(breaks) + 1) < len(p) and 4 * (len(breaks) + 1) <= POSITIONS // 8:
        first = np.concatenate([[0], breaks])
        return _RUNS + np.stack([p[first], np.diff(np.concatenate([first, [len(p)]])).astype(np.uint16)], 1).tobytes()
    if 2 * len(p) <= POSITIONS // 8:
        return _ARRAY + p.tobytes()
    bits = np.zeros(POSITIONS, bool)
    bits[p] = True
    return _BITS + np.packbits(bits).tobytes()


def unpack(container: bytes) -> np.ndarray:
    kind, body = container[:1], container[1:]
    if kind == _ARRAY:
        return np.frombuffer(body, np.uint16).astype(np.int64)
    if kind == _BITS:
        return np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8)))
    runs = np.frombuffer(body, np.uint16).reshape(-1, 2).astype(np.int64)
    begin = np.repeat(runs[:, 0] - np.concatenate([[0], np.cumsum(runs[:, 1])[:-1]]), runs[:, 1])
    return begin + np.arange(runs[:, 1].sum())


def bitmaps(rows: DataFrame) -> DataFrame:
    """rows(range, period, pos): (range, period, bits), one container each; it has at most POSITIONS positions."""
    sets = rows.groupBy("range", "period").agg(F.collect_set(F.col("pos").cast("smallint")).alias("positions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["bits"] = [pack(np.sort(np.asarray(p))) for p in b.pop("positions")]
            yield b

    return sets.mapInPandas(run, "range bigint, period string, bits binary")


def encode_keys(keys: DataFrame) -> DataFrame:
    """(tab, ref_id, range, pos): distinct keys with integer codes, the same on every run over the same keys."""
    keys = cut(keys.distinct())
    ranges = max(1, -(-keys.count() // RANGE_KEYS))
    hashed = keys.withColumn("part", F.pmod(F.xxhash64("tab", "ref_id"), F.lit(ranges)))
    n = F.row_number().over(Window.partitionBy("part").orderBy("tab", "ref_id")) - 1
    numbered = hashed.withColumn("n", n)
    # A range that outgrew its bitmap goes on in a further one.
    return numbered.select(
        "tab",
        "ref_id",
        (F.col("part") + F.lit(ranges) * F.floor(F.col("n") / POSITIONS)).cast("bigint").alias("range"),
        (F.col("n") % POSITIONS).cast("bigint").alias("pos"),
    )


def _suspects(refs: pd.DataFrame, alive: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """One range: walks the periods in order, keeping the OR of all parents created before."""
    known = np.zeros(POSITIONS, bool)
    alive = alive.sort_values("period")
    periods, containers, i = alive["period"].tolist(), alive["bits"].tolist(), 0
    out = []
    for period, bits in refs.sort_values("period")[["period", "bits"]].itertuples(index=False):
        while i < len(periods) and (periods[i] < period or period == ""):
            known[unpack(containers[i])] = True
            i += 1
        asked = unpack(bits)
        out.append(pd.DataFrame({"period": period, "pos": asked[~known[asked]]}))
    if out:
        rows = pd.concat(out, ignore_index=True)
        rows["range"] = refs["range"].iloc[0]
        yield rows[["range", "period", "pos"]]


def _run(refs: pd.DataFrame, alive: pd.DataFrame) -> pd.DataFrame:
    empty = pd.DataFrame({"range": [], "period": [], "pos": []}).astype({"range": "int64", "period": "str", "pos": "int64"})
    if refs.empty:
        return empty
    # A null period sorts last: by then every parent that ever lived is known.
    undated = refs[refs["period"] == ""]
    dated = refs[refs["period"] != ""]
    parts = [p for r in (dated, undated) if len(r) for p in _suspects(r, alive)]
    return pd.concat(parts, ignore_index=True) if parts else empty


def find_orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """refs(owner, at, feld, tab, ref_id) against parents(tab, ref_id, alive_from):
    (owner, feld, ref_id, state, period) with state missing, deleted or late and period yyyy-MM of at."""
    refs = cut(refs.withColumn("period", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit(""))).distinct())
    parents = cut(parents)
    by_period = refs.select("tab", "ref_id", "period").distinct()
    codes = cut(encode_keys(by_period.select("tab", "ref_id").unionByName(parents.select("tab", "ref_id"))))

    ref_bits = bitmaps(by_period.join(codes, ["tab", "ref_id"]))
    created = F.date_format("alive_from", "yyyy-MM").alias("period")
    lived = parents.filter(F.col("alive_from").isNotNull()).select("tab", "ref_id", created)
    parent_bits = bitmaps(lived.join(codes, ["tab", "ref_id"]))

    suspects = (
        ref_bits.groupBy("range")
        .cogroup(parent_bits.groupBy("range"))
        .applyInPandas(_run, "range bigint, period string, pos bigint")
        .join(codes, ["range", "pos"])
        .join(parents.withColumn("known", F.lit(True)), ["tab", "ref_id"], "left")
        .select("tab", "ref_id", "period", "known", "alive_from")
    )
    state = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("alive_from").isNull(), "deleted")
        .when(F.col("alive_from") > F.col("at"), "late")
    )
    return (
        refs.join(suspects, ["tab", "ref_id", "period"])
        .select("owner", "feld", "ref_id", state.alias("state"), F.nullif("period", F.lit("")).alias("period"))
        .filter(F.col("state").isNotNull())
        .distinct()
    )
