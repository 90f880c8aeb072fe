"""Deeply nested records into flat tables that keep the link from child to parent.

The JVM brings every JSON field into one typed nested shape (list of struct(val, child lists)). The Arrow stage then
works on whole buffers: list offsets give the child arrays, the parent-index kernel says which parent each element
has, and keys and paths are propagated by vectorised take. No row is parsed or looped over in Python.

Defined cases: null, blank or invalid JSON gives no row; null and empty elements keep their position; an element
without a value still has children; an array of one element may stand bare; any value may be in a {m, v} envelope.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.functions import variants as V


@dataclass(frozen=True)
class Level:
    """One array: its member name, how an element's value is read, and the arrays below it."""

    name: str
    value: str  # "" an id, "." the element itself, else a path of members
    below: tuple[Level, ...] = field(default_factory=tuple)


#: The arrays of a letter, by JSON field.
LETTER_LEVELS = {
    "schlagworte": (Level("personen", ""), Level("orte", ""), Level("sachen", "")),
    "datierung": (Level("alternativen", "am.j", (Level("belege", "sig"),)),),
    "transkription": (Level("seiten", "nr", (Level("zeilen", "n", (Level("noten", "typ"),)),)),),
}


def _value(element: Column, path: str) -> Column:
    if path == "":
        return V.reference(element)
    for name in [] if path == "." else path.split("."):
        element = V.member(element, name)
    return V.scalar(element)


def typed(parent: Column, level: Level) -> Column:
    """array<struct<val, child arrays>> of one level below parent."""

    def element(e: Column) -> Column:
        return F.struct(_value(e, level.value).alias("val"), *(typed(e, c).alias(c.name) for c in level.below))

    return F.transform(V.elements(V.member(parent, level.name)), element)


def _emit(rows: pa.Array, path: pa.Array | None, lists: pa.Array, level: Level) -> Iterator[tuple]:
    """(level name, row index, path, parent path, value) of the elements in lists; rows and path are the parents'."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    parent = pc.list_parent_indices(lists)
    items = pc.list_flatten(lists)
    if not len(items):
        return
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    starts = lengths.cumsum() - lengths
    at = pa.array(starts).take(parent)
    pos = pc.subtract(pa.array(np.arange(len(items))), at.cast(pa.int64())).cast(pa.string())
    own = rows.take(parent)
    above = path.take(parent) if path is not None else pa.nulls(len(items), pa.string())
    here = pos if path is None else pc.binary_join_element_wise(above, pos, "/")
    yield level.name, own, here, above, pc.struct_field(items, "val")
    for child in level.below:
        yield from _emit(own, here, pc.struct_field(items, child.name), child)


def flatten(df: DataFrame, key: str, fields: dict[str, tuple[Level, ...]]) -> DataFrame:
    """(key, child, path, parent_path, val): one row per array element of the JSON fields, with val null where the
    element has none. path holds zero-based positions from the outermost array inward; parent_path is null at the top.
    Narrow: no shuffle; only the key and the typed arrays reach Python."""
    tops = [(f, lv) for f, levels in fields.items() for lv in levels]
    parsed = df.select(F.col(key).cast("string").alias("k"), *(V.parse(F.col(f)).alias(f) for f in fields))
    shaped = parsed.select("k", *(typed(F.col(f), lv).alias(f"a{i}") for i, (f, lv) in enumerate(tops)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, index = batch.column(0), pa.array(np.arange(batch.num_rows))
            for i, (_, lv) in enumerate(tops):
                for name, own, here, above, val in _emit(index, None, batch.column(i + 1), lv):
                    child = pa.repeat(pa.scalar(name, pa.string()), len(own))
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(own), child, here, above, val.cast(pa.string())],
                        names=[key, "child", "path", "parent_path", "val"],
                    )

    return shaped.mapInArrow(run, f"`{key}` string, child string, path string, parent_path string, val string")


def with_value(nodes: DataFrame) -> DataFrame:
    """Only elements that have a value."""
    return nodes.filter(F.col("val").isNotNull())
