"""Columns over JSON of varying shape: envelopes, one-element arrays standing bare, id notations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An id is 24 hex digits, whatever stands around it.
ID_PATTERN = r"(?<![0-9A-Fa-f])([0-9A-Fa-f]{24})(?![0-9A-Fa-f])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds value once; without it nested uses would double the expression at each level."""
    return F.transform(F.array(value), body)[0]


def parse(text: Column) -> Column:
    """Variant of a JSON text. Null, blank and invalid texts, and texts with anything after the value, give null:
    the text is parsed as the only element of an array, so that the whole of it must be one value."""
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return let(alone, lambda a: F.when(F.size(a) == 1, a[0]))


def bare(v: Column) -> Column:
    """The value without its {m, v} envelope (an object with a member v); two envelopes may lie around each other."""
    once = lambda x: F.coalesce(F.try_variant_get(x, "$.v", "variant"), x)
    return let(once(v), once)


def member(v: Column, name: str) -> Column:
    return F.try_variant_get(bare(v), f"$.{name}", "variant")


def elements(v: Column) -> Column:
    """array<variant>: the array, or one element standing alone; null and missing give null."""
    return let(
        bare(v),
        lambda u: F.coalesce(
            F.try_variant_get(u, "$", "array<variant>"),
            F.when(u.isNotNull() & ~F.is_variant_null(u), F.array(u)),
        ),
    )


def _scalar(u: Column) -> Column:
    """The same of a value without envelope."""
    return let(
        F.try_variant_get(u, "$", "string"),
        lambda t: F.when((F.trim(t) != "") & ~F.schema_of_variant(u).rlike("^(OBJECT|ARRAY|VOID)"), t),
    )


def scalar(v: Column) -> Column:
    """The text of a string, number or boolean; null for objects, arrays, nulls and blank strings."""
    return let(bare(v), _scalar)


def normal_id(text: Column) -> Column:
    """24 lower-case digits; a text that holds no id is kept trimmed, a blank one is null."""
    plain = lambda: F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))
    return F.lower(let(F.regexp_extract(text, ID_PATTERN, 1), lambda found: F.when(found != "", found).otherwise(plain())))


def reference(v: Column) -> Column:
    """An id in any notation: string, ObjectId("..."), {"$oid": ...}."""
    return let(bare(v), lambda u: let(F.coalesce(F.try_variant_get(u, "$['$oid']", "string"), _scalar(u)), normal_id))
