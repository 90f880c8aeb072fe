"""Queries over the raw letter records: p3 (nested records) and p4 (orphan references), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.operators import letters, nested, orphans
from missiva.sources.tables import current_letters


def p3_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All child elements of all letters, with or without a value, linked to letter and parent."""
    rows = current_letters(spark, sf_dir, *nested.LETTER_LEVELS)
    return nested.flatten(rows, "brief_id", nested.LETTER_LEVELS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.with_value(p3_nodes(spark, sf_dir)).select("brief_id", "child", "path", "val")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.create_map(*(F.lit(x) for kv in letters.TARGETS.items() for x in kv))
    refs = letters.references(spark, sf_dir).select(
        F.col("brief_id").alias("owner"), F.col("exported_at").alias("at"), "feld", target[F.col("feld")].alias("tab"), "ref_id"
    )
    found = orphans.find_orphans(refs, letters.parents(spark, sf_dir))
    return found.select(F.col("owner").alias("brief_id"), "feld", "ref_id", "state", F.col("period").alias("monat"))


def p4_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per field, state and month of export."""
    return p4_found(spark, sf_dir).groupBy("feld", "state", "monat").agg(
        F.count("*").alias("refs"), F.countDistinct("brief_id").alias("briefs")
    )


QUERIES = {"p3_found": p3_found, "p3_nodes": p3_nodes, "p4_found": p4_found, "p4_per_month": p4_per_month}


# --- the same in SQL -------------------------------------------------------------------------------------------------


def _bare(x: str) -> str:
    return f"(CASE WHEN json_type({x}) = 'OBJECT' AND json_exists({x}, '$.v') THEN json_extract({x}, '$.v') ELSE {x} END)"


def _list(x: str) -> str:
    u = _bare(x)
    return (
        f"(CASE WHEN json_type({u}) = 'ARRAY' THEN json_extract({u}, '$[*]') "
        f"WHEN {u} IS NULL OR json_type({u}) = 'NULL' THEN [] ELSE [{u}] END)"
    )


def _member(x: str, name: str) -> str:
    return f"json_extract({_bare(x)}, '$.{name}')"


def _scalar(x: str) -> str:
    u = _bare(x)
    return f"(CASE WHEN json_type({u}) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN nullif(trim({u} ->> '$'), '') END)"


def _id(x: str) -> str:
    u = _bare(x)
    return f"nullif(regexp_extract(lower(coalesce({u} ->> '$.\"$oid\"', {_scalar(x)})), '[0-9a-f]{{24}}'), '')"


LETTERS_SQL = """letters AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brief_id ORDER BY rev DESC, loaded_at DESC) AS k FROM briefs WHERE brief_id IS NOT NULL) WHERE k = 1
), js AS (
  SELECT brief_id, exported_at, verfasser,
    CASE WHEN json_valid(schlagworte) THEN schlagworte::JSON END AS schlagworte,
    CASE WHEN json_valid(datierung) THEN datierung::JSON END AS datierung,
    CASE WHEN json_valid(transkription) THEN transkription::JSON END AS transkription
  FROM letters)"""


def _level(name: str, source: str, parent: str, value: str, top: bool) -> str:
    path = "(p - 1)::VARCHAR" if top else "path || '/' || (p - 1)::VARCHAR"
    return (
        f"{name} AS (SELECT brief_id, {path} AS path, l[p] AS e FROM (SELECT brief_id, {'NULL' if top else 'path'} AS path, "
        f"{_list(_member(parent, name))} AS l FROM {source}), unnest(range(1, len(l) + 1)) AS r(p))"
    )


def _p3_sql(then: str) -> str:
    parts, selects = [LETTERS_SQL], []
    for column, levels in nested.LETTER_LEVELS.items():
        for level in levels:
            source, parent, top = "js", column, True
            while level:
                parts.append(_level(level.name, source, parent, level.value, top))
                value = "e"
                for m in level.value.split(".") if level.value else []:
                    value = _member(value, m)
                val = _scalar(value) if level.value else _id("e")
                selects.append(f"SELECT brief_id, '{level.name}' AS child, path, {val} AS val FROM {level.name}")
                source, parent, top = level.name, "e", False
                level = level.below[0] if level.below else None
    return "WITH " + ",\n".join(parts) + "\n" + then.format("\nUNION ALL ".join(selects))


REFS_SQL = LETTERS_SQL + ",\nrefs AS (" + "\nUNION ".join(
    [
        f"SELECT brief_id, exported_at, '{f}' AS feld, '{letters.TARGETS[f]}' AS tab, {_id('e')} AS ref_id "
        f"FROM (SELECT brief_id, exported_at, unnest({_list(_member('schlagworte', f))}) AS e FROM js)"
        for f in letters.KEYWORDS
    ]
    + [
        "SELECT brief_id, exported_at, 'verfasser' AS feld, 'people' AS tab, "
        "nullif(regexp_extract(lower(e.v.person.v), '[0-9a-f]{24}'), '') AS ref_id "
        "FROM (SELECT brief_id, exported_at, unnest(verfasser) AS e FROM js)"
    ]
) + ")"

_P4_SQL = (
    "WITH "
    + REFS_SQL
    + """, par AS (
  SELECT tab, ref_id, min(created_at) FILTER (WHERE deleted_at IS NULL) AS alive_from FROM (
    SELECT 'people' AS tab, ref_id, created_at, deleted_at FROM people UNION ALL SELECT 'orts', ref_id, created_at, deleted_at FROM orts
    UNION ALL SELECT 'saches', ref_id, created_at, deleted_at FROM saches) GROUP BY ALL
), found AS (
  SELECT brief_id, feld, r.ref_id, CASE WHEN p.tab IS NULL THEN 'missing' WHEN alive_from IS NULL THEN 'deleted' WHEN alive_from > exported_at THEN 'late' END AS state,
    strftime(exported_at, '%Y-%m') AS monat
  FROM refs r LEFT JOIN par p ON r.tab = p.tab AND r.ref_id = p.ref_id WHERE r.ref_id IS NOT NULL)
"""
)

SQL = {
    "p3_found": _p3_sql("SELECT * FROM ({}) WHERE val IS NOT NULL"),
    "p3_nodes": _p3_sql("SELECT *, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS parent_path FROM ({})"),
    "p4_found": _P4_SQL + "SELECT * FROM found WHERE state IS NOT NULL",
    "p4_per_month": _P4_SQL
    + "SELECT feld, state, monat, count(*) AS refs, count(DISTINCT brief_id) AS briefs FROM found WHERE state IS NOT NULL GROUP BY ALL",
}
