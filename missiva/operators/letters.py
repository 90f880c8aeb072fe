"""References of letters to the reference tables, one row per occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.functions import variants as V
from missiva.sources.tables import current_letters, table

#: Field of a letter -> table its ids point to.
TARGETS = {"personen": "people", "orte": "orts", "sachen": "saches", "verfasser": "people"}
KEYWORDS = ("personen", "orte", "sachen")


def keyword_ids(keywords: Column) -> dict[str, Column]:
    """keywords, a parsed field: array<string> of normal-form ids per keyword field; null elements where an element holds
    no id. Parse into a column of its own first, else the text is parsed for each field."""
    return {f: F.transform(V.elements(V.member(keywords, f)), V.reference) for f in KEYWORDS}


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(brief_id, exported_at, feld, ref_id) of the counting revisions, a row per distinct reference of a letter.
    Empty references, null array elements and missing structs give no row."""
    letters = current_letters(spark, sf_dir, "exported_at", "schlagworte", "verfasser").withColumn("schlagworte", V.parse(F.col("schlagworte")))
    ids = keyword_ids(F.col("schlagworte"))
    ids["verfasser"] = F.transform(F.col("verfasser"), lambda e: V.normal_id(e["v"]["person"]["v"]))
    per_field = F.array(
        *(F.struct(F.lit(f).alias("feld"), F.array_compact(F.array_distinct(a)).alias("ids")) for f, a in ids.items())
    )
    return (
        letters.select("brief_id", "exported_at", F.explode(per_field).alias("r"))
        .select("brief_id", "exported_at", "r.feld", F.explode("r.ids").alias("ref_id"))
    )


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, ref_id, alive_from) of the reference tables: alive_from is the earliest creation of a record that isn't
    deleted, null if all are deleted. A living record without a creation time counts as always there."""
    living = F.when(F.col("deleted_at").isNull(), F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp_ntz")))
    rows = [
        table(spark, sf_dir, t).select(
            F.lit(t).alias("tab"), V.normal_id(F.col("ref_id")).alias("ref_id"), living.alias("alive")
        )
        for t in sorted(set(TARGETS.values()))
    ]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    return union.filter(F.col("ref_id").isNotNull()).groupBy("tab", "ref_id").agg(F.min("alive").alias("alive_from"))
