"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from missiva.plans import evaluation, formats, records, retrieval, streams

QUERIES = {**records.QUERIES, **retrieval.QUERIES, **evaluation.QUERIES, **formats.QUERIES, **streams.QUERIES}
SQL = {**records.SQL, **retrieval.SQL, **evaluation.SQL, **formats.SQL, **streams.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval of a batch of questions."""
    return retrieval.fuse_hits(spark, sf_dir)
