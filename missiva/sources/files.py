"""Readers and writers of the archive's file formats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from missiva.sources.tables import exists, hadoop


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Lines of JSON under a declared schema, so that no pass is spent on inferring it. Blank lines give no row; a line
    that isn't JSON fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank."""
    return spark.read.text(path).filter(F.trim("value") != "").count()


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or an empty one of the schema where there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_matrix(spark: SparkSession, path: str, dim: int, rows_per_task: int = 50_000) -> DataFrame:
    """(row, embedding) of a flat file of little-endian 32-bit floats, dim to a row. A cut last row is left out. Spark's
    binary reader holds a file in one piece, so ranges of it are listed and each task reads its own."""
    fs, p = hadoop(spark, path)
    rows = fs.getFileStatus(p).getLen() // (4 * dim)
    parts = max(1, -(-rows // rows_per_task))
    ranges = spark.range(0, rows, rows_per_task, parts)
    place = fs.resolvePath(p).toString()  # with its scheme, so that every executor reads from the same store

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, inner = FileSystem.from_uri(place.replace("file:/", "file:///", 1) if place.startswith("file:/") and not place.startswith("file:///") else place)
        with store.open_input_file(inner) as f:
            for b in batches:
                for start in b["id"]:
                    n = min(rows_per_task, rows - start)
                    flat = np.frombuffer(f.read_at(n * dim * 4, start * dim * 4), "<f4")
                    yield pd.DataFrame({"row": np.arange(start, start + n), "embedding": list(flat.reshape(n, dim))})

    return ranges.mapInPandas(load, "row bigint, embedding array<float>")


def attach(texts: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Texts that have a vector; a partly built index is served as far as it goes."""
    return texts.join(vectors, key)


def consistent(vectors: DataFrame, meta: DataFrame) -> bool:
    """Whether the number of vectors is the one the metadata says."""
    return vectors.count() == meta.first()["count"]


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Appends (id, embedding): rows are found by id, so no order has to be kept."""
    df.write.mode("append").parquet(path)


def write_meta(spark: SparkSession, path: str, **values) -> None:
    spark.createDataFrame([values]).coalesce(1).write.mode("overwrite").json(path)


def write_once(df: DataFrame, path: str) -> None:
    """A baseline: kept if there is one already."""
    df.write.mode("ignore").parquet(path)


def write_gold(df: DataFrame, path: str) -> None:
    """Gold sets, questions and the like as pretty JSON objects, one a row, written where the rows are."""
    df.select(F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_gold(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Such objects again, with source, the name of the .json file or folder they are in (null outside of one). A file may
    hold several objects, each ending with a brace alone in its line."""
    rows = spark.read.option("lineSep", "\n}").text(path).select(F.concat("value", F.lit("\n}")).alias("value"), F.col("_metadata.file_path").alias("place"))
    rows = rows.filter(F.trim(F.regexp_replace("value", r"[\s}]", "")) != "")
    source = F.nullif(F.regexp_extract("place", r"/([^/]+)\.json(?:/|$)", 1), F.lit("")).alias("source")
    return rows.select(source, F.from_json("value", schema).alias("x")).select("source", "x.*")


def read_fixtures(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The JSON files of a folder by what their names begin with; other names are left alone."""
    return {name: read_gold(spark, f"{folder}/{name}*.json", schema) for name, schema in schemas.items()}


def review_sheet(rows: DataFrame) -> DataFrame:
    """rows(qid, question, answer, sources array<string>): (qid, sheet), a question's part of a Markdown sheet for a human
    reviewer: question, answer, the first ten sources, and a line to grade it."""
    shown = F.array_join(F.transform(F.slice(F.coalesce("sources", F.array().cast("array<string>")), 1, 10), lambda s: F.concat(F.lit("- Brief "), s)), "\n")
    sheet = F.concat_ws("\n\n", F.concat(F.lit("## "), "qid"), F.concat(F.lit("**"), "question", F.lit("**")), F.coalesce("answer", F.lit("(keine Antwort)")), F.nullif(shown, F.lit("")), F.lit("Note: ____"))
    return rows.select("qid", sheet.alias("sheet"))
