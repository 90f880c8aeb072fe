"""Embedding as an incremental stream: new texts are embedded once, changed texts again, lost work is repeated."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.sources.tables import latest

DIM = 64
#: Texts handed to the model at once.
BATCH = 32
_SIGNS = regex.compile(r"[^\p{L}\p{N}]+")


class HashedWords:
    """Offline stand-in for a text model: signed counts of hashed words, not normalised; an empty text gives zeros."""

    def __init__(self, dim: int):
        self.dim, self.places = dim, {}

    def _place(self, word: str) -> tuple[int, int]:
        h = hashlib.md5(word.encode()).hexdigest()
        return int(h[:8], 16) % self.dim, 1 if h[8] >= "8" else -1

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in _SIGNS.sub(" ", (t or "").lower()).split():
                if w not in self.places:
                    if len(self.places) > 200_000:
                        self.places.clear()
                    self.places[w] = self._place(w)
                at, sign = self.places[w]
                out[i, at] += sign
        return out


@cache
def model(dim: int) -> HashedWords:
    """The model of this process: made by the first text that needs it, then kept for all batches and queries."""
    return HashedWords(dim)


def embed_batches(batches: Iterator[pd.Series], dim: int = DIM) -> Iterator[pd.Series]:
    """Vectors of texts, in order, BATCH at a time; a model that gives another number of vectors is an error."""
    for texts in batches:
        out: list[list[float]] = []
        for lo in range(0, len(texts), BATCH):
            part = texts.iloc[lo : lo + BATCH].tolist()
            got = model(dim).encode(part)
            if got.shape != (len(part), dim):
                raise ValueError(f"{got.shape} instead of {(len(part), dim)}")
            out += got.tolist()
        yield pd.Series(out)


def embed(text: Column, dim: int = DIM) -> Column:
    """The text's vector; the same for letters, passages and questions."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from embed_batches(batches, dim)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(text)


def pending(texts: DataFrame, done: DataFrame) -> DataFrame:
    """texts(id, text) of which done(id, hash) has no vector of the same text; adds hash."""
    return texts.withColumn("hash", F.sha1("text")).join(done.select("id", "hash"), ["id", "hash"], "left_anti")


def current(vectors: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, embedding): vectors of the texts as they are now; outdated and orphaned ones are left out."""
    same = vectors.join(texts.select("id", F.sha1("text").alias("hash")), ["id", "hash"], "left_semi")
    return latest(same, ["id"], [F.col("batch").desc()]).select("id", "embedding")


def run_available(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Embeds what came to the Parquet folder source since the last run and ends. Progress is kept in checkpoint, so a
    run that died goes on where it was; a micro-batch that is repeated writes to the same place again."""

    def write(batch: DataFrame, number: int) -> None:
        rows = latest(batch.filter("id IS NOT NULL"), ["id"], [F.sha1("text")])
        done = spark.read.schema(VECTORS).parquet(f"{target}/batch=*") if number else spark.createDataFrame([], VECTORS)
        todo = pending(rows, done)
        vectors = todo.select("id", "hash", embed(F.col("text")).alias("embedding"), F.lit(number).cast("bigint").alias("batch"))
        vectors.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


VECTORS = "id string, hash string, embedding array<float>, batch bigint"
