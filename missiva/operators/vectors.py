"""Scores of stored vectors against the vectors of a batch of questions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missiva.sources.tables import latest

#: Questions broadcast at once; a larger batch is scored block by block.
BLOCK = 1_000


def usable(vectors: DataFrame, key: str) -> DataFrame:
    """(key, embedding), the last row of each key, without null, cut, zero and non-finite vectors."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.filter((F.size("embedding") == F.col("dim")) & F.col(key).isNotNull()).filter(finite)
    return latest(rows, [key], [F.col("updated_at").desc_nulls_last(), F.col("vec_no")])


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles, as an expression; for a few rows."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def _blocks(questions: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """Questions in blocks of about BLOCK by hash: (qids, unit vectors). Only one block is at the driver at a time."""
    rows = questions.filter("vector IS NOT NULL").select("qid", "vector")
    blocks = max(1, -(-rows.count() // BLOCK))
    for b in range(blocks):
        block = rows.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).orderBy("qid").collect()
        if block:
            yield [r["qid"] for r in block], _unit(np.array([r["vector"] for r in block], np.float64))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)  # a zero vector is similar to nothing


def best(vectors: DataFrame, questions: DataFrame, keep: list[str], k: int, ties: str) -> DataFrame:
    """vectors(*keep, embedding), questions(qid, vector): (qid, *keep, score, rank) of the k best of each question, scores
    to six places, ties by a unique column. Each batch of vectors is one matrix product with a broadcast block of questions
    and hands on at most k rows a question, so neither all pairs nor the vectors are ever shuffled."""
    schema = ", ".join(f"`{c}` {t}" for c, t in vectors.select(*keep).dtypes)
    parts = []
    for ids, matrix in _blocks(questions):
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for b in batches:
                if not len(b):
                    continue
                s = np.round(q @ _unit(np.array(b["embedding"].tolist(), np.float64)).T, 6)
                n = min(k, len(b))
                least = -np.partition(-s, n - 1, axis=1)[:, n - 1]
                i, j = np.nonzero(s >= least[:, None])  # ties with the k-th too
                by = b[ties].to_numpy()[j]
                order = np.lexsort((np.unique(by, return_inverse=True)[1], -s[i, j], i))
                i, j = i[order], j[order]
                top = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[top], j[top]
                out = b[keep].iloc[j].reset_index(drop=True)
                out.insert(0, "qid", [ids[x] for x in i])
                out["score"] = s[i, j]
                yield out

        parts.append(vectors.select(*keep, "embedding").mapInPandas(run, f"qid string, {schema}, score double"))
    if not parts:
        parts = [vectors.sparkSession.createDataFrame([], f"qid string, {schema}, score double")]
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), ties))
    # The rank filter is a limit per task before the shuffle as well.
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank).filter(F.col("rank") <= k)


def pair_scores(pairs: DataFrame, vectors: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """pairs(qid, key), vectors(key, embedding), questions(qid, vector): (qid, key, score) of these pairs only."""
    both = pairs.select("qid", key).join(vectors.select(key, "embedding"), key).join(questions.filter("vector IS NOT NULL").select("qid", "vector"), "qid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, q = (_unit(np.array(b[c].tolist(), np.float64)) for c in ("embedding", "vector"))
                yield pd.DataFrame({"qid": b["qid"], key: b[key], "score": np.round((x * q).sum(1), 6)})

    return both.mapInPandas(run, f"qid string, `{key}` {dict(vectors.dtypes)[key]}, score double")
