"""The incremental stream over the archive. SQL says what has to be there when it is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.operators import archive as A
from missiva.plans import sqltext as S
from missiva.sources.tables import fresh_path
from missiva.streaming import embedding


def stream_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All public letters through the stream in two arrivals, the second repeating the first with changes."""
    folder = fresh_path(spark, "stream")
    letters = A.public(A.corpus(spark, sf_dir)).select("id", A.embed_text(F.col("titel"), F.col("subjects"), F.col("regest"), F.col("incipit")).alias("text"))
    args = (spark, f"{folder}/in", "id string, text string", f"{folder}/out", f"{folder}/state")
    letters.write.parquet(f"{folder}/in/first")
    embedding.run_available(args[0], f"{folder}/in/*", *args[2:])
    changed = letters.withColumn("text", F.concat("text", F.lit(" revidiert")))
    changed.write.parquet(f"{folder}/in/second")
    embedding.run_available(args[0], f"{folder}/in/*", *args[2:])
    vectors = spark.read.schema(embedding.VECTORS).parquet(f"{folder}/out/batch=*")
    return embedding.current(vectors, changed).select("id", F.size("embedding").alias("dim"))


QUERIES = {"stream_embed": stream_embed}
SQL = {"stream_embed": f"WITH {S.CORPUS}\nSELECT id, {embedding.DIM} AS dim FROM pub"}
