"""Table access and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, else one set by setCheckpointDir. Where neither is set, as in
    tests, a session on one machine gets a local one; a cluster has to name its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="missiva-"))
    return sc.getCheckpointDir()


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, whatever the store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    return fs.exists(p)


def fingerprint(spark: SparkSession, paths: list[str], *more) -> str:
    """A name for the state of these files: paths, lengths and times, and whatever else a result depends on."""
    seen = []
    for path in paths:
        fs, p = hadoop(spark, path)
        if fs.exists(p):
            files = fs.listStatus(p)
            seen += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    return hashlib.sha1(repr((sorted(seen), more)).encode()).hexdigest()[:20]


def stored(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table kept under this name in the shared folder; built if it isn't there. It is written beside its place and
    renamed when complete, so that no other session sees or replaces part of it."""
    path = f"{shared_dir(spark)}/{name}"
    if not exists(spark, path):
        draft = f"{path}-{uuid.uuid4().hex}"
        build().write.parquet(draft)
        fs, p = hadoop(spark, draft)
        if exists(spark, path) or not fs.rename(p, hadoop(spark, path)[1]):
            fs.delete(p, True)  # another session was first
    return spark.read.parquet(path)


def side_by_side(jobs: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Results of jobs that don't need each other: small ones leave most cores idle."""
    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as pool:
        running = {name: pool.submit(inheritable_thread_target(job)) for name, job in jobs.items()}
        return {name: job.result() for name, job in running.items()}


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that a lost executor costs a re-read and not a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_all(builds: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """The same for several tables that don't need each other."""
    return side_by_side({name: lambda b=build: cut(b()) for name, build in builds.items()})


def fresh_path(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared one, removed when the program ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def remove() -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            fs, p = hadoop(spark, path)
            fs.delete(p, True)

    atexit.register(remove)
    return path


def numbered(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Adds the row's place, from 1, within its key, by an order that leaves no ties. Rows are sorted by ranges of key and
    order over all tasks, so that a key with a third of the rows is no single task; the only small tables are the rows of
    each key in each range."""
    sorted_ = cut(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__part", F.spark_partition_id()))
    place = Window.partitionBy("__part", *keys).orderBy(*order)
    sizes = sorted_.groupBy("__part", *keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    rows = sorted_.withColumn("__place", F.row_number().over(place)).join(starts, same)
    return rows.select(*df.columns, (F.col("__place") + F.col("__before")).cast("int").alias(name))


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in order. The rank filter becomes a partial group limit before the shuffle,
    so a key that holds a third of the rows sends one row per map task."""
    rank = "__rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(rank)


def current_letters(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The counting revision of each letter: highest rev, then latest load; rows without brief_id are left out."""
    briefs = table(spark, sf_dir, "briefs").filter(F.col("brief_id").isNotNull())
    wanted = briefs.select(*dict.fromkeys(("brief_id", "rev", "loaded_at", *cols)))
    order = [F.col("rev").desc_nulls_last(), F.col("loaded_at").desc_nulls_last()]
    return latest(wanted, ["brief_id"], order).select("brief_id", *cols)
