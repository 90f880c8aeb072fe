"""How often every term occurs, and in how many records, kept up by signed deltas in a persistent store.

A batch holds only added, changed or deleted records. Of each record in it the state before (if any) counts -1 and the
state after +1; the signed changes are aggregated per term, map-side first, and appended to the partitioned store as
one small delta per term. The counts are the sum over the store's deltas.

Records are bucketed by owner: a batch reads the state of the buckets it touches and no more. After COMPACT batches the
states and deltas are merged into one of each. What counts is in a manifest, a numbered file written when a batch is
complete: a later session opens the store by it, an unfinished batch is in none and is written anew, and files are
only ever added, so a lost task can run again.

Defined cases: a record without terms counts as a record; a term twice in a record is two occurrences and one record;
repeated rows and superseded revisions change nothing, in whatever order they arrive; null terms don't count; rows
without owner are left out; a deleted record counts no more until a higher version brings it back.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.sources.tables import latest

#: Stands in field and term for the record itself, so that the number of records is one of the counts.
RECORD = "*"
#: Directories a batch's counts are spread over, by hash of the term; buckets of records; batches until they are merged.
PARTS, BUCKETS, COMPACT = 16, 64, 8
COUNTS = "feld string, term string, occurrences bigint, records bigint"
TERMS = "array<struct<feld:string,term:string>>"


class TermCounts:
    """The store at path; an existing one is opened as its last complete batch left it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = self._last() or {"number": 0, "buckets": buckets, "batches": []}

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _last(self) -> dict | None:
        fs, folder = self._fs(f"{self.path}/manifest")
        if not fs.exists(folder):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/{names[-1]}").collect())) if names else None

    def _commit(self, batches: list[str]) -> None:
        """The manifest appears under its number at once, by a rename; another writer's of that number makes it fail."""
        nxt = self.manifest | {"number": self.manifest["number"] + 1, "batches": batches}
        target = f"{self.path}/manifest/{nxt['number']:012d}.json"
        fs, draft = self._fs(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(nxt).encode()))
        out.close()
        if not fs.rename(draft, self._fs(target)[1]):
            raise RuntimeError(f"{target} was written by another session")
        self.manifest = nxt

    def _read(self, what: str, schema: str) -> DataFrame:
        """The union of the batches; each folder is read alone, so that its own subfolders are its partitions."""
        return reduce(DataFrame.unionByName, (self.spark.read.schema(schema).parquet(f"{self.path}/{b}/{what}") for b in self.manifest["batches"]))

    def _states(self, buckets: list[int] | None = None) -> DataFrame:
        """(owner, version, terms, gone) of the records in the buckets, or in all: the highest version of each."""
        rows = self._read("records", f"owner string, version bigint, terms {TERMS}, gone boolean, bucket int")
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))  # whole directories, which the scan skips
        return latest(rows, ["owner"], [F.col("version").desc()]).drop("bucket")

    def counts(self) -> DataFrame:
        """(feld, term, occurrences, records), of terms that still occur."""
        if not self.manifest["batches"]:
            return self.spark.createDataFrame([], COUNTS)
        sums = self._read("counts", COUNTS).groupBy("feld", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        return sums.filter(F.col("records") > 0)

    @staticmethod
    def _signed(terms, gone, sign: int):
        """array<(feld, term, occurrences, records)> of a state: in the sorted terms the first of a run of equals stands for
        the record. Empty for no state and a deleted one."""
        listed = F.concat(F.array(F.struct(F.lit(RECORD).alias("feld"), F.lit(RECORD).alias("term"))), F.array_sort(F.filter(terms, lambda t: t["term"].isNotNull())))
        flagged = F.transform(
            F.arrays_zip(listed.alias("x"), F.concat(F.array(F.lit(None)), listed).alias("y")),
            lambda p: F.struct(p["x"]["feld"].alias("feld"), p["x"]["term"].alias("term"), F.lit(sign).alias("o"), F.when(p["y"].isNull() | (p["x"] != p["y"]), sign).otherwise(0).alias("r")),
        )
        return F.when(~gone, F.filter(flagged, lambda s: s["feld"].isNotNull())).otherwise(F.array().cast("array<struct<feld:string,term:string,o:int,r:int>>"))

    def apply(self, changes: DataFrame) -> None:
        """changes(owner, version, terms, gone): records added, changed (higher version) or deleted (gone)."""
        count = self.manifest["buckets"]
        no_terms = F.array().cast(TERMS)
        changes = changes.filter(F.col("owner").isNotNull()).select("owner", "version", F.coalesce("terms", no_terms).alias("terms"), F.coalesce("gone", F.lit(False)).alias("gone"))
        new = latest(changes, ["owner"], [F.col("version").desc_nulls_last()]).withColumn("bucket", F.pmod(F.xxhash64("owner"), F.lit(count)).cast("int"))
        if self.manifest["batches"]:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
            old = self._states(touched).toDF("owner", "seen", "before", "before_gone")
            new = new.join(old, "owner", "left").filter(F.col("seen").isNull() | (F.col("version") > F.col("seen"))).drop("seen")
        else:
            new = new.withColumn("before", F.lit(None).cast(TERMS)).withColumn("before_gone", F.lit(True))
        name = f"batch-{self.manifest['number']:012d}-{uuid.uuid4().hex}"
        target = f"{self.path}/{name}/records"
        # The state before is kept beside the one after, so that the deltas need one look; nobody reads it later.
        new.repartition("bucket").write.partitionBy("bucket").parquet(target)
        written = self.spark.read.schema(f"owner string, terms {TERMS}, gone boolean, before {TERMS}, before_gone boolean, bucket int").parquet(target)
        after = self._signed(F.col("terms"), F.col("gone"), 1)
        before = self._signed(F.coalesce("before", no_terms), F.coalesce("before_gone", F.lit(True)), -1)
        self._write_counts(written.select(F.explode(F.concat(after, before)).alias("x")).select("x.feld", "x.term", F.col("x.o").alias("occurrences"), F.col("x.r").alias("records")), name)
        self._commit([*self.manifest["batches"], name])
        if len(self.manifest["batches"]) > COMPACT:
            self.compact()

    def _write_counts(self, deltas: DataFrame, name: str) -> None:
        merged = deltas.groupBy("feld", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        merged = merged.filter((F.col("occurrences") != 0) | (F.col("records") != 0))
        part = F.pmod(F.hash("feld", "term"), F.lit(PARTS)).alias("part")
        merged.select("*", part).repartition("part").write.partitionBy("part").parquet(f"{self.path}/{name}/counts")

    def compact(self) -> None:
        """One state per record and one count per term; then the merged files are removed."""
        old = self.manifest["batches"]
        name = f"base-{self.manifest['number']:012d}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64("owner"), F.lit(self.manifest["buckets"])).cast("int")
        self._states().withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/records")
        self._write_counts(self._read("counts", COUNTS), name)
        self._commit([name])
        for b in old:
            fs, p = self._fs(f"{self.path}/{b}")
            fs.delete(p, True)


def marked(counts: DataFrame, rare: int, common: float) -> DataFrame:
    """Adds mark: rare in at most so many records, else common in more than that share of all records, else null."""
    total = counts.filter((F.col("feld") == RECORD) & (F.col("term") == RECORD)).select(F.col("records").alias("all_records"))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.col("all_records") * common, "common")
    rows = counts.filter(F.col("feld") != RECORD)
    return rows.join(F.broadcast(total)).withColumn("mark", mark)  # total has one row
