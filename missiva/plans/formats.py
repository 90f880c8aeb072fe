"""File formats written and read again, each as a query over what came back; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.operators import archive as A
from missiva.operators import vectors as X
from missiva.plans import evaluation, retrieval
from missiva.plans import sqltext as S
from missiva.sources import files
from missiva.sources.tables import fresh_path, table

CORPUS = "id string, sichtbar string, titel string, date_iso string, senders array<string>, subjects array<string>, regest string, synthetic boolean"


def jsonl_corpus(spark, d) -> DataFrame:
    """The corpus as lines of JSON."""
    path = fresh_path(spark, "corpus")
    files.write_jsonl(A.corpus(spark, d).select(*(c.split()[0] for c in CORPUS.split(", "))), path)
    return files.read_jsonl(spark, path, CORPUS)


def jsonl_passages(spark, d) -> DataFrame:
    """Passages as lines of JSON, and the number of lines that aren't blank."""
    path = fresh_path(spark, "passages")
    files.write_jsonl(A.chunks(A.fulltexts(spark, d)), path)
    back = files.read_jsonl(spark, path, "chunkid string, letterid string, kind string, seq int, text string")
    return back.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).withColumn("lines", F.lit(files.count_lines(spark, path)))


GOLD = "year int, side string, nr int, id string"
QUESTION = "id string, template string, lang string, text string, offen bigint, intern bigint, seed string"


def _fixtures(spark, d) -> dict[str, DataFrame]:
    """Gold sets and generated questions as pretty JSON in one folder, read again by their names."""
    path = fresh_path(spark, "fixtures")
    files.write_gold(evaluation.gold_year(spark, d), f"{path}/gold_year.json")
    files.write_gold(evaluation.gold_tag_in(spark, d).withColumn("year", F.lit(None).cast("int")), f"{path}/gold_tag.json")
    files.write_gold(evaluation.generated_questions(spark, d).withColumn("seed", F.lit(evaluation.SEED)), f"{path}/generated_questions.json")
    return files.read_fixtures(spark, path, {"gold_": GOLD, "generated_": QUESTION})


def gold_files(spark, d) -> DataFrame:
    return _fixtures(spark, d)["gold_"]


def question_files(spark, d) -> DataFrame:
    return _fixtures(spark, d)["generated_"]


def vector_store(spark, d) -> DataFrame:
    """Vectors appended in two steps with their metadata, then what an archive checks as it opens them."""
    path = fresh_path(spark, "vectors")
    good = X.usable(table(spark, d, "letter_vectors"), "id").select("id", "vec_no", "embedding")
    for part in (0, 1):
        files.write_vectors(good.filter(F.col("vec_no") % 2 == part).select("id", "embedding"), f"{path}/rows")
    back = spark.read.parquet(f"{path}/rows")
    files.write_meta(spark, f"{path}/meta", model="stored", dim=64, count=back.count())
    meta = spark.read.schema("model string, dim int, count bigint").json(f"{path}/meta")
    served = files.attach(A.public(A.corpus(spark, d)).select("id"), back, "id")
    return served.agg(F.count("*").alias("served")).withColumn("consistent", F.lit(files.consistent(back, meta)))


def baseline_once(spark, d) -> DataFrame:
    """A baseline is written once: a second run leaves it as it is. An index that isn't there is an empty table."""
    path = fresh_path(spark, "baseline")
    run = evaluation.recall_precision(spark, d)
    files.write_once(run, path)
    files.write_once(run.limit(0), path)
    absent = files.optional(spark, f"{path}-absent", "qid string, n_hits bigint, n_gold bigint, recall double, precision double")
    return files.optional(spark, path, "qid string, n_hits bigint, n_gold bigint, recall double, precision double").unionByName(absent)


def review_sheets(spark, d) -> DataFrame:
    """A sheet for each answer of the offline model."""
    rows = retrieval.answers(spark, d).join(retrieval.questions(spark).withColumnRenamed("text", "question"), "qid")
    shown = retrieval.fuse_hits(spark, d).filter("rank <= 12").groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("sources"))
    return files.review_sheet(rows.join(shown, "qid", "left"))


NAMES = "jsonl_corpus jsonl_passages gold_files question_files vector_store baseline_once review_sheets".split()
QUERIES = {n: globals()[n] for n in NAMES}

_SHEET = """SELECT qid, concat_ws(chr(10) || chr(10), '## ' || qid, '**' || text || '**', answer, (SELECT string_agg('- Brief ' || id, chr(10) ORDER BY rank) FROM hi WHERE hi.qid = an.qid AND rank <= 10), 'Note: ____') AS sheet FROM an JOIN q0 USING (qid)"""
_ANSWERED = retrieval.SQL["answers"].rsplit("\nSELECT qid, CASE", 1)

SQL = {
    "jsonl_corpus": evaluation._with(S.CORPUS, then="SELECT id, sichtbar, titel, date_iso, senders, subjects, regest, synthetic FROM let"),
    "jsonl_passages": retrieval._with(S.FULLTEXT, retrieval._WIN, then="SELECT kind, count(*) AS n, sum(length(trim(substr(t, b + 1, e - b)))) AS chars, (SELECT count(*) FROM win) AS lines FROM win GROUP BY kind"),
    "gold_files": f"SELECT 'gold_year' AS source, year, side, nr, id FROM ({evaluation.SQL['gold_year']}) UNION ALL SELECT 'gold_tag', NULL, side, nr, id FROM ({evaluation.SQL['gold_tag_in']})",
    "question_files": f"SELECT 'generated_questions' AS source, *, '{evaluation.SEED}' AS seed FROM ({evaluation.SQL['generated_questions']})",
    "vector_store": evaluation._with(S.CORPUS, S.VECTORS, then="SELECT count(*) AS served, TRUE AS consistent FROM lv JOIN pub USING (id)"),
    "baseline_once": evaluation.SQL["recall_precision"],
    "review_sheets": f"{_ANSWERED[0]},\nan AS (SELECT qid, CASE{_ANSWERED[1]})\n{_SHEET}",
}
