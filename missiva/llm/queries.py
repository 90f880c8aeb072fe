"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from missiva.functions import variants as V
from missiva.llm import bpe, language, leakage, neighbours, pii, samename, splitting, termcounts
from missiva.operators import letters
from missiva.plans.records import REFS_SQL
from missiva.sources.tables import fresh_path, table


def _tagged(feld: str, ids: Column) -> Column:
    """array<struct<feld, term>> of one field's ids; empty where the field is missing."""
    ids = F.coalesce(ids, F.array().cast("array<string>"))
    return F.transform(ids, lambda x: F.struct(F.lit(feld).alias("feld"), x.alias("term")))


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of one language of every incipit and full text, in order, each with a confidence."""
    docs = table(spark, sf_dir, "documents").filter("lang IS NOT NULL").select("kind", "lang", "text")
    texts = _letter_texts(spark, sf_dir)
    codes = {w: k for k, ws in language.NAMES.items() for w in ws.split()}
    code = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    # Labels of letters are doubted more than those of the corpus ("+"), see language.fit.
    own = texts.select(F.concat(F.lit("+"), "tbl").alias("kind"), code[F.lower(F.trim("label"))].alias("lang"), "text")
    field = language.stored_fit(spark, language.sample(docs.unionByName(own)))
    return language.tag(texts, field)


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each text: that of most of its words, with the mean confidence of these passages."""
    per = p2_segments(spark, sf_dir).groupBy("tbl", "id", "label", "lang").agg(
        F.sum("words").alias("words"), (F.sum(F.col("words") * F.col("confidence")) / F.sum("words")).alias("confidence")
    )
    best = per.groupBy("tbl", "id", "label").agg(F.max(F.struct("words", "confidence", "lang")).alias("b"), F.sum("words").alias("all_words"))
    return best.select("tbl", "id", "label", "b.lang", "b.confidence", (F.col("b.words") / F.col("all_words")).alias("share"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of passages of at least eight words that the label doesn't name."""
    long = p2_segments(spark, sf_dir).filter("words >= 8").select("tbl", "id", "label", "lang").distinct()
    return long.filter(~language.names_language(F.col("label"), F.col("lang"))).select("tbl", "id", "lang").distinct()


def _letter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, id, label, text), distinct, of incipits and full texts."""
    sources = {"corpus": "incipit", "fulltext": "volltext"}
    parts = [
        table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), "id", F.col("sprache").alias("label"), F.col(c).alias("text"))
        for t, c in sources.items()
    ]
    return parts[0].unionByName(parts[1]).distinct()


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all keyword ids. Letters are loaded as they came: first what was there when nine tenths had been
    loaded; then those a newer revision is on its way for are withdrawn; then the rest, which restores, changes and adds
    letters."""
    briefs = table(spark, sf_dir, "briefs").filter("brief_id IS NOT NULL").withColumn("schlagworte", V.parse(F.col("schlagworte")))
    terms = F.flatten(
        F.array(*(_tagged(feld, ids) for feld, ids in letters.keyword_ids(F.col("schlagworte")).items()))
    )
    rows = briefs.select(
        F.col("brief_id").alias("owner"),
        # The counting revision: highest rev, then latest load.
        (F.coalesce("rev", F.lit(0)).cast("bigint") * F.lit(1 << 42) + F.coalesce(F.unix_millis(F.col("loaded_at").cast("timestamp")), F.lit(0))).alias("version"),
        terms.alias("terms"),
        F.lit(False).alias("gone"),
        "loaded_at",
    )
    cut = briefs.agg(F.percentile_approx("loaded_at", 0.9).alias("t")).first()["t"]
    store = termcounts.TermCounts(spark, fresh_path(spark, "termcounts"))
    if cut is None:
        store.apply(rows)
    else:
        early = F.coalesce(F.col("loaded_at") <= F.lit(cut).cast("timestamp_ntz"), F.lit(True))
        rest = rows.filter(~early)
        store.apply(rows.filter(early))
        store.apply(rest.withColumn("version", F.col("version") - 1).withColumn("gone", F.lit(True)))
        store.apply(rest)
    found = termcounts.marked(store.counts(), rare=2, common=0.02)
    return found.select("feld", F.col("term").alias("ref_id"), "occurrences", F.col("records").alias("briefs"), "mark")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_counts(spark, sf_dir).filter("mark IS NOT NULL").select("feld", "ref_id", "mark")


def p6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.passages(table(spark, sf_dir, "fulltext"), "id", ["volltext", "erlaeuterung"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that the operator cut into more than one passage."""
    return p6_passages(spark, sf_dir).filter("seq = 1").select("id", "kind").distinct()


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to hold of the passages of each text: they cover it without a gap, fit, and overlap as asked."""
    rows = p6_passages(spark, sf_dir).withColumn("size", F.length("passage"))
    rows = rows.withColumn("new", F.col("size") - F.col("overlap") == F.col("end_at") - F.col("begin_at"))
    w = Window.partitionBy("id", "kind", "begin_at").orderBy("end_at")  # a repeated id may have several texts
    gap = F.col("begin_at") - F.lag("end_at").over(Window.partitionBy("id", "kind").orderBy("begin_at"))
    rows = rows.withColumn("r", F.row_number().over(w)).filter("r = 1").withColumn("gap", gap)
    return rows.groupBy("id", "kind").agg(
        F.max("end_at").alias("signs"), (F.max("size") <= 800).alias("fits"), (F.min("begin_at") == 0).alias("begins"), F.bool_and("new").alias("whole"),
        F.coalesce(F.bool_and(F.col("gap").between(0, 1)), F.lit(True)).alias("gapless"), (F.max("overlap") <= 151).alias("laps"),
    )


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a document that shares a seed with a test item, with its alignment."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.contained(p9_alignments(spark, sf_dir))


def p9_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with whole or edited copies of test items, by how much of the item the alignment covers."""
    return leakage.edited(p9_alignments(spark, sf_dir))


def _p10_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of personal information."""
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p10_places(spark, sf_dir).select("doc_id", "kind", "val").distinct()


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with placeholders."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.redact(docs, pii.find(docs))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaces = {"letter": "letter_vectors", "chunk": "chunk_vectors"}
    parts = [neighbours.nearest(table(spark, sf_dir, t)).select(F.lit(s).alias("space"), "vec_a", "vec_b") for s, t in spaces.items()]
    return parts[0].unionByName(parts[1])


def p7_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling in senders and recipients with the entity it belongs to; all revisions count, as all were typed."""
    briefs = table(spark, sf_dir, "briefs")
    typed = [briefs.select(F.explode(c).alias("x")).select(F.col("x.v.namemitamt.combi").alias("name")) for c in ("verfasser", "adressat")]
    names = typed[0].unionByName(typed[1]).filter(F.length(F.trim("name")) > 0).distinct()
    return samename.entities(names)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samename.pairs(p7_entities(spark, sf_dir))


QUERIES = {
    "p2_found": p2_found,
    "p2_segments": p2_segments,
    "p2_texts": p2_texts,
    "p7_found": p7_found,
    "p7_entities": p7_entities,
    "p1_found": p1_found,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
    "p6_found": p6_found,
    "p6_passages": p6_passages,
    "p6_totals": p6_totals,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_alignments": p9_alignments,
    "p9_edited": p9_edited,
    "p10_found": p10_found,
    "p10_redacted": p10_redacted,
}

_WHITE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

_OCCURRENCES = REFS_SQL.replace("\nUNION SELECT", "\nUNION ALL SELECT")
_P5 = (
    "WITH "
    + _OCCURRENCES
    + """, n AS (SELECT count(*) AS total FROM letters), c AS (
  SELECT feld, ref_id, count(*) AS occurrences, count(DISTINCT brief_id) AS briefs FROM refs
  WHERE feld <> 'verfasser' AND ref_id IS NOT NULL GROUP BY ALL)
SELECT feld, ref_id, occurrences, briefs, CASE WHEN briefs <= 2 THEN 'rare' WHEN briefs > 0.02 * total THEN 'common' END AS mark FROM c, n"""
)

_P1 = """SELECT DISTINCT '{space}' AS space, least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM (
  SELECT x.vec_no AS a, y.vec_no AS b, row_number() OVER (PARTITION BY x.vec_no ORDER BY list_cosine_similarity(x.e, y.e) DESC, y.vec_no) AS k
  FROM {t} x JOIN {t} y ON x.vec_no <> y.vec_no) WHERE k <= 5"""
_VECTORS = """{t} AS (SELECT vec_no, any_value(embedding)::DOUBLE[] AS e FROM {table} WHERE embedding IS NOT NULL AND len(embedding) = dim
  AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0 GROUP BY vec_no)"""

# Words folded by SQL's own means; every run of twelve words of an item, joined.
_FOLDED = (
    "strip_accents(replace(replace(replace(replace(lower(regexp_replace(regexp_replace(text, '[\u00ad\u200b\u200c\u200d\u2060\ufeff]', '', 'g'), "
    r"'([\pL\pN_])[-‐‑⸗=¬]\s*[\r\n]\s*([\pL\pN_])', '\1\2', 'g')), 'ß', 'ss'), 'ſ', 's'), 'æ', 'ae'), 'œ', 'oe'))"
)
_RUNS = (
    "SELECT DISTINCT {key}, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM "
    "(SELECT {key}, regexp_extract_all(translate(" + _FOLDED + r", 'vj', 'ui'), '[\pL\pN]+') AS w FROM {table} WHERE {key} IS NOT NULL) WHERE len(w) >= 12)"
)

SQL = {
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({_RUNS.format(key='doc_id', table='documents')}) JOIN ({_RUNS.format(key='item_id', table='eval_items')}) USING (run)",
    "p1_found": f"WITH {_VECTORS.format(t='l', table='letter_vectors')}, {_VECTORS.format(t='c', table='chunk_vectors')} "
    f"{_P1.format(space='letter', t='l')} UNION ALL {_P1.format(space='chunk', t='c')}",
    "p5_counts": _P5,
    "p5_found": f"SELECT feld, ref_id, mark FROM ({_P5}) WHERE mark IS NOT NULL",
    "p6_totals": "SELECT id, kind, max(n)::INT AS signs, TRUE AS fits, TRUE AS begins, TRUE AS whole, TRUE AS gapless, TRUE AS laps FROM (SELECT id, kind, length(trim(regexp_replace(t, "
    f"'{_WHITE}', ' ', 'g'))) AS n FROM (SELECT id, 'volltext' AS kind, volltext AS t FROM fulltext UNION ALL SELECT id, 'erlaeuterung', erlaeuterung FROM fulltext)) WHERE n > 800 GROUP BY id, kind",
    "p6_found": "SELECT DISTINCT id, kind FROM (SELECT id, 'volltext' AS kind, volltext AS t FROM fulltext UNION ALL SELECT id, 'erlaeuterung', erlaeuterung FROM fulltext) "
    f"WHERE length(trim(regexp_replace(t, '{_WHITE}', ' ', 'g'))) > 800",
}
