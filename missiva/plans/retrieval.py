"""Retrieval over the archive: derived tables, matching, vectors, fusion, reranking, context, guards; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.functions import text as T
from missiva.functions import variants as V
from missiva.operators import answer as W
from missiva.operators import archive as A
from missiva.operators import evaluate as E
from missiva.operators import letters as L
from missiva.operators import match as M
from missiva.operators import retrieve as R
from missiva.operators import vectors as X
from missiva.plans import records
from missiva.plans import sqltext as S
from missiva.sources.tables import fingerprint, side_by_side, stored, table
from missiva.streaming import embedding

QUESTIONS = [
    ("q01", "Welche Briefe behandeln die Jagdordnung?"),
    ("q02", "Welche Briefe betreffen Waldstreit und Kelchordnung?"),
    ("q03", "Welche Briefe schrieb Georg Keispler an Ludwig Greirlmann?"),
    ("q04", "Briefe von Johann Krärbogel"),
    ("q05", "Welche Briefe stammen aus dem Jahr 1563?"),
    ("q06", "Fasse den Brief 10001 zusammen."),
    ("q07", "Was steht in Brief 99999?"),
    ("q08", "Wie viele Briefe gibt es insgesamt?"),
    ("q09", "Welche Briefe erwähnen Vorwürfe?"),
    ("q10", "beschädigte Stadt"),
    ("q11", "Abendmahlordnung"),
    ("q12", "Guten Tag"),
    ("q13", "Welche Briefe schrieb Balthasar Spongulm?"),
]
#: Floors for the stored vectors, whose similarities lie elsewhere than those of a text model.
PARAMS = A.Params(min_score=0.4, chunk_min_score=0.3)
_VALUES = ", ".join("('{}', '{}')".format(q, t.replace("'", "''")) for q, t in QUESTIONS)


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "qid string, text string")


def _with_vectors(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """Each question gets the stored vector of its place in key order, as no text model is at hand."""
    first = vectors.orderBy("vec_no").limit(len(QUESTIONS)).select("vec_no", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    stored_ones = [r["vector"] for r in first.orderBy("vec_no").collect()]
    rows = [(q, t, stored_ones[i] if i < len(stored_ones) else None) for i, (q, t) in enumerate(QUESTIONS)]
    return spark.createDataFrame(rows, "qid string, text string, vector array<double>")


#: Tables the index is made of, and a number that changes with the way it is made.
SOURCES, VERSION = "corpus fulltext saches briefs letter_vectors chunk_vectors".split(), 2


def index(spark: SparkSession, sf_dir: str, *parts: str) -> R.Index:
    """The index, kept in the shared folder under the state of the tables it is made of: built by the first query that needs
    a part, opened by all others. Only the parts named, all if none is."""
    key = fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in SOURCES], VERSION, PARAMS)
    keep = lambda name, build: stored(spark, f"index-{key}/{name}", build)
    pub = keep("letters", lambda: A.described(A.public(A.corpus(spark, sf_dir)), spark, sf_dir))
    variants = A.labels(spark, sf_dir, "saches").select(F.col("short").alias("label"), F.explode("variants").alias("variant"))
    builds = {
        "subjects": ("subjects", lambda: A.subject_postings(pub, variants)),
        "senders": ("persons", lambda: A.person_postings(pub, "senders")),
        "recipients": ("persons", lambda: A.person_postings(pub, "recipients")),
        "stem_text": ("texts", lambda: A.stem_texts(pub, A.fulltexts(spark, sf_dir))),
        "stems": ("texts", lambda: A.stem_postings(A.stem_texts(pub, A.fulltexts(spark, sf_dir)))),
        "vectors": ("vectors", lambda: X.usable(table(spark, sf_dir, "letter_vectors"), "id")),
        "chunk_vectors": ("chunks", lambda: X.usable(table(spark, sf_dir, "chunk_vectors"), "chunkid")),
        "passages": ("passages", lambda: A.chunks(A.fulltexts(spark, sf_dir)).select("chunkid", "text")),
        "texts": ("passages", lambda: A.public(A.fulltexts(spark, sf_dir)).join(pub.select("id"), "id", "left_semi")),
    }
    wanted = {name: lambda n=name, b=build: keep(n, b) for name, (part, build) in builds.items() if not parts or part in parts}
    done = side_by_side(wanted)
    return R.Index(pub, *(done.get(n) for n in ("subjects", "senders", "recipients", "stem_text", "stems", "vectors", "chunk_vectors", "passages", "texts")))


# --- ETL --------------------------------------------------------------------------------------------------------------


def etl_unwrap_default(spark, d):
    return A.unwrapped(spark, d).drop("schlagworte")


def etl_resolve_labels(spark, d):
    return A.resolved(A.unwrapped(spark, d), spark, d, "sachen")


def etl_abstract(spark, d):
    a = A.unwrapped(spark, d)
    tags = A.resolved(a, spark, d, "sachen").select("brief_id", "labels")
    rows = a.join(tags, "brief_id", "left").withColumn("labels", A.filled(F.col("labels")))
    made = A.abstract(F.col("textsorte"), F.col("senders"), F.col("recipients"), F.col("places_sent"), F.coalesce("date_display", "date_iso"), F.col("labels"))
    return rows.select("id", made.alias("abstract"))


def etl_kinds(spark, d):
    """Kinds of letters by label: the tables have labels already, so each subject's id stands as a kind here as well."""
    a = A.unwrapped(spark, d).select("brief_id", "textsorte")
    coded = A.unwrapped(spark, d).select("brief_id", F.get(L.keyword_ids(V.parse(F.col("schlagworte")))["sachen"], F.lit(0)).alias("textsorte")).filter("textsorte IS NOT NULL")
    return A.kinds(spark, d, a.withColumn("coded", F.lit(False)).unionByName(coded.withColumn("coded", F.lit(True)))).select("brief_id", "coded", "textsorte")


def etl_destination(spark, d):
    """Made-up abstracts with a destination where there is no place of sending; the first recipient's letters stand in for
    the place, as the tables have none."""
    made = A.abstract(F.col("textsorte"), F.col("senders"), F.col("recipients"), F.col("places_sent"), F.col("date_iso"), F.array().cast("array<string>"), F.slice("recipients", 1, 1))
    return A.unwrapped(spark, d).select("id", made.alias("abstract"))


def etl_servable(spark, d):
    """Letters by the published, looser reading: all that aren't marked internal."""
    return A.public_or_unknown(A.corpus(spark, d)).select("id", "sichtbar")


def etl_embed_text(spark, d):
    c = A.corpus(spark, d)
    return c.select("id", A.embed_text(F.col("titel"), F.col("subjects"), F.col("regest"), F.col("incipit")).alias("text"), F.col("synthetic"))


def etl_year_counts(spark, d):
    return A.corpus(spark, d).groupBy(F.substring("date_iso", 1, 4).alias("year")).agg(F.count("*").alias("letters"))


def etl_visibility(spark, d):
    c = A.corpus(spark, d)
    return c.agg(
        F.count("*").alias("letters"),
        F.count_if(F.col("sichtbar") == "offen").alias("offen"),
        F.count_if(F.col("sichtbar") == "intern").alias("intern"),
        F.count_if(~F.col("sichtbar").eqNullSafe("intern")).alias("not_intern"),
        F.count_if("synthetic").alias("synthetic"),
    )


def etl_last_row_wins(spark, d):
    return A.corpus(spark, d).select("id", "sichtbar", "titel", "date_iso")


def etl_fulltext(spark, d):
    f = A.fulltexts(spark, d)
    return f.select("id", F.coalesce(F.length("volltext"), F.lit(0)).alias("volltext_length"), F.col("volltext").isNotNull().alias("has_full_text"), F.substring("volltext", 1, 1500).alias("excerpt"))


# --- text and postings ------------------------------------------------------------------------------------------------


def text_normalize(spark, d):
    return A.corpus(spark, d).select("id", T.normalize(F.col("regest")).alias("normal"))


def text_stems(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.stems(F.col("text"))).alias("pos", "stem"))
    return rows.groupBy("stem").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def text_subject_forms(spark, d):
    labels = A.labels(spark, d, "saches").select("short").distinct()
    return labels.select("short", F.explode(T.subject_forms(F.col("short"))).alias("form"))


def postings_subject(spark, d):
    return index(spark, d, "subjects").subjects


def postings_person(spark, d):
    i = index(spark, d, "persons")
    return i.senders.select("form", "id", F.lit("sender").alias("side")).unionByName(i.recipients.select("form", "id", F.lit("recipient").alias("side")))


def postings_stem(spark, d):
    return index(spark, d, "texts").stems.groupBy("stem").agg(F.count("*").alias("letters"))


def stem_text_phrase(spark, d):
    return index(spark, d, "texts").stem_text.filter(F.contains("stem_text", F.concat(F.lit(" "), T.stem_phrase(F.lit("frühen Rat")), F.lit(" ")))).select("id", "stem_text")


def chunk_documents(spark, d):
    return A.chunks(A.fulltexts(spark, d))


def chunk_unpivot(spark, d):
    return A.public(A.fulltexts(spark, d)).unpivot("id", ["volltext", "erlaeuterung"], "kind", "text").filter("text IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# --- matching ---------------------------------------------------------------------------------------------------------


def _q(spark):
    return M.features(questions(spark))


def question_features(spark, d):
    return _q(spark).select("qid", "normal", "stemmed", F.array_join("terms", " ").alias("terms"), F.array_join(F.array_sort("years"), " ").alias("years"), F.array_join(F.array_sort("ids"), " ").alias("ids"), "statistic")


def match_subject_forms(spark, d):
    return M.subject_candidates(_q(spark), index(spark, d, "subjects").subjects)


def match_subjects(spark, d):
    return M.subjects(_q(spark), index(spark, d, "subjects").subjects)


def match_persons(spark, d):
    i = index(spark, d, "persons")
    return M.persons(_q(spark), i.senders, i.recipients)


def match_years(spark, d):
    return M.years(_q(spark), index(spark, d, "letters").letters)


def match_ids(spark, d):
    return M.ids(_q(spark), index(spark, d, "letters").letters)


def match_texts(spark, d):
    i = index(spark, d, "texts")
    return M.texts(_q(spark), i.stems, i.stem_text)


def gates(spark, d):
    i, q = index(spark, d, "persons"), _q(spark)
    return M.gates(q, i.letters, M.persons(q, i.senders, i.recipients), M.years(q, i.letters), M.ids(q, i.letters))


# --- vectors ----------------------------------------------------------------------------------------------------------


#: The stated query set of vector searches: every vector whose number is divisible by this.
EVERY = 50


def _asking(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("vec_no") % EVERY == 0).select(F.col("vec_no").cast("string").alias("qid"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def cosine_top30(spark, d):
    i = index(spark, d, "vectors")
    return X.best(i.vectors.join(i.letters.select("id"), "id"), _asking(i.vectors), ["id"], PARAMS.top_k, "id")


def cosine_expression(spark, d):
    """Every vector against the one of the query set before it, as a plain expression over an equi-join."""
    v = index(spark, d, "vectors").vectors.withColumn("q", F.col("vec_no") - F.col("vec_no") % EVERY)
    asking = v.filter("vec_no = q").select("q", F.col("embedding").alias("other"))
    return v.join(asking, "q").select("vec_no", F.round(X.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


def chunk_best(spark, d):
    i = index(spark, d, "chunks")
    return R.best_chunks(i, _asking(i.chunk_vectors))


def dedup_by_score(spark, d):
    """Letters scored by their hundred best passages: of each letter only the best stays."""
    i = index(spark, d, "chunks")
    scores = X.best(i.chunk_vectors.withColumnRenamed("letterid", "id"), _asking(i.chunk_vectors), ["id", "chunkid"], 100, "chunkid")
    return M.first_by_score(scores.drop("rank"), "id", "chunkid")


def question_similarity(spark, d):
    """The questions themselves, embedded by the same model as the letters' texts; the best of each."""
    letters = index(spark, d, "letters").letters
    text = A.embed_text(F.col("titel"), F.col("subjects"), F.col("regest"), F.col("incipit"))
    some = F.exists("embedding", lambda x: x != 0)
    vectors = letters.select("id", embedding.embed(text).alias("embedding")).filter(some)
    asked = questions(spark).select("qid", embedding.embed(F.col("text")).alias("embedding")).filter(some).withColumnRenamed("embedding", "vector")
    return X.best(vectors, asked, ["id"], PARAMS.top_k, "id")


# --- fusion and after -------------------------------------------------------------------------------------------------


def _fused(spark, d) -> tuple[R.Index, R.Fused]:
    i = index(spark, d)
    return i, R.fuse(i, _with_vectors(spark, i.vectors), _with_vectors(spark, i.chunk_vectors), PARAMS)


def fuse_hits(spark, d):
    return _fused(spark, d)[1].hits


def response_counts(spark, d):
    """What a response says of its retrieval: matches of each path, and those under the floor."""
    f = _fused(spark, d)[1]
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = f.gates.join(f.counts, "qid", "left").select("qid", "closed", "lookup", "structured", *(zero(c) for c in ("matches", "keyword_matches", "chunk_matches", "below_floor")))
    return rows.withColumn("in_context", F.least("matches", F.lit(PARAMS.context_max)))


RERANK = A.Params(rerank_min=0.1)


def _scorer(question, text):
    """The offline scorer, which leaves texts whose length is divisible by seven without a score, as a service may."""
    return F.when(F.length(text) % 7 != 0, R.overlap_scorer(question, text))


def _reranked(spark, d) -> tuple[R.Index, R.Fused, DataFrame]:
    i, f = _fused(spark, d)
    return i, f, R.rerank(f.hits, questions(spark), i.letters, i.passages, _scorer, RERANK)


def rerank_prune(spark, d):
    return _reranked(spark, d)[2].select("qid", "id", "rank", "keyword", "rerank")


def response_chat(spark, d):
    i, _, hits = _reranked(spark, d)
    return R.response_chat(hits, i, PARAMS)


def response_retrieve(spark, d):
    i, _, hits = _reranked(spark, d)
    return R.response_retrieve(hits, i, PARAMS)


def sources_split(spark, d):
    """Letters the model saw and further candidates, per question."""
    cited, extra = R.cited_and_extra(response_chat(spark, d))
    return cited.withColumn("part", F.lit("cited")).unionByName(extra.withColumn("part", F.lit("extra"))).groupBy("qid", "part").agg(F.count("*").alias("letters"), F.min("rank").alias("first"))


def calibration(spark, d):
    """Rerank scores of letters found by similarity alone: quantiles without interpolation over all questions."""
    return E.floor_quantile(R.embedding_only(response_retrieve(spark, d)).withColumn("run", F.lit("all")), "rerank", ["run"], [0.1, 0.5, 0.9])


def context_blocks(spark, d):
    i, f = _fused(spark, d)
    matched = M.subject_candidates(_q(spark), i.subjects).filter("kept")
    return R.context(f.hits, i, matched, PARAMS)


def answers(spark, d):
    """Answers of the offline model to all questions, through both guards."""
    i, f = _fused(spark, d)
    matched = M.subject_candidates(_q(spark), i.subjects).filter("kept")
    context = R.prompt(R.context(f.hits, i, matched, PARAMS))
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("rank", "id")))), lambda x: x["id"])
    seen = F.col("rank") <= PARAMS.context_max
    known = f.hits.groupBy("qid").agg(F.collect_list("id").alias("ids"), in_order(F.col("keyword") & seen).alias("evidence"))
    rows = _q(spark).select("qid", "text", "statistic").join(known, "qid", "left").join(context, "qid", "left")
    return W.answers(rows.withColumn("history", F.array().cast("array<struct<role:string,content:string>>")), W.listing, p=PARAMS)


REQUESTS = [("r1", "Wer schrieb?"), ("r2", ""), ("r3", None), ("r4", " ")]


def requests_refused(spark, d):
    return W.validated(spark.createDataFrame(REQUESTS, "rid string, message string"))[1]


FOLLOW_UPS = [("f1", "Und 1563?", "Frage: Wer?"), ("f2", "Und an wen?", None), ("f3", "Mehr?", "zwei\nZeilen"), ("f4", "Wann?", "fehlt")]


def rewritten(spark, d):
    """Follow-up questions through an offline model that sets the last line of the transcript before them, gives two lines
    where there are two, and fails on one."""

    def model(transcript: str, question: str) -> str:
        if transcript == "fehlt":
            raise W.ServiceError("unreachable")
        return f"{transcript} {question}"

    return W.rewritten(spark.createDataFrame(FOLLOW_UPS, "qid string, text string, transcript string"), model)


def context_prompt(spark, d):
    return R.prompt(context_blocks(spark, d))


TURNS = [
    ("c1", 1, "user", "Wer schrieb 1563?"),
    ("c1", 2, "assistant", "Brief 10001 wurde 1563 geschrieben."),
    ("c1", 3, "system", "nicht zeigen"),
    ("c1", 4, "user", "   "),
    *(("c1", n, "user" if n % 2 else "assistant", f"Frage oder Antwort {n} " + "x" * 40 * n) for n in range(5, 26)),
    ("c2", 1, "user", "Und an wen?"),
    ("c2", 2, "bot", "unbekannte Rolle"),
]
ANSWERS = [
    ("a1", "Siehe Brief 10001 und Brief Nr. 10002.", ["10001", "10002"]),
    ("a2", "Brief 10001 nennt es, Brief 99999 auch.", ["10001"]),
    ("a3", "Die vorliegenden Briefe enthalten dazu keine Informationen.", ["10001"]),
    ("a4", "Keine der Quellen erwähnt Genf; Brief 10003 vielleicht.", []),
    ("a5", "Diese Frage betrifft das gesamte Archiv.", []),
    ("a6", "brief 123 und Brief Nr.45678x", ["123"]),
]


def history_clip(spark, d):
    return R.history(spark.createDataFrame(TURNS, "conv string, turn int, role string, content string"))


def history_transcript(spark, d):
    return R.transcript(history_clip(spark, d))


def _answers(spark):
    return spark.createDataFrame(ANSWERS, "aid string, answer string, sources array<string>")


def citation_guard(spark, d):
    g = R.citation_guard(_answers(spark))
    return g.select("aid", F.array_join(F.array_sort("cited"), " ").alias("cited"), F.array_join(F.array_sort("invented"), " ").alias("invented"), "retry")


def refusal_guard(spark, d):
    return R.refusal_guard(_answers(spark))


NAMES = """etl_unwrap_default etl_resolve_labels etl_abstract etl_kinds etl_destination etl_servable etl_embed_text etl_year_counts etl_visibility etl_last_row_wins etl_fulltext
text_normalize text_stems text_subject_forms postings_subject postings_person postings_stem stem_text_phrase chunk_documents chunk_unpivot
question_features match_subject_forms match_subjects match_persons match_years match_ids match_texts gates cosine_top30 cosine_expression chunk_best
dedup_by_score question_similarity fuse_hits response_counts rerank_prune response_chat response_retrieve sources_split calibration context_blocks context_prompt
answers requests_refused rewritten history_clip history_transcript citation_guard refusal_guard""".split()
QUERIES = {n: globals()[n] for n in NAMES}

# --- SQL --------------------------------------------------------------------------------------------------------------


def _with(*parts: str, then: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + then


_scalar, _member, _bare, _list, _id = records._scalar, records._member, records._bare, records._list, records._id
_NAMES = "list_filter(list_transform(coalesce({c}, []), lambda x: x.v.namemitamt.combi), lambda y: y IS NOT NULL AND y <> '')"
_RAW = f"""raw AS (SELECT brief_id, short AS id, '{A.DEFAULT.url}' || short AS url, coalesce(nullif(sichtbar, ''), 'unbekannt') AS sichtbar, textsorte,
  left({_scalar(_member('d', 'iso'))}, 10) AS date_iso, {_scalar(_member('d', 'schoen'))} AS date_display,
  {_NAMES.format(c='verfasser')} AS senders, {_NAMES.format(c='adressat')} AS recipients, {S.filled('absendeort')} AS places_sent, s
  FROM (SELECT *, CASE WHEN json_valid(datierung) THEN datierung::JSON END AS d, CASE WHEN json_valid(schlagworte) THEN schlagworte::JSON END AS s FROM letters WHERE coalesce(short, '') <> ''))"""
_LETTERS = records.LETTERS_SQL.split("), js AS")[0] + ")"
_RESOLVED = f"""el AS (SELECT brief_id, p, {_id('e')} AS ref_id FROM (SELECT brief_id, p, l[p] AS e FROM (SELECT brief_id, {_list(_member('s', 'sachen'))} AS l FROM raw), unnest(range(1, len(l) + 1)) AS r(p))),
res AS (SELECT brief_id, list(short ORDER BY p) AS labels, list_sort(list_distinct(flatten(list(variants)))) AS variants FROM el JOIN lab USING (ref_id) GROUP BY brief_id)"""
_BASE = (S.CORPUS, S.FULLTEXT, S.LABELS)
_QV = f"""qv AS (SELECT qid, embedding AS vector FROM (SELECT *, row_number() OVER (ORDER BY qid) AS n FROM q0) JOIN (SELECT *, row_number() OVER (ORDER BY vec_no) AS n FROM lv) USING (n)),
qc AS (SELECT qid, embedding AS vector FROM (SELECT *, row_number() OVER (ORDER BY qid) AS n FROM q0) JOIN (SELECT *, row_number() OVER (ORDER BY vec_no) AS n FROM cv) USING (n))"""
_COS = "round(list_cosine_similarity(v.embedding::DOUBLE[], w.vector::DOUBLE[]), 6)"


def _scores(letters: str = "qv", chunks: str = "qc") -> str:
    return f"""sco AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT w.qid, v.id, {_COS} AS score FROM lv v JOIN pub USING (id), {letters} w)),
cs AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunkid) AS rank FROM (SELECT w.qid, v.letterid AS id, v.chunkid, v.kind, {_COS} AS score FROM cv v, {chunks} w)),
cb AS (SELECT qid, id, chunk_score, chunkid, kind FROM (SELECT qid, c.id, score AS chunk_score, chunkid, kind, row_number() OVER (PARTITION BY qid, c.id ORDER BY score DESC, chunkid) AS r FROM cs c JOIN pub ON c.id = pub.id WHERE rank <= {PARAMS.chunk_top_k}) WHERE r = 1)"""


_SCORES = _scores()
_SET = tuple(f"{n} AS (SELECT vec_no::VARCHAR AS qid, embedding AS vector FROM {t} WHERE vec_no % {EVERY} = 0)" for n, t in (("sq", "lv"), ("sc0", "cv")))
_GATES = """ga AS (SELECT qid, statistic OR (len(ids) > 0 AND qid NOT IN (SELECT qid FROM im)) AS closed, len(ids) > 0 AND qid IN (SELECT qid FROM im) AS lookup,
  qid IN (SELECT qid FROM im) OR (NOT (len(ids) > 0 AND qid IN (SELECT qid FROM im)) AND (qid IN (SELECT qid FROM ym) OR qid IN (SELECT qid FROM pm WHERE exact))) AS structured FROM q)"""
_MATCH = (S.features(_VALUES), S.SUBJECT_POSTINGS, S.PERSONS, S.STEM_TEXT, S.SUBJECTS, S.PERSON_MATCH, S.YEARS, S.IDS, S.TEXTS, _GATES)
_FUSE = f"""plain AS (SELECT qid FROM q WHERE qid NOT IN (SELECT qid FROM im)),
ev AS (SELECT * FROM (
  SELECT qid, id, 1 AS ord, 2 * count(*) AS weight FROM (SELECT qid, form FROM sc2 WHERE kept) JOIN sp USING (form) WHERE qid IN (FROM plain) GROUP BY qid, id
  UNION ALL SELECT qid, id, 2, 2 FROM pm WHERE qid IN (FROM plain) UNION ALL SELECT qid, id, 3, 0 FROM ym WHERE qid IN (FROM plain)
  UNION ALL SELECT qid, id, 4, 100 FROM im UNION ALL SELECT qid, id, 5, 1 FROM tm WHERE qid IN (SELECT qid FROM ga WHERE NOT structured)) WHERE qid IN (SELECT qid FROM ga WHERE NOT closed)),
kw AS (SELECT qid, id, sum(weight)::INT AS specificity, list_sort(list_distinct(list(ord))) AS paths FROM ev GROUP BY qid, id),
wa AS (SELECT qid, structured, CASE WHEN structured THEN 0 WHEN qid IN (SELECT qid FROM kw) THEN {PARAMS.extra_k} ELSE {PARAMS.top_k} END AS k FROM ga WHERE NOT closed),
ne AS (SELECT qid, id FROM sco JOIN wa USING (qid) WHERE rank <= k),
bc AS (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY chunk_score DESC, chunkid) AS r FROM cb JOIN wa USING (qid) WHERE NOT structured AND chunk_score >= {PARAMS.chunk_min_score}) WHERE r <= {PARAMS.chunk_extra_k}),
ev2 AS (SELECT qid, id FROM kw UNION SELECT qid, id FROM ne UNION SELECT qid, id FROM bc),
hi1 AS (SELECT e.qid, e.id, kw.id IS NOT NULL AS keyword, bc.id IS NOT NULL AS by_chunk, coalesce(specificity, 0) AS specificity, coalesce(s.score, 0.0) AS cosine, greatest(coalesce(s.score, 0.0), cb.chunk_score) AS score, cb.chunkid, cb.kind AS chunk_kind,
    CASE WHEN kw.id IS NOT NULL THEN array_to_string(list_transform(paths, lambda o: ['Schlagwort', 'Person', 'Jahr', 'Nummer', 'Text'][o]), ', ') WHEN bc.id IS NOT NULL THEN 'Passage ' || cb.kind ELSE 'Embedding' END AS reasons
  FROM ev2 e LEFT JOIN kw ON kw.qid = e.qid AND kw.id = e.id LEFT JOIN bc ON bc.qid = e.qid AND bc.id = e.id LEFT JOIN sco s ON s.qid = e.qid AND s.id = e.id LEFT JOIN cb ON cb.qid = e.qid AND cb.id = e.id),
hi2 AS (SELECT *, keyword OR by_chunk OR cosine >= {PARAMS.min_score} AS stays FROM hi1), hi0 AS (SELECT * EXCLUDE (by_chunk, stays) FROM hi2 WHERE stays),
hi AS (SELECT * EXCLUDE (cosine), row_number() OVER (PARTITION BY qid ORDER BY keyword DESC, specificity DESC, score DESC, cosine DESC, id) AS rank FROM hi0)"""
_ALL = (*_BASE, *_MATCH, S.VECTORS, _QV, _SCORES, _FUSE)
_TEXTS = f"""wt AS (SELECT id || '__' || kind || '__' || printf('%03d', seq) AS chunkid, trim(substr(t, b + 1, e - b)) AS passage FROM win)"""
_RERANK = f"""ex0 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM hi WHERE NOT keyword),
ex AS (SELECT h.qid, h.id, h.rank AS old, q0.text AS question, substr(concat_ws(chr(10), nullif(titel, ''), nullif(regest, ''), nullif(passage, '')), 1, 1500) AS body
  FROM ex0 h JOIN q0 USING (qid) LEFT JOIN pub ON pub.id = h.id LEFT JOIN wt ON wt.chunkid = h.chunkid WHERE n <= {A.DEFAULT.rerank_max}),
ex2 AS (SELECT qid, id, old, CASE WHEN length(body) % 7 <> 0 THEN round(len(list_intersect(a, b)) / len(a), 6) END AS rerank FROM (SELECT *, list_distinct({S.stems('question')}) AS a, {S.stems('body')} AS b FROM ex)),
rr0 AS (SELECT *, NULL::DOUBLE AS rerank FROM hi WHERE keyword UNION ALL SELECT hi.*, ex2.rerank FROM ex2 JOIN hi ON hi.qid = ex2.qid AND hi.id = ex2.id WHERE coalesce(ex2.rerank, 9) >= {RERANK.rerank_min}),
rr AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY keyword DESC, CASE WHEN keyword THEN 0 ELSE coalesce(rerank, 0) END DESC, rank) AS rank FROM rr0)"""
_DESCRIBED = f"""ring AS (SELECT id, list_sort(list_distinct(list(v))) AS variants FROM (SELECT id, unnest(subjects) AS label FROM pub) t JOIN (SELECT short, unnest(variants) AS v FROM lab) l ON t.label = l.short GROUP BY id),
rawid AS (SELECT id, first(places_sent ORDER BY brief_id DESC) AS places_sent, first(date_display ORDER BY brief_id DESC) AS dd FROM raw GROUP BY id),
pubd AS (SELECT p.*, coalesce(places_sent, []) AS places_sent, coalesce(variants, []) AS variants, coalesce(nullif(dd, ''), date_iso) AS date_display FROM pub p LEFT JOIN rawid USING (id) LEFT JOIN ring USING (id)),
sr AS (SELECT r.qid, r.rank, r.id, p.url, round(r.score, 3) AS score, round(r.rerank, 3) AS rerank, r.reasons, r.chunk_kind, w.passage, p.titel, p.date_display, p.senders, p.recipients, p.regest, p.synthetic, p.sichtbar,
  coalesce(f.volltext IS NOT NULL, FALSE) AS has_full_text, r.rank <= {PARAMS.context_max} AS in_context FROM rr r JOIN pubd p USING (id) LEFT JOIN wt w ON w.chunkid = r.chunkid LEFT JOIN ft f ON f.id = r.id AND f.sichtbar = 'offen')"""


def _fits(c: str) -> str:
    return f"list_filter({c}, lambda t: list_has_any({S.subject_forms('t')}, forms))"


_CONTEXT = f"""ctx0 AS (SELECT qid, rank, id, p.* EXCLUDE id, reasons, coalesce(forms, []) AS forms, w.passage, hi.chunk_kind, f.volltext, f.erlaeuterung FROM hi JOIN pubd p USING (id)
  LEFT JOIN (SELECT qid, list(form) AS forms FROM sc2 WHERE kept GROUP BY qid) USING (qid) LEFT JOIN wt w ON w.chunkid = hi.chunkid LEFT JOIN ft f ON f.id = hi.id AND f.sichtbar = 'offen' WHERE rank <= {PARAMS.context_max}),
ctx1 AS (SELECT *, list_concat({_fits('subjects')}, {_fits('variants')}) AS hit FROM ctx0),
ctx2 AS (SELECT *, list_filter(subjects, lambda t: NOT list_contains(hit, t)) AS other, concat_ws(' | ', CASE WHEN len(senders) > 0 THEN 'Von: ' || array_to_string(senders, ', ') END,
  CASE WHEN len(recipients) > 0 THEN 'An: ' || array_to_string(recipients, ', ') END, CASE WHEN date_display <> '' THEN 'Datum: ' || date_display END, CASE WHEN len(places_sent) > 0 THEN 'Absendeort: ' || array_to_string(places_sent, ', ') END) AS who FROM ctx1),
ctx AS (SELECT qid, rank, id, concat_ws(chr(10), '[' || rank || '] Brief ' || id || ' (' || url || ')', nullif(who, ''), 'Treffer: ' || reasons,
  CASE WHEN len(hit) > 0 THEN 'Treffer-Schlagwort: ' || array_to_string(hit, '; ') END,
  CASE WHEN len(other) > 0 THEN CASE WHEN len(hit) > 0 THEN 'Weitere Schlagworte: ' ELSE 'Schlagworte: ' END || array_to_string(other[1:{PARAMS.tags_shown}], '; ') || CASE WHEN len(other) > {PARAMS.tags_shown} THEN ' (+' || (len(other) - {PARAMS.tags_shown}) || ')' ELSE '' END END,
  CASE WHEN incipit <> '' THEN 'Incipit: "' || incipit || '"' END, regest, CASE WHEN synthetic THEN '(Automatisch erzeugt)' END,
  CASE WHEN passage IS NOT NULL THEN CASE WHEN chunk_kind = 'volltext' THEN 'Transkription (Passage): ' ELSE 'Erläuterung (Passage): ' END || passage WHEN rank <= {PARAMS.excerpts} THEN 'Transkription (Auszug): ' || substr(volltext, 1, {PARAMS.excerpt_chars}) END,
  CASE WHEN rank <= {PARAMS.excerpts} THEN 'Erläuterung: ' || erlaeuterung END) AS block FROM ctx2)"""
_ANSWERS_SQL = f"""known AS (SELECT qid, array_to_string(list_transform(list(id ORDER BY rank)[1:3], lambda i: 'Brief ' || i), ', ') AS named, count_if(keyword AND rank <= {PARAMS.context_max}) AS evidence FROM hi GROUP BY qid)
SELECT qid, CASE WHEN named IS NULL THEN CASE WHEN statistic THEN '{W.STATISTIC_ANSWER}' ELSE '{W.NOTHING_FOUND}' END
  WHEN contains(text, 'Vorwürfe') AND evidence = 0 THEN 'Die vorliegenden Briefe enthalten dazu keine Informationen.' ELSE 'Dazu: ' || named || '.' END AS answer,
  named IS NOT NULL AND contains(text, 'Waldstreit') AND NOT contains(text, 'Vorwürfe') AS citation_retry, named IS NOT NULL AND contains(text, 'Vorwürfe') AND evidence > 0 AS refusal_retry, NULL::VARCHAR AS error FROM q LEFT JOIN known USING (qid)"""
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_SIZE, _HALF, _LAP = A.DEFAULT.chunk_size, A.DEFAULT.chunk_size // 2, A.DEFAULT.chunk_overlap
def _stop(b: str) -> str:
    end = f"({b} + {_SIZE})"
    back = f"strpos(reverse(substr(t, 1, {end} + 1)), ' ')"
    return f"CASE WHEN {end} >= length(t) THEN length(t) WHEN {back} > 0 AND {end} + 1 - {back} > {b} + {_HALF} THEN {end} + 1 - {back} ELSE {end} END"


_WIN = f"""src AS (SELECT * FROM (SELECT id, kind, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) AS t FROM (SELECT id, 'volltext' AS kind, volltext AS text FROM ft WHERE sichtbar = 'offen' UNION ALL SELECT id, 'erlaeuterung', erlaeuterung FROM ft WHERE sichtbar = 'offen') WHERE text IS NOT NULL) WHERE t <> ''),
win AS (SELECT id, kind, t, 0 AS seq, 0 AS b, {_stop('0')} AS e FROM src UNION ALL
  SELECT id, kind, t, seq + 1, nb, {_stop('nb')} FROM (SELECT *, greatest(e - {_LAP}, b + 1) AS nb FROM win WHERE e < length(t)))"""


_TURNS = ", ".join(f"('{c}', {n}, '{r}', '{t}')" for c, n, r, t in TURNS)
_ANSWERS = ", ".join("('{}', '{}', {}::VARCHAR[])".format(a, t.replace("'", "''"), s) for a, t, s in ANSWERS)
_CLIP = f"""hc AS (SELECT conv, turn, role, substr(trim(content), 1, 700) AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn DESC) AS n FROM (VALUES {_TURNS}) t(conv, turn, role, content)
  WHERE role IN ('user', 'assistant') AND trim(content) <> '') WHERE n <= 6)"""

_TEXT = (S.FULLTEXT, _WIN, _TEXTS)
_FULL = (S.CORPUS, _LETTERS, _RAW, *_TEXT, S.LABELS, *_MATCH, S.VECTORS, _QV, _SCORES, _FUSE)
_WORDS = S.words("text")
_HASHED = f"""etx AS (SELECT id, concat_ws(chr(10), titel, CASE WHEN len(subjects) > 0 THEN 'Schlagworte: ' || array_to_string(subjects, ', ') END, regest, CASE WHEN incipit <> '' THEN 'Incipit: ' || incipit END) AS text FROM pub),
ew AS (SELECT 'l' AS side, id, unnest({_WORDS}) AS w FROM etx UNION ALL SELECT 'q', qid, unnest({_WORDS}) FROM q0),
ev0 AS (SELECT side, id, ('0x' || substr(md5(w), 1, 8))::BIGINT % {embedding.DIM} AS slot, sum(CASE WHEN substr(md5(w), 9, 1) >= '8' THEN 1 ELSE -1 END) AS x FROM ew GROUP BY ALL),
en AS (SELECT side, id, sqrt(sum(x * x)) AS norm FROM ev0 GROUP BY ALL HAVING sum(x * x) > 0),
ed AS (SELECT b.id AS qid, a.id, sum(a.x * b.x) AS dot FROM ev0 a JOIN ev0 b USING (slot) WHERE a.side = 'l' AND b.side = 'q' GROUP BY ALL),
es AS (SELECT b.id AS qid, a.id, round(coalesce(dot, 0) / (a.norm * b.norm), 6) AS score FROM (FROM en WHERE side = 'l') a CROSS JOIN (FROM en WHERE side = 'q') b LEFT JOIN ed ON ed.qid = b.id AND ed.id = a.id)"""

SQL = {
    "etl_unwrap_default": _with(_LETTERS, _RAW, then="SELECT * EXCLUDE s FROM raw"),
    "etl_resolve_labels": _with(_LETTERS, _RAW, S.LABELS, _RESOLVED, then="SELECT * FROM res"),
    "etl_abstract": _with(
        _LETTERS, _RAW, S.LABELS, _RESOLVED,
        then=f"SELECT id, {S.abstract('textsorte', 'senders', 'recipients', 'places_sent', 'd', 'l')} AS abstract FROM (SELECT *, coalesce(date_display, date_iso) AS d, coalesce(labels, []) AS l FROM raw LEFT JOIN res USING (brief_id))",
    ),
    "etl_kinds": _with(_LETTERS, _RAW, S.LABELS, then=f"""SELECT brief_id, FALSE AS coded, textsorte FROM raw UNION ALL SELECT brief_id, TRUE, CASE WHEN regexp_matches(k, '^[0-9a-f]{{24}}$') THEN short ELSE k END
  FROM (SELECT brief_id, {_id('l[1]')} AS k FROM (SELECT brief_id, {_list(_member('s', 'sachen'))} AS l FROM raw)) LEFT JOIN lab ON ref_id = k WHERE k IS NOT NULL"""),
    "etl_destination": _with(_LETTERS, _RAW, then=f"SELECT id, {S.abstract('textsorte', 'senders', 'recipients', 'places_sent', 'date_iso', '[]::VARCHAR[]', 'recipients[1:1]')} AS abstract FROM raw"),
    "etl_servable": _with(S.CORPUS, then="SELECT id, sichtbar FROM let WHERE sichtbar IS DISTINCT FROM 'intern'"),
    "etl_embed_text": _with(S.CORPUS, then="SELECT id, concat_ws(chr(10), titel, CASE WHEN len(subjects) > 0 THEN 'Schlagworte: ' || array_to_string(subjects, ', ') END, regest, CASE WHEN incipit <> '' THEN 'Incipit: ' || incipit END) AS text, synthetic FROM let"),
    "etl_year_counts": _with(S.CORPUS, then="SELECT left(date_iso, 4) AS year, count(*) AS letters FROM let GROUP BY 1"),
    "etl_visibility": _with(S.CORPUS, then="SELECT count(*) AS letters, count_if(sichtbar = 'offen') AS offen, count_if(sichtbar = 'intern') AS intern, count_if(sichtbar IS DISTINCT FROM 'intern') AS not_intern, count_if(synthetic) AS synthetic FROM let"),
    "etl_last_row_wins": _with(S.CORPUS, then="SELECT id, sichtbar, titel, date_iso FROM let"),
    "etl_fulltext": _with(S.FULLTEXT, then="SELECT id, coalesce(length(volltext), 0) AS volltext_length, volltext IS NOT NULL AS has_full_text, substr(volltext, 1, 1500) AS excerpt FROM ft"),
    "text_normalize": _with(S.CORPUS, then=f"SELECT id, {S.norm('regest')} AS normal FROM let"),
    "text_stems": f"SELECT stem, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({S.stems('text')}) AS stem FROM documents) GROUP BY stem",
    "text_subject_forms": _with(S.LABELS, then=f"SELECT short, unnest({S.subject_forms('short')}) AS form FROM (SELECT DISTINCT short FROM lab)"),
    "postings_subject": _with(*_BASE, S.SUBJECT_POSTINGS, then="SELECT form, id FROM sp"),
    "postings_person": _with(*_BASE, S.PERSONS, then="SELECT form, id, 'sender' AS side FROM snd UNION ALL SELECT form, id, 'recipient' FROM rcp"),
    "postings_stem": _with(*_BASE, S.STEM_TEXT, then="SELECT stem, count(*) AS letters FROM stp GROUP BY stem"),
    "stem_text_phrase": _with(*_BASE, S.STEM_TEXT, then="SELECT id, stem_text FROM st WHERE contains(stem_text, ' fruh rat ')"),
    "chunk_documents": _with(S.FULLTEXT, _WIN, then="SELECT id || '__' || kind || '__' || printf('%03d', seq) AS chunkid, id AS letterid, kind, seq, trim(substr(t, b + 1, e - b)) AS text FROM win"),
    "chunk_unpivot": _with(S.FULLTEXT, then="SELECT kind, count(*) AS n, sum(length(text)) AS chars FROM (SELECT 'volltext' AS kind, volltext AS text FROM ft WHERE sichtbar = 'offen' UNION ALL SELECT 'erlaeuterung', erlaeuterung FROM ft WHERE sichtbar = 'offen') WHERE text IS NOT NULL GROUP BY kind"),
    "question_features": _with(S.features(_VALUES), then="SELECT qid, normal, stemmed, array_to_string(terms, ' ') AS terms, array_to_string(list_sort(years), ' ') AS years, array_to_string(list_sort(ids), ' ') AS ids, statistic FROM q"),
    "match_subject_forms": _with(*_BASE, *_MATCH, then="SELECT * FROM sc2"),
    "match_subjects": _with(*_BASE, *_MATCH, then="SELECT qid, id, count(*) AS matches FROM (SELECT qid, form FROM sc2 WHERE kept) JOIN sp USING (form) GROUP BY qid, id"),
    "match_persons": _with(*_BASE, *_MATCH, then="SELECT * FROM pm"),
    "match_years": _with(*_BASE, *_MATCH, then="SELECT * FROM ym"),
    "match_ids": _with(*_BASE, *_MATCH, then="SELECT * FROM im"),
    "match_texts": _with(*_BASE, *_MATCH, then="SELECT * FROM tm"),
    "gates": _with(*_BASE, *_MATCH, then="SELECT * FROM ga"),
    "cosine_top30": _with(S.CORPUS, S.VECTORS, *_SET, _scores("sq", "sc0"), then="SELECT * FROM sco WHERE rank <= 30"),
    "cosine_expression": _with(S.VECTORS, then=f"SELECT v.vec_no, round(list_cosine_similarity(v.embedding::DOUBLE[], w.embedding::DOUBLE[]), 6) AS score FROM lv v JOIN lv w ON w.vec_no = v.vec_no - v.vec_no % {EVERY}"),
    "chunk_best": _with(S.CORPUS, S.VECTORS, *_SET, _scores("sq", "sc0"), then="SELECT * FROM cb"),
    "dedup_by_score": _with(S.CORPUS, S.VECTORS, *_SET, _scores("sq", "sc0"), then="SELECT qid, id, chunkid, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY score DESC, chunkid) AS r FROM cs WHERE rank <= 100) WHERE r = 1"),
    "question_similarity": _with(S.CORPUS, S.features(_VALUES), _HASHED, then=f"SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM es) WHERE rank <= {PARAMS.top_k}"),
    "fuse_hits": _with(*_ALL, then="SELECT * FROM hi"),
    "response_counts": _with(*_ALL, then=f"SELECT *, least(matches, {PARAMS.context_max}) AS in_context FROM (SELECT ga.qid, closed, lookup, structured, count(*) FILTER (stays) AS matches, count(*) FILTER (keyword) AS keyword_matches, count(*) FILTER (by_chunk) AS chunk_matches, count(*) FILTER (NOT stays) AS below_floor FROM ga LEFT JOIN hi2 ON hi2.qid = ga.qid GROUP BY ALL)"),
    "rerank_prune": _with(*_FULL, _RERANK, then="SELECT qid, id, rank, keyword, rerank FROM rr"),
    "response_chat": _with(*_FULL, _RERANK, _DESCRIBED, then="SELECT qid, rank, id, url, score, rerank, reasons, chunk_kind AS passage_kind, passage, titel, date_display, senders, recipients, regest, synthetic AS regest_synthetic, sichtbar, NOT synthetic AS has_regest, has_full_text, in_context FROM sr"),
    "response_retrieve": _with(*_FULL, _RERANK, _DESCRIBED, then="SELECT qid, rank, id, score, rerank, reasons, chunk_kind AS passage, sichtbar FROM sr"),
    "sources_split": _with(*_FULL, _RERANK, _DESCRIBED, then="SELECT qid, CASE WHEN in_context THEN 'cited' ELSE 'extra' END AS part, count(*) AS letters, min(rank) AS first FROM sr GROUP BY ALL"),
    "calibration": _with(*_FULL, _RERANK, _DESCRIBED, then="SELECT 'all' AS run, share, l[floor((len(l) - 1) * share)::BIGINT + 1] AS value FROM (SELECT list(rerank ORDER BY rerank) AS l FROM sr WHERE rerank IS NOT NULL AND (reasons = 'Embedding' OR starts_with(reasons, 'Passage '))), (SELECT unnest([0.1, 0.5, 0.9]) AS share)"),
    "context_blocks": _with(*_FULL, _DESCRIBED.split(",\nsr AS")[0], _CONTEXT, then="SELECT * FROM ctx"),
    "context_prompt": _with(*_FULL, _DESCRIBED.split(",\nsr AS")[0], _CONTEXT, then="SELECT qid, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM ctx GROUP BY qid"),
    "answers": _with(*_ALL, then="").rstrip() + ",\n" + _ANSWERS_SQL,
    "requests_refused": "SELECT rid, 'Missing ''message'' string in request body.' AS error FROM (VALUES ('r2'), ('r3')) t(rid)",
    "rewritten": "SELECT * FROM (VALUES ('f1', 'Frage: Wer? Und 1563?', TRUE), ('f2', 'Und an wen?', FALSE), ('f3', 'Mehr?', FALSE), ('f4', 'Wann?', FALSE)) t(qid, text, rewritten)",
    "history_clip": _with(_CLIP, then="SELECT * FROM hc"),
    "history_transcript": _with(_CLIP, then="SELECT conv, string_agg(CASE WHEN role = 'assistant' THEN 'Antwort: ' ELSE 'Frage: ' END || content, chr(10) ORDER BY turn) AS transcript FROM hc GROUP BY conv"),
    "citation_guard": f"SELECT aid, array_to_string(list_sort(c), ' ') AS cited, array_to_string(list_sort(list_filter(c, lambda x: NOT list_contains(sources, x))), ' ') AS invented, len(list_filter(c, lambda x: NOT list_contains(sources, x))) > 0 AS retry "
    f"FROM (SELECT *, list_distinct(regexp_extract_all(answer, '(?i)Brief\\s+(?:Nr\\.?\\s*)?(\\d{{3,6}})', 1)) AS c FROM (VALUES {_ANSWERS}) t(aid, answer, sources))",
    "refusal_guard": f"SELECT aid, o AS opens_with_refusal, regexp_matches(answer, '(?i){T.REFUSAL}') AS refuses, o AND len(sources) > 0 AS retry FROM (SELECT *, regexp_matches(substr(trim(answer), 1, 160), '(?i){T.REFUSAL_START}') AS o FROM (VALUES {_ANSWERS}) t(aid, answer, sources))",
}
