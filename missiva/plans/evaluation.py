"""Gold sets, questions, measures and incremental upkeep over the archive; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from missiva.functions import text as T
from missiva.functions import variants as V
from missiva.operators import archive as A
from missiva.operators import evaluate as E
from missiva.plans import records
from missiva.plans import retrieval as R
from missiva.plans import sqltext as S
from missiva.sources.tables import current_letters, latest, table

#: Terms of content questions, each with the expression that finds it in an abstract.
TERMS = {"Siegel": "siegel", "Vorwürfe": "vorw[uü]rf", "Rechnung": "rechnung", "Universität": "universität"}
SAMPLED = 10
SEED = "20260821"
SHARES = [0.0, 0.1, 0.5, 0.9, 1.0]
THRESHOLDS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8]


def gold_tag_counts(spark, d):
    return E.tag_counts(A.corpus(spark, d))


def gold_pair_counts(spark, d):
    return E.pair_counts(A.corpus(spark, d))


def gold_tag_in(spark, d):
    """Letters that carry one of a few subjects."""
    wanted = F.array(F.lit("Jagdordnung"), F.lit("Waldstreit"))
    return E.by_visibility(A.corpus(spark, d).filter(F.arrays_overlap("subjects", wanted)), [])


def gold_regex_pair(spark, d):
    """Letters whose senders and recipients each have a match."""
    c = A.corpus(spark, d)
    return E.by_visibility(c.filter(F.exists("senders", lambda s: s.rlike("Keispler|Krärbogel")) & F.exists("recipients", lambda r: r.rlike("[a-z]mann"))), [])


def gold_year(spark, d):
    """Letters of each year, by the year in their nested date."""
    dated = current_letters(spark, d, "short", "sichtbar", "datierung").filter(F.coalesce("short", F.lit("")) != "").withColumn("date", V.parse(F.col("datierung")))
    year = V.scalar(V.member(V.member(F.col("date"), "am"), "j")).try_cast("int")
    rows = dated.select(F.col("short").alias("id"), A.some(F.col("sichtbar"), "unbekannt").alias("sichtbar"), year.alias("year"))
    return E.by_visibility(rows.filter("year IS NOT NULL"), ["year"])


def gold_name_spellings(spark, d):
    c = A.corpus(spark, d)
    pairs = c.filter("size(senders) > 0 AND size(recipients) > 0").select(F.get("senders", F.lit(0)).alias("sender"), F.get("recipients", F.lit(0)).alias("recipient")).distinct()
    return E.spelled(c, pairs).groupBy("sender", "recipient").agg(F.count("*").alias("letters"))


def gold_tagged_split(spark, d):
    return E.tagged_split(A.corpus(spark, d), TERMS)


def untagged_recall(spark, d):
    """Of the letters whose abstract has a term, those without its tag; the run found letters that have an opening."""
    split = gold_tagged_split(spark, d).withColumnRenamed("term", "qid")
    hits = split.join(A.corpus(spark, d).filter("incipit <> ''").select("id"), "id").select("qid", "id")
    return E.untagged_recall(hits, split)


def generated_questions(spark, d):
    return E.questions_about(A.corpus(spark, d), TERMS, SAMPLED, SEED)


def question_lists(spark, d):
    """Questions by template, numbered: what a page would offer."""
    w = Window.partitionBy("template").orderBy("id")  # at most SAMPLED rows each
    return generated_questions(spark, d).select("template", F.row_number().over(w).alias("nr"), "text")


#: Answers to be checked: (qid, lang, answer, sources, seen, gold, must, exempt, refusal expected).
CHECKED = [
    ("a1", "de", "Brief 10001 und Brief 10002 handeln von der Sache und dem Rat.", ["10001", "10002", "10003"], 2, ["10001", "10003"], [], [], False),
    ("a2", "de", "The letter Brief 10001 and Brief 77777 are in the archive.", ["10001"], 5, ["10001"], ["10001"], ["77777"], False),
    ("a3", "de", "Die vorliegenden Briefe enthalten dazu keine Informationen.", ["10002", "10004"], 2, ["10004"], [], [], False),
    ("a4", "de", "keine Informationen", ["10005"], 1, [], ["10005", "10006"], [], True),
    ("a5", "en", "It is in Brief 10006 and Brief 88888, and Brief Nr. 99999.", ["10007"], 1, [], [], [], False),
    ("a6", "de", "", [], 0, ["10001"], [], [], True),
]


def answer_checks(spark, d):
    """Literal answers; the payload of a source is its number and the abstract of its letter."""
    rows = spark.createDataFrame(CHECKED, "qid string, lang string, answer string, sources array<string>, in_context int, gold array<string>, must array<string>, exempt array<string>, expect_refusal boolean")
    texts = A.corpus(spark, d).select("id", F.concat_ws(" ", "id", "regest", F.when(F.col("id") == "10007", "siehe 10006")).alias("t"))
    said = rows.select("qid", F.explode("sources").alias("id")).join(texts, "id").groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("t")), " ").alias("payload"))
    return E.checked_answers(rows.join(said, "qid", "left").withColumn("payload", F.coalesce("payload", F.lit(""))))


def answer_report(spark, d):
    return E.answer_report(answer_checks(spark, d))


def false_refusals(spark, d):
    return answer_checks(spark, d).filter("false_refusal").select("qid")


def measure_report(spark, d):
    """Means of the run as texts, over subjects with few and with many gold letters."""
    m = recall_precision(spark, d).withColumn("size", F.when(F.col("n_gold") <= 5, "few").otherwise("many"))
    return m.groupBy("size").agg(F.count("*").alias("questions"), E.percent(F.round(F.avg("recall"), 6)).alias("recall"), E.percent(F.round(F.avg("precision"), 6)).alias("precision"))


def seeded_sample(spark, d):
    return E.sampled(gold_tag_counts(spark, d), "tag", SAMPLED, SEED)


def template_groups(spark, d):
    """Generated questions by template."""
    tags = gold_tag_counts(spark, d).select(F.lit("sache").alias("template"), F.concat(F.lit("Welche Briefe behandeln "), "tag", F.lit("?")).alias("text"))
    pairs = gold_pair_counts(spark, d).select(F.lit("person").alias("template"), F.concat(F.lit("Welche Briefe schrieb "), "sender", F.lit(" an "), "recipient", F.lit("?")).alias("text"))
    return tags.unionByName(pairs).groupBy("template").agg(F.count("*").alias("questions"), F.min("text").alias("first"))


def _run(spark, d) -> tuple[DataFrame, DataFrame]:
    """A run to measure: questions are subjects, gold(qid, id, opens, edited) the open letters tagged with them, hits
    those that name them in their abstract or opening, or are tagged and have an opening at all."""
    c = A.corpus(spark, d).filter("sichtbar = 'offen'").withColumn("opens", F.coalesce(F.col("incipit") != "", F.lit(False)))
    gold = c.select(F.explode(F.array_distinct("subjects")).alias("qid"), "id", "opens", (~F.col("synthetic")).alias("edited"))
    hits = gold.filter("opens").select("qid", "id")
    named = c.select("id", F.explode(T.words(T.normalize(F.concat_ws(" ", "regest", "incipit")))).alias("w")).distinct()
    tags = gold.select("qid", F.lower("qid").alias("w")).distinct()
    return hits.unionByName(named.join(tags, "w").select("qid", "id")).distinct(), gold


def recall_precision(spark, d):
    hits, gold = _run(spark, d)
    return E.recall_precision(hits, gold.select("qid", "id"))


def worst_questions(spark, d):
    return E.worst(recall_precision(spark, d))


def mean_measures(spark, d):
    m = recall_precision(spark, d)
    return m.agg(F.count("*").alias("questions"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision"))


def leak_assertion(spark, d):
    """Hits of a run over all letters that aren't open."""
    c = A.corpus(spark, d)
    hits = c.filter("NOT synthetic").select(F.lit("all").alias("qid"), "id")
    forbidden = gold_tag_in(spark, d).unionByName(gold_regex_pair(spark, d)).filter("side = 'intern'")
    return E.leaks(hits, c, forbidden)


def baseline_diff(spark, d):
    """The run against one that found tagged letters with an opening only."""
    hits, gold = _run(spark, d)
    plain = gold.select("qid", "id")
    return E.baseline_diff(E.recall_precision(hits, plain), E.recall_precision(gold.filter("opens").select("qid", "id"), plain))


def citation_recall(spark, d):
    _, gold = _run(spark, d)
    shown = gold.filter("opens")
    return E.citation_recall(shown.select("qid", "id"), shown.filter("edited").select("qid", "id"))


def _values(spark, d):
    return table(spark, d, "events").select("event_type", "value")


def floor_quantile(spark, d):
    return E.floor_quantile(_values(spark, d), "value", ["event_type"], SHARES)


def threshold_sweep(spark, d):
    return E.threshold_sweep(_values(spark, d), "value", ["event_type"], THRESHOLDS)


def stability_outcomes(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("qid"), F.col("event_id").alias("run"), F.col("event_type").alias("outcome"))
    return E.stability(e)


def detect_lang(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", T.detect_lang(F.col("text")).alias("detected"))


def language_mix(spark, d):
    r = table(spark, d, "documents").filter("text IS NOT NULL").select("lang", T.detect_lang(F.col("text")).alias("detected"))
    return r.groupBy("lang", "detected").agg(F.count("*").alias("n"), F.count_if(F.col("lang").isin("de", "en") & (F.col("lang") != F.col("detected"))).alias("off"))


def health_counters(spark, d):
    """One row of sizes: letters, open ones, subjects in use, passages, letters with a vector."""
    c = A.corpus(spark, d)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        one(c, "letters"),
        one(A.public(c), "retrievable"),
        one(A.public(c).select(F.explode("subjects")).distinct(), "subjects"),
        one(table(spark, d, "chunk_vectors").select("chunkid").distinct(), "chunks"),
        one(table(spark, d, "letter_vectors").filter("embedding IS NOT NULL").select("id").distinct(), "vectors"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def incremental_missing(spark, d):
    """Letters that still need a vector."""
    done = table(spark, d, "letter_vectors").filter("embedding IS NOT NULL").select("id")
    return A.public(A.corpus(spark, d)).join(done, "id", "left_anti").select("id")


def orphan_vectors(spark, d):
    """Vectors whose letter is gone."""
    return table(spark, d, "letter_vectors").select("vec_no", "id").distinct().join(A.public(A.corpus(spark, d)), "id", "left_anti").select("vec_no", "id")


def hash_invalidation(spark, d):
    """Letters whose text changed between its first and last load, by hash of what is embedded."""
    rows = table(spark, d, "briefs").filter("brief_id IS NOT NULL").select("brief_id", "rev", "loaded_at", F.sha1(F.concat_ws("|", "textsorte", "datierung", "schlagworte")).alias("h"))
    new = latest(rows, ["brief_id"], [F.col("rev").desc(), F.col("loaded_at").desc()])
    old = latest(rows, ["brief_id"], [F.col("rev").asc(), F.col("loaded_at").asc()])
    return new.join(old.select("brief_id", F.col("h").alias("old")), "brief_id").filter("h <> old").select("brief_id", "h")


NAMES = """gold_tag_counts gold_pair_counts gold_tag_in gold_regex_pair gold_year gold_name_spellings gold_tagged_split untagged_recall generated_questions
question_lists answer_checks answer_report false_refusals measure_report seeded_sample template_groups
recall_precision worst_questions mean_measures leak_assertion baseline_diff citation_recall floor_quantile threshold_sweep stability_outcomes detect_lang
language_mix health_counters incremental_missing orphan_vectors hash_invalidation""".split()
QUERIES = {n: globals()[n] for n in NAMES}


def _with(*parts: str, then: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + then


def _split(rows: str, keys: str = "") -> str:
    """Numbered gold letters of rows (keys, id, sichtbar)."""
    return f"""SELECT *, row_number() OVER (PARTITION BY {keys} side ORDER BY TRY_CAST(id AS BIGINT) NULLS LAST, id)::INT AS nr
  FROM (SELECT DISTINCT {keys} CASE WHEN sichtbar = 'offen' THEN 'offen' ELSE 'intern' END AS side, id FROM {rows})"""


_TAGS = "tc AS (SELECT tag, count(*) AS n FROM (SELECT unnest(subjects) AS tag FROM pub) WHERE length(tag) >= 5 GROUP BY tag HAVING count(*) BETWEEN 3 AND 60)"
_PAIRS = "pc AS (SELECT s AS sender, r AS recipient, count(*) AS n FROM (SELECT senders[1] AS s, recipients[1] AS r FROM pub) WHERE s <> '' AND r <> '' GROUP BY ALL HAVING count(*) >= 3)"
_SPELL = "list_distinct([{x}, c, '[' || c || ']', '[' || split_part(c, ',', 1) || ']' || regexp_extract(c, '^[^,]*(,.*)$', 1)])"


def _forms(x: str, name: str, alias: str) -> str:
    core = f"trim(regexp_replace(regexp_replace({x}, '[\\[\\]]', '', 'g'), '\\s+', ' ', 'g'))"
    return f"{name} AS (SELECT sender, recipient, unnest({_SPELL.format(x=x)}) AS {alias} FROM (SELECT *, {core} AS c FROM pr))"


_RUN = f"""gold AS (SELECT DISTINCT unnest(subjects) AS qid, id, coalesce(incipit <> '', FALSE) AS opens, NOT synthetic AS edited FROM pub),
nw AS (SELECT DISTINCT id, unnest({S.words("concat_ws(' ', regest, incipit)")}) AS w FROM pub),
hits AS (SELECT qid, id FROM gold WHERE opens UNION SELECT t.qid, nw.id FROM nw JOIN (SELECT DISTINCT qid, lower(qid) AS w FROM gold) t USING (w))"""


def _measures(name: str, hits: str) -> str:
    return f"""{name} AS (SELECT qid, n_hits, n_gold, round(CASE WHEN n_gold > 0 THEN b / n_gold ELSE 0 END, 6) AS recall, round(CASE WHEN n_hits > 0 THEN b / n_hits ELSE 0 END, 6) AS precision FROM (
  SELECT coalesce(h.qid, g.qid) AS qid, count(h.id) AS n_hits, count(g.id) AS n_gold, count_if(h.id IS NOT NULL AND g.id IS NOT NULL) AS b FROM {hits} h FULL JOIN gold g ON h.qid = g.qid AND h.id = g.id GROUP BY 1))"""


def _count(text: str, ws: list[str]) -> str:
    padded = f"(' ' || lower({text}) || ' ')"
    return " + ".join(f"(len(string_split({padded}, ' {w} ')) - 1)" for w in ws)


_LANG = f"CASE WHEN regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'zh' WHEN {_count('text', T.ENGLISH_WORDS)} > {_count('text', T.GERMAN_WORDS)} THEN 'en' ELSE 'de' END"
_TERMS = ", ".join(f"('{t}', '{rx}')" for t, rx in TERMS.items())
_TAGGED = f"""terms AS (SELECT * FROM (VALUES {_TERMS}) t(term, rx)),
tg AS (SELECT term, id, len(list_filter(subjects, lambda s: regexp_matches(s, '(?i)' || rx))) > 0 AS tagged FROM pub, terms WHERE regexp_matches(regest, '(?i)' || rx))"""
_CORE = "trim(regexp_replace(regexp_replace({x}, '[\\[\\]]', '', 'g'), '\\s+', ' ', 'g'))"
_GENERATED = f"""gs AS (SELECT 'gen_sache_' || right(md5(tag), 6) AS id, 'sache' AS template, 'de' AS lang, 'Welche Briefe erwähnen ' || tag || '?' AS text, count_if(sichtbar = 'offen') AS offen, count_if(sichtbar <> 'offen') AS intern
  FROM (SELECT tag FROM tc ORDER BY md5(tag || '{SEED}'), tag LIMIT {SAMPLED}) JOIN (SELECT DISTINCT id, sichtbar, unnest(subjects) AS tag FROM let) USING (tag) GROUP BY tag),
pr AS (SELECT sender, recipient, row_number() OVER (ORDER BY md5(sender || '|' || recipient || '{SEED}'), sender || '|' || recipient) AS nr FROM pc QUALIFY nr <= {SAMPLED}),
{_forms("sender", "fs", "nm")}, {_forms("recipient", "fr", "nm")},
pl AS (SELECT sender, recipient, id FROM fs JOIN (SELECT id, unnest(senders) AS nm FROM let) USING (nm) INTERSECT SELECT sender, recipient, id FROM fr JOIN (SELECT id, unnest(recipients) AS nm FROM let) USING (nm)),
gp AS (SELECT 'gen_person_' || lpad(nr::VARCHAR, 2, '0') || '_' || (first(id ORDER BY TRY_CAST(id AS BIGINT), id) FILTER (sichtbar = 'offen')) AS id, 'person' AS template, 'de' AS lang,
  'Welche Briefe schrieb ' || {_CORE.format(x='sender')} || ' an ' || {_CORE.format(x='recipient')} || '?' AS text, count_if(sichtbar = 'offen') AS offen, count_if(sichtbar <> 'offen') AS intern
  FROM pl JOIN let USING (id) JOIN pr USING (sender, recipient) GROUP BY sender, recipient, nr HAVING count_if(sichtbar = 'offen') > 0),
gi AS (SELECT 'gen_inhalt_' || regexp_replace(lower(term), '[^a-z]', '', 'g') AS id, 'inhalt' AS template, 'de' AS lang, 'Welche Briefe erwähnen ' || term || '?' AS text, count_if(sichtbar = 'offen') AS offen, count_if(sichtbar <> 'offen') AS intern
  FROM let JOIN (SELECT * FROM (VALUES {_TERMS}) t(term, rx)) ON regexp_matches(regest, '(?i)' || rx) GROUP BY term),
gq AS (FROM gs UNION ALL FROM gp UNION ALL FROM gi)"""
_CHECK_ROWS = ", ".join("('{}', '{}', '{}', {}::VARCHAR[], {}, {}::VARCHAR[], {}::VARCHAR[], {}::VARCHAR[], {})".format(*r) for r in CHECKED)
_CHECKS = f"""ck AS (SELECT * FROM (VALUES {_CHECK_ROWS}) t(qid, lang, answer, sources, seen, gold, must, exempt, expect)),
pay AS (SELECT qid, string_agg(concat_ws(' ', id, regest, CASE WHEN id = '10007' THEN 'siehe 10006' END), ' ') AS payload FROM (SELECT qid, unnest(sources) AS id FROM ck) JOIN let USING (id) GROUP BY qid),
ck2 AS (SELECT *, list_filter(gold, lambda g: list_contains(sources[1:seen], g)) AS gs, list_filter(must, lambda g: list_contains(sources[1:seen], g)) AS ms, list_distinct(regexp_extract_all(answer, 'Brief\\s+(\\d{{3,6}})', 1)) AS cited,
  regexp_matches(answer, '(?i){T.REFUSAL}') AS ref, {_LANG.replace('text', 'answer')} AS al FROM ck LEFT JOIN pay USING (qid)),
ck3 AS (SELECT *, list_filter(cited, lambda i: NOT list_contains(sources, i) AND NOT list_contains(exempt, i)) AS un, len(list_filter(gs, lambda g: list_contains(cited, g))) AS gc, len(list_filter(ms, lambda g: list_contains(cited, g))) AS mc FROM ck2),
ac AS (SELECT qid, al AS answer_lang, al = lang AS aligned, len(cited) AS cited, array_to_string(list_sort(list_filter(un, lambda i: contains(coalesce(payload, ''), i))), ' ') AS echoed, array_to_string(list_sort(list_filter(un, lambda i: NOT contains(coalesce(payload, ''), i))), ' ') AS invented,
  CASE WHEN expect THEN ref END AS refused, CASE WHEN len(gs) > 0 THEN round(gc / len(gs), 6) END AS citation_recall, len(ms) > 0 AND mc = len(ms) AS must_cited, array_to_string(list_sort(list_filter(ms, lambda g: NOT list_contains(cited, g))), ' ') AS must_uncited,
  CASE WHEN len(must) > 0 THEN len(ms) > 0 AND ref AND mc = 0 ELSE len(gs) > 0 AND ref AND gc = 0 END AS false_refusal FROM ck3)"""

SQL = {
    "gold_tag_counts": _with(S.CORPUS, _TAGS, then="SELECT * FROM tc"),
    "gold_pair_counts": _with(S.CORPUS, _PAIRS, then="SELECT * FROM pc"),
    "gold_tag_in": _with(S.CORPUS, then=_split("let WHERE list_has_any(subjects, ['Jagdordnung', 'Waldstreit'])")),
    "gold_regex_pair": _with(S.CORPUS, then=_split("let WHERE len(list_filter(senders, lambda s: regexp_matches(s, 'Keispler|Krärbogel'))) > 0 AND len(list_filter(recipients, lambda s: regexp_matches(s, '[a-z]mann'))) > 0")),
    "gold_year": _with(R._LETTERS, then=_split(f"""(SELECT short AS id, coalesce(nullif(sichtbar, ''), 'unbekannt') AS sichtbar, TRY_CAST({records._scalar(records._member(records._member('d', 'am'), 'j'))} AS INT) AS year
  FROM (SELECT *, CASE WHEN json_valid(datierung) THEN datierung::JSON END AS d FROM letters WHERE coalesce(short, '') <> '')) WHERE year IS NOT NULL""", "year,")),
    "gold_name_spellings": _with(
        S.CORPUS,
        "pr AS (SELECT DISTINCT senders[1] AS sender, recipients[1] AS recipient FROM let WHERE len(senders) > 0 AND len(recipients) > 0)",
        _forms("sender", "fs", "nm"),
        _forms("recipient", "fr", "nm"),
        then="SELECT sender, recipient, count(*) AS letters FROM (SELECT sender, recipient, id FROM fs JOIN (SELECT id, unnest(senders) AS nm FROM let) USING (nm) INTERSECT "
        "SELECT sender, recipient, id FROM fr JOIN (SELECT id, unnest(recipients) AS nm FROM let) USING (nm)) GROUP BY ALL",
    ),
    "gold_tagged_split": _with(S.CORPUS, _TAGGED, then="SELECT * FROM tg"),
    "untagged_recall": _with(
        S.CORPUS, _TAGGED,
        then="SELECT term AS qid, count_if(NOT tagged) AS untagged, CASE WHEN count_if(NOT tagged) > 0 THEN round(count_if(NOT tagged AND hit) / count_if(NOT tagged), 6) END AS untagged_recall "
        "FROM (SELECT tg.*, coalesce(incipit <> '', FALSE) AS hit FROM tg JOIN pub USING (id)) GROUP BY term",
    ),
    "generated_questions": _with(S.CORPUS, _TAGS, _PAIRS, _GENERATED, then="SELECT * FROM gq"),
    "question_lists": _with(S.CORPUS, _TAGS, _PAIRS, _GENERATED, then="SELECT template, row_number() OVER (PARTITION BY template ORDER BY id) AS nr, text FROM gq"),
    "answer_checks": _with(S.CORPUS, _CHECKS, then="SELECT * FROM ac"),
    "answer_report": _with(S.CORPUS, _CHECKS, then="SELECT count(*) AS answers, count_if(NOT aligned) AS misaligned, printf('%.1f%%', 100 * avg(citation_recall)) AS citation_recall, count_if(false_refusal) AS false_refusals FROM ac"),
    "false_refusals": _with(S.CORPUS, _CHECKS, then="SELECT qid FROM ac WHERE false_refusal"),
    "measure_report": _with(S.CORPUS, _RUN, _measures("m", "hits"), then="SELECT CASE WHEN n_gold <= 5 THEN 'few' ELSE 'many' END AS size, count(*) AS questions, printf('%.1f%%', 100 * round(avg(recall), 6)) AS recall, printf('%.1f%%', 100 * round(avg(precision), 6)) AS precision FROM m GROUP BY 1"),
    "seeded_sample": _with(S.CORPUS, _TAGS, then=f"SELECT * FROM tc ORDER BY md5(tag || '{SEED}'), tag LIMIT 10"),
    "template_groups": _with(
        S.CORPUS, _TAGS, _PAIRS,
        then="SELECT template, count(*) AS questions, min(text) AS first FROM (SELECT 'sache' AS template, 'Welche Briefe behandeln ' || tag || '?' AS text FROM tc UNION ALL SELECT 'person', 'Welche Briefe schrieb ' || sender || ' an ' || recipient || '?' FROM pc) GROUP BY template",
    ),
    "recall_precision": _with(S.CORPUS, _RUN, _measures("m", "hits"), then="SELECT * FROM m"),
    "worst_questions": _with(S.CORPUS, _RUN, _measures("m", "hits"), then="SELECT * FROM m ORDER BY recall, qid LIMIT 5"),
    "mean_measures": _with(S.CORPUS, _RUN, _measures("m", "hits"), then="SELECT count(*) AS questions, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision FROM m"),
    "leak_assertion": _with(S.CORPUS, then="SELECT 'all' AS qid, id FROM let WHERE NOT synthetic AND sichtbar <> 'offen'"),
    "baseline_diff": _with(
        S.CORPUS, _RUN, _measures("m", "hits"), "tagged AS (SELECT qid, id FROM gold WHERE opens)", _measures("b", "tagged"),
        then="SELECT qid, dr AS d_recall, dp AS d_precision, CASE WHEN least(dr, dp) < -0.005 THEN 'worse' WHEN greatest(dr, dp) > 0.005 THEN 'better' ELSE 'same' END AS verdict FROM (SELECT m.qid, round(m.recall - b.recall, 6) AS dr, round(m.precision - b.precision, 6) AS dp FROM m JOIN b USING (qid))",
    ),
    "citation_recall": _with(S.CORPUS, _RUN, then="SELECT qid, count(*) AS shown_gold, round(avg(edited::INT), 6) AS citation_recall, count_if(edited) = 0 AS false_refusal FROM gold WHERE opens GROUP BY qid"),
    "floor_quantile": f"SELECT event_type, share, l[floor((len(l) - 1) * share)::BIGINT + 1] AS value FROM (SELECT event_type, list(value ORDER BY value) AS l FROM events GROUP BY 1), (SELECT unnest({SHARES}) AS share)",
    "threshold_sweep": f"SELECT event_type, threshold, count_if(value >= threshold) AS n FROM events, (SELECT unnest({THRESHOLDS}) AS threshold) GROUP BY ALL",
    "stability_outcomes": "SELECT user_id::VARCHAR AS qid, count(DISTINCT event_type) AS outcomes FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1",
    "detect_lang": f"SELECT doc_id, {_LANG} AS detected FROM documents WHERE text IS NOT NULL",
    "language_mix": f"SELECT lang, detected, count(*) AS n, count_if(coalesce(lang IN ('de', 'en') AND lang <> detected, FALSE)) AS off FROM (SELECT lang, {_LANG} AS detected FROM documents WHERE text IS NOT NULL) GROUP BY ALL",
    "health_counters": _with(S.CORPUS, then="SELECT (SELECT count(*) FROM let) AS letters, (SELECT count(*) FROM pub) AS retrievable, (SELECT count(DISTINCT s) FROM (SELECT unnest(subjects) AS s FROM pub)) AS subjects, (SELECT count(*) FROM (SELECT DISTINCT chunkid FROM chunk_vectors)) AS chunks, (SELECT count(*) FROM (SELECT DISTINCT id FROM letter_vectors WHERE embedding IS NOT NULL)) AS vectors"),
    "incremental_missing": _with(S.CORPUS, then="SELECT id FROM pub p WHERE NOT EXISTS (SELECT 1 FROM letter_vectors v WHERE v.id = p.id AND embedding IS NOT NULL)"),
    "orphan_vectors": _with(S.CORPUS, then="SELECT DISTINCT vec_no, id FROM letter_vectors v WHERE NOT EXISTS (SELECT 1 FROM pub p WHERE p.id = v.id)"),
    "hash_invalidation": "SELECT brief_id, h FROM (SELECT brief_id, first(h ORDER BY rev DESC, loaded_at DESC) AS h, first(h ORDER BY rev, loaded_at) AS old FROM (SELECT brief_id, rev, loaded_at, sha1(concat_ws('|', textsorte, datierung, schlagworte)) AS h FROM briefs WHERE brief_id IS NOT NULL) GROUP BY 1) WHERE h <> old",
}
