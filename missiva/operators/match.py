"""Deterministic matching of a batch of questions against the postings. Every result is keyed by question (qid).

Containment of a form in a question is an equi-join: the question's word runs are spelled out and joined on the form.
Only the few candidates of one question are compared with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missiva.functions import text as T
from missiva.operators.archive import DEFAULT, Params


def features(questions: DataFrame, years: str = r"1[4-6]\d\d") -> DataFrame:
    """questions(qid, text): adds normal, stemmed, terms, years, ids and the gate for statistics."""
    return questions.select(
        "*",
        T.normalize(F.col("text")).alias("normal"),
        T.stem_phrase(F.col("text")).alias("stemmed"),
        T.search_terms(F.col("text")).alias("terms"),
        T.year_refs(F.col("text"), years).alias("years"),
        T.id_refs(F.col("text")).alias("ids"),
        T.asks_statistic(F.col("text")).alias("statistic"),
    )


def _longest(forms: DataFrame) -> int:
    """Words of the longest form: one number."""
    return forms.agg(F.max(F.size(F.split("form", " ")))).first()[0] or 1


def _contained(questions: DataFrame, forms: DataFrame, columns: list[str]) -> DataFrame:
    """(qid, form): forms that stand as whole words in one of the columns."""
    most = _longest(forms)
    runs = F.array_union(*(T.ngrams(T.words(F.col(c)), most) for c in columns)) if len(columns) > 1 else T.ngrams(T.words(F.col(columns[0])), most)
    return questions.select("qid", F.explode(runs).alias("form")).join(forms, "form", "left_semi").select("qid", "form").distinct()


def _containing(questions: DataFrame, forms: DataFrame, least: int) -> DataFrame:
    """(qid, form): forms that hold the whole question, of least signs or more, as whole words."""
    short = questions.filter(F.length("normal") >= least).select("qid", "normal")
    # Only runs of forms as long as some question can be equal to it; a question longer than all forms has none.
    most = min(_longest(forms), short.agg(F.max(F.size(F.split("normal", " ")))).first()[0] or 1)
    runs = forms.select("form", F.explode(T.ngrams(T.words(F.col("form")), most)).alias("normal"))
    return runs.join(short, "normal").select("qid", "form").distinct()


def _specific(cands: DataFrame) -> DataFrame:
    """Candidates that no longer candidate of the same question holds as whole words."""
    other = cands.select(F.col("qid").alias("o_qid"), F.col("form").alias("o_form"))
    held = (F.col("qid") == F.col("o_qid")) & (F.col("form") != F.col("o_form")) & T.whole(F.col("o_form"), F.col("form"))
    return cands.join(other, held, "left_anti")


def subject_candidates(questions: DataFrame, postings: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(qid, form, letters, kept): surviving forms with the number of letters they reach; kept unless that is generic."""
    forms = postings.select("form").distinct()
    cands = _contained(questions, forms, ["normal", "stemmed"]).unionByName(_containing(questions, forms, p.min_form)).distinct()
    sizes = postings.groupBy("form").agg(F.count("*").alias("letters"))
    return _specific(cands).join(sizes, "form").select("qid", "form", "letters", (F.col("letters") <= p.max_bucket).alias("kept"))


def subjects(questions: DataFrame, postings: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(qid, id, matches): letters of the kept forms with the number of distinct forms they carry."""
    kept = subject_candidates(questions, postings, p).filter("kept").select("qid", "form")
    return kept.join(postings, "form").groupBy("qid", "id").agg(F.count("*").alias("matches"))


def persons(questions: DataFrame, senders: DataFrame, recipients: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(qid, id, exact): with forms on both sides the letters on both, else letters of multi-word forms that aren't
    generic. exact where both sides were named and a letter was found."""
    sides = {}
    for name, postings in (("s", senders), ("r", recipients)):
        sides[name] = _specific(_contained(questions, postings.select("form").distinct(), ["normal"])).withColumn("side", F.lit(name))
    named = sides["s"].unionByName(sides["r"])
    both = named.groupBy("qid").agg(F.count_distinct("side").alias("n"))
    two, one = both.filter("n = 2").select("qid"), both.filter("n = 1").select("qid")
    reach = lambda name, postings: sides[name].join(two, "qid", "left_semi").join(postings, "form").select("qid", "id").distinct()
    exact = reach("s", senders).join(reach("r", recipients), ["qid", "id"], "left_semi").withColumn("exact", F.lit(True))
    every = senders.withColumn("side", F.lit("s")).unionByName(recipients.withColumn("side", F.lit("r")))
    sizes = every.groupBy("side", "form").agg(F.count("*").alias("letters"))
    single = named.join(one, "qid", "left_semi").filter(F.col("form").contains(" ")).join(sizes, ["side", "form"])
    single = single.filter(F.col("letters") <= p.max_bucket).join(every, ["side", "form"]).select("qid", "id").distinct()
    return exact.unionByName(single.withColumn("exact", F.lit(False)))


def years(questions: DataFrame, letters: DataFrame) -> DataFrame:
    """(qid, id) of letters of the years a question asks for."""
    dated = letters.select(F.substring("date_iso", 1, 4).alias("year"), "id")
    return questions.select("qid", F.explode("years").alias("year")).join(dated, "year").select("qid", "id").distinct()


def ids(questions: DataFrame, letters: DataFrame) -> DataFrame:
    """(qid, id) of the letters a question names by number."""
    return questions.select("qid", F.explode("ids").alias("id")).join(letters.select("id"), "id").select("qid", "id").distinct()


def texts(questions: DataFrame, postings: DataFrame, stem_text: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(qid, id) of letters whose searched text holds all terms of a question: one term also as the beginning of a word at
    most twelve longer; several as one phrase in order. A result that is generic is dropped whole."""
    asked = questions.filter(F.size("terms") > 0).select("qid", "terms", F.size("terms").alias("n"))
    term = asked.select("qid", "n", F.explode("terms").alias("term"))
    # A term meets the stems it begins by equality with their beginnings, each cut at every length from four.
    begin = postings.select("stem").distinct().select(
        "stem",
        F.explode(
            F.array_distinct(
                F.concat(
                    F.array("stem"),
                    F.transform(
                        F.sequence(F.greatest(F.lit(4), F.length("stem") - 12), F.greatest(F.lit(4), F.length("stem"))),
                        lambda k: F.substring("stem", F.lit(1), k),
                    ),
                )
            )
        ).alias("term"),
    ).filter(F.length("term") <= F.length("stem"))
    hit = term.join(begin, "term").select("qid", "n", "term", "stem").join(postings, "stem")
    every = hit.groupBy("qid", "n", "id").agg(F.count_distinct("term").alias("k")).filter("k = n").select("qid", "n", "id")
    phrase = asked.filter("n > 1").select("qid", F.concat(F.lit(" "), F.array_join("terms", " "), F.lit(" ")).alias("phrase"))
    held = every.filter("n > 1").join(stem_text.select("id", "stem_text"), "id").join(phrase, "qid").filter(F.contains("stem_text", "phrase"))
    found = every.filter("n = 1").select("qid", "id").unionByName(held.select("qid", "id"))
    generic = found.groupBy("qid").agg(F.count("*").alias("c")).filter(F.col("c") > p.max_bucket).select("qid")
    return found.join(generic, "qid", "left_anti")


def gates(questions: DataFrame, letters: DataFrame, found_persons: DataFrame, found_years: DataFrame, found_ids: DataFrame) -> DataFrame:
    """(qid, closed, lookup, structured): closed for statistics and for numbers of which none exists; lookup if a number
    was found; structured if the answer is a closed set (both correspondents, years or numbers)."""
    hit = found_ids.select("qid").distinct().withColumn("by_id", F.lit(True))
    year = found_years.select("qid").distinct().withColumn("by_year", F.lit(True))
    pair = found_persons.filter("exact").select("qid").distinct().withColumn("by_pair", F.lit(True))
    g = questions.select("qid", "statistic", (F.size("ids") > 0).alias("numbered"))
    for d in (hit, year, pair):
        g = g.join(d, "qid", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return g.select(
        "qid",
        (F.col("statistic") | (F.col("numbered") & ~yes("by_id"))).alias("closed"),
        (F.col("numbered") & yes("by_id")).alias("lookup"),
        (yes("by_id") | (~(F.col("numbered") & yes("by_id")) & (yes("by_year") | yes("by_pair")))).alias("structured"),
    )


def first_by_score(hits: DataFrame, key: str, ties: str) -> DataFrame:
    """Of rows with one key in a question only the best scored."""
    w = Window.partitionBy("qid", key).orderBy(F.col("score").desc(), ties)
    return hits.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
