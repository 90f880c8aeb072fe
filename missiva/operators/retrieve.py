"""Fusion of all paths into one ranked list per question; reranking, context blocks and guards over it."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missiva.functions import text as T
from missiva.operators import match as M
from missiva.operators import vectors as X
from missiva.operators.archive import DEFAULT, Params
from missiva.sources.tables import cut, cut_all, numbered


@dataclass
class Index:
    """What retrieval reads: letters, postings, searched texts, vectors and texts of letters and passages."""

    letters: DataFrame
    subjects: DataFrame
    senders: DataFrame
    recipients: DataFrame
    stem_text: DataFrame
    stems: DataFrame
    vectors: DataFrame
    chunk_vectors: DataFrame
    passages: DataFrame
    texts: DataFrame


def best_chunks(index: Index, questions: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(qid, id, chunk_score, chunkid, kind): of the best passages of all, the best of each public letter."""
    best = X.best(index.chunk_vectors.withColumnRenamed("letterid", "id"), questions, ["id", "chunkid", "kind"], p.chunk_top_k, "chunkid")
    w = Window.partitionBy("qid", "id").orderBy(F.col("score").desc(), "chunkid")
    one = best.join(index.letters.select("id"), "id").withColumn("r", F.row_number().over(w)).filter("r = 1")
    return one.select("qid", "id", F.col("score").alias("chunk_score"), "chunkid", "kind")


@dataclass
class Fused:
    """Hits of a batch of questions, and what was decided on the way to them."""

    hits: DataFrame
    gates: DataFrame
    counts: DataFrame


def fuse(index: Index, questions: DataFrame, chunk_questions: DataFrame, p: Params = DEFAULT) -> Fused:
    """questions(qid, text, vector), chunk_questions(qid, vector). hits: (qid, id, rank, keyword, specificity, score,
    chunkid, chunk_kind, reasons); gates: (qid, closed, lookup, structured); counts: (qid, matches, keyword_matches,
    chunk_matches, below_floor).

    Keyword evidence (subject, person, year, number, text) first, then what is similar enough; within it the more
    specific, then the higher score. A letter without a vector has similarity 0. Everything is keyed by (qid, id), so
    the paths meet in one aggregation. Vectors hand on the top_k best of each question; other similarities are computed
    for the letters with evidence only. Ranks are counted over all tasks, as a year may hold a share of all letters."""
    q = cut(M.features(questions))
    found_ids = cut(M.ids(q, index.letters))
    plain = q.join(found_ids.select("qid").distinct(), "qid", "left_anti")  # a number named turns the other matchers off
    vectors = index.vectors.join(index.letters.select("id"), "id")
    found = cut_all(
        {
            "subject": lambda: M.subjects(plain, index.subjects, p),
            "person": lambda: M.persons(plain, index.senders, index.recipients, p),
            "year": lambda: M.years(plain, index.letters),
            "text": lambda: M.texts(plain, index.stems, index.stem_text, p),
            "scores": lambda: X.best(vectors, questions, ["id"], p.top_k, "id"),
            "chunk": lambda: best_chunks(index, chunk_questions, p),
        }
    )
    scores, chunk = found.pop("scores"), found.pop("chunk")
    found["number"] = found_ids
    gates = cut(M.gates(q, index.letters, found["person"], found["year"], found_ids))
    open_q = q.join(gates.filter("NOT closed"), "qid")
    loose = open_q.filter("NOT structured")
    found["text"] = found["text"].join(loose.select("qid"), "qid", "left_semi")
    path = lambda name, order, weight, extra=None: found[name].select(
        "qid", "id", F.lit(order).alias("ord"), (weight if extra is None else extra).cast("int").alias("weight")
    )
    evidence = (
        path("subject", 1, F.lit(0), F.col("matches") * 2)
        .unionByName(path("person", 2, F.lit(2)))
        .unionByName(path("year", 3, F.lit(0)))
        .unionByName(path("number", 4, F.lit(100)))
        .unionByName(path("text", 5, F.lit(1)))
    )
    evidence = evidence.join(open_q.select("qid"), "qid", "left_semi")
    keyword = cut(evidence.groupBy("qid", "id").agg(F.sum("weight").alias("specificity"), F.sort_array(F.collect_set("ord")).alias("paths")))
    any_keyword = keyword.select("qid").distinct().withColumn("any", F.lit(True))

    wanted = open_q.join(any_keyword, "qid", "left").select(
        "qid", F.when(F.col("structured"), 0).when(F.col("any"), p.extra_k).otherwise(p.top_k).alias("k"), "structured"
    )
    near = scores.join(wanted, "qid").filter(F.col("rank") <= F.col("k")).select("qid", "id", F.col("score").alias("near"))
    order = Window.partitionBy("qid").orderBy(F.col("chunk_score").desc(), "chunkid")
    by_chunk = (
        chunk.join(wanted.filter("NOT structured"), "qid")
        .filter(F.col("chunk_score") >= p.chunk_min_score)
        .withColumn("r", F.row_number().over(order))
        .filter(F.col("r") <= p.chunk_extra_k)
        .select("qid", "id", F.lit(True).alias("by_chunk"))
    )
    every = keyword.join(near, ["qid", "id"], "full").join(by_chunk, ["qid", "id"], "full")
    every = cut(every.join(chunk, ["qid", "id"], "left"))
    others = X.pair_scores(every.filter("near IS NULL"), vectors, questions, "id")
    every = every.join(others, ["qid", "id"], "left")
    is_keyword = F.col("paths").isNotNull()
    cosine = F.coalesce("near", "score", F.lit(0.0))
    kept = is_keyword | F.coalesce("by_chunk", F.lit(False)) | (cosine >= p.min_score)
    counts = every.groupBy("qid").agg(
        F.count_if(kept).alias("matches"), F.count_if(is_keyword).alias("keyword_matches"), F.count_if("by_chunk").alias("chunk_matches"), F.count_if(~kept).alias("below_floor")
    )
    words = {1: "Schlagwort", 2: "Person", 3: "Jahr", 4: "Nummer", 5: "Text"}
    names = F.transform("paths", lambda o: F.element_at(F.array(*(F.lit(w) for w in words.values())), o))
    reasons = F.when(is_keyword, F.array_join(names, ", ")).when(F.col("by_chunk"), F.concat(F.lit("Passage "), "kind")).otherwise("Embedding")
    rows = every.filter(kept).select(
        "qid",
        "id",
        is_keyword.alias("keyword"),
        F.coalesce("specificity", F.lit(0)).cast("int").alias("specificity"),
        F.greatest(cosine, "chunk_score").alias("score"),
        cosine.alias("cosine"),
        "chunkid",
        F.col("kind").alias("chunk_kind"),
        reasons.alias("reasons"),
    )
    by_evidence = [F.col("keyword").desc(), F.col("specificity").desc(), F.col("score").desc(), F.col("cosine").desc(), F.col("id")]
    return Fused(numbered(rows, ["qid"], by_evidence, "rank").drop("cosine"), gates, counts)


def overlap_scorer(question: Column, text: Column) -> Column:
    """Offline stand-in for a pair model: share of the question's stems that the text has."""
    asked = F.array_distinct(T.stems(question))
    return F.round(F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, T.stems(text))) / F.size(asked)).otherwise(0.0), 6)


def reachable(url: str, timeout: float = 2.0) -> bool:
    """Whether an optional service answers its health request in time."""
    try:
        with urllib.request.urlopen(f"{url}/health", timeout=timeout) as response:
            return response.status == 200
    except OSError:
        return False


def service_scorer(url: str, timeout: float = 20.0) -> Callable[[Column, Column], Column] | None:
    """A pair model behind HTTP as a scorer, none if it isn't reachable. Pairs go out in the batches they come in, those of one
    question together; a batch that fails gives no scores, so its hits stay as they are."""
    if not reachable(url):
        return None

    @F.pandas_udf("double")
    def score(questions: pd.Series, texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), index=texts.index, dtype="float64")
        for question, rows in texts.groupby(questions):
            body = json.dumps({"query": question, "docs": [{"id": str(i), "text": t or ""} for i, t in rows.items()]}).encode()
            request = urllib.request.Request(f"{url}/rerank", body, {"Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(request, timeout=timeout) as response:
                    got = {s["id"]: s["score"] for s in json.load(response)["scores"]}
            except (OSError, ValueError, KeyError):
                continue
            for i in rows.index:
                out[i] = got.get(str(i))
        return out

    return score


def rerank(
    hits: DataFrame, questions: DataFrame, letters: DataFrame, passages: DataFrame, scorer: Callable[[Column, Column], Column] | None = overlap_scorer, p: Params = DEFAULT
) -> DataFrame:
    """Rescores the hits without keyword evidence, at most rerank_max of each question, by titel, regest and the passage
    that matched; drops those under rerank_min and puts the rest behind the others by the new score, one the scorer gave no
    score for as if it were 0. No scorer (the service is off, or failed) leaves hits and order as they are. Adds rerank and
    rank. What is beyond rerank_max vanishes, as published."""
    if scorer is None:
        return hits.withColumn("rerank", F.lit(None).cast("double"))
    sure, extra = hits.filter("keyword"), hits.filter("NOT keyword")
    nth = Window.partitionBy("qid").orderBy("rank")
    extra = extra.withColumn("n", F.row_number().over(nth)).filter(F.col("n") <= p.rerank_max).drop("n")
    text = F.substring(F.concat_ws("\n", *(F.nullif(c, F.lit("")) for c in ("titel", "regest", "passage"))), 1, 1500)
    asked = (
        extra.select("qid", "id", "chunkid")
        .join(questions.select("qid", F.col("text").alias("question")), "qid")
        .join(letters.select("id", "titel", "regest"), "id", "left")
        .join(passages.select("chunkid", F.col("text").alias("passage")), "chunkid", "left")
    )
    scores = asked.select("qid", "id", scorer(F.col("question"), text).alias("rerank"))
    scored = extra.join(scores, ["qid", "id"], "left").filter(F.col("rerank").isNull() | (F.col("rerank") >= p.rerank_min))
    both = sure.withColumn("rerank", F.lit(None).cast("double")).unionByName(scored.select(*hits.columns, "rerank"))
    order = [F.col("keyword").desc(), F.when(F.col("keyword"), 0.0).otherwise(F.coalesce("rerank", F.lit(0.0))).desc(), F.col("old")]
    return numbered(both.withColumnRenamed("rank", "old"), ["qid"], order, "rank").drop("old")


def context(hits: DataFrame, index: Index, matched: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(qid, rank, id, block): the text block a model would get for each of the first context_max hits: who, where and
    when, why it was found, tags and variants that match the question first and apart, the passage that matched, else for
    the first `excerpts` hits the beginning of the transcription, and for these the commentary.
    matched(qid, form): forms of the question that survived."""
    forms = matched.groupBy("qid").agg(F.collect_set("form").alias("forms"))
    rows = hits.filter(F.col("rank") <= p.context_max).join(index.letters, "id").join(forms, "qid", "left")
    rows = rows.join(index.passages.select("chunkid", F.col("text").alias("passage")), "chunkid", "left").join(index.texts.drop("sichtbar"), "id", "left")
    forms_of = F.coalesce("forms", F.array().cast("array<string>"))
    fits = lambda c: F.filter(c, lambda t: F.arrays_overlap(T.subject_forms(t, p.min_form), forms_of))
    rows = rows.withColumn("hit_tags", F.concat(fits("subjects"), fits("variants")))
    rows = rows.withColumn("other_tags", F.filter("subjects", lambda t: ~F.array_contains("hit_tags", t)))
    listed = lambda c, word: F.when(F.size(c) > 0, F.concat(F.lit(word), F.array_join(c, ", ")))
    who = F.concat_ws(
        " | ",
        listed("senders", "Von: "),
        listed("recipients", "An: "),
        F.when(F.col("date_display") != "", F.concat(F.lit("Datum: "), "date_display")),
        listed("places_sent", "Absendeort: "),
    )
    more = F.size("other_tags") - p.tags_shown
    others = F.concat(
        F.when(F.size("hit_tags") > 0, "Weitere Schlagworte: ").otherwise("Schlagworte: "),
        F.array_join(F.slice("other_tags", 1, p.tags_shown), "; "),
        F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(")"))).otherwise(""),
    )
    first = F.col("rank") <= p.excerpts
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Brief "), "id", F.lit(" ("), "url", F.lit(")")),
        F.nullif(who, F.lit("")),
        F.concat(F.lit("Treffer: "), "reasons"),
        F.when(F.size("hit_tags") > 0, F.concat(F.lit("Treffer-Schlagwort: "), F.array_join("hit_tags", "; "))),
        F.when(F.size("other_tags") > 0, others),
        F.when(F.col("incipit") != "", F.concat(F.lit('Incipit: "'), "incipit", F.lit('"'))),
        "regest",
        F.when(F.col("synthetic"), "(Automatisch erzeugt)"),
        F.when(F.col("passage").isNotNull(), F.concat(F.when(F.col("chunk_kind") == "volltext", "Transkription (Passage): ").otherwise("Erläuterung (Passage): "), "passage")).when(
            first & F.col("volltext").isNotNull(), F.concat(F.lit("Transkription (Auszug): "), F.substring("volltext", 1, p.excerpt_chars))
        ),
        F.when(first & F.col("erlaeuterung").isNotNull(), F.concat(F.lit("Erläuterung: "), "erlaeuterung")),
    )
    return rows.select("qid", "rank", "id", block.alias("block"))


def _sources(hits: DataFrame, index: Index, p: Params) -> DataFrame:
    rows = hits.join(index.letters, "id").join(index.passages.select("chunkid", F.col("text").alias("passage")), "chunkid", "left")
    short = lambda c: F.round(c, 3)
    return rows.withColumn("score", short("score")).withColumn("rerank", short("rerank")).withColumn("in_context", F.col("rank") <= p.context_max)


def response_chat(hits: DataFrame, index: Index, p: Params = DEFAULT) -> DataFrame:
    """The rows an answer is shown with, in rank order per question: all columns of a source and whether the model saw it.
    hits with the column rerank (see rerank)."""
    rows = _sources(hits, index, p).join(index.texts.select("id", F.col("volltext").isNotNull().alias("full")), "id", "left")
    return rows.select(
        "qid", "rank", "id", "url", "score", "rerank", "reasons", F.col("chunk_kind").alias("passage_kind"), "passage", "titel", "date_display", "senders", "recipients", "regest",
        F.col("synthetic").alias("regest_synthetic"), "sichtbar", (~F.col("synthetic")).alias("has_regest"), F.coalesce("full", F.lit(False)).alias("has_full_text"), "in_context",
    )


def response_retrieve(hits: DataFrame, index: Index, p: Params = DEFAULT) -> DataFrame:
    """The short form: (qid, rank) and the six columns of a source for measuring."""
    return _sources(hits, index, p).select("qid", "rank", "id", "score", "rerank", "reasons", F.col("chunk_kind").alias("passage"), "sichtbar")


def cited_and_extra(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the model saw, and further candidates that stand apart."""
    return sources.filter("in_context"), sources.filter("NOT in_context")


def embedding_only(sources: DataFrame) -> DataFrame:
    """Sources all of whose reasons are similarity, and that have a rerank score; the rest isn't used for calibration."""
    fuzzy = F.forall(F.split("reasons", ", "), lambda r: (r == "Embedding") | r.startswith("Passage "))
    return sources.filter(fuzzy & F.col("rerank").isNotNull())


def prompt(blocks: DataFrame) -> DataFrame:
    """(qid, context): the blocks of each question in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"])
    return blocks.groupBy("qid").agg(F.array_join(ordered, "\n\n").alias("context"))


def history(turns: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """turns(conv, turn, role, content): valid, non-blank ones, the last 2 x history_turns of each conversation, cut."""
    valid = turns.filter(F.col("role").isin("user", "assistant") & (F.trim("content") != ""))
    w = Window.partitionBy("conv").orderBy(F.col("turn").desc())
    last = valid.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= 2 * p.history_turns)
    return last.select("conv", "turn", "role", F.substring(F.trim("content"), 1, p.history_chars).alias("content"))


def transcript(turns: DataFrame) -> DataFrame:
    line = F.concat(F.when(F.col("role") == "assistant", "Antwort: ").otherwise("Frage: "), "content")
    rows = turns.select("conv", F.struct("turn", line.alias("line")).alias("x")).groupBy("conv").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return rows.select("conv", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("transcript"))


def citation_guard(answers: DataFrame) -> DataFrame:
    """answers(aid, answer, sources array<string>): adds cited, invented (cited, not a source) and retry."""
    cited = T.cited_ids(F.col("answer"))
    return answers.select("aid", cited.alias("cited"), F.array_except(cited, "sources").alias("invented")).withColumn("retry", F.size("invented") > 0)


def refusal_guard(answers: DataFrame) -> DataFrame:
    """answers(aid, answer, sources): retry where an answer refuses although there are sources."""
    opens = T.opens_with_refusal(F.col("answer"))
    return answers.select("aid", opens.alias("opens_with_refusal"), T.looks_like_refusal(F.col("answer")).alias("refuses"), (opens & (F.size("sources") > 0)).alias("retry"))
