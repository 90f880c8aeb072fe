"""The letters as retrieval sees them, and what is derived from them once: labels, abstracts, postings, passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.functions import text as T
from missiva.functions import variants as V
from missiva.operators import letters as L
from missiva.sources.tables import current_letters, latest, table


@dataclass(frozen=True)
class Params:
    """Limits and floors of retrieval; defaults are the published ones."""

    top_k: int = 30
    extra_k: int = 10
    chunk_top_k: int = 20
    chunk_extra_k: int = 10
    chunk_min_score: float = 0.5
    min_score: float = 0.5
    rerank_min: float = 0.3
    rerank_max: int = 80
    context_max: int = 60
    excerpts: int = 8
    excerpt_chars: int = 1_500
    evidence_max: int = 20
    tags_shown: int = 12
    min_form: int = 4
    max_bucket: int = 150
    history_turns: int = 3
    history_chars: int = 700
    chunk_size: int = 800
    chunk_overlap: int = 150
    url: str = "https://archiv.example/brief/"


DEFAULT = Params()


def some(c: Column, default: str) -> Column:
    """Default for null and the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def filled(array: Column) -> Column:
    """The array's elements that aren't null or empty; no array gives an empty one."""
    return F.coalesce(F.filter(array, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def unwrapped(spark: SparkSession, sf_dir: str, p: Params = DEFAULT) -> DataFrame:
    """Raw letters with their envelopes taken off, defaults filled, one row per letter that has a number."""
    rows = current_letters(spark, sf_dir, "short", "sichtbar", "textsorte", "absendeort", "verfasser", "adressat", "datierung", "schlagworte")
    rows = rows.filter(F.coalesce("short", F.lit("")) != "").withColumn("d", V.parse(F.col("datierung")))
    names = lambda c: filled(F.transform(c, lambda x: x["v"]["namemitamt"]["combi"]))
    return rows.select(
        "brief_id",
        F.col("short").alias("id"),
        F.concat(F.lit(p.url), "short").alias("url"),
        some(F.col("sichtbar"), "unbekannt").alias("sichtbar"),
        "textsorte",
        F.substring(V.scalar(V.member(F.col("d"), "iso")), 1, 10).alias("date_iso"),
        V.scalar(V.member(F.col("d"), "schoen")).alias("date_display"),
        names("verfasser").alias("senders"),
        names("adressat").alias("recipients"),
        filled(F.col("absendeort")).alias("places_sent"),
        "schlagworte",
    )


def labels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(ref_id, label, variants) of one reference table: its living row created last; blank labels are left out."""
    rows = table(spark, sf_dir, name)
    variants = F.transform("alternativen", lambda a: a["text"]["v"]) if "alternativen" in rows.columns else F.array().cast("array<string>")
    rows = rows.select(V.normal_id(F.col("ref_id")).alias("ref_id"), "short", "created_at", "deleted_at", variants.alias("variants"))
    rows = rows.filter("ref_id IS NOT NULL AND deleted_at IS NULL AND trim(short) <> ''")
    return latest(rows, ["ref_id"], [F.col("created_at").desc_nulls_last(), "short"]).select("ref_id", "short", filled(F.col("variants")).alias("variants"))


def resolved(letters: DataFrame, spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    """(brief_id, labels, variants): a keyword field's ids replaced by their labels in order, unresolved ones dropped;
    variants are the distinct further labels. Joined on the id, so the dictionary is broadcast only if Spark finds it small."""
    ids = letters.select("brief_id", V.parse(F.col("schlagworte")).alias("s")).select("brief_id", F.posexplode(L.keyword_ids(F.col("s"))[field]).alias("pos", "ref_id"))
    hit = ids.join(labels(spark, sf_dir, L.TARGETS[field]), "ref_id")
    per = hit.groupBy("brief_id").agg(F.sort_array(F.collect_list(F.struct("pos", "short", "variants"))).alias("x"))
    return per.select(
        "brief_id",
        F.transform("x", lambda r: r["short"]).alias("labels"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("x", lambda r: r["variants"])))).alias("variants"),
    )


def abstract(kind: Column, senders: Column, recipients: Column, places: Column, date: Column, subjects: Column, received: Column | None = None) -> Column:
    """One German sentence made of a letter's data, for letters without an editor's abstract; where it was sent from, else
    where it was received."""
    people = F.concat_ws(
        " ",
        some(kind, "Brief"),
        F.when(F.size(senders) > 0, F.concat(F.lit("von "), F.array_join(senders, " und "))),
        F.when(F.size(recipients) > 0, F.concat(F.lit("an "), F.array_join(recipients, " und "))),
    )
    place = F.when(F.size(places) > 0, F.array_join(places, " / "))
    if received is not None:
        place = F.coalesce(place, F.when(F.size(received) > 0, F.concat(F.lit("Zielort "), F.array_join(received, " / "))))
    head = F.concat_ws(", ", people, place, F.nullif(date, F.lit("")))
    themes = F.when(F.size(subjects) > 0, F.concat(F.lit(" Themen: "), F.array_join(subjects, ", "), F.lit("."))).otherwise("")
    return F.concat(head, F.lit("."), themes)


def corpus(spark: SparkSession, sf_dir: str, p: Params = DEFAULT) -> DataFrame:
    """The letters retrieval works on: the last row built for each number, abstracts filled in where there is none."""
    rows = latest(table(spark, sf_dir, "corpus").filter("id IS NOT NULL AND id <> ''"), ["id"], [F.col("built_at").desc_nulls_last()])
    plain = rows.select(
        "id",
        F.concat(F.lit(p.url), "id").alias("url"),
        some(F.col("sichtbar"), "unbekannt").alias("sichtbar"),
        "titel",
        "textsorte",
        F.col("dateiso").alias("date_iso"),
        filled(F.col("senders")).alias("senders"),
        filled(F.col("recipients")).alias("recipients"),
        F.nullif(F.trim("regest"), F.lit("")).alias("editorial"),
        filled(F.col("keywordsubjects")).alias("subjects"),
        F.trim("incipit").alias("incipit"),
    )
    made = abstract(F.col("textsorte"), F.col("senders"), F.col("recipients"), F.array().cast("array<string>"), F.col("date_iso"), F.col("subjects"))
    return plain.withColumn("regest", F.coalesce("editorial", made)).withColumn("synthetic", F.col("editorial").isNull())


def described(letters: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds places_sent and date_display from the raw letters and variants, the further labels of the subjects."""
    raw = latest(unwrapped(spark, sf_dir).select("id", "brief_id", "places_sent", "date_display"), ["id"], [F.col("brief_id").desc()]).drop("brief_id")
    rings = labels(spark, sf_dir, "saches").select(F.col("short").alias("label"), F.explode("variants").alias("variant"))
    tags = letters.select("id", F.explode("subjects").alias("label")).join(rings, "label")
    rings_of = tags.groupBy("id").agg(F.array_sort(F.collect_set("variant")).alias("variants"))
    rows = letters.join(raw, "id", "left").join(rings_of, "id", "left")
    none = F.array().cast("array<string>")
    return rows.withColumns({"places_sent": F.coalesce("places_sent", none), "variants": F.coalesce("variants", none), "date_display": F.coalesce(F.nullif("date_display", F.lit("")), "date_iso")})


def kinds(spark: SparkSession, sf_dir: str, letters: DataFrame) -> DataFrame:
    """letters(brief_id, textsorte): kinds given by the id of a subject record are replaced by its label, others stay; an
    id without a record gives null. A left join on the id."""
    words = labels(spark, sf_dir, "saches").select(F.col("ref_id").alias("kind_id"), F.col("short").alias("kind_label"))
    by_id = F.when(F.col("textsorte").rlike("(?i)^[0-9a-f]{24}$"), F.lower("textsorte"))
    rows = letters.withColumn("kind_id", by_id).join(words, "kind_id", "left")
    return rows.withColumn("textsorte", F.when(F.col("kind_id").isNull(), F.col("textsorte")).otherwise(F.col("kind_label"))).drop("kind_id", "kind_label")


def public(letters: DataFrame) -> DataFrame:
    """Letters that may be served. Strict: only those marked open (the looser reading, all but internal ones, is
    public_or_unknown)."""
    return letters.filter(F.col("sichtbar") == "offen")


def public_or_unknown(letters: DataFrame) -> DataFrame:
    return letters.filter(~F.col("sichtbar").eqNullSafe("intern"))


def fulltexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sichtbar, volltext, erlaeuterung): the last changed row of each id that has either text."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = latest(table(spark, sf_dir, "fulltext").filter("id IS NOT NULL"), ["id"], [F.col("changed_at").desc_nulls_last()])
    rows = rows.select("id", some(F.col("sichtbar"), "unbekannt").alias("sichtbar"), blank("volltext").alias("volltext"), blank("erlaeuterung").alias("erlaeuterung"))
    return rows.filter("volltext IS NOT NULL OR erlaeuterung IS NOT NULL")


def embed_text(titel: Column, subjects: Column, regest: Column, incipit: Column) -> Column:
    """The text a letter is embedded by: labelled lines, those without a value left out."""
    return F.concat_ws(
        "\n",
        titel,
        F.when(F.size(subjects) > 0, F.concat(F.lit("Schlagworte: "), F.array_join(subjects, ", "))),
        regest,
        F.when(incipit != "", F.concat(F.lit("Incipit: "), incipit)),
    )


# --- postings, in long form -------------------------------------------------------------------------------------------


def subject_postings(letters: DataFrame, variants: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """(form, id), distinct: forms of the subjects of each letter; variants(label, variant) add further labels."""
    tags = letters.select("id", F.explode("subjects").alias("label"))
    if variants is not None:
        tags = tags.unionByName(tags.join(variants, "label").select("id", F.col("variant").alias("label")))
    return tags.select(F.explode(T.subject_forms(F.col("label"), p.min_form)).alias("form"), "id").distinct()


def person_postings(letters: DataFrame, side: str, p: Params = DEFAULT) -> DataFrame:
    """(form, id), distinct, of senders or recipients."""
    names = letters.select("id", F.explode(side).alias("name"))
    return names.select(F.explode(T.person_forms(F.col("name"), p.min_form)).alias("form"), "id").distinct()


def stem_texts(letters: DataFrame, comments: DataFrame) -> DataFrame:
    """(id, stems, stem_text): stems of the editor's abstract and of the commentary; in stem_text they stand apart by two
    spaces, so that no phrase crosses from one to the other. Made-up abstracts aren't searched."""
    parts = letters.join(comments.select("id", "erlaeuterung"), "id", "left").select("id", *(T.stems(F.col(c)).alias(c) for c in ("editorial", "erlaeuterung")))
    padded = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))).otherwise("")
    none = F.array().cast("array<string>")
    both = F.concat(*(F.coalesce(c, none) for c in ("editorial", "erlaeuterung")))
    return parts.filter("editorial IS NOT NULL OR erlaeuterung IS NOT NULL").select(
        "id", both.alias("stems"), F.concat(padded("editorial"), padded("erlaeuterung")).alias("stem_text")
    )


def stem_postings(texts: DataFrame) -> DataFrame:
    """(stem, id), distinct, of stems of three letters or more."""
    return texts.select(F.explode(F.array_distinct("stems")).alias("stem"), "id").filter(F.length("stem") >= 3)


# --- passages ---------------------------------------------------------------------------------------------------------


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows of at most size signs over the text with single spaces; each ends at the last space in its second half,
    if there is one, and the next begins overlap signs before that end."""
    text = " ".join(text.split())
    if not text:
        return []
    out, start = [], 0
    while True:
        stop = min(start + size, len(text))
        if stop < len(text):
            space = text.rfind(" ", 0, stop + 1)
            if space > start + size // 2:
                stop = space
        out.append(text[start:stop].strip())
        if stop >= len(text):
            return out
        start = max(stop - overlap, start + 1)


def chunks(texts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(chunkid, letterid, kind, seq, text) of texts(id, sichtbar, volltext, erlaeuterung), open ones only."""
    long = public(texts).unpivot("id", ["volltext", "erlaeuterung"], "kind", "text").filter("text IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (f"{i}__{k}__{n:03d}", i, k, n, w)
                for i, k, t in b.itertuples(index=False)
                for n, w in enumerate(windows(t, p.chunk_size, p.chunk_overlap))
            ]
            yield pd.DataFrame(rows, columns=["chunkid", "letterid", "kind", "seq", "text"])

    return long.mapInPandas(run, "chunkid string, letterid string, kind string, seq int, text string")
