"""Gold sets from curated data and the measures of retrieval against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missiva.functions import text as T
from missiva.sources.tables import cut, numbered


def by_visibility(letters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, nr, id): the letters of each gold set, distinct, open ones and all others apart, numbered in numeric
    order. A row for each letter, since a set may hold any share of the archive."""
    side = F.when(F.col("sichtbar") == "offen", "offen").otherwise("intern").alias("side")
    rows = letters.select(*keys, side, "id", F.col("id").try_cast("bigint").alias("n")).distinct()
    return numbered(rows, [*keys, "side"], [F.col("n").asc_nulls_last(), F.col("id")], "nr").select(*keys, "side", "nr", "id")


def tag_counts(letters: DataFrame, least: int = 3, most: int = 60, label: int = 5) -> DataFrame:
    """(tag, n): occurrences of each subject among open letters, in a range of sizes; short labels are left out."""
    tags = letters.filter("sichtbar = 'offen'").select(F.explode("subjects").alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).filter(F.col("n").between(least, most) & (F.length("tag") >= label))


def pair_counts(letters: DataFrame, least: int = 3) -> DataFrame:
    """(sender, recipient, n) of first sender and first recipient of open letters."""
    ends = letters.filter("sichtbar = 'offen'").select(F.get("senders", F.lit(0)).alias("sender"), F.get("recipients", F.lit(0)).alias("recipient"))
    return ends.filter("sender <> '' AND recipient <> ''").groupBy("sender", "recipient").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def sampled(pool: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows of the pool, the same whatever the order it is read in."""
    return pool.orderBy(F.md5(F.concat(F.col(key), F.lit(seed))), key).limit(n)


def spelled(letters: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sender, recipient, id): letters of a pair under any spelling of either name. Both names are matched at once: matched
    on one name, a sender of a tenth of the letters would bring each of them to each of its pairs."""
    forms = pairs.select("sender", "recipient", F.explode(T.name_spellings(F.col("sender"))).alias("s_name"))
    forms = forms.select("*", F.explode(T.name_spellings(F.col("recipient"))).alias("r_name"))
    named = letters.select("id", "recipients", F.explode(F.array_distinct("senders")).alias("s_name"))
    named = named.select("id", "s_name", F.explode(F.array_distinct("recipients")).alias("r_name"))
    return named.join(forms, ["s_name", "r_name"]).select("sender", "recipient", "id").distinct()


def tagged_split(letters: DataFrame, terms: dict[str, str]) -> DataFrame:
    """terms, a stated list of term and regular expression: (term, id, tagged): open letters whose text matches, whatever
    the case, and whether the label of one of their tags matches too. One pass over the letters, no join."""

    def found(term: str, rx: str) -> Column:
        hit = lambda c: c.rlike(f"(?iu){rx}")
        return F.when(hit(F.col("regest")), F.struct(F.lit(term).alias("term"), F.exists("subjects", hit).alias("tagged")))

    each = F.array(*(found(t, rx) for t, rx in terms.items()))
    rows = letters.filter("sichtbar = 'offen'").select("id", F.explode(F.array_compact(each)).alias("x"))
    return rows.select("x.term", "id", "x.tagged")


def untagged_recall(hits: DataFrame, split: DataFrame) -> DataFrame:
    """hits(qid, id), split(qid, id, tagged): (qid, untagged, untagged_recall): share of the gold letters without the tag
    that were found; null where there is none."""
    both = split.join(hits.select("qid", "id").distinct().withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    n = F.count_if(~F.col("tagged"))
    share = F.when(n > 0, F.round(F.count_if(~F.col("tagged") & F.col("hit").isNotNull()) / n, 6))
    return both.groupBy("qid").agg(n.alias("untagged"), share.alias("untagged_recall"))


def recall_precision(hits: DataFrame, gold: DataFrame, keys: str = "qid") -> DataFrame:
    """hits(qid, id), gold(qid, id): (qid, n_hits, n_gold, recall, precision), 0 where a denominator is."""
    both = hits.withColumn("h", F.lit(1)).join(gold.withColumn("g", F.lit(1)), [keys, "id"], "full").groupBy(keys)
    counts = both.agg(
        F.coalesce(F.sum("h"), F.lit(0)).alias("n_hits"), F.coalesce(F.sum("g"), F.lit(0)).alias("n_gold"), F.count_if(F.col("h").isNotNull() & F.col("g").isNotNull()).alias("both")
    )
    share = lambda n: F.round(F.when(F.col(n) > 0, F.col("both") / F.col(n)).otherwise(0.0), 6)
    return counts.select(keys, "n_hits", "n_gold", share("n_gold").alias("recall"), share("n_hits").alias("precision"))


def worst(measures: DataFrame, n: int = 5) -> DataFrame:
    return measures.orderBy("recall", "qid").limit(n)


def leaks(hits: DataFrame, letters: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """Hits that aren't open, by their mark or because a gold set has them among its closed ones (forbidden(id)); has to be
    empty."""
    closed = letters.filter("sichtbar <> 'offen'").select("id")
    if forbidden is not None:
        closed = closed.unionByName(forbidden.select("id")).distinct()
    return hits.join(closed, "id", "left_semi").select("qid", "id")


def baseline_diff(run: DataFrame, base: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """(qid, d_recall, d_precision, verdict) of questions in both runs."""
    b = base.select("qid", F.col("recall").alias("b_recall"), F.col("precision").alias("b_precision"))
    d = run.join(b, "qid").select("qid", F.round(F.col("recall") - F.col("b_recall"), 6).alias("d_recall"), F.round(F.col("precision") - F.col("b_precision"), 6).alias("d_precision"))
    verdict = F.when(F.least("d_recall", "d_precision") < -tolerance, "worse").when(F.greatest("d_recall", "d_precision") > tolerance, "better").otherwise("same")
    return d.withColumn("verdict", verdict)


def floor_quantile(rows: DataFrame, value: str, keys: list[str], shares: list[float]) -> DataFrame:
    """(keys, share, value): the element at floor((n - 1) x share) of the sorted values, without interpolation. Equal values
    are counted first, then places are summed up over ranges of values, so that no group is sorted by one task."""
    counted = cut(rows.groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("c")))
    sorted_ = cut(counted.repartitionByRange(*keys, "value").withColumn("part", F.spark_partition_id()))
    sizes = sorted_.groupBy(*keys, "part").agg(F.sum("c").alias("s"))
    whole = Window.partitionBy(*keys)
    starts = sizes.select(*keys, "part", (F.sum("s").over(whole.orderBy("part")) - F.col("s")).alias("start"), F.sum("s").over(whole).alias("n"))
    upto = F.sum("c").over(Window.partitionBy(*keys, "part").orderBy("value"))
    placed = sorted_.join(starts, [*keys, "part"]).withColumn("end", F.col("start") + upto)
    wanted = F.array(*(F.struct(F.lit(s).alias("share"), F.floor((F.col("n") - 1) * s).alias("k")) for s in shares))
    at = placed.select(*keys, "value", "c", "end", F.explode(wanted).alias("q")).filter("q.k < end AND q.k >= end - c")
    return at.select(*keys, "q.share", "value")


def threshold_sweep(rows: DataFrame, value: str, keys: list[str], thresholds: list[float]) -> DataFrame:
    """(keys, threshold, n): how many values reach each threshold; one pass, whatever the thresholds."""
    counts = rows.groupBy(*keys).agg(*(F.count_if(F.col(value) >= t).alias(f"t{i}") for i, t in enumerate(thresholds)))
    each = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("n")) for i, t in enumerate(thresholds)))
    return counts.select(*keys, F.explode(each).alias("x")).select(*keys, "x.threshold", "x.n")


def stability(outcomes: DataFrame) -> DataFrame:
    """outcomes(qid, run, outcome): questions whose outcome isn't the same in all runs."""
    return outcomes.groupBy("qid").agg(F.count_distinct("outcome").alias("outcomes")).filter("outcomes > 1")


def citation_recall(shown_gold: DataFrame, cited: DataFrame) -> DataFrame:
    """shown_gold(qid, id) gold letters that were shown, cited(qid, id) letters an answer cites: share of the shown that
    are cited, and whether nothing was cited although gold was shown."""
    both = shown_gold.join(cited.distinct().withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    n = F.count("hit")
    return both.groupBy("qid").agg(F.count("*").alias("shown_gold"), F.round(n / F.count("*"), 6).alias("citation_recall"), (n == 0).alias("false_refusal"))


def percent(share: Column) -> Column:
    """A share as a text with one decimal."""
    return F.when(share.isNotNull(), F.format_string("%.1f%%", 100 * share))


def checked_answers(rows: DataFrame) -> DataFrame:
    """rows(qid, lang, answer, sources array, in_context int, gold array, must array, exempt array, expect_refusal, payload):
    what is measured of each answer. Citations that aren't sources are echoed if their number stands anywhere in the
    payload the sources came with, else invented. Recall counts the gold letters the model saw; it is null where it saw
    none. A refusal is false if gold was seen and none cited."""
    cited = T.strict_cited_ids(F.col("answer"))
    seen = F.slice("sources", 1, F.greatest("in_context", F.lit(0)))
    unsourced = F.array_except(F.array_except("cited", "sources"), "exempt")
    base = rows.withColumn("cited", cited).withColumns({"gold_seen": F.array_intersect("gold", seen), "must_seen": F.array_intersect("must", seen), "unsourced": unsourced})
    echoed = F.filter("unsourced", lambda i: F.contains("payload", i))
    n_gold, n_must = F.size("gold_seen"), F.size("must_seen")
    gold_cited, must_cited = F.size(F.array_intersect("gold_seen", "cited")), F.size(F.array_intersect("must_seen", "cited"))
    refuses = T.looks_like_refusal(F.col("answer"))
    return base.select(
        "qid",
        T.detect_lang(F.col("answer")).alias("answer_lang"),
        (T.detect_lang(F.col("answer")) == F.col("lang")).alias("aligned"),
        F.size("cited").alias("cited"),
        F.array_join(F.array_sort(echoed), " ").alias("echoed"),
        F.array_join(F.array_sort(F.array_except("unsourced", echoed)), " ").alias("invented"),
        F.when(F.col("expect_refusal"), refuses).alias("refused"),
        F.when(n_gold > 0, F.round(gold_cited / n_gold, 6)).alias("citation_recall"),
        ((n_must > 0) & (must_cited == n_must)).alias("must_cited"),
        F.array_join(F.array_sort(F.array_except("must_seen", "cited")), " ").alias("must_uncited"),
        F.when(F.size("must") > 0, (n_must > 0) & refuses & (must_cited == 0)).otherwise((n_gold > 0) & refuses & (gold_cited == 0)).alias("false_refusal"),
    )


def answer_report(checked: DataFrame) -> DataFrame:
    """One row: answers, those in another language than the question, mean citation recall, false refusals."""
    return checked.agg(
        F.count("*").alias("answers"), F.count_if(~F.col("aligned")).alias("misaligned"), percent(F.avg("citation_recall")).alias("citation_recall"), F.count_if("false_refusal").alias("false_refusals")
    )


def slug(name: Column) -> Column:
    """A term as part of an id: lower case, without anything but a to z."""
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def questions_about(letters: DataFrame, terms: dict[str, str], n: int, seed: str) -> DataFrame:
    """Generated questions: (id, template, lang, text, offen, intern), with the number of gold letters on either side. n
    subjects and n pairs of correspondents are sampled, the terms are a stated list. Pairs are numbered as sampled; one
    without an open letter keeps its number and gives no question."""
    sides = [F.count_if(F.col("sichtbar") == "offen").alias("offen"), F.count_if(F.col("sichtbar") != "offen").alias("intern")]
    columns = ["id", "template", F.lit("de").alias("lang"), "text", "offen", "intern"]
    tags = sampled(tag_counts(letters), "tag", n, seed)
    tagged = letters.select("id", "sichtbar", F.explode(F.array_distinct("subjects")).alias("tag")).join(tags.select("tag"), "tag").groupBy("tag").agg(*sides)
    by_tag = tagged.select(F.concat(F.lit("gen_sache_"), F.right(F.md5("tag"), F.lit(6))).alias("id"), F.lit("sache").alias("template"), F.concat(F.lit("Welche Briefe erwähnen "), "tag", F.lit("?")).alias("text"), "offen", "intern")

    pairs = pair_counts(letters).withColumn("pair", F.concat_ws("|", "sender", "recipient"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.md5(F.concat("pair", F.lit(seed))), "pair"))  # of n rows
    chosen = sampled(pairs, "pair", n, seed).withColumn("nr", place)
    found = spelled(letters, chosen.select("sender", "recipient")).join(letters.select("id", "sichtbar"), "id")
    first = F.min_by(F.when(F.col("sichtbar") == "offen", F.col("id")), F.when(F.col("sichtbar") == "offen", F.struct(F.col("id").try_cast("bigint"), "id")))
    of_pair = found.groupBy("sender", "recipient").agg(*sides, first.alias("first")).join(chosen.select("sender", "recipient", "nr"), ["sender", "recipient"]).filter("offen > 0")
    by_pair = of_pair.select(
        F.concat(F.lit("gen_person_"), F.lpad(F.col("nr").cast("string"), 2, "0"), F.lit("_"), "first").alias("id"),
        F.lit("person").alias("template"),
        F.concat(F.lit("Welche Briefe schrieb "), T.name_core(F.col("sender")), F.lit(" an "), T.name_core(F.col("recipient")), F.lit("?")).alias("text"),
        "offen", "intern",
    )
    each = F.array(*(F.when(F.col("regest").rlike(f"(?iu){rx}"), F.lit(t)) for t, rx in terms.items()))
    by_term = letters.select("sichtbar", F.explode(F.array_compact(each)).alias("term")).groupBy("term").agg(*sides)
    by_term = by_term.select(F.concat(F.lit("gen_inhalt_"), slug(F.col("term"))).alias("id"), F.lit("inhalt").alias("template"), F.concat(F.lit("Welche Briefe erwähnen "), "term", F.lit("?")).alias("text"), "offen", "intern")
    return by_tag.select(*columns).unionByName(by_pair.select(*columns)).unionByName(by_term.select(*columns))
