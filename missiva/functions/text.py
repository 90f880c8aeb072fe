"""Column functions over German texts: normal form, stems, forms of subjects and names, references, refusals.

All are plain expressions, so they stay inside code generation. Word boundaries are spelled out as "no ASCII letter,
digit or underscore", because the JVM's own boundary takes umlauts for word characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a question that never become search terms.
STOPWORDS = (
    "welche welcher welches wer was wie wann wo warum briefe brief erwähnen erwähnt erwähnung nennen nennt "
    "gibt geben zu über von an der die das den dem des ein eine einen einem einer und oder mit in im aus "
    "jahr jahre jahren schrieb schreibt schrieben betreffen betrifft handeln behandeln thema sind ist "
    "werden wurde wurden große großen groß alle diese dieser dieses dies etwas nicht auch noch sich "
    "bei nach vor für durch als auf um wegen zwischen unter ohne gegen seinem seiner seine sein ihrem "
    "ihrer ihre ihr dass wird hat haben hatte hatten kann können soll sollen will wollen "
    "viele vielen enthält enthalten insgesamt beste besten gute guten sehr mehr meisten einige welchen"
).split()
#: What asks for a statistic of the whole archive.
AGGREGATE = r"(wie ?viele|wieviel|anzahl|insgesamt|die meisten|am häufigsten|durchschnittlich)"
#: How an answer refuses at its start, and anywhere.
REFUSAL_START = r"^\W*(die vorliegenden briefe enthalten dazu keine informationen|kein(e|er)?\s+(der|des)?\s*(bereitgestellten|vorliegenden|quellen|brief))"
REFUSAL = (
    "kein hinreichend relevanter Brief|keine Informationen|keine relevanten|stelle .*konkrete Frage|spezifische Frage|"
    "betrifft das gesamte Archiv|nicht beantwortet werden|nicht in den bereitgestellten|nicht enthalten|Zählung oder Statistik"
)
#: Words counted to tell German from English.
GERMAN_WORDS = "der die das und nicht ein eine den im mit von zu".split()
ENGLISH_WORDS = "the and of to in is that which with from".split()

_NO_WORD_BEFORE, _NO_WORD_AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def normalize(s: Column) -> Column:
    """Lower case, every run of other signs than letters and digits one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "))


def words(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


def stem_word(w: Column) -> Column:
    """Umlauts folded; then of words over five letters en, er, em, es dropped, else of those over four e, n, s."""
    folded = F.replace(F.translate(w, "äöü", "aou"), F.lit("ß"), F.lit("ss"))
    size = F.length(folded)
    return (
        F.when((size > 5) & F.substring(folded, -2, 2).isin("en", "er", "em", "es"), F.left(folded, size - 2))
        .when((size > 4) & F.substring(folded, -1, 1).isin("e", "n", "s"), F.left(folded, size - 1))
        .otherwise(folded)
    )


def stems(s: Column) -> Column:
    """array<string>: stems of the words of s."""
    return F.transform(words(normalize(s)), stem_word)


def stem_phrase(s: Column) -> Column:
    return F.array_join(stems(s), " ")


def ngrams(ws: Column, most: int) -> Column:
    """All runs of 1 to most words, joined by a space; empty for no words."""
    runs = lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(most), F.size(ws) - i + 1)), lambda n: F.array_join(F.slice(ws, i, n), " ")
    )
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.size(ws)), runs))
    return F.when(F.size(ws) > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def subject_forms(subject: Column, least: int = 4) -> Column:
    """Forms a subject is found by: whole, without parentheses, and comma segments that hold a letter and a space."""
    bare = F.regexp_replace(subject, r"\s*\([^)]*\)", "")
    segments = F.split(bare, ",")
    parts = F.when(
        F.size(segments) > 1,
        F.filter(F.transform(segments, normalize), lambda f: f.rlike(r"\p{L}") & f.contains(" ")),
    ).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(normalize(subject), normalize(bare)), parts)
    return F.array_distinct(F.filter(every, lambda f: F.length(f) >= least))


def person_forms(name: Column, least: int = 4) -> Column:
    """Forms a name is found by: whole, before the first comma, that part's last word; and stems of these one longer."""
    base = normalize(F.element_at(F.split(name, ","), 1))
    ws = words(base)
    last = F.when(F.size(ws) > 1, F.element_at(ws, -1))
    forms = F.array_distinct(F.filter(F.array_compact(F.array(normalize(name), base, last)), lambda f: F.length(f) >= least))
    stemmed = F.filter(F.transform(forms, stem_phrase), lambda f: F.length(f) >= least + 1)
    return F.array_distinct(F.concat(forms, stemmed))


def whole(text: Column, part: Column) -> Column:
    """Whether part stands in text as whole words."""
    space = F.lit(" ")
    return F.contains(F.concat(space, text, space), F.concat(space, part, space))


def search_terms(question: Column) -> Column:
    """Stems of the words that search texts: of four letters or more, no stopword, with a letter; in order, distinct."""
    kept = F.filter(words(normalize(question)), lambda w: (F.length(w) >= 4) & ~w.isin(*STOPWORDS) & w.rlike(r"\p{L}"))
    return F.array_distinct(F.transform(kept, stem_word))


def year_refs(question: Column, years: str = r"1[4-6]\d\d") -> Column:
    """Years of a question that asks by date; else none."""
    asks = question.rlike(rf"(?i){_NO_WORD_BEFORE}(jahr[A-Za-z0-9_]*|datiert){_NO_WORD_AFTER}")
    found = F.regexp_extract_all(question, F.lit(rf"{_NO_WORD_BEFORE}({years}){_NO_WORD_AFTER}"), 1)
    return F.when(asks, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def id_refs(question: Column) -> Column:
    """Letter numbers named in a question, each with its own word for letter before it."""
    pattern = rf"(?i){_NO_WORD_BEFORE}brief[A-Za-z0-9_]*\s+(?:nr\.?\s*)?(\d{{3,6}}){_NO_WORD_AFTER}"
    return F.array_distinct(F.regexp_extract_all(question, F.lit(pattern), 1))


def cited_ids(answer: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"(?i)Brief\s+(?:Nr\.?\s*)?(\d{3,6})"), 1))


def strict_cited_ids(answer: Column) -> Column:
    """The narrower reading used for measuring: no abbreviation, capital only."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"Brief\s+(\d{3,6})"), 1))


def asks_statistic(question: Column) -> Column:
    return question.rlike(rf"(?iu){_NO_WORD_BEFORE}{AGGREGATE}{_NO_WORD_AFTER}")


def opens_with_refusal(answer: Column) -> Column:
    return F.substring(F.trim(answer), 1, 160).rlike(f"(?iu){REFUSAL_START}")


def looks_like_refusal(answer: Column) -> Column:
    return answer.rlike(f"(?iu){REFUSAL}")


def count_words(text: Column, ws: list[str]) -> Column:
    """How often any of ws stands in text between single spaces, a space shared by two neighbours counting once each."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    total = F.lit(0)
    for w in ws:
        total = total + F.size(F.split(padded, f" {w} ", -1)) - 1
    return total


def detect_lang(text: Column) -> Column:
    """zh, de or en by word counts; ties are German."""
    german, english = count_words(text, GERMAN_WORDS), count_words(text, ENGLISH_WORDS)
    return F.when(text.rlike(r"[\x{4e00}-\x{9fff}]"), "zh").when(english > german, "en").otherwise("de")


def name_core(name: Column) -> Column:
    """A name without brackets and double spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"[\[\]]", ""), r"\s+", " "))


def name_spellings(name: Column) -> Column:
    """At most four spellings an editor may have used: raw, core, core in brackets, first comma part in brackets."""
    core = name_core(name)
    head, tail = F.substring_index(core, ",", 1), F.regexp_extract(core, r"^[^,]*(,.*)$", 1)
    return F.array_distinct(F.array(name, core, F.concat(F.lit("["), core, F.lit("]")), F.concat(F.lit("["), head, F.lit("]"), tail)))
