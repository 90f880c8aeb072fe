"""Personal information in free text, by bootstrapped contextual extraction.

1. One pass over the texts gives candidates, wider than what is sought: whatever has a sign or word for "at" in it, runs
   of digits and capitals, capitalised words, and names of places or things followed by a small number. Each has an
   instance (how its address is spelled, its street word, the number's shape, the given name) and patterns (words before
   and after).
2. Instances and patterns are a bipartite graph, one for all kinds. Seeds (some spellings, street words, shapes, given
   names) score the patterns they occur with; well scored patterns score further instances; and again. Words that
   introduce numbers are seeds too: each counts as PRIOR occurrences of its kind, which the data may confirm or outweigh.
   Every round is a join and two map-side aggregations in Spark; nothing of it is collected.
3. A candidate is taken as what its pattern and instance score highest for, if high enough; so spellings, street words,
   shapes and names that are in no list are found by where they stand.

Defined cases: null, empty and blank texts give no row and stay as they are; rows without doc_id are left out; a repeated finding in a text counts once;
overlapping findings are replaced by the longer one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.sources.tables import cut

# --- Fixed values ----------------------------------------------------------------------------------------------------
#: Given names to begin with, some for each language.
SEED_NAMES = (
    "Anna Andreas Barbara Birgit Christian Elisabeth Georg Hans Heike Johann Jonas Jürgen Karl Katharina Konrad Maria "
    "Michael Peter Petra Stefan Thomas Ulrich Uwe Wolfgang "
    "Alice Clive Edith Edward George Graham Harriet Henry James John Mary Nigel Robert Trevor William "
    "Benoît Camille Claire François Jacques Jean Jérôme Louis Marie Pierre Thierry "
    "Anna Antonio Chiara Elena Ettore Fabrizio Francesca Giovanni Giulia Lorenzo Luca Marco Paolo Renzo Roberto "
    "Annelies Femke Jan Joost Maaike Pieter Sjoerd Willem"
).split()
#: Titles, offices and forms of address, which stand before a surname but are no given name.
TITLES = set(
    "Herr Herrn Frau Fräulein Dr Doktor Prof Professor Magister Mag Rektor Pfarrer Pfarrherr Superintendent Hofrat "
    "Buchdrucker Junker Juncker Meister Vetter Vogt Kanzler Bischof Abt Graf Freiherr Bruder Schwager Doctor Master Mr Mrs Ms Miss Sir Lady "
    "Squire Reverend Cousin Bishop Father Brother Monsieur Madame Mademoiselle Sieur Maître Docteur Abbé Pasteur Frère "
    "Père Mme Mlle Me Signor Signore Signora Signorina Dottor Dottore Dott Dottssa Don Padre Messer Maestro Fra Frate "
    "Meneer Mevrouw Heer Meester Dominee Dhr Mevr Mijnheer Frater Pater Consul Legatus Minister Princeps Rex Dominus "
    "Sankt St Saint Sainte San Santa Santo Sint Einsender Einsenderin Besitzer Besitzerin Leihgeber Bearbeiter Kopist "
    "The Der Die Das Den Dem Des Le La Les Il Lo Gli De Het Een Ein Eine Einen Un Une Una An Am Im In Et And Und".split()
)
PARTICLES = r"(?:(?:von|van|vom|de|del|della|di|da|du|des|dos|ten|ter|te|le|la|af|av|y)\s(?:der\s|den\s|dem\s|de\s|la\s|las\s|los\s|het\s)?|(?:d'|d’))"
#: Words before numbers that nobody doubts; and words before numbers of other kinds.
PHONE_WORDS = "tel. tel.: tel telefon telefon: telephone telephone: téléphone phone phone: telefono telefoon mobil fax handy".split()
ID_WORDS = (
    "reisepass personalausweis ausweis-nr. steuer-id sozialversicherungsnr.: passport passeport paspoortnummer "
    "carta d'identità codice fiscale bsn insurance"
).split()
OTHER_WORDS = (
    "isbn issn signatur sign. ms. cod. inventar-nr. film mikrofiche rechnung regest datiert brief blatt bl. zeile "
    "gesamtbetrag seite s. fol. nr. aufnahme lesart lesesaal raum saal kasten"
).split()
#: Shapes (9 a digit, A a capital) of phone numbers with a country or bracketed area code, and of numbers with a fixed build.
PHONE_SHAPES = regex.compile(r"^(?:\+9|009999999|\(9{2,5}\) ?\d*)")
ID_SHAPES = regex.compile(r"^(?:999\.9999\.9999\.99|AA ?99 ?99 ?99 ?A|9 99 99 99 999 999 99|99 999 999 999)$")
STREETS = {
    "de": "straße strasse str. gasse weg platz allee hof mühle winkel turm grund ufer ring damm markt steig pfad graben "
    "wall steg stieg gässchen gäßchen zeile kai brücke rain anger twiete chaussee landstraße bogen".split(),
    "nl": "straat gracht kade plein laan weg singel dijk pad slag steeg markt baan hof dreef wal haven".split(),
    "en": r"Street St\. Lane Road Rd\. Row Close Avenue Ave\. Court Square Terrace Hill Gate Walk Way Yard Mews Crescent "
    r"Drive Place Gardens Green Passage Alley Parade".split(),
    "fr": "rue quai place avenue boulevard impasse chemin allée cours passage route square ruelle esplanade venelle".split(),
    "it": r"via v\. viale v\.le piazza p\.za p\.zza piazzetta corso vicolo largo strada c\.so contrada borgo salita calle lungarno campo".split(),
}
#: Street words to begin with; the others above are found by where they stand.
SEED_STREETS = "straße strasse str. gasse weg platz am an zum straat gracht street lane road rue quai place avenue via piazza corso".split()
# ---------------------------------------------------------------------------------------------------------------------

#: Occurrences a seed word counts for; patterns with fewer known instances and no seed say nothing.
PRIOR, LEAST = 3.0, 2
#: What candidates of one group are judged as: the first of each is no personal information.
CLASSES = {"email": ("noemail", "email"), "address": ("noaddress", "address"), "number": ("other", "phone", "idnr")}
#: Classes whose candidates are mostly something else.
STRICT = ("address",)
#: Parts a frequent pattern's candidates are split into.
SALT = 8

_AT = r"(?:\s?(?:@|＠|\((?:at|ät|@|AT)\)|\[(?:at|ät|AT)\]|\{(?:at|AT)\})\s?)"
_DOT = r"(?:\.|\s?[(\[{](?:dot|DOT|punkt|Punkt|point|punto|punt)[)\]}]\s?|\s(?:DOT|dot|Punkt|punkt)\s)"
_LABEL = r"[\p{L}\d](?:[\p{L}\d-]*[\p{L}\d])?"
_LOCAL = r"(?<![\p{L}\d._%+-])[\p{L}\d](?:[\p{L}\d._%+-]*[\p{L}\d_])?"
EMAIL = regex.compile(
    rf"{_LOCAL}(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})+|\s(?:AT|at|arobase|chiocciola|apenstaartje)\s{_LABEL}(?:\s(?:DOT|dot|punkt|Punkt|point|punto|punt)\s{_LABEL})+)"
)

_NO = r"\d{1,3}(?:\s?[a-z](?![\p{L}\d]))?(?:\s?[–-]\s?\d{1,3}(?:\s?[a-z](?![\p{L}\d]))?)?(?![\p{L}\d]|[.,/-]\d)"
_CAP = r"\p{Lu}[\p{L}'’]*"
_CAPS = rf"{_CAP}(?:-{_CAP})*"
_SUFFIX = "|".join(sorted({s.replace(".", r"\.") for k in ("de", "nl") for s in STREETS[k]}, key=len, reverse=True))
#: What a named street may begin with, and the street words that stand apart from their name.
_PLACED = "Am|Im|Zum|Zur|An der|An den|An dem|Auf der|Auf dem|In der|In den|Bei der|Hinter der|Hinter dem|Unter den|Unter der|Vor dem|Op de|Op den|Aan de|Aan den|Aan het"
_APART = r"Straße|Strasse|Str\.|Landstraße|Landstr\.|Chaussee|Allee|Weg|Platz|Gasse|Ring|Damm|Ufer|Markt|Tor"
_JOINED = r"straße|strasse|str\.|gasse|weg|platz|allee|straat|gracht|kade|plein|laan"
_OF = r"(?:(?:de la|de l['’]|des|du|de|d['’]|della|delle|dello|dell['’]|dei|degli|del|di|da|dal|dalla)\s?)?"
ADDRESS = regex.compile(
    "|".join(
        [
            # Am Lindenhof 16; An der Badermühle 51: a place named by a preposition.
            rf"(?<![\p{{L}}\d])(?:{_PLACED})\s{_CAPS}\s{_NO}",
            # Badergasse 12; Haferstr. 4a; with an ending that towns have too only where nothing is counted by the number
            rf"(?<![\p{{L}}\d-])\p{{Lu}}[\p{{L}}-]*?(?:{_SUFFIX})\s{_NO}(?!\s\p{{L}})",
            rf"(?<![\p{{L}}\d-])\p{{Lu}}[\p{{L}}-]*?(?:{_JOINED})\s{_NO}",
            # Hallecker Straße 137
            rf"(?<![\p{{L}}\d-])(?:{_CAPS}\s){{1,2}}(?:{_APART})\s{_NO}",
            # 105 Candle Close
            rf"(?<![\p{{L}}\d,.-])\d{{1,3}}[a-z]?(?:\s?[–-]\s?\d{{1,3}})?\s(?:{_CAPS}\s){{1,3}}(?:{'|'.join(STREETS['en'])})(?!\p{{L}})",
            # 88 bis, quai de la Corderie
            rf"(?<![\p{{L}}\d,.-])\d{{1,3}}(?:\s?[–-]\s?\d{{1,3}})?\s?(?:bis|ter|quater|[a-z](?!\p{{L}}))?,?\s(?:{'|'.join(STREETS['fr'])})\s{_OF}{_CAPS}(?:\s{_OF}{_CAPS})*",
            # piazza del Pozzo Vecchio, n. 64
            rf"(?<![\p{{L}}\d])(?i:{'|'.join(STREETS['it'])})\s{_OF}{_CAPS}(?:\s{_OF}{_CAPS})*,?\s(?:n\.\s?)?{_NO}",
        ]
    ).replace(r"\s", r"[ \u00A0\u2009]")
)
# A street of no known form, between a line's start, bracket or verb and a postcode with a town.
ADDRESS_BY_TOWN = regex.compile(rf"(?:(?<=\()|(?<=^)|(?<=\n)|(?<=wohnt )|(?<=woont )|(?<=abita in )|(?<=demeure )|(?<=lives at )|(?<=geht an ))((?:\p{{L}}[\p{{L}}'’-]*\.?[ ]){{1,4}}(?:n\.[ ])?{_NO})(?=(?:,\s|\n)\d{{5}}\s\p{{Lu}})")
_TOWN = regex.compile(r"(?:,\s|\n)\d{5}\s\p{Lu}")
#: What an address of ADDRESS consists of: none goes beyond such a stretch. In it, what a house number has beside it in any
#: of the forms above, by their own words; only such stretches are searched with the long patterns.
_STRETCH = regex.compile(r"[\p{L}\d \u00A0\u2009'’.,/–-]+")
_HOUSE = regex.compile(r"(?<!\d)\d{1,3}(?!\d)")
_plain = lambda words: tuple(sorted({w.replace("\\", "").casefold() for w in words}))
_ENDS = _plain(f"{_SUFFIX}|{_JOINED}|{_APART}".split("|"))
_PLACED_ENDS = _plain(x.split()[-1] for x in _PLACED.split("|"))
_AFTER = _plain(STREETS["en"] + STREETS["fr"])
_ITALIAN = regex.compile(rf"(?<![\p{{L}}\d])(?i:{'|'.join(STREETS['it'])})[ \u00A0\u2009]")
#: From the house number on: a range, a letter, three names and the street word.
_NEXT = regex.compile(r"(?:\S+\s+){0,8}\S*")
#: Broad candidates: an "at" without a domain, and a capitalised word with a small number.
_AT_ONLY = regex.compile(rf"{_LOCAL}{_AT}{_LABEL}")
_THING = regex.compile(r"(?<![\p{L}\d-])(\p{Lu}[\p{L}-]*\.?)[ \u00A0\u2009]\d{1,3}(?![\p{L}\d]|[.,/-]\d)")
_POSTED = regex.compile(r"(?:,\s|\n|\s)\d{4,5}\s\p{Lu}")
_FORM = regex.compile(rf"^[^@＠\s(\[{{]*({_AT}|\s\w+\s)(.*)$", regex.S)
_STREET_WORD = regex.compile(
    rf"(?i)(?:^(am|im|zum|zur|an|auf|in|bei|hinter|unter|vor|op|aan)\s|({'|'.join(sorted({w for ws in STREETS.values() for w in ws} | set(_APART.lower().split('|')), key=len, reverse=True))})(?=\s\d|,|\s\p{{L}}|$))"
)
#: What every e-mail address has in it, by the words of _AT and EMAIL; only texts with one are searched for them.
_EMAIL_MARK = regex.compile(r"[@＠]|[(\[{](?:at|ät|AT|ÄT)[)\]}]|\s(?:AT|at|arobase|chiocciola|apenstaartje)\s")
NOT_STREET = regex.compile(r"^(?:Platz|Zeile|Hof|Turm|Weg|Markt|Bogen)\s|\b(?:Lesesaal|Raum|Saal|Kasten|Blatt|Zeile)\s")

NUMBER = regex.compile(
    r"(?<![\p{L}\d.,/+@_-])(?:\+|\()?(?:[A-Z]{0,3}\d[A-Z\d]*|[A-Z]{2}(?=\s\d\d\s)|[A-Z]\d[A-Z\d]+)(?:(?:\)[ \u00A0]?|[ \u00A0]?[/–-][ \u00A0]?|\.|[ \u00A0]\(|[ \u00A0]|\()(?:[A-Z]?\d[A-Z\d]*|[A-Z](?![\p{L}.'’-])))*"
)
_GIVEN = r"\p{Lu}\p{Ll}[\p{L}]*(?:-\p{Lu}\p{Ll}\p{L}*)?"
_SUR = r"\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)*"
_INITIALS = r"(?:\p{Lu}\.[  ]?)*"
NAME = regex.compile(rf"(?<![\p{{L}}\d-])({_GIVEN})[  ]({_INITIALS}{PARTICLES}?)({_SUR})(?![\p{{L}}-])")
TURNED = regex.compile(rf"(?<![\p{{L}}\d-])({_SUR}),[  ]({_GIVEN})((?:[  ]\p{{Lu}}\.(?!\w))*)(?![\p{{L}}-])")
_SAINT = regex.compile(r"(?:\bSt|\bSte|\bSankt|\bSanct|\bSaint|\bSainte|\bSan|\bSanta|\bSint|\bhl|\bHl)\.?\s$")

_DIGIT, _DIGITS, _CAPITAL, _BLANK, _DOTS = re.compile(r"\d"), re.compile(r"\d+"), re.compile(r"[A-Z]"), re.compile(r"\s"), regex.compile(_DOT)
#: What a number of seven digits and letters consists of; texts without such a stretch are not searched for numbers.
_NUMERIC = re.compile(r"[A-Z\d+(](?:[A-Z\d]|[ \u00A0/–.()-]){6}")

COLUMNS = "doc_id, kind string, beg int, fin int, val string, inst string, pats array<string>"


def shape(number: str) -> str:
    return _CAPITAL.sub("A", _DIGIT.sub("9", number))


def _token(t: str) -> str:
    if "@" in t:
        return "@"
    t = t.lower().strip("()[],;")
    return (t if t.isalpha() else _DIGITS.sub("9", t))[:24]


def _around(text: str, beg: int, fin: int) -> list[str]:
    """Patterns of a place: the word before, the two before, the word after with the one before."""
    line = text[max(0, beg - 60) : beg]
    left = line.rsplit("\n", 1)[-1].split() if not line.endswith("\n") else []
    before = _token(left[-1]) if left else "\n"
    two = f"{_token(left[-2])} {before}" if len(left) > 1 else f"\n {before}"
    right = text[fin : fin + 40].split()
    after = _token(right[0]) if right and fin < len(text) and text[fin] not in "\n" else "\n"
    return [f"1 {before}", f"2 {two}", f"3 {before}|{after}"]


def _spelling(email: str) -> str:
    """How an address writes its signs, whatever its words."""
    m = _FORM.match(email)
    dots = {_BLANK.sub("", d).lower() for d in _DOTS.findall(m.group(2))} if m else set()
    return f"{_BLANK.sub('', m.group(1)).lower() if m else '?'}|{' '.join(sorted(dots)) or 'none'}"


def _street_word(street: str) -> str:
    found = _STREET_WORD.search(street)
    return (found.group(1) or found.group(2)).casefold() if found else "?"


def _place(text: str, beg: int, fin: int) -> list[str]:
    """An address also has the pattern that postcode and town follow, if they do."""
    return [*_around(text, beg, fin), *["4 town"] * bool(_POSTED.match(text, fin))]


def _street_windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches with a house number that may belong to a street."""
    for stretch in _STRETCH.finditer(text):
        b, e = stretch.span()
        italian = None
        for m in _HOUSE.finditer(text, b, e):
            p = m.start()
            if italian is None:
                first = _ITALIAN.search(text, b, e)
                italian = first.end() if first else e
            words = text[b:p].rsplit(None, 2)
            if (
                italian <= p
                or text[max(b, p - 24) : p].rstrip().casefold().endswith(_ENDS)
                or (len(words) > 1 and words[-2].casefold().endswith(_PLACED_ENDS))
                or any(x in after for after in (_NEXT.match(text, p, e).group().casefold(),) for x in _AFTER)
            ):
                yield b, e
                break


def candidates(text: str) -> list[tuple]:
    """(kind, begin, end, value, instance, patterns) of one text."""
    out, taken, numbers = [], [], []

    def free(b: int, e: int) -> bool:
        return all(e <= x or b >= y for x, y in taken)

    if _EMAIL_MARK.search(text):
        for m in EMAIL.finditer(text):
            out.append(("email", m.start(), m.end(), m.group(), _spelling(m.group()), _around(text, *m.span())))
            taken.append(m.span())
        for m in _AT_ONLY.finditer(text):
            if free(*m.span()):
                out.append(("email", m.start(), m.end(), m.group(), _spelling(m.group()), _around(text, *m.span())))
    for b, e in _street_windows(text):
        for m in ADDRESS.finditer(text, b, e):
            if free(*m.span()) and not NOT_STREET.search(m.group()):
                out.append(("address", m.start(), m.end(), m.group(), _street_word(m.group()), _place(text, *m.span())))
                taken.append(m.span())
    if _TOWN.search(text):
        for m in ADDRESS_BY_TOWN.finditer(text):
            if free(*m.span()) and not NOT_STREET.search(m.group()):
                out.append(("address", m.start(), m.end(), m.group(), _street_word(m.group()), _place(text, *m.span())))
                taken.append(m.span())
    for m in NUMBER.finditer(text) if _NUMERIC.search(text) else ():
        value = m.group()
        digits = sum(c.isdigit() for c in value)
        if digits < 4 or sum(c.isalnum() for c in value) < 7 or not free(*m.span()):
            continue
        if value.startswith("(") and ")" not in value:
            value, beg = value[1:], m.start() + 1
        else:
            beg = m.start()
        out.append(("number", beg, beg + len(value), value, shape(value), _around(text, beg, beg + len(value))))
        numbers.append(m.span())
    for m in _THING.finditer(text):
        if free(*m.span()) and all(m.end() <= x or m.start() >= y for x, y in numbers):
            out.append(("address", m.start(), m.end(), m.group(), f"thing {m.group(1).casefold()}", _place(text, *m.span())))
    at = 0
    while m := NAME.search(text, at):
        at = m.start(3) if m.group(1) in TITLES or m.group(1).isupper() else m.end()
        given = m.group(1)
        if given in TITLES or m.group(3) in TITLES or not free(*m.span()) or _SAINT.search(text[max(0, m.start() - 8) : m.start()]):
            at = min(at, m.start(3)) if m.start(3) > m.start() else at
            continue
        out.append(("name", m.start(), m.end(), m.group(), given, _around(text, m.start(), m.end())))
        at = m.start(3)
    for m in TURNED.finditer(text, overlapped=True):
        if m.group(1) not in TITLES and m.group(2) not in TITLES and free(*m.span()):
            out.append(("name", m.start(), m.end(), m.group(), m.group(2), _around(text, m.start(), m.end())))
    return out


def extract(docs: DataFrame) -> DataFrame:
    """Candidates of docs(doc_id, text)."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, *c) for d, t in b.itertuples(index=False) for c in candidates(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "beg", "fin", "val", "inst", "pats"])

    texts = docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    return texts.mapInPandas(run, COLUMNS.replace("doc_id", f"doc_id {key}", 1))


def _parts(given: F.Column) -> F.Column:
    """Given names of a hyphenated one."""
    return F.split(given, "-")


def bootstrap(edges: DataFrame, known: DataFrame, words: DataFrame, rounds: int, least: float) -> tuple[DataFrame, DataFrame]:
    """edges(cls, inst, pat), distinct; known(cls, inst, score) and words(cls, pat, score): scores of the seeds, 0 to 1, of
    which those of one class exclude each other. Returns (instances, patterns) with scores. A pattern's score is the mean
    over the known instances it occurs with and, if it is a seed, PRIOR more of its own, shrunk where there are few; a new
    instance's is the mean of its scored patterns, if one of them is good. In classes of STRICT what isn't known counts
    against a pattern, as their candidates are mostly something else."""
    instances = known
    every = edges.filter(F.col("cls").isin(*STRICT)).groupBy("cls", "pat").agg(F.count("*").alias("every"))
    patterns = None
    for _ in range(rounds):
        scored = edges.join(instances, ["cls", "inst"])
        seen = scored.groupBy("cls", "pat").agg(F.sum("score").alias("s"), F.count("*").alias("c"))
        n = F.coalesce("every", "c", F.lit(0)) + F.when(F.col("score").isNotNull(), PRIOR).otherwise(0.0)
        total = F.coalesce("s", F.lit(0.0)) + F.coalesce(F.col("score") * PRIOR, F.lit(0.0))
        patterns = cut(seen.join(words, ["cls", "pat"], "full").join(every, ["cls", "pat"], "left").select("cls", "pat", (total / (n + 0.3)).alias("score"), n.alias("n")))
        new = (
            edges.join(patterns, ["cls", "pat"])
            .groupBy("cls", "inst")
            .agg(F.avg("score").alias("mean"), F.max("score").alias("best"))
            .filter(F.col("best") >= least)
            .select("cls", "inst", F.greatest(F.col("mean"), F.col("best") * 0.75).alias("score"))
        )
        instances = cut(
            new.join(known.withColumnRenamed("score", "fixed"), ["cls", "inst"], "full")
            .select("cls", "inst", F.coalesce("fixed", "score").alias("score"))
        )
    return instances, patterns


def _joined(rows: DataFrame, scores: DataFrame, on: str) -> DataFrame:
    """rows join scores on one column; a frequent value's rows are spread over SALT tasks, its few scores copied to each."""
    salted = rows.withColumn("salt", F.pmod(F.col("id"), F.lit(SALT)).cast("int"))
    copies = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(copies, [on, "salt"]).drop("salt")


def _seeds(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known instances, seed words) of all groups."""
    spark = edges.sparkSession
    inst = F.col("inst")
    phone, idnr = inst.rlike("^number " + PHONE_SHAPES.pattern[1:]), inst.rlike("^number " + ID_SHAPES.pattern[1:])
    streets = [f"address {w}" for w in SEED_STREETS]
    things = [f"address thing {w}{dot}" for w in OTHER_WORDS for dot in ("", ".")]
    yes = {
        "email": inst == "email @|.",
        "noemail": inst.endswith("|none"),
        "address": inst.isin(streets),
        "noaddress": inst.isin(things),
        "phone": phone & ~idnr,
        "idnr": idnr,
        "other": F.lit(False),
    }
    about = {c: reduce(lambda a, b: a | b, (yes[x] for x in cs)) for cs in CLASSES.values() for c in cs}  # known as one of its group
    score = reduce(lambda w, c: w.when(F.col("cls") == c, F.when(about[c], yes[c].cast("double"))), yes, F.when(F.lit(False), F.lit(0.0)))
    known = edges.select("cls", "inst").distinct().withColumn("score", score).filter(F.col("score").isNotNull())
    listed = {"phone": PHONE_WORDS, "idnr": ID_WORDS, "other": OTHER_WORDS}
    rows = [(c, f"number 1 {w}", 1.0 if c == own else 0.0) for own, ws in listed.items() for w in ws for c in listed]
    return known, spark.createDataFrame(rows, "cls string, pat string, score double")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, beg, fin, val): every place of personal information in docs(doc_id, text)."""
    spark = docs.sparkSession
    rows = cut(extract(docs))
    numbers, names = rows.filter("kind = 'number'"), rows.filter("kind = 'name'")

    # Names: the instances are given names.
    name_edges = names.select(F.explode(_parts(F.col("inst"))).alias("inst"), F.explode("pats").alias("pat"))
    name_edges = cut(name_edges.filter("pat NOT LIKE '1 %'").distinct().withColumn("cls", F.lit("name")))
    seeds = spark.createDataFrame([("name", n, 1.0) for n in SEED_NAMES], "cls string, inst string, score double")
    # A pattern filled by many words that are no given name is no good one: what isn't known counts against it.
    size = name_edges.groupBy("pat").agg(F.count("*").alias("n"))
    every = name_edges.groupBy("inst").agg(F.count("*").alias("all"))
    given = seeds.select("inst")
    for _ in range(3):
        hits = name_edges.join(given, "inst", "left_semi").groupBy("pat").agg(F.count("*").alias("hits"))
        good = hits.join(size, "pat").filter("hits >= 2 AND hits / n >= 0.25").select("pat")
        support = name_edges.join(good, "pat", "left_semi").groupBy("inst").agg(F.count("*").alias("good"))
        likely = support.join(every, "inst").filter("good / all >= 0.15")
        fresh = likely.filter("good >= 3").select("inst")
        given = cut(fresh.unionByName(seeds.select("inst")).distinct())
    firsts = names.select("doc_id", "beg", "fin", "val", F.element_at(_parts(F.col("inst")), 1).alias("inst"), "pats")
    # A given name too rare to be known is taken where both patterns of its place are mostly filled by known ones, itself not
    # counted; unless its other places speak against it.
    hits = name_edges.join(given, "inst", "left_semi").groupBy("pat").agg(F.count("*").alias("hits"))
    scored = hits.join(size, "pat").filter("hits >= 2").select("pat", (F.col("hits") / (F.col("n") - 1 + 0.3)).alias("score"))
    rare = firsts.join(likely.select("inst").join(given, "inst", "left_anti"), "inst", "left_semi")
    placed = (
        rare.select("doc_id", "beg", "fin", "val", F.explode(F.filter("pats", lambda p: ~p.startswith("1 "))).alias("pat"))
        .distinct()
        .join(scored, "pat", "left")
        .groupBy("doc_id", "beg", "fin", "val")
        .agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))
        .filter("score >= 0.5")
    )
    named = firsts.join(given, "inst", "left_semi").select("doc_id", "beg", "fin", "val").unionByName(placed.drop("score"))
    named = named.select("doc_id", F.lit("name").alias("kind"), "beg", "fin", "val")

    # All other kinds: groups of classes that exclude each other, in one graph.
    group = F.create_map(*(x for k, cs in CLASSES.items() for x in (F.lit(k), F.array(*map(F.lit, cs)))))
    others = rows.filter(F.col("kind") != "name").withColumn("inst", F.concat_ws(" ", "kind", "inst"))
    others = others.withColumn("pats", F.transform("pats", lambda p: F.concat_ws(" ", "kind", p))).withColumn("id", F.monotonically_increasing_id())
    others = cut(others)
    edges = cut(others.select("kind", "inst", F.explode("pats").alias("pat")).distinct().select(F.explode(group[F.col("kind")]).alias("cls"), "inst", "pat"))
    known, words = _seeds(edges)
    instances, patterns = bootstrap(edges, known, words, 3, 0.6)

    by_pattern = _joined(others.select("id", F.explode("pats").alias("pat")), patterns.filter(F.col("n") >= LEAST), "pat").groupBy("id", "cls").agg(F.max("score").alias("ctx"))
    by_form = _joined(others.select("id", "inst"), instances, "inst").select("id", "cls", F.col("score").alias("form"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    scores = by_pattern.join(by_form, ["id", "cls"], "full").select("id", "cls", zero("ctx").alias("ctx"), zero("form").alias("form"))
    scores = scores.withColumn("total", F.col("ctx") + F.col("form"))
    of = {c: F.max(F.when(F.col("cls") == c, F.struct("total", "ctx", "form"))).alias(c) for cs in CLASSES.values() for c in cs}
    judged = others.join(scores.groupBy("id").agg(*of.values()), "id")
    total = lambda c: zero(f"{c}.total")
    form = lambda c: zero(f"{c}.form")
    digits, signs = F.length(F.regexp_replace("val", r"\D", "")), F.length(F.regexp_replace("val", r"[^0-9A-Z]", ""))
    is_phone = (total("phone") >= 0.9) & (total("phone") >= total("idnr")) & digits.between(8, 15)
    number = F.when((total("other") > total("phone")) & (total("other") > total("idnr")), None).when(is_phone, "phone").when((total("idnr") >= 0.9) & (signs >= 7), "idnr")
    taken = lambda c: (total(c) >= 0.9) | (form(c) >= 0.5)
    here = zero("address.ctx") >= 0.8  # what has no street word is taken only where its place says so
    kind = (
        F.when(F.col("kind") == "number", number)
        .when((F.col("kind") == "email") & taken("email") & (total("email") > total("noemail")), "email")
        .when((F.col("kind") == "address") & (form("noaddress") < 1) & F.when(F.col("inst").contains(" thing "), (form("address") >= 0.5) & here).otherwise((form("address") >= 0.5) | here), "address")
    )
    trimmed = F.when(F.col("kind") == "phone", F.regexp_replace("val", r"[^0-9]+$", "")).otherwise(F.col("val"))
    found = (
        judged.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select("doc_id", "kind", "beg", (F.col("beg") + F.length(trimmed)).alias("fin"), trimmed.alias("val"))
    )
    return found.unionByName(named)


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs(doc_id, text) with every found place replaced by [KIND]; texts without one stay as they are."""
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("beg", "fin", "kind")).alias("spans"))
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for text, spans in zip(b["text"], b["spans"]):
                if text is None or spans is None:
                    texts.append(text)
                    continue
                chosen: list = []
                for s in sorted(spans, key=lambda s: (s["beg"] - s["fin"], s["beg"], s["kind"])):
                    if all(s["fin"] <= c["beg"] or s["beg"] >= c["fin"] for c in chosen):
                        chosen.append(s)
                for s in sorted(chosen, key=lambda s: -s["beg"]):
                    text = f"{text[: s['beg']]}[{s['kind'].upper()}]{text[s['fin'] :]}"
                texts.append(text)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": texts})

    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").join(spans, "doc_id", "left").mapInPandas(run, f"doc_id {key}, text string")
