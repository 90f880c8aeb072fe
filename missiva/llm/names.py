"""Parts of a name as people type it: given names, surname, generation, office, place; or a body and its town."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

# --- Fixed values: given names with the forms they were written in, titles, offices, kinds of bodies ------------------
GIVEN = """
Albrecht Albert Albertus Albrecht.
Ambrosius Ambros Brosius Ambrosi
Andreas Andres Endres Andrea Drewes
Anna Anne Ann Annen Annele Änni
Anton Antonius Toni Thönges
Balthasar Balthassar Baltzer Baltz Balzer Baltasar Hauser
Barbara Barbel Bärbel Barbel Barbla
Bartholomäus Bartholomeus Barthel Bartel Mewes
Bernhard Bernhardus Bernhart Benz
Christian Christianus Karsten
Christoph Christophorus Stoffel Christof
Daniel Danielus Dan
Dorothea Dorle Dorothe Dorte Dorothee Thea
Elisabeth Elsbeth Elsa Else Elisabetha Lisbeth Els Bethli
Erasmus Asmus Rasmus Erasmi
Franz Franciscus Frantz
Friedrich Fritz Fridericus Friderich Fredericus Frederik Fridrich Friedericus
Georg Jörg Jerg Georgius Gorg Görg Georgii Jürgen Gg
Hieronymus Jeronimus Jerome
Heinrich Heinz Hainrich Henricus Hinrich Heintz Henrich Heinricus Heinrici
Jakob Jacob Jacobus Jockel Jäckel
Joachim Jochen Jochim
Johann Hans Johannes Ioannes Joannes Hannes Johan Henslin Iohannes
Josua Josue
Kaspar Caspar Casparus Jasper
Katharina Käthe Catharina Kathrin Trina Käthi Katherina Catherina Catrina
Konrad Conrad Conradus Kunz Kurt Cunrad Contz Konradus Cuntz
Leonhard Lienhart Leonhardus Lienhard Leonard Linhard Lenhart
Lukas Lucas
Ludwig Lutz Ludovicus Ludowig Ludvicus Ludewig
Magdalena Magda Lena
Margarethe Margareta Gretha Grete Margret Gret Margaretha Gretel
Markus Marcus Marx
Martin Martinus Merten Märti
Matthäus Mattheus Matthaeus Mathäus Mathes Matthes Mathis Thewes Matheus Debes
Melchior Melcher Melk
Michael Michel Michaelus
Nikolaus Klaus Niclas Nicolaus Claus Niklas Niclaus Klas Nicolai
Ottmar Othmarus Otmar Othmar Otmarus
Paul Paulus Pauli Pawel
Peter Petrus Petri Peterlin
Philipp Philippus Lips Philip
Quirin Quirinus Corin Quirein Kirin
Regula Regel Regelin Regele
Rudolf Rudolphus Ruodolf Ruedi Rudolph
Sebastian Bastian Sebastianus Basti Wastel Bastel
Sibylla Sibille Sibylle Billa Sybilla Sibilla
Sigmund Sigismund
Stephan Stephanus Steffen
Theodor Theodorus Dietrich
Thomas Thoma Tomas Thomae Thome
Ulrich Utz Udalricus Ulricus Ueli Uli Huldrych Ulrici
Ursula Ursel Orsel
Valentin Veltin Valentinus Velten Valtin Valten Feltin
Wilhelm Willem Guilielmus Wilhelmus Wilm Guillelmus Willi
Wolfgang Wolf Wolfgangus
Zacharias Zachariae Zacher Zachäus Zacharius
"""
TITLES = "Herr Herrn Hr Frau Dr Doktor Mag Magister Lic Licentiat Prof Junker"
UNSURE_TITLES = ("m", "d")  # Magister and Doctor, but also initials
OLDER = r"(?:(?-i:d)\.\s?ä\.?|der ältere|des älteren|senior|sen\.?|maior|natu maior)"
YOUNGER = r"(?:(?-i:d)\.\s?j\.?|der jüngere|des jüngeren|iunior|junior|jun\.?|iun\.?|minor)"
BODIES = {
    "rat": "rat rath stadtrat stadtrath magistrat magistratus senat senatus ratsherren",
    "kirche": "kirchenrat kirchenrath konsistorium consistorium kirchen-rath kirchen-rat",
    "schule": "universität univ universitas universitet akademie academia hochschule acad schola",
    "kloster": "kloster stift abtei monasterium convent konvent",
    "kapitel": "kapitel domkapitel capitulum",
}
BODY_FILLERS = "der des die stadt zu in von und bürgermeister burgermeister hohe alta an ehrbarer consul consules et"
# ---------------------------------------------------------------------------------------------------------------------


@lru_cache(1 << 16)
def fold(word: str) -> str:
    """A word without accents, doubled letters and the choices of old spelling (c/k, y/i, u/v/w, th/t, ae/ä ...)."""
    w = word.lower().replace("ß", "ss").replace("æ", "ae").replace("œ", "oe")
    w = unicodedata.normalize("NFC", w).replace("ü", "y").replace("ue", "y")  # written u, ue and y alike
    w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
    w = "".join(c for c in w if c.isalnum())
    for a, b in (("sch", "sh"), ("uu", "w"), ("ae", "a"), ("oe", "o"), ("ph", "f"), ("ck", "k"), ("th", "t"), ("dt", "t"), ("tz", "z"), ("c", "k"), ("y", "i"), ("j", "i"), ("v", "u"), ("w", "u")):
        w = w.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", w)


_LATIN = re.compile(r"(?:ius|us)$")


def surname_key(word: str) -> str:
    """Folded surname without a Latin ending."""
    parts = [fold(_LATIN.sub("", p) if len(p) > 6 and _LATIN.search(p.lower()) else p) for p in re.split(r"[-\s]+", word.strip()) if p]
    key = "".join(parts)
    return key[:-1] if len(key) > 5 and key.endswith(("ern", "eln")) else key  # the dative of older texts


def _bare(surname: str) -> str:
    """Letters of a surname as typed, without accents and a Latin ending."""
    w = _LATIN.sub("", surname.lower()) if len(surname) > 6 else surname.lower()
    return _plain(w)


def _forms() -> dict[str, str]:
    out = {}
    for line in GIVEN.strip().splitlines():
        names = line.split()
        for n in names:
            out.setdefault(fold(n), names[0])
            f = fold(n)
            if f.endswith("s") is False:
                out.setdefault(fold(n + "us"), names[0])
    return out


def _plain(word: str) -> str:
    """Lower-case letters without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if c.isalnum())


FORMS = _forms()
RAW = {_plain(n): line.split()[0] for line in reversed(GIVEN.strip().splitlines()) for n in line.split()}
CANONICAL = {line.split()[0]: fold(line.split()[0]) for line in GIVEN.strip().splitlines()}
_BODY = {fold(w): kind for kind, ws in BODIES.items() for w in ws.split()}
_FILL = {fold(w) for w in BODY_FILLERS.split()}
_TITLE = {w.lower() for w in TITLES.split()}


def damerau(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions; most + 1 if it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, nxt[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            nxt.append(v)
        if min(nxt) > most:
            return most + 1
        before, row = row, nxt
    return row[-1]


@lru_cache(1 << 16)
def given_readings(token: str) -> tuple[str, ...]:
    """What a given name can stand for: canonical names, or the token itself where it is none known. One or two
    letters, and what ends in a point, are abbreviations: all canonical names (and their forms) with those letters."""
    plain = token.rstrip(".")
    f = fold(plain)
    if not f:
        return ()
    if token.endswith(".") or len(plain) <= 2:
        if len(plain) == 1:
            same = {"c": "ck", "k": "ck", "i": "ij", "j": "ij", "v": "vf", "f": "vf", "u": "u"}.get(plain.lower(), plain.lower())
            return tuple(sorted({c for c in CANONICAL if c[0].lower() in same})) or (plain.upper() + ".",)
        if _plain(plain) in RAW:
            return (RAW[_plain(plain)],)
        got = {c for form, c in FORMS.items() if form.startswith(f)}
        if not got:  # letters left out in the middle: Gg., Pl., Hnr.
            got = {c for form, c in FORMS.items() if form[0] == f[0] and _within(f, form) and c in CANONICAL and form == CANONICAL[c]}
        if not got and len(f) > 3:
            got = {c for form, c in FORMS.items() if damerau(f, form[: len(f)], 1) <= 1}
        if not got and len(plain) > 3:  # a slip within the abbreviation
            raw = _plain(plain)
            got = {c for form, c in RAW.items() if damerau(raw, form[: len(raw)], 1) <= 1}
        return tuple(sorted(got)) or (plain.capitalize() + ".",)
    if f in FORMS:
        return (FORMS[f],)
    most = 1 if len(f) < 8 else 2
    near = sorted((damerau(f, form, most), form) for form in FORMS if abs(len(form) - len(f)) <= most)
    near = [x for x in near if x[0] <= most]
    if near:
        best = near[0][0]
        got = {FORMS[form] for d, form in near if d == best}
        if len(got) == 1:
            return tuple(got)
    raw = _plain(plain)
    near = {c for form, c in RAW.items() if damerau(raw, form, 1) <= 1}
    return tuple(near) if len(near) == 1 else (f,)


def _within(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


def is_short(token: str) -> bool:
    return token.endswith(".") or len(token) <= 2


@dataclass(frozen=True)
class Name:
    """body is the kind of a body, town its key; else surname and the readings of the given names as typed (given)."""

    body: str = ""
    town: str = ""
    surname: str = ""
    raw: str = ""  # the surname's or town's letters as typed
    given: tuple[str, ...] = ()
    title: str = ""  # a title that may be the initial of a first given name
    generation: str = ""
    office: str = ""
    place: str = ""


#: A town's name may be of two words, as in Markt Hallthal; both begin with a capital.
_TOWN = r"(?:[^\W\d_a-zäöüß][\w-]*\.? )?\w[\w-]*"
_TOWN_LATIN = re.compile(r"(?:ensis|ense|ensium|iensis)$")


def town_key(word: str) -> str:
    return fold(_TOWN_LATIN.sub("", word.lower()))


def _is_given(token: str) -> bool:
    return is_short(token) or fold(token) in FORMS


def _body(words: list[str]) -> Name | None:
    keys = [fold(w) for w in words]
    kind, at = "", -1
    for i, k in enumerate(keys):
        if k in _BODY:
            kind, at = _BODY[k], i
            break
    if not kind and len(words) > 1 and keys[0] == fold("hohe") and damerau(keys[1], fold("schule"), 1) <= 1:
        kind, at = "schule", 1
    if not kind:  # a typing error in the word for the body
        first = [i for i, k in enumerate(keys) if k not in _FILL][:1]
        for i in first:
            close = [b for b in _BODY if len(b) >= 7 and len(keys[i]) >= 6 and damerau(keys[i], b, 1) <= 1]
            if close:
                kind, at = _BODY[close[0]], i
    if not kind:
        return None
    rest = [w for i, w in enumerate(words) if i != at and keys[i] not in _FILL and keys[i] != fold("schule")]
    if not rest:
        return None
    return Name(body=kind, town=town_key(rest[-1]), raw=_plain(_TOWN_LATIN.sub("", rest[-1].lower())))


def parse(text: str) -> Name | None:
    """None for a blank name."""
    s = unicodedata.normalize("NFC", text).replace("[", "").replace("]", "")
    s = " ".join(s.split())
    if not s:
        return None
    office = place = generation = ""
    m = re.search(r"\(([^)]*)\)", s)
    if m:
        office = fold(m.group(1).split(" in ")[0].split(" zu ")[0])
        s = " ".join((s[: m.start()] + " " + s[m.end() :]).split()).replace(" ,", ",")
    for mark, rx in (("A", OLDER), ("J", YOUNGER)):
        m = re.search(rf"(?<!\w){rx}(?!\w)", s, re.I)
        if m:
            generation = mark
            s = " ".join((s[: m.start()] + " " + s[m.end() :]).split()).replace(" ,", ",")
            break
    words = [w.strip(",") for w in s.split()]
    body = _body(words)
    if body:
        return body
    m = re.search(rf" (?:von|aus|de) ({_TOWN})$", s)
    if m:
        place, s = town_key(m.group(1)), s[: m.start()]
    parts = [p.strip() for p in s.split(",") if p.strip()]
    if not parts:
        return None
    title = ""
    lead = parts[0].split()
    while len(lead) > 1 and lead[0].rstrip(".").lower() in _TITLE:
        lead = lead[1:]
    turned = False
    if len(parts) > 1:
        bare = lead[1:] if len(lead) == 2 and lead[0].rstrip(".").lower() in UNSURE_TITLES else lead
        second = parts[1].split()
        while len(second) > 1 and second[0].rstrip(".").lower() in _TITLE:
            second = second[1:]
        if len(bare) == 1 and not (len(second) > 2 and second[-2].lower() in ("in", "zu", "von")) and all(w[:1].isupper() for w in second):
            # Without a given name before it, the first part is a surname; then given names follow.
            if len(lead) == 1 or any(_is_given(w) or given_readings(w)[0] in CANONICAL for w in second):
                turned, lead, parts = True, bare, [parts[0], " ".join(second), *parts[2:]]
    if turned:
        given, surname, tail = parts[1].split(), lead[-1], parts[2:]
    else:
        given, surname, tail = lead[:-1], lead[-1], parts[1:]
    if given and given[0].endswith(".") and given[0].rstrip(".").lower() in UNSURE_TITLES and len(given) > 1:
        title, given = given[0].rstrip(".").upper(), given[1:]
    for t in tail:
        m = re.match(rf"(.+?)\s(?:in|zu|von)\s({_TOWN})$", t)
        if m:
            office, place = fold(m.group(1)), town_key(m.group(2))
        elif not office and len(t.split()) == 1:
            office = fold(t)
    return Name("", "", surname_key(surname), _bare(surname), tuple(given), title, generation, office, place)
