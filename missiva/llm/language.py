"""Languages of texts and of their passages, by a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features, hashed; each pair of neighbours a learned transition. The
field is fitted here, on at most SAMPLE labelled texts (a bounded sample by hash; a documented parameter, as only the
fitting uses it): passages of different languages are joined to code-switched training texts, and passages the
field firmly contradicts after half of the rounds are dropped, since labels may be wrong. Forward-backward then gives
every word of every text a probability for each language; runs of one language are passages.

Weights are a few MB whatever the corpus, so they are broadcast; texts stay where they are, whole.

Defined cases: null, empty and blank texts and texts without a letter have no passage; words of no language (cipher)
get the label "x", which is never reported; digits alone are no words.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from missiva.sources.tables import stored

LANGS = ("de", "en", "fr", "it", "la", "nl")
LABELS = (*LANGS, "x")
#: Labelled texts the field is fitted on, at most; characters and words of each, from anywhere in it; training texts; rounds; hashed features.
SAMPLE, SIGNS, WORDS, TEXTS, ROUNDS, SPACE = 6_000, 6_000, 400, 3_500, 6, 1 << 17
SEED = 7
#: What a label may call a language.
NAMES = {
    "de": "de deu ger dt deutsch german de-de de-at de-ch frühnhd frühneuhochdeutsch fnhd nhd mhd hochdeutsch dtsch teutsch",
    "la": "la lat latein lateinisch latin latina",
    "fr": "fr fre fra frz franz französisch french français francais fr-fr",
    "it": "it ita ital italienisch italian italiano it-it",
    "nl": "nl nld dut ndl niederländisch holländisch dutch nederlands holl nl-nl",
    "en": "en eng engl englisch english en-gb en-us",
}
_NAMED = {w: k for k, ws in NAMES.items() for w in ws.split()}
_SPLIT = re.compile(r"[/,;+&|]|\s+u\.\s*|\s+und\s+|\s+and\s+|\s+et\s+|\s+")


def named(label: str | None) -> set[str]:
    """Languages a label names; none for a missing or undetermined one."""
    return {_NAMED[t] for part in _SPLIT.split((label or "").strip().lower()) if (t := part.strip(" .()[]?")) in _NAMED}


_MARKS = dict.fromkeys(map(ord, "­​"))
_WORD = re.compile(r"\S*[^\W\d_]\S*")
_ALNUM = re.compile(r"\S*[^\W_]\S*")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def tokens(text: str | None) -> list[tuple[int, int, str]]:
    """(begin, end, folded word) of each run of signs between white space that holds a letter."""
    out = []
    for m in _WORD.finditer(text or ""):
        w = unicodedata.normalize("NFC", m.group().translate(_MARKS)).lower().replace("ſ", "s").replace("’", "'")
        out.append((m.start(), m.end(), _EDGE.sub("", w)))
    return out


def features(word: str) -> list[int]:
    """Hashed features: the word, its affixes, its character n-grams, its form."""
    w = word
    names = [f"w{w}", f"l{min(len(w), 9)}"]
    names += [f"p{w[:k]}" for k in (1, 2, 3)] + [f"s{w[-k:]}" for k in (1, 2, 3, 4)]
    padded = f"^{w}$"
    names += [f"n{padded[i : i + 3]}" for i in range(len(padded) - 2)]
    if "'" in w:
        names.append("q" + w.split("'")[0])
    return [xxhash.xxh32_intdigest(n) % SPACE for n in names]


class Field:
    """The fitted field: weights of features and of transitions."""

    def __init__(self):
        n = len(LABELS)
        self.w = np.zeros((SPACE, n), np.float32)
        self.t = np.zeros((n, n), np.float32)
        self.t[np.arange(n), np.arange(n)] = 2.0
        self.words: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {"w": self.w.astype(np.float16), "t": self.t}

    def __setstate__(self, s):
        self.w, self.t, self.words = s["w"].astype(np.float32), s["t"], {}

    def emissions(self, words: list[str]) -> np.ndarray:
        known = self.words
        if len(known) > 300_000:
            known.clear()
        out = np.empty((len(words), len(LABELS)), np.float32)
        for i, w in enumerate(words):
            e = known.get(w)
            if e is None:
                f = features(w)
                e = known[w] = self.w[f].sum(0) / np.sqrt(len(f))
            out[i] = e
        return out

    def messages(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward messages over a batch, each up to a factor per word, and the potentials of transitions and
        words: e (texts, words, labels), mask (texts, words), words first."""
        b, n, k = e.shape
        t = np.exp(self.t - self.t.max())
        x = np.exp(e - e.max(2, keepdims=True))
        alpha, beta = np.empty_like(x), np.ones_like(x)
        a = x[:, 0] / x[:, 0].sum(1, keepdims=True)
        alpha[:, 0] = a
        for i in range(1, n):
            nxt = (a @ t) * x[:, i]
            a = np.where(mask[:, i, None], nxt / nxt.sum(1, keepdims=True), a)
            alpha[:, i] = a
        z = np.ones((b, k), np.float32)
        for i in range(n - 2, -1, -1):
            nxt = (z * x[:, i + 1]) @ t.T
            z = np.where(mask[:, i + 1, None], nxt / nxt.sum(1, keepdims=True), z)
            beta[:, i] = z
        return alpha, beta, t, x

    def marginals(self, e: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probability of each label of each word."""
        alpha, beta, _, _ = self.messages(e, mask)
        p = alpha * beta
        return p / p.sum(2, keepdims=True)

    def expected(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals, and expected counts of transitions: forward message, transition, next word, backward message."""
        alpha, beta, t, x = self.messages(e, mask)
        p = alpha * beta
        joint = alpha[:, :-1, :, None] * t * (x[:, 1:] * beta[:, 1:])[:, :, None, :]
        joint /= np.maximum(joint.sum((2, 3), keepdims=True), 1e-30)
        return p / p.sum(2, keepdims=True), (joint * mask[:, 1:, None, None]).sum((0, 1))


def _cipher(rng: np.random.Generator, n: int) -> list[str]:
    letters = list("abcdefghijklmnopqrstuvwxyz")
    return ["".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(n)]


def fit(texts: list[tuple[str, str]]) -> Field:
    """texts: (language and kind, text). Labels of kinds that begin with "+" are doubted more: a first field is fitted
    on the others, then on all texts whose label that field confirms. The same texts give the same field."""
    texts = sorted(texts)
    trusted = [t for t in texts if " +" not in t[0]] or texts
    first = _fit(trusted, ROUNDS // 2, TEXTS * 2 // 3)
    found = passages(first, [t for _, t in texts])
    agreed = []
    for (stratum, text), ps in zip(texts, found):
        lang = stratum.partition(" ")[0]
        total = sum(p[3] for p in ps if p[2] != "x")
        if total and sum(p[3] for p in ps if p[2] == lang) >= 0.85 * total:
            agreed.append((stratum, text))
    return _fit(agreed or texts, ROUNDS, TEXTS)


def _fit(texts: list[tuple[str, str]], rounds: int, size_of: int) -> Field:
    rng = np.random.default_rng(SEED)
    by: dict[str, dict[str, list[list[str]]]] = {k: {} for k in LANGS}
    for stratum, text in texts:
        lang, _, kind = stratum.partition(" ")
        words = [w for *_, w in tokens(text)]
        at = int(rng.integers(0, max(1, len(words) - WORDS + 1)))
        if len(words) >= 5:
            by[lang].setdefault(kind, []).append(words[at : at + WORDS])
    langs = [k for k in LANGS if by[k]]
    field = Field()
    if not langs:
        return field
    sequences = []
    for _ in range(size_of):
        seq, own = [], []
        for _ in range(int(rng.integers(1, 4))):
            if rng.random() < 0.06:
                part, label = _cipher(rng, int(rng.integers(3, 14))), len(LANGS)
            else:
                lang = langs[rng.integers(len(langs))]
                kinds = list(by[lang].values())
                weight = np.sqrt([len(k) for k in kinds])  # a kind with few texts counts less
                own_kind = kinds[rng.choice(len(kinds), p=weight / weight.sum())]
                source = own_kind[rng.integers(len(own_kind))]
                size = int(rng.integers(4, 28))
                at = int(rng.integers(0, max(1, len(source) - size + 1)))
                part, label = source[at : at + size], LANGS.index(lang)
            seq += part
            own += [label] * len(part)
        sequences.append((seq, np.array(own)))
    index: dict[str, int] = {}
    feats: list[list[int]] = []
    coded = []
    for seq, own in sequences:
        ids = []
        for w in seq:
            if w not in index:
                index[w] = len(feats)
                feats.append(features(w))
            ids.append(index[w])
        coded.append((np.array(ids), own))
    sizes = np.array([len(f) for f in feats])
    flat = np.concatenate([np.array(f) for f in feats])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    scale = (1 / np.sqrt(sizes)).astype(np.float32)
    sq_w, sq_t = np.full_like(field.w, 1e-2), np.full_like(field.t, 1.0)
    for turn in range(rounds):
        if turn == rounds // 2:
            coded = [(ids, own) for ids, own in coded if _agrees(field, ids, own, flat, starts, scale)]
        coded.sort(key=lambda c: len(c[0]))
        blocks = [coded[i : i + 50] for i in range(0, len(coded), 50)]
        for b in rng.permutation(len(blocks)):
            block = blocks[b]
            n = max(len(ids) for ids, _ in block)
            ids, own, mask = (np.zeros((len(block), n), int) for _ in range(3))
            for r, (i, o) in enumerate(block):
                ids[r, : len(i)], own[r, : len(i)], mask[r, : len(i)] = i, o, 1
            mask = mask.astype(bool)
            used, back = np.unique(ids, return_inverse=True)
            e = _scores(field, used, flat, starts, scale)[back].reshape(*ids.shape, -1)
            p, between = field.expected(e, mask)
            gold = np.eye(len(LABELS), dtype=np.float32)[own]
            diff = ((gold - p) * mask[..., None]).reshape(-1, len(LABELS))
            per_word = np.zeros((len(used), len(LABELS)), np.float32)
            np.add.at(per_word, back.ravel(), diff)
            per_word *= scale[used][:, None]
            rows = np.concatenate([flat[starts[u] : starts[u + 1]] for u in used])
            touched, where = np.unique(rows, return_inverse=True)
            g = np.zeros((len(touched), len(LABELS)), np.float32)
            np.add.at(g, where, np.repeat(per_word, sizes[used], axis=0))
            g -= 1e-3 * field.w[touched]
            sq_w[touched] += g * g
            field.w[touched] += 0.3 * g / np.sqrt(sq_w[touched])
            both = mask[:, 1:]
            seen = np.zeros_like(field.t)
            np.add.at(seen, (own[:, :-1][both], own[:, 1:][both]), 1)
            g = seen - between
            sq_t += g * g
            field.t += 0.3 * g / np.sqrt(sq_t)
    return field


def _scores(field: Field, used: np.ndarray, flat: np.ndarray, starts: np.ndarray, scale: np.ndarray) -> np.ndarray:
    rows = np.concatenate([flat[starts[u] : starts[u + 1]] for u in used])
    at = np.concatenate([[0], np.cumsum(starts[used + 1] - starts[used])])[:-1]
    return np.add.reduceat(field.w[rows], at, axis=0) * scale[used][:, None]


def _agrees(field: Field, ids, own, flat, starts, scale) -> bool:
    used, back = np.unique(ids, return_inverse=True)
    e = _scores(field, used, flat, starts, scale)[back][None]
    p = field.marginals(e, np.ones(e.shape[:2], bool))[0]
    return bool(p[np.arange(len(ids)), own].mean() > 0.5)


def passages(field: Field, texts: list[str | None]) -> list[list[tuple]]:
    """Per text (begin, end, label, words, confidence) of its runs of one language, in order."""
    words = [tokens(t) for t in texts]
    out: list[list[tuple]] = [[] for _ in texts]
    order = sorted((i for i in range(len(texts)) if words[i]), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        size = len(words[order[at]])
        end = at
        while end < len(order) and end - at < 128 and len(words[order[end]]) <= size * 1.3 + 8:
            end += 1
        block = order[at:end]
        n = len(words[block[-1]])
        e = np.zeros((len(block), n, len(LABELS)), np.float32)
        mask = np.zeros((len(block), n), bool)
        for r, i in enumerate(block):
            k = len(words[i])
            e[r, :k] = field.emissions([w for *_, w in words[i]])
            mask[r, :k] = True
        p = field.marginals(e, mask)
        for r, i in enumerate(block):
            k = len(words[i])
            best = p[r, :k].argmax(1)
            cuts = np.flatnonzero(np.diff(best)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), k]):
                label = int(best[lo])
                out[i].append((words[i][lo][0], words[i][hi - 1][1], LABELS[label], hi - lo, float(p[r, lo:hi, label].mean())))
        at = end
    return out


def sample(labelled: DataFrame) -> list[tuple[str, str]]:
    """At most SAMPLE of labelled(kind, lang, text): of each kind of text and language an equal share, chosen by hash
    of the text, so that old and modern German, which share a label, are both learned. Of a longer text a stretch of SIGNS
    characters, also chosen by hash."""
    rows = labelled.filter(F.col("lang").isin(*LANGS) & (F.length("text") > 40)).withColumn("h", F.xxhash64("text"))
    begin = F.lit(1) + F.pmod(F.col("h"), F.greatest(F.length("text") - SIGNS, F.lit(0)) + 1).cast("int")
    rows = rows.select(F.coalesce("kind", F.lit("")).alias("kind"), "lang", "h", F.substring("text", begin, F.lit(SIGNS)).alias("text"))
    strata = rows.select(F.count_distinct("kind", "lang").alias("n")).first()["n"]
    share = -(-SAMPLE // max(1, strata))
    order = Window.partitionBy("kind", "lang").orderBy("h", "text")
    picked = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= share)
    return [(f"{r['lang']} {r['kind']}", r["text"]) for r in picked.orderBy("r", "h", "kind", "lang").limit(SAMPLE).collect()]


def stored_fit(spark: SparkSession, texts: list[tuple[str, str]]) -> Field:
    """The field fitted on these texts, kept in the shared folder under the hash of texts and parameters, so that it is
    fitted once however many queries ask for it."""
    parameters = (WORDS, TEXTS, ROUNDS, SPACE, SEED, LABELS)
    name = hashlib.sha256(repr((parameters, sorted(texts))).encode("utf-8", "surrogatepass")).hexdigest()
    kept = stored(spark, f"language-field-{name}", lambda: spark.createDataFrame([(bytearray(pickle.dumps(fit(texts))),)], "field binary").coalesce(1))
    return pickle.loads(bytes(kept.first()["field"]))


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """docs(tbl, id, label, text): (tbl, id, label, seq, begin_at, end_at, lang, words, confidence), a row per passage."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = passages(shared.value, b["text"].tolist())
            rows = [
                (t, i, lab, s, *p[:3], len(_ALNUM.findall(text, p[0], p[1])), p[4])
                for t, i, lab, text, ps in zip(b["tbl"], b["id"], b["label"], b["text"], found)
                for s, p in enumerate(p for p in ps if p[2] != "x")
            ]
            yield pd.DataFrame(rows, columns=["tbl", "id", "label", "seq", "begin_at", "end_at", "lang", "words", "confidence"])

    schema = "tbl string, id string, label string, seq int, begin_at int, end_at int, lang string, words int, confidence double"
    return docs.filter(F.col("text").isNotNull()).select("tbl", "id", "label", "text").mapInPandas(run, schema)


def names_language(label: Column, lang: Column) -> Column:
    """Whether the label names the language; the same reading as named(), as an expression."""
    known = F.create_map(*(F.lit(x) for pair in _NAMED.items() for x in pair))
    parts = F.transform(F.split(F.lower(F.coalesce(label, F.lit(""))), f"(?U){_SPLIT.pattern}"), lambda t: F.regexp_replace(t, r"^[ .()\[\]?]+|[ .()\[\]?]+$", ""))
    return F.exists(parts, lambda t: F.coalesce(F.try_element_at(known, t) == lang, F.lit(False)))
