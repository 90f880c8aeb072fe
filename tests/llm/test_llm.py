"""Operators of the subpackage against brute force, round trips and small literal cases."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from missiva.llm import bpe, language, leakage, names, neighbours, pii, samename, splitting, termcounts, words

TEXTS = ["", None, " ", "Grüße, Welt!", "don't  stop\n\n x" * 3, "<|endoftext|> 123456", "日本語 🖋️ ſtadt", "x" * 3000, "a\u0000b‍", "ÄÖÜ" * 50]


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in bpe.encode_column(df, "doc_id", "text").collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_perfect_hash_is_minimal():
    items = {f"k{i}".encode(): i for i in range(999)}
    h = bpe.PerfectHash(items)
    assert sorted(h.values.tolist()) == list(range(999)) and all(h.get(k) == v for k, v in items.items())
    assert h.get(b"absent") == -1 and bpe.PerfectHash({}).get(b"x") == -1


@pytest.mark.parametrize("text", ["", "   ", "Kurz.", "Satz eins. " * 200, "w" * 2500, "a b " * 900, "Absatz eins\n\nAbsatz zwei; " * 90, "1. Punkt\n" * 150])
def test_split_is_a_round_trip(text):
    whole, parts = " ".join(text.split()), splitting.split(text)
    assert all(len(p) <= 800 for *_, p in parts) and (len(parts) > 1) == (len(whole) > 800)
    back = ""
    for begin, _, overlap, p in parts:
        back += " " * (begin > len(back)) + p[overlap:]
    assert back == whole and all(o <= 151 for _, _, o, _ in parts)


def test_passages_stand_in_their_source():
    text = "  Erster\n\n Satz hier. " * 80 + "x" * 1700 + "\t ende "
    for b, e, o, sb, se, p in splitting.split_at(text):
        assert " ".join(text[sb:se].split()) == p[o:] and e - b == len(p) - o


def test_split_prefers_strong_boundaries():
    text = ("wort " * 60 + "ende.\n\n") * 4
    assert all(p.endswith("ende.") for *_, p in splitting.split(text))


def test_counts_follow_deltas(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(termcounts, "COMPACT", 2)
    state = {}
    for batch in range(5):
        rows = []
        for owner in rng.sample(range(12), 8):
            version, gone = rng.randint(0, 9), rng.random() < 0.2
            terms = [("f", rng.choice("abc")) for _ in range(rng.randint(0, 5))] + [("f", None)]
            rows += [(str(owner), version, terms, gone)] * 2
            if owner not in state or version > state[owner][0]:
                state[owner] = (version, terms, gone)
        store = termcounts.TermCounts(spark, str(tmp_path / "s"))  # each batch in a session of its own
        store.apply(spark.createDataFrame(rows + [(None, 1, [("f", "a")], False)], "owner string, version bigint, terms array<struct<feld:string,term:string>>, gone boolean"))
        live = [[t for _, t in terms if t] for _, terms, gone in state.values() if not gone]
        want = {t: (sum(x.count(t) for x in live), sum(t in x for x in live)) for t in "abc"}
        got = {r.term: (r.occurrences, r.records) for r in store.counts().collect() if r.feld == "f"}
        assert got == {t: c for t, c in want.items() if c[0]}
        assert {r.records for r in store.counts().filter("feld = '*'").collect()} == ({len(live)} if live else set())


def test_batches_read_what_they_touch(spark, tmp_path):
    path = str(tmp_path / "s")
    schema = "owner string, version bigint, terms array<struct<feld:string,term:string>>, gone boolean"
    assert termcounts.TermCounts(spark, path).counts().count() == 0
    termcounts.TermCounts(spark, path).apply(spark.createDataFrame([(str(i), 1, [("f", "a")], False) for i in range(300)], schema))
    opened = termcounts.TermCounts(spark, path)
    scan = opened._states([3])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ (= 3|IN)", scan), scan
    opened._commit([*opened.manifest["batches"]])
    with pytest.raises(RuntimeError):  # the number is taken
        late = termcounts.TermCounts(spark, path)
        late.manifest["number"] -= 1
        late._commit([])
    opened.apply(spark.createDataFrame([("7", 2, None, True), ("8", 0, None, True)], schema))
    assert {(r.term, r.records) for r in termcounts.TermCounts(spark, path).counts().collect()} == {("a", 299), ("*", 299)}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"wort{i}" for i in range(40)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, make(rng.choice([5, 12, 30]))) for i in range(8)]
    docs = []
    for d in range(60):
        w = make(rng.randint(0, 40))
        _, src = rng.choice(items)
        at, n = rng.randint(0, max(0, len(src) - 11)), rng.choice([0, 6, 11, 12, 20])
        docs.append((d, w[:10] + src[at : at + n] + w[10:]))
    runs = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    want = {(d, i) for d, w in docs for i, s in items if runs(w) & runs(s)}
    text = lambda w: " ".join(w).replace("wort1 ", "WORT-\n1, ").replace("wort2 ", "„Wört2“ ")
    df = spark.createDataFrame([(d, text(w)) for d, w in docs] + [(98, None), (99, ""), (None, text(items[0][1]))], "doc_id bigint, text string")
    it = spark.createDataFrame([(i, " ".join(s)) for i, s in items] * 2 + [(50, None), (51, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.contained(leakage.leaks(df, it)).collect()}
    assert want and got == want
    assert leakage.leaks(df, it.limit(0)).count() == 0


def test_edited_copies_are_aligned(spark):
    item = [f"wort{i}" for i in range(40)]
    copy = ["anders" if i % 8 == 7 else w for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(copy)), (2, "ganz fremde worte stehen hier und sonst nichts")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id, r.aligned, r.matched, r.run) for r in leakage.leaks(docs, items).collect()] == [(1, 7, 39, 35, 7)]


def test_recall_of_edited_copies(spark, monkeypatch):
    """Copies with replaced, dropped and inserted words are found by their alignment, copies of less than half aren't; items in several blocks."""
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", 7)
    rng = random.Random(8)
    make = lambda n: [f"w{rng.randint(0, 3_000)}" for _ in range(n)]
    items = [make(rng.randint(40, 90)) for _ in range(20)]
    docs, want = [], set()
    for d in range(300):
        k, rate = rng.randrange(20), rng.choice([0.0, 0.05, 0.1, 0.15])
        copy = []
        for w in items[k]:
            r = rng.random()
            copy += [] if r < rate / 3 else make(1) if r < 2 * rate / 3 else [w, *make(1)] if r < rate else [w]
        if d % 3 == 2:
            docs.append((d, make(30) + copy[: len(items[k]) // 3] + make(30)))
        else:
            docs.append((d, make(30) + copy + make(30)))
            want.add((d, k))
    text = lambda w: " ".join(w)
    df = spark.createDataFrame([(d, text(w)) for d, w in docs], "doc_id bigint, text string")
    it = spark.createDataFrame([(i, text(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.edited(leakage.leaks(df, it)).collect()}
    assert len(got & want) >= 0.98 * len(want) and not got - want


def test_words_of_old_texts():
    assert words.words("Vnd Waſſer-\nſtraß, l'Été 12") == ["und", "wasserstrass", "l", "ete", "12"]


def test_alignment_bridges_edits():
    a = np.array([11, 12, 13, 14, 15, 16, 17], np.uint64)
    b = np.array([9, 11, 12, 13, 8, 15, 16, 17, 9], np.uint64)
    assert leakage.align([(a, b), (a[:2], b[:1]), (a, b[2:])]).tolist() == [[2 * 6 - 1, 0, 7, 6, 3], [0, 0, 0, 0, 0], [2 * 5 - 1, 1, 7, 5, 3]]


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(6)
    for _ in range(30):
        a, b = (rng.integers(2, 6, rng.integers(1, 12)).astype(np.uint64) for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        score, lo, hi, matched, _ = leakage.align([(a, b)])[0]
        assert score == h.max() and (not score or h[hi].max() == score) and score <= 2 * matched <= 2 * (hi - lo)


def brute(rows, k=5):
    good = {n: np.array(v, np.float64) for n, d, v in rows if v and len(v) == d and np.isfinite(v).all() and np.any(v)}
    out = set()
    for a, x in good.items():
        near = sorted(good, key=lambda b: (-round(float(x @ good[b] / np.linalg.norm(x) / np.linalg.norm(good[b])), 9), b))
        out |= {(min(a, b), max(a, b)) for b in [b for b in near if b != a][:k]}
    return out


@pytest.mark.parametrize("copies", [0, 40])
def test_neighbours_equal_brute_force(spark, copies):
    rng = np.random.default_rng(1)
    middle = rng.standard_normal((12, 16))
    rows = [(i, 16, (middle[i % 12] + 0.4 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(1000 + i, 16, rows[3][2]) for i in range(copies)]
    rows += [(500, 16, [0.0] * 16), (501, 16, None), (502, 16, [1.0] * 9), (503, 16, [float("nan")] * 16)]
    df = spark.createDataFrame([(*r, None) for r in rows + rows[:9]], "vec_no bigint, dim int, embedding array<float>, updated_at timestamp")
    got = {tuple(r) for r in neighbours.nearest(df).collect()}
    want = brute(rows)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_neighbours_of_few(spark):
    schema = "vec_no bigint, dim int, embedding array<float>, updated_at timestamp"
    assert neighbours.nearest(spark.createDataFrame([], schema)).count() == 0
    two = [(1, 2, [1.0, 0.0], None), (2, 2, [0.0, 1.0], None)]
    assert [tuple(r) for r in neighbours.nearest(spark.createDataFrame(two, schema)).collect()] == [(1, 2)]


def test_cells_and_pieces(spark, monkeypatch):
    """Divided coarse cells, pieces of a cell and visits of few of them find nearly all that brute force finds."""
    for name, value in {"CELL": 32, "TOP": 6, "PIECE": 48, "SALT": 256}.items():
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(3)
    middle = rng.standard_normal((250, 24))
    x = (middle[rng.integers(250, size=3_000)] + 0.6 * rng.standard_normal((3_000, 24))).astype(np.float32)
    x[1_000:1_400] = x[0] + 0.05 * x[1_000:1_400]  # a dense knot
    df = spark.createDataFrame([(i, 24, v.tolist(), None) for i, v in enumerate(x)], "vec_no bigint, dim int, embedding array<float>, updated_at timestamp")
    got = {tuple(r) for r in neighbours.nearest(df).collect()}
    u = neighbours.unit(x)
    want = set()
    for a in range(0, 3_000, 50):
        sim = np.round(u @ u[a], 12)
        sim[a] = -3
        want |= {(min(a, int(b)), max(a, int(b))) for b in np.lexsort((np.arange(3_000), -sim))[:5]}
    assert len(got & want) >= 0.9 * len(want)


def test_bounds_of_codes():
    """Bit counts and corrected estimates stay within their bounds; rounded bytes within their error."""
    rng = np.random.default_rng(5)
    x, y = neighbours.unit(rng.standard_normal((400, 64))), neighbours.unit(rng.standard_normal((300, 64)))
    y[:100] = neighbours.unit(x[:100] + 0.1 * y[:100])
    (a, own), (b, _) = neighbours.encode(x), neighbours.encode(y)
    differ = np.bitwise_count(a[:, None] ^ b[None]).sum(2)
    high, low = neighbours.reach(neighbours.bits(64))
    sim = x @ y.T
    assert ((sim <= high[differ]) & (sim >= low[differ])).mean() > 0.99
    rows = pd.DataFrame({"own": own, "beat": -2.0, **neighbours.Visitors.of(x)})
    v = neighbours.Visitors(rows)
    assert (np.abs(v.x @ y.T - sim) <= v.err[:, None]).all()
    i, j, s = neighbours.visit(v, y, 5)
    best = np.argsort(-sim, axis=1)[:, :5]
    found = set(zip(i.tolist(), j.tolist()))
    assert np.mean([(r, int(c)) in found for r in range(400) for c in best[r]]) > 0.98 and len(found) < 400 * 8


def test_label_names():
    assert language.named("la u. deu") == {"la", "de"} and language.named("und") == set() and language.named("frühnhd.") == {"de"}
    assert language.named("de und la") == {"de", "la"} and language.named(None) == language.named(" ? ") == set()


def test_label_names_as_an_expression(spark):
    labels = ["la u. deu", "und", "frühnhd.", "de und la", None, " ? ", "de/la", "[lat.]", "", "Deutsch, Latein", "de\u00a0et fr", "engl."]
    df = spark.createDataFrame([(x, k) for x in labels for k in language.LANGS], "label string, lang string")
    rows = df.withColumn("yes", language.names_language(F.col("label"), F.col("lang"))).collect()
    assert [r.yes for r in rows] == [r.lang in language.named(r.label) for r in rows]


def test_expected_counts_equal_enumeration():
    rng = np.random.default_rng(2)
    f, n, k = language.Field(), 4, len(language.LABELS)
    f.t = rng.standard_normal((k, k)).astype(np.float32)
    e = rng.standard_normal((1, n, k)).astype(np.float32)
    single, double, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(sum(e[0, i, c] for i, c in enumerate(path)) + sum(f.t[x, y] for x, y in zip(path, path[1:])))
        total += w
        for i, c in enumerate(path):
            single[i, c] += w
        for x, y in zip(path, path[1:]):
            double[x, y] += w
    padded = np.concatenate([e, rng.standard_normal((1, 3, k)).astype(np.float32)], 1)  # the mask hides what follows
    p, between = f.expected(padded, np.array([[True] * n + [False] * 3]))
    assert np.abs(p[0, :n] - single / total).max() < 1e-5 and np.abs(between - double / total).max() < 1e-4


def test_sample_leaves_no_kind_out(spark):
    rows = [(f"k{i:02d}", "de", f"text {j} " * 900 + "wort " * 40) for i in range(30) for j in range(3)] + [(None, "la", "x " * 50), ("k", None, "y " * 50)]
    got = language.sample(spark.createDataFrame(rows, "kind string, lang string, text string"))
    assert len({k for k, _ in got}) == 31 and all(len(t) <= language.SIGNS for _, t in got)
    assert language.stored_fit(spark, []).t.shape == language.stored_fit(spark, []).t.shape == (7, 7)


@pytest.fixture(scope="module")
def field():
    pools = {
        "de": "der rath hat dem pfarrer geschrieben und die stadt erwartet das schreiben nicht".split(),
        "la": "senatus populus litteras misit ad fratrem propter bellum et pacem non accepit".split(),
        "fr": "le conseil a reçu la lettre avec les frères mais le prince refuse l'argent".split(),
    }
    rng = random.Random(0)
    return language._fit([(f"{k} t", " ".join(rng.choice(ws) for _ in range(60))) for k, ws in pools.items() for _ in range(40)], 3, 400), pools


def test_passages_are_found(field):
    f, pools = field
    rng = random.Random(3)
    part = lambda k, n: " ".join(rng.choice(pools[k]) for _ in range(n))
    texts = [None, "", "123", part("de", 12), part("de", 15) + " " + part("la", 12) + " " + part("fr", 10)]
    got = [[(p[2], p[3]) for p in ps] for ps in language.passages(f, texts)]
    assert got[:3] == [[], [], []] and got[3] == [("de", 12)]
    assert [g[0] for g in got[4]] == ["de", "la", "fr"] and all(abs(n - m) <= 1 for (_, n), m in zip(got[4], (15, 12, 10)))


def test_name_parts():
    p = names.parse
    same = [p("Balthasar Mürtisch d. Ä. (Arzt)"), p("[Balthasar Myrtisch] d. Ä."), p("Mürtischius d. Ä., Balthasar")]
    assert len({(x.surname, x.generation) for x in same}) == 1
    assert p("Schola alta Goldstettenensis") == p("Schola alta Goldstettenensis") and p("Univ. Goldstetten").town == p("Academia Goldstettenensis").town
    assert p("  ") is None and names.given_readings("Veltin") == ("Valentin",) and "Katharina" in names.given_readings("K.")


def test_entities(spark):
    groups = [
        ["Georg Krärbogel", "D. Georg Krärbogel", "Krärbogel, Jörg", "G. Krärbogelus", "Georg Krrärbogel", "Goerg Krärbogel", "Georg Krärbgoel"],
        ["Johann Krärbogel", "[Johannes Krärbogel]"],
        ["Anna Feurzler d. Ä.", "Anne Feurzler der Ältere"],
        ["Anna Feurzler d. J."],
        ["Rat der Stadt Lindweiler", "Senatus Lindweilerensis"],
        ["Kirchenrat Lindweiler", "Consistorium Lindweilerense"],
        ["Dorothea Johann Graninger", "D. J. Graninger"],
    ]
    rows = spark.createDataFrame([(n,) for g in groups for n in g], "name string")
    got = {tuple(r) for r in samename.pairs(samename.entities(rows)).collect()}
    assert got == {tuple(sorted(x)) for g in groups for x in itertools.combinations(g, 2)}


def test_towns_of_two_words_and_like_initials(spark):
    p = names.parse
    assert p("Waundegger, Konrad aus Markt Otterfeld").surname == p("Konrad Waundegger").surname and p("Hans Meier, Kanzler in Bad Au").place == "badau"
    groups = [
        ["Friedrich Larchegger", "F. Larchegger", "Friedrich Larchegger von Markt Au"],
        ["Valentin Larchegger", "V. Larchegger"],
        ["Katharina Bostel", "C. Bostel", "K. Bostel aus Markt Au"],
        ["Regula Wimpolt, Professor zu Moos", "Regula Wiempolt, Professor zu Moos", "R. Wiempolt", "Reg. Wiempolt"],
        ["Regula Wiempol"],
    ]
    rows = spark.createDataFrame([(n,) for g in groups for n in g], "name string")
    found = dict(tuple(r) for r in samename.entities(rows).collect())
    for g in groups[:3]:
        assert len({found[n] for n in g}) == 1, g
    assert len({found[g[0]] for g in groups[:4]}) == 4 and found["Regula Wimpolt, Professor zu Moos"] == found["Regula Wiempolt, Professor zu Moos"]


def test_slips_typed_in_several_ways(spark):
    right = [f"{g} Bullinger" for g in "Heinrich Anna Georg Konrad Barbara Ulrich Thomas Peter Maria Johann Jakob Elisabeth".split()]
    slip = ["Bullniger, Heinrich", "Heinrich Bullniger", "Heinrich Bullniger, Pfarrer"]
    rows = spark.createDataFrame([(n,) for n in right + slip], "name string")
    got = {tuple(r) for r in samename.pairs(samename.entities(rows)).collect()}
    assert got == {tuple(sorted(x)) for x in itertools.combinations(["Heinrich Bullinger", *slip], 2)}


def test_pointers_are_followed_to_the_end(spark):
    chain = spark.createDataFrame([(str(k), str(k + 1)) for k in range(9)], "node string, to string")
    assert {tuple(r) for r in samename._follow(chain).select("node", "end").collect()} == {(str(k), "9") for k in range(9)}


def test_trie_equals_brute_force():
    rng = random.Random(4)
    keys = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) for _ in range(150)})
    trie = samename.Trie(keys)
    for w in rng.sample(keys, 25):
        assert dict(trie.within(w)) == {k: d for k in keys if (d := names.damerau(w, k, 2)) <= 2}


def test_wide_candidates_are_judged_by_form_and_place(spark):
    """Spellings and street words that are no seeds are learned from where they stand; what merely looks like them isn't taken."""
    t = "Scans an (jonas_b48 AT archiv-goldfeld DOT example). Leihgeber ist Uwe Bär (Am Lindenhof 16–18, 68850 Eck). Lesart A @ Zeile 39. Platz 22. demeure 88 bis, quai de la Corderie"
    wide = {(k, v) for k, _, _, v, *_ in pii.candidates(t) if k in ("email", "address")}
    right = {("email", "jonas_b48 AT archiv-goldfeld DOT example"), ("address", "Am Lindenhof 16–18"), ("address", "88 bis, quai de la Corderie")}
    assert right < wide and {("email", "A @ Zeile"), ("address", "Zeile 39")} < wide
    docs = [f"Scans an ({n}_b4@archiv.example). Leihgeber ist {n} ({s} {i}, 6885{i} Eck)." for i, n in enumerate(("uwe", "petra", "jonas", "karl")) for s in ("Badergasse", "Neuer Platz", "Lange Straße", "Am Turm")]
    docs += [f"Scans an (anna AT haus{i} DOT example)." for i in range(3)] + [f"Leihgeber ist Anna (Wieser Twiete {i}, 6885{i} Eck). Zettel {i + 20} liegt bei." for i in range(5)]
    df = spark.createDataFrame(list(enumerate([t, *docs, "Die Twiete ist eng. Brief Haferstieg 9 fehlt."])), "doc_id bigint, text string")
    got = {(r.doc_id, r.kind, r.val) for r in pii.find(df).filter("kind IN ('email', 'address')").collect()}
    assert {(k, v) for d, k, v in got if d == 0} == right
    assert len([1 for _, k, _ in got if k == "email"]) == 1 + 16 + 3 and {v for d, k, v in got if k == "address" and d >= 20} >= {f"Wieser Twiete {i}" for i in range(5)}
    assert not [v for *_, v in got if v.startswith(("Zettel", "Brief", "A @"))]


def test_bootstrapped_findings(spark):
    surnames = ["Bär", "Norz", "Flam", "Drux", "Kell", "Wams"]
    known, new = ["Uwe", "Petra", "Jonas"], ["Torsten", "Svenja"]
    docs = [f"Bearbeitung: {g} {s}. Erneut. Tel. +49 69 9000{i}{j}77. Reisepass 756.1234.567{i}.0{j}, vorgelegt von {g} {s}." for i, g in enumerate(known + new) for j, s in enumerate(surnames)]
    docs += ["Die Kirche St. Georg zu Eck. Herr Schmidt kam. Film 20213 12 030.", "Tel. 069 9000 1234. Reisepass 991234567, vorgelegt von Torsten Neu.", None, "", "Magister Norz"]
    df = spark.createDataFrame([*enumerate(docs), (None, "Bearbeitung: Uwe Norz")], "doc_id bigint, text string")
    found = pii.find(df)
    got = {(r.doc_id, r.kind, r.val) for r in found.collect()}
    n = len(docs)
    assert (n - 4, "phone", "069 9000 1234") in got and (n - 4, "idnr", "991234567") in got and (n - 4, "name", "Torsten Neu") in got
    assert not [g for g in got if g[0] in (n - 5, n - 3, n - 2, n - 1)]
    assert sum(k == "name" for _, k, _ in got) == len(known + new) * len(surnames) + 1
    texts = {r.doc_id: r.text for r in pii.redact(df, found).collect()}
    assert texts[0].startswith("Bearbeitung: [NAME]. Erneut. Tel. [PHONE].") and texts[n - 3] is None and texts[n - 1] == "Magister Norz"


def test_rare_given_names_are_found_by_their_place(spark):
    docs = [f"Mit besten Grüßen\n{g} Norz\n" for g in ("Uwe", "Petra", "Jonas", "Anna", "Karl")]
    docs += ["Mit besten Grüßen\nRosalind Bär\n", "Die Rosalia Stadt liegt fern."]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    names = {(r.doc_id, r.val) for r in pii.find(df).filter("kind = 'name'").collect()}
    assert (5, "Rosalind Bär") in names and not [n for n in names if n[0] == 6] and len(names) == 6


def test_prefilters_lose_nothing():
    streets = (
        "Via Roma 12|Piazza Vecchia 3|via Roma n.64|Lange Strasse 5|Alte Gasse 12|Neuer Markt 3|Hoher Ring 7|Alter Damm 9|Oberes Ufer 2|"
        "Am Lindenhof 16–18|An der Badermühle 51|Badergasse 12|Haferstr. 4a|105 Candle Close|12 – 14 Old Candle Close|88 bis, quai de la Corderie|"
        f"piazza del Pozzo Vecchio, n. 64|Am {'Lang' * 30} 5|Via {'Lunga ' * 20}4|Am\u00a0Lindenhof\u00a016|via\u2009Roma\u20093"
    ).split("|")
    for x in streets:
        t = f"Er wohnt hier ({x}), im Jahr 1563; 12 Briefe."
        whole = [m.span() for m in pii.ADDRESS.finditer(t)]
        assert whole and [m.span() for b, e in pii._street_windows(t) for m in pii.ADDRESS.finditer(t, b, e)] == whole
        assert [(b, e) for k, b, e, *_ in pii.candidates(t) if k == "address"] == whole
    found = [(k, v) for t in ("Uwe apenstaartje archief punt nl", "wohnt Lange Zeilen Beim Bache 5,\u00a012345 Eck") for k, _, _, v, *_ in pii.candidates(t)]
    assert ("email", "Uwe apenstaartje archief punt nl") in found and ("address", "Lange Zeilen Beim Bache 5") in found


def test_extra_columns_with_clashing_names(spark):
    """Columns called like those an operator makes for itself change nothing."""
    clash = lambda df, *names: df.withColumns({n: F.lit("clash") for n in names})
    rng = np.random.default_rng(9)
    vectors = spark.createDataFrame([(i, 8, rng.standard_normal(8).tolist(), None) for i in range(30)], "vec_no bigint, dim int, embedding array<float>, updated_at timestamp")
    near = lambda df: sorted(tuple(r) for r in neighbours.nearest(df).collect())
    assert near(clash(vectors, "key", "rep", "raw", "cell", "piece", "h1", "members", "near", "__rank")) == near(vectors)
    docs = spark.createDataFrame([(1, "Reisepass 756.1234.5678.97, Uwe Norz (uwe@haus.example) " + " ".join(f"wort{i}" for i in range(20))), (2, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(f"wort{i}" for i in range(15)))], "item_id bigint, text string")
    leaks = lambda d, i: [tuple(r) for r in leakage.leaks(d, i).collect()]
    assert leaks(clash(docs, "h", "at", "k", "item_id", "run"), clash(items, "doc_id", "k")) == leaks(docs, items) != []
    found = lambda d: sorted(tuple(r) for r in pii.find(d).collect())
    assert found(clash(docs, "kind", "beg", "fin", "val", "inst", "pats", "id", "cls", "salt")) == found(docs) != []
    texts = spark.createDataFrame([("a", "Satz eins. " * 100, None)], "id string, volltext string, erlaeuterung string")
    assert splitting.passages(clash(texts, "k", "kind", "text", "seq", "passage"), "id", ["volltext", "erlaeuterung"]).collect() == splitting.passages(texts, "id", ["volltext", "erlaeuterung"]).collect() != []
    assert bpe.encode_column(clash(docs, "ids"), "doc_id", "text").collect() == bpe.encode_column(docs, "doc_id", "text").collect()
    tagged = docs.select(F.lit("t").alias("tbl"), F.col("doc_id").cast("string").alias("id"), F.lit("de").alias("label"), "text")
    f = language.Field()
    assert language.tag(clash(tagged, "seq", "lang", "words", "begin_at"), f).collect() == language.tag(tagged, f).collect()
