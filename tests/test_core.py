"""Core operators on small literal rows: nulls, ties, repeated rows, empty tables, odd shapes."""

import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from missiva.functions import text as T
from missiva.functions import variants as V
from missiva.operators import answer as W
from missiva.operators import archive as A
from missiva.operators import evaluate as E
from missiva.operators import match as M
from missiva.operators import nested as N
from missiva.operators import orphans as O
from missiva.operators import retrieve as R
from missiva.operators import vectors as X
from missiva.plans import retrieval as P
from missiva.sources import files
from missiva.sources.tables import fingerprint, latest, numbered, shared_dir
from missiva.streaming import embedding

KEY = "50c1a0003c7be9d24c000012"


def column(spark, values, expr):
    return [r[1] for r in sorted(spark.createDataFrame(list(enumerate(values)), "i int, s string").select("i", expr(F.col("s"))).collect())]


def test_only_whole_json_counts(spark):
    parsed = column(spark, ['{"a":1}', '{"a":1}}', '{"a":1} x', '{"a":', "", None, "null", "[1]"], lambda s: V.parse(s).isNotNull())
    assert parsed == [True, False, False, False, False, False, True, True]


def test_id_notations(spark):
    values = [KEY, KEY.upper(), f" {KEY}\n", f'ObjectId("{KEY}")', "", "  ", None, "Unbekannt", KEY + "0"]
    assert column(spark, values, V.normal_id) == [KEY] * 4 + [None] * 3 + ["unbekannt", KEY + "0"]


def flat(spark, **fields):
    row = ("b1", *(json.dumps(fields[f]) if f in fields else None for f in N.LETTER_LEVELS))
    df = spark.createDataFrame([row], "brief_id string, schlagworte string, datierung string, transkription string")
    return {(r.child, r.path): r.val for r in N.flatten(df, "brief_id", N.LETTER_LEVELS).collect()}


def test_nested_shapes(spark):
    assert flat(spark, schlagworte={"v": {"sachen": {"v": KEY}, "orte": [None, {"v": ""}, {"v": {"$oid": KEY.upper()}}], "personen": None}}) == {
        ("sachen", "0"): KEY, ("orte", "0"): None, ("orte", "1"): None, ("orte", "2"): KEY,
    }
    got = flat(spark, transkription={"seiten": [{"zeilen": [{}, {"n": {"v": 3}, "noten": {"typ": "loch"}}]}, {"nr": {"v": "1v"}}]})
    assert got == {("seiten", "0"): None, ("seiten", "1"): "1v", ("zeilen", "0/0"): None, ("zeilen", "0/1"): "3", ("noten", "0/1/0"): "loch"}
    got = flat(spark, datierung={"alternativen": {"am": {"j": {"v": "1531"}}, "belege": [{"sig": "E II 8"}, {"v": None}]}})
    assert got == {("alternativen", "0"): "1531", ("belege", "0/0"): "E II 8", ("belege", "0/1"): None}


def test_nested_empty_table(spark):
    df = spark.createDataFrame([], "brief_id string, schlagworte string, datierung string, transkription string, path string")
    assert N.flatten(df, "brief_id", N.LETTER_LEVELS).count() == 0


def orphans(spark, refs, parents):
    r = spark.createDataFrame(refs, "owner string, at timestamp_ntz, feld string, tab string, ref_id string")
    p = spark.createDataFrame(parents, "tab string, ref_id string, alive_from timestamp_ntz")
    return sorted((x.owner, x.ref_id, x.state, x.period) for x in O.find_orphans(r, p).collect())


def test_orphan_states(spark):
    t = lambda m, d=1: dt.datetime(2015, m, d)
    refs = [("a", t(3, 10), "f", "t", k) for k in ("gone", "dead", "early", "late", "same_before", "same_after")]
    refs += [("a", t(3, 10), "f", "t", "gone"), ("b", None, "f", "t", "late"), ("b", None, "f", "t", "gone"), ("c", t(5), "f", "u", "early")]
    parents = [("t", "dead", None), ("t", "early", t(1)), ("t", "late", t(7)), ("t", "same_before", t(3, 9)), ("t", "same_after", t(3, 11))]
    assert orphans(spark, refs, parents) == [
        ("a", "dead", "deleted", "2015-03"), ("a", "gone", "missing", "2015-03"), ("a", "late", "late", "2015-03"),
        ("a", "same_after", "late", "2015-03"), ("b", "gone", "missing", None), ("c", "early", "missing", "2015-05"),
    ]


def test_orphans_of_empty_tables(spark):
    assert orphans(spark, [], [("t", "x", None)]) == []
    assert orphans(spark, [("a", dt.datetime(2015, 1, 1), "f", "t", "x")], []) == [("a", "x", "missing", "2015-01")]


def test_latest_takes_one_row(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", None)], "k string, rev int")
    assert sorted(map(tuple, latest(df, ["k"], [F.col("rev").desc_nulls_last()]).collect())) == [("a", 2), ("b", None)]


@pytest.mark.parametrize("word,stem", [("kometen", "komet"), ("träume", "traum"), ("fasse", "fass"), ("fass", "fass"), ("straße", "strass"), ("", ""), ("den", "den")])
def test_stems(spark, word, stem):
    assert column(spark, [word], T.stem_word) == [stem]


def test_subject_forms(spark):
    forms = column(spark, ["Heidelberger Katechismus, Frage 60", "Reichstag (1530)", "Bullinger, Apologie des HK", "Eid", ""], T.subject_forms)
    assert [sorted(f) for f in forms] == [
        ["frage 60", "heidelberger katechismus", "heidelberger katechismus frage 60"], ["reichstag", "reichstag 1530"], ["apologie des hk", "bullinger apologie des hk"], [], [],
    ]


def test_person_forms(spark):
    assert sorted(column(spark, ["Heinrich Weickers, Abt"], T.person_forms)[0]) == ["heinrich weicker", "heinrich weicker abt", "heinrich weickers", "heinrich weickers abt", "weicker", "weickers"]


def test_question_references(spark):
    q = ["Fasse Brief Nr. 18494 und Brief 77 zusammen", "aus dem Jahr 1563 und 1599", "die Ausgabe von 1563", "äbrief 18494", "Am häufigsten?"]
    assert column(spark, q, T.id_refs) == [["18494"], [], [], ["18494"], []]
    assert column(spark, q, T.year_refs)[1:3] == [["1563", "1599"], []]
    assert column(spark, q, T.asks_statistic) == [False] * 4 + [True]


def test_windows():
    assert A.windows("", 800, 150) == [] and A.windows("  ", 800, 150) == []
    assert A.windows("x" * 800, 800, 150) == ["x" * 800]
    parts = A.windows("x" * 900, 800, 150)
    assert [len(p) for p in parts] == [800, 250]
    assert all(len(p) <= 800 for p in A.windows("wort " * 3000, 800, 150))


def archive(spark):
    rows = [
        ("1", "offen", ["Jagdordnung"], ["Anna Meier"], ["Beat Gross"], "1563-01-01", "Das Siegel der Stadt"),
        ("2", "offen", ["Jagdordnung, Bern"], ["Beat Gross"], ["Anna Meier"], "1563-02-01", "Siegelring"),
        ("3", "offen", [], ["Carl Ohm"], [], None, None),
    ]
    return spark.createDataFrame(rows, "id string, sichtbar string, subjects array<string>, senders array<string>, recipients array<string>, date_iso string, editorial string")


def test_matching(spark):
    letters = archive(spark)
    comments = spark.createDataFrame([("3", "ein Siegel")], "id string, erlaeuterung string")
    asked = [("a", "Jagdordnungen in Bern"), ("b", "Anna Meier an Beat Gross"), ("c", "Was schrieb Carl Ohm?"), ("d", "Siegel"), ("e", "im Jahr 1563"), ("f", "Brief 999"), ("g", "")]
    q = M.features(spark.createDataFrame(asked, "qid string, text string"))
    senders, recipients = A.person_postings(letters, "senders"), A.person_postings(letters, "recipients")
    persons = {(r.qid, r.id, r.exact) for r in M.persons(q, senders, recipients).collect()}
    assert persons == {("b", "1", True), ("b", "2", True), ("c", "3", False)}
    subjects = {(r.qid, r.id) for r in M.subjects(q, A.subject_postings(letters)).collect()}
    assert ("a", "1") in subjects or ("a", "2") in subjects
    texts = A.stem_texts(letters, comments)
    assert {(r.qid, r.id) for r in M.texts(q, A.stem_postings(texts), texts).collect() if r.qid == "d"} == {("d", "1"), ("d", "2"), ("d", "3")}
    gates = {r.qid: (r.closed, r.structured) for r in M.gates(q, letters, M.persons(q, senders, recipients), M.years(q, letters), M.ids(q, letters)).collect()}
    assert gates["f"] == (True, False) and gates["e"] == (False, True) and gates["b"] == (False, True) and gates["g"] == (False, False)


def test_generic_forms_are_dropped(spark):
    postings = spark.createDataFrame([("brief ordnung", str(i)) for i in range(151)] + [("ordnung", "1")], "form string, id string")
    q = M.features(spark.createDataFrame([("a", "die Brief Ordnung")], "qid string, text string"))
    assert [(r.form, r.kept) for r in M.subject_candidates(q, postings).collect()] == [("brief ordnung", False)]


def test_rewrites_are_accepted_or_not(spark):
    assert column(spark, ["Wer?", "a\nb", "", None, "x" * 401], W.accepts_rewrite) == [True, False, False, False, False]


def test_answers_and_guards(spark):
    """A transport failure is asked again once, a refused request isn't; either guard asks again once; the error says how
    many letters were found."""
    rows = [
        ("busy", "t", False, "c", ["1"], []), ("down", "t", False, "c", ["1", "2"], []), ("denied", "t", False, "c", ["1"], []), ("invents", "t", False, "c", ["10001"], []),
        ("refuses", "t", False, "c", ["10001"], ["10001"]), ("none", "t", False, None, None, None), ("counts", "t", True, None, [], []), ("plain", "t", False, "c", ["1"], None),
    ]
    questions = spark.createDataFrame([(r[0], r[0], *r[2:], None) for r in rows], "qid string, text string, statistic boolean, context string, ids array<string>, evidence array<string>, history array<struct<role:string,content:string>>")
    calls = {}

    def model(messages):
        q = messages[0]["content"].rsplit("Frage: ", 1)[1]
        calls[q] = calls.get(q, 0) + 1
        if q == "busy" and calls[q] == 1:
            raise W.ServiceError("busy", 429)
        if q == "down":
            raise W.ServiceError("ECONNRESET")
        if q == "denied":
            raise W.ServiceError("no", 401)
        if q == "invents" and len(messages) == 1:
            return "Brief 99999"
        if q == "refuses" and len(messages) == 1:
            return "Keine der Quellen nennt es."
        return f"{calls[q]} Brief 10001" if q in ("invents", "refuses") else str(calls[q])

    got = {r.qid: (r.answer, r.citation_retry, r.refusal_retry, r.error) for r in W.answers(questions, model, pause=0).collect()}
    assert got["busy"] == ("2", False, False, None) and got["plain"] == ("1", False, False, None)
    assert got["invents"] == ("2 Brief 10001", True, False, None) and got["refuses"] == ("2 Brief 10001", False, True, None)
    assert got["down"][0] is None and "2 Briefe" in got["down"][3] and "401" in got["denied"][3]
    assert got["none"][0] == W.NOTHING_FOUND and got["counts"][0] == W.STATISTIC_ANSWER
    assert {r.answer for r in W.answers(questions, None).filter("qid IN ('busy', 'none')").collect()} == {None, W.NOTHING_FOUND}


def test_unscored_hits_stay(spark):
    hits = spark.createDataFrame(
        [("q", "1", 1, True, None), ("q", "2", 2, False, None), ("q", "3", 3, False, "3__volltext__000"), ("q", "4", 4, False, None)], "qid string, id string, rank int, keyword boolean, chunkid string"
    )
    questions = spark.createDataFrame([("q", "Siegel")], "qid string, text string")
    letters = spark.createDataFrame([("2", "ohne", ""), ("3", "nichts", None), ("9", "x", "x")], "id string, titel string, regest string")
    passages = spark.createDataFrame([("3__volltext__000", "das Siegel")], "chunkid string, text string")
    scorer = lambda q, t: F.when(F.length(t) > 0, F.when(t.contains("Siegel"), 0.9).otherwise(0.1))
    got = [(r.id, r.rank, r.rerank) for r in R.rerank(hits, questions, letters, passages, scorer).orderBy("rank").collect()]
    assert got == [("1", 1, None), ("3", 2, 0.9), ("4", 3, None)]
    assert R.rerank(hits, questions, letters, passages, None).select("id", "rank").collect() == hits.select("id", "rank").collect()


def test_scores_of_a_service(spark):
    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(500 if asked["query"] == "kaputt" else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"scores": [{"id": d["id"], "score": len(d["text"]) / 10} for d in asked["docs"] if d["text"]]}).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    pairs = spark.createDataFrame([("a", "eins"), ("a", ""), ("b", "drei"), ("kaputt", "zwei"), ("b", None)], "q string, t string")
    got = [r.s for r in pairs.select(R.service_scorer(url)(F.col("q"), F.col("t")).alias("s")).collect()]
    server.shutdown()
    server.server_close()
    assert got == [0.4, None, 0.4, None, None] and R.service_scorer(url) is None


def test_rows_are_numbered_over_all_tasks(spark):
    rows = [("a", i) for i in range(500)] + [("b", 1), (None, 7), (None, 8)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = {(r.k, r.v): r.nr for r in numbered(df, ["k"], [F.col("v").desc()], "nr").collect()}
    assert len(got) == 503 and all(got["a", i] == 500 - i for i in range(500)) and got["b", 1] == 1 and (got[None, 8], got[None, 7]) == (1, 2)
    assert numbered(df.limit(0), ["k"], [F.col("v")], "nr").count() == 0


def test_bitmap_containers():
    rng = np.random.default_rng(1)
    for p in ([], [5], list(range(100, 9_000)), sorted(rng.choice(32_768, 40, replace=False)), sorted(rng.choice(32_768, 9_000, replace=False)), list(range(32_768))):
        packed = O.pack(np.array(p, np.int64))
        assert O.unpack(packed).tolist() == [int(x) for x in p] and len(packed) <= 4_097
    assert len(O.pack(np.array([5]))) == 3 and len(O.pack(np.arange(100, 9_000))) == 5


def test_best_and_pair_scores_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x, q = rng.standard_normal((300, 8)), rng.standard_normal((3, 8))
    x[7] = x[3]
    vectors = spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)] + [("none", None)], "qid string, vector array<double>")
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    s = np.round(unit(q) @ unit(x).T, 6)
    want = {(f"q{i}", f"{j:03d}", r + 1) for i in range(3) for r, j in enumerate(np.lexsort((np.arange(300), -s[i]))[:10])}
    assert {(r.qid, r.id, r["rank"]) for r in X.best(vectors, asked, ["id"], 10, "id").collect()} == want
    pairs = spark.createDataFrame([("q1", "003"), ("q2", "299"), ("none", "001"), ("q1", "gone")], "qid string, id string")
    assert {(r.qid, r.id, r.score) for r in X.pair_scores(pairs, vectors, asked, "id").collect()} == {("q1", "003", s[1, 3]), ("q2", "299", s[2, 299])}
    assert X.best(vectors.limit(0), asked, ["id"], 10, "id").count() == 0 and X.best(vectors, asked.limit(0), ["id"], 10, "id").count() == 0


def test_torn_batch_is_written_anew(spark, tmp_path):
    """A batch whose files are there without its commit, as a run that died leaves it, is written again and counts once."""
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id string, text string"
    spark.createDataFrame([("1", "a"), ("2", "b")], schema).write.parquet(f"{src}/x")
    spark.createDataFrame([("1", "torn", [0.0], 0)], embedding.VECTORS).write.parquet(f"{out}/batch=0")
    embedding.run_available(spark, f"{src}/*", schema, out, state)
    rows = spark.read.schema(embedding.VECTORS).parquet(f"{out}/batch=*").collect()
    assert sorted(r.id for r in rows) == ["1", "2"] and all(r.hash != "torn" for r in rows)


def test_model_is_kept_and_checked(spark):
    assert embedding.model(8) is embedding.model(8)
    got = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(["Rat und Stadt", "", None, "rat, und STADT!"])], "i int, t string").select("i", embedding.embed(F.col("t"), 8).alias("v")).orderBy("i").collect()]
    assert got[0] == got[3] and sum(map(abs, got[0])) in (1.0, 3.0) and got[1] == got[2] == [0.0] * 8


def test_shared_folder():
    """The setting comes first, then a folder set in code; only a session on one machine goes without."""

    def session(master, conf=None, in_code=None):
        made = []
        sc = SimpleNamespace(master=master, getConf=lambda: conf or {}, getCheckpointDir=lambda: made[-1] if made else in_code, setCheckpointDir=made.append)
        return SimpleNamespace(sparkContext=sc, conf=conf or {})

    assert shared_dir(session("spark://x:1", {"spark.checkpoint.dir": "hdfs:///a/"}, "/b")) == "hdfs:///a"
    assert shared_dir(session("spark://x:1", in_code="hdfs:///b")) == "hdfs:///b"
    assert "missiva-" in shared_dir(session("local[4]"))
    for master in ("spark://x:1", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))


def test_measures(spark):
    hits = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "9")], "qid string, id string")
    gold = spark.createDataFrame([("a", "1"), ("a", "3"), ("c", "1")], "qid string, id string")
    got = {r.qid: (r.n_hits, r.n_gold, r.recall, r.precision) for r in E.recall_precision(hits, gold).collect()}
    assert got == {"a": (2, 2, 0.5, 0.5), "b": (1, 0, 0.0, 0.0), "c": (0, 1, 0.0, 0.0)}
    values = spark.createDataFrame([("k", float(v)) for v in (5, 1, 4, 2, 3)], "k string, v double")
    assert {r.share: r.value for r in E.floor_quantile(values, "v", ["k"], [0.0, 0.5, 0.9, 1.0]).collect()} == {0.0: 1, 0.5: 3, 0.9: 4, 1.0: 5}


def test_index_is_opened_and_not_rebuilt(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    first = P.index(spark, d, "subjects").subjects.count()

    def fail(*_):
        raise AssertionError("built again")

    monkeypatch.setattr(A, "subject_postings", fail)
    assert first and P.index(spark, d, "subjects").subjects.count() == first
    assert fingerprint(spark, [d]) == fingerprint(spark, [d]) != fingerprint(spark, [d], "other")


def test_gold_sets_are_numbered_rows(spark):
    rows = [("10", "offen", 1), ("9", "offen", 1), ("9", "offen", 1), ("x", "offen", 1), ("11", "intern", 1), ("12", "unbekannt", 1), ("5", "offen", None)]
    df = spark.createDataFrame(rows, "id string, sichtbar string, year int")
    got = {(r.year, r.side, r.nr, r.id) for r in E.by_visibility(df, ["year"]).collect()}
    assert got == {(1, "offen", 1, "9"), (1, "offen", 2, "10"), (1, "offen", 3, "x"), (1, "intern", 1, "11"), (1, "intern", 2, "12"), (None, "offen", 1, "5")}


def joined_rows(df):
    """Rows that the joins of a plan gave in all, once it was run."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        return (node.metrics().apply("numOutputRows").value() if "Join" in kind else 0) + sum(map(walk, below))

    return walk(df._jdf.queryExecution().executedPlan())


def test_letters_of_a_pair_under_any_spelling(spark):
    rows = [
        ("1", ["Meier, Hans"], ["Vogt"]), ("2", ["[Meier, Hans]", "Meier, Hans"], ["[Vogt]", "Vogt", "Vogt"]), ("3", ["Huber", "[Meier], Hans"], ["Vogt"]),
        ("4", ["Meier, Hans"], ["Huber"]), ("5", ["Huber"], ["Vogt"]), ("6", ["Meier, Hans"], []), ("7", [], ["Vogt"]), ("8", ["[Meier,  Hans]"], ["Vogt"]),
    ]
    letters = spark.createDataFrame(rows, "id string, senders array<string>, recipients array<string>")
    pairs = spark.createDataFrame([("Meier, Hans", "Vogt"), ("[Meier,  Hans]", "Vogt")], "sender string, recipient string")
    got = sorted(tuple(r) for r in E.spelled(letters, pairs).collect())
    assert got == [("Meier, Hans", "Vogt", i) for i in "123"] + [("[Meier,  Hans]", "Vogt", i) for i in "1238"]


def test_a_sender_of_many_pairs_meets_each_letter_once(spark):
    rows = [(str(i), ["Meier"], [f"Vogt {i}"]) for i in range(300)]
    letters = spark.createDataFrame(rows, "id string, senders array<string>, recipients array<string>")
    pairs = letters.selectExpr("senders[0] AS sender", "recipients[0] AS recipient")
    found = E.spelled(letters, pairs)
    assert found.count() == 300 and joined_rows(found) == 300


def test_tagged_and_untagged(spark):
    letters = spark.createDataFrame(
        [("1", "offen", "Ein TRAUM", ["Träume"]), ("2", "offen", "Traumbild", ["Eid"]), ("3", "intern", "Traum", []), ("4", "offen", None, ["Traum"]), ("5", "offen", "träumt", None)],
        "id string, sichtbar string, regest string, subjects array<string>",
    )
    split = E.tagged_split(letters, {"Traum": "tr[äa]um", "Komet": "komet"})
    assert {(r.term, r.id, r.tagged) for r in split.collect()} == {("Traum", "1", True), ("Traum", "2", False), ("Traum", "5", None)}
    of = split.filter("tagged IS NOT NULL").withColumnRenamed("term", "qid")
    hits = spark.createDataFrame([("Traum", "2"), ("Traum", "2"), ("Traum", "9")], "qid string, id string")
    assert [(r.qid, r.untagged, r.untagged_recall) for r in E.untagged_recall(hits, of).collect()] == [("Traum", 1, 1.0)]
    assert E.untagged_recall(hits, of.filter("tagged")).first()["untagged_recall"] is None


def test_responses_and_split(spark):
    sources = spark.createDataFrame(
        [("q", 1, "Embedding", 0.5, True), ("q", 2, "Passage volltext", 0.4, True), ("q", 3, "Person, Jahr", None, False), ("q", 4, "Embedding", None, False), ("q", 5, "Schlagwort", 0.9, False)],
        "qid string, rank int, reasons string, rerank double, in_context boolean",
    )
    cited, extra = R.cited_and_extra(sources)
    assert [r["rank"] for r in cited.orderBy("rank").collect()] == [1, 2] and extra.count() == 3
    assert [r["rank"] for r in R.embedding_only(sources).orderBy("rank").collect()] == [1, 2]


def test_percent_and_slug(spark):
    df = spark.createDataFrame([(0.666, "Kälte & Eis"), (None, None), (1.0, "")], "x double, s string")
    assert [tuple(r) for r in df.select(E.percent(F.col("x")), E.slug(F.col("s"))).collect()] == [("66.6%", "klteeis"), (None, None), ("100.0%", "")]


def test_abstracts_name_a_destination(spark):
    df = spark.createDataFrame([(["Bern"], ["Basel"]), ([], ["Basel", "Au"]), ([], [])], "a array<string>, b array<string>")
    none = F.array().cast("array<string>")
    made = A.abstract(F.lit(None).cast("string"), none, none, F.col("a"), F.lit(""), none, F.col("b"))
    assert [r[0] for r in df.select(made).collect()] == ["Brief, Bern.", "Brief, Zielort Basel / Au.", "Brief."]


def test_files(spark, tmp_path):
    path = str(tmp_path / "m.bin")
    x = np.arange(12, dtype="<f4")
    (tmp_path / "m.bin").write_bytes(x.tobytes() + b"\0\0")
    rows = sorted((r.row, r.embedding) for r in files.read_matrix(spark, path, 4, rows_per_task=2).collect())
    assert rows == [(i, x[4 * i : 4 * i + 4].tolist()) for i in range(3)]
    df = spark.createDataFrame([("1", "ä")], "id string, t string")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "id string, t string").collect() == df.collect()
    assert files.count_lines(spark, str(tmp_path / "j")) == 1
    assert files.optional(spark, str(tmp_path / "none"), "id string").count() == 0
    files.write_once(df, str(tmp_path / "base"))
    files.write_once(df.limit(0), str(tmp_path / "base"))
    assert spark.read.parquet(str(tmp_path / "base")).count() == 1


def test_stream_repeats_nothing(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id string, text string"
    spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "b")], schema).write.parquet(f"{src}/x")
    embedding.run_available(spark, f"{src}/*", schema, out, state)
    spark.createDataFrame([("1", "a"), ("2", "c"), ("3", None)], schema).write.parquet(f"{src}/y")
    embedding.run_available(spark, f"{src}/*", schema, out, state)
    rows = spark.read.schema(embedding.VECTORS).parquet(f"{out}/batch=*")
    assert rows.filter("id = '1'").count() == 1 and rows.filter("id = '2'").count() == 2
    now = spark.createDataFrame([("1", "a"), ("2", "c")], schema)
    assert {r.id for r in embedding.current(rows, now).collect()} == {"1", "2"}
