"""Answers over the letters found, by whatever model is given as a callable, with the guards around it.

A model is a function of messages, a list of {"role", "content"}, to a text; it may raise ServiceError. Each question is
answered where its row is, so questions are spread over all tasks."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.functions import text as T
from missiva.operators.archive import DEFAULT, Params

#: What is answered without a model.
STATISTIC_ANSWER = "Diese Frage betrifft das gesamte Archiv (Zählung oder Statistik) und kann aus einzelnen Briefen nicht beantwortet werden."
NOTHING_FOUND = "Zu dieser Frage findet sich im Archiv kein hinreichend relevanter Brief."
_CITED = re.compile(r"Brief\s+(?:Nr\.?\s*)?(\d{3,6})", re.I)
_REFUSAL = re.compile(T.REFUSAL_START, re.I)
Model = Callable[[list[dict]], str]


class ServiceError(Exception):
    """A model that couldn't be reached, or said why it failed by an HTTP status."""

    def __init__(self, cause: str, status: int | None = None):
        super().__init__(cause)
        self.status = status


def validated(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests(rid, message): those that can be asked, and those that can't, with the reason. A null or empty message is
    none; blanks are, as published."""
    ok = F.coalesce(F.col("message") != "", F.lit(False))
    return requests.filter(ok), requests.filter(~ok).select("rid", F.lit("Missing 'message' string in request body.").alias("error"))


def accepts_rewrite(answer: Column) -> Column:
    """Whether a model's rewriting of a question is usable: one line, not empty, at most 400 signs."""
    t = F.trim(answer)
    return F.coalesce((F.length(t) > 0) & (F.length(t) <= 400) & ~t.contains("\n"), F.lit(False))


def rewritten(questions: DataFrame, rewrite: Callable[[str, str], str]) -> DataFrame:
    """questions(qid, text, transcript): text is replaced by the model's reading of it in the light of the transcript, if
    there is one and it is usable; a model that fails costs nothing but the rewriting."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, before in zip(b["text"], b["transcript"]):
                try:
                    out.append(rewrite(before, text) if before else None)
                except Exception:  # noqa: BLE001 - any failure falls back to the question
                    out.append(None)
            yield b[["qid", "text"]].assign(proposed=out)

    rows = questions.select("qid", "text", "transcript").mapInPandas(run, "qid string, text string, proposed string")
    proposed = F.trim("proposed")
    return rows.select("qid", F.when(accepts_rewrite(F.col("proposed")), proposed).otherwise(F.col("text")).alias("text"), (accepts_rewrite(F.col("proposed")) & (proposed != F.col("text"))).alias("rewritten"))


def _asked(generate: Model, messages: list[dict], pause: float) -> str:
    """One retry after a pause if the service wasn't reached, was busy or broke; not if it refused the request."""
    try:
        return generate(messages) or ""
    except ServiceError as e:
        if e.status is not None and e.status < 500 and e.status != 429:
            raise
        time.sleep(pause)
        return generate(messages) or ""


def answer_one(question: str, context: str, ids: list[str], evidence: list[str], history: list[dict], generate: Model, pause: float, p: Params) -> tuple[str, bool, bool]:
    """(answer, asked again for a citation, asked again for a refusal); what comes of asking again isn't checked again."""
    messages = [*history, {"role": "user", "content": f"Quellenausschnitte:\n\n{context}\n\nFrage: {question}"}]
    again = lambda said, correction: _asked(generate, [*messages, {"role": "assistant", "content": said}, {"role": "user", "content": correction}], pause)
    answer = _asked(generate, messages, pause)
    known = set(ids)
    invented = [i for i in dict.fromkeys(_CITED.findall(answer)) if i not in known]
    if invented:
        answer = again(answer, f"Nicht in den Quellen: {', '.join(invented)}. Bitte nur Briefe aus den Quellen nennen.")
    refused = bool(evidence) and bool(_REFUSAL.search(answer.strip()[:160]))
    if refused:
        named = ", ".join(evidence[: p.evidence_max]) + (" u. a." if len(evidence) > p.evidence_max else "")
        answer = again(answer, f"Diese Briefe passen zur Frage: {named}. Bitte mit ihnen antworten.")
    return answer, bool(invented), refused


def answers(questions: DataFrame, generate: Model | None, pause: float = 2.0, p: Params = DEFAULT) -> DataFrame:
    """questions(qid, text, statistic, context, ids, evidence, history array<struct<role,content>>):
    (qid, answer, citation_retry, refusal_retry, error). Without letters the answer is a fixed one; a service that fails
    gives no answer but an error that says how many letters were found. No model answers only what needs none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                ids = [] if r.ids is None else list(r.ids)
                if not ids:
                    rows.append((r.qid, STATISTIC_ANSWER if r.statistic else NOTHING_FOUND, False, False, None))
                    continue
                if generate is None:
                    rows.append((r.qid, None, False, False, None))
                    continue
                history = [dict(t) if isinstance(t, dict) else {"role": t[0], "content": t[1]} for t in (r.history if r.history is not None else [])]
                try:
                    got = answer_one(r.text, r.context or "", ids, [] if r.evidence is None else list(r.evidence), history, generate, pause, p)
                    rows.append((r.qid, *got, None))
                except ServiceError as e:
                    rows.append((r.qid, None, False, False, f"{len(ids)} Briefe gefunden, aber der Antwortdienst ist nicht erreichbar ({e.status or e})."))
            yield pd.DataFrame(rows, columns=["qid", "answer", "citation_retry", "refusal_retry", "error"])

    wanted = questions.select("qid", "text", "statistic", "context", "ids", "evidence", "history")
    return wanted.mapInPandas(run, "qid string, answer string, citation_retry boolean, refusal_retry boolean, error string")


def listing(messages: list[dict]) -> str:
    """Offline stand-in for a text model: names the first three letters of the context. So that the guards have work, it
    first invents a number where the question has "Waldstreit" and refuses where it has "Vorwürfe"."""
    asked = next(m["content"] for m in messages if m["content"].startswith("Quellenausschnitte"))
    question = asked.rsplit("Frage: ", 1)[-1]
    first = messages[-1]["content"] is asked
    named = ", ".join(f"Brief {i}" for i in re.findall(r"^\[\d+\] Brief (\S+) \(", asked, re.M)[:3])
    if first and "Vorwürfe" in question:
        return "Die vorliegenden Briefe enthalten dazu keine Informationen."
    return f"Dazu: {named}{', Brief 99999' if first and 'Waldstreit' in question else ''}."
