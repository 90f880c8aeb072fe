"""Pieces of DuckDB SQL that say the same as missiva.functions.text and the archive's derived tables."""

from __future__ import annotations

from missiva.functions import text as T
from missiva.operators.archive import DEFAULT


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def stem(w: str) -> str:
    f = f"replace(replace(replace(replace({w}, 'ä', 'a'), 'ö', 'o'), 'ü', 'u'), 'ß', 'ss')"
    return (
        f"(CASE WHEN length({f}) > 5 AND right({f}, 2) IN ('en', 'er', 'em', 'es') THEN left({f}, length({f}) - 2) "
        f"WHEN length({f}) > 4 AND right({f}, 1) IN ('e', 'n', 's') THEN left({f}, length({f}) - 1) ELSE {f} END)"
    )


def words(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: w <> '')"


def stems(x: str) -> str:
    return f"list_transform({words(x)}, lambda v: {stem('v')})"


def filled(x: str) -> str:
    return f"list_filter(coalesce({x}, []), lambda y: y IS NOT NULL AND y <> '')"


def subject_forms(x: str) -> str:
    bare = f"regexp_replace({x}, '\\s*\\([^)]*\\)', '', 'g')"
    parts = f"CASE WHEN contains({bare}, ',') THEN list_filter(list_transform(string_split({bare}, ','), lambda z: {norm('z')}), lambda z: regexp_matches(z, '\\p{{L}}') AND contains(z, ' ')) ELSE []::VARCHAR[] END"
    return f"list_distinct(list_filter(list_concat([{norm(x)}, {norm(bare)}], {parts}), lambda z: length(z) >= 4))"


def last(table: str, key: str, order: str, where: str) -> str:
    return f"(SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k FROM {table} WHERE {where}) WHERE k = 1)"


def abstract(kind: str, senders: str, recipients: str, places: str, date: str, subjects: str, received: str = "[]::VARCHAR[]") -> str:
    return (
        f"concat_ws(', ', concat_ws(' ', coalesce(nullif({kind}, ''), 'Brief'), CASE WHEN len({senders}) > 0 THEN 'von ' || array_to_string({senders}, ' und ') END, "
        f"CASE WHEN len({recipients}) > 0 THEN 'an ' || array_to_string({recipients}, ' und ') END), CASE WHEN len({places}) > 0 THEN array_to_string({places}, ' / ') WHEN len({received}) > 0 THEN 'Zielort ' || array_to_string({received}, ' / ') END, nullif({date}, '')) || '.' || "
        f"CASE WHEN len({subjects}) > 0 THEN ' Themen: ' || array_to_string({subjects}, ', ') || '.' ELSE '' END"
    )


CORPUS = f"""let0 AS (
  SELECT id, '{DEFAULT.url}' || id AS url, coalesce(nullif(sichtbar, ''), 'unbekannt') AS sichtbar, titel, textsorte, dateiso AS date_iso,
    {filled('senders')} AS senders, {filled('recipients')} AS recipients, nullif(trim(regest), '') AS editorial, {filled('keywordsubjects')} AS subjects, trim(incipit) AS incipit
  FROM {last('corpus', 'id', 'built_at DESC NULLS LAST', "id IS NOT NULL AND id <> ''")}
), let AS (
  SELECT *, coalesce(editorial, {abstract('textsorte', 'senders', 'recipients', '[]::VARCHAR[]', 'date_iso', 'subjects')}) AS regest, editorial IS NULL AS synthetic FROM let0
), pub AS (SELECT * FROM let WHERE sichtbar = 'offen')"""

FULLTEXT = f"""ft AS (SELECT * FROM (
  SELECT id, coalesce(nullif(sichtbar, ''), 'unbekannt') AS sichtbar, nullif(trim(volltext), '') AS volltext, nullif(trim(erlaeuterung), '') AS erlaeuterung
  FROM {last('fulltext', 'id', 'changed_at DESC NULLS LAST', 'id IS NOT NULL')}) WHERE volltext IS NOT NULL OR erlaeuterung IS NOT NULL)"""

LABELS = """lab AS (
  SELECT ref_id, short, list_filter(list_transform(coalesce(alternativen, []), lambda a: a.text.v), lambda y: y IS NOT NULL AND y <> '') AS variants
  FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY created_at DESC NULLS LAST, short) AS k FROM (
    SELECT lower(regexp_extract(ref_id, '[0-9A-Fa-f]{24}')) AS ref_id, short, alternativen, created_at FROM saches WHERE deleted_at IS NULL AND trim(short) <> '')) WHERE k = 1
)"""

SUBJECT_POSTINGS = f"""tags AS (SELECT id, unnest(subjects) AS label FROM pub),
tags2 AS (SELECT id, label FROM tags UNION ALL SELECT t.id, v FROM tags t JOIN (SELECT short, unnest(variants) AS v FROM lab) l ON t.label = l.short),
sp AS (SELECT DISTINCT unnest({subject_forms('label')}) AS form, id FROM tags2)"""


def person_postings(name: str, side: str) -> str:
    base = norm("split_part(name, ',', 1)")
    return f"""{name}0 AS (SELECT id, unnest({side}) AS name FROM pub),
{name}1 AS (SELECT id, unnest(list_filter([{norm('name')}, {base}, CASE WHEN contains({base}, ' ') THEN split_part({base}, ' ', -1) END], lambda z: z IS NOT NULL AND length(z) >= 4)) AS form FROM {name}0),
{name} AS (SELECT DISTINCT form, id FROM (SELECT form, id FROM {name}1 UNION ALL SELECT * FROM (SELECT array_to_string({stems('form')}, ' ') AS form, id FROM {name}1) WHERE length(form) >= 5))"""


PERSONS = person_postings("snd", "senders") + ",\n" + person_postings("rcp", "recipients")

STEM_TEXT = f"""st AS (
  SELECT p.id, list_concat(coalesce({stems('editorial')}, []), coalesce({stems('erlaeuterung')}, [])) AS stems,
    CASE WHEN editorial IS NOT NULL THEN ' ' || array_to_string({stems('editorial')}, ' ') || ' ' ELSE '' END ||
    CASE WHEN erlaeuterung IS NOT NULL THEN ' ' || array_to_string({stems('erlaeuterung')}, ' ') || ' ' ELSE '' END AS stem_text
  FROM pub p LEFT JOIN ft f ON p.id = f.id WHERE editorial IS NOT NULL OR erlaeuterung IS NOT NULL
), stp AS (SELECT DISTINCT stem, id FROM (SELECT unnest(stems) AS stem, id FROM st) WHERE length(stem) >= 3)"""


def vectors(name: str, table: str, key: str) -> str:
    good = "len(embedding) = dim AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0"
    return f"{name} AS {last(table, key, 'updated_at DESC NULLS LAST, vec_no', f'embedding IS NOT NULL AND {key} IS NOT NULL AND {good}')}"


VECTORS = vectors("lv", "letter_vectors", "id") + ",\n" + vectors("cv", "chunk_vectors", "chunkid")

STOP = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"


def features(questions: str) -> str:
    """CTE q over VALUES rows (qid, text)."""
    terms = f"list_transform(list_filter({words('text')}, lambda w: length(w) >= 4 AND w NOT IN {STOP} AND regexp_matches(w, '\\p{{L}}')), lambda v: {stem('v')})"
    # list_distinct keeps no order, so the first place of each term is kept by hand.
    return f"""q0 AS (SELECT * FROM (VALUES {questions}) t(qid, text)),
q AS (SELECT qid, text, {norm('text')} AS normal, array_to_string({stems('text')}, ' ') AS stemmed,
  list_filter({terms}, lambda x, i: list_position({terms}, x) = i) AS terms,
  CASE WHEN regexp_matches(lower(text), '\\b(jahr\\w*|datiert)\\b') THEN list_distinct(regexp_extract_all(text, '\\b(1[4-6]\\d\\d)\\b', 1)) ELSE [] END AS years,
  list_distinct(regexp_extract_all(lower(text), '\\bbrief\\w*\\s+(?:nr\\.?\\s*)?(\\d{{3,6}})\\b', 1)) AS ids,
  regexp_matches(lower(text), '\\b{T.AGGREGATE}\\b') AS statistic FROM q0)"""


SUBJECTS = f"""sc AS (SELECT DISTINCT qid, form FROM q, (SELECT DISTINCT form FROM sp) f WHERE contains(' ' || normal || ' ', ' ' || form || ' ')
    OR contains(' ' || stemmed || ' ', ' ' || form || ' ') OR (length(normal) >= 4 AND contains(' ' || form || ' ', ' ' || normal || ' '))),
sc2 AS (SELECT qid, c.form, letters, letters <= {DEFAULT.max_bucket} AS kept FROM sc c JOIN (SELECT form, count(*) AS letters FROM sp GROUP BY form) s ON c.form = s.form
  WHERE NOT EXISTS (SELECT 1 FROM sc o WHERE o.qid = c.qid AND o.form <> c.form AND contains(' ' || o.form || ' ', ' ' || c.form || ' ')))"""


def side(name: str, postings: str) -> str:
    return f"""{name}c AS (SELECT DISTINCT qid, form FROM q, (SELECT DISTINCT form FROM {postings}) f WHERE contains(' ' || normal || ' ', ' ' || form || ' ')),
{name}k AS (SELECT qid, form FROM {name}c c WHERE NOT EXISTS (SELECT 1 FROM {name}c o WHERE o.qid = c.qid AND o.form <> c.form AND contains(' ' || o.form || ' ', ' ' || c.form || ' ')))"""


PERSON_MATCH = (
    side("sn", "snd")
    + ",\n"
    + side("rc", "rcp")
    + f""",
two AS (SELECT DISTINCT qid FROM snk WHERE qid IN (SELECT qid FROM rck)),
pm AS (
  SELECT qid, id, TRUE AS exact FROM (SELECT qid, id FROM snk JOIN snd USING (form) WHERE qid IN (SELECT qid FROM two) INTERSECT SELECT qid, id FROM rck JOIN rcp USING (form) WHERE qid IN (SELECT qid FROM two))
  UNION ALL SELECT DISTINCT qid, id, FALSE FROM (
    SELECT k.qid, p.id FROM snk k JOIN snd p USING (form) WHERE contains(form, ' ') AND form IN (SELECT form FROM snd GROUP BY form HAVING count(*) <= {DEFAULT.max_bucket})
    UNION ALL SELECT k.qid, p.id FROM rck k JOIN rcp p USING (form) WHERE contains(form, ' ') AND form IN (SELECT form FROM rcp GROUP BY form HAVING count(*) <= {DEFAULT.max_bucket}))
  WHERE qid NOT IN (SELECT qid FROM two))"""
)

YEARS = "ym AS (SELECT DISTINCT qid, id FROM (SELECT qid, unnest(years) AS y FROM q) JOIN pub ON left(date_iso, 4) = y)"
IDS = "im AS (SELECT DISTINCT qid, p.id FROM (SELECT qid, unnest(ids) AS i FROM q) JOIN pub p ON p.id = i)"

TEXTS = f"""qt AS (SELECT qid, len(terms) AS n, terms, unnest(terms) AS term FROM q WHERE len(terms) > 0),
th AS (SELECT DISTINCT qid, n, terms, term, id FROM qt JOIN stp ON stem = term OR (length(term) >= 4 AND starts_with(stem, term) AND length(stem) <= length(term) + 12)),
ta AS (SELECT qid, n, any_value(terms) AS terms, id FROM th GROUP BY qid, n, id HAVING count(DISTINCT term) = n),
tf AS (SELECT qid, t.id FROM ta t JOIN st USING (id) WHERE n = 1 OR contains(stem_text, ' ' || array_to_string(terms, ' ') || ' ')),
tm AS (SELECT qid, id FROM tf WHERE qid IN (SELECT qid FROM tf GROUP BY qid HAVING count(*) <= {DEFAULT.max_bucket}))"""
