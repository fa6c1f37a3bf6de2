"""Queries of the checks that answers go through."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.operators import claims as op
from strataflow.plans.registry import query
from strataflow.sources.roles import role, with_

_HEDGE = r"(?i)\b(cannot|can''t|could not|unable to) (determine|tell|find|confirm|verify)\b|\bdoes not (specify|determine|state|contain|show)\b|\bnot (explicitly )?(stated|specified|shown|available)\b|\bno evidence\b"
#: Sentences, by a sign put behind their ends.
_SENTENCES = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def _two(spark, d, *names):
    return [role(spark, d, n) for n in names]


@query("c1_numeric_claims", with_("answers", "evidence", "numeric_facts") + rf""", p AS (SELECT answer_id, unnest(regexp_extract_all(text, '(?s)\d+(?:\.\d+)?|[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*|.')) AS piece, unnest(range(len(regexp_extract_all(text, '(?s)\d+(?:\.\d+)?|[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*|.')))) AS place FROM answers),
    a AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY answer_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_, lag(piece) OVER o AS b, lead(piece) OVER o AS n1, lead(piece, 2) OVER o AS n2 FROM p WINDOW o AS (PARTITION BY answer_id ORDER BY place)),
    hedged AS (SELECT DISTINCT answer_id, unnest(regexp_extract_all(s, '\b\d+(?:\.\d+)?')) AS piece FROM (SELECT answer_id, unnest({_SENTENCES}) AS s FROM answers) WHERE regexp_matches(s, '{_HEDGE}')),
    num AS (SELECT answer_id, piece AS number, at_, CAST(piece AS DOUBLE) AS v FROM a WHERE regexp_matches(piece, '^\d') AND NOT coalesce((b IS NULL OR b = chr(10)) AND n1 IN ('.', ')') AND n2 = ' ', false) AND NOT EXISTS (SELECT 1 FROM hedged h WHERE h.answer_id = a.answer_id AND h.piece = a.piece)),
    said AS (SELECT answer_id, at_ AS q, lower(string_split(piece, '.')[-1]) AS last FROM a WHERE regexp_matches(piece, '^[A-Za-z_]')),
    met AS (SELECT num.answer_id, number, num.at_, v, count(DISTINCT value) AS vs, min(value) AS value, max(CAST(line = v AS INT)) AS own FROM num JOIN said ON said.answer_id = num.answer_id AND abs(num.at_ - q) <= 150 JOIN numeric_facts f ON lower(string_split(f.symbol, '.')[-1]) = last GROUP BY ALL),
    wrong AS (SELECT DISTINCT answer_id, number FROM met WHERE vs = 1 AND value <> v AND own = 0 AND NOT (abs(value) > 0 AND abs(value) < 1 AND v >= 1 AND v = floor(v)))
    SELECT DISTINCT n.answer_id, n.number, CASE WHEN w.number IS NOT NULL THEN 'contradicted' WHEN v IN (SELECT value FROM numeric_facts) OR EXISTS (SELECT 1 FROM evidence e WHERE e.answer_id = n.answer_id AND contains(content, n.number)) THEN 'supported' ELSE 'unsupported' END AS verdict FROM num n LEFT JOIN wrong w ON w.answer_id = n.answer_id AND w.number = n.number""")
def c1_numeric_claims(spark, d):
    return op.numeric_claims(*_two(spark, d, "answers", "evidence", "numeric_facts"))


@query("c2_gap_check", with_("answers", "answer_gaps") + f" SELECT answer_id, list_sort(list(DISTINCT gap)) AS gaps, CASE WHEN regexp_matches(any_value(text), '{_HEDGE}') THEN 'pass' ELSE 'revise' END AS outcome, CASE WHEN regexp_matches(any_value(text), '{_HEDGE}') THEN '' ELSE 'The evidence does not determine the full answer due to missing facts. ' END || any_value(text) AS text FROM answers JOIN answer_gaps USING (answer_id) GROUP BY answer_id")
def c2_gap_check(spark, d):
    return op.gap_check(*_two(spark, d, "answers", "answer_gaps"))


@query("c4_fenced_code", with_("answers", "evidence") + r""", b AS (SELECT answer_id, unnest(regexp_extract_all(text, '(?s)```[a-zA-Z0-9_+-]*\n(.*?)```', 1)) AS code FROM answers), f AS (SELECT answer_id, trim(regexp_replace(code, '\s+', ' ', 'g')) AS code, list_filter(list_transform(string_split(code, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM b),
    e AS (SELECT answer_id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS c FROM evidence)
    SELECT f.answer_id, 0 AS block, code, coalesce(bool_or(contains(c, code) OR c LIKE '%' || array_to_string(list_transform(lines, lambda x: replace(replace(x, '%', '\%'), '_', '\_')), '%') || '%' ESCAPE '\'), false) AS supported FROM f LEFT JOIN e ON e.answer_id = f.answer_id WHERE length(code) >= 20 GROUP BY ALL""")
def c4_fenced_code(spark, d):
    return op.fenced_code(*_two(spark, d, "answers", "evidence"))


@query("c5_mentioned_paths", with_("answers", "evidence") + r""", m AS (SELECT DISTINCT answer_id, unnest(regexp_extract_all(text, '\b[\w-]+\.(?:ts|js|py|json|md|tsx|jsx)\b')) AS path FROM answers)
    SELECT m.answer_id, path, EXISTS (SELECT 1 FROM evidence e WHERE e.answer_id = m.answer_id AND (suffix(file, path) OR contains(content, path))) AS supported FROM m""")
def c5_mentioned_paths(spark, d):
    return op.mentioned_paths(*_two(spark, d, "answers", "evidence"))


@query("c6_fallback_order", "WITH RECURSIVE " + with_("answers", "fallback_facts").removeprefix("WITH ") + """, ch AS (SELECT unit, list(symbol ORDER BY place) AS chain FROM (SELECT unit, symbol, min(place) AS place FROM fallback_facts GROUP BY ALL) GROUP BY unit),
    s AS (SELECT answer_id, unit, text, chain, 1 AS at_, 1 AS k, CAST([] AS VARCHAR[]) AS bad FROM answers, ch WHERE len(list_filter(chain, lambda x: contains(text, x))) > 0
        UNION ALL SELECT answer_id, unit, text, chain, CASE WHEN instr(substr(text, at_), chain[k]) > 0 THEN at_ + instr(substr(text, at_), chain[k]) - 1 ELSE at_ END, k + 1, CASE WHEN instr(substr(text, at_), chain[k]) = 0 AND contains(text, chain[k]) THEN list_append(bad, chain[k]) ELSE bad END FROM s WHERE k <= len(chain))
    SELECT answer_id, unit, bad AS out_of_order FROM s WHERE k = len(chain) + 1""")
def c6_fallback_order(spark, d):
    return op.fallback_order(*_two(spark, d, "answers", "fallback_facts"))


_PATH = r"(?:[\w.-]+/)+[\w.-]+\.(?:py|ts|tsx|js|jsx|java|go|rs|cs|rb)"


@query("c7_equivalence_claims", with_("answers", "code_files") + rf""", s AS (SELECT answer_id, unnest({_SENTENCES}) AS s FROM answers), m AS (SELECT answer_id, s, unnest(list_distinct(regexp_extract_all(s, '{_PATH}'))) AS path FROM s WHERE regexp_matches(s, '(?i)\b(identical|same code|no functional difference|no difference|equivalent|duplicate of|exactly the same)\b'))
    SELECT answer_id, list_sort(list(DISTINCT path)) AS files, count(DISTINCT rtrim(content)) = 1 AS "true" FROM m JOIN code_files USING (path) GROUP BY answer_id, s HAVING count(DISTINCT path) >= 2""")
def c7_equivalence_claims(spark, d):
    return op.equivalence_claims(*_two(spark, d, "answers", "code_files"))


@query("c7_technology_claims", with_("answers") + rf""", t(technology) AS (VALUES ('Celery'), ('GraphQL'), ('Redis'), ('Kafka'), ('Spark'), ('Flask'), ('Stripe')), m AS (SELECT answer_id, technology, text FROM answers, t WHERE regexp_matches(text, '(?i)\b' || technology || '\b'))
    SELECT answer_id, technology FROM m WHERE len(list_filter(regexp_extract_all(text, '(?is).{{0,120}}\b' || technology || '\b.{{0,120}}'), lambda x: regexp_matches(x, '(?i)(uses?|using|used|leverages?|relies\s+on|is\s+built\s+(on|with)|is\s+handled\s+by|is\s+managed\s+by|runs?\s+on|integrates?\s+with|powered\s+by|via|through|with)'))) > 0
        AND len(list_filter({_SENTENCES}, lambda s: regexp_matches(s, '(?i)\b' || technology || '\b') AND NOT regexp_matches(s, '(?i)\b(not|no|never|n''t|without|absent|does\s+not|doesn''t|isn''t|aren''t|lacks?|there\s+is\s+no|nowhere|instead\s+of|rather\s+than|unlike)\b'))) > 0 AND technology <> 'Spark'""")
def c7_technology_claims(spark, d):
    present = spark.range(1).select(F.lit("spark").alias("technology"))
    return op.technology_claims(role(spark, d, "answers"), present, technologies=("Celery", "GraphQL", "Redis", "Kafka", "Spark", "Flask", "Stripe"))


@query("c7_relation_claims", with_("answers", "code_files") + rf""", c AS (SELECT answer_id, unnest(regexp_extract_all(text, '`?({_PATH})`?([^.\n]{{0,80}}?\b(?:calls?|uses?|depends?\s+on|invokes?|instantiates?|references?|imports?|consumes?)\b[^.\n]{{0,60}}?)`([A-Za-z_]\w*)`')) AS clause FROM answers),
    k AS (SELECT DISTINCT answer_id, regexp_extract(clause, '{_PATH}') AS path, regexp_extract(clause, '`([A-Za-z_]\w*)`$', 1) AS symbol FROM c WHERE NOT regexp_matches(clause, '(?i)\b(not|never|no|nowhere|without)\b|n''t\b'))
    SELECT answer_id, path, symbol, CASE WHEN NOT regexp_matches(content, '\b' || symbol || '\b') THEN 'absent' WHEN NOT regexp_matches(regexp_replace(content, '(?:def|class|function|func|fn|const|let|var)\s+' || symbol || '\b', ' ', 'g'), '\b' || symbol || '\b') THEN 'defines' ELSE 'holds' END AS verdict FROM k JOIN code_files USING (path)""")
def c7_relation_claims(spark, d):
    return op.relation_claims(*_two(spark, d, "answers", "code_files"))


@query("c11_dead_files", with_("code_files", "import_edges") + r""" SELECT path FROM code_files WHERE path NOT IN (SELECT dst FROM import_edges WHERE src <> dst) AND string_split(path, '/')[-1] NOT IN ('main.py', 'app.py', '__main__.py', 'manage.py', 'wsgi.py', 'asgi.py', 'index.ts', 'index.js', 'server.ts', 'server.js', '__init__.py', 'index.tsx', 'index.jsx', 'mod.rs')
    AND NOT regexp_matches(content, '\bAPIRouter\s*\(|\bclass\s+\w*Middleware\b|\bBlueprint\s*\(|\brouter\s*=\s*Router\s*\(') AND NOT contains(content, 'if __name__ == "__main__"')""")
def c11_dead_files(spark, d):
    return op.dead_files(*_two(spark, d, "code_files", "import_edges"))


@query("c9_cited_symbols", with_("answers", "code_files") + rf""", s AS (SELECT answer_id, unnest({_SENTENCES}) AS s FROM answers), p AS (SELECT answer_id, s, unnest(list_distinct(regexp_extract_all(s, '{_PATH}'))) AS path FROM s), n AS (SELECT DISTINCT answer_id, path, unnest(list_distinct(regexp_extract_all(s, '`([A-Za-z_]\w*)`', 1))) AS symbol FROM p)
    SELECT answer_id, path, symbol, regexp_matches(content, '\b' || symbol || '\b') AS found FROM n JOIN code_files USING (path)""")
def c9_cited_symbols(spark, d):
    return op.cited_symbols(*_two(spark, d, "answers", "code_files"))
