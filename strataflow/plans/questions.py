"""Queries of question planning and of intent extraction.

The SQL is written from the fixed values in `functions.questions`, so they are stated once; whether they are right is up to
tests/test_questions.py, a table of questions and what they ask for, written by hand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.functions import questions as fn
from strataflow.operators import history as hist
from strataflow.plans.registry import query
from strataflow.sources.roles import role, with_

def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _texts(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _case(rules: list[tuple[str, str]], otherwise: str) -> str:
    """The name of the first rule whose pattern matches t."""
    return "CASE " + " ".join(f"WHEN regexp_matches(t, {_text(pattern)}) THEN {_text(name)}" for name, pattern in rules) + f" ELSE {otherwise} END"


def _count(words, how: str) -> str:
    return f"len(list_filter({_texts(words)}, lambda x: {how}))"


_Q = with_("questions") + ", q AS (SELECT id, text, lower(text) AS t FROM questions)"


_INSIDE = "CASE WHEN regexp_matches(t, 'threshold|limit|max|min') AND NOT contains(t, 'admin') THEN 'threshold' ELSE 'unknown' END"


@query("text_question_type", f"{_Q} SELECT id, {_case(fn.QUESTION_TYPES, _INSIDE)} AS type FROM q")
def text_question_type(spark, d):
    return role(spark, d, "questions").select("id", fn.question_type(F.col("text")).alias("type"))


_INSIDE_T, _WORD_T = "contains(t, x)", r"regexp_matches(t, '\b' || x || '\b')"


@query("text_complexity", _Q + rf""", k AS (SELECT id, t, string_split_regex(text, '\s+') AS w FROM q),
    p AS (SELECT id, CAST(len(w) > 7 AS INT) + {_count(fn.RELATION_WORDS, _INSIDE_T)} + {_count(fn.SYSTEM_WORDS, _WORD_T)} + {_count(fn.TROUBLE_WORDS, _INSIDE_T)}
        + len(list_filter(w, lambda x: list_contains({_texts(fn.CONJUNCTIONS)}, lower(x)))) + 2 * {_count(fn.REASON_WORDS, _INSIDE_T)}
        + CASE WHEN id % 4 = 0 AND (len(w) <= 6 OR regexp_matches(t, {_text(fn.FOLLOW_UP)})) THEN 2 ELSE 0 END AS score FROM k)
    SELECT id, CAST(score AS INT) AS score, CASE WHEN score >= 2 THEN 'complex' ELSE 'simple' END AS kind FROM p""")
def text_complexity(spark, d):
    score = fn.complexity(F.col("text"), F.col("id") % 4 == 0)
    return role(spark, d, "questions").select("id", score.alias("score"), F.when(score >= 2, "complex").otherwise("simple").alias("kind"))


_INTENT = _case(fn.INTENTS, "'explanation'")
_STRATEGY = _case(fn.STRATEGIES, "NULL")
_OF_INTENT = "CASE intent " + " ".join(f"WHEN {_text(a)} THEN {_text(b)}" for a, b in fn.OF_INTENT.items()) + " END"
_CHUNKS = "(VALUES " + ", ".join(f"({_text(k)}, {a}, {b})" for k, (a, b) in fn.CHUNKS.items()) + ") b(strategy, least, most)"


@query("text_intent", _Q + f" SELECT id, {_INTENT} AS intent FROM q")
def text_intent(spark, d):
    return role(spark, d, "questions").select("id", fn.intent(F.lower("text")).alias("intent"))


@query("text_strategy", _Q + f""", s AS (SELECT id, {_STRATEGY} AS own, {_INTENT} AS intent FROM q), c AS (SELECT id, own IS NOT NULL AS met, coalesce(own, {_OF_INTENT}) AS strategy FROM s)
    SELECT id, strategy, least, most, CASE WHEN met THEN 0.7 ELSE 0.6 END AS confidence FROM c JOIN {_CHUNKS} USING (strategy)""")
def text_strategy(spark, d):
    return role(spark, d, "questions").select("id", fn.strategy(F.lower("text")).alias("s")).select("id", "s.strategy", "s.least", "s.most", F.col("s.confidence").cast("decimal(2,1)").alias("confidence"))


#: Weights in tenths, so that sums and comparisons are exact.
_ROUTES = "(VALUES " + ", ".join(f"({k}, {_text(name)}, {_text(phrase)}, {round(10 * weight)})" for k, (name, phrases) in enumerate(fn.ROUTES.items()) for phrase, weight in phrases.items()) + ") r(k, name, phrase, weight)"


@query("text_route", _Q + rf""", s AS (SELECT id, k, name, least(10, sum(CASE WHEN regexp_matches(t, '\b' || phrase || '\b') THEN weight ELSE 0 END)) AS s FROM q, {_ROUTES} GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, k) AS rn FROM s), f AS (SELECT a.id, a.name AS n1, a.s AS s1, b.name AS n2, b.s AS s2 FROM o a JOIN o b ON b.id = a.id AND a.rn = 1 AND b.rn = 2)
    SELECT id, CASE WHEN s1 >= 6 THEN n1 ELSE 'EXPLANATION' END AS primary_route, CASE WHEN s1 >= 6 THEN s1 / 10 ELSE 0.5 END AS score, CASE WHEN s1 >= 6 AND s2 >= 6 AND s1 - s2 <= 1 THEN n2 END AS secondary_route FROM f""")
def text_route(spark, d):
    return role(spark, d, "questions").select("id", fn.route(F.col("text")).alias("r")).select("id", F.col("r.primary").alias("primary_route"), "r.score", F.col("r.secondary").alias("secondary_route"))


@query("text_primary_entity", _Q + r""", e AS (SELECT id, trim(regexp_extract(text, '["'']([^"'']{2,60})["'']', 1)) AS quoted, regexp_extract(text, '\b([A-Z][a-zA-Z0-9]{2,})\b', 1) AS symbol, regexp_extract(text, '\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b', 1) AS snake,
        array_to_string(list_filter(string_split_regex(lower(trim(regexp_extract(text, '(?i)\bwhere\s+(?:is|are|can\s+I\s+find)\s+(?:the\s+)?(.+?)(?:\s+(?:feature|functionality|module|system|component|logic|code|executed|implemented|defined|located|handled|used|called|in\s+the\s+project))', 1))), '\s+'), lambda w: length(w) > 2 AND NOT list_contains(""" + _texts(fn.QUALIFIERS) + r""", w)), '_') AS noun,
        array_to_string(list_filter(string_split_regex(regexp_replace(t, '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND NOT list_contains(""" + _texts(fn.STOP_WORDS) + r""", w))[1:2], '_') AS phrase FROM q)
    SELECT id, CASE WHEN quoted <> '' THEN quoted WHEN symbol <> '' THEN symbol WHEN snake <> '' THEN snake WHEN noun <> '' THEN noun ELSE phrase END AS entity, CASE WHEN quoted <> '' OR symbol <> '' THEN 1.0 WHEN snake <> '' THEN 0.8 WHEN noun <> '' THEN 0.85 WHEN phrase <> '' THEN 0.6 ELSE 0.0 END AS confidence FROM e""")
def text_primary_entity(spark, d):
    return role(spark, d, "questions").select("id", fn.primary_entity(F.col("text")).alias("e")).select("id", "e.entity", F.col("e.confidence").cast("decimal(3,2)").alias("confidence"))


_PURPOSES = "(VALUES " + ", ".join(f"({_text(kind)}, {_text(topic)}, {_text(pattern)})" for kind, topic, pattern in fn.PURPOSES) + ") r(type, topic, pattern)"
_CONFIDENCE = "CASE source_type " + " ".join(f"WHEN {_text(a)} THEN {b}" for a, b in fn.SOURCE_CONFIDENCE.items()) + " END"
_EVIDENCE = with_("intent_sources") + f", ev AS (SELECT sha256(type || ':' || topic) AS intent_id, type, topic, source_type, source_id, regexp_extract(text, '(?i)' || pattern, 0) AS snippet, created_at FROM intent_sources, {_PURPOSES} WHERE regexp_matches(text, '(?i)' || pattern))"


@query("intent_evidence", f"{_EVIDENCE} SELECT intent_id, source_type, source_id, snippet FROM ev")
def intent_evidence(spark, d):
    return hist.intent_evidence(role(spark, d, "intent_sources")).select("intent_id", "source_type", "source_id", "snippet")


@query("r27_intent_extraction", f"{_EVIDENCE} SELECT intent_id, type, topic, max({_CONFIDENCE}) AS confidence, count(*) AS evidence_count, count(*) FILTER (source_type = 'ADR') AS adr_count, count(*) FILTER (source_type = 'PR') AS pr_count, count(*) FILTER (source_type = 'COMMIT') AS commit_count, CAST(min(created_at) AS DATE) AS first_seen, CAST(max(created_at) AS DATE) AS last_seen FROM ev GROUP BY ALL")
def r27_intent_extraction(spark, d):
    found = hist.intents(hist.intent_evidence(role(spark, d, "intent_sources")))
    return found.withColumns({"confidence": F.col("confidence").cast("decimal(2,1)"), "first_seen": F.col("first_seen").cast("date"), "last_seen": F.col("last_seen").cast("date")})


@query("a29_intent_aggregate", f"{_EVIDENCE} SELECT type, source_type, count(*) AS evidence, count(DISTINCT topic) AS topics FROM ev GROUP BY ALL")
def a29_intent_aggregate(spark, d):
    return hist.intent_evidence(role(spark, d, "intent_sources")).groupBy("type", "source_type").agg(F.count("*").alias("evidence"), F.count_distinct("topic").alias("topics"))
