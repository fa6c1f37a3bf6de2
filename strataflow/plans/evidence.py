"""Queries of evidence packets, plans, investigations, typed lookups and the whole rebuild."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataflow.functions import text as fn
from strataflow.operators import advisory, claims
from strataflow.operators import evidence as op
from strataflow.operators import history as hist
from strataflow.operators import retrieval as rop
from strataflow.plans import history, lookup, runtime, snapshots
from strataflow.plans.registry import query
from strataflow.sources import adapters
from strataflow.sources.adapters import table
from strataflow.sources.roles import role, with_

_TYPES = """(VALUES ('threshold', ['facts', 'text']), ('list_count', ['facts', 'text']), ('exact_constant', ['facts', 'text']), ('fallback_chain', ['facts', 'text', 'graph']), ('config_surface', ['facts', 'text']), ('prompt_template', ['facts', 'text']), ('dependency_injection', ['facts', 'graph', 'text']), ('symbol_location', ['symbols', 'text']),
    ('impact_analysis', ['graph', 'text', 'symbols']), ('change_impact_prediction', ['graph', 'text']), ('refactoring_analysis', ['graph', 'text']), ('architecture_analysis', ['text', 'graph']), ('onboarding_analysis', ['text', 'symbols']), ('behavior_explanation', ['text', 'symbols', 'graph']), ('test_query', ['text', 'symbols'])) p(type, own)"""
#: Types of the questions of the tables, by their number.
_KIND = "CASE id % 30 WHEN 0 THEN 'threshold' WHEN 1 THEN 'list_count' WHEN 2 THEN 'fallback_chain' WHEN 3 THEN 'onboarding_analysis' WHEN 4 THEN 'symbol_location' WHEN 5 THEN 'dependency_injection' WHEN 6 THEN 'prompt_template' WHEN 7 THEN 'config_surface' WHEN 8 THEN 'exact_constant' WHEN 9 THEN 'architecture_analysis' WHEN 10 THEN 'change_impact_prediction' WHEN 11 THEN 'refactoring_analysis' WHEN 12 THEN 'impact_analysis' WHEN 13 THEN 'behavior_explanation' WHEN 14 THEN 'test_query' WHEN 15 THEN 'prediction_accountability' WHEN 16 THEN 'runtime_intelligence' WHEN 18 THEN 'impact_analysis' ELSE 'unknown' END"
_PLAN = f"{with_('questions', 'provider_hits', 'evidence_texts', 'question_gaps')}, ty AS (SELECT id AS query, {_KIND} AS type FROM questions), pl0 AS (SELECT query, ty.type, coalesce(own, ['text']) AS own FROM ty LEFT JOIN {_TYPES} ON p.type = ty.type), pl AS (SELECT query, type, unnest(own) AS provider, unnest(range(len(own))) AS place FROM pl0)"
_RAW = f"{_PLAN}, own AS (SELECT h.*, place AS turn FROM provider_hits h JOIN pl USING (query, provider)), fi AS (SELECT query, id, min((rank, turn)) AS k, min_by(provider, (rank, turn)) AS provider FROM own GROUP BY ALL), raw AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY k, id) AS place, provider, id FROM fi QUALIFY place <= 50)"
_PACKET = "WITH RECURSIVE " + _RAW.removeprefix("WITH ") + ", ca AS (SELECT query, id, place, least(CAST(ceil(chars / 4) AS INTEGER), 1200) AS n, row_number() OVER (PARTITION BY query ORDER BY place) AS i FROM raw JOIN evidence_texts USING (id) WHERE ceil(chars / 4) <= 3600), pk AS (SELECT query, id, i, CASE WHEN n <= 7000 THEN n ELSE 0 END AS used, n <= 7000 AS took FROM ca WHERE i = 1 UNION ALL SELECT ca.query, ca.id, ca.i, CASE WHEN used + n <= 7000 THEN used + n ELSE used END, used + n <= 7000 FROM pk JOIN ca ON ca.query = pk.query AND ca.i = pk.i + 1), packet AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY i) AS place, id FROM pk WHERE took)"


def _questions(spark, d):
    return role(spark, d, "questions").select(F.col("id").alias("query"), "text")


def _gathered(spark, d):
    plan, found = op.planned(_questions(spark, d)), role(spark, d, "provider_hits")
    raw = op.raw_evidence(plan, found)
    return plan, found, raw, op.evidence_packet(raw, role(spark, d, "evidence_texts").select("id", "chars"))


@query("q3_raw_evidence", f"{_RAW} SELECT query, place, provider, id FROM raw")
def q3_raw_evidence(spark, d):
    return _gathered(spark, d)[2]


@query("q2_evidence_packet", f"{_PACKET} SELECT query, place, id FROM packet")
def q2_evidence_packet(spark, d):
    return _gathered(spark, d)[3]


@query("q8_explain_selection", f"{_PACKET} SELECT h.query, h.provider, h.id, h.rank, CASE WHEN pl.provider IS NULL THEN 'not planned' WHEN raw.id IS NULL THEN 'over cap' WHEN raw.provider <> h.provider THEN 'duplicate' WHEN packet.id IS NULL THEN 'over budget' ELSE 'selected' END AS reason FROM provider_hits h LEFT JOIN pl ON pl.query = h.query AND pl.provider = h.provider LEFT JOIN raw ON raw.query = h.query AND raw.id = h.id LEFT JOIN packet ON packet.query = h.query AND packet.id = h.id")
def q8_explain_selection(spark, d):
    return op.selection(*_gathered(spark, d))


@query("q7_last_evidence", f"{_PACKET}, s AS (SELECT query % 5 AS session, query * 10 % 37 AS at_, query, id FROM packet), n AS (SELECT session, max((at_, query)) AS n FROM s GROUP BY session) SELECT s.session, query, id FROM s JOIN n ON n.session = s.session AND (at_, query) = n.n")
def q7_last_evidence(spark, d):
    return op.last_evidence(_gathered(spark, d)[3].select((F.col("query") % 5).alias("session"), (F.col("query") * 10 % 37).alias("at"), "query", "id"))


@query("q1_answer_outline", f"{_PACKET}, l AS (SELECT query, count(*) AS n, string_agg('[' || id || '] ' || string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1], chr(10) ORDER BY place) AS text FROM packet JOIN evidence_texts USING (id) GROUP BY query), g AS (SELECT DISTINCT query FROM question_gaps) SELECT q.id AS query, CASE WHEN n IS NULL THEN 'abstain' WHEN n < 3 OR g.query IS NOT NULL THEN 'revise' ELSE 'pass' END AS outcome, coalesce(l.text, 'The evidence does not answer this.') AS text FROM questions q LEFT JOIN l ON l.query = q.id LEFT JOIN g ON g.query = q.id")
def q1_answer_outline(spark, d):
    return op.answer_outline(_gathered(spark, d)[3], role(spark, d, "evidence_texts"), _questions(spark, d), role(spark, d, "question_gaps"))


_PATHS = with_("provider_hits") + ", inv AS (SELECT query, id, list_sort(list(DISTINCT provider)) AS paths, min(rank) AS best FROM provider_hits WHERE rank <= 10 GROUP BY ALL)"


def _investigated(spark, d):
    hits = role(spark, d, "provider_hits")
    return op.investigations({p: hits.where(F.col("provider") == p) for p in ("text", "facts", "graph", "symbols")})


@query("n14_investigation", f"{_PATHS} SELECT * FROM inv")
def n14_investigation(spark, d):
    return _investigated(spark, d)


@query("q9_hypotheses", f"{_PATHS} SELECT query, id, len(paths) AS support, row_number() OVER (PARTITION BY query ORDER BY len(paths) DESC, best, id) AS place FROM inv QUALIFY place <= 3")
def q9_hypotheses(spark, d):
    return op.hypotheses(_investigated(spark, d))


@query("q9_error_anchors", with_("test_outputs", "terminal_errors") + """, e AS (SELECT file AS id, content AS t FROM test_outputs UNION ALL SELECT command, output FROM terminal_errors) SELECT id, CASE WHEN regexp_matches(t, '(?i)error|exception|failed') THEN 'runtime' ELSE 'unknown' END AS kind, list_reverse(regexp_extract_all(t, 'File "([^"]+)", line', 1))[1] AS file, CAST(list_reverse(regexp_extract_all(t, 'File "[^"]+", line (\\d+)', 1))[1] AS INT) AS line FROM e""")
def q9_error_anchors(spark, d):
    rows = role(spark, d, "test_outputs").select(F.col("file").alias("id"), F.col("content").alias("t")).union(role(spark, d, "terminal_errors").select("command", "output"))
    return rows.select("id", op.error_anchors(F.col("t")).alias("a")).select("id", "a.*")


_TASKS = with_("plan_documents", "plan_units") + r""", ln AS (SELECT doc, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM plan_documents), tk AS (SELECT doc, line, regexp_extract(t, '^\s*(?:[-*]\s+\[([ xX])\]|\d+[.)])\s+(.+?)\s*$', 2) AS text, lower(regexp_extract(t, '^\s*(?:[-*]\s+\[([ xX])\]|\d+[.)])\s+(.+?)\s*$', 1)) = 'x' AS done, list_distinct(regexp_extract_all(t, '`([\w./-]+\.\w+)`', 1)) AS files FROM ln WHERE regexp_matches(t, '^\s*(?:[-*]\s+\[([ xX])\]|\d+[.)])\s+(.+?)\s*$'))"""
_WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> ''))"


def _tasks(spark, d):
    return op.plan_tasks(role(spark, d, "plan_documents"))


@query("q10_plan_tasks", f"{_TASKS} SELECT doc, line, text, done, list_sort(files) AS files FROM tk")
def q10_plan_tasks(spark, d):
    return _tasks(spark, d).withColumn("files", F.sort_array("files"))


@query("n12_plan_gaps", f"{_TASKS}, t AS (SELECT doc || ':' || line AS task, {_WORDS.format('text')} AS w, files FROM tk), u AS (SELECT {_WORDS.format('text')} AS o, file FROM plan_units), s AS (SELECT task, max(0.55::DOUBLE * len(list_intersect(w, o)) / len(list_distinct(list_concat(w, o))) + 0.45::DOUBLE * CAST(list_contains(files, file) AS INT)) AS s FROM t, u GROUP BY task) SELECT task, CASE WHEN s >= 0.15 THEN round(s, 6) ELSE 0.0 END AS similarity, CASE WHEN s >= 0.4 THEN 'done' WHEN s >= 0.15 THEN 'partial' ELSE 'missing' END AS status FROM s")
def n12_plan_gaps(spark, d):
    words = F.array_distinct(rop.tokens(F.col("text")))
    tasks = _tasks(spark, d).select(F.concat_ws(":", F.col("doc").cast("string"), F.col("line").cast("string")).alias("task"), words.alias("words"), "files")
    units = role(spark, d, "plan_units").select("unit", words.alias("words"), "file")
    return op.plan_analysis(tasks, units).withColumn("similarity", F.round("similarity", 6))


@query("c3_quoted_strings", r"""WITH a AS (SELECT doc_id AS answer_id, text, (doc_id + 1) AS next FROM documents), q AS (SELECT DISTINCT answer_id, unnest(regexp_extract_all(text, '"([^"\n]{4,})"', 1)) AS quote FROM a) SELECT answer_id, quote, coalesce(bool_or(contains(e.text, quote)), false) AS found FROM q LEFT JOIN documents e ON e.doc_id IN (answer_id - 1, answer_id + 1) GROUP BY ALL""")
def c3_quoted_strings(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), "text")
    near = docs.select(F.explode(F.array(F.col("answer_id") - 1, F.col("answer_id") + 1)).alias("answer_id"), F.col("text").alias("content"))
    return claims.quoted_strings(docs, near)


@query("text_inflections", r"SELECT DISTINCT p_type AS word, list_sort(list_distinct([lower(p_type), lower(p_type) || 's', lower(p_type) || 'ed', lower(p_type) || 'ing', CASE WHEN regexp_matches(lower(p_type), '[^aeiou]y$') THEN substr(lower(p_type), 1, length(p_type) - 1) || 'ies' END])) AS forms FROM part WHERE NOT regexp_matches(lower(p_type), '([^aeiou]y|e|s|x|z|ch|sh)$')")
def text_inflections(spark, d):
    words = table(spark, d, "part").select(F.col("p_type").alias("word")).distinct().where(~F.lower("word").rlike("([^aeiou]y|e|s|x|z|ch|sh)$"))
    return words.select("word", F.sort_array(fn.inflections(F.lower("word"))).alias("forms"))


@query("text_like_family", "SELECT p_partkey, p_name ILIKE '%red%' OR p_name ILIKE '%blue%' AS anywhere, p_name ILIKE 'red%' AS start, p_name ILIKE '%red' AS \"end\" FROM part")
def text_like_family(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", fn.like_any(name, ["RED", "blue"]).alias("anywhere"), fn.like_any(name, ["Red"], "start").alias("start"), fn.like_any(name, ["red"], "end").alias("end"))


# typed lookups


@query("q12_file_owners", f"{history._EXPERTISE} SELECT entity_id, author_email, round(expertise_score, 6) AS score, row_number() OVER (PARTITION BY entity_id ORDER BY round(expertise_score, 9) DESC, author_email) AS place FROM files QUALIFY place <= 3")
def q12_file_owners(spark, d):
    files = hist.file_expertise(history._authored(spark, d))
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.round("expertise_score", 9).desc(), "author_email"))
    return files.withColumn("place", place).where("place <= 3").select("entity_id", "author_email", F.round("expertise_score", 6).alias("score"), "place")


@query("q12_open_incidents", adapters.with_("incidents") + " SELECT entity_id, count(*) AS n, max(created_at) AS last FROM incidents WHERE severity IN ('CRITICAL', 'HIGH') GROUP BY entity_id")
def q12_open_incidents(spark, d):
    return adapters.incidents(spark, d).where("severity IN ('CRITICAL', 'HIGH')").groupBy("entity_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last"))


@query("q12_evolution_timeline", f"{snapshots._EVOLUTION} SELECT snapshot_date, event_type, importance FROM e WHERE entity_id = 'ADR-3'")
def q12_evolution_timeline(spark, d):
    return snapshots.r7_evolution_events(spark, d).where("entity_id = 'ADR-3'").select("snapshot_date", "event_type", "importance")


@query("q12_least_covered", with_("coverage_entities") + " SELECT entity_id, coverage_percent FROM coverage_entities ORDER BY coverage_percent, entity_id LIMIT 10")
def q12_least_covered(spark, d):
    return role(spark, d, "coverage_entities").orderBy("coverage_percent", "entity_id").limit(10).select("entity_id", "coverage_percent")


@query("q12_failed_decisions", with_("decision_outcomes", "causal_explanations", "causal_factors") + " SELECT o.entity_id, count(f.factor_id) AS factors FROM decision_outcomes o LEFT JOIN causal_explanations x ON x.target_entity_id = o.entity_id LEFT JOIN causal_factors f ON f.explanation_id = x.id WHERE outcome_type IN ('FAILED', 'DEGRADED') GROUP BY o.entity_id")
def q12_failed_decisions(spark, d):
    bad = role(spark, d, "decision_outcomes").where("outcome_type IN ('FAILED', 'DEGRADED')").select("entity_id")
    told = bad.join(role(spark, d, "causal_explanations"), F.col("target_entity_id") == F.col("entity_id"), "left").join(role(spark, d, "causal_factors"), F.col("explanation_id") == F.col("id"), "left")
    return told.groupBy("entity_id").agg(F.count("factor_id").alias("factors"))


@query("q12_active_drift", with_("drift_findings") + " SELECT entity_id, count(*) AS active FROM drift_findings WHERE resolution_state = 'ACTIVE' GROUP BY entity_id")
def q12_active_drift(spark, d):
    return role(spark, d, "drift_findings").where("resolution_state = 'ACTIVE'").groupBy("entity_id").agg(F.count("*").alias("active"))


@query("q12_unhealthy_components", with_("runtime_health_history") + " SELECT component_id, max_by(health_score, computed_at) AS health FROM runtime_health_history GROUP BY 1 HAVING max_by(health_score, computed_at) < 80")
def q12_unhealthy_components(spark, d):
    return role(spark, d, "runtime_health_history").groupBy("component_id").agg(F.max_by("health_score", "computed_at").alias("health")).where("health < 80")


@query("q12_coupled_with", with_("couplings") + " SELECT target_path AS other, confidence FROM couplings WHERE source_path = 'm5/p5' UNION SELECT source_path, confidence FROM couplings WHERE target_path = 'm5/p5'")
def q12_coupled_with(spark, d):
    rows = role(spark, d, "couplings")
    return rows.where("source_path = 'm5/p5'").select(F.col("target_path").alias("other"), "confidence").union(rows.where("target_path = 'm5/p5'").select("source_path", "confidence")).distinct()


@query("q12_pulls_by_author", with_("pull_exports") + " SELECT json_extract_string(content, '$.author') AS author, count(DISTINCT json_extract_string(content, '$.id')) AS pulls FROM pull_exports GROUP BY 1")
def q12_pulls_by_author(spark, d):
    rows = role(spark, d, "pull_exports").select(F.from_json("content", "id string, author string").alias("p")).select("p.*")
    return rows.groupBy("author").agg(F.count_distinct("id").alias("pulls"))


# the whole rebuild

class Rebuilt:
    """What several steps of a rebuild go on from: the first that needs a table writes it; one that failed is tried again by the next."""

    def __init__(self, spark, d) -> None:
        self.spark, self.d = spark, d

    @cached_property
    def files(self):
        return history.files_table(self.spark, self.d)

    @cached_property
    def coupled(self):
        return history.coupled_table(self.spark, self.d)

    @cached_property
    def parts(self):
        return history.parts(self.spark, self.d, self.coupled, self.files)


STEPS = [
    ("AuthorExpertise", lambda s, d, t: history.r2_file_expertise(s, d, t.files)), ("LogicalCoupling", lambda s, d, t: history.r1_logical_coupling(s, d, t.coupled)), ("ArchitecturalDrift", lambda s, d, t: history.r3_drift_findings(s, d, t.parts)), ("KnowledgeHotspots", lambda s, d, t: history.r5_hotspots(s, d, t.parts)),
    ("KnowledgeValidity", lambda s, d, t: snapshots.r6_validity(s, d, t.parts)), ("ArchitecturalEvolution", lambda s, d, t: snapshots.r7_evolution(s, d)), ("TestCoverage", lambda s, d, t: lookup.r8_coverage_risk(s, d)), ("DecisionOutcomes", lambda s, d, t: snapshots.r9_decision_outcomes(s, d)), ("CausalReasoning", lambda s, d, t: snapshots.r10_causal_chains(s, d)),
    ("IncidentEvents", lambda s, d, t: snapshots.x7_incident_escalations(s, d)), ("RuntimeIntelligence", lambda s, d, t: runtime.r19_runtime_health(s, d)), ("RuntimeDependencies", lambda s, d, t: runtime.r23_dependency_view(s, d)), ("RuntimeBlastRadius", lambda s, d, t: runtime.r24_runtime_blast_radius(s, d)),
    ("IncidentIntelligence", lambda s, d, t: snapshots.r12_incident_predictions(s, d, t.parts)), ("ChangeImpact", lambda s, d, t: history.r13_change_risk(s, d)), ("PredictionAccountability", lambda s, d, t: snapshots.r15_prediction_accountability(s, d)),
]
OPTIONAL = ("RuntimeIntelligence", "RuntimeDependencies", "RuntimeBlastRadius")


@query("r30_rebuild", "SELECT unnest(range(1, 17)) AS step_no, unnest(['AuthorExpertise', 'LogicalCoupling', 'ArchitecturalDrift', 'KnowledgeHotspots', 'KnowledgeValidity', 'ArchitecturalEvolution', 'TestCoverage', 'DecisionOutcomes', 'CausalReasoning', 'IncidentEvents', 'RuntimeIntelligence', 'RuntimeDependencies', 'RuntimeBlastRadius', 'IncidentIntelligence', 'ChangeImpact', 'PredictionAccountability']) AS step, 'OK' AS status")
def r30_rebuild(spark, d):
    """All sixteen builders in order, the three of runtime optional; a failure would be recorded and the others run."""
    tables = Rebuilt(spark, d)
    done = advisory.rebuild(spark, [(name, lambda s, f=f: f(s, d, tables)) for name, f in STEPS], optional=OPTIONAL)
    return done.select(F.col("step_no").cast("long").alias("step_no"), "step", "status")
