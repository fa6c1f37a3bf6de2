"""Deterministic checks of answers (assistant turns) against sources, and cross-table diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.operators import audit, lookup
from strataflow.plans import retrieval, snapshots
from strataflow.plans.registry import query
from strataflow.sources import roles
from strataflow.sources.adapters import table


@query("c8_thin_grounding", "SELECT user_id, count(DISTINCT event_type) AS sources, CASE WHEN count(DISTINCT event_type) < 3 THEN 'revise' ELSE 'pass' END AS outcome FROM events GROUP BY user_id")
def c8_thin_grounding(spark, d):
    n = F.count_distinct("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(n.alias("sources"), F.when(n < 3, "revise").otherwise("pass").alias("outcome"))


@query("c10_omitted_files", "WITH m AS (SELECT l_orderkey % 100 AS answer, l_partkey AS file, count(*) AS n FROM lineitem GROUP BY ALL) SELECT answer, file, n FROM m WHERE n >= 2 AND file NOT IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%') QUALIFY row_number() OVER (PARTITION BY answer ORDER BY n DESC, file) <= 3")
def c10_omitted_files(spark, d):
    from pyspark.sql import Window

    m = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("answer"), F.col("l_partkey").alias("file")).agg(F.count("*").alias("n")).where("n >= 2").join(table(spark, d, "part").where(F.col("p_name").startswith("red")).select(F.col("p_partkey").alias("file")), "file", "left_anti")
    return m.withColumn("rn", F.row_number().over(Window.partitionBy("answer").orderBy(F.col("n").desc(), "file"))).where("rn <= 3").select("answer", "file", "n")


_WORDS = "list_distinct(list_filter(string_split_regex(lower({}.text), '[^a-z0-9]+'), lambda x: length(x) > 3))"


@query("v33_relevance_verdict", f"WITH {retrieval._LISTS}, w AS (SELECT query, doc, {_WORDS.format('documents')} AS w, {_WORDS.format('benchmark')} AS q FROM bm JOIN documents ON doc_id = doc JOIN benchmark ON item_id = query WHERE rank <= 10) SELECT query, doc, CASE WHEN len(list_intersect(w, q)) = len(q) THEN 'exact' WHEN len(list_intersect(w, q)) * 2 >= len(q) THEN 'partial' ELSE 'none' END AS verdict FROM w")
def v33_relevance_verdict(spark, d):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: F.length(x) > 3))
    t = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), words.alias("w"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), words.alias("q"))
    n = F.size(F.array_intersect("w", "q"))
    return retrieval._bm25(spark, d).join(t, "doc").join(q, "query").select("query", "doc", F.when(n == F.size("q"), "exact").when(n * 2 >= F.size("q"), "partial").otherwise("none").alias("verdict"))


@query("v34_retrieval_gap", "SELECT count(*) AS gaps FROM (SELECT l_orderkey, l_linenumber AS s, l_linenumber + 1 AS e FROM lineitem) h WHERE NOT EXISTS (SELECT 1 FROM lineitem p WHERE p.l_orderkey = h.l_orderkey AND p.l_quantity > 30 AND p.l_linenumber <= h.e AND p.l_linenumber + 1 >= h.s)")
def v34_retrieval_gap(spark, d):
    items = table(spark, d, "lineitem")
    hits = items.select("l_orderkey", F.col("l_linenumber").alias("s"), (F.col("l_linenumber") + 1).alias("e")).alias("h")
    packet = items.where("l_quantity > 30").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ps"), (F.col("l_linenumber") + 1).alias("pe")).alias("p")
    return hits.join(packet, (F.col("l_orderkey") == F.col("k")) & (F.col("ps") <= F.col("e")) & (F.col("pe") >= F.col("s")), "left_anti").agg(F.count("*").alias("gaps"))


_KB = ("knowledge_hotspots", "links", "author_expertise", "architectural_health", "drift_findings", "knowledge_validity", "validity_evidence", "evolution_entities", "review_recommendations", "review_scope", "review_outcomes", "decisions",
       "validity_history", "hotspot_history", "architectural_health_history", "drift_history", "evolution_snapshots", "outcome_history", "coverage_snapshots", "coverage_entities", "outcome_evidence", "causal_explanations", "causal_factors", "causal_chains", "causal_evidence", "decision_outcomes")
_DIAGNOSTICS = roles.with_(*_KB) + """, real AS (SELECT adr_id, count(DISTINCT author_email) AS n FROM links JOIN author_expertise e ON e.entity_id = node_id AND entity_type = 'FILE' GROUP BY adr_id),
    dates AS (SELECT 'validity_history' AS t, snapshot_date FROM validity_history UNION ALL SELECT 'hotspot_history', snapshot_date FROM hotspot_history UNION ALL SELECT 'architectural_health_history', snapshot_date FROM architectural_health_history
        UNION ALL SELECT 'drift_history', snapshot_date FROM drift_history UNION ALL SELECT 'evolution_snapshots', snapshot_date FROM evolution_snapshots UNION ALL SELECT 'outcome_history', snapshot_date FROM outcome_history UNION ALL SELECT 'coverage_snapshots', snapshot_date FROM coverage_snapshots),
    found AS (SELECT 1 AS check_no, 'expert_count' AS check_name, entity_id AS entity FROM knowledge_hotspots h LEFT JOIN real ON adr_id = entity_id WHERE entity_type = 'ADR' AND expert_count <> coalesce(n, 0)
    UNION ALL SELECT 2, 'health_without_drift', h.entity_id FROM architectural_health h LEFT JOIN drift_findings f ON f.entity_id = h.entity_id AND resolution_state = 'ACTIVE' WHERE health_score < 100 AND f.id IS NULL
    UNION ALL SELECT 3, 'validity_without_evidence', v.id FROM knowledge_validity v LEFT JOIN validity_evidence e ON e.validity_id = v.id WHERE validity_score < 100 AND e.validity_id IS NULL
    UNION ALL SELECT 4, 'evolution_missing', v.entity_id FROM knowledge_validity v LEFT JOIN evolution_entities e USING (entity_id) WHERE e.id IS NULL
    UNION ALL SELECT 5, 'review_without_scope', CAST(id AS VARCHAR) FROM review_recommendations WHERE id NOT IN (SELECT recommendation_id FROM review_scope)
    UNION ALL SELECT 6, 'bus_factor', entity_id FROM knowledge_hotspots WHERE bus_factor > expert_count OR bus_factor < 0
    UNION ALL SELECT 7, 'review_of_missing_decision', CAST(review_id AS VARCHAR) FROM review_outcomes WHERE entity_type = 'ADR' AND entity_id NOT IN (SELECT id FROM decisions)
    UNION ALL SELECT DISTINCT 8, 'bad_dates', t FROM dates WHERE snapshot_date IS NULL OR NOT regexp_full_match(CAST(snapshot_date AS VARCHAR), '[0-9]{4}-[0-9]{2}-[0-9]{2}')
    UNION ALL SELECT DISTINCT 9, 'orphaned_history', entity_id FROM validity_history WHERE entity_id NOT IN (SELECT entity_id FROM knowledge_validity)
    UNION ALL SELECT 10, 'isolated_coverage', entity_id FROM coverage_entities c WHERE entity_type = 'ADR' AND coverage_percent < 50
        AND NOT EXISTS (SELECT 1 FROM outcome_evidence o WHERE o.entity_type = c.entity_type AND o.entity_id = c.entity_id AND evidence_type = 'COVERAGE')
        AND NOT EXISTS (SELECT 1 FROM causal_factors JOIN causal_explanations x ON explanation_id = x.id WHERE target_entity_type = c.entity_type AND target_entity_id = c.entity_id AND factor_type = 'COVERAGE_DEGRADATION')
    UNION ALL SELECT 11, 'outcome_without_history', entity_id FROM decision_outcomes WHERE entity_id NOT IN (SELECT entity_id FROM outcome_history)
    UNION ALL SELECT 12, 'empty_explanation', id FROM causal_explanations WHERE id NOT IN (SELECT explanation_id FROM causal_factors)
    UNION ALL SELECT 13, 'broken_chain', explanation_id FROM causal_chains WHERE prev_factor_id NOT IN (SELECT factor_id FROM causal_factors) OR next_factor_id NOT IN (SELECT factor_id FROM causal_factors)
    UNION ALL SELECT 14, 'factor_without_evidence', factor_id FROM causal_factors WHERE factor_id NOT IN (SELECT factor_id FROM causal_evidence))"""


def _diagnostics(spark, d):
    return audit.diagnostics({n: roles.role(spark, d, n) for n in _KB})


@query("r29_diagnostics", f"{_DIAGNOSTICS} SELECT check_no, check_name, count(*) AS bad FROM found GROUP BY ALL")
def r29_diagnostics(spark, d):
    return _diagnostics(spark, d).groupBy("check_no", "check_name").agg(F.count("*").alias("bad"))


@query("j25_mismatch_joins", f"{_DIAGNOSTICS} SELECT check_no, check_name, entity FROM found")
def j25_mismatch_joins(spark, d):
    return _diagnostics(spark, d)


@query("j20_runtime_static_reconcile", "WITH s AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem WHERE l_linestatus = 'F'), r AS (SELECT l_suppkey AS a, l_partkey % 100 AS b, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL) SELECT r.a, r.b, n, CASE WHEN s.a IS NULL THEN 'dynamic' WHEN n > 3 THEN 'hot' ELSE 'verified' END AS state FROM r LEFT JOIN s ON s.a = r.a AND s.b = r.b")
def j20_runtime_static_reconcile(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b"), "l_linestatus")
    static = items.where("l_linestatus = 'F'").select("a", "b").distinct().withColumn("known", F.lit(True))
    seen = items.where("l_linestatus = 'O'").groupBy("a", "b").agg(F.count("*").alias("n"))
    return seen.join(static, ["a", "b"], "left").select("a", "b", "n", F.when(F.col("known").isNull(), "dynamic").when(F.col("n") > 3, "hot").otherwise("verified").alias("state"))


@query("j3_shared_source_pairs", "WITH e AS (SELECT DISTINCT l_suppkey AS i, l_orderkey AS s FROM lineitem) SELECT a.i AS x, b.i AS y, count(*) AS n FROM e a JOIN e b ON a.s = b.s AND a.i < b.i GROUP BY ALL HAVING count(*) >= 2")
def j3_shared_source_pairs(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_orderkey").alias("s")).distinct()
    return e.alias("a").join(e.alias("b"), (F.col("a.s") == F.col("b.s")) & (F.col("a.i") < F.col("b.i"))).groupBy(F.col("a.i").alias("x"), F.col("b.i").alias("y")).agg(F.count("*").alias("n")).where("n >= 2")


@query("j4_expert_extremes", roles.with_("links", "author_expertise") + """, e AS (SELECT adr_id, author_email, sum(expertise_score) AS total FROM links JOIN author_expertise ON entity_id = node_id AND entity_type = 'FILE' GROUP BY ALL)
    SELECT adr_id, max(total) AS best, min(total) AS worst, count(*) AS experts, max(total) / sum(total) AS concentration FROM e GROUP BY adr_id""")
def j4_expert_extremes(spark, d):
    return lookup.expert_extremes(roles.role(spark, d, "links"), roles.role(spark, d, "author_expertise"))


@query("j22_prediction_outcome", snapshots._RATES.split(", st AS")[0] + ", o AS (SELECT event_id AS id, event_id % 3 = 0 AS resolved FROM events WHERE event_type = 'error') SELECT version, count(*) AS n, count(*) FILTER (resolved) AS resolved, round(avg(p), 9) AS mean_p FROM pred JOIN o USING (id) GROUP BY version")
def j22_prediction_outcome(spark, d):
    outcomes = table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), (F.col("event_id") % 3 == 0).alias("resolved"))
    return lookup.outcomes_by_version(snapshots._predictions(spark, d), outcomes).withColumn("mean_p", F.round("mean_p", 9))


@query("j23_mapping_health_patterns", roles.with_("runtime_mappings", "runtime_health_history") + """, lh AS (SELECT component_id, max_by(health_score, computed_at) AS health FROM runtime_health_history GROUP BY 1), pt AS (SELECT 'svc' || (user_id % 10) AS component_id, event_type AS pattern FROM events WHERE event_type = 'error' GROUP BY ALL)
    SELECT entity_id, min(health) AS health, count(DISTINCT component_id) AS components, count(pattern) AS patterns FROM runtime_mappings JOIN lh USING (component_id) LEFT JOIN pt USING (component_id) GROUP BY entity_id""")
def j23_mapping_health_patterns(spark, d):
    patterns = table(spark, d, "events").where("event_type = 'error'").select(F.concat(F.lit("svc"), (F.col("user_id") % 10).cast("string")).alias("component_id"), F.col("event_type").alias("pattern")).distinct()
    return lookup.runtime_state(roles.role(spark, d, "runtime_mappings"), roles.role(spark, d, "runtime_health_history"), patterns)
