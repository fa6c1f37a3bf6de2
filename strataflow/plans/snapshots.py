"""Queries over snapshot series: drops, trends, outcomes, validity, incidents, accountability, upserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataflow.functions.session import cut
from strataflow.operators import audit
from strataflow.operators import snapshots as op
from strataflow.plans import history as plans
from strataflow.plans.registry import query
from strataflow.sources import adapters as role
from strataflow.sources import roles as more

_H = role.with_("health_history")
_C = role.with_("coverage_history")


def _lag(value: str, table: str, delta: str, least: int) -> str:
    return f"SELECT entity_id, snapshot_date, {value}, round(delta, 6) AS delta FROM (SELECT *, {delta} AS delta FROM (SELECT *, lag({value}) OVER (PARTITION BY entity_id ORDER BY snapshot_date) AS before FROM {table})) WHERE delta >= {least}"


@query("w1_health_drops", f"{_H} {_lag('health_score', 'health_history', 'before - health_score', 5)}")
def w1_health_drops(spark, d):
    return op.changes(role.health_history(spark, d), ["entity_type", "entity_id"], "snapshot_date", "health_score", 5).select("entity_id", "snapshot_date", "health_score", F.round("delta", 6).alias("delta"))


_VAL = "validity_history AS (SELECT entity_id, snapshot_date, floor((health_score * 0.7 + 20) * 100 + 1e-6) / 100 AS validity_score FROM health_history)"


def _validity_history(spark, d):
    return role.health_history(spark, d).select("entity_id", "snapshot_date", (F.floor((F.col("health_score") * 0.7 + 20) * 100 + 1e-6) / 100).alias("validity_score"))


@query("w2_validity_drops", f"{_H}, {_VAL} {_lag('validity_score', 'validity_history', 'before - validity_score', 5)}")
def w2_validity_drops(spark, d):
    return op.changes(_validity_history(spark, d), ["entity_id"], "snapshot_date", "validity_score", 5).select("entity_id", "snapshot_date", "validity_score", F.round("delta", 6).alias("delta"))


@query("w3_hotspot_escalations", f"{_H}, hot AS (SELECT entity_id, snapshot_date, round(100 - health_score, 2) AS hotspot_score FROM health_history) {_lag('hotspot_score', 'hot', 'hotspot_score - before', 5)}")
def w3_hotspot_escalations(spark, d):
    hot = role.health_history(spark, d).select("entity_id", "snapshot_date", F.round(100 - F.col("health_score"), 2).alias("hotspot_score"))
    return op.changes(hot, ["entity_id"], "snapshot_date", "hotspot_score", 5, drop=False).select("entity_id", "snapshot_date", "hotspot_score", F.round("delta", 6).alias("delta"))


@query("w4_coverage_drops", f"{_C} {_lag('coverage_percent', 'coverage_history', 'before - coverage_percent', 10)}")
def w4_coverage_drops(spark, d):
    return op.changes(role.coverage_history(spark, d), ["entity_id"], "snapshot_date", "coverage_percent", 10).select("entity_id", "snapshot_date", "coverage_percent", F.round("delta", 6).alias("delta"))


@query("w5_coverage_recoveries", f"{_C} {_lag('coverage_percent', 'coverage_history', 'coverage_percent - before', 10)}")
def w5_coverage_recoveries(spark, d):
    return op.changes(role.coverage_history(spark, d), ["entity_id"], "snapshot_date", "coverage_percent", 10, drop=False).select("entity_id", "snapshot_date", "coverage_percent", F.round("delta", 6).alias("delta"))


_TREND = "CASE WHEN n >= 2 AND latest > earliest + 5 THEN 'IMPROVING' WHEN n >= 2 AND latest < earliest - 5 THEN 'DEGRADING' ELSE 'STABLE' END"


@query("w6_health_trend", f"{_H}, fl AS (SELECT entity_id, min_by(health_score, snapshot_date) AS earliest, max_by(health_score, snapshot_date) AS latest, count(*) AS n FROM health_history GROUP BY entity_id) SELECT *, {_TREND} AS trend FROM fl")
def w6_health_trend(spark, d):
    return op.first_last(role.health_history(spark, d), ["entity_id"], "snapshot_date", "health_score").withColumn("trend", op.trend(F.col("n"), F.col("earliest"), F.col("latest")))


@query("w7_validity_trend", f"{_H}, {_VAL}, fl AS (SELECT entity_id, min_by(validity_score, snapshot_date) AS earliest, max_by(validity_score, snapshot_date) AS latest, count(*) AS n FROM validity_history GROUP BY entity_id) SELECT *, {_TREND} AS trend FROM fl")
def w7_validity_trend(spark, d):
    return op.first_last(_validity_history(spark, d), ["entity_id"], "snapshot_date", "validity_score").withColumn("trend", op.trend(F.col("n"), F.col("earliest"), F.col("latest")))


@query("j13_as_of_previous", f"{_H} SELECT h.entity_id, h.snapshot_date, p.snapshot_date AS prev_date, p.health_score AS prev_value FROM health_history h LEFT JOIN health_history p ON p.entity_id = h.entity_id AND p.snapshot_date = (SELECT max(x.snapshot_date) FROM health_history x WHERE x.entity_id = h.entity_id AND x.snapshot_date < h.snapshot_date)")
def j13_as_of_previous(spark, d):
    return op.as_of_before(role.health_history(spark, d), ["entity_id"], "snapshot_date", "health_score").select("entity_id", "snapshot_date", "prev_date", "prev_value")


@query("j14_latest_snapshot", f"{_C} SELECT entity_id, coverage_percent FROM coverage_history WHERE snapshot_date = (SELECT max(snapshot_date) FROM coverage_history)")
def j14_latest_snapshot(spark, d):
    return op.latest_snapshot(role.coverage_history(spark, d), "snapshot_date").select("entity_id", "coverage_percent")


@query("j16_latest_by_key", f"{_C} SELECT entity_id, max_by(coverage_percent, snapshot_date) AS coverage_percent, max(snapshot_date) AS snapshot_date FROM coverage_history GROUP BY entity_id")
def j16_latest_by_key(spark, d):
    return op.latest_by_key(role.coverage_history(spark, d), ["entity_id"], "snapshot_date", ["coverage_percent"])


_OUTCOMES = f"""h AS (SELECT entity_id, min_by(health_score, snapshot_date) AS earliest, max_by(health_score, snapshot_date) AS latest, count(*) AS n FROM health_history GROUP BY entity_id),
    c AS (SELECT entity_id, max_by(coverage_percent, snapshot_date) AS cov FROM coverage_history GROUP BY entity_id),
    i AS (SELECT entity_id, count(*) AS incident_count FROM incidents WHERE severity <> 'RESOLVED' GROUP BY entity_id),
    k AS (SELECT entity_id FROM h UNION SELECT entity_id FROM c UNION SELECT entity_id FROM i),
    o AS (SELECT entity_id, coalesce(incident_count, 0) AS incident_count, coalesce(n, 0) AS hn, CASE WHEN coalesce(n, 0) >= 2 AND latest > earliest + 5 THEN 'IMPROVING' WHEN coalesce(n, 0) >= 2 AND latest < earliest - 5 THEN 'DEGRADING' ELSE 'STABLE' END AS health_trend,
        greatest(0.0, least(100.0, 100 - greatest(0.0, 100 - coalesce(latest, 100.0)) - coalesce(incident_count, 0) * 20 - CASE WHEN cov < 50 THEN 15 WHEN cov < 75 THEN 10 WHEN cov < 90 THEN 5 ELSE 0 END)) AS outcome_score
        FROM k LEFT JOIN h USING (entity_id) LEFT JOIN c USING (entity_id) LEFT JOIN i USING (entity_id)),
    outcomes AS (SELECT *, CASE WHEN outcome_score >= 85 THEN 'SUCCESSFUL' WHEN outcome_score >= 70 THEN 'STABLE' WHEN outcome_score >= 50 THEN 'DEGRADING' ELSE 'FAILED' END AS outcome_type, hn + incident_count AS evidence_count,
        least(100.0, log10(hn + incident_count + 1) * 40) AS confidence FROM o)"""


def _outcomes(spark, d):
    return op.decision_outcomes(role.health_history(spark, d), role.coverage_history(spark, d), role.incidents(spark, d))


@query("r9_decision_outcomes", role.with_("health_history", "coverage_history", "incidents") + f", {_OUTCOMES} SELECT entity_id, round(outcome_score, 6) AS outcome_score, outcome_type, health_trend, incident_count, evidence_count, round(confidence, 6) AS confidence FROM outcomes")
def r9_decision_outcomes(spark, d):
    return _outcomes(spark, d).withColumns({"outcome_score": F.round("outcome_score", 6), "confidence": F.round("confidence", 6)})


@query("u7_signal_key_union", role.with_("health_history", "coverage_history", "incidents") + " SELECT entity_id FROM health_history UNION SELECT entity_id FROM coverage_history UNION SELECT entity_id FROM incidents")
def u7_signal_key_union(spark, d):
    return role.health_history(spark, d).select("entity_id").union(role.coverage_history(spark, d).select("entity_id")).union(role.incidents(spark, d).select("entity_id")).distinct()


_VALIDITY = plans._HOTSPOT + """, hot AS (SELECT *, CASE WHEN hotspot_score >= 76 THEN 'CRITICAL' WHEN hotspot_score >= 51 THEN 'HIGH' WHEN hotspot_score >= 26 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM parts),
    pe AS (SELECT adr_id, count(DISTINCT author_email) AS experts, min(knowledge_age_days) AS best_age FROM adr_experts GROUP BY adr_id),
    """ + more.ctes("review_outcomes", "previous_validity") + """,
    rv AS (SELECT entity_id AS adr_id, least(30, sum(post_merge_incidents) * 15 + sum(defects_found) * 5) AS review FROM review_outcomes WHERE entity_type = 'ADR' GROUP BY 1),
    pv AS (SELECT adr_id, validity_score AS was FROM previous_validity),
    dr AS (SELECT adr_id, count(*) FILTER (severity = 'CRITICAL') * 20 + count(*) FILTER (severity = 'HIGH') * 10 AS drift_raw FROM findings WHERE adr_id IS NOT NULL GROUP BY adr_id),
    st AS (SELECT f.adr_id, health_score, hot.severity AS hot, hot.bus_factor, drift_raw, pe.experts, rv.review, pv.was, CASE WHEN coalesce(best_age, 9999) > 365 THEN 20 WHEN coalesce(best_age, 9999) > 90 THEN 10 ELSE 0 END AS s0
        FROM (SELECT DISTINCT adr_id FROM adr_links) f LEFT JOIN pe USING (adr_id) LEFT JOIN health USING (adr_id) LEFT JOIN hot USING (adr_id) LEFT JOIN dr USING (adr_id) LEFT JOIN rv USING (adr_id) LEFT JOIN pv USING (adr_id)),
    validity AS (SELECT adr_id, greatest(0.0, 100 - (CASE WHEN bus_factor = 1 THEN least(30, s0 + 10) ELSE s0 END + coalesce(least(30.0, (100 - health_score) * 0.3), 0.0) + least(40, coalesce(drift_raw, 0)) + CASE WHEN hot = 'CRITICAL' THEN 20 ELSE 0 END + coalesce(review, 0))) AS validity_score, was,
        least(100, CASE WHEN experts > 0 THEN 25 ELSE 0 END + CASE WHEN health_score IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN hot IS NOT NULL THEN 25 ELSE 0 END + 25) AS confidence_score FROM st)"""


def _validity(spark, d, p, hotspots):
    return op.validity(p.links, p.experts, p.health, hotspots, p.findings, more.role(spark, d, "review_outcomes"), more.role(spark, d, "previous_validity"))


@query("r6_validity", f"{_VALIDITY} SELECT adr_id, round(validity_score, 6) AS validity_score, confidence_score, CASE WHEN validity_score > was + 5 THEN 'IMPROVING' WHEN validity_score < was - 5 THEN 'DEGRADING' ELSE 'STABLE' END AS trend, CASE WHEN validity_score >= 90 THEN 'VERY_HIGH' WHEN validity_score >= 75 THEN 'HIGH' WHEN validity_score >= 50 THEN 'MEDIUM' WHEN validity_score >= 25 THEN 'LOW' ELSE 'VERY_LOW' END AS tier FROM validity")
def r6_validity(spark, d, p: plans.Parts | None = None):
    p = p or plans.parts(spark, d)
    return _validity(spark, d, p, plans.hotspot_table(spark, d, p)).withColumn("validity_score", F.round("validity_score", 6))


_FACTORS = """factors AS (SELECT DISTINCT i.id AS incident_id, i.incident_type, 'COVERAGE_DEGRADATION' AS factor_type, 80 AS contribution_score FROM incidents i JOIN coverage_history h ON h.entity_id = i.entity_id AND h.snapshot_date >= i.created_at - INTERVAL 30 DAYS AND h.snapshot_date <= i.created_at WHERE coverage_percent < 50 AND severity <> 'RESOLVED'
    UNION ALL SELECT DISTINCT i.id, i.incident_type, 'ARCHITECTURAL_DECAY', 70 FROM incidents i JOIN health_history h ON h.entity_id = i.entity_id AND h.snapshot_date >= i.created_at - INTERVAL 30 DAYS AND h.snapshot_date <= i.created_at WHERE health_score < 50 AND severity <> 'RESOLVED')"""
_FROM_FACTORS = role.with_("incidents", "coverage_history", "health_history") + f", {_FACTORS}"


def _factors(spark, d):
    rows = role.incidents(spark, d)
    return op.incident_factors(rows, role.coverage_history(spark, d), "snapshot_date", F.col("coverage_percent") < 50, "COVERAGE_DEGRADATION", 80).unionByName(op.incident_factors(rows, role.health_history(spark, d), "snapshot_date", F.col("health_score") < 50, "ARCHITECTURAL_DECAY", 70))


@query("j11_incident_factors", f"{_FROM_FACTORS} SELECT * FROM factors")
def j11_incident_factors(spark, d):
    return _factors(spark, d)


@query("a10_incident_patterns", f"{_FROM_FACTORS}, p AS (SELECT incident_id, incident_type, string_agg(factor_type, ',' ORDER BY factor_type) AS factor_pattern FROM factors GROUP BY ALL) SELECT incident_type, factor_pattern, count(DISTINCT incident_id) AS frequency, least(100, count(DISTINCT incident_id) * 10) AS confidence FROM p GROUP BY ALL HAVING count(DISTINCT incident_id) >= 2")
def a10_incident_patterns(spark, d):
    return op.incident_patterns(_factors(spark, d))


@query("a9_group_concat", f"{_FROM_FACTORS} SELECT incident_id, string_agg(factor_type, ',' ORDER BY factor_type) AS factors FROM factors GROUP BY incident_id")
def a9_group_concat(spark, d):
    return _factors(spark, d).groupBy("incident_id").agg(F.array_join(F.sort_array(F.collect_list("factor_type")), ",").alias("factors"))


_PREDICT = _VALIDITY.replace(role.CTE["commits"], ", ".join(role.CTE[k] for k in ("health_history", "coverage_history", "incidents")) + ", " + role.CTE["commits"], 1).replace("health AS (SELECT adr_id", "drift_health AS (SELECT adr_id").replace("LEFT JOIN health USING", "LEFT JOIN drift_health USING") + f""", {_OUTCOMES}, {more.ctes("runtime_mappings", "runtime_health_history")},
    rh AS (SELECT component_id, max_by(health_score, computed_at) AS runtime FROM runtime_health_history GROUP BY 1), live AS (SELECT entity_id, max_by(runtime, component_id) AS runtime FROM runtime_mappings JOIN rh USING (component_id) GROUP BY 1),
    lc AS (SELECT entity_id, coverage_percent AS cov FROM coverage_history WHERE snapshot_date = (SELECT max(snapshot_date) FROM coverage_history)),
    lh AS (SELECT entity_id, health_score AS hs FROM health_history WHERE snapshot_date = (SELECT max(snapshot_date) FROM health_history)),
    risks AS (SELECT k.entity_id, CASE WHEN coalesce(cov, 100.0) < 30 THEN 1.0 WHEN coalesce(cov, 100.0) < 80 THEN (80 - cov) / 50.0 ELSE 0.0 END AS r1,
        CASE WHEN coalesce(bus_factor, 10) = 1 THEN least(1.0, (coalesce(blast_score, 0.0) * 0.6 + coalesce(coupling_score, 0.0) * 0.4) / 100) ELSE least(1.0, coalesce(hotspot_score, 0.0) / 100) END AS r2,
        CASE WHEN coalesce(hs, 100.0) < 40 THEN 1.0 WHEN coalesce(hs, 100.0) < 90 THEN (90 - hs) / 50.0 ELSE 0.0 END AS r3,
        CASE outcome_type WHEN 'FAILED' THEN 1.0 WHEN 'DEGRADED' THEN 0.5 WHEN 'DEGRADING' THEN 0.5 ELSE 0.0 END AS r4,
        CASE WHEN coalesce(validity_score, 100.0) < 40 THEN 1.0 WHEN coalesce(validity_score, 100.0) < 80 THEN (80 - validity_score) / 40.0 ELSE 0.0 END AS r5, coalesce((100 - runtime) / 100, 0.0) AS r6
        FROM k LEFT JOIN lc USING (entity_id) LEFT JOIN lh USING (entity_id) LEFT JOIN hot ON hot.adr_id = k.entity_id LEFT JOIN outcomes USING (entity_id) LEFT JOIN validity v ON v.adr_id = k.entity_id LEFT JOIN live USING (entity_id)),
    tot AS (SELECT *, 1 - (1 - r1) * (1 - r2) * (1 - r3) * (1 - r4) * (1 - r5) * (1 - r6) AS total, greatest(r1, r2, r3, r4, r5, r6) AS top FROM risks)
    SELECT entity_id, round(total * 100, 6) AS risk_score, CASE WHEN total * 100 >= 90 THEN 'CRITICAL' WHEN total * 100 >= 70 THEN 'HIGH' WHEN total * 100 >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
        CAST(least(100, floor((top + total / 2) * 50) + 30) AS BIGINT) AS confidence, CASE top WHEN r1 THEN 'COVERAGE' WHEN r2 THEN 'HOTSPOT' WHEN r3 THEN 'HEALTH' WHEN r4 THEN 'OUTCOME' WHEN r5 THEN 'VALIDITY' ELSE 'RUNTIME' END AS primary_driver FROM tot WHERE total > 0"""


@query("r12_incident_predictions", _PREDICT)
def r12_incident_predictions(spark, d, p: plans.Parts | None = None):
    entities = u7_signal_key_union(spark, d)
    cov, health = op.latest_snapshot(role.coverage_history(spark, d), "snapshot_date"), op.latest_snapshot(role.health_history(spark, d), "snapshot_date")
    p = p or plans.parts(spark, d)
    hotspots = cut(plans.hotspot_table(spark, d, p))
    return op.incident_predictions(entities, cov, health, hotspots, _outcomes(spark, d), _validity(spark, d, p, hotspots), more.role(spark, d, "runtime_mappings"), more.role(spark, d, "runtime_health_history")).withColumn("risk_score", F.round("risk_score", 6))


@query("x7_incident_escalations", role.with_("incidents") + """, s AS (SELECT entity_id, incident_type, id, epoch_us(created_at) AS t, CASE severity WHEN 'RESOLVED' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END AS r,
        row_number() OVER (PARTITION BY entity_id, incident_type ORDER BY created_at, id) AS n FROM incidents),
    f AS (WITH RECURSIVE g AS (SELECT entity_id, incident_type, id, n, CASE WHEN r > 0 THEN t END AS lt, r AS lr, r > 0 AS emit FROM s WHERE n = 1
        UNION ALL SELECT s.entity_id, s.incident_type, s.id, s.n,
            CASE WHEN s.r = 0 THEN NULL WHEN g.lt IS NULL OR s.t - g.lt > 1209600000000 OR s.r > g.lr THEN s.t ELSE g.lt END,
            CASE WHEN s.r = 0 THEN 0 WHEN g.lt IS NULL OR s.t - g.lt > 1209600000000 OR s.r > g.lr THEN s.r ELSE g.lr END,
            s.r > 0 AND (g.lt IS NULL OR s.t - g.lt > 1209600000000 OR s.r > g.lr)
        FROM g JOIN s ON s.entity_id = g.entity_id AND s.incident_type = g.incident_type AND s.n = g.n + 1) SELECT * FROM g)
    SELECT entity_id, incident_type, id FROM f WHERE emit""")
def x7_incident_escalations(spark, d):
    return op.escalations(role.incidents(spark, d))


_CAUSAL = f"""ev AS (SELECT entity_id, snapshot_date AS event_date, 'HEALTH' AS kind, round(before - health_score, 2) AS amount FROM (SELECT *, lag(health_score) OVER (PARTITION BY entity_id ORDER BY snapshot_date) AS before FROM health_history) WHERE before - health_score >= 5
    UNION ALL SELECT entity_id, snapshot_date, 'COVERAGE', round(before - coverage_percent, 2) FROM (SELECT *, lag(coverage_percent) OVER (PARTITION BY entity_id ORDER BY snapshot_date) AS before FROM coverage_history) WHERE before - coverage_percent >= 10),
    ch AS (SELECT *, row_number() OVER w AS step, lag(kind) OVER w AS pk, lag(event_date) OVER w AS pd, amount / sum(amount) OVER (PARTITION BY entity_id) * 100 AS share, count(*) OVER (PARTITION BY entity_id) AS n FROM ev WINDOW w AS (PARTITION BY entity_id ORDER BY event_date, kind)),
    ks AS (SELECT entity_id, count(DISTINCT kind) AS kinds FROM ev GROUP BY entity_id)
    SELECT entity_id, step, kind, event_date, CASE WHEN pk IS NULL THEN NULL WHEN pd = event_date THEN 'CORRELATED_WITH' WHEN pk = kind THEN 'AMPLIFIED' WHEN share > 30 THEN 'CONTRIBUTED_TO' ELSE 'PRECEDED' END AS relation, round(share, 4) AS share,
        CAST(least(100, kinds * 20 + least(50, n * 10) + CASE WHEN n > 1 THEN 10 ELSE 0 END) AS BIGINT) AS confidence FROM ch JOIN ks USING (entity_id)"""


@query("r10_causal_chains", role.with_("health_history", "coverage_history") + f", {_CAUSAL}")
def r10_causal_chains(spark, d):
    health = op.changes(role.health_history(spark, d), ["entity_id"], "snapshot_date", "health_score", 5).select("entity_id", F.col("snapshot_date").alias("event_date"), F.lit("HEALTH").alias("kind"), F.round("delta", 2).alias("amount"))
    cov = op.changes(role.coverage_history(spark, d), ["entity_id"], "snapshot_date", "coverage_percent", 10).select("entity_id", F.col("snapshot_date").alias("event_date"), F.lit("COVERAGE").alias("kind"), F.round("delta", 2).alias("amount"))
    return op.causal_chain(health.unionByName(cov)).select("entity_id", "step", "kind", "event_date", "relation", F.round("share", 4).alias("share"), F.col("confidence").cast("long").alias("confidence"))


_EVOLUTION = more.with_("evolution_snapshots") + """, b AS (SELECT *, lag(health_score) OVER w AS h0, lag(validity_score) OVER w AS v0, lag(bus_factor) OVER w AS b0, lag(node_count) OVER w AS n0, row_number() OVER w = 1 AS is_first FROM evolution_snapshots WINDOW w AS (PARTITION BY entity_id ORDER BY snapshot_date)),
    e AS (SELECT entity_id, snapshot_date, 'CREATED' AS event_type, 10 AS importance FROM b WHERE is_first
        UNION ALL SELECT entity_id, snapshot_date, 'HEALTH_CHANGED', 40 FROM b WHERE abs(health_score - h0) > 5 UNION ALL SELECT entity_id, snapshot_date, 'EVOLUTION_MILESTONE', 90 FROM b WHERE abs(health_score - h0) > 5 AND h0 >= 80 AND health_score < 80
        UNION ALL SELECT entity_id, snapshot_date, 'VALIDITY_CHANGED', 60 FROM b WHERE abs(validity_score - v0) > 5 UNION ALL SELECT entity_id, snapshot_date, 'EVOLUTION_MILESTONE', 90 FROM b WHERE abs(validity_score - v0) > 5 AND v0 >= 50 AND validity_score < 50
        UNION ALL SELECT entity_id, snapshot_date, 'RISK_CHANGED', 50 FROM b WHERE bus_factor <> b0 UNION ALL SELECT entity_id, snapshot_date, 'EVOLUTION_MILESTONE', 90 FROM b WHERE b0 > 1 AND bus_factor = 1
        UNION ALL SELECT entity_id, snapshot_date, 'EXPANDED', 10 FROM b WHERE node_count > n0 UNION ALL SELECT entity_id, snapshot_date, 'CONTRACTED', 10 FROM b WHERE node_count < n0)"""


@query("r7_evolution_events", f"{_EVOLUTION} SELECT * FROM e")
def r7_evolution_events(spark, d):
    return op.evolution_events(more.role(spark, d, "evolution_snapshots"))


@query("r7_evolution", f"""{_EVOLUTION}, t AS (SELECT entity_id, sum(importance) AS total, count(*) AS change_count, greatest(1, date_diff('day', min(snapshot_date), DATE '2024-01-31')) AS days FROM e GROUP BY entity_id),
    l AS (SELECT entity_id, max_by(health_score, snapshot_date) AS hs, min_by(health_score, snapshot_date) AS hs0, max_by(validity_score, snapshot_date) AS vs, min_by(validity_score, snapshot_date) AS vs0, max_by(bus_factor, snapshot_date) AS bf, max_by(node_count, snapshot_date) AS nodes, count(*) AS n FROM evolution_snapshots GROUP BY entity_id),
    v AS (SELECT *, total / 100 / (days * log10(greatest(10, nodes))) AS velocity FROM t JOIN l USING (entity_id))
    SELECT entity_id, change_count, round(velocity, 6) AS velocity, CASE WHEN days < 30 THEN 'EMERGING' WHEN vs < 25 OR bf = 0 THEN 'OBSOLETE' WHEN velocity < 0.2 AND hs > 80 THEN 'STABLE' WHEN n >= 2 AND (hs < hs0 - 5 OR vs < vs0 - 5) THEN 'DECLINING' ELSE 'ACTIVE' END AS status FROM v""")
def r7_evolution(spark, d):
    return op.evolution(more.role(spark, d, "evolution_snapshots"), role.EVENTS_AS_OF[:10]).withColumn("velocity", F.round("velocity", 6))


_PRED = """pred AS (SELECT event_id AS id, ts, 'v' || (event_id % 3) AS version, least(1.0, value / 100) AS p, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
    CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN ['OOM'] ELSE ['CRASH', 'OOM'] END AS expected, CASE WHEN event_type <> 'error' THEN NULL WHEN user_id % 3 = 0 THEN ['OOM', 'CRASH'] WHEN user_id % 3 = 1 THEN ['OOM'] ELSE ['TIMEOUT'] END AS actual FROM events)"""


def _predictions(spark, d):
    return role.table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("version"), F.least(F.lit(1.0), F.col("value") / 100).alias("p"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"), op.type_match(_expected(), _actual()).alias("match"))


def _words(*names):
    return F.array(*[F.lit(x) for x in names])


def _expected():
    return F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 2 == 0, _words("OOM")).otherwise(_words("CRASH", "OOM"))


def _actual():
    types = F.when(F.col("user_id") % 3 == 0, _words("OOM", "CRASH")).when(F.col("user_id") % 3 == 1, _words("OOM")).otherwise(_words("TIMEOUT"))
    return F.when(F.col("event_type") == "error", types)


_RATES = f"""WITH {_PRED}, st AS (SELECT *, CASE WHEN p >= 0.4 AND y = 1 THEN 'TP' WHEN p >= 0.4 AND y = 0 THEN 'FP' WHEN p < 0.4 AND y = 1 THEN 'FN' ELSE 'TN' END AS state, CASE WHEN expected IS NULL OR actual IS NULL THEN NULL WHEN len(expected) = len(actual) AND list_has_all(actual, expected) THEN 'TYPE_MATCH' WHEN list_has_any(expected, actual) THEN 'PARTIAL_MATCH' ELSE 'TYPE_MISMATCH' END AS match FROM pred),
    m AS (SELECT version, avg((p - y) ** 2) AS brier, count(*) FILTER (state = 'FP') / greatest(1, count(*) FILTER (state IN ('FP', 'TN'))) AS fpr, count(*) FILTER (state = 'FN') / greatest(1, count(*) FILTER (state IN ('FN', 'TP'))) AS fnr, count(*) FILTER (match IN ('TYPE_MATCH', 'PARTIAL_MATCH')) / greatest(1, sum(y)) AS type_precision, count(*) AS n FROM st GROUP BY version)"""


@query("r15_prediction_accountability", f"{_RATES} SELECT version, round(brier, 6) AS brier, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr, round(type_precision, 6) AS type_precision, n FROM m")
def r15_prediction_accountability(spark, d):
    return op.accountability(_predictions(spark, d)).select("version", F.round("brier", 6).alias("brier"), F.round("fpr", 6).alias("fpr"), F.round("fnr", 6).alias("fnr"), F.round("type_precision", 6).alias("type_precision"), "n")


@query("a14_confusion_states", f"{_RATES} SELECT version, state, count(*) AS n FROM st GROUP BY ALL")
def a14_confusion_states(spark, d):
    return _predictions(spark, d).withColumn("state", op.confusion(F.col("p"), F.col("y"))).groupBy("version", "state").agg(F.count("*").alias("n"))


@query("r16_engine_trust", f"{_RATES} SELECT version, round(brier, 6) AS brier, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr, round(type_precision, 6) AS type_precision, brier < 0.15 AND fpr < 0.10 AND fnr < 0.05 AS trustworthy FROM m")
def r16_engine_trust(spark, d):
    rates = op.accountability(_predictions(spark, d))
    metric = rates.select("version", F.expr("stack(4, 'brier', brier, 'fpr', fpr, 'fnr', fnr, 'type_precision', type_precision) AS (name, value)"))
    return op.engine_trust(metric).withColumns({c: F.round(c, 6) for c in ("brier", "fpr", "fnr", "type_precision")})


@query("j12_range_join", f"WITH {_PRED} SELECT a.id, count(b.event_id) AS n FROM pred a JOIN events b ON b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 DAYS WHERE a.p >= 1 AND b.event_type = 'error' GROUP BY a.id")
def j12_range_join(spark, d):
    left = _predictions(spark, d).where("p >= 1").select("id", "ts")
    right = role.table(spark, d, "events").where("event_type = 'error'").select("event_id", F.col("ts").alias("at"))
    return op.range_counts(left, right, "id", "ts", "at", 2)


@query("a11_outcome_types", role.with_("incidents") + " SELECT entity_id, CAST(to_json(list_sort(list(DISTINCT incident_type))) AS VARCHAR) AS types FROM incidents GROUP BY entity_id")
def a11_outcome_types(spark, d):
    return role.incidents(spark, d).groupBy("entity_id").agg(F.to_json(F.sort_array(F.collect_set("incident_type"))).alias("types"))


@query("udf_incident_type_match", role.with_("incidents") + ", a AS (SELECT entity_id, list(DISTINCT incident_type) AS t FROM incidents GROUP BY entity_id) SELECT entity_id, CASE WHEN len(t) = 2 AND list_has_all(t, ['OOM', 'DEADLOCK']) THEN 'TYPE_MATCH' WHEN list_has_any(t, ['OOM', 'DEADLOCK']) THEN 'PARTIAL_MATCH' ELSE 'TYPE_MISMATCH' END AS match FROM a")
def udf_incident_type_match(spark, d):
    rows = role.incidents(spark, d).groupBy("entity_id").agg(F.collect_set("incident_type").alias("t"))
    return rows.select("entity_id", op.type_match(F.from_json(F.lit('["OOM", "DEADLOCK"]'), "array<string>"), F.col("t")).alias("match"))


@query("u1_active_entities", more.with_("coverage_snapshots", "hotspot_history", "architectural_health_history", "decision_outcomes") + " SELECT entity_id, 'FILE' AS entity_type FROM coverage_snapshots UNION SELECT entity_id, 'FILE' FROM hotspot_history UNION SELECT entity_id, 'MODULE' FROM architectural_health_history UNION SELECT entity_id, 'ADR' FROM decision_outcomes WHERE entity_type = 'ADR'")
def u1_active_entities(spark, d):
    r = lambda name: more.role(spark, d, name)
    return op.active_entities(r("coverage_snapshots"), r("hotspot_history"), r("architectural_health_history"), r("decision_outcomes"))


_BAD = "SELECT '{0}' AS source, count(*) FILTER (snapshot_date IS NULL OR NOT regexp_full_match(CAST(snapshot_date AS VARCHAR), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS bad, count(*) AS n FROM {0}"


@query("u4_date_audit", more.with_("validity_history", "hotspot_history", "architectural_health_history", "drift_history", "evolution_snapshots", "outcome_history", "coverage_snapshots") + " " + " UNION ALL ".join(_BAD.format(t) for t in ("validity_history", "hotspot_history", "architectural_health_history", "drift_history", "evolution_snapshots", "outcome_history", "coverage_snapshots")))
def u4_date_audit(spark, d):
    return audit.bad_dates({k: more.role(spark, d, k) for k in audit.DATED})


@query("j15_star_join", role.with_("health_history", "coverage_history", "incidents", "adrs") + ", lc AS (SELECT entity_id, max_by(coverage_percent, snapshot_date) AS cov FROM coverage_history GROUP BY 1), lh AS (SELECT entity_id, max_by(health_score, snapshot_date) AS health FROM health_history GROUP BY 1), i AS (SELECT entity_id, count(*) AS n FROM incidents GROUP BY 1) SELECT id, coalesce(cov, 100.0) AS cov, coalesce(health, 100.0) AS health, coalesce(n, 0) AS n FROM adrs LEFT JOIN lc ON lc.entity_id = id LEFT JOIN lh ON lh.entity_id = id LEFT JOIN i ON i.entity_id = id")
def j15_star_join(spark, d):
    cov = op.latest_by_key(role.coverage_history(spark, d), ["entity_id"], "snapshot_date", ["coverage_percent"]).select(F.col("entity_id").alias("id"), F.col("coverage_percent").alias("cov"))
    health = op.latest_by_key(role.health_history(spark, d), ["entity_id"], "snapshot_date", ["health_score"]).select(F.col("entity_id").alias("id"), F.col("health_score").alias("health"))
    n = role.incidents(spark, d).groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
    return role.adrs(spark, d).select("id").join(cov, "id", "left").join(health, "id", "left").join(n, "id", "left").fillna({"cov": 100.0, "health": 100.0, "n": 0})


@query("k1_replace_by_group", "WITH new AS (SELECT c_custkey AS id, c_nationkey AS grp, c_acctbal * 2 AS v FROM customer WHERE c_nationkey < 5 AND c_custkey % 2 = 0) SELECT c_custkey AS id, c_nationkey AS grp, c_acctbal AS v FROM customer WHERE c_nationkey NOT IN (SELECT grp FROM new) UNION ALL SELECT * FROM new")
def k1_replace_by_group(spark, d):
    old = role.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("v"))
    return op.replace_groups(old, old.where("grp < 5 AND id % 2 = 0").withColumn("v", F.col("v") * 2), "grp")


@query("k2_insert_or_ignore", "SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, -1.0 FROM customer WHERE c_custkey % 3 = 0")
def k2_insert_or_ignore(spark, d):
    rows = role.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return op.insert_or_ignore(rows.where("id % 3 <> 0"), rows.withColumn("v", F.lit(-1.0)), ["id"])


@query("k3_upsert_last_wins", "SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value, max(ts)::DATE AS day FROM events GROUP BY ALL")
def k3_upsert_last_wins(spark, d):
    return op.latest_wins(role.table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "value", F.col("ts").cast("date").alias("day"))


@query("k4_tombstones", "WITH t AS (SELECT user_id, max(event_id) AS dead FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT event_id, user_id FROM events LEFT JOIN t USING (user_id) WHERE event_type <> 'error' AND (dead IS NULL OR event_id > dead)")
def k4_tombstones(spark, d):
    rows = role.table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("event_id").alias("seq"))
    return op.without_tombstones(rows.where("event_type <> 'error'"), rows.where("event_type = 'error'"), ["user_id"]).select("event_id", "user_id")


@query("k7_snapshot_append", f"{_H} SELECT entity_id, snapshot_date, health_score FROM health_history QUALIFY row_number() OVER (PARTITION BY entity_id, snapshot_date ORDER BY health_score DESC) = 1")
def k7_snapshot_append(spark, d):
    rows = role.health_history(spark, d).select("entity_id", "snapshot_date", "health_score")
    return op.upsert(rows, rows.where("snapshot_date >= '2024-01-15'"), ["entity_id", "snapshot_date"])


@query("k8_retention", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAYS")
def k8_retention(spark, d):
    return op.retained(role.table(spark, d, "events"), "ts", role.EVENTS_AS_OF, 7).select("event_id", "event_type")


@query("k10_capped_export", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE user_id IN (SELECT user_id FROM (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id ORDER BY t DESC, user_id LIMIT 10))) WHERE rn <= 25")
def k10_capped_export(spark, d):
    events = role.table(spark, d, "events")
    recent = events.groupBy("user_id").agg(F.max("ts").alias("t")).orderBy(F.col("t").desc(), "user_id").limit(10).select("user_id")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return events.join(recent, "user_id", "left_semi").withColumn("rn", rank).where("rn <= 25").select("user_id", "event_id")
