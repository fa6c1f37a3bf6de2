"""Queries over change history: coupling, expertise, drift, hotspots, review, change risk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions.session import cut
from strataflow.operators import history as op
from strataflow.plans.registry import query
from strataflow.sources import adapters as role

_CHANGES = r"""changes AS (SELECT DISTINCT sha, path FROM commit_files WHERE change_type <> 'DELETE' AND path NOT LIKE '%/package-lock.json')"""
_SMALL = "small AS (SELECT sha, path FROM changes QUALIFY count(*) OVER (PARTITION BY sha) <= 50)"
_STATS = "stats AS (SELECT path, count(*) AS change_count, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM small JOIN commits USING (sha) GROUP BY path)"
_EDGES = """edges AS (SELECT a.path AS source_path, b.path AS target_path, count(*) AS co_change_count, min(ts) AS first_seen_at, max(ts) AS last_seen_at
    FROM small a JOIN small b ON a.sha = b.sha AND a.path < b.path JOIN commits c ON c.sha = a.sha GROUP BY ALL HAVING count(*) >= 2)"""
_COUPLED = """coupled AS (SELECT e.*, co_change_count / (s.change_count + t.change_count - co_change_count) AS confidence
    FROM edges e JOIN stats s ON s.path = source_path JOIN stats t ON t.path = target_path)"""
_COUPLING = role.with_("commits", "commit_files") + f", {_CHANGES}, {_SMALL}, {_STATS}, {_EDGES}, {_COUPLED}"
_DAYS = f"(epoch_us(TIMESTAMP '{role.AS_OF}') - epoch_us(ts)) / 86400e6"
_AUTHORED = f"""sized AS (SELECT * FROM commit_files QUALIFY count(*) OVER (PARTITION BY sha) <= 50),
    authored AS (SELECT lower(author_email) AS author_email, path, sha, ts, {_DAYS} AS days_ago,
        CASE WHEN {_DAYS} <= 30 THEN 1.0 WHEN {_DAYS} <= 90 THEN 0.8 WHEN {_DAYS} <= 365 THEN 0.5 ELSE 0.25 END AS weight
        FROM (SELECT DISTINCT sha, path FROM sized WHERE change_type <> 'DELETE' AND path NOT LIKE '%/package-lock.json') JOIN commits USING (sha)
        WHERE n_parents <= 1 AND author_email NOT LIKE '%[bot]%'),
    files AS (SELECT author_email, path AS entity_id, CAST(sum(weight) AS DOUBLE) AS expertise_score, count(*) AS contribution_count, min(days_ago) AS knowledge_age_days FROM authored GROUP BY ALL)"""
_EXPERTISE = role.with_("commits", "commit_files") + f", {_AUTHORED}"
_ADR_EXPERTS = """adr_experts AS (SELECT l.adr_id, author_email, sum(least(expertise_score, 10.0)) AS expertise_score, count(DISTINCT entity_id) AS own_files, min(knowledge_age_days) AS knowledge_age_days,
        count(DISTINCT entity_id) / any_value(n_files) AS coverage
    FROM files JOIN (SELECT DISTINCT adr_id, node_id FROM adr_links) l ON l.node_id = entity_id
    JOIN (SELECT adr_id, count(DISTINCT node_id) AS n_files FROM adr_links GROUP BY adr_id) t ON t.adr_id = l.adr_id GROUP BY l.adr_id, author_email)"""
_FINDINGS = f"""governed AS (SELECT DISTINCT node_id AS path FROM adr_links),
    owners AS (SELECT DISTINCT adr_id, node_id FROM adr_links),
    crossed AS (SELECT a.adr_id AS adr_a, b.adr_id AS adr_b, c.* FROM coupled c JOIN owners a ON a.node_id = source_path JOIN owners b ON b.node_id = target_path WHERE a.adr_id <> b.adr_id),
    findings AS (SELECT 'MISSING_IMPLEMENTATION' AS drift_type, id AS adr_id, NULL AS entity_id, 'LOW' AS severity, CAST(1.0 AS DOUBLE) AS confidence FROM adrs ANTI JOIN adr_links ON adr_id = id
        UNION ALL SELECT 'ORPHANED', NULL, path, CASE WHEN change_count > 100 THEN 'CRITICAL' ELSE 'HIGH' END, 1.0 FROM stats ANTI JOIN governed USING (path) WHERE change_count > 50
        UNION ALL SELECT 'GOVERNANCE_VIOLATION', adr_a, source_path || '|' || target_path, 'HIGH', confidence FROM crossed WHERE confidence > 0.5 AND co_change_count > 5
        UNION ALL SELECT 'EXCESSIVE_COUPLING', adr_a, NULL, 'MEDIUM', 0.8 FROM crossed GROUP BY adr_a HAVING count(DISTINCT adr_b) >= 3
        UNION ALL SELECT 'STALE_DECISION', id, NULL, 'MEDIUM', 0.7 FROM adrs JOIN (SELECT adr_id, sum(change_count) AS churn FROM adr_links JOIN stats ON path = node_id GROUP BY adr_id) c ON c.adr_id = id
            WHERE churn > 100 AND date_diff('day', created_at, DATE '{role.AS_OF[:10]}') > 365)"""
_DRIFT = role.with_("commits", "commit_files", "adrs", "adr_links") + f", {_CHANGES}, {_SMALL}, {_STATS}, {_EDGES}, {_COUPLED}, {_FINDINGS}"


def _coupled(spark, d):
    return op.logical_coupling(role.commit_files(spark, d), role.commits(spark, d))


def _small(spark, d):
    return op.small_groups(op.source_changes(role.commit_files(spark, d)), 50)


def _recent(spark, d):
    """Commits of the last week."""
    return role.commits(spark, d).where(F.col("ts") >= F.lit("2001-07-25 00:00:00").cast("timestamp_ntz"))


def _recent_scope(spark, d):
    return _small(spark, d).join(_recent(spark, d), "sha").select("path").distinct()


def _authored(spark, d):
    return op.authored(role.commit_files(spark, d), role.commits(spark, d), role.AS_OF)


@query("r1_logical_coupling", f"{_COUPLING} SELECT source_path, target_path, co_change_count, round(confidence, 6) AS confidence FROM coupled")
def r1_logical_coupling(spark, d, coupled: DataFrame | None = None):
    return (_coupled(spark, d) if coupled is None else coupled).select("source_path", "target_path", "co_change_count", F.round("confidence", 6).alias("confidence"))


@query("a1_file_change_stats", f"{_COUPLING} SELECT path, change_count, CAST(first_seen_at AS DATE) AS first_seen, CAST(last_seen_at AS DATE) AS last_seen FROM stats")
def a1_file_change_stats(spark, d):
    return op.file_change_stats(_small(spark, d), role.commits(spark, d)).select("path", "change_count", F.col("first_seen_at").cast("date").alias("first_seen"), F.col("last_seen_at").cast("date").alias("last_seen"))


@query("a2_co_change_support", f"{_COUPLING} SELECT source_path, target_path, co_change_count, CAST(first_seen_at AS DATE) AS first_seen FROM edges")
def a2_co_change_support(spark, d):
    return op.co_changes(_small(spark, d), role.commits(spark, d)).select("source_path", "target_path", "co_change_count", F.col("first_seen_at").cast("date").alias("first_seen"))


@query("p10_source_changes", role.with_("commit_files") + f", {_CHANGES} SELECT * FROM changes")
def p10_source_changes(spark, d):
    return op.source_changes(role.commit_files(spark, d))


@query("p11_small_commits", role.with_("commit_files") + f", {_CHANGES}, {_SMALL} SELECT sha, count(*) AS n FROM small GROUP BY sha")
def p11_small_commits(spark, d):
    return _small(spark, d).groupBy("sha").agg(F.count("*").alias("n"))


@query("w10_coupling_evidence", f"{_COUPLING} SELECT source_path, target_path, a.sha, row_number() OVER (PARTITION BY source_path, target_path ORDER BY ts DESC, a.sha) AS rn FROM edges JOIN small a ON a.path = source_path JOIN small b ON b.path = target_path AND b.sha = a.sha JOIN commits c ON c.sha = a.sha QUALIFY rn <= 20")
def w10_coupling_evidence(spark, d):
    return op.coupling_evidence(role.commit_files(spark, d), role.commits(spark, d))


@query("t1_strongest_couplings", f"{_COUPLING} SELECT source_path, target_path, round(confidence, 6) AS confidence FROM coupled ORDER BY round(confidence, 9) DESC, source_path, target_path LIMIT 10")
def t1_strongest_couplings(spark, d):
    return _coupled(spark, d).orderBy(F.round("confidence", 9).desc(), "source_path", "target_path").limit(10).select("source_path", "target_path", F.round("confidence", 6).alias("confidence"))


@query("a30_coupling_centrality", f"{_COUPLING} SELECT node, round(sum(w), 6) AS centrality, count(*) AS degree FROM (SELECT source_path AS node, confidence AS w FROM coupled UNION ALL SELECT target_path, confidence FROM coupled) GROUP BY node")
def a30_coupling_centrality(spark, d):
    return op.centrality(_coupled(spark, d), "source_path", "target_path", "confidence").select("node", F.round("centrality", 6).alias("centrality"), "degree")


@query("u2_coupled_files", f"{_COUPLING}, scope AS (SELECT DISTINCT path FROM small JOIN commits USING (sha) WHERE ts >= TIMESTAMP '2001-07-25 00:00:00') SELECT target_path AS path FROM coupled JOIN scope ON path = source_path UNION SELECT source_path FROM coupled JOIN scope ON path = target_path")
def u2_coupled_files(spark, d):
    scope, edges = _recent_scope(spark, d), _coupled(spark, d)
    return edges.join(scope, F.col("path") == F.col("source_path")).select(F.col("target_path").alias("path")).union(edges.join(scope, F.col("path") == F.col("target_path")).select("source_path")).distinct()


@query("u6_scope_difference", f"{_COUPLING}, scope AS (SELECT DISTINCT path FROM small JOIN commits USING (sha) WHERE ts >= TIMESTAMP '2001-07-25 00:00:00') SELECT DISTINCT path FROM (SELECT target_path AS path FROM coupled JOIN scope ON path = source_path UNION SELECT source_path FROM coupled JOIN scope ON path = target_path) ANTI JOIN scope USING (path)")
def u6_scope_difference(spark, d):
    return u2_coupled_files(spark, d).join(_recent_scope(spark, d), "path", "left_anti")


@query("r2_file_expertise", f"{_EXPERTISE} SELECT author_email, entity_id, round(expertise_score, 6) AS expertise_score, contribution_count, round(knowledge_age_days, 6) AS age FROM files")
def r2_file_expertise(spark, d, files: DataFrame | None = None):
    return (op.file_expertise(_authored(spark, d)) if files is None else files).select("author_email", "entity_id", F.round("expertise_score", 6).alias("expertise_score"), "contribution_count", F.round("knowledge_age_days", 6).alias("age"))


@query("r2_directory_expertise", f"{_EXPERTISE} SELECT author_email, regexp_extract(entity_id, '^(.*)/[^/]*$', 1) AS directory, round(sum(least(expertise_score, 1.0)), 6) AS expertise_score, CAST(sum(contribution_count) AS BIGINT) AS contribution_count FROM files GROUP BY 1, 2")
def r2_directory_expertise(spark, d):
    return op.directory_expertise(op.file_expertise(_authored(spark, d)), 1.0).select("author_email", "directory", F.round("expertise_score", 6).alias("expertise_score"), "contribution_count")


@query("r2_adr_expertise", role.with_("commits", "commit_files", "adr_links") + f", {_AUTHORED}, {_ADR_EXPERTS} SELECT adr_id, author_email, round(expertise_score, 6) AS expertise_score, own_files, round(coverage, 6) AS coverage FROM adr_experts")
def r2_adr_expertise(spark, d):
    return op.adr_expertise(op.file_expertise(_authored(spark, d)), role.adr_links(spark, d)).select("adr_id", "author_email", F.round("expertise_score", 6).alias("expertise_score"), "own_files", F.round("coverage", 6).alias("coverage"))


@query("w9_expertise_evidence", f"{_EXPERTISE} SELECT author_email, path, sha, row_number() OVER (PARTITION BY author_email, path ORDER BY ts DESC, sha) AS rn FROM authored QUALIFY rn <= 20")
def w9_expertise_evidence(spark, d):
    return op.expertise_evidence(_authored(spark, d))


@query("a34_knowledge_risk", f"{_EXPERTISE} SELECT entity_id, count(*) AS experts, count(*) FILTER (knowledge_age_days <= 90) AS active_experts, count(*) FILTER (knowledge_age_days > 90) AS stale_experts FROM files GROUP BY entity_id")
def a34_knowledge_risk(spark, d):
    return op.knowledge_risk(op.file_expertise(_authored(spark, d)))


@query("a33_reviewers", f"{_EXPERTISE}, scope AS (SELECT DISTINCT path FROM commit_files JOIN commits USING (sha) WHERE ts >= TIMESTAMP '2001-07-25 00:00:00'), own AS (SELECT author_email, sum(expertise_score) AS total, min(knowledge_age_days) AS age FROM files SEMI JOIN scope ON path = entity_id GROUP BY 1) SELECT author_email, round(total, 6) AS total, round(total / (SELECT max(total) FROM own) * CASE WHEN age <= 90 THEN 1.0 WHEN age <= 365 THEN 0.8 ELSE 0.5 END, 6) AS score FROM own ORDER BY round(total / (SELECT max(total) FROM own) * CASE WHEN age <= 90 THEN 1.0 WHEN age <= 365 THEN 0.8 ELSE 0.5 END, 9) DESC, author_email LIMIT 5")
def a33_reviewers(spark, d):
    scope = role.commit_files(spark, d).join(_recent(spark, d), "sha").select("path")
    return op.reviewers(op.file_expertise(_authored(spark, d)), scope, 5).select("author_email", F.round("total", 6).alias("total"), F.round("reviewer_score", 6).alias("score"))


def _findings(spark, d):
    stats = op.file_change_stats(_small(spark, d), role.commits(spark, d))
    return op.drift_findings(role.adrs(spark, d), role.adr_links(spark, d), stats, _coupled(spark, d), role.AS_OF[:10])


@query("r3_drift_findings", f"{_DRIFT} SELECT drift_type, adr_id, entity_id, severity, round(confidence, 6) AS confidence FROM findings")
def r3_drift_findings(spark, d, p: Parts | None = None):
    return (p.findings if p else _findings(spark, d)).withColumn("confidence", F.round("confidence", 6))


_HEALTH = "health AS (SELECT adr_id, sum(confidence) * count(*) AS drift_score, count(*) AS active_findings, count(*) FILTER (severity = 'CRITICAL') AS critical_findings, greatest(0.0, 100 - sum(confidence) * count(*)) AS health_score FROM findings WHERE adr_id IS NOT NULL GROUP BY adr_id)"


@query("r4_drift_health", f"{_DRIFT}, {_HEALTH} SELECT adr_id, round(drift_score, 6) AS drift_score, active_findings, critical_findings, round(health_score, 6) AS health_score FROM health")
def r4_drift_health(spark, d):
    return op.drift_health(_findings(spark, d)).select("adr_id", F.round("drift_score", 6).alias("drift_score"), "active_findings", "critical_findings", F.round("health_score", 6).alias("health_score"))


@query("j6_missing_implementation", role.with_("adrs", "adr_links") + " SELECT id FROM adrs ANTI JOIN adr_links ON adr_id = id")
def j6_missing_implementation(spark, d):
    return role.adrs(spark, d).join(role.adr_links(spark, d), F.col("id") == F.col("adr_id"), "left_anti").select("id")


@query("j5_cross_decision_coupling", f"{_DRIFT} SELECT adr_a, adr_b, count(*) AS n, round(max(confidence), 6) AS strongest FROM crossed GROUP BY ALL")
def j5_cross_decision_coupling(spark, d):
    links = role.adr_links(spark, d)
    a, b = links.select(F.col("node_id").alias("source_path"), F.col("adr_id").alias("adr_a")).distinct(), links.select(F.col("node_id").alias("target_path"), F.col("adr_id").alias("adr_b")).distinct()
    return _coupled(spark, d).join(a, "source_path").join(b, "target_path").where("adr_a <> adr_b").groupBy("adr_a", "adr_b").agg(F.count("*").alias("n"), F.round(F.max("confidence"), 6).alias("strongest"))


_HOTSPOT = f"""{_DRIFT}, {_HEALTH}, {_AUTHORED}, {_ADR_EXPERTS},
    ends AS (SELECT source_path AS path, target_path AS other FROM coupled UNION ALL SELECT target_path, source_path FROM coupled),
    outside AS (SELECT o.adr_id, o.node_id AS path, other FROM owners o JOIN ends ON ends.path = o.node_id LEFT JOIN owners x ON x.node_id = other WHERE x.adr_id IS NULL OR x.adr_id <> o.adr_id),
    coupling AS (SELECT adr_id, least(100.0, count(DISTINCT path || '|' || other) * 5.0) AS coupling_score FROM outside GROUP BY adr_id),
    people AS (SELECT adr_id, count(*) AS expert_count, count(*) FILTER (coverage >= 0.2 AND knowledge_age_days < 365) AS bus_factor, max(expertise_score) / sum(expertise_score) AS concentration FROM adr_experts GROUP BY adr_id),
    blast AS (SELECT adr_id, least(100.0, count(*) * 1.0) AS blast_score FROM owners GROUP BY adr_id),
    parts AS (SELECT adr_id, coalesce(expert_count, 0) AS expert_count, coalesce(bus_factor, 0) AS bus_factor, coalesce(concentration, 0.0) AS concentration, coalesce(coupling_score, 0.0) AS coupling_score, coalesce(blast_score, 0.0) AS blast_score,
        least(100.0, (0.4 * greatest(0.0, 100 - coalesce(health_score, 100.0)) + 0.3 * coalesce(blast_score, 0.0) + 0.3 * coalesce(coupling_score, 0.0)) * CASE coalesce(bus_factor, 0) WHEN 0 THEN 2.0 WHEN 1 THEN 1.5 ELSE 1.0 END) AS hotspot_score
        FROM (SELECT DISTINCT adr_id FROM adr_links) LEFT JOIN people USING (adr_id) LEFT JOIN coupling USING (adr_id) LEFT JOIN health USING (adr_id) LEFT JOIN blast USING (adr_id))"""


@dataclass
class Parts:
    """What the decision analytics share, each computed once and written."""

    links: DataFrame
    coupled: DataFrame
    experts: DataFrame
    findings: DataFrame
    health: DataFrame


def coupled_table(spark, d) -> DataFrame:
    """The coupling that analytics go on from, written."""
    return cut(_coupled(spark, d).select("source_path", "target_path", "co_change_count", "confidence"))


def files_table(spark, d) -> DataFrame:
    """The authors' expertise in files, written."""
    return cut(op.file_expertise(_authored(spark, d)).select("author_email", "entity_id", "expertise_score", "contribution_count", "knowledge_age_days"))


def parts(spark, d, coupled: DataFrame | None = None, files: DataFrame | None = None) -> Parts:
    """coupled, files: coupled_table and files_table where they have been made."""
    links = role.adr_links(spark, d)
    stats = cut(op.file_change_stats(_small(spark, d), role.commits(spark, d)).select("path", "change_count"))
    coupled = coupled_table(spark, d) if coupled is None else coupled
    experts = cut(op.adr_expertise(op.file_expertise(_authored(spark, d)) if files is None else files, links))
    findings = cut(op.drift_findings(role.adrs(spark, d), links, stats, coupled, role.AS_OF[:10]))
    return Parts(links, coupled, experts, findings, op.drift_health(findings))


def hotspot_table(spark, d, p: Parts | None = None):
    p = p or parts(spark, d)
    blast = p.links.select("adr_id", "node_id").distinct().groupBy("adr_id").agg(F.least(F.lit(100.0), F.count("*") * 1.0).alias("blast_score"))
    return op.hotspots(p.links, p.experts, p.coupled, p.health, blast)


@query("r5_hotspots", f"{_HOTSPOT} SELECT adr_id, expert_count, bus_factor, round(concentration, 6) AS concentration, round(CAST(coupling_score AS DOUBLE), 6) AS coupling_score, round(hotspot_score, 6) AS hotspot_score, CASE WHEN hotspot_score >= 76 THEN 'CRITICAL' WHEN hotspot_score >= 51 THEN 'HIGH' WHEN hotspot_score >= 26 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM parts")
def r5_hotspots(spark, d, p: Parts | None = None):
    return hotspot_table(spark, d, p).select("adr_id", "expert_count", "bus_factor", F.round("concentration", 6).alias("concentration"), F.round("coupling_score", 6).alias("coupling_score"), F.round("hotspot_score", 6).alias("hotspot_score"), "severity")


@query("a7_bus_factor", role.with_("commits", "commit_files", "adr_links") + f", {_AUTHORED}, {_ADR_EXPERTS} SELECT adr_id, count(*) FILTER (coverage >= 0.2 AND knowledge_age_days < 365) AS bus_factor FROM adr_experts GROUP BY adr_id")
def a7_bus_factor(spark, d):
    experts = op.adr_expertise(op.file_expertise(_authored(spark, d)), role.adr_links(spark, d))
    return experts.groupBy("adr_id").agg(F.count_if((F.col("coverage") >= 0.2) & (F.col("knowledge_age_days") < 365)).alias("bus_factor"))


_INTENTS = "evidence AS (SELECT 'T' || (l_suppkey % 30) AS intent_id, CASE WHEN l_orderkey % 3 = 0 THEN 'ADR' WHEN l_orderkey % 3 = 1 THEN 'PR' ELSE 'COMMIT' END AS source_type, l_orderkey AS source_id FROM lineitem)"


@query("r28_intent_graph", f"WITH {_INTENTS}, e AS (SELECT DISTINCT * FROM evidence) SELECT a.intent_id AS source_intent, b.intent_id AS target_intent, count(*) AS evidence_count, least(1.0, count(*) / 10.0) AS weight, count(*) FILTER (a.source_type = 'ADR') AS adr_support, count(*) FILTER (a.source_type = 'PR') AS pr_support, count(*) FILTER (a.source_type = 'COMMIT') AS commit_support FROM e a JOIN e b ON a.source_type = b.source_type AND a.source_id = b.source_id AND a.intent_id < b.intent_id GROUP BY ALL HAVING count(*) >= 2")
def r28_intent_graph(spark, d):
    kind = F.when(F.col("l_orderkey") % 3 == 0, "ADR").when(F.col("l_orderkey") % 3 == 1, "PR").otherwise("COMMIT")
    evidence = role.table(spark, d, "lineitem").select(F.concat(F.lit("T"), (F.col("l_suppkey") % 30).cast("string")).alias("intent_id"), kind.alias("source_type"), F.col("l_orderkey").alias("source_id"))
    return op.intent_graph(evidence)


@query("r13_change_risk", role.with_("incidents") + " SELECT entity_id, incident_type, (count(*) + 1) / ((SELECT count(*) FROM incidents) + 20) AS frequency, count(*) AS n FROM incidents GROUP BY ALL")
def r13_change_risk(spark, d):
    rows = role.incidents(spark, d)
    total = rows.agg(F.count("*").alias("total"))
    return rows.groupBy("entity_id", "incident_type").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("entity_id", "incident_type", op.change_risk(F.col("n"), F.col("total")).alias("frequency"), "n")


@query("a24_noisy_or_risk", role.with_("incidents") + ", f AS (SELECT entity_id, (count(*) + 1) / ((SELECT count(*) FROM incidents) + 20) AS r FROM incidents GROUP BY entity_id, incident_type) SELECT entity_id, round(1 - product(1 - r), 6) AS risk FROM f GROUP BY entity_id")
def a24_noisy_or_risk(spark, d):
    return r13_change_risk(spark, d).groupBy("entity_id").agg(F.round(op.noisy_or(F.col("frequency")), 6).alias("risk"))


@query("j1_commit_file_join", role.with_("commits", "commit_files") + " SELECT sha, path, author_email, CAST(ts AS DATE) AS day FROM commit_files JOIN commits USING (sha)")
def j1_commit_file_join(spark, d):
    return role.commit_files(spark, d).join(role.commits(spark, d), "sha").select("sha", "path", "author_email", F.col("ts").cast("date").alias("day"))


@query("j2_pair_self_join", f"{_COUPLING} SELECT count(*) AS pairs, count(DISTINCT a.sha) AS commits FROM small a JOIN small b ON a.sha = b.sha AND a.path < b.path")
def j2_pair_self_join(spark, d):
    small = _small(spark, d)
    return small.alias("a").join(small.alias("b"), (F.col("a.sha") == F.col("b.sha")) & (F.col("a.path") < F.col("b.path"))).agg(F.count("*").alias("pairs"), F.count_distinct("a.sha").alias("commits"))


@query("j8_semi_join", role.with_("commits", "adr_links") + ", commit_files AS (SELECT DISTINCT 'm' || (l_partkey % 20) || '/p' || l_partkey AS path FROM lineitem) SELECT node_id, adr_id FROM adr_links SEMI JOIN commit_files ON path = node_id")
def j8_semi_join(spark, d):
    return role.adr_links(spark, d).join(role.table(spark, d, "lineitem").select(F.concat(F.lit("m"), (F.col("l_partkey") % 20).cast("string"), F.lit("/p"), F.col("l_partkey").cast("string")).alias("path")), F.col("path") == F.col("node_id"), "left_semi").select("node_id", "adr_id")


@query("j9_anti_join", role.with_("commits") + " SELECT sha FROM commits WHERE sha NOT IN (SELECT l_orderkey FROM lineitem)")
def j9_anti_join(spark, d):
    return role.commits(spark, d).join(role.table(spark, d, "lineitem"), F.col("sha") == F.col("l_orderkey"), "left_anti").select("sha")
