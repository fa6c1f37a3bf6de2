"""Advisory queries, and single steps of the larger pipelines under their own names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataflow.operators import advisory as op
from strataflow.operators import graph as gop
from strataflow.operators import history as hist
from strataflow.operators import lookup as lop
from strataflow.operators.communities import communities
from strataflow.plans import graph, history, lookup, runtime, snapshots
from strataflow.plans.registry import query
from strataflow.sources import adapters as role
from strataflow.sources import roles
from strataflow.sources.adapters import table


@query("a12_brier_score", f"{snapshots._RATES} SELECT version, round(brier, 6) AS brier FROM m")
def a12_brier_score(spark, d):
    return snapshots.r15_prediction_accountability(spark, d).select("version", "brier")


@query("a13_error_rates", f"{snapshots._RATES} SELECT version, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr, round(type_precision, 6) AS type_precision FROM m")
def a13_error_rates(spark, d):
    return snapshots.r15_prediction_accountability(spark, d).select("version", "fpr", "fnr", "type_precision")


@query("a25_primary_driver", "SELECT user_id, first(event_type ORDER BY n DESC, event_type) AS driver FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def a25_primary_driver(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("driver"))


_NEWEST = "{0} AS (SELECT * FROM (SELECT *, {1} AS v, coalesce({1} - lag({1}) OVER (PARTITION BY entity_id ORDER BY snapshot_date), 0.0) AS delta FROM {2}) WHERE snapshot_date = (SELECT max(snapshot_date) FROM {2}))"


@query("r11_incident_rules", roles.with_("coverage_snapshots", "hotspot_history", "architectural_health_history", "decision_outcomes", "validity_history") + ", " + ", ".join(_NEWEST.format(*x) for x in (("c", "coverage_percent", "coverage_snapshots"), ("a", "health_score", "architectural_health_history"), ("t", "validity_score", "validity_history"))) + """,
    x AS (SELECT 'FILE' AS entity_type, entity_id, 'COVERAGE_INCIDENT' AS incident_type, CASE WHEN v < 30 THEN 'CRITICAL' WHEN v < 50 THEN 'HIGH' WHEN delta < -10 THEN 'MEDIUM' WHEN v > 55 THEN 'RESOLVED' END AS severity FROM c
    UNION ALL SELECT 'FILE', entity_id, 'HOTSPOT_INCIDENT', CASE WHEN bus_factor = 1 THEN CASE WHEN blast_radius_score * 0.6 + coupling_score * 0.4 >= 80 THEN 'CRITICAL' WHEN blast_radius_score * 0.6 + coupling_score * 0.4 >= 60 THEN 'HIGH' WHEN blast_radius_score * 0.6 + coupling_score * 0.4 >= 30 THEN 'MEDIUM' ELSE 'LOW' END
        WHEN hotspot_score > 90 THEN 'HIGH' WHEN hotspot_score > 70 THEN 'MEDIUM' WHEN bus_factor >= 2 THEN 'RESOLVED' END FROM hotspot_history WHERE snapshot_date = (SELECT max(snapshot_date) FROM hotspot_history)
    UNION ALL SELECT 'MODULE', entity_id, 'HEALTH_INCIDENT', CASE WHEN v < 40 THEN 'CRITICAL' WHEN delta < -25 THEN 'HIGH' WHEN delta < -15 THEN 'MEDIUM' WHEN v > 80 THEN 'RESOLVED' END FROM a
    UNION ALL SELECT 'ADR', entity_id, 'OUTCOME_INCIDENT', CASE outcome_type WHEN 'FAILED' THEN 'CRITICAL' WHEN 'DEGRADED' THEN 'MEDIUM' WHEN 'SUCCESSFUL' THEN 'RESOLVED' END FROM decision_outcomes
    UNION ALL SELECT 'MODULE', entity_id, 'VALIDITY_INCIDENT', CASE WHEN v < 40 THEN 'HIGH' WHEN v < 60 THEN 'MEDIUM' WHEN v > 80 THEN 'RESOLVED' END FROM t)
    SELECT * FROM x WHERE severity IS NOT NULL""")
def r11_incident_rules(spark, d):
    return op.incident_rules(*[roles.role(spark, d, n) for n in ("coverage_snapshots", "hotspot_history", "architectural_health_history", "decision_outcomes", "validity_history")])


_RISK_SETS = "ents AS (SELECT DISTINCT l_orderkey AS change_id, 'ADR-' || (l_partkey % 30) AS entity_id FROM lineitem)"


@query("r14_change_set_risk", role.with_("incidents") + f""", {_RISK_SETS}, fr AS (SELECT entity_id, max((n + 1) / (t + 20)) AS frequency FROM (SELECT entity_id, incident_type, count(*) AS n FROM incidents GROUP BY ALL), (SELECT count(*) AS t FROM incidents) GROUP BY entity_id),
    ex AS (SELECT 'ADR-' || (user_id % 30) AS entity_id, avg(value) AS score FROM events GROUP BY 1), cp AS (SELECT 'ADR-' || (p_partkey % 30) AS entity_id, max(p_size) * 1.5 AS strength FROM part GROUP BY 1),
    g AS (SELECT change_id, 1 - product(1 - coalesce(frequency, 0)) AS base, 1 - least(1.0, coalesce(avg(score), 0) / 100) * 0.5 AS modifier, CASE WHEN coalesce(max(strength), 0) > 50 THEN max(strength) / 100 * 0.4 ELSE 0 END AS penalty FROM ents LEFT JOIN fr USING (entity_id) LEFT JOIN ex USING (entity_id) LEFT JOIN cp USING (entity_id) GROUP BY change_id),
    p AS (SELECT *, least(1.0, base * modifier + penalty) AS probability FROM g)
    SELECT change_id, round(probability, 6) AS probability, CASE WHEN probability >= 0.4 THEN 'CRITICAL' WHEN probability >= 0.2 THEN 'HIGH' WHEN probability >= 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS severity, round(0.71 + 0.1 * (1 - penalty), 6) AS confidence FROM p""")
def r14_change_set_risk(spark, d):
    sets = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("change_id"), F.concat(F.lit("ADR-"), (F.col("l_partkey") % 30).cast("string")).alias("entity_id")).distinct()
    frequency = history.r13_change_risk(spark, d).groupBy("entity_id").agg(F.max("frequency").alias("frequency"))
    expertise = table(spark, d, "events").groupBy(F.concat(F.lit("ADR-"), (F.col("user_id") % 30).cast("string")).alias("entity_id")).agg(F.avg("value").alias("score"))
    coupling = table(spark, d, "part").groupBy(F.concat(F.lit("ADR-"), (F.col("p_partkey") % 30).cast("string")).alias("entity_id")).agg((F.max("p_size") * 1.5).alias("strength"))
    found = op.change_set_risk(sets, frequency, expertise, coupling)
    return found.withColumns({"probability": F.round("probability", 6), "confidence": F.round("confidence", 6)})


@query("r17_review_recommendations", roles.with_("change_sets", "impacts", "couplings", "links", "architectural_health", "knowledge_hotspots") + """, own AS (SELECT DISTINCT change_id, path FROM change_sets),
    strong AS (SELECT * FROM couplings WHERE confidence > 0.5 AND co_change_count > 5), ends AS (SELECT source_path AS path, target_path AS node FROM strong UNION SELECT target_path, source_path FROM strong),
    hit AS (SELECT DISTINCT change_id, node AS path FROM own JOIN impacts ON root = path EXCEPT SELECT * FROM own), tied AS (SELECT DISTINCT change_id, node AS path FROM own JOIN ends USING (path) EXCEPT SELECT * FROM own EXCEPT SELECT * FROM hit),
    a AS (SELECT DISTINCT change_id, adr_id FROM own JOIN links ON node_id = path),
    g AS (SELECT change_id, count(DISTINCT adr_id) AS n_adrs, min(health_score) AS mh, max(hotspot_score) AS hot, max(CAST(severity = 'CRITICAL' AS INT)) AS crit FROM a LEFT JOIN architectural_health h ON h.entity_id = adr_id LEFT JOIN knowledge_hotspots k ON k.entity_id = adr_id GROUP BY 1),
    bl AS (SELECT change_id, least(100.0, max(governance_score)) AS blast FROM own JOIN impacts ON root = path GROUP BY 1),
    r AS (SELECT c.change_id, coalesce(i.n, 0) AS n_impacted, coalesce(t.n, 0) AS n_coupled, coalesce(n_adrs, 0) AS n_adrs, greatest(0.0, 100 - coalesce(mh, 100.0)) AS hr, coalesce(hot, 0.0) AS hot, coalesce(crit, 0) AS crit, coalesce(blast, 0.0) AS blast
        FROM (SELECT DISTINCT change_id FROM own) c LEFT JOIN g USING (change_id) LEFT JOIN bl USING (change_id) LEFT JOIN (SELECT change_id, count(*) AS n FROM hit GROUP BY 1) i USING (change_id) LEFT JOIN (SELECT change_id, count(*) AS n FROM tied GROUP BY 1) t USING (change_id)),
    s AS (SELECT *, (hr + hot + blast + least(100, (n_impacted + n_coupled) * 5)) / 4 AS risk FROM r),
    z AS (SELECT *, CASE WHEN crit = 1 OR hr > 80 THEN 'ARCHITECTURAL' WHEN n_adrs > 2 OR hot > 60 THEN 'DEEP' WHEN blast > 30 THEN 'STANDARD' ELSE 'LIGHT' END AS depth FROM s)
    SELECT change_id, n_impacted, n_coupled, n_adrs, round(risk, 6) AS risk_score, CASE WHEN risk >= 75 THEN 'CRITICAL' WHEN risk >= 50 THEN 'HIGH' WHEN risk >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, depth, CASE WHEN depth IN ('ARCHITECTURAL', 'DEEP') THEN 2 ELSE 1 END AS n_reviewers FROM z""")
def r17_review_recommendations(spark, d):
    found = op.review_recommendations(*[roles.role(spark, d, n) for n in ("change_sets", "impacts", "couplings", "links", "architectural_health", "knowledge_hotspots")])
    return found.withColumn("risk_score", F.round("risk_score", 6))


_PATHS = f"WITH RECURSIVE {graph._EDGES}, step AS (SELECT DISTINCT src, dst FROM edges WHERE type <> 'assigns'), r AS (SELECT 'e900' AS node, ['e900'] AS path UNION ALL SELECT dst, list_append(path, dst) FROM r JOIN step ON src = node WHERE len(path) <= 15 AND node <> 'e1'), best AS (SELECT min(path) AS path FROM r WHERE node = 'e1')"


@query("g9_explain_dependency", f"{_PATHS} SELECT unnest(path) AS node, unnest(range(len(path))) AS step FROM best WHERE path IS NOT NULL")
def g9_explain_dependency(spark, d):
    return gop.shortest_path(graph.edges_of(spark, d).where("type <> 'assigns'"), "e900", "e1", 15).select(F.posexplode("path").alias("step", "node")).select("node", F.col("step").cast("long").alias("step"))


@query("g13_actionable_impact", f"WITH {graph._EDGES}, act AS (SELECT DISTINCT src, dst FROM edges WHERE type <> 'imports'), {graph._S}, {graph._reach('r', 'seeds', 'act', 'dst', 'src', 5)}, a AS (SELECT seed, node, depth FROM r WHERE depth > 0) SELECT *, 'Actionable' AS verdict FROM a UNION ALL SELECT DISTINCT dst, src, 1, 'Safe' FROM edges e JOIN seeds ON dst = seeds.node WHERE type = 'imports' AND NOT EXISTS (SELECT 1 FROM a WHERE a.seed = e.dst AND a.node = e.src)")
def g13_actionable_impact(spark, d):
    return op.actionable_impact(graph.edges_of(spark, d), graph._seeds(spark, 1, 2, 5, 8), 5)


@query("g15_identifier_edges", "WITH t AS (SELECT DISTINCT source, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents), f AS (SELECT w, min(source) AS home, count(*) AS n FROM t WHERE length(w) >= 4 GROUP BY w HAVING count(*) <= 0.3 * (SELECT count(DISTINCT source) FROM documents)) SELECT source AS src, home AS dst, count(*) AS weight FROM t JOIN f USING (w) WHERE source <> home GROUP BY ALL")
def g15_identifier_edges(spark, d):
    docs = table(spark, d, "documents")
    t = docs.select("source", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("w")).where(F.length("w") >= 4).distinct()
    total = docs.agg(F.count_distinct("source").alias("total"))
    f = t.groupBy("w").agg(F.min("source").alias("home"), F.count("*").alias("n")).join(F.broadcast(total)).where("n <= 0.3 * total").select("w", "home")
    return t.join(f, "w").where("source <> home").groupBy(F.col("source").alias("src"), F.col("home").alias("dst")).agg(F.count("*").alias("weight"))


#: Labels of folders take the least label that more than 3 edges join to theirs until nothing moves; hubs are seated one after the other.
_COMMUNITIES = history._COUPLING.replace("WITH ", "WITH RECURSIVE ", 1) + """, pr AS (SELECT DISTINCT least(source_path, target_path) AS a, greatest(source_path, target_path) AS b FROM coupled WHERE source_path <> target_path),
    nb AS (SELECT a AS node, b AS other FROM pr UNION ALL SELECT b, a FROM pr), deg AS (SELECT node, row_number() OVER (ORDER BY count(*) DESC, node) AS place FROM nb GROUP BY node),
    hubs AS (SELECT * FROM deg WHERE place <= (SELECT count(*) // 20 FROM deg)), own AS (SELECT node, string_split(node, '/')[1] AS folder FROM deg WHERE node NOT IN (SELECT node FROM hubs)),
    fl AS (SELECT p.folder AS x, q.folder AS y, count(*) AS n FROM nb JOIN own p ON p.node = nb.node JOIN own q ON q.node = nb.other WHERE p.folder <> q.folder GROUP BY ALL),
    lab AS (SELECT DISTINCT 0 AS i, folder, folder AS label FROM own UNION ALL SELECT i + 1, folder, least(label, coalesce(up, label)) FROM (SELECT i, folder, label, up, count(up) OVER () AS c
        FROM lab LEFT JOIN (SELECT la, min(lb) AS up FROM (SELECT a.label AS la, b.label AS lb FROM fl JOIN lab a ON a.folder = x JOIN lab b ON b.folder = y WHERE a.label <> b.label GROUP BY 1, 2 HAVING sum(n) > 3) GROUP BY la) ON la = label) WHERE c > 0),
    mem AS (SELECT node, own.folder, label, count(*) OVER (PARTITION BY label) > 20 AS large, (row_number() OVER (PARTITION BY own.folder ORDER BY node) - 1) // 20 AS run FROM own JOIN (SELECT folder, label FROM lab WHERE i = (SELECT max(i) FROM lab)) USING (folder)),
    base AS (SELECT node, min(node) OVER (PARTITION BY label, CASE WHEN large THEN folder END, CASE WHEN large THEN run END) AS community FROM mem), size AS (SELECT community, count(*) AS n FROM base GROUP BY 1),
    wish AS (SELECT place, community, count(*) AS k, any_value(n) AS n FROM hubs JOIN nb USING (node) JOIN base ON base.node = other JOIN size USING (community) GROUP BY ALL),
    seat AS (SELECT CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS taken UNION ALL SELECT s.place + 1, list_append(any_value(taken), arg_min(community, (-k, community)) FILTER (n + len(list_filter(taken, lambda x: x = community)) < 20))
        FROM seat s LEFT JOIN wish w ON w.place = s.place + 1 WHERE s.place < (SELECT count(*) FROM hubs) GROUP BY s.place),
    sat AS (SELECT unnest(range(1, len(taken) + 1)) AS place, unnest(taken) AS community FROM seat WHERE place = (SELECT max(place) FROM seat)),
    room AS (SELECT community, row_number() OVER (ORDER BY community, k) AS j FROM (SELECT community, unnest(range(20 - n - (SELECT count(*) FROM sat WHERE sat.community = size.community))) AS k FROM size)),
    late AS (SELECT place, row_number() OVER (ORDER BY place) AS j FROM sat WHERE community IS NULL),
    grown AS (SELECT * FROM base UNION ALL SELECT node, coalesce(sat.community, room.community, node) FROM hubs JOIN sat USING (place) LEFT JOIN late USING (place) LEFT JOIN room USING (j))"""


@query("g16_communities", f"{_COMMUNITIES} SELECT node, community FROM grown QUALIFY count(*) OVER (PARTITION BY community) >= 3")
def g16_communities(spark, d):
    edges = history._coupled(spark, d).select(F.col("source_path").alias("src"), F.col("target_path").alias("dst"))
    return communities(edges, lambda c: F.split(c, "/")[0])


@query("g17_recompute_guard", f"WITH {graph._EDGES}, b AS (SELECT DISTINCT src, dst FROM edges WHERE type <> 'fallback_to'), a AS (SELECT DISTINCT src, dst FROM edges), c AS (SELECT count(*) AS changed FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))) SELECT changed, (SELECT count(*) FROM a) AS total, changed > (SELECT count(*) FROM a) * 0.1 AS recompute FROM c")
def g17_recompute_guard(spark, d):
    edges = graph.edges_of(spark, d)
    return op.needs_recompute(edges, edges.where("type <> 'fallback_to'"))


@query("g24_impact_zone", f"WITH {graph._EDGES}, s(node) AS (VALUES ('e3')), {graph._reach('r', 's', 'edges', 'dst', 'src', 10)} SELECT node, depth FROM r WHERE depth > 0")
def g24_impact_zone(spark, d):
    return gop.bfs(gop.reversed_(graph.edges_of(spark, d)), graph._seeds(spark, 3), 10).select("node", "depth")


@query("g28_runtime_dependents", f"WITH {runtime._EV}, {runtime._VIEW}, s(node) AS (VALUES ('svc1'), ('svc4')), {graph._reach('r', 's', 'dep', 'target', 'source', 5)} SELECT seed, node, depth FROM r WHERE depth > 0")
def g28_runtime_dependents(spark, d):
    from strataflow.operators import runtime as rt

    edges = rt.dependency_view(runtime._evidence(spark, d), role.EVENTS_AS_OF[:10]).select(F.col("target").alias("src"), F.col("source").alias("dst"))
    seeds = spark.range(1).select(F.explode(F.array(F.lit("svc1"), F.lit("svc4"))).alias("node"))
    return gop.bfs(edges, seeds, 5)


@query("x3_staleness_propagation", f"WITH {graph._EDGES}, s(node) AS (VALUES ('e2'), ('e7')), {graph._reach('r', 's', 'edges', 'dst', 'src', 10)} SELECT node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY node")
def x3_staleness_propagation(spark, d):
    return op.stale_closure(graph.edges_of(spark, d), graph._seeds(spark, 2, 7), 10)


@query("x5_incremental_chunks", "SELECT DISTINCT sha256(text) AS chunk FROM documents WHERE lang <> 'en' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def x5_incremental_chunks(spark, d):
    docs = table(spark, d, "documents").select("lang", F.sha2("text", 256).alias("chunk"))
    return docs.where("lang <> 'en'").select("chunk").distinct().join(docs.where("lang = 'en'").select("chunk"), "chunk", "left_anti")


@query("n5_artifact_health", "WITH a AS (SELECT 'a' || p_partkey AS artifact, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size END AS generated FROM part), dep AS (SELECT 'a' || p_partkey AS src, 'a' || (p_partkey // 2) AS dst FROM part WHERE p_partkey > 0), n AS (SELECT src AS artifact, max(generated) AS newest FROM dep JOIN a ON artifact = dst GROUP BY src) SELECT artifact, generated IS NOT NULL AS exists, generated IS NOT NULL AND (newest IS NULL OR generated >= newest) AS fresh, CASE WHEN generated IS NULL THEN 'incomplete' WHEN NOT (newest IS NULL OR generated >= newest) THEN 'degraded' ELSE 'healthy' END AS status FROM a LEFT JOIN n USING (artifact)")
def n5_artifact_health(spark, d):
    name = lambda c: F.concat(F.lit("a"), c.cast("string"))
    part = table(spark, d, "part")
    artifacts = part.select(name(F.col("p_partkey")).alias("artifact"), F.when(F.col("p_size") % 9 != 0, F.col("p_size")).alias("generated"))
    dependencies = part.where("p_partkey > 0").select(name(F.col("p_partkey")).alias("src"), name(F.floor(F.col("p_partkey") / 2)).alias("dst"))
    return op.artifact_health(artifacts, dependencies)


@query("n17_majority_language", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), m AS (SELECT source, max(n) AS top FROM c GROUP BY source), k AS (SELECT c.source, lang, count(*) OVER (PARTITION BY c.source) AS ties FROM c JOIN m ON m.source = c.source AND n = top) SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM k WHERE k.source = d.source AND (k.lang = d.lang OR ties > 1))")
def n17_majority_language(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    counts = docs.groupBy("source", "lang").agg(F.count("*").alias("n")).withColumn("top", F.max("n").over(Window.partitionBy("source"))).where("n = top")
    keep = counts.withColumn("ties", F.count("*").over(Window.partitionBy("source"))).select(F.col("source").alias("s"), F.col("lang").alias("l"), "ties")
    return docs.join(keep, (F.col("source") == F.col("s")) & ((F.col("lang") == F.col("l")) | (F.col("ties") > 1)), "left_semi").select("doc_id")


@query("v18_pagerank_channel", f"WITH RECURSIVE {graph._EDGES}, {graph._RANKS}, seed AS (SELECT DISTINCT dst AS node FROM edges WHERE src IN ('e100', 'e101')) SELECT node FROM ranks ORDER BY round(score * CASE WHEN node IN (SELECT node FROM seed) THEN 10 ELSE 1 END, 9) DESC, node LIMIT 10")
def v18_pagerank_channel(spark, d):
    edges = graph.edges_of(spark, d)
    ranks = gop.pagerank(edges.withColumn("weight", F.lit(1.0)))
    targets = edges.where(F.col("src").isin("e100", "e101")).select(F.col("dst").alias("t")).distinct()
    boosted = ranks.join(targets, F.col("node") == F.col("t"), "left").select("node", F.round(F.col("score") * F.when(F.col("t").isNotNull(), 10).otherwise(1), 9).alias("s"))
    return boosted.orderBy(F.col("s").desc(), "node").limit(10).select("node")


@query("v30_fact_expansion", f"WITH {lookup._FACTS}, s0 AS (SELECT DISTINCT symbol FROM facts WHERE file_path = 'M1/f1'), f1 AS (SELECT DISTINCT file_path FROM facts SEMI JOIN s0 USING (symbol)), s1 AS (SELECT DISTINCT symbol FROM facts SEMI JOIN f1 USING (file_path)) SELECT fact_id FROM facts SEMI JOIN s1 USING (symbol) ORDER BY CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, fact_id LIMIT 50")
def v30_fact_expansion(spark, d):
    facts = lookup.facts(spark, d)
    first = facts.where("file_path = 'M1/f1'").select("symbol").distinct()
    files = facts.join(first, "symbol", "left_semi").select("file_path").distinct()
    second = facts.join(files, "file_path", "left_semi").select("symbol").distinct()
    return facts.join(second, "symbol", "left_semi").orderBy(lop.confidence_rank(F.col("confidence")), "fact_id").limit(50).select("fact_id")


@query("q12_top_experts", f"{history._EXPERTISE} SELECT author_email, round(sum(expertise_score), 6) AS total FROM files GROUP BY author_email ORDER BY round(sum(expertise_score), 6) DESC, author_email LIMIT 10")
def q12_top_experts(spark, d):
    files = hist.file_expertise(history._authored(spark, d))
    return files.groupBy("author_email").agg(F.round(F.sum("expertise_score"), 6).alias("total")).orderBy(F.col("total").desc(), "author_email").limit(10)
