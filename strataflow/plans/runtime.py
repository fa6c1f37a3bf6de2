"""Queries over runtime events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataflow.operators import runtime as op
from strataflow.plans.registry import query
from strataflow.sources import adapters as role

_E = role.with_("runtime_events")
_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
_BASE = f"""dc AS (SELECT component_id, event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM runtime_events WHERE ts >= {_AS_OF} - INTERVAL 30 DAYS GROUP BY ALL),
    base AS (SELECT component_id, event_type, sum(n) / greatest(30, count(*)) AS mean, sum(n * n) / greatest(30, count(*)) - (sum(n) / greatest(30, count(*))) ** 2 AS variance FROM dc GROUP BY ALL)"""
_RECENT = f"recent AS (SELECT component_id, event_type, count(*) AS n FROM runtime_events WHERE ts >= {_AS_OF} - INTERVAL 2 DAYS AND ts < {_AS_OF} GROUP BY ALL)"


def _base(spark, d):
    return op.baselines(role.runtime_events(spark, d), role.EVENTS_AS_OF)


def _recent(spark, d):
    return op.recent_counts(role.runtime_events(spark, d), role.EVENTS_AS_OF, 2)


@query("r18_runtime_baselines", f"{_E}, {_BASE} SELECT component_id, event_type, round(mean, 6) AS mean, round(variance, 6) AS variance FROM base")
def r18_runtime_baselines(spark, d):
    return _base(spark, d).select("component_id", "event_type", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


_INC = role.CTE["incidents"]
_CAL = """cnt AS (SELECT incident_type AS event_type, count(*) AS n FROM incidents WHERE severity <> 'RESOLVED' GROUP BY 1),
    tot AS (SELECT sum(n) AS total, count(*) AS classes FROM cnt), en AS (SELECT sum(-(n / total) * log2(n / total)) AS entropy FROM cnt, tot),
    pri(event_type, prior) AS (VALUES ('OOM', 0.8), ('TIMEOUT', 0.5), ('DEADLOCK', 0.7), ('CRASH', 0.9), ('DEFAULT', 0.1)),
    ty AS (SELECT event_type FROM cnt UNION SELECT event_type FROM pri),
    al AS (SELECT ty.event_type, coalesce(n, 0) AS n, CAST(coalesce(prior, 0.1) AS DOUBLE) AS prior, total, classes, CASE WHEN classes > 1 THEN entropy / log2(classes) ELSE 0 END AS norm, (SELECT count(*) FROM ty) AS n_types
        FROM ty LEFT JOIN cnt USING (event_type) LEFT JOIN pri USING (event_type), tot, en),
    em AS (SELECT *, CASE WHEN total = 0 THEN 0.0 WHEN norm < 0.5 THEN (n + 1) / (total + n_types) ELSE n / total END AS emp FROM al),
    cal AS (SELECT event_type, CASE WHEN total >= 30 THEN emp WHEN total >= 10 THEN prior * (1 - (total - 9) / 20.0) + emp * (total - 9) / 20.0 ELSE prior END AS weight,
        least(1.0, total / 30.0) * CASE WHEN classes = 0 OR norm >= 0.5 THEN 1.0 ELSE 0.6 END AS confidence, CASE WHEN total >= 30 THEN 'CALIBRATED' WHEN total >= 10 THEN 'WARM' ELSE 'COLD' END AS mode FROM em)"""


def _calibration(spark, d):
    return op.calibration(role.incidents(spark, d).where("severity <> 'RESOLVED'").groupBy(F.col("incident_type").alias("event_type")).agg(F.count("*").alias("n")))


@query("r21_runtime_calibration", f"WITH {_INC}, {_CAL} SELECT event_type, round(weight, 6) AS weight, round(confidence, 6) AS confidence, mode FROM cal")
def r21_runtime_calibration(spark, d):
    return _calibration(spark, d).select("event_type", F.round("weight", 6).alias("weight"), F.round("confidence", 6).alias("confidence"), "mode")


_HEALTH = f"""{_E}, {_BASE}, {_RECENT}, pen AS (SELECT component_id, event_type, n * 0.5 * 1.5 + CASE WHEN mean IS NULL THEN n ELSE greatest(0, n - ceil(mean + sqrt(variance))) END * 0.5 * 4.0 AS penalty FROM recent LEFT JOIN base USING (component_id, event_type)),
    hs AS (SELECT component_id, CAST(greatest(0, floor(100 - sum(penalty) + 0.5)) AS BIGINT) AS health_score, first(event_type ORDER BY round(penalty, 9) DESC, event_type) AS primary_driver FROM pen GROUP BY component_id),
    rh AS (SELECT *, CASE WHEN health_score < 50 THEN 'CRITICAL' WHEN health_score < 90 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM hs)"""


def _health(spark, d):
    return op.health(_recent(spark, d), _base(spark, d), _calibration(spark, d))


@query("r19_runtime_health", f"{_HEALTH} SELECT component_id, health_score, status, primary_driver FROM rh")
def r19_runtime_health(spark, d):
    return _health(spark, d)


@query("r20_runtime_patterns", f"{_E}, {_BASE}, {_RECENT} SELECT component_id, event_type, n, round(greatest(2.0, coalesce(mean + 3 * sqrt(variance), 0)), 6) AS threshold FROM recent LEFT JOIN base USING (component_id, event_type) WHERE n > greatest(2.0, coalesce(mean + 1 * sqrt(variance) * 3, 0))")
def r20_runtime_patterns(spark, d):
    return op.anomalies(_recent(spark, d), _base(spark, d), 2).withColumn("threshold", F.round("threshold", 6))


_KEPT = """s AS (SELECT 'svc' || event_type AS component_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
    k AS (WITH RECURSIVE g AS (SELECT component_id, event_id, t, n, t AS last, true AS keep FROM s WHERE n = 1
        UNION ALL SELECT s.component_id, s.event_id, s.t, s.n, CASE WHEN s.t - g.last > 60000000 THEN s.t ELSE g.last END, s.t - g.last > 60000000 FROM g JOIN s ON s.component_id = g.component_id AND s.n = g.n + 1) SELECT component_id, event_id, t FROM g WHERE keep)"""


def _kept(spark, d):
    return op.debounced(role.runtime_events(spark, d, "event_type"))


@query("w11_debounce", f"WITH {_KEPT} SELECT component_id, event_id FROM k")
def w11_debounce(spark, d):
    return _kept(spark, d).select("component_id", "event_id")


@query("r22_temporal_dependencies", f"""WITH {_KEPT}, calm AS (SELECT * FROM k x WHERE (SELECT count(DISTINCT y.component_id) FROM k y WHERE y.t BETWEEN x.t - 5000000 AND x.t + 5000000) <= 3)
    SELECT b.component_id AS source, a.component_id AS target, count(*) AS observations, CAST(0.6 AS DOUBLE) AS confidence FROM calm a JOIN calm b ON b.t BETWEEN a.t + 1000000 AND a.t + 60000000 AND a.component_id <> b.component_id GROUP BY ALL HAVING count(*) >= 3""")
def r22_temporal_dependencies(spark, d):
    return op.temporal_pairs(_kept(spark, d))


@query("j26_time_window_pairs", f"""WITH {_KEPT} SELECT a.component_id AS first, b.component_id AS then, count(*) AS n FROM k a JOIN k b ON b.t BETWEEN a.t + 1000000 AND a.t + 30000000 AND a.component_id <> b.component_id GROUP BY ALL""")
def j26_time_window_pairs(spark, d):
    pairs = op.temporal_pairs(_kept(spark, d), lag_s=30, macro_components=1 << 30, least=1)
    return pairs.select(F.col("target").alias("first"), F.col("source").alias("then"), F.col("observations").alias("n"))


_EV = """evidence AS (SELECT 'svc' || (user_id % 10) AS source, 'svc' || (user_id % 7) AS target, CASE WHEN event_id % 211 = 0 THEN 'TOMBSTONE' WHEN event_id % 2 = 0 THEN 'HARD' ELSE 'CORRELATED' END AS dependency_type,
    'src' || (event_id % 4) AS evidence_source, least(1.0, value / 200) AS raw_confidence, CAST(ts AS DATE) AS discovered_at FROM events WHERE user_id % 10 <> user_id % 7)"""
_VIEW = """dead AS (SELECT DISTINCT source, target FROM evidence WHERE dependency_type = 'TOMBSTONE'),
    dep AS (SELECT source, target, least(1.0, max(dc) + 0.1 * greatest(0, count(DISTINCT evidence_source) - 1)) AS confidence, count(*) AS n
        FROM (SELECT *, CASE WHEN age <= 7 THEN raw_confidence WHEN age <= 30 THEN raw_confidence * 0.75 WHEN age <= 90 THEN raw_confidence * 0.5 ELSE 0.0 END AS dc FROM (SELECT *, date_diff('day', discovered_at, DATE '2024-01-31') AS age FROM evidence WHERE dependency_type <> 'TOMBSTONE'))
        ANTI JOIN dead USING (source, target) GROUP BY ALL HAVING least(1.0, max(dc) + 0.1 * greatest(0, count(DISTINCT evidence_source) - 1)) >= 0.1)"""


def _evidence(spark, d):
    kind = F.when(F.col("event_id") % 211 == 0, "TOMBSTONE").when(F.col("event_id") % 2 == 0, "HARD").otherwise("CORRELATED")
    name = lambda m: F.concat(F.lit("svc"), (F.col("user_id") % m).cast("string"))
    return role.table(spark, d, "events").where("user_id % 10 <> user_id % 7").select(name(10).alias("source"), name(7).alias("target"), kind.alias("dependency_type"), F.concat(F.lit("src"), (F.col("event_id") % 4).cast("string")).alias("evidence_source"), F.least(F.lit(1.0), F.col("value") / 200).alias("raw_confidence"), F.col("ts").cast("date").alias("discovered_at"))


@query("r23_dependency_view", f"WITH {_EV}, {_VIEW} SELECT source, target, round(confidence, 6) AS confidence, n FROM dep")
def r23_dependency_view(spark, d):
    return op.dependency_view(_evidence(spark, d), role.EVENTS_AS_OF[:10]).withColumn("confidence", F.round("confidence", 6))


@query("j10_tombstone_suppression", f"WITH {_EV} SELECT source, target, count(*) AS n FROM evidence e WHERE dependency_type <> 'TOMBSTONE' AND NOT EXISTS (SELECT 1 FROM evidence t WHERE t.dependency_type = 'TOMBSTONE' AND t.source = e.source AND t.target = e.target) GROUP BY ALL")
def j10_tombstone_suppression(spark, d):
    rows = _evidence(spark, d)
    return rows.where("dependency_type <> 'TOMBSTONE'").join(rows.where("dependency_type = 'TOMBSTONE'").select("source", "target").distinct(), ["source", "target"], "left_anti").groupBy("source", "target").agg(F.count("*").alias("n"))


def _hops(n: int) -> str:
    parts = ["h0 AS (SELECT component_id AS start, component_id AS node, risk AS value FROM failing)"]
    for k in range(1, n + 1):
        parts.append(f"h{k} AS (SELECT start, source AS node, max(value * confidence * 0.3{' * 0.85' if k > 1 else ''}) AS value FROM h{k - 1} JOIN dep ON target = node WHERE start <> source GROUP BY ALL)")
    return ", ".join(parts) + ", allh AS (" + " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(1, n + 1)) + ")"


@query("r24_runtime_blast_radius", f"WITH {_EV}, {_VIEW}, failing AS (SELECT 'svc' || i AS component_id, (i + 1) / 10.0 AS risk FROM range(7) t(i)), {_hops(5)}, best AS (SELECT start, node, round(max(value), 4) AS r FROM allh GROUP BY ALL) SELECT node AS component_id, round(1 - product(1 - r), 6) AS blast_risk, count(*) AS sources FROM best GROUP BY node")
def r24_runtime_blast_radius(spark, d):
    edges = op.dependency_view(_evidence(spark, d), role.EVENTS_AS_OF[:10]).select("source", "target", "confidence", F.lit(0.3).alias("factor"))
    failing = spark.range(7).select(F.concat(F.lit("svc"), F.col("id").cast("string")).alias("component_id"), ((F.col("id") + 1) / 10.0).alias("risk"))
    return op.blast_radius(edges, failing).withColumn("blast_risk", F.round("blast_risk", 6))


@query("w8_latest_unhealthy", f"{_E}, s AS (SELECT component_id, CAST(ts AS DATE) AS computed_at, CASE WHEN count(*) FILTER (severity = 'CRITICAL') > 5 THEN 'CRITICAL' WHEN count(*) FILTER (severity = 'ERROR') > 8 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM runtime_events GROUP BY ALL) SELECT * FROM s WHERE status <> 'HEALTHY' QUALIFY row_number() OVER (PARTITION BY component_id ORDER BY computed_at DESC) = 1")
def w8_latest_unhealthy(spark, d):
    status = F.when(F.count_if(F.col("severity") == "CRITICAL") > 5, "CRITICAL").when(F.count_if(F.col("severity") == "ERROR") > 8, "DEGRADED").otherwise("HEALTHY")
    return op.latest_unhealthy(role.runtime_events(spark, d).groupBy("component_id", F.col("ts").cast("date").alias("computed_at")).agg(status.alias("status")))


@query("a8_count_distinct", f"{_E} SELECT event_type, count(DISTINCT component_id) AS components, count(DISTINCT component_id || '|' || severity) AS pairs FROM runtime_events GROUP BY event_type")
def a8_count_distinct(spark, d):
    return role.runtime_events(spark, d).groupBy("event_type").agg(F.count_distinct("component_id").alias("components"), F.count_distinct(F.concat("component_id", F.lit("|"), "severity")).alias("pairs"))


@query("a27_edge_merge", "SELECT user_id % 10 AS source, user_id % 7 AS target, count(*) AS observed, max(least(1.0, value / 100)) AS confidence FROM events GROUP BY ALL")
def a27_edge_merge(spark, d):
    return role.table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("source"), (F.col("user_id") % 7).alias("target")).agg(F.count("*").alias("observed"), F.max(F.least(F.lit(1.0), F.col("value") / 100)).alias("confidence"))


@query("a28_verified_lines", "SELECT user_id, list_sort(list(DISTINCT CAST(json_extract_string(props, '$.k') AS INTEGER))) AS lines FROM events GROUP BY user_id")
def a28_verified_lines(spark, d):
    return role.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.get_json_object("props", "$.k").cast("int"))).alias("lines"))


@query("s11_coverage_bitmap", "SELECT event_id, [x for x in range(1, 17) if ((event_id * 37 % 65536) >> CAST(x - 1 AS INTEGER)) & 1 = 1] AS lines FROM events")
def s11_coverage_bitmap(spark, d):
    n = (F.col("event_id") * 37 % 65536).cast("int")
    two = F.unhex(F.lpad(F.concat(F.lpad(F.hex(n.bitwiseAND(F.lit(255))), 2, "0"), F.lpad(F.hex(F.shiftright(n, 8)), 2, "0")), 4, "0"))
    return role.table(spark, d, "events").select("event_id", F.transform(op.covered_lines(two), lambda x: x.cast("long")).alias("lines"))


@query("s10_span_edges", "SELECT c.user_id % 10 AS child, p.user_id % 10 AS parent, count(*) AS n, CAST(0.85 AS DOUBLE) AS confidence FROM events c JOIN events p ON c.event_id // 3 = p.event_id AND c.event_id > 0 GROUP BY ALL")
def s10_span_edges(spark, d):
    spans = role.table(spark, d, "events").select(F.col("event_id").alias("span_id"), F.floor(F.col("event_id") / 3).alias("parent_id"), (F.col("user_id") % 10).alias("service"))
    c, p = spans.where("span_id > 0").alias("c"), spans.alias("p")
    return c.join(p, F.col("c.parent_id") == F.col("p.span_id")).groupBy(F.col("c.service").alias("child"), F.col("p.service").alias("parent")).agg(F.count("*").alias("n")).withColumn("confidence", F.lit(0.85))


@query("x6_sliding_windows", "SELECT event_type, w, count(*) AS n FROM (SELECT event_type, unnest([CAST(ts AS DATE) - 2, CAST(ts AS DATE) - 1, CAST(ts AS DATE)]) AS w FROM events) GROUP BY ALL")
def x6_sliding_windows(spark, d):
    rows = role.table(spark, d, "events").select("event_type", F.window(F.col("ts"), "3 days", "1 day").alias("w"))
    return rows.groupBy("event_type", F.col("w.start").cast("date").alias("w")).agg(F.count("*").alias("n"))


@query("x8_idempotent_append", "SELECT event_id, event_type FROM events")
def x8_idempotent_append(spark, d):
    events = role.table(spark, d, "events").select("event_id", "event_type")
    return events.unionByName(events.where("event_id % 3 = 0")).dropDuplicates(["event_id"])


@query("x9_high_water_mark", "SELECT event_type, max(event_id) AS mark, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' GROUP BY event_type")
def x9_high_water_mark(spark, d):
    return role.table(spark, d, "events").where(F.col("ts") > F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).groupBy("event_type").agg(F.max("event_id").alias("mark"), F.count("*").alias("n"))


@query("w13_share_of_total", "SELECT event_id, round(value / sum(value) OVER (PARTITION BY user_id) * 100, 6) AS share FROM events")
def w13_share_of_total(spark, d):
    return role.table(spark, d, "events").select("event_id", F.round(F.col("value") / F.sum("value").over(Window.partitionBy("user_id")) * 100, 6).alias("share"))
