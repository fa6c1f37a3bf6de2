"""Advisory analytics: change-set risk, review recommendations, incident rules, gap analysis, artifact health, rebuilds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.operators.communities import communities as communities
from strataflow.operators.graph import bfs, reversed_


def change_set_risk(entities: DataFrame, frequencies: DataFrame, expertise: DataFrame, coupling: DataFrame) -> DataFrame:
    """Risk of changing a set of entities (change_id, entity_id): noisy-or of their frequencies, less for experts, more for strong coupling.

    expertise (entity_id, score), coupling (entity_id, strength, 0 to 100).
    """
    rows = entities.join(frequencies, "entity_id", "left").join(expertise, "entity_id", "left").join(coupling, "entity_id", "left")
    base = 1 - F.product(1 - F.coalesce("frequency", F.lit(0.0)))
    modifier = 1 - F.least(F.lit(1.0), F.coalesce(F.avg("score"), F.lit(0.0)) / 100) * 0.5
    strongest = F.coalesce(F.max("strength"), F.lit(0.0))
    penalty = F.when(strongest > 50, strongest / 100 * 0.4).otherwise(0.0)
    found = rows.groupBy("change_id").agg(base.alias("base"), modifier.alias("modifier"), penalty.alias("penalty"))
    p = F.least(F.lit(1.0), F.col("base") * F.col("modifier") + F.col("penalty"))
    return found.select("change_id", p.alias("probability"), F.when(p >= 0.4, "CRITICAL").when(p >= 0.2, "HIGH").when(p >= 0.1, "MEDIUM").otherwise("LOW").alias("severity"), (0.4 * 0.8 + 0.3 * 0.7 + 0.2 * 0.9 + 0.1 * (1 - F.col("penalty"))).alias("confidence"))


def review_recommendations(changes: DataFrame, impacts: DataFrame, coupling: DataFrame, links: DataFrame, health: DataFrame, hotspots: DataFrame) -> DataFrame:
    """Scope, risks, depth and number of reviewers of each change (change_id, path).

    impacts (root, node, governance_score), coupling (source_path, target_path, confidence, co_change_count; over .5 and 5 count),
    links (adr_id, node_id), health (entity_id, health_score), hotspots (entity_id, hotspot_score, bus_factor, severity).
    """
    own = changes.select("change_id", "path").distinct()
    strong = coupling.where("confidence > 0.5 AND co_change_count > 5")
    ends = strong.select(F.col("source_path").alias("path"), F.col("target_path").alias("node")).union(strong.select("target_path", "source_path")).distinct()
    hit = own.join(impacts.select(F.col("root").alias("path"), "node"), "path").select("change_id", F.col("node").alias("path")).distinct().join(own, ["change_id", "path"], "left_anti")
    tied = own.join(ends, "path").select("change_id", F.col("node").alias("path")).distinct().join(own, ["change_id", "path"], "left_anti").join(hit, ["change_id", "path"], "left_anti")
    adrs = own.join(links.select(F.col("node_id").alias("path"), "adr_id"), "path").select("change_id", "adr_id").distinct()
    signals = adrs.join(health.select(F.col("entity_id").alias("adr_id"), "health_score"), "adr_id", "left").join(hotspots.select(F.col("entity_id").alias("adr_id"), "hotspot_score", "bus_factor", "severity"), "adr_id", "left")
    by_adr = signals.groupBy("change_id").agg(F.count_distinct("adr_id").alias("n_adrs"), F.min("health_score").alias("min_health"), F.max("hotspot_score").alias("hotspot_risk"), F.max((F.col("severity") == "CRITICAL").cast("int")).alias("critical"))
    by_root = own.join(impacts.select(F.col("root").alias("path"), "governance_score"), "path").groupBy("change_id").agg(F.least(F.lit(100.0), F.max("governance_score")).alias("blast_risk"))
    rows = own.select("change_id").distinct()
    for part in (by_adr, by_root, hit.groupBy("change_id").agg(F.count("*").alias("n_impacted")), tied.groupBy("change_id").agg(F.count("*").alias("n_coupled"))):
        rows = rows.join(part, "change_id", "left")
    rows = rows.fillna({"n_adrs": 0, "min_health": 100.0, "hotspot_risk": 0.0, "critical": 0, "blast_risk": 0.0, "n_impacted": 0, "n_coupled": 0})
    rows = rows.withColumn("health_risk", F.greatest(F.lit(0.0), 100 - F.col("min_health"))).withColumn("coupling_risk", F.least(F.lit(100), (F.col("n_impacted") + F.col("n_coupled")) * 5))
    rows = rows.withColumn("risk_score", (F.col("health_risk") + F.col("hotspot_risk") + F.col("blast_risk") + F.col("coupling_risk")) / 4)
    score = F.col("risk_score")
    rows = rows.withColumn("risk_level", F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW"))
    depth = F.when((F.col("critical") == 1) | (F.col("health_risk") > 80), "ARCHITECTURAL").when((F.col("n_adrs") > 2) | (F.col("hotspot_risk") > 60), "DEEP").when(F.col("blast_risk") > 30, "STANDARD").otherwise("LIGHT")
    rows = rows.withColumn("depth", depth)
    return rows.select("change_id", "n_impacted", "n_coupled", "n_adrs", "risk_score", "risk_level", "depth", F.when(F.col("depth").isin("ARCHITECTURAL", "DEEP"), 2).otherwise(1).alias("n_reviewers"))


def incident_rules(coverage: DataFrame, hotspots: DataFrame, health: DataFrame, outcomes: DataFrame, validity: DataFrame) -> DataFrame:
    """(entity_type, entity_id, incident_type, severity) by five families of rules on the newest snapshots; RESOLVED where a signal is good again.

    coverage, health and validity (entity_id, snapshot_date, ...), hotspots (entity_id, snapshot_date, bus_factor, hotspot_score,
    blast_radius_score, coupling_score), outcomes (entity_type, entity_id, outcome_type). What is emitted of these is up to the lock (snapshots.escalations).
    """
    from strataflow.operators.snapshots import as_of_before, latest_snapshot

    def newest(history: DataFrame, value: str) -> DataFrame:
        rows = latest_snapshot(as_of_before(history, ["entity_id"], "snapshot_date", value), "snapshot_date")
        return rows.select("entity_id", F.col(value).alias("v"), F.coalesce(F.col(value) - F.col("prev_value"), F.lit(0.0)).alias("delta"))

    def rated(rows: DataFrame, entity_type: str, kind: str, severity: Column) -> DataFrame:
        return rows.select(F.lit(entity_type).alias("entity_type"), "entity_id", F.lit(kind).alias("incident_type"), severity.alias("severity")).where("severity IS NOT NULL")

    v, delta = F.col("v"), F.col("delta")
    c = rated(newest(coverage, "coverage_percent"), "FILE", "COVERAGE_INCIDENT", F.when(v < 30, "CRITICAL").when(v < 50, "HIGH").when(delta < -10, "MEDIUM").when(v > 55, "RESOLVED"))
    weight = F.col("blast_radius_score") * 0.6 + F.col("coupling_score") * 0.4
    alone = F.when(weight >= 80, "CRITICAL").when(weight >= 60, "HIGH").when(weight >= 30, "MEDIUM").otherwise("LOW")
    score = F.col("hotspot_score")
    shared = F.when(score > 90, "HIGH").when(score > 70, "MEDIUM").when(F.col("bus_factor") >= 2, "RESOLVED")
    h = rated(latest_snapshot(hotspots, "snapshot_date"), "FILE", "HOTSPOT_INCIDENT", F.when(F.col("bus_factor") == 1, alone).otherwise(shared))
    a = rated(newest(health, "health_score"), "MODULE", "HEALTH_INCIDENT", F.when(v < 40, "CRITICAL").when(delta < -25, "HIGH").when(delta < -15, "MEDIUM").when(v > 80, "RESOLVED"))
    kind = F.col("outcome_type")
    o = rated(outcomes.where("entity_type = 'ADR'"), "ADR", "OUTCOME_INCIDENT", F.when(kind == "FAILED", "CRITICAL").when(kind == "DEGRADED", "MEDIUM").when(kind == "SUCCESSFUL", "RESOLVED"))
    t = rated(newest(validity, "validity_score"), "MODULE", "VALIDITY_INCIDENT", F.when(v < 40, "HIGH").when(v < 60, "MEDIUM").when(v > 80, "RESOLVED"))
    return c.unionByName(h).unionByName(a).unionByName(o).unionByName(t)


def needs_recompute(before: DataFrame, after: DataFrame, share: float = 0.1) -> DataFrame:
    """Whether more than `share` of the edges (src, dst) changed: changed, total, recompute."""
    a, b = before.select("src", "dst").distinct(), after.select("src", "dst").distinct()
    changed = a.join(b, ["src", "dst"], "left_anti").unionByName(b.join(a, ["src", "dst"], "left_anti")).agg(F.count("*").alias("changed"))
    return changed.join(F.broadcast(a.agg(F.count("*").alias("total")))).withColumn("recompute", F.col("changed") > F.col("total") * share)


def actionable_impact(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """(seed, node, depth, verdict): dependents reached through edges that need action; direct importers are Safe and go no further."""
    back = reversed_(edges.where("type <> 'imports'"))
    reach = bfs(back, seeds, depth).withColumn("verdict", F.lit("Actionable"))
    safe = edges.where("type = 'imports'").join(seeds.select(F.col("node").alias("dst")), "dst").select(F.col("dst").alias("seed"), F.col("src").alias("node"), F.lit(1).alias("depth")).distinct().join(reach.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("verdict", F.lit("Safe"))
    return reach.unionByName(safe)


def stale_closure(dependencies: DataFrame, dirty: DataFrame, depth: int = 10) -> DataFrame:
    """Everything that depends, through any number of steps, on what is dirty (node): (node, depth)."""
    reach = bfs(reversed_(dependencies), dirty, depth)
    return reach.groupBy("node").agg(F.min("depth").alias("depth"))


def artifact_health(artifacts: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Fresh artifacts (artifact, generated) are no older than anything (src depends on dst) they are made from: exists, fresh, status."""
    newest = dependencies.join(artifacts.select(F.col("artifact").alias("dst"), F.col("generated").alias("g")), "dst").groupBy(F.col("src").alias("artifact")).agg(F.max("g").alias("newest"))
    rows = artifacts.join(newest, "artifact", "left")
    fresh = F.col("generated").isNotNull() & (F.col("newest").isNull() | (F.col("generated") >= F.col("newest")))
    return rows.select("artifact", F.col("generated").isNotNull().alias("exists"), fresh.alias("fresh"), F.when(F.col("generated").isNull(), "incomplete").when(~fresh, "degraded").otherwise("healthy").alias("status"))


def rebuild(spark: SparkSession, steps: Sequence[tuple[str, Callable[[SparkSession], DataFrame]]], target: str | None = None, optional: Sequence[str] = ()) -> DataFrame:
    """Runs the steps in order, each on its own: a failure is recorded and the next step runs. (step_no, step, status, n_rows, message)."""
    rows = []
    for number, (name, build) in enumerate(steps, 1):
        try:
            table = build(spark)
            if target is not None:
                table.write.mode("overwrite").parquet(f"{target}/{name}")
                table = spark.read.parquet(f"{target}/{name}")
            rows.append((number, name, "OK", table.count(), ""))
        except Exception as error:  # a step must not end the rebuild
            rows.append((number, name, "SKIPPED" if name in optional else "FAILED", None, str(error).splitlines()[0][:200]))
    return spark.createDataFrame(rows, "step_no int, step string, status string, n_rows long, message string")
