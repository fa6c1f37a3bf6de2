"""Snapshot time series: drops and recoveries, trends, outcomes, validity, incidents, prediction accountability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.operators.folds import sorted_fold
from strataflow.operators.ranks import running


def changes(history: DataFrame, keys: list[str], date: str, value: str, least: float, drop: bool = True) -> DataFrame:
    """Snapshots whose value fell (or rose) by `least` or more since the one before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(date))
    delta = (before - F.col(value)) if drop else (F.col(value) - before)
    return history.withColumn("before", before).withColumn("delta", delta).where(F.col("delta") >= least)


def as_of_before(history: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Every snapshot with the one before it: the as-of self-join as one window."""
    w = Window.partitionBy(*keys).orderBy(date)
    return history.withColumn("prev_date", F.lag(date).over(w)).withColumn("prev_value", F.lag(value).over(w))


def first_last(history: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Earliest and latest value and the number of snapshots, by one aggregation."""
    return history.groupBy(*keys).agg(F.min_by(value, date).alias("earliest"), F.max_by(value, date).alias("latest"), F.count("*").alias("n"))


def trend(n: Column, earliest: Column, latest: Column) -> Column:
    return F.when((n >= 2) & (latest > earliest + 5), "IMPROVING").when((n >= 2) & (latest < earliest - 5), "DEGRADING").otherwise("STABLE")


def latest_snapshot(history: DataFrame, date: str) -> DataFrame:
    """Rows of the newest date of the whole table; the date is one row."""
    newest = history.agg(F.max(date).alias("_newest"))
    return history.join(F.broadcast(newest), F.col(date) == F.col("_newest")).drop("_newest")


def latest_by_key(history: DataFrame, keys: list[str], date: str, values: list[str]) -> DataFrame:
    return history.groupBy(*keys).agg(*[F.max_by(v, date).alias(v) for v in values], F.max(date).alias(date))


def decision_outcomes(health: DataFrame, coverage: DataFrame, incidents: DataFrame) -> DataFrame:
    """Score, band and confidence of each entity from its health, coverage and incidents (entity_id keyed signals)."""
    h = first_last(health, ["entity_id"], "snapshot_date", "health_score").select("entity_id", F.col("earliest").alias("h0"), F.col("latest").alias("h1"), F.col("n").alias("hn"))
    c = latest_by_key(coverage, ["entity_id"], "snapshot_date", ["coverage_percent"]).select("entity_id", F.col("coverage_percent").alias("cov"))
    i = incidents.where("severity <> 'RESOLVED'").groupBy("entity_id").agg(F.count("*").alias("incident_count"))
    keys = h.select("entity_id").union(c.select("entity_id")).union(i.select("entity_id")).distinct()
    rows = keys.join(h, "entity_id", "left").join(c, "entity_id", "left").join(i, "entity_id", "left").fillna({"hn": 0, "incident_count": 0})
    weak = F.when(F.col("cov") < 50, 15).when(F.col("cov") < 75, 10).when(F.col("cov") < 90, 5).otherwise(0)
    raw = 100 - F.greatest(F.lit(0.0), 100 - F.coalesce("h1", F.lit(100.0))) - F.col("incident_count") * 20 - weak
    rows = rows.withColumn("outcome_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))
    n = F.col("hn") + F.col("incident_count")
    return rows.select("entity_id", "outcome_score", F.when(F.col("outcome_score") >= 85, "SUCCESSFUL").when(F.col("outcome_score") >= 70, "STABLE").when(F.col("outcome_score") >= 50, "DEGRADING").otherwise("FAILED").alias("outcome_type"), trend(F.col("hn"), F.col("h0"), F.col("h1")).alias("health_trend"), "incident_count", n.alias("evidence_count"), F.least(F.lit(100.0), F.log10(n + 1) * 40).alias("confidence"))


def validity(links: DataFrame, experts: DataFrame, health: DataFrame, hotspots: DataFrame, findings: DataFrame, reviews: DataFrame, previous: DataFrame) -> DataFrame:
    """Validity of decisions: 100 less capped penalties for stale experts, health, drift, hotspots and reviews; confidence by signals, trend against before.

    reviews (entity_type, entity_id, post_merge_incidents, defects_found); previous (adr_id, validity_score).
    """
    files = links.groupBy("adr_id").agg(F.count("*").alias("n_files"))
    people = experts.groupBy("adr_id").agg(F.count_distinct("author_email").alias("experts"), F.min("knowledge_age_days").alias("best_age"))
    drift = findings.where("adr_id IS NOT NULL").groupBy("adr_id").agg(F.count("*").alias("n_findings"), (F.count_if(F.col("severity") == "CRITICAL") * 20 + F.count_if(F.col("severity") == "HIGH") * 10).alias("drift_raw"))
    rows = files.join(people, "adr_id", "left").join(health.select("adr_id", "health_score"), "adr_id", "left").join(hotspots.select("adr_id", F.col("severity").alias("hot"), "bus_factor"), "adr_id", "left").join(drift, "adr_id", "left")
    found = reviews.where("entity_type = 'ADR'").groupBy(F.col("entity_id").alias("adr_id")).agg(F.least(F.lit(30), F.sum("post_merge_incidents") * 15 + F.sum("defects_found") * 5).alias("review"))
    rows = rows.join(found, "adr_id", "left").join(previous.select("adr_id", F.col("validity_score").alias("was")), "adr_id", "left")
    age = F.coalesce("best_age", F.lit(9999.0))
    stale = F.when(age > 365, 20).when(age > 90, 10).otherwise(0)
    stale = F.when(F.col("bus_factor") == 1, F.least(F.lit(30), stale + 10)).otherwise(stale)
    sick = F.coalesce(F.least(F.lit(30.0), (100 - F.col("health_score")) * 0.3), F.lit(0.0))
    score = F.greatest(F.lit(0.0), 100 - (stale + sick + F.least(F.lit(40), F.coalesce("drift_raw", F.lit(0))) + F.when(F.col("hot") == "CRITICAL", 20).otherwise(0) + F.coalesce("review", F.lit(0))))
    confidence = F.least(F.lit(100), F.when(F.col("experts") > 0, 25).otherwise(0) + F.when(F.col("health_score").isNotNull(), 25).otherwise(0) + F.when(F.col("hot").isNotNull(), 25).otherwise(0) + F.lit(25))
    moved = F.when(score > F.col("was") + 5, "IMPROVING").when(score < F.col("was") - 5, "DEGRADING").otherwise("STABLE")
    return rows.select("adr_id", score.alias("validity_score"), confidence.alias("confidence_score"), moved.alias("trend")).withColumn("tier", F.when(F.col("validity_score") >= 90, "VERY_HIGH").when(F.col("validity_score") >= 75, "HIGH").when(F.col("validity_score") >= 50, "MEDIUM").when(F.col("validity_score") >= 25, "LOW").otherwise("VERY_LOW"))


def incident_factors(incidents: DataFrame, history: DataFrame, date: str, condition: Column, factor: str, contribution: int, days: int = 30) -> DataFrame:
    """Incidents whose entity met the condition in the `days` before: an equi-join with a range on the date."""
    i, h = incidents.where("severity <> 'RESOLVED'").alias("i"), history.where(condition).alias("h")
    within = (F.col(f"h.{date}") >= F.col("i.created_at") - F.expr(f"INTERVAL {days} DAYS")) & (F.col(f"h.{date}") <= F.col("i.created_at"))
    return i.join(h, (F.col("i.entity_id") == F.col("h.entity_id")) & within, "left_semi").select(F.col("id").alias("incident_id"), "incident_type", F.lit(factor).alias("factor_type"), F.lit(contribution).alias("contribution_score"))


def incident_patterns(factors: DataFrame, least: int = 2) -> DataFrame:
    """Sets of factors that incidents of a type share, with their frequency and confidence."""
    own = factors.groupBy("incident_id", "incident_type").agg(F.array_join(F.sort_array(F.collect_list("factor_type")), ",").alias("factor_pattern"))
    return own.groupBy("incident_type", "factor_pattern").agg(F.count_distinct("incident_id").alias("frequency")).where(F.col("frequency") >= least).withColumn("confidence", F.least(F.lit(100), F.col("frequency") * 10))


def _graded(value: Column, low: float, high: float, scale: float) -> Column:
    return F.when(value < low, 1.0).when(value < high, (high - value) / scale).otherwise(0.0)


def incident_predictions(entities: DataFrame, coverage: DataFrame, health: DataFrame, hotspots: DataFrame, outcomes: DataFrame, valid: DataFrame, mappings: DataFrame, runtime_health: DataFrame) -> DataFrame:
    """Noisy-OR of six risks of each entity, with severity, confidence and the strongest driver (the first of equals)."""
    rows = entities.join(coverage.select("entity_id", F.col("coverage_percent").alias("cov")), "entity_id", "left").join(health.select("entity_id", F.col("health_score").alias("health")), "entity_id", "left").join(hotspots.select(F.col("adr_id").alias("entity_id"), "hotspot_score", "bus_factor", "coupling_score", "blast_score"), "entity_id", "left").join(outcomes.select("entity_id", "outcome_type"), "entity_id", "left").join(valid.select(F.col("adr_id").alias("entity_id"), "validity_score"), "entity_id", "left")
    # the newest health of each component, then of an entity's components the last by name
    newest = latest_by_key(runtime_health, ["component_id"], "computed_at", ["health_score"]).select("component_id", F.col("health_score").alias("runtime"))
    live = mappings.join(newest, "component_id").groupBy("entity_id").agg(F.max_by("runtime", "component_id").alias("runtime"))
    rows = rows.join(live, "entity_id", "left")
    cov = _graded(F.coalesce("cov", F.lit(100.0)), 30, 80, 50.0)
    hot = F.when(F.coalesce("bus_factor", F.lit(10)) == 1, F.least(F.lit(1.0), (F.coalesce("blast_score", F.lit(0.0)) * 0.6 + F.coalesce("coupling_score", F.lit(0.0)) * 0.4) / 100)).otherwise(F.least(F.lit(1.0), F.coalesce("hotspot_score", F.lit(0.0)) / 100))
    sick = _graded(F.coalesce("health", F.lit(100.0)), 40, 90, 50.0)
    out = F.when(F.col("outcome_type") == "FAILED", 1.0).when(F.col("outcome_type").isin("DEGRADED", "DEGRADING"), 0.5).otherwise(0.0)
    val = _graded(F.coalesce("validity_score", F.lit(100.0)), 40, 80, 40.0)
    run = F.coalesce((100.0 - F.col("runtime")) / 100.0, F.lit(0.0))
    risks = {"COVERAGE": cov, "HOTSPOT": hot, "HEALTH": sick, "OUTCOME": out, "VALIDITY": val, "RUNTIME": run}
    rows = rows.select("entity_id", *[r.alias(k) for k, r in risks.items()])
    rest = F.lit(1.0)
    for k in risks:
        rest = rest * (1 - F.col(k))
    top = F.greatest(*[F.col(k) for k in risks])
    rows = rows.withColumn("total", 1 - rest).withColumn("top", top).where("total > 0")
    driver = F.coalesce(*[F.when(F.col(k) == F.col("top"), F.lit(k)) for k in risks])
    score = F.col("total") * 100
    return rows.select("entity_id", score.alias("risk_score"), F.when(score >= 90, "CRITICAL").when(score >= 70, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW").alias("severity"), F.least(F.lit(100), F.floor((F.col("top") + F.col("total") / 2) * 50) + 30).alias("confidence"), driver.alias("primary_driver"))


def escalations(incidents: DataFrame, days: int = 14) -> DataFrame:
    """The lock of (entity, type) as an ordered fold: an incident is emitted if none is locked, its lock is over `days` old, or it is more severe; RESOLVED clears the lock."""
    rank = F.when(F.col("severity") == "RESOLVED", 0).when(F.col("severity") == "MEDIUM", 1).when(F.col("severity") == "HIGH", 2).otherwise(3)
    own = incidents.select("entity_id", "incident_type", F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"), "id", rank.alias("r"))
    span = days * 86_400_000_000

    def step(lock, t, i, r):
        if r == 0:
            return None, None
        return ((t, r), (i,)) if lock is None or t - lock[0] > span or r > lock[1] else (lock, None)

    return sorted_fold(own, ["entity_id", "incident_type"], ["t", "id"], ["t", "id", "r"], step, f"id {own.schema['id'].dataType.simpleString()}")


def causal_chain(events: DataFrame) -> DataFrame:
    """Events (entity_id, event_date, kind, amount) as ordered chains: relation to the one before, share of the total, confidence."""
    w = Window.partitionBy("entity_id").orderBy("event_date", "kind")
    everything = Window.partitionBy("entity_id")
    rows = events.withColumn("step", F.row_number().over(w)).withColumn("prev_kind", F.lag("kind").over(w)).withColumn("prev_date", F.lag("event_date").over(w)).withColumn("share", F.col("amount") / F.sum("amount").over(everything) * 100).withColumn("n", F.count("*").over(everything)).withColumn("kinds", F.size(F.collect_set("kind").over(everything)))
    relation = F.when(F.col("prev_kind").isNull(), F.lit(None).cast("string")).when(F.col("prev_date") == F.col("event_date"), "CORRELATED_WITH").when(F.col("prev_kind") == F.col("kind"), "AMPLIFIED").when(F.col("share") > 30, "CONTRIBUTED_TO").otherwise("PRECEDED")
    confidence = F.least(F.lit(100), F.col("kinds") * 20 + F.least(F.lit(50), F.col("n") * 10) + F.when(F.col("n") > 1, 10).otherwise(0))
    return rows.select("entity_id", "step", "kind", "event_date", "amount", relation.alias("relation"), "share", confidence.alias("confidence"))


def evolution_events(snapshots: DataFrame) -> DataFrame:
    """(entity_id, snapshot_date, event_type, importance) of what changed since the snapshot before.

    snapshots: entity_id, snapshot_date, health_score, validity_score, bus_factor, node_count.
    """
    w = Window.partitionBy("entity_id").orderBy("snapshot_date")
    was = {c: F.lag(c).over(w) for c in ("health_score", "validity_score", "bus_factor", "node_count")}
    rows = snapshots.withColumns({f"was_{c}": x for c, x in was.items()}).withColumn("first", F.row_number().over(w) == 1)
    event = lambda when, kind, importance: F.when(when, F.struct(F.lit(kind).alias("event_type"), F.lit(importance).alias("importance")))
    health, validity_, bus, nodes = (F.col(c) for c in was)
    moved = lambda c: ~F.col("first") & (F.abs(F.col(c) - F.col(f"was_{c}")) > 5)
    events = [
        event(F.col("first"), "CREATED", 10),
        event(moved("health_score"), "HEALTH_CHANGED", 40), event(moved("health_score") & (F.col("was_health_score") >= 80) & (health < 80), "EVOLUTION_MILESTONE", 90),
        event(moved("validity_score"), "VALIDITY_CHANGED", 60), event(moved("validity_score") & (F.col("was_validity_score") >= 50) & (validity_ < 50), "EVOLUTION_MILESTONE", 90),
        event(~F.col("first") & (bus != F.col("was_bus_factor")), "RISK_CHANGED", 50), event(~F.col("first") & (F.col("was_bus_factor") > 1) & (bus == 1), "EVOLUTION_MILESTONE", 90),
        event(~F.col("first") & (nodes > F.col("was_node_count")), "EXPANDED", 10), event(~F.col("first") & (nodes < F.col("was_node_count")), "CONTRACTED", 10),
    ]
    return rows.select("entity_id", "snapshot_date", F.explode(F.array_compact(F.array(*events))).alias("e")).select("entity_id", "snapshot_date", "e.event_type", "e.importance")


def evolution(snapshots: DataFrame, as_of: str) -> DataFrame:
    """Velocity of each entity (importance of its events by day and size) and its status: EMERGING, OBSOLETE, STABLE, DECLINING or ACTIVE."""
    totals = evolution_events(snapshots).groupBy("entity_id").agg(F.sum("importance").alias("total"), F.count("*").alias("change_count"), F.min("snapshot_date").alias("first_seen"))
    latest = latest_by_key(snapshots, ["entity_id"], "snapshot_date", ["health_score", "validity_score", "bus_factor", "node_count"]).drop("snapshot_date")
    trends = [first_last(snapshots, ["entity_id"], "snapshot_date", c).select("entity_id", trend(F.col("n"), F.col("earliest"), F.col("latest")).alias(f"trend_{c}")) for c in ("health_score", "validity_score")]
    rows = totals.join(latest, "entity_id").join(trends[0], "entity_id").join(trends[1], "entity_id")
    days = F.greatest(F.lit(1), F.datediff(F.lit(as_of), "first_seen"))
    velocity = F.col("total") / 100 / (days * F.log10(F.greatest(F.lit(10), F.col("node_count"))))
    falling = (F.col("trend_health_score") == "DEGRADING") | (F.col("trend_validity_score") == "DEGRADING")
    status = F.when(days < 30, "EMERGING").when((F.col("validity_score") < 25) | (F.col("bus_factor") == 0), "OBSOLETE").when((velocity < 0.2) & (F.col("health_score") > 80), "STABLE").when(falling, "DECLINING").otherwise("ACTIVE")
    return rows.select("entity_id", "change_count", velocity.alias("velocity"), status.alias("status"))


def active_entities(coverage: DataFrame, hotspots: DataFrame, health: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(entity_id, entity_type) of all that have a signal, each once by type."""
    parts = [(coverage, "FILE"), (hotspots, "FILE"), (health, "MODULE"), (outcomes.where("entity_type = 'ADR'"), "ADR")]
    return reduce(DataFrame.union, [t.select("entity_id", F.lit(k).alias("entity_type")) for t, k in parts]).distinct()


def range_pairs(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, days: int) -> DataFrame:
    """Rows of right within `days` after a row of left, without any key: both sides meet in day buckets, so it is an equi-join."""
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 86_400_000_000).cast("long")
    spread = left.withColumn("_b", F.explode(F.sequence(bucket(left_ts), bucket(left_ts) + days)))
    met = spread.join(right.withColumn("_b", bucket(right_ts)), "_b")
    gap = F.unix_micros(F.col(right_ts).cast("timestamp")) - F.unix_micros(F.col(left_ts).cast("timestamp"))
    return met.where((gap >= 0) & (gap <= days * 86_400_000_000)).drop("_b")


def range_counts(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, days: int) -> DataFrame:
    """(key, n): how many rows of right lie within `days` after the rows of left of a key, without a row for each pair.

    A window is the difference of two running counts: both its ends and the rows of right are put in one order of time, dealt in
    ranges. Keys without any are left out, as in a join.
    """
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own = left.where(F.col(left_ts).isNotNull()).select(F.col(key).alias("_k"), at(left_ts).alias("_t"))
    # at one time the beginnings of windows come before the rows, the ends after them
    ends = F.array(F.struct(F.lit(0).alias("place"), F.col("_t").alias("t"), F.lit(-1).alias("sign")), F.struct(F.lit(2).alias("place"), (F.col("_t") + days * 86_400_000_000).alias("t"), F.lit(1).alias("sign")))
    points = own.select("_k", F.inline(ends)).withColumn("one", F.lit(0).cast("long"))
    # rows of one time are one, so that no time is too much for its range
    rows = right.where(F.col(right_ts).isNotNull()).groupBy(at(right_ts).alias("t")).agg(F.count("*").alias("one")).select(F.lit(None).cast(own.schema["_k"].dataType).alias("_k"), F.lit(1).alias("place"), "t", F.lit(0).alias("sign"), "one")
    counted = running(points.unionByName(rows), [F.col("t"), F.col("place"), F.col("_k")], ["one"])
    return counted.where("place <> 1").groupBy(F.col("_k").alias(key)).agg(F.sum(F.col("sign") * F.col("before_one")).cast("long").alias("n")).where("n > 0")


def confusion(p: Column, y: Column, cut: float = 0.4) -> Column:
    return F.when((p >= cut) & (y == 1), "TP").when((p >= cut) & (y == 0), "FP").when((p < cut) & (y == 1), "FN").otherwise("TN")


def accountability(predictions: DataFrame) -> DataFrame:
    """Brier score, false positive and negative rates, and precision of the predicted types, by engine version (version, p, y, match)."""
    state = predictions.withColumn("state", confusion(F.col("p"), F.col("y")))
    count = lambda k: F.count_if(F.col("state") == k)
    return state.groupBy("version").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), (count("FP") / F.greatest(F.lit(1), count("FP") + count("TN"))).alias("fpr"), (count("FN") / F.greatest(F.lit(1), count("FN") + count("TP"))).alias("fnr"), (F.count_if(F.col("match").isin("TYPE_MATCH", "PARTIAL_MATCH")) / F.greatest(F.lit(1), F.sum("y"))).alias("type_precision"), F.count("*").alias("n"))


def engine_trust(metrics: DataFrame) -> DataFrame:
    """Metrics (version, name, value) in one row a version; trustworthy under a Brier score of .15, .10 false positives and .05 false negatives."""
    wide = metrics.groupBy("version").pivot("name", ["brier", "fpr", "fnr", "type_precision"]).agg(F.max("value"))
    return wide.withColumn("trustworthy", (F.col("brier") < 0.15) & (F.col("fpr") < 0.10) & (F.col("fnr") < 0.05))


def type_match(expected: Column, actual: Column) -> Column:
    """TYPE_MATCH if both arrays are as long and every expected type is there, PARTIAL_MATCH if any is, else TYPE_MISMATCH; null without expectation."""
    all_there = F.size(F.filter(expected, lambda x: ~F.array_contains(actual, x))) == 0
    return F.when(expected.isNull() | actual.isNull(), F.lit(None).cast("string")).when((F.size(expected) == F.size(actual)) & all_there, "TYPE_MATCH").when(F.arrays_overlap(expected, actual), "PARTIAL_MATCH").otherwise("TYPE_MISMATCH")


# Sinks on immutable tables


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Last wins: rows of new in place of those with their keys."""
    return old.join(new, keys, "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """First wins."""
    return old.unionByName(new.join(old, keys, "left_anti"))


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """All rows of the groups that new touches are replaced by new's."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def latest_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def without_tombstones(rows: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    """Rows not deleted; a row written after its tombstone (by seq) is alive again."""
    dead = tombstones.groupBy(*keys).agg(F.max("seq").alias("_dead"))
    return rows.join(dead, keys, "left").where(F.col("_dead").isNull() | (F.col("seq") > F.col("_dead"))).drop("_dead")


def retained(rows: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    return rows.where(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))
