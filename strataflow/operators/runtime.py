"""Runtime analytics over event streams: baselines, health, anomaly patterns, calibration, dependency discovery, blast radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.operators.folds import sorted_fold

#: Fixed prior weights of event types.
PRIORS = {"OOM": 0.8, "TIMEOUT": 0.5, "DEADLOCK": 0.7, "CRASH": 0.9, "DEFAULT": 0.1}


def daily_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("component_id", "event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))


def baselines(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Mean and population variance of daily counts over `days` days, days without events counting 0."""
    recent = events.where(F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))
    n = F.greatest(F.lit(days), F.count("*"))
    mean = F.sum("n") / n
    return daily_counts(recent).groupBy("component_id", "event_type").agg(mean.alias("mean"), (F.sum(F.col("n") * F.col("n")) / n - mean * mean).alias("variance"))


def recent_counts(events: DataFrame, as_of: str, days: int = 1) -> DataFrame:
    return events.where((F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") < F.lit(as_of).cast("timestamp_ntz"))).groupBy("component_id", "event_type").agg(F.count("*").alias("n"))


def health(counts: DataFrame, base: DataFrame, weights: DataFrame, default: float = 0.5) -> DataFrame:
    """Score, status and primary driver of each component: n * w * 1.5 and 4 w for what exceeds ceil(mean + sd)."""
    rows = counts.join(base, ["component_id", "event_type"], "left").join(weights.select("event_type", "weight"), "event_type", "left").withColumn("w", F.coalesce("weight", F.lit(default)))
    excess = F.when(F.col("mean").isNull(), F.col("n")).otherwise(F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("mean") + F.sqrt("variance"))))
    rows = rows.withColumn("penalty", F.col("n") * F.col("w") * 1.5 + excess * F.col("w") * 4.0)
    # the driver is the first of the largest penalties by event type
    scored = rows.groupBy("component_id").agg(F.sum("penalty").alias("total"), F.min_by("event_type", F.struct(-F.round("penalty", 9), "event_type")).alias("primary_driver"))
    score = F.greatest(F.lit(0), F.floor(100 - F.col("total") + 0.5)).cast("long")
    return scored.select("component_id", score.alias("health_score"), F.when(score < 50, "CRITICAL").when(score < 90, "DEGRADED").otherwise("HEALTHY").alias("status"), "primary_driver")


def anomalies(counts: DataFrame, base: DataFrame, floor: float = 5) -> DataFrame:
    """Counts above max(floor, mean + 3 sd)."""
    rows = counts.join(base, ["component_id", "event_type"], "left")
    limit = F.greatest(F.lit(float(floor)), F.coalesce(F.col("mean") + 3 * F.sqrt("variance"), F.lit(0.0)))
    return rows.withColumn("threshold", limit).where(F.col("n") > F.col("threshold")).select("component_id", "event_type", "n", "threshold")


def calibration(counts: DataFrame) -> DataFrame:
    """Weights of event types (event_type, n) by mode: priors under 10 incidents, blended under 30, then empirical; Laplace where entropy is low."""
    spark = counts.sparkSession
    prior = spark.range(1).select(F.explode(F.create_map(*[x for k, v in PRIORS.items() for x in (F.lit(k), F.lit(v))])).alias("event_type", "prior"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("classes"))
    p = F.col("n") / F.col("total")
    entropy = counts.join(F.broadcast(total)).agg(F.coalesce(F.sum(-p * F.log2(p)), F.lit(0.0)).alias("entropy"))
    types = counts.select("event_type").union(prior.select("event_type")).distinct()
    rows = types.join(counts, "event_type", "left").join(prior, "event_type", "left").join(F.broadcast(total)).join(F.broadcast(entropy)).join(F.broadcast(types.agg(F.count("*").alias("n_types")))).fillna({"n": 0, "prior": PRIORS["DEFAULT"]})
    norm = F.when(F.col("classes") > 1, F.col("entropy") / F.log2(F.col("classes"))).otherwise(0.0)
    empirical = F.when(F.col("total") == 0, 0.0).when(norm < 0.5, (F.col("n") + 1) / (F.col("total") + F.col("n_types"))).otherwise(F.col("n") / F.col("total"))
    blend = (F.col("total") - 9) / 20.0
    mode = F.when(F.col("total") >= 30, "CALIBRATED").when(F.col("total") >= 10, "WARM").otherwise("COLD")
    weight = F.when(mode == "CALIBRATED", empirical).when(mode == "WARM", F.col("prior") * (1 - blend) + empirical * blend).otherwise(F.col("prior"))
    confidence = F.least(F.lit(1.0), F.col("total") / 30.0) * F.when((F.col("classes") == 0) | (norm >= 0.5), 1.0).otherwise(0.6)
    return rows.select("event_type", weight.alias("weight"), confidence.alias("confidence"), mode.alias("mode"))


def debounced(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Events of a component more than `seconds` after the last one kept.

    An event further than that from the event before it is always kept, so the series falls into sessions that
    are folded on their own, row by row.
    """
    gap = seconds * 1_000_000
    w = Window.partitionBy("component_id").orderBy("t", "event_id")
    own = events.select("component_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    opened = own.withColumn("new", (F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(gap + 1)) > gap).cast("int")).withColumn("session", F.sum("new").over(w))

    def step(last, t, event_id):
        return (t, (t, event_id)) if last is None or t - last > gap else (last, None)

    return sorted_fold(opened, ["component_id", "session"], ["t", "event_id"], ["t", "event_id"], step, f"t long, event_id {opened.schema['event_id'].dataType.simpleString()}").drop("session")


def temporal_pairs(kept: DataFrame, lag_s: int = 60, macro_s: int = 5, macro_components: int = 3, least: int = 3, confidence: float = 0.6) -> DataFrame:
    """Components that follow others by 1 to `lag_s` seconds `least` times or more; moments with over `macro_components` components within `macro_s` do not count.

    The self-joins are range joins without a key, so both sides meet in buckets of time.
    """
    width = lag_s * 1_000_000
    bucketed = kept.withColumn("b", F.floor(F.col("t") / width).cast("long"))
    near = F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b")
    crowd = bucketed.select("event_id", "t", near).alias("x").join(bucketed.select(F.col("component_id").alias("c"), F.col("t").alias("u"), "b").alias("y"), "b").where(F.abs(F.col("u") - F.col("t")) <= macro_s * 1_000_000).groupBy("event_id").agg(F.count_distinct("c").alias("n")).where(F.col("n") <= macro_components)
    calm = bucketed.join(crowd.select("event_id"), "event_id", "left_semi")
    forward = F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b")
    pairs = calm.select(F.col("component_id").alias("target"), "t", forward).join(calm.select(F.col("component_id").alias("source"), F.col("t").alias("u"), "b"), "b").where((F.col("source") != F.col("target")) & (F.col("u") - F.col("t") >= 1_000_000) & (F.col("u") - F.col("t") <= width))
    return pairs.groupBy("source", "target").agg(F.count("*").alias("observations")).where(F.col("observations") >= least).withColumn("confidence", F.lit(confidence))


def decayed(confidence: Column, age_days: Column) -> Column:
    return F.when(age_days <= 7, confidence).when(age_days <= 30, confidence * 0.75).when(age_days <= 90, confidence * 0.5).otherwise(0.0)


def dependency_view(evidence: DataFrame, as_of: str, least: float = 0.1) -> DataFrame:
    """Dependencies from evidence: decayed, corroborated by further sources, without those that a tombstone ends."""
    dead = evidence.where("dependency_type = 'TOMBSTONE'").select("source", "target").distinct()
    age = F.datediff(F.lit(as_of), F.col("discovered_at"))
    alive = evidence.where("dependency_type <> 'TOMBSTONE'").join(dead, ["source", "target"], "left_anti").withColumn("decayed", decayed(F.col("raw_confidence"), age))
    found = alive.groupBy("source", "target").agg(F.least(F.lit(1.0), F.max("decayed") + 0.1 * F.greatest(F.lit(0), F.count_distinct("evidence_source") - 1)).alias("confidence"), F.count("*").alias("n"))
    return found.where(F.col("confidence") >= least)


def blast_radius(edges: DataFrame, failing: DataFrame, depth: int = 5) -> DataFrame:
    """Risk that failing components (component_id, risk) bring to others over dependents (source depends on target).

    A path of k hops carries risk * prod(confidence) * prod(type factor) * 0.85 ** (k - 1); of each source and target the best
    path counts, and sources join by noisy-or. edges: (source, target, confidence, factor). Only the best value of a
    (start, node) pair goes on from a round, so the frontier is bounded by the pairs and not by the paths.
    """
    frontier = failing.select(F.col("component_id").alias("start"), F.col("component_id").alias("node"), F.col("risk").alias("value"))
    best = None
    for hop in range(1, depth + 1):
        decay = 0.85 if hop > 1 else 1.0
        reached = frontier.join(edges, F.col("node") == F.col("target")).select("start", F.col("source").alias("node"), (F.col("value") * F.col("confidence") * F.col("factor") * decay).alias("value")).where("start <> node")
        frontier = reached.groupBy("start", "node").agg(F.max("value").alias("value"))
        best = frontier if best is None else best.unionByName(frontier)
    top = best.groupBy("start", "node").agg(F.round(F.max("value"), 4).alias("risk"))
    return top.groupBy(F.col("node").alias("component_id")).agg((1 - F.product(1 - F.col("risk"))).alias("blast_risk"), F.count("*").alias("sources"))


def latest_unhealthy(history: DataFrame) -> DataFrame:
    """The latest unhealthy state of each component, whether or not it recovered since."""
    rank = F.row_number().over(Window.partitionBy("component_id").orderBy(F.col("computed_at").desc()))
    return history.where("status <> 'HEALTHY'").withColumn("rn", rank).where("rn = 1").drop("rn")


def covered_lines(bits: Column) -> Column:
    """Line numbers of a coverage bitmap, least significant bit first: line = byte * 8 + bit + 1."""
    n = F.octet_length(bits)
    byte = lambda i: F.conv(F.hex(F.substring(bits, i + 1, 1)), 16, 10).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n * 8 - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(places, lambda p: F.pmod(F.floor(byte(F.floor(p / 8).cast("int")) / F.pow(F.lit(2.0), p % 8)), F.lit(2)) == 1), lambda p: p + 1)


def debounced_changes(events: DataFrame, seconds: int = 2) -> DataFrame:
    """(file, at, kind, n): the last change of each burst of a file; changes are one burst while the next comes within `seconds`."""
    bursts = events.groupBy("file", F.session_window("at", f"{seconds} seconds").alias("w"))
    return bursts.agg(F.max_by("kind", F.struct("at", "seq")).alias("kind"), F.max("at").alias("at"), F.count("*").alias("n")).select("file", "at", "kind", "n")


def reconcile_runs(triggers: DataFrame, debounce: int = 1, duration: int = 5) -> DataFrame:
    """(repository, start, n): when reconciliation runs: `debounce` seconds after the last trigger of a burst, never while a run of `duration` seconds is going on; bursts that end meanwhile are one run after it.

    triggers: repository, at. An ordered fold over a repository's bursts.
    """
    bursts = triggers.groupBy("repository", F.session_window("at", f"{debounce} seconds").alias("w")).agg(F.max("at").alias("last"), F.count("*").alias("n"))
    due = (F.unix_micros(F.col("last").cast("timestamp")) + debounce * 1_000_000).alias("due")
    listed = bursts.groupBy("repository").agg(F.sort_array(F.collect_list(F.struct(due, "n"))).alias("bs"))
    empty = F.array().cast("array<struct<start:bigint,n:bigint>>")

    def step(runs, b):
        prior = F.try_element_at(runs, F.lit(-1))
        free = prior["start"] + duration * 1_000_000
        waits = prior["start"].isNotNull() & (prior["start"] > b["due"])
        more = F.struct(prior["start"].alias("start"), (prior["n"] + b["n"]).alias("n"))
        begin = F.struct(F.greatest(b["due"], F.coalesce(free, b["due"])).alias("start"), b["n"].alias("n"))
        return F.when(waits, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(more))).otherwise(F.concat(runs, F.array(begin)))

    return listed.select("repository", F.explode(F.aggregate("bs", empty, step)).alias("r")).select("repository", F.timestamp_micros("r.start").alias("start"), "r.n")
