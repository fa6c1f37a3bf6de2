"""Streaming queries: the input as files arriving, drained, and held against the batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataflow.functions.session import shared_dir

from strataflow.plans.registry import ORACLE_SQL, query
from strataflow.plans import runtime, snapshots  # noqa: F401  their SQL is the reference of the twins
from strataflow.sources.adapters import table
from strataflow.streaming import folds
from strataflow.streaming import streams as op


def _events(spark, d):
    return op.event_stream(spark, f"{d}/event[s].parquet")


@query("x6_stream_windows", ORACLE_SQL["x6_sliding_windows"])
def x6_stream_windows(spark, d):
    return op.drained(op.windowed_counts(_events(spark, d), "ts", "event_type", "3 days", "1 day", "60 days"), "complete").select("event_type", F.col("start").cast("date").alias("w"), "n")


@query("x7_stream_escalations", ORACLE_SQL["x7_incident_escalations"])
def x7_stream_escalations(spark, d):
    kind = F.element_at(F.array(F.lit("OOM"), F.lit("TIMEOUT"), F.lit("DEADLOCK"), F.lit("CRASH")), (F.col("user_id") % 4 + 1).cast("int"))
    severity = F.when(F.col("value") >= 150, "CRITICAL").when(F.col("value") >= 100, "HIGH").when(F.col("event_id") % 7 == 0, "RESOLVED").otherwise("MEDIUM")
    rows = _events(spark, d).where("event_type = 'error' AND value >= 40").select(F.col("event_id").alias("id"), F.concat(F.lit("ADR-"), (F.col("user_id") % 30).cast("string")).alias("entity_id"), kind.alias("incident_type"), severity.alias("severity"), F.col("ts").alias("created_at"))
    return op.drained(op.escalations(rows))


@query("x8_stream_deduplication", "SELECT event_id, event_type FROM events")
def x8_stream_deduplication(spark, d):
    twice = _events(spark, d).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    return op.drained(op.idempotent(twice, "ts", "event_id").select("event_id", "event_type"))


@query("x1_latest_change_by_key", "SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, count(*) AS n FROM events GROUP BY user_id")
def x1_latest_change_by_key(spark, d):
    return op.drained(op.latest_by_key(_events(spark, d), "user_id", "ts", ["event_type"]), "complete")


def _arriving(spark, d, part_rows=500_000):
    """The events in files that arrive one after the other, each a stretch of time in no order, and one far later event for every user: time goes on.

    A stretch is one file, of about `part_rows` rows: the watermark moves between triggers, and what is left of a stretch for a later one would be late.
    """
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = f"{shared_dir(spark)}/arriving-{uuid.uuid4().hex}"
    parts = max(4, -(-rows.count() // part_rows))
    # events of one time are one stretch's; stretches are as full as each other, however time is
    cuts = rows.where("ts IS NOT NULL").repartitionByRange(parts, "ts").withColumn("stretch", F.spark_partition_id())
    cuts.write.partitionBy("stretch").parquet(f"{path}/stretches")
    for k in sorted(int(r[0]) for r in spark.read.parquet(f"{path}/stretches").select("stretch").distinct().collect()):
        own = spark.read.schema(rows.schema).parquet(f"{path}/stretches/stretch={k}")
        own.repartition(1).sortWithinPartitions(F.xxhash64("event_id")).write.mode("append").parquet(f"{path}/in/part={k}")
    for k, days in ((parts, 400), (parts + 1, 500)):
        rows.groupBy("user_id").agg(F.lit(-1).cast(rows.schema["event_id"].dataType).alias("event_id"), F.lit("error").alias("event_type"), F.lit(200.0).alias("value"), F.date_add(F.max("ts"), days).cast("timestamp").alias("ts")).write.mode("append").parquet(f"{path}/in/part={k}")
    return op.event_stream(spark, f"{path}/in/part=*", 8)


@query("w11_timed_debounce", ORACLE_SQL["w11_debounce"])
def w11_timed_debounce(spark, d):
    rows = _arriving(spark, d).select(F.concat(F.lit("svc"), "event_type").alias("component_id"), "ts", "event_id")
    with folds.rocks(spark):
        return op.drained(folds.debounced(rows, 60, "1 day")).where("event_id >= 0").select("component_id", "event_id")


@query("x7_timed_escalations", ORACLE_SQL["x7_incident_escalations"])
def x7_timed_escalations(spark, d):
    kind = F.element_at(F.array(F.lit("OOM"), F.lit("TIMEOUT"), F.lit("DEADLOCK"), F.lit("CRASH")), (F.col("user_id") % 4 + 1).cast("int"))
    severity = F.when(F.col("value") >= 150, "CRITICAL").when(F.col("value") >= 100, "HIGH").when(F.col("event_id") % 7 == 0, "RESOLVED").otherwise("MEDIUM")
    rows = _arriving(spark, d).where("event_type = 'error' AND value >= 40").select(F.col("event_id").alias("id"), F.concat(F.lit("ADR-"), (F.col("user_id") % 30).cast("string")).alias("entity_id"), kind.alias("incident_type"), severity.alias("severity"), F.col("ts").alias("created_at"))
    with folds.rocks(spark):
        return op.drained(folds.escalations(rows, late="1 day")).where("id >= 0").select("entity_id", "incident_type", "id")
