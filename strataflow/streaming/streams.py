"""Structured Streaming twins of the event operators: windows under a watermark, deduplication, the incident lock, latest state by key."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions.session import shared_dir


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Files of a path (or glob) as a stream, with the schema that they have."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the input at hand, as a table: exactly once by batch number, then stopped."""
    spark = stream.sparkSession
    base = _scratch(spark)

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces its own rows
        target = "all" if mode == "complete" else f"batch={number}"
        batch.write.mode("overwrite").parquet(f"{base}/out/{target}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/all" if mode == "complete" else f"{base}/out/*")


def windowed_counts(events: DataFrame, ts: str, key: str, size: str, slide: str, late: str = "1 day") -> DataFrame:
    """Counts by key in sliding windows; what is later than `late` is dropped."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(key, F.window(ts, size, slide).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def idempotent(events: DataFrame, ts: str, key: str, late: str = "2 days") -> DataFrame:
    """Each key once, however often it is delivered within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def debounced(events: DataFrame, gap: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """The last change of each burst of a file (file, at, seq, kind), once no event can continue it."""
    timed = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    bursts = timed.groupBy("file", F.session_window("at", gap).alias("w")).agg(F.max_by("kind", F.struct("at", "seq")).alias("kind"), F.max("at").alias("at"), F.count("*").alias("n"))
    return bursts.select("file", "at", "kind", "n")


def escalations(incidents: DataFrame, days: int = 14) -> DataFrame:
    """The lock of (entity, type) as keyed state: what batch gives by a fold over the whole history, in micro-batches.

    The state is the time and rank of the locked incident; a batch's rows are folded in the order of time and id.
    """
    span = days * 86_400_000_000
    rank = {"RESOLVED": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, level = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(parts)).sort_values(["t", "id"])
        out = []
        for t, i, severity in zip(rows["t"], rows["id"], rows["severity"], strict=True):
            r = rank[severity]
            if r == 0:
                at, level = -1, 0
            elif at < 0 or t - at > span or r > level:
                at, level = int(t), r
                out.append(int(i))
        state.update((int(at), int(level)))
        yield pd.DataFrame({"entity_id": [key[0]] * len(out), "incident_type": [key[1]] * len(out), "id": out})

    own = incidents.select("entity_id", "incident_type", "severity", "id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"))
    return own.groupBy("entity_id", "incident_type").applyInPandasWithState(step, "entity_id string, incident_type string, id long", "at long, level long", "append", "NoTimeout")


def latest_by_key(events: DataFrame, key: str, ts: str, values: list[str]) -> DataFrame:
    """The newest row of each key, kept as aggregation state: changes to a key between triggers come out once."""
    return events.groupBy(key).agg(*[F.max_by(v, F.struct(ts, "event_id")).alias(v) for v in values], F.count("*").alias("n"))
