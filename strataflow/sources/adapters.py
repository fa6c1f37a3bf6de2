"""Roles of the engine (change history, decisions, snapshots, events, texts) on the star-schema tables.

Operators take role-typed DataFrames; an adapter gives a role from the tables at hand. Each adapter has the
same projection as SQL, for the queries' reference results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment analyses look back from; operators take it as an argument, never the wall clock.
AS_OF = "2001-09-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(key: str):
    return F.concat(F.lit("m"), (F.col(key) % 20).cast("string"), F.lit("/p"), F.col(key).cast("string"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha, author_email, ts, n_parents): orders; every 17th is a merge, every 40th developer a bot."""
    dev = F.when(F.col("o_custkey") % 40 == 0, F.concat(F.lit("bot"), (F.col("o_custkey") % 3).cast("string"), F.lit("[bot]"))).otherwise(F.concat(F.lit("Dev"), (F.col("o_custkey") % 40).cast("string")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), dev.alias("author_email"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderkey") % 17 == 0, 2).otherwise(1).alias("n_parents"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha, path, change_type): line items; a returned one is a deletion, every 97th part a lock file."""
    path = F.when(F.col("l_partkey") % 97 == 0, F.concat(F.lit("m"), (F.col("l_partkey") % 20).cast("string"), F.lit("/package-lock.json"))).otherwise(_path("l_partkey"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), path.alias("path"), F.when(F.col("l_returnflag") == "R", "DELETE").otherwise("MODIFY").alias("change_type"))


def adr_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(adr_id, node_id, confidence, score): parts of even size are governed by one of 25 decisions."""
    return table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.concat(F.lit("ADR-"), (F.col("p_partkey") % 25).cast("string")).alias("adr_id"), _path("p_partkey").alias("node_id"), (F.col("p_size") / 50.0).alias("confidence"), F.col("p_size").alias("score"))


def adrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, created_at): decisions 0 to 29, five of them without links; the nth is of the nth quarter from 1995 on."""
    return spark.range(30).select(F.concat(F.lit("ADR-"), F.col("id").cast("string")).alias("id"), F.add_months(F.lit("1995-01-01").cast("date"), (F.col("id") * 3).cast("int")).alias("created_at"))


def runtime_events(spark: SparkSession, sf_dir: str, component: str = "user_id % 10") -> DataFrame:
    """(event_id, component_id, event_type, severity, ts)."""
    severity = F.when(F.col("value") >= 100, "CRITICAL").when(F.col("value") >= 50, "ERROR").when(F.col("value") >= 20, "WARNING").otherwise("INFO")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("svc"), F.expr(component).cast("string")).alias("component_id"), "event_type", severity.alias("severity"), "ts", "value")


def health_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_type, entity_id, snapshot_date, health_score): daily mean of an entity's event values, at most 100."""
    ev = table(spark, sf_dir, "events").select(F.concat(F.lit("ADR-"), (F.col("user_id") % 30).cast("string")).alias("entity_id"), F.col("ts").cast("date").alias("snapshot_date"), "value")
    return ev.groupBy("entity_id", "snapshot_date").agg((F.floor(F.least(F.lit(100.0), F.avg("value") + 25) * 100 + 1e-6) / 100).alias("health_score")).select(F.lit("ADR").alias("entity_type"), "entity_id", "snapshot_date", "health_score")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, entity_id, incident_type, severity, created_at): error events of value 40 and more."""
    kind = F.element_at(F.array(F.lit("OOM"), F.lit("TIMEOUT"), F.lit("DEADLOCK"), F.lit("CRASH")), (F.col("user_id") % 4 + 1).cast("int"))
    severity = F.when(F.col("value") >= 150, "CRITICAL").when(F.col("value") >= 100, "HIGH").when(F.col("event_id") % 7 == 0, "RESOLVED").otherwise("MEDIUM")
    return table(spark, sf_dir, "events").where("event_type = 'error' AND value >= 40").select(F.col("event_id").alias("id"), F.concat(F.lit("ADR-"), (F.col("user_id") % 30).cast("string")).alias("entity_id"), kind.alias("incident_type"), severity.alias("severity"), F.col("ts").alias("created_at"))


def coverage_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, snapshot_date, coverage_percent): the share of an entity's events in a day that are no errors."""
    ev = table(spark, sf_dir, "events").select(F.concat(F.lit("ADR-"), (F.col("user_id") % 30).cast("string")).alias("entity_id"), F.col("ts").cast("date").alias("snapshot_date"), "event_type", "value")
    return ev.groupBy("entity_id", "snapshot_date").agg(F.round(F.count_if(F.col("value") >= 25) * 100.0 / F.count("*"), 2).alias("coverage_percent"))


#: The same roles as CTEs.
CTE = {
    "commits": """commits AS (SELECT o_orderkey AS sha, CASE WHEN o_custkey % 40 = 0 THEN 'bot' || (o_custkey % 3) || '[bot]' ELSE 'Dev' || (o_custkey % 40) END AS author_email,
        o_orderdate AS ts, CASE WHEN o_orderkey % 17 = 0 THEN 2 ELSE 1 END AS n_parents FROM orders)""",
    "commit_files": """commit_files AS (SELECT l_orderkey AS sha, 'm' || (l_partkey % 20) || CASE WHEN l_partkey % 97 = 0 THEN '/package-lock.json' ELSE '/p' || l_partkey END AS path,
        CASE WHEN l_returnflag = 'R' THEN 'DELETE' ELSE 'MODIFY' END AS change_type FROM lineitem)""",
    "adr_links": """adr_links AS (SELECT 'ADR-' || (p_partkey % 25) AS adr_id, 'm' || (p_partkey % 20) || '/p' || p_partkey AS node_id, p_size / 50.0 AS confidence, p_size AS score
        FROM part WHERE p_size % 2 = 0)""",
    "adrs": "adrs AS (SELECT 'ADR-' || i AS id, CAST(DATE '1995-01-01' + to_months(CAST(i * 3 AS INTEGER)) AS DATE) AS created_at FROM range(30) t(i))",
    "runtime_events": """runtime_events AS (SELECT event_id, 'svc' || (user_id % 10) AS component_id, event_type, CASE WHEN value >= 100 THEN 'CRITICAL' WHEN value >= 50 THEN 'ERROR'
        WHEN value >= 20 THEN 'WARNING' ELSE 'INFO' END AS severity, ts, value FROM events)""",
    "health_history": """health_history AS (SELECT 'ADR' AS entity_type, 'ADR-' || (user_id % 30) AS entity_id, CAST(ts AS DATE) AS snapshot_date, floor(least(100.0, avg(value) + 25) * 100 + 1e-6) / 100 AS health_score
        FROM events GROUP BY ALL)""",
    "incidents": """incidents AS (SELECT event_id AS id, 'ADR-' || (user_id % 30) AS entity_id, ['OOM', 'TIMEOUT', 'DEADLOCK', 'CRASH'][user_id % 4 + 1] AS incident_type,
        CASE WHEN value >= 150 THEN 'CRITICAL' WHEN value >= 100 THEN 'HIGH' WHEN event_id % 7 = 0 THEN 'RESOLVED' ELSE 'MEDIUM' END AS severity, ts AS created_at
        FROM events WHERE event_type = 'error' AND value >= 40)""",
    "coverage_history": """coverage_history AS (SELECT 'ADR-' || (user_id % 30) AS entity_id, CAST(ts AS DATE) AS snapshot_date, round(count(*) FILTER (value >= 25) * 100.0 / count(*), 2) AS coverage_percent
        FROM events GROUP BY ALL)""",
}


def with_(*names: str) -> str:
    """The start of a statement that uses the named roles."""
    return "WITH " + ", ".join(CTE[n] for n in names)
