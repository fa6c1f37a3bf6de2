"""Queries of the data sources, the keyed tables, and their synchronisation; the files they read are written from the tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions.session import cut, shared_dir
from strataflow.operators import sketches
from strataflow.plans.registry import query
from strataflow.sources import readers
from strataflow.sources.adapters import table
from strataflow.sources.datasource import register
from strataflow.sources.generations import Generations
from strataflow.sources.keyed import KeyedTable
from strataflow.streaming.streams import drained
from strataflow.streaming.sync import synchronise, watermarks


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_COMMITS = "commits AS (SELECT o_orderkey AS sha, 'Dev' || (o_custkey % 40) AS author_email, CAST(o_orderdate AS TIMESTAMP) AS ts, CASE WHEN o_orderkey % 17 = 0 THEN 2 ELSE 1 END AS n_parents FROM orders)"
_FILES = "files AS (SELECT l_orderkey AS sha, 'm' || (l_partkey % 20) || '/p' || l_partkey AS path, CASE WHEN max(l_returnflag) = 'R' THEN 'DELETE' ELSE 'MODIFY' END AS change_type, CAST(sum(l_quantity) AS BIGINT) AS added FROM lineitem GROUP BY ALL)"


#: Files that a year's commits are dealt over, at most.
_PER_YEAR = 16


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, value): commits as git prints them, with their year: an order is a commit, its parts are the files."""
    path_of = F.concat(F.lit("m"), (F.col("l_partkey") % 20).cast("string"), F.lit("/p"), F.col("l_partkey").cast("string"))
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sha"), path_of.alias("path")).agg(F.max("l_returnflag").alias("flag"), F.sum("l_quantity").cast("long").alias("added"))
    line = F.concat(F.lit(":100644 100644 1 2 "), F.when(F.col("flag") == "R", "D").otherwise("M"), F.lit("\t"), F.col("path"), F.lit("\n"), F.col("added").cast("string"), F.lit("\t0\t"), F.col("path"))
    lines = files.groupBy("sha").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.concat(F.lit("Dev"), (F.col("o_custkey") % 40).cast("string")).alias("author"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.when(F.col("o_orderkey") % 17 == 0, "p q").otherwise("p").alias("parents"))
    head = F.concat_ws("\u001f", F.concat(F.lit("\u001e"), F.col("sha").cast("string")), "author", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "parents", F.concat(F.lit("change "), F.col("sha").cast("string")))
    return orders.join(lines, "sha", "left").select(F.year("ts").alias("y"), F.concat(head, F.lit("\n\n"), F.coalesce("lines", F.lit(""))).alias("value"))


def write_logs(records: DataFrame, path: str) -> str:
    """Change logs in files, a folder for each year; a year is no single task's."""
    records.repartition(F.col("y"), F.pmod(F.xxhash64("value"), F.lit(_PER_YEAR))).write.mode("append").partitionBy("y").text(path)
    return path


@query("s4_gitlog_source", f"WITH {_COMMITS}, {_FILES} SELECT author_email, count(DISTINCT c.sha) AS commits, count(path) AS files, count(*) FILTER (change_type = 'DELETE') AS deleted, CAST(sum(added) AS BIGINT) AS added FROM commits c LEFT JOIN files USING (sha) WHERE ts >= TIMESTAMP '1997-01-01 00:00:00' GROUP BY author_email")
def s4_gitlog_source(spark: SparkSession, d: str) -> DataFrame:
    log = register(spark).read.format("gitlog").load(write_logs(log_records(spark, d), _folder(spark, "logs"))).where(F.col("ts") >= F.lit("1997-01-01").cast("timestamp"))
    kinds = F.filter("files", lambda f: f["change_type"] == "DELETE")
    return log.groupBy("author_email").agg(F.count("*").alias("commits"), F.sum(F.size("files")).alias("files"), F.sum(F.size(kinds)).alias("deleted"), F.sum(F.aggregate("files", F.lit(0).cast("long"), lambda s, f: s + f["added"])).alias("added"))


@query("s4_gitlog_stream", f"WITH {_COMMITS}, {_FILES} SELECT c.sha, author_email, n_parents, count(path) AS files FROM commits c LEFT JOIN files USING (sha) GROUP BY ALL")
def s4_gitlog_stream(spark: SparkSession, d: str) -> DataFrame:
    stream = register(spark).readStream.format("gitlog").load(write_logs(log_records(spark, d), _folder(spark, "logs")))
    return drained(stream.select(F.col("sha").cast("long").alias("sha"), "author_email", "n_parents", F.size("files").cast("long").alias("files")))


_PULLS = "SELECT 'pr' || (o_orderkey % 5000) AS id, 'Change ' || o_orderkey AS title, 'Dev' || (o_custkey % 40) AS author, CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'open' ELSE 'closed' END AS state, CAST(o_orderdate AS TIMESTAMP) AS updated_at FROM {0}"


@query("s6_pull_request_source", f"WITH p AS ({_PULLS.format('orders')}) SELECT id, title, author, state, CAST(updated_at AS DATE) AS updated FROM p WHERE updated_at > TIMESTAMP '1996-01-01 00:00:00' QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, title DESC) = 1")
def s6_pull_request_source(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(_PULLS.format("{orders}"), orders=table(spark, d, "orders"))
    rows.select(F.to_json(F.struct("id", "title", "author", "state", F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"))).alias("value")).write.text(path := _folder(spark, "pulls"))
    pulls = register(spark).read.format("pullrequests").load(path).where(F.col("updated_at") > F.lit("1996-01-01").cast("timestamp"))
    last = pulls.groupBy("id").agg(F.max_by(F.struct("title", "author", "state", "updated_at"), F.struct("updated_at", "title")).alias("r"))
    return last.select("id", "r.title", "r.author", "r.state", F.col("r.updated_at").cast("date").alias("updated"))


_SPANS = "SELECT 't' || l_orderkey AS \"traceId\", l_orderkey || '.' || l_linenumber AS \"spanId\", CASE WHEN l_linenumber > 1 THEN l_orderkey || '.' || (l_linenumber - 1) END AS \"parentSpanId\", 'svc' || (l_suppkey % 12) AS service FROM {0}"


@query("s9_span_source", f'WITH s AS ({_SPANS.format("lineitem")}) SELECT p.service AS source, c.service AS target, count(*) AS observed FROM s c JOIN s p ON p."traceId" = c."traceId" AND p."spanId" = c."parentSpanId" WHERE p.service <> c.service GROUP BY ALL')
def s9_span_source(spark: SparkSession, d: str) -> DataFrame:
    spark.sql(_SPANS.format("{lineitem}").replace('"', "`"), lineitem=table(spark, d, "lineitem")).select(F.to_json(F.struct("*")).alias("value")).write.text(path := _folder(spark, "spans"))
    # both sides of the join come from one reading of the files
    spans = cut(register(spark).read.format("spans").load(path).select("trace_id", "span_id", "parent_span_id", "service"))
    parents = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("source"))
    met = spans.join(parents, ["trace_id", "parent_span_id"]).where("source <> service")
    return met.groupBy("source", F.col("service").alias("target")).agg(F.count("*").alias("observed"))


@query("k1_bucketed_replace", "WITH new AS (SELECT c_custkey AS id, c_nationkey AS grp, c_acctbal * 2 AS v FROM customer WHERE c_nationkey < 5 AND c_custkey % 2 = 0) SELECT c_custkey AS id, c_nationkey AS grp, c_acctbal AS v FROM customer WHERE c_nationkey NOT IN (SELECT grp FROM new) UNION ALL SELECT * FROM new")
def k1_bucketed_replace(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("v"))
    kept = KeyedTable(spark, _folder(spark, "keyed"), old.schema, ["grp"], buckets=16)
    kept.replace_groups(old)
    kept.replace_groups(old.where("grp < 5 AND id % 2 = 0").withColumn("v", F.col("v") * 2))
    return kept.rows()


@query("k3_bucketed_upsert", "SELECT client_id, seq, change_id, op, source, segment, city, balance FROM client_changes QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY seq DESC, change_id DESC) = 1 AND op <> 'D'")
def k3_bucketed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Changes of clients in the order they came, in three batches; deleted clients stay as the change that deleted them, for later ones to compare with."""
    changes = table(spark, d, "client_changes").select("client_id", "seq", "change_id", "op", "source", "segment", "city", "balance")
    kept = KeyedTable(spark, _folder(spark, "keyed"), changes.schema, ["client_id"], ["seq", "change_id"], buckets=16)
    for batch in range(3):
        kept.upsert(changes.where(F.col("change_id") % 3 == batch), "changes", batch)
    kept.upsert(changes.where("change_id % 3 = 1"), "changes", 1)  # delivered again
    return kept.rows().where("op <> 'D'")


def _synced(spark: SparkSession, d: str) -> KeyedTable:
    """A table of commits, synchronised when logs up to 1994 were there, and again with the rest."""
    logs, checkpoint = _folder(spark, "logs"), _folder(spark, "checkpoint")
    kept = KeyedTable(spark, _folder(spark, "keyed"), "sha long, author_email string, ts timestamp, n_parents int, files int", ["sha"], ["ts"], buckets=16)
    shape = lambda batch: batch.select(F.col("sha").cast("long").alias("sha"), "author_email", "ts", "n_parents", F.size("files").alias("files"))
    records = cut(log_records(spark, d))
    for years in ("y < 1995", "y >= 1995"):
        write_logs(records.where(years), logs)
        synchronise(register(spark).readStream.format("gitlog").load(logs), kept, checkpoint, "commits", "ts", shape)
    return kept


@query("s5_streamed_sync", f"WITH {_COMMITS}, {_FILES} SELECT c.sha, author_email, CAST(ts AS DATE) AS day, n_parents, CAST(count(path) AS INTEGER) AS files FROM commits c LEFT JOIN files USING (sha) GROUP BY ALL")
def s5_streamed_sync(spark: SparkSession, d: str) -> DataFrame:
    return _synced(spark, d).rows().select("sha", "author_email", F.col("ts").cast("date").alias("day"), "n_parents", "files")


@query("x9_stream_marks", f"WITH {_COMMITS} SELECT 'commits' AS stream, CAST(max(ts) AS DATE) AS mark, count(*) AS n FROM commits")
def x9_stream_marks(spark: SparkSession, d: str) -> DataFrame:
    kept = _synced(spark, d)
    return watermarks(kept).select("stream", F.to_date("mark").alias("mark"), F.lit(kept.rows().count()).alias("n"))


@query("s12_coverage_report", "SELECT 'm' || (l_partkey % 20) || '/p' || l_partkey AS path, CAST(count(DISTINCT l_orderkey) FILTER (l_quantity > 25) AS INTEGER) AS covered, CAST(count(DISTINCT l_orderkey) AS INTEGER) AS total FROM (SELECT l_partkey, l_orderkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) GROUP BY l_partkey")
def s12_coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """A part is a file, its orders are the statements, run where more than 25 were ordered; a report holds a hundredth of the files."""
    hits = table(spark, d, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.max("l_quantity").alias("q"))
    statement = F.struct(F.col("l_orderkey").cast("string").alias("k"), F.when(F.col("q") > 25, 3).otherwise(0).alias("v"))
    files = hits.groupBy("l_partkey").agg(F.struct(F.map_from_entries(F.collect_list(statement)).alias("s")).alias("f"))
    path_of = F.concat(F.lit("m"), (F.col("l_partkey") % 20).cast("string"), F.lit("/p"), F.col("l_partkey").cast("string"))
    reports = files.groupBy((F.col("l_partkey") % 100).alias("report")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(path_of.alias("k"), F.col("f").alias("v"))))).alias("value"))
    # a report is a file of its own: a folder each
    reports.repartition("report").write.partitionBy("report").text(path := _folder(spark, "coverage"))
    return readers.coverage_report(spark, path).select("path", "covered", "total")


@query("s15_annotations", "SELECT 'src/p' || p_partkey || '.py' AS file, p_name AS what, p_brand AS symbol, CAST(p_size AS VARCHAR) AS signal FROM part WHERE p_partkey % 3 <> 2")
def s15_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Annotations in JSON, one alone or two in a list; what has no signals is left out."""
    part = table(spark, d, "part")
    of = lambda signals: F.struct(F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file"), F.col("p_name").alias("what"), F.array("p_brand").alias("key_symbols"), signals.alias("signals"))
    own = of(F.when(F.col("p_partkey") % 3 != 2, F.array(F.col("p_size").cast("string"))))
    listed = F.to_json(F.array(own, of(F.lit(None).cast("array<string>"))))
    found = readers.annotations(part.select(F.when(F.col("p_partkey") % 2 == 0, listed).otherwise(F.to_json(own)).alias("content")))
    return found.select("file", "what", F.get("key_symbols", F.lit(0)).alias("symbol"), F.get("signals", F.lit(0)).alias("signal"))


@query("s15_communities", "SELECT 'c' || n_nationkey AS community, n_name AS summary, 's' || s_suppkey AS member FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def s15_communities(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_list(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).alias("members"))
    one = F.struct(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("summary"), "members")
    return readers.communities(table(spark, d, "nation").join(members, "n_nationkey").select(F.to_json(F.struct(F.array(one).alias("communities"))).alias("content")))


@query("k5_generations", "SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_acctbal > 0")
def k5_generations(spark: SparkSession, d: str) -> DataFrame:
    """A rebuild is swapped in whole; one that is aborted or empty leaves the live generation."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    kept = Generations(spark, _folder(spark, "generations"))
    for part, keep in ((rows, True), (rows.where("v > 0"), True), (rows.where("v > 100"), False), (rows.where("v > 1e12"), True)):
        kept.begin(part)
        kept.commit() if keep else kept.abort()
    return kept.live()


@query("a8_daily_sketches", "SELECT event_type, count(*) AS n, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS days, true AS different_is_near, true AS median_is_near FROM events GROUP BY event_type")
def a8_daily_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Days are summarised as they come, the last ones later; what the summaries say over all days is held against the events themselves."""
    events = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    kept = sketches.kept(spark, _folder(spark, "sketches"))
    last = events.agg(F.max("day")).first()[0]
    for part in (events.where(F.col("day") < F.date_sub(F.lit(last), 5)), events.where(F.col("day") >= F.date_sub(F.lit(last), 6))):
        kept.replace_groups(sketches.daily(part, "day", "event_type", "user_id", "value"))
    told = sketches.merged(kept.rows(), [0.4, 0.6])
    exact = events.groupBy("event_type").agg(F.count_distinct("day").alias("days"), F.count_distinct("user_id").alias("different"), F.percentile("value", 0.5).alias("median"))
    rows = exact.join(told.withColumnsRenamed({"key": "event_type", "different": "estimate"}), "event_type")
    near = F.abs(F.col("estimate") - F.col("different")) <= F.greatest(F.lit(1.0), F.col("different") * 0.08)
    between = (F.get("quantiles", F.lit(0)) <= F.col("median")) & (F.col("median") <= F.get("quantiles", F.lit(1)))
    return rows.select("event_type", "n", "days", near.alias("different_is_near"), between.alias("median_is_near"))
