"""Execution traces and exports of five formats as runtime edges: tests, coverage, spans, logs, calls by hand; pull requests and terminal errors.

Inputs are tables of files (file, content), so a folder of traces is read in parallel and a file that does not parse costs itself only. An
edge is (source_path, source_symbol, target_path, target_symbol, format, confidence).
"""

from __future__ import annotations

import sqlite3
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow.functions.text import strip_ansi
from strataflow.operators.ranks import running

_FRAME = "struct<path:string,file:string,filename:string,name:string,function:string>"
_CALL = f"struct<traceback:array<{_FRAME}>,crash:struct<path:string,message:string>>"
_TEST = f"struct<nodeid:string,outcome:string,call:{_CALL},setup:{_CALL},teardown:{_CALL}>"
_SPAN = "struct<traceId:string,spanId:string,parentSpanId:string,name:string,attributes:array<struct<key:string,value:struct<stringValue:string>>>>"
_PULL = "struct<id:string,title:string,body:string,author:string,state:string,updated_at:timestamp,comments:array<struct<author:string,body:string>>,reviews:array<struct<author:string,state:string>>,files:array<string>,commits:array<string>>"
#: What the ring of terminal errors holds.
MOST_ERRORS, MOST_CHARS = 10, 20_000


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("content"))


def relative(path: Column, root: str = "") -> Column:
    """A path with forward slashes, without the root and a leading ./ ."""
    plain = F.regexp_replace(path, r"\\\\", "/")
    if root:
        plain = F.when(plain.startswith(root.rstrip("/") + "/"), F.substring(plain, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(plain)
    return F.regexp_replace(plain, r"^\./", "")


def _edges(rows: DataFrame, a: tuple[Column, Column], b: tuple[Column, Column], form: str, confidence: float) -> DataFrame:
    return rows.select(a[0].alias("source_path"), a[1].alias("source_symbol"), b[0].alias("target_path"), b[1].alias("target_symbol"), F.lit(form).alias("format"), F.lit(confidence).alias("confidence"))


def pytest_reports(files: DataFrame, root: str = "") -> DataFrame:
    """Edges of JSON reports: from a test along the frames of its traceback (.8), and to what it crashed on (.7)."""
    both = F.from_json("content", f"tests array<{_TEST}>, report struct<tests:array<{_TEST}>>")
    tests = files.select("file", both.alias("j")).select("file", F.posexplode(F.coalesce("j.tests", "j.report.tests")).alias("n", "t"))
    node = F.split("t.nodeid", "::")
    own = tests.select("file", "n", relative(node[0], root).alias("path"), F.when(F.size(node) > 1, F.element_at(node, -1)).alias("symbol"), F.col("t.outcome").alias("outcome"), F.col("t.call.crash").alias("crash"), F.coalesce("t.call.traceback", "t.setup.traceback", "t.teardown.traceback").alias("frames"))
    frames = own.select("file", "n", "path", "symbol", F.posexplode("frames").alias("k", "f")).select("file", "n", "k", "path", "symbol", relative(F.coalesce("f.path", "f.file", "f.filename"), root).alias("to_path"), F.coalesce("f.name", "f.function").alias("to_symbol")).where("to_path IS NOT NULL OR to_symbol IS NOT NULL")
    w = Window.partitionBy("file", "n").orderBy("k")
    first = F.row_number().over(w) == 1
    placed = frames.withColumn("a", F.when(first, F.col("path")).otherwise(F.lag("to_path").over(w))).withColumn("b", F.when(first, F.col("symbol")).otherwise(F.lag("to_symbol").over(w)))
    crashed = own.where("outcome = 'failed' AND crash IS NOT NULL")
    return _edges(placed, (F.col("a"), F.col("b")), (F.col("to_path"), F.col("to_symbol")), "pytest", 0.8).unionByName(_edges(crashed, (F.col("path"), F.col("symbol")), (relative(F.col("crash.path"), root), F.split(F.coalesce("crash.message", F.lit("exception")), ":")[0]), "pytest", 0.7))


def pytest_text(files: DataFrame, root: str = "") -> DataFrame:
    """Edges of printed tracebacks: along the frames (.75), a test's own frame starts anew; and from the last frame to each error named (.65)."""
    frame = r'File "([^"]+)", line (\d+), in ([A-Za-z_][\w.]*)'
    rows = files.select("file", F.posexplode(F.regexp_extract_all("content", F.lit(frame), F.lit(0))).alias("k", "f")).select("file", "k", relative(F.regexp_extract("f", frame, 1), root).alias("path"), F.regexp_extract("f", frame, 3).alias("symbol"))
    w = Window.partitionBy("file").orderBy("k")
    chained = rows.withColumn("a", F.lag("path").over(w)).withColumn("b", F.lag("symbol").over(w))
    last = rows.groupBy("file").agg(F.max_by(F.struct("path", "symbol"), "k").alias("last"))
    errors = files.select("file", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*([A-Za-z_][\w.]*(?:Error|Exception))\b"), F.lit(1))).alias("error")).join(last, "file", "left")
    return _edges(chained.where(~F.col("symbol").startswith("test_")), (F.col("a"), F.col("b")), (F.col("path"), F.col("symbol")), "pytest", 0.75).unionByName(_edges(errors, (F.col("last.path"), F.col("last.symbol")), (F.lit(None).cast("string"), F.col("error")), "pytest", 0.65))


def coverage_lines(files: DataFrame, root: str = "") -> DataFrame:
    """(path, lines): lines that coverage reports in JSON say were run."""
    info = F.from_json("content", "files map<string,struct<executed_lines:array<int>,executedLines:array<int>>>")
    rows = files.select(F.explode(info["files"]).alias("p", "i")).select(relative(F.col("p"), root).alias("path"), F.explode(F.coalesce("i.executed_lines", "i.executedLines")).alias("line"))
    return rows.groupBy("path").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def coverage_database(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """(path, lines) of the database files that coverage tools write; a file that is none gives nothing."""
    out = pa.schema([("path", pa.string()), ("line", pa.int32())])

    def of(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                base = sqlite3.connect(":memory:")
                try:
                    base.deserialize(content)
                    found = base.execute("SELECT f.path, b.numbits FROM file f JOIN line_bits b ON b.file_id = f.id").fetchall()
                except sqlite3.Error:
                    found = []
                finally:
                    base.close()
                rows = [{"path": p, "line": 8 * k + bit} for p, bits in found for k, byte in enumerate(bits) for bit in range(8) if byte >> bit & 1]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, out)

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(of, "path string, line int")
    return raw.select(relative(F.col("path"), root).alias("path"), "line").groupBy("path").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def spans(files: DataFrame, root: str = "") -> DataFrame:
    """Edges of span exports (flat or by resource and scope): from a span's parent to it, by file and function of their attributes or their names (.85)."""
    form = f"spans array<{_SPAN}>, resourceSpans array<struct<scopeSpans:array<struct<spans:array<{_SPAN}>>>>>"
    j = F.from_json("content", form)
    nested = F.flatten(F.flatten(F.transform(j["resourceSpans"], lambda r: F.transform(r["scopeSpans"], lambda s: s["spans"]))))
    rows = files.select("file", F.explode(F.coalesce(j["spans"], nested)).alias("s")).select("file", "s.*")
    of = lambda *keys: F.coalesce(*[F.get(F.filter("attributes", lambda a: a["key"] == k), F.lit(0))["value"]["stringValue"] for k in keys])  # noqa: E731, B023
    own = rows.select("file", "traceId", "spanId", "parentSpanId", relative(of("code.filepath", "code.file.path"), root).alias("path"), F.coalesce(of("code.function", "code.function.name"), "name").alias("symbol"))
    parent = own.select("file", "traceId", F.col("spanId").alias("parentSpanId"), F.col("path").alias("a"), F.col("symbol").alias("b"))
    met = own.join(parent, (own["file"] == parent["file"]) & own["traceId"].eqNullSafe(parent["traceId"]) & (own["parentSpanId"] == parent["parentSpanId"]))
    return _edges(met, (F.col("a"), F.col("b")), (F.col("path"), F.col("symbol")), "otel", 0.85)


def log_lines(files: DataFrame, symbols: DataFrame, least: int = 4) -> DataFrame:
    """Edges from log_entry to each known symbol (path, name; of `least` letters) that logs name (.55)."""
    words = files.select(F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\w+"), F.lit(0)))).alias("name")).distinct()
    met = symbols.where(F.length("name") >= least).select("path", "name").distinct().join(words, "name")
    return _edges(met, (F.lit(None).cast("string"), F.lit("log_entry")), (F.col("path"), F.col("name")), "log", 0.55)


def manual_calls(files: DataFrame, root: str = "") -> DataFrame:
    """Edges of calls written by hand: {"calls": [{"caller": "file:symbol", "callee": "file:symbol"}]} (.95)."""
    rows = files.select(F.explode(F.from_json("content", "calls array<struct<caller:string,callee:string>>")["calls"]).alias("c"))
    part = lambda c: (F.when(F.contains(c, F.lit(":")), relative(F.split(c, ":")[0], root)), F.element_at(F.split(c, ":"), -1))
    return _edges(rows, part(F.col("c.caller")), part(F.col("c.callee")), "manual", 0.95)


def merged(edges: list[DataFrame]) -> DataFrame:
    """Edges of all formats, each once with the number of times it was seen and its best confidence."""
    every = reduce(DataFrame.unionByName, edges)
    return every.groupBy("source_path", "source_symbol", "target_path", "target_symbol").agg(F.max("confidence").alias("confidence"), F.count("*").alias("observed"), F.array_join(F.sort_array(F.collect_set("format")), ",").alias("formats"))


def pull_requests(files: DataFrame, since: str | None = None) -> DataFrame:
    """Pull requests of exports (an array, or one a line) that changed after `since`: the newest state of each id, with comments, reviews, files and commits."""
    rows = files.select(F.explode(F.coalesce(F.from_json("content", f"array<{_PULL}>"), F.array(F.from_json("content", _PULL)))).alias("p")).select("p.*").where("id IS NOT NULL")
    if since is not None:
        rows = rows.where(F.col("updated_at") > F.lit(since).cast("timestamp"))
    newest = F.row_number().over(Window.partitionBy("id").orderBy(F.col("updated_at").desc(), F.col("title")))
    return rows.withColumn("_n", newest).where("_n = 1").drop("_n")


def terminal_ring(errors: DataFrame, most: int = MOST_ERRORS, chars: int = MOST_CHARS) -> DataFrame:
    """The last `most` errors of each workspace (cwd, at, command, exit_code, output), without terminal colours and cut to `chars`."""
    rank = F.row_number().over(Window.partitionBy("cwd").orderBy(F.col("at").desc(), "command"))
    kept = errors.withColumn("_n", rank).where(F.col("_n") <= most)
    return kept.select("cwd", "at", F.coalesce(F.nullif("command", F.lit("")), F.lit("(unknown command)")).alias("command"), "exit_code", F.substring(strip_ansi(F.col("output")), 1, chars).alias("output"))


def decision_sections(files: DataFrame) -> DataFrame:
    """(id, title, status, context, decision, consequences, hash) of decision records in Markdown (file, content)."""
    section = lambda name: F.regexp_replace(F.regexp_extract("content", rf"(?is)(?:^|\n)##\s+{name}[^\n]*\n(.*?)(?=\n##\s|\Z)", 1), r"^\s+|\s+$", "")
    return files.select(F.upper(F.regexp_extract("file", r"(?i)(adr-?\d+)", 1)).alias("id"), F.trim(F.regexp_extract("content", r"(?m)^#\s+(.+)$", 1)).alias("title"), F.upper(section("status")).alias("status"), section("context").alias("context"), section("decision").alias("decision"), section("consequences").alias("consequences"), F.sha2("content", 256).alias("hash"))


def compared(now: DataFrame, before: DataFrame, key: str = "id") -> DataFrame:
    """(key, state): records (key, hash) against those of the run before: new, changed, unchanged or removed."""
    both = now.select(key, F.col("hash").alias("a")).join(before.select(key, F.col("hash").alias("b")), key, "full")
    return both.select(key, F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "removed").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed").alias("state"))


def runtime_lines(lines: DataFrame) -> DataFrame:
    """Events of log files (file, line, value) whose first line is a manifest that names the commit: lines that do not parse or have another severity are left out, files without a manifest altogether."""
    from strataflow.sources.readers import EVENT_SCHEMA, SEVERITIES

    manifest = lines.where("line = 1").select("file", F.get_json_object("value", "$.repository_commit_hash").alias("repository_commit_hash")).where("repository_commit_hash IS NOT NULL")
    events = lines.where("line > 1").select("file", F.from_json("value", EVENT_SCHEMA).alias("e")).where("e.event_id IS NOT NULL")
    return events.select("file", "e.event_id", "e.component_id", "e.event_type", F.upper("e.severity").alias("severity")).where(F.col("severity").isin(*SEVERITIES)).join(manifest, "file")


def synced(rows: DataFrame, state: DataFrame, stream: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Rows beyond a stream's mark in the state (stream, mark), and the state after them: the newest time seen, other streams as they were."""
    mark = state.where(F.col("stream") == stream).agg(F.max("mark").alias("_mark"))
    fresh = rows.join(F.broadcast(mark)).where(F.col("_mark").isNull() | (F.col(at) > F.col("_mark"))).drop("_mark")
    after = rows.agg(F.max(at).alias("mark")).select(F.lit(stream).alias("stream"), "mark").where("mark IS NOT NULL")
    moved = state.unionByName(after).groupBy("stream").agg(F.max("mark").alias("mark"))
    return fresh, moved


def segments(docs: DataFrame, tombstones: DataFrame, size: int = 500) -> DataFrame:
    """(segment, sealed, docs, live): documents (id, seq) in segments of `size` in the order written; deleted ones (id, seq) are dead unless written again after."""
    placed = running(docs, [F.col("seq"), F.col("id")]).withColumn("segment", F.floor((F.col("rank") - 1) / size)).drop("rank")
    last = F.max("seq").over(Window.partitionBy("id"))
    dead = tombstones.groupBy("id").agg(F.max("seq").alias("_dead"))
    rows = placed.withColumn("newest", F.col("seq") == last).join(dead, "id", "left")
    alive = F.col("newest") & (F.col("_dead").isNull() | (F.col("seq") > F.col("_dead")))
    return rows.groupBy("segment").agg((F.count("*") == size).alias("sealed"), F.count("*").alias("docs"), F.count_if(alive).alias("live"))


def atomic_save(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text under another name in the same folder and renames it: readers see the old one or the new one, whole."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
    target, part = hadoop.Path(path), hadoop.Path(path + ".part")
    stream = target.getFileSystem(conf).create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    # this rename takes the old file's place in one step, where deleting it first would leave a moment without any
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(target.toUri(), conf).rename(part, target, options)
