"""Sources: file walks, change logs, decision records, runtime event logs, coverage reports, traces and notes.

Each reader gives role-typed columns with an explicit schema; nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions.text import file_role, gitignored, ignored, language, redact_dotenv

#: Fixed names of folders that a walk leaves out.
IGNORED = ("node_modules", ".git", "dist", "build", "__pycache__", ".venv")
EVENT_SCHEMA = "event_id string, component_id string, event_type string, severity string, payload string, timestamp timestamp, repository_commit_hash string"
SEVERITIES = ("INFO", "WARNING", "ERROR", "CRITICAL")


def walked(listing: DataFrame, extensions: Sequence[str], names: Sequence[str] = IGNORED, ignore_lines: Sequence[str] = ()) -> DataFrame:
    """The files of a listing (path, ...) that a walk takes: with one of the extensions, or dotenv files, and left out neither by a pattern nor by an ignore file."""
    path = F.col("path")
    wanted = F.lower("path").rlike("(" + "|".join("\\." + e.lstrip(".") for e in extensions) + ")$") | path.rlike(r"(^|/)[^/]*\.env(\.[a-z]+)?$")
    return listing.where(wanted & ~ignored(path, list(names)) & ~gitignored(path, ignore_lines))


def ignore_file(spark: SparkSession, root: str, name: str = ".gitignore") -> list[str]:
    """The lines of the ignore file of a root, from whatever store it is in; none if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root, name)
    store = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(at):
        return []
    stream = store.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()


def walk(spark: SparkSession, root: str, extensions: Sequence[str], names: Sequence[str] = IGNORED, most: int | None = None, use_ignore_file: bool = True) -> DataFrame:
    """Files under a root: path (relative), language, role, size, modified, text (secrets of dotenv files redacted).

    The root's .gitignore holds. Names that begin with a dot or an underscore are hidden to Spark's readers and left out. With `most`, the files of
    the highest priority: shallow before deep, new before old.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root), "^file:/*", "/")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), F.concat(F.lit("^"), base, F.lit("/*")), "")
    text = F.decode("content", "UTF-8")
    files = walked(raw.withColumn("path", path), extensions, names, ignore_file(spark, root) if use_ignore_file else ())
    shown = F.when(F.col("path").rlike(r"(^|/)[^/]*\.env(\.[a-z]+)?$"), redact_dotenv(text)).otherwise(text)
    found = files.select("path", language(F.col("path")).alias("language"), file_role(F.col("path"), text).alias("role"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), shown.alias("text"))
    if most is None:
        return found
    return found.orderBy(F.size(F.split("path", "/")), F.col("modified").desc(), "path").limit(most)


#: What git is to print for `git_log`: git log --format=GIT_FORMAT --raw --numstat --no-abbrev.
GIT_FORMAT = "%x1e%H%x1f%ae%x1f%aI%x1f%P%x1f%s"


def git_log(files: DataFrame, since: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Commits (sha, author_email, ts, n_parents, subject) and their files (sha, path, change_type, added, deleted) from logs (content) printed in GIT_FORMAT.

    Names and statuses come from the --raw lines (or from --name-status), added and deleted lines from --numstat; a rename is a change of
    its new path; binary files have no line counts. Only commits after `since` are kept.
    """
    records = files.select(F.explode(F.filter(F.split("content", "\u001e"), lambda x: F.trim(x) != "")).alias("r")).select(F.split("r", "\r?\n", -1).alias("l"))
    head = F.split(F.col("l")[0], "\u001f", -1)
    commits = records.select(head[0].alias("sha"), head[1].alias("author_email"), F.to_timestamp(head[2]).alias("ts"), F.size(F.filter(F.split(head[3], " "), lambda x: x != "")).alias("n_parents"), head[4].alias("subject"), F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))).alias("rows")).dropDuplicates(["sha"])
    if since is not None:
        commits = commits.where(F.col("ts") > F.lit(since).cast("timestamp"))
    lines = commits.select("sha", F.explode("rows").alias("r"))
    raw = r"^(?::\d+ \d+ [0-9a-f.]+ [0-9a-f.]+ )?([ACDMRT])\d*\t(?:[^\t]+\t)?([^\t]+)$"
    status = lines.where(F.col("r").rlike(raw)).select("sha", F.regexp_extract("r", raw, 2).alias("path"), F.regexp_extract("r", raw, 1).alias("s"))
    number = r"^(\d+|-)\t(\d+|-)\t(.+)$"
    # {old => new} and old => new are how counts name a rename
    named = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract("r", number, 3), r"\{[^{}]* => ([^{}]*)\}", "$1"), r"^.* => ", ""), "//", "/")
    counts = lines.where(F.col("r").rlike(number)).select("sha", named.alias("path"), F.regexp_extract("r", number, 1).try_cast("int").alias("added"), F.regexp_extract("r", number, 2).try_cast("int").alias("deleted"))
    both = status.join(counts, ["sha", "path"], "full")
    kind = F.when(F.col("s") == "D", "DELETE").when(F.col("s") == "A", "ADD").otherwise("MODIFY")
    return commits.drop("rows"), both.select("sha", "path", kind.alias("change_type"), "added", "deleted")


def change_log(spark: SparkSession, path: str, since: str | None = None) -> tuple[DataFrame, DataFrame]:
    """git_log of the files under a path."""
    return git_log(spark.read.text(path, wholetext=True).select(F.col("value").alias("content")), since)


def decision_records(spark: SparkSession, path: str) -> DataFrame:
    """Decision records in Markdown: id (from the file name), title, status, created_at, hash, and the files they name."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    status = F.upper(F.regexp_extract("value", r"(?im)^\s*(?:\*\*)?status(?:\*\*)?\s*:\s*(\w+)", 1))
    return raw.select(F.upper(F.regexp_extract("file", r"(?i)(adr-?\d+)", 1)).alias("id"), F.regexp_extract("value", r"(?m)^#\s+(.+)$", 1).alias("title"), F.when(status == "", "UNKNOWN").otherwise(status).alias("status"), F.to_date(F.nullif(F.regexp_extract("value", r"(?im)^\s*date\s*:\s*(\d{4}-\d{2}-\d{2})", 1), F.lit(""))).alias("created_at"), F.sha2("value", 256).alias("hash"), F.array_distinct(F.expr(r"regexp_extract_all(value, '`([A-Za-z0-9_./-]+\\.[a-z]+)`', 1)")).alias("files"))


def runtime_log(spark: SparkSession, path: str) -> DataFrame:
    """Runtime events of a JSON-lines file whose manifest line names the commit; lines that are malformed or of unknown severity are left out.

    Without a manifest nothing is read: the result is empty.
    """
    lines = spark.read.text(path).select(F.from_json("value", EVENT_SCHEMA).alias("e"), F.get_json_object("value", "$.manifest.repository_commit_hash").alias("commit"))
    manifest = lines.where("commit IS NOT NULL").agg(F.max("commit").alias("manifest")).where("manifest IS NOT NULL")
    events = lines.where("e.event_id IS NOT NULL").select("e.*").where(F.upper("severity").isin(*SEVERITIES))
    return events.join(F.broadcast(manifest)).withColumn("repository_commit_hash", F.coalesce("repository_commit_hash", "manifest")).drop("manifest")


def coverage_report(spark: SparkSession, path: str) -> DataFrame:
    """Covered and all statements of each file of a coverage-final report: a map of path to {s: {statement: hits}}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<s:map<string,int>>>").alias("m"))
    return raw.select(F.explode("m").alias("path", "f")).select("path", F.size(F.filter(F.map_values("f.s"), lambda n: n > 0)).alias("covered"), F.size("f.s").alias("total"))


def trace_edges(spark: SparkSession, path: str) -> DataFrame:
    """Calls between services from spans (traceId, spanId, parentSpanId, service): parent and child services, count, confidence .85."""
    spans = spark.read.schema("traceId string, spanId string, parentSpanId string, service string").json(path)
    child, parent = spans.alias("c"), spans.alias("p")
    met = child.join(parent, (F.col("c.traceId") == F.col("p.traceId")) & (F.col("c.parentSpanId") == F.col("p.spanId")))
    return met.groupBy(F.col("p.service").alias("source"), F.col("c.service").alias("target")).agg(F.count("*").alias("observed")).withColumn("confidence", F.lit(0.85))


def notes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, file string, text string, tags array<string>, created timestamp").json(path, multiLine=True)


def annotations(files: DataFrame) -> DataFrame:
    """Annotations (file, what, key_symbols, depends_on, signals, annotated_at) of files (content) that hold one, or a list of them, in JSON."""
    one = "struct<file:string,what:string,key_symbols:array<string>,depends_on:array<string>,signals:array<string>,annotated_at:timestamp>"
    rows = files.select(F.explode(F.coalesce(F.from_json("content", f"array<{one}>"), F.array(F.from_json("content", one)))).alias("a")).select("a.*")
    return rows.where("file IS NOT NULL AND signals IS NOT NULL")


def communities(files: DataFrame) -> DataFrame:
    """(community, summary, member) of files (content) with {"communities": [{"id", "summary", "members"}]}."""
    rows = files.select(F.explode(F.from_json("content", "communities array<struct<id:string,summary:string,members:array<string>>>")["communities"]).alias("c"))
    return rows.select(F.col("c.id").alias("community"), "c.summary", F.explode("c.members").alias("member"))


def new_since(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that an earlier run has not seen."""
    return rows.join(known.select(*keys).distinct(), list(keys), "left_anti")
