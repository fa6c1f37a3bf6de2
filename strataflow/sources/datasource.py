"""Spark data sources of change logs, pull-request exports and call spans: `spark.read.format("gitlog")` and `readStream`.

Files hold records: commits that begin with a mark, or lines of JSON. A large file is split by bytes; a split reads the records that begin in it, so
every record is read once, by one task, and a task holds one record at a time beside its batch. Comparisons of a source's
time column are pushed into the reader, which looks at a record's time before it takes the rest apart. As a stream, a source
gives each file once, in the order of names: files are complete when they appear, and later ones have later names.

Paths are whatever pyarrow opens (local, hdfs, s3, gs); for stores that only Spark reads `readers.change_log` does the same by columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from strataflow.functions.session import ship

_COMPARE: dict[type, Callable[[datetime, datetime], bool]] = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b}
_BATCH = 4096


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int | None


def _moment(text: str | None) -> datetime | None:
    """A time as ISO 8601 gives it; without a zone it is UTC's."""
    if not text:
        return None
    try:
        found = datetime.fromisoformat(text)
    except ValueError:
        return None
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)


def records(file, start: int, end: int | None, mark: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """Records of a seekable file whose mark lies in [start, end); with lines the mark is the newline before, and before the first line."""
    held, at = b"", start
    if mark == b"\n":
        at, end = start - 1, None if end is None else end - 1
        held = b"\n" if start == 0 else b""
    file.seek(max(at, 0))
    more = True
    while not held.startswith(mark):
        found = held.find(mark)
        if found >= 0:
            held, at = held[found:], at + found
        elif more:
            at, held = at + len(held), file.read(piece)
            more = bool(held)
        else:
            return
    pos = 0  # what is held is cut where more is read, not at each record
    while end is None or at + pos < end:
        found = held.find(mark, pos + len(mark))
        while found < 0 and more:
            read = file.read(piece)
            more, seen = bool(read), len(held) - pos
            held, at, pos = held[pos:] + read, at + pos, 0
            found = held.find(mark, max(seen - len(mark), 1))
        if found < 0:
            yield held[pos + len(mark) :]
            return
        yield held[pos + len(mark) : found]
        pos = found


class _Format:
    """What tells the sources apart: name, schema, mark, the time column, and how a record is read."""

    name: str
    ddl: str
    schema: pa.Schema
    mark = b"\n"
    time: str

    @staticmethod
    def head(record: bytes) -> tuple[datetime | None, object] | None:
        """The record's time, and what `row` goes on from; None for what is no record."""
        raise NotImplementedError

    @staticmethod
    def row(head: object) -> tuple | None:
        raise NotImplementedError


#: Status lines (--raw or --name-status) and counts of lines (--numstat).
_STATUS = re.compile(r"^(?::\d+ \d+ [0-9a-f.]+ [0-9a-f.]+ )?([ACDMRT])\d*\t(?:[^\t]+\t)?([^\t]+)$")
_COUNTS = re.compile(r"^(\d+|-)\t(\d+|-)\t(.+)$")
_KIND = {"A": "ADD", "D": "DELETE"}


def _renamed(path: str) -> str:
    """The new path of a rename as counts print it."""
    return re.sub(r"^.* => ", "", re.sub(r"\{[^{}]* => ([^{}]*)\}", r"\1", path)).replace("//", "/")


class GitLogFormat(_Format):
    """Commits as readers.GIT_FORMAT prints them."""

    name = "gitlog"
    ddl = "sha string, author_email string, ts timestamp, n_parents int, subject string, files array<struct<path:string,change_type:string,added:int,deleted:int>>"
    schema = pa.schema([("sha", pa.string()), ("author_email", pa.string()), ("ts", pa.timestamp("us", "UTC")), ("n_parents", pa.int32()), ("subject", pa.string()), ("files", pa.list_(pa.struct([("path", pa.string()), ("change_type", pa.string()), ("added", pa.int32()), ("deleted", pa.int32())])))])
    mark, time = b"\x1e", "ts"

    @staticmethod
    def head(record):
        line, _, rest = record.decode("utf-8", "replace").partition("\n")
        fields = line.rstrip("\r").split("\x1f")
        return None if len(fields) < 5 or not fields[0] else (_moment(fields[2]), (fields, rest))

    @staticmethod
    def row(head):
        (sha, author, at, parents, subject), rest = head[0][:5], head[1]
        files: dict[str, list] = {}
        for line in rest.splitlines():
            if found := _STATUS.match(line):
                files.setdefault(found[2], [None, None, None])[0] = _KIND.get(found[1], "MODIFY")
            elif found := _COUNTS.match(line):
                own = files.setdefault(_renamed(found[3]), [None, None, None])
                own[1:] = [None if x == "-" else int(x) for x in found.group(1, 2)]
        return sha, author, _moment(at), len(parents.split()), subject, [{"path": p, "change_type": k or "MODIFY", "added": a, "deleted": d} for p, (k, a, d) in files.items()]


def _json(record: bytes) -> dict | None:
    try:
        found = json.loads(record)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _text(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


class PullRequestFormat(_Format):
    """Pull requests, one in JSON on each line."""

    name = "pullrequests"
    ddl = "id string, title string, author string, state string, updated_at timestamp, comments array<struct<author:string,body:string>>, files array<string>"
    schema = pa.schema([("id", pa.string()), ("title", pa.string()), ("author", pa.string()), ("state", pa.string()), ("updated_at", pa.timestamp("us", "UTC")), ("comments", pa.list_(pa.struct([("author", pa.string()), ("body", pa.string())]))), ("files", pa.list_(pa.string()))])
    time = "updated_at"

    @staticmethod
    def head(record):
        found = _json(record)
        return None if found is None or found.get("id") is None else (_moment(_text(found.get("updated_at"))), found)

    @staticmethod
    def row(head):
        comments = [{"author": _text(c.get("author")), "body": _text(c.get("body"))} for c in head.get("comments") or [] if isinstance(c, dict)]
        return *(_text(head.get(c)) for c in ("id", "title", "author", "state")), _moment(_text(head.get("updated_at"))), comments, [_text(f) for f in head.get("files") or [] if f is not None]


class SpanFormat(_Format):
    """Spans of calls between services, one in JSON on each line."""

    name = "spans"
    ddl = "trace_id string, span_id string, parent_span_id string, service string, operation string, start timestamp, attributes map<string,string>"
    schema = pa.schema([("trace_id", pa.string()), ("span_id", pa.string()), ("parent_span_id", pa.string()), ("service", pa.string()), ("operation", pa.string()), ("start", pa.timestamp("us", "UTC")), ("attributes", pa.map_(pa.string(), pa.string()))])
    time = "start"

    @staticmethod
    def head(record):
        found = _json(record)
        return None if found is None or found.get("spanId") is None else (_moment(_text(found.get("start"))), found)

    @staticmethod
    def row(head):
        attributes = head.get("attributes")
        told = [(str(k), _text(v)) for k, v in attributes.items()] if isinstance(attributes, dict) else []
        return *(_text(head.get(c)) for c in ("traceId", "spanId", "parentSpanId", "service", "name")), _moment(_text(head.get("start"))), told


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files under a path, or of the one file, in the order of names; hidden ones are left out."""
    store, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    info = store.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size)]
    found = store.get_file_info(pafs.FileSelector(root, recursive=True))
    hidden = re.compile(r"(^|/)[_.]")
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not hidden.search(f.path[len(root) :].lstrip("/")))


def _splits(files: list[tuple[str, int]], most: int) -> list[Split]:
    """Splits of files; a compressed one can't be split."""
    out = []
    for path, size in files:
        if path.endswith((".gz", ".bz2", ".zst")):
            out.append(Split(path, 0, None))
        else:
            out += [Split(path, at, min(at + most, size)) for at in range(0, size, most)]
    return out


class _Source:
    """Reads splits; shared by the batch and the stream reader."""

    def __init__(self, kind: type[_Format], options: dict) -> None:
        self.kind, self.path = kind, options["path"]
        self.most = int(options.get("splitbytes", 64 << 20))
        self.kept: list[tuple[type, datetime]] = []

    def rows(self, split: Split | None) -> Iterator[pa.RecordBatch]:
        """The records of a split; Spark asks for none where there are no splits."""
        if split is None:
            return
        kind, held = self.kind, []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kind.schema.types, strict=True)], schema=kind.schema)
        store = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else pafs.LocalFileSystem()
        compressed = split.end is None
        with store.open_input_stream(split.path) if compressed else store.open_input_file(split.path) as file:
            source = _Forward(file) if compressed else file
            for record in records(source, split.start, split.end, kind.mark):
                head = kind.head(record)
                if head is None or not all(head[0] is not None and _COMPARE[op](head[0], value) for op, value in self.kept):
                    continue
                held.append(kind.row(head[1]))
                if len(held) == _BATCH:
                    yield batch()
                    held.clear()
        if held:
            yield batch()


class _Forward:
    """A decompressed stream, which is only ever read from its beginning."""

    def __init__(self, file) -> None:
        self.file = file

    def seek(self, at: int) -> None:
        if at:
            raise ValueError("a compressed file is read from its beginning")

    def read(self, n: int) -> bytes:
        return self.file.read(n)


class _Reader(DataSourceReader):
    def __init__(self, kind: type[_Format], options: dict) -> None:
        self.source = _Source(kind, options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of the time column with a time; Spark applies the rest."""
        for f in filters:
            own = getattr(f, "attribute", None) == (self.source.kind.time,)
            value = getattr(f, "value", None)
            if own and isinstance(f, IsNotNull) and any(getattr(g, "attribute", None) == f.attribute and type(g) in _COMPARE for g in filters):
                continue  # a comparison that is pushed too says so already
            if own and type(f) in _COMPARE and isinstance(value, datetime):
                self.source.kept.append((type(f), value if value.tzinfo else value.replace(tzinfo=timezone.utc)))
            else:
                yield f

    def partitions(self) -> list[Split]:
        return _splits(_listed(self.source.path), self.source.most)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.source.rows(partition)


class _StreamReader(DataSourceStreamReader):
    """The offset is the name of the last file given."""

    def __init__(self, kind: type[_Format], options: dict) -> None:
        self.source = _Source(kind, options)

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.source.path)
        return {"after": files[-1][0] if files else ""}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return _splits([f for f in _listed(self.source.path) if start["after"] < f[0] <= end["after"]], self.source.most)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.source.rows(partition)


class _Records(DataSource):
    kind: type[_Format]

    @classmethod
    def name(cls) -> str:
        return cls.kind.name

    def schema(self) -> str:
        return self.kind.ddl

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.kind, {k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.kind, {k.lower(): v for k, v in self.options.items()})


class GitLog(_Records):
    kind = GitLogFormat


class PullRequests(_Records):
    kind = PullRequestFormat


class Spans(_Records):
    kind = SpanFormat


def register(spark: SparkSession) -> SparkSession:
    """Makes the formats known to a session and lets Spark push filters into them."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (GitLog, PullRequests, Spans):
        spark.dataSource.register(source)
    return spark
