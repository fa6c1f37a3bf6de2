"""Tables kept by key in buckets: an upsert rewrites the buckets that its keys fall into and no others.

A table is a folder of immutable files. Rows of one bucket and version lie under data/version=V/bucket=B; a manifest for each version names, for every
bucket, the version that has its rows, and is complete when Spark's committer has left its marker there. So a reader sees
one version whole, a writer that dies leaves the last version as it was, and what it wrote is never looked at. The manifest also keeps the
batch that made the version and how far its stream had come: both are committed with the rows, or not at all.

One writer at a time: two that begin on one version would both write the next; the second fails, as its manifest exists.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "version long, bucket int, held long, folder string, bytes long, stream string, batch long, mark string"


@dataclass
class Written:
    """What one change did: the new version, the buckets it rewrote, and the bytes that took."""

    version: int
    buckets: list[int]
    bytes: int
    repeated: bool = False


class KeyedTable:
    """Rows by key. A key has one row, or all rows of its group where groups are replaced whole.

    keys: the columns that buckets go by. order: of several rows of a key the one with the greatest order wins (ties: by a hash of the
    row); without it the later change wins. Null keys are a key. buckets is fixed when the folder is made; an upsert costs the buckets it touches, so
    take enough of them that one fits a task (`row_bytes * rows / buckets`); a change that touches all of them rewrites the table.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, keys: Sequence[str], order: Sequence[str] = (), buckets: int = 64) -> None:
        self.spark, self.folder, self.keys, self.order, self.buckets = spark, folder.rstrip("/"), list(keys), list(order), buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _path(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at, at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def version(self) -> int:
        """The last complete version; 0 if there is none."""
        at, store = self._path("manifest")
        if not store.exists(at):
            return 0
        found = [0]
        for status in store.listStatus(at):
            name = status.getPath().getName()
            if name.startswith("v") and store.exists(self._path(f"manifest/{name}/_SUCCESS")[0]):
                found.append(int(name[1:]))
        return max(found)

    def _manifest(self, version: int) -> list:
        """A row for each bucket: as many as the table has buckets, whatever it holds."""
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest/v{version}").collect() if version else []

    def state(self) -> tuple[int, dict[str, tuple[int, str | None]]]:
        """The version, and for each stream the last batch committed and its mark."""
        version = self.version()
        return version, {r["stream"]: (r["batch"], r["mark"]) for r in self._manifest(version) if r["bucket"] == -1 and r["stream"] is not None}

    def rows(self, version: int | None = None) -> DataFrame:
        """The table, or an earlier version of it."""
        return self._read(self._manifest(self.version() if version is None else version))

    def _read(self, manifest: list) -> DataFrame:
        folders = [f"{self.folder}/data/{r['folder']}/bucket={r['bucket']}" for r in manifest if r["bucket"] >= 0]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _change(self, changes: DataFrame, merge, stream: str | None, batch: int | None, mark: str | Callable[[DataFrame], str | None] | None) -> Written:
        version, streams = self.state()
        if stream is not None and batch is not None and stream in streams and streams[stream][0] >= batch:
            return Written(version, [], 0, True)
        manifest = self._manifest(version)
        # a change is read more than once, and what it is read from may be gone by then; what it touches is at most the buckets' numbers
        folder = f"v{version + 1}-{uuid.uuid4().hex}"
        staged = f"{self.folder}/data/{folder}/changes"
        changes.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema]).write.parquet(staged)
        new = self.spark.read.schema(self.schema).parquet(staged)
        mark = mark(new) if callable(mark) else mark
        touched = sorted(r[0] for r in new.select(self._bucket().alias("b")).distinct().collect())
        before = self._read([r for r in manifest if r["bucket"] in set(touched)])
        merged = merge(before, new).withColumn("bucket", self._bucket())
        # a bucket is one task's unless one key has much of it: its rows are dealt by a hash of the row as well
        dealt = merged.repartition(F.col("bucket"), F.pmod(F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in self.schema.names]))), F.lit(4)))
        dealt.write.partitionBy("bucket").parquet(f"{self.folder}/data/{folder}/rows")
        sizes = self._sizes(f"data/{folder}/rows")
        kept = [(version + 1, r["bucket"], r["held"], r["folder"], r["bytes"], None, None, None) for r in manifest if r["bucket"] >= 0 and r["bucket"] not in set(touched)]
        kept += [(version + 1, b, version + 1, f"{folder}/rows", n, None, None, None) for b, n in sizes.items()]
        told = streams | ({stream: (batch, mark)} if stream is not None else {})
        kept += [(version + 1, -1, version + 1, None, 0, s, b, m) for s, (b, m) in told.items()] or [(version + 1, -1, version + 1, None, 0, None, None, None)]
        self._commit(version + 1, kept)
        return Written(version + 1, touched, sum(sizes.values()))

    def _sizes(self, name: str) -> dict[int, int]:
        at, store = self._path(name)
        found = {}
        for status in store.listStatus(at) if store.exists(at) else []:
            part = status.getPath().getName()
            if part.startswith("bucket="):
                found[int(part.removeprefix("bucket="))] = store.getContentSummary(status.getPath()).getLength()
        return found

    def _commit(self, version: int, rows: list[tuple]) -> None:
        """The version is there when the committer's marker is; one that an earlier writer left unfinished is written over."""
        at, store = self._path(f"manifest/v{version}")
        if store.exists(at) and store.exists(self._path(f"manifest/v{version}/_SUCCESS")[0]):
            raise RuntimeError(f"version {version} of {self.folder} has been written by another writer")
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.folder}/manifest/v{version}")

    def _latest(self, rows: DataFrame) -> DataFrame:
        """Of the rows of a key the last, combined before they are shuffled."""
        row = F.struct(*[F.col(f"`{c}`") for c in self.schema.names])
        by = F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(self.order)], F.col("upsert_turn"), F.xxhash64(F.to_json(row)).alias("h"))
        names = [F.col(f"`{k}`").alias(f"upsert_{i}") for i, k in enumerate(self.keys)]
        return rows.groupBy(*names).agg(F.max_by(row, by).alias("upsert_row")).select("upsert_row.*")

    def upsert(self, changes: DataFrame, stream: str | None = None, batch: int | None = None, mark: str | Callable[[DataFrame], str | None] | None = None) -> Written:
        """Inserts the changes or replaces rows of their keys (last wins). A batch of a stream that has been committed is not applied again.

        mark may be a function of the changes, which gets them as they have been written.
        """
        turn = lambda df, n: df.withColumn("upsert_turn", F.lit(n))
        return self._change(changes, lambda old, new: self._latest(turn(old, 0).unionByName(turn(new, 1))), stream, batch, mark)

    def insert_missing(self, changes: DataFrame, stream: str | None = None, batch: int | None = None, mark: str | None = None) -> Written:
        """Inserts rows whose key is not there (first wins); of several new rows of a key the last by order."""
        turn = lambda df, n: df.withColumn("upsert_turn", F.lit(n))

        def merge(old, new):
            return old.unionByName(self._latest(turn(self._without(new, old), 0)))

        return self._change(changes, merge, stream, batch, mark)

    def replace_groups(self, changes: DataFrame, stream: str | None = None, batch: int | None = None, mark: str | None = None) -> Written:
        """All rows of a key in the changes take the place of all rows of that key."""
        return self._change(changes, lambda old, new: self._without(old, new).unionByName(new), stream, batch, mark)

    def delete(self, keys: DataFrame, stream: str | None = None, batch: int | None = None, mark: str | None = None) -> Written:
        """Removes the rows of the keys."""
        filled = keys.select(*[F.col(f"`{f.name}`") if f.name in self.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema])
        return self._change(filled, self._without, stream, batch, mark)

    def _without(self, rows: DataFrame, others: DataFrame) -> DataFrame:
        """Rows whose key is not among the others'."""
        gone = others.select(*[F.col(f"`{k}`").alias(f"upsert_{i}") for i, k in enumerate(self.keys)]).distinct()
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"upsert_{i}")) for i, k in enumerate(self.keys)]
        condition = same[0]
        for c in same[1:]:
            condition = condition & c
        return rows.join(gone, condition, "left_anti")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests before the last `keep` versions and the folders that none of those use; gives how many folders went."""
        version = self.version()
        used = {r["folder"].split("/")[0] for v in range(max(version - keep + 1, 1), version + 1) for r in self._manifest(v) if r["folder"]}
        gone = 0
        for name, unused in (("manifest", lambda n: n.startswith("v") and int(n[1:]) <= version - keep), ("data", lambda n: n not in used and int(n.split("-")[0][1:]) <= version)):
            at, store = self._path(name)
            for status in store.listStatus(at) if store.exists(at) else []:
                if unused(status.getPath().getName()):
                    store.delete(status.getPath(), True)
                    gone += name == "data"
        return gone
