"""Data sources, keyed tables and their synchronisation, on files and failures made here."""

import gzip
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from strataflow.plans.ingest import write_logs
from strataflow.sources import keyed
from strataflow.sources.datasource import records, register
from strataflow.sources.keyed import KeyedTable
from strataflow.streaming.sync import synchronise, watermarks


def commit(sha, day, author="a@x", files=(("src/a.py", "M", 3, 1),), parents="p1"):
    raw = "".join(f":100644 100644 abc def {k}\t{p}\n" for p, k, _, _ in files) + "".join(f"{a}\t{d}\t{p}\n" for p, _, a, d in files)
    return f"\x1e{sha}\x1f{author}\x1f2024-01-{day:02d}T10:00:00+02:00\x1f{parents}\x1fsubject {sha}\n\n{raw}"


@pytest.mark.parametrize("mark", [b"\x1e", b"\n"])
@pytest.mark.parametrize("piece", [1, 3, 1000])
def test_each_record_is_in_one_split(mark, piece):
    rng = random.Random(len(mark) * piece)
    for _ in range(60):
        own = [bytes(rng.choices(b"abc", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 9))]
        data = b"".join(mark + x for x in own) if mark != b"\n" else b"\n".join(own)
        if mark != b"\n":
            data = bytes(rng.choices(b"xy", k=rng.randint(0, 3))) + data
        step = rng.randint(1, 9)
        got = [r for at in range(0, len(data), step) for r in records(io.BytesIO(data), at, min(at + step, len(data)), mark, piece)]
        expected = own if mark != b"\n" else data.split(b"\n")
        # a line that begins where the file ends is none
        assert got == (expected if data and not (mark == b"\n" and data.endswith(b"\n")) else expected[:-1] if data else []), (data, step)


def test_git_log_source(spark, tmp_path):
    (tmp_path / "a.log").write_text("warning: rubbish\n" + "".join(commit(f"c{k}", k + 1, f"dev{k % 3}@x") for k in range(25)) + "\x1ebroken\x1f")
    with gzip.open(tmp_path / "b.log.gz", "wt") as out:
        out.write(commit("z", 30, files=[("src/{old => new}/b.py", "R090", 1, 2), ("x => y.bin", "A", "-", "-")], parents=""))
    (tmp_path / "_hidden").write_text(commit("h", 1))
    register(spark)
    df = spark.read.format("gitlog").option("splitBytes", 200).load(str(tmp_path))
    rows = {r.sha: r for r in df.collect()}
    assert sorted(rows) == sorted([*(f"c{k}" for k in range(25)), "z"])
    assert df.rdd.getNumPartitions() > 5
    assert rows["z"].n_parents == 0 and rows["c3"].n_parents == 1 and rows["c3"].subject == "subject c3"
    assert ("y.bin", None, None) in [(f.path, f.added, f.deleted) for f in rows["z"].files] and ("src/new/b.py", 1, 2) in [(f.path, f.added, f.deleted) for f in rows["z"].files]
    later = df.where("ts >= timestamp'2024-01-20 08:00:00'").where("author_email = 'dev1@x'")
    assert sorted(r.sha for r in later.collect()) == ["c19", "c22"]
    plan = later._jdf.queryExecution().executedPlan().toString()
    assert "author_email" in plan.split("Filter")[1].split("\n")[0] and "ts" not in plan.split("Filter")[1].split("\n")[0].replace("email", "")  # the time is the reader's
    assert df.where("ts is null").count() == 0


def test_json_line_sources(spark, tmp_path):
    register(spark)
    pulls = [{"id": k, "title": "t", "author": None, "state": "open", "updated_at": f"2024-02-{k + 1:02d}T00:00:00Z", "comments": [{"author": "a", "body": "b"}, 3], "files": ["x", None]} for k in range(9)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.jsonl").write_text("\n".join([*map(json.dumps, pulls), "{broken", "[]", '{"title": "no id"}', '{"id": "q", "updated_at": "never"}']))
    df = spark.read.format("pullrequests").option("splitBytes", 64).load(f"file://{tmp_path}/p")
    got = {r.id: r for r in df.collect()}
    assert sorted(got) == [*"012345678", "q"] and got["q"].updated_at is None
    assert got["4"].files == ["x"] and [(c.author, c.body) for c in got["4"].comments] == [("a", "b")]
    assert df.where("updated_at > timestamp'2024-02-06' and updated_at < timestamp'2024-02-09'").count() == 2
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.jsonl").write_text('{"traceId":"t","spanId":"1","service":"web","start":"2024-01-01","attributes":{"k":1}}\n{"traceId":"t","spanId":"2","parentSpanId":"1","service":"db"}\n')
    spans = spark.read.format("spans").load(str(tmp_path / "s"))
    assert sorted((r.span_id, r.parent_span_id, r.service, r.attributes) for r in spans.collect()) == [("1", None, "web", {"k": "1"}), ("2", "1", "db", {})]
    (tmp_path / "none").mkdir()
    assert spark.read.format("spans").load(str(tmp_path / "none")).count() == 0


SCHEMA = "file string, id long, seq long, v string"


def table(spark, folder, keys=("id",), order=("seq",), buckets=8):
    return KeyedTable(spark, str(folder), SCHEMA, keys, order, buckets)


def change(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", upsert_turn string")


def content(t):
    return sorted(tuple(r) for r in t.rows().collect())


def test_upsert_is_last_wins(spark, tmp_path):
    rng, t, expected = random.Random(5), table(spark, tmp_path / "t"), {}
    assert content(t) == [] and t.version() == 0
    for turn in range(4):
        rows = [(f"f{rng.randint(0, 5)}", rng.randint(0, 30), rng.randint(0, 9), f"{turn}-{k}") for k in range(40)]
        rows += rows[:5]
        t.upsert(change(spark, rows).drop("upsert_turn"))
        own = {}
        for r in rows:
            if r[1] not in own or r[2] > own[r[1]][2]:
                own[r[1]] = r
        for i, r in own.items():
            if i not in expected or r[2] >= expected[i][2]:
                expected[i] = r
        got = {r[1]: r for r in content(t)}
        assert {i: r[2] for i, r in got.items()} == {i: r[2] for i, r in expected.items()}
        expected = got
    assert t.version() == 4 and t.vacuum(1) == 3 and len(content(t)) == len(expected)


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = table(spark, tmp_path / "t", buckets=32)
    first = t.upsert(change(spark, [("f", k, 0, "x" * 200) for k in range(6000)]))
    before = {r["bucket"]: r["folder"] for r in t._manifest(1)}
    one = t.upsert(change(spark, [("f", 17, 1, "new")]))
    assert len(first.buckets) == 32 and len(one.buckets) == 1 and one.bytes * 16 < first.bytes
    after = {r["bucket"]: r["folder"] for r in t._manifest(2)}
    assert {b for b in before if b >= 0 and before[b] != after[b]} == set(one.buckets)
    assert t.rows().count() == 6000 and t.rows(1).where("v = 'new'").count() == 0 and t.rows().where("v = 'new'").count() == 1


def test_groups_replaced_rows_kept_and_deleted(spark, tmp_path):
    t = table(spark, tmp_path / "t", keys=("file",), order=())
    t.replace_groups(change(spark, [("a", 1, 0, "x"), ("a", 2, 0, "x"), ("b", 3, 0, "x"), (None, 4, 0, "n")]))
    t.replace_groups(change(spark, [("a", 9, 0, "y"), ("a", 9, 0, "y"), (None, 5, 0, "m")]))
    assert sorted(map(str, (tuple(r) for r in t.rows().collect()))) == sorted(map(str, [("a", 9, 0, "y"), ("a", 9, 0, "y"), ("b", 3, 0, "x"), (None, 5, 0, "m")]))
    t.delete(spark.createDataFrame([("a",), ("zz",)], "file string"))
    assert sorted(map(str, (tuple(r) for r in t.rows().collect()))) == sorted(map(str, [("b", 3, 0, "x"), (None, 5, 0, "m")]))
    u = table(spark, tmp_path / "u")
    u.insert_missing(change(spark, [("a", 1, 0, "old")]))
    u.insert_missing(change(spark, [("a", 1, 9, "late"), ("a", 2, 1, "p"), ("a", 2, 2, "q")]))
    assert content(u) == [("a", 1, 0, "old"), ("a", 2, 2, "q")]
    u.upsert(change(spark, []))
    assert u.version() == 3 and len(content(u)) == 2


class Killed(Exception):
    pass


@pytest.mark.parametrize("when", ["before the version", "after the version", "in the version"])
def test_sync_survives_being_killed(spark, tmp_path, monkeypatch, when):
    register(spark)
    logs = tmp_path / "logs"
    logs.mkdir()
    schema = "sha string, author_email string, ts timestamp, n_parents int"
    shape = lambda df: df.select("sha", "author_email", "ts", "n_parents")
    make = lambda: KeyedTable(spark, str(tmp_path / "t"), schema, ["sha"], ["ts"], 4)

    def run(done=None):
        synchronise(spark.readStream.format("gitlog").load(str(logs)), make(), str(tmp_path / "cp"), "commits", "ts", shape, done)

    (logs / "001.log").write_text("".join(commit(f"c{k}", k + 1) for k in range(5)))
    run()
    (logs / "002.log").write_text(commit("c2", 20, "new@x") + commit("d", 21))
    real = keyed.KeyedTable._commit

    def killed(self, version, rows):
        if when == "after the version":
            real(self, version, rows)
        if when == "in the version":  # the manifest is there without the committer's marker
            self.spark.createDataFrame(rows[:1], keyed._MANIFEST).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{self.folder}/manifest/v{version}")
        raise Killed

    monkeypatch.setattr(keyed.KeyedTable, "_commit", killed)
    with pytest.raises(Exception, match="Killed"):
        run()
    seen = make().rows().count()
    assert seen == (6 if when == "after the version" else 5)
    monkeypatch.setattr(keyed.KeyedTable, "_commit", real)
    done = []
    run(done)
    assert [w.repeated for w in done] == [when == "after the version"]
    got = {r.sha: r.author_email for r in make().rows().collect()}
    assert got == {**{f"c{k}": "a@x" for k in range(5)}, "c2": "new@x", "d": "a@x"}
    assert [(r.stream, r.mark) for r in watermarks(make()).collect()] == [("commits", "2024-01-21 08:00:00")]
    done.clear()
    run(done)
    assert not done and make().version() == 2


def test_two_writers_of_one_version(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.upsert(change(spark, [("a", 1, 0, "x")]))
    with pytest.raises(RuntimeError, match="another writer"):
        t._commit(1, [(1, -1, 1, None, 0, None, None, None)])


class _Counted(bytes):
    """Bytes that count how much their slices copy."""

    copied = 0

    def __getitem__(self, key):
        found = bytes.__getitem__(self, key)
        _Counted.copied += len(found)
        return _Counted(found) if isinstance(key, slice) else found

    def __add__(self, other):
        return _Counted(bytes.__add__(self, other))

    def __radd__(self, other):
        return _Counted(bytes.__add__(other, self))


class _CountedFile(io.BytesIO):
    def read(self, n=-1):
        return _Counted(super().read(n))


@pytest.mark.parametrize("mark, data", [(b"\n", b"".join(b"%d\n" % k for k in range(5000))), (b"\x1e", b"".join(b"\x1e%d" % k for k in range(5000)))])
def test_records_are_not_copied_with_all_that_follows(mark, data):
    _Counted.copied = 0
    found = list(records(_CountedFile(data), 0, None, mark, piece=1 << 14))
    assert [int(r) for r in found if r] == list(range(5000))
    assert _Counted.copied < 4 * len(data)
    for most in (1, 7, 100):
        split = [r for at in range(0, len(data), most * 50) for r in records(io.BytesIO(data), at, at + most * 50, mark, piece=64)]
        assert [int(r) for r in split if r] == list(range(5000))


def test_synchronisation_reads_its_source_once(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.log").write_text("".join(commit(f"s{k}", 1 + k % 28) for k in range(50)))
    read = spark.sparkContext.accumulator(0)

    @F.udf("timestamp")
    def seen(ts):
        read.add(1)
        return ts

    table = KeyedTable(spark, str(tmp_path / "kept"), "sha string, ts timestamp", ["sha"], ["ts"], buckets=2)
    stream = register(spark).readStream.format("gitlog").load(str(tmp_path / "logs"))
    synchronise(stream, table, str(tmp_path / "cp"), "commits", "ts", lambda df: df.select("sha", seen("ts").alias("ts")))
    assert read.value == 50
    assert table.rows().count() == 50
    assert [(r.stream, r.mark) for r in watermarks(table).collect()] == [("commits", "2024-01-28 08:00:00")]


def test_a_year_of_logs_is_not_one_file(spark, tmp_path):
    rows = spark.range(2000).select(F.lit(1995).alias("y"), F.concat(F.lit("\x1e"), F.col("id").cast("string")).alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_logs(rows, str(tmp_path / "logs"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list((tmp_path / "logs/y=1995").glob("part-*"))
    assert len(files) > 1
    assert sum(f.read_bytes().count(b"\x1e") for f in files) == 2000
