"""Filter audit, web archives and views after batches against brute force, on awkward and on empty tables."""

import base64
import glob
import gzip
import hashlib
import random
import re
from collections import defaultdict
from itertools import permutations

import edge
import pytest
from pyspark.sql import functions as F

from strataflow.llm._skew import spread_join
from strataflow.llm.batch_views import batch_views, canonical_nodes, join_lifetimes, node_summaries
from strataflow.llm.filter_audit import FILTERS, audit_filters, first_failures
from strataflow.llm.warc import deduplicate_archives, originals, read_archives, write_archives

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# 11


def fails(text, earlier):
    words, upper = WORD.findall(text), sum("A" <= c <= "Z" for c in text)
    return {c for c, x in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * upper > 10 * len(text), any(c in "#$%&*|" for c in text), earlier), strict=True) if x}


def audited(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    rows = [(i, t or "", lang or "") for i, t, lang in docs]
    parts, out = defaultdict(list), {}
    for i, t, part in rows:
        parts[part].append((i, fails(t, i is not None and any(j is not None and j < i and u == t for j, u, _ in rows))))
    for part, own in parts.items():
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = [x for x in own if f in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f]
        for (p, _, _), row in out.items():
            if p == part:
                row[6] = shapley[row[6]]
    return {k: tuple(v) for k, v in out.items()}


def audit_rows(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_first_failures():
    table = first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    assert table[1 << FILTERS.index("C"), list(map("".join, permutations("ABCDE"))).index("ABCDE")] == 2


def test_filter_audit_on_awkward_documents(spark):
    rng = random.Random(4)
    shout = " ".join(rng.choices(["LOUD", "Words", "quiet", "a|b", "many"], k=150))
    more = [(100 + k, shout if k % 3 else edge.words(k, 120) + " #" * (k % 2)) for k in range(30)]
    rows = [(*r[:2], r[2]) for r in edge.rows()] + [(i, t, ("de", None, "")[i % 3]) for i, t in more]
    labels = [(i, i % 2, (i or 0) % 5 == 0) for i, _, _ in rows if i is not None] + [(4, 0, None), (4, None, 1), (None, 1, 1), (999, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, lang string, part string, mask int, digest string")
    told = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, label string")
    got = audit_rows(audit_filters(docs, told))
    assert got == audited(rows, labels)
    assert {p for p, _, _ in got} == {"", "en", "de"} and sum(r[5] for r in got.values()) > 0


def test_filter_audit_of_many_parts_and_long_words(spark):
    rows = [(k, f"w{k % 5} " * 120, f"p{k % 90}") for k in range(400)] + [(1000, "x" * (3 << 20) + " y" * 200, "p0")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_rows(audit_filters(docs, labels)) == audited(rows, [])


def test_filter_audit_of_nothing(spark):
    assert audit_filters(edge.empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# 12

PAGES = "page_id long, url string, html string, digest string, payload string, kind string"


def capture_rows():
    body = "<html>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nhello</html>\r\n"
    rows = [(k, f"http://h/{k}", body) for k in range(20)] + [(20 + k, f"http://h/{k}", edge.words(k, 30)) for k in range(20)]
    rows += [(50, None, None), (51, "http://e", ""), (52, "", ""), (53, "http://a b\r\nEvil: 1", "é漢\U0001f600\r\r\n\r\n"), (54, "u", "x" * (3 << 20)), (55, "u", "\r\n\r\n"), (56, "u", "\r\n")]
    rows += [(60, "http://r", "same row"), (60, "http://r", "same row"), (60, "http://q", "same row"), (None, "n", "without id"), (None, "m", "without id"), (None, "m", body), (61, "z", "same row")]
    return rows


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "p", "k") for r in rows], PAGES)


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def resolved(rows, least=0):
    """The result of writing and reading back: (page_id, bytes, digest, type, refers_to), by looking through all rows."""
    groups = defaultdict(list)
    for i, u, h in rows:
        groups[(h or "").encode()].append((i is None, i, u or ""))
    out = []
    for data, own in groups.items():
        own.sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        for k, (_, i, _) in enumerate(own):
            first = not k or len(data) < least
            out.append((i, len(data), digest(data), "response" if first else "revisit", None if first else own[0][1]))
    return sorted(out, key=str)


def archived(found):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.original_id) for r in found.collect()], key=str)


@pytest.mark.parametrize("least", [0, 20])
def test_archives_read_back(spark, tmp_path, least):
    rows = capture_rows()
    write_archives(pages(spark, rows).repartition(3), str(tmp_path / "w"), min_bytes=least)
    records = read_archives(spark, str(tmp_path / "w"))
    assert archived(originals(records)) == resolved(rows, least)
    told = records.collect()
    assert all(r.intact for r in told)
    assert sorted(r.record_id for r in told) == sorted({r.record_id for r in told})
    sent = {(h or "").encode() for _, _, h in rows}
    responses = [bytes(r.payload) for r in told if r.record_type == "response"]
    assert set(responses) == sent and (least or len(responses) == len(sent))
    assert all(r.payload is None for r in told if r.record_type == "revisit")
    assert {r.uri for r in told if r.page_id == 53} == {"http://a%20b%20%20Evil:%201"}
    assert archived(originals(read_archives(spark, str(tmp_path / "w"), payloads=False))) == resolved(rows, least)


def test_archives_are_what_the_format_says(spark, tmp_path):
    write_archives(pages(spark, capture_rows()), str(tmp_path / "w"))
    names = set()
    for file in glob.glob(str(tmp_path / "w" / "*.gz")):
        data = gzip.open(file).read()
        while data:
            header, _, rest = data.partition(b"\r\n\r\n")
            assert header.startswith(b"WARC/1.1\r\n")
            fields = dict(line.split(b": ", 1) for line in header.split(b"\r\n")[1:])
            n = int(fields[b"Content-Length"])
            assert fields[b"WARC-Block-Digest"] == b"sha1:" + digest(rest[:n]).encode()
            assert rest[n : n + 4] == b"\r\n\r\n"
            assert (b"WARC-Refers-To" in fields) == (fields[b"WARC-Type"] == b"revisit")
            names.add((fields[b"WARC-Type"], fields[b"WARC-Record-ID"], fields.get(b"WARC-Refers-To")))
            data = rest[n + 4 :]
    assert {r for _, _, r in names if r} <= {i for t, i, _ in names if t == b"response"}


def test_archives_deduplicated_again(spark, tmp_path):
    rows = [(k, f"u{k}", f"text {k % 3}") for k in range(9)]
    write_archives(pages(spark, rows[:4]), str(tmp_path / "a" / "x=1"), date="2020-01-01T00:00:00Z")
    write_archives(pages(spark, rows[4:]), str(tmp_path / "a" / "x=2"), date="2021-01-01T00:00:00Z")
    deduplicate_archives(spark, str(tmp_path / "a"), str(tmp_path / "b"), "2022-02-02T00:00:00Z")
    records = read_archives(spark, str(tmp_path / "b"))
    assert archived(originals(records)) == resolved(rows)
    assert {r.date for r in records.collect()} == {"2022-02-02T00:00:00Z"}


def test_archives_with_rubbish_and_nothing(spark, tmp_path):
    write_archives(pages(spark, []), str(tmp_path / "none"))
    assert originals(read_archives(spark, str(tmp_path / "none"))).count() == 0
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nPage-Id: 7\r\nContent-Length: 3\r\n\r\n\xff\x00z\r\n\r\n"
    lost = b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <b>\r\nWARC-Refers-To: <gone>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    broken = b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut short"
    (tmp_path / "x").mkdir()
    with gzip.open(tmp_path / "x" / "a.warc.gz", "wb") as out:
        out.write(b"no record\r\n\r\n" + record + lost + broken)
    with gzip.open(tmp_path / "x" / "b.warc.gz", "wb") as out:
        out.write(record.replace(b"<a>", b"<c>"))
    got = {r.record_id: (bytes(r.payload) if r.payload is not None else None, r.page_id) for r in read_archives(spark, str(tmp_path / "x")).collect()}
    assert got == {"<a>": (b"\xff\x00z", 7), "<b>": (None, None), "<c>": (b"\xff\x00z", 7)}
    found = {r.record_id: (r.original_id, r.payload_bytes) for r in originals(read_archives(spark, str(tmp_path / "x"))).collect()}
    assert found == {"<a>": (None, 3), "<b>": (None, None), "<c>": (None, 3)}


# 13


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 13])
def test_canonical_nodes(spark, n):
    levels = (n - 1).bit_length()
    spans = [(a, b) for a in range(-1, n + 1) for b in range(-1, n + 2)]
    df = spark.createDataFrame(spans, "lo int, hi int")
    for r in df.select("lo", "hi", canonical_nodes(F.col("lo"), F.col("hi"), n).alias("nodes")).collect():
        under = []
        for v in r.nodes:
            k = levels - (v.bit_length() - 1)
            under += range((v << k) - (1 << levels), ((v + 1) << k) - (1 << levels))
        assert sorted(under) == list(range(max(r.lo, 0), min(r.hi, n))), r
        assert len(r.nodes) <= max(2 * levels, 1)


def views(rows, n):
    out = {}
    for b in range(n):
        groups = defaultdict(list)
        for g, i, x, lo, hi in rows:
            if lo is not None and hi is not None and max(lo, 0) <= b < hi:
                groups[g].append((i, x))
        for g, own in groups.items():
            xs = [x for _, x in own if x is not None]
            out[b, g] = (len(own), sum(xs) if xs else None, min(xs) if xs else None, len({i for i, _ in own if i is not None}))
    return out


@pytest.mark.parametrize("n", [1, 3, 6, 11])
def test_batch_views(spark, n):
    rng = random.Random(n)
    some = lambda *x: rng.choice([*x, None])
    rows = [(some("a", "b", "c"), some(1, 2, 3, 4), some(5, 6, -7), some(*range(-1, n + 1)), some(*range(n + 3))) for _ in range(300)]
    rows += rows[:40]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "g string, i int, x long, lo int, hi int, batch string, n int")
    got = {(r.batch, r.g): (r.n_rows, r.sum_x, r.min_x, r.distinct_i) for r in batch_views(df, ["g"], n, sums=["x"], mins=["x"], distinct=["i"]).collect()}
    assert got == views(rows, n)
    # on a path no id of a group is counted twice, whatever nodes hold it
    held = node_summaries(df, ["g"], n, distinct=["i"]).where("d0 is not null").groupBy("node").count().count()
    assert held >= 1


def test_batch_views_of_nothing(spark):
    df = spark.createDataFrame([], "g string, i int, x long, lo int, hi int")
    assert batch_views(df, ["g"], 3, sums=["x"], mins=["x"], distinct=["i"]).count() == 0
    assert batch_views(df.where("x = 1").unionByName(spark.createDataFrame([("a", 1, 1, 2, 2)], df.schema)), ["g"], 3).count() == 0


def test_lifetimes_joined(spark):
    left = spark.createDataFrame([(1, "x", 0, 3), (1, "x", 0, 3), (2, "y", 1, 2), (None, "z", 0, 3), (3, "w", 0, 1)], "k long, l string, lo int, hi int")
    right = spark.createDataFrame([(1, "p", 2, 3), (1, "q", 0, 1), (2, "r", 2, 3), (None, "s", 0, 3), (3, "t", 0, 3)], "k long, r string, lo int, hi int")
    got = sorted((r.l, r.r, r.lo, r.hi) for r in join_lifetimes(left, right, ["k"]).collect())
    assert got == [("w", "t", 0, 1), ("x", "p", 2, 3), ("x", "p", 2, 3), ("x", "q", 0, 1), ("x", "q", 0, 1)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_the_join(spark, how):
    rng = random.Random(7)
    left = [(rng.choice([1, 1, 1, 2, 3, None, None, rng.randint(4, 60)]), k % 40) for k in range(3000)]
    right = [(k, f"v{k}") for k in range(50)] + [(1, "again"), (None, "none")]
    a, b = spark.createDataFrame(left, "k int, x int"), spark.createDataFrame(right, "k int, v string")
    expected = sorted(map(tuple, a.join(b, "k", how).collect()), key=str)
    assert sorted(map(tuple, spread_join(a, b, ["k"], how).collect()), key=str) == expected
    assert sorted(map(tuple, spread_join(a, b, ["k"], how, share=2).collect()), key=str) == expected
    assert spread_join(a.where("false"), b, ["k"], how).count() == 0
