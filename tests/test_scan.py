"""BM25 in one pass: the same rows as by joins, without a shuffle of scores, in shards, segments and with ties."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same
from conftest import SF
from pyspark.sql import functions as F

from strataflow.operators import fusion, retrieval, scan
from strataflow.plans import registry

registry.load()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(400)] + [(1000, None), (1001, "")]
    docs += [(2000 + i, docs[5][1]) for i in range(40)]  # copies tie
    asked = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 20)))) for i in range(30)] + [(90, "nowhere"), (91, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "q int, text string")


def _rows(df):
    return sorted((r["query"], r["rank"], r["doc"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("pairs", [200_000, 40])
def test_scan_is_the_search_by_joins(texts, monkeypatch, pairs):
    monkeypatch.setattr(scan, "PAIRS", pairs)
    docs, asked = texts
    every = retrieval.bm25(docs, asked, "doc_id", "text", "q", "text", None)
    expected = retrieval.top_k(every, "query", F.round("score", 9), "doc", 7)
    assert _rows(retrieval.bm25(docs, asked, "doc_id", "text", "q", "text", 7)) == _rows(expected)


@pytest.mark.parametrize("at_once", [1, 7, 64, 1000])
def test_few_partial_scores_at_a_time(monkeypatch, at_once):
    monkeypatch.setattr(scan, "AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    row = np.sort(rng.integers(0, 50, 300))
    weight, starts, counts, queries = rng.random(300), rng.integers(0, 6, 300), rng.integers(1, 5, 300), rng.integers(0, 9, 12)
    whole = np.zeros((50, 9))
    for r, w, s, c in zip(row, weight, starts, counts):
        np.add.at(whole[r], queries[s : s + c], w)
    best = scan.Best(5, 9)
    scan.add_scores(best, pa.array(np.arange(50)), row, weight, starts, counts, queries)
    found = best.settle().to_pydict()
    for q in range(9):
        ranked = sorted(((-round(s, 9), d) for d, s in enumerate(whole[:, q]) if s > 0))[:5]
        assert [d for p, d in zip(found["query"], found["doc"]) if p == q] == [d for _, d in ranked]


def test_scores_are_not_shuffled(texts):
    docs, asked = texts
    plan = retrieval.bm25(docs, asked, "doc_id", "text", "q", "text", 7)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan and "SortMergeJoin" not in plan


def test_documents_in_two_segments_are_found_once(spark):
    rows = [(s, d, "apple " * (1 + (d + s) % 4) + f"pear{d}") for s in range(3) for d in range(20)] + [(None, 50, "apple apple")]
    docs = spark.createDataFrame(rows, "seg int, doc_id int, text string")
    asked = spark.createDataFrame([(1, "apple"), (2, "pear3 apple")], "q int, text string")
    dead = spark.createDataFrame([(3,), (4,)], "doc int")
    found = fusion.segmented_bm25(docs, "seg", dead, asked, "doc_id", "text", "q", "text", 10).collect()
    of = {q: [r["doc"] for r in found if r["query"] == q] for q in (1, 2)}
    assert all(len(set(d)) == len(d) == 10 for d in of.values()) and not {3, 4, 50} & set(of[1] + of[2])


def test_prefixes_longer_than_tokens(spark):
    docs = spark.createDataFrame([(1, "a license"), (2, "licenses licensed"), (3, "lic")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "licens"), (2, "lic licens"), (3, "licensesandmore")], "q int, text string")
    found = retrieval.bm25(docs, asked, "doc_id", "text", "q", "text", 5, prefix=True).collect()
    assert {q: sorted(r["doc"] for r in found if r["query"] == q) for q in (1, 2, 3)} == {1: [1, 2], 2: [1, 2, 3], 3: []}


def test_an_indexed_search_shuffles_no_scores(texts):
    docs, asked = texts
    found = retrieval.index(docs, "doc_id", "text").search(asked, "q", "text", 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan and "SortMergeJoin" not in plan
    assert _rows(found) == _rows(retrieval.bm25(docs, asked, "doc_id", "text", "q", "text", 7))


def _best_in_groups(rows):
    return sorted((r["query"], str(r["group"]), r["doc"], round(r["score"], 9)) for r in rows)


@pytest.mark.parametrize(("pairs", "slots"), [(200_000, 1_000_000), (40, 1_000_000), (200_000, 200), (200_000, 1)])
def test_the_best_in_groups_are_those_of_all_scores(texts, monkeypatch, pairs, slots):
    monkeypatch.setattr(scan, "PAIRS", pairs)
    monkeypatch.setattr(scan, "SLOTS", slots)
    docs, asked = texts
    docs = docs.withColumn("part", F.when(F.col("doc_id") % 13 != 0, F.concat(F.lit("p"), (F.col("doc_id") % 13).cast("string"))))
    every = retrieval.bm25(docs, asked, "doc_id", "text", "q", "text", None).join(docs.select(F.col("doc_id").alias("doc"), F.col("part").alias("group")), "doc").collect()
    expected = {}
    for r in sorted(every, key=lambda r: (-round(r["score"], 9), r["doc"])):
        expected.setdefault((r["query"], r["group"]), r)
    found = retrieval.best_in_groups(docs, asked, "doc_id", "text", "q", "text", "part")
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert len(expected) > 100 and _best_in_groups(found.collect()) == _best_in_groups(expected.values())


def test_a_task_holds_few_groups_and_hands_on_all(monkeypatch):
    monkeypatch.setattr(scan, "SLOTS", 6)
    batch = pa.record_batch({"doc": pa.array(range(40)), "seg": pa.array([0] * 40, pa.int32()), "t": [["a"] * (1 + i % 3) + ["b"] for i in range(40)], "group": pa.array([None if i % 8 == 7 else i % 8 for i in range(40)])})
    held = []
    monkeypatch.setattr(scan.Best, "grow", lambda self, n, f=scan.Best.grow: held.append(n) or f(self, n))
    sent = type("Sent", (), {"value": (["a", "b"], [0], np.ones((1, 2)), np.array([3.0]), np.array([0, 2, 3]), np.array([0, 1, 1]), [7, 8])})
    rows = pa.Table.from_batches(scan._scores(sent, pa.int64(), 1, pa.int64())([batch, batch.slice(0, 0), batch])).to_pylist()
    assert max(held) <= 3 and {(r["query"], r["group"]) for r in rows} == {(q, g) for q in (7, 8) for g in (*range(7), None)}
    best = {}
    for r in sorted(rows, key=lambda r: (-round(r["score"], 9), r["doc"])):
        best.setdefault((r["query"], r["group"]), r["doc"])
    one = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 3))
    score = lambda q, i: one(1 + i % 3, 2 + i % 3) + (one(1, 2 + i % 3) if q == 8 else 0)
    for (q, g), doc in best.items():
        assert doc == min((i for i in range(40) if (None if i % 8 == 7 else i % 8) == g), key=lambda i: (-round(score(q, i), 9), i))


def test_no_score_of_best_chunks_is_shuffled(spark):
    plan = registry.QUERIES["a26_best_chunk_per_file"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


@pytest.mark.parametrize("repeated", [False, True])
def test_best_chunks_of_odd_tables(spark, tmp_path, repeated):
    docs = [(1, "apple pear", "s1"), (2, "Apple apple fig", None), (3, None, "s2"), (4, "", "s1"), (None, "apple fig fig", "s3"), (5, "fig", None), (6, "apple pear", "s1"), (7, "kiwi", "s4")]
    if repeated:
        # a copy, other texts of the same and another length in other groups, and more rows without a key
        docs += [(1, "apple pear", "s1"), (6, "kiwi fig", "s2"), (7, "apple kiwi apple kiwi", "s4"), (None, "apple apple fig", "s3"), (None, "pear", "s2")]
    asked = [(1, "apple fig"), (1, "fig kiwi"), (2, "PEAR pear"), (3, None), (None, "kiwi")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert_same(registry.QUERIES["a26_best_chunk_per_file"](spark, str(tmp_path)), con, registry.ORACLE_SQL["a26_best_chunk_per_file"])
