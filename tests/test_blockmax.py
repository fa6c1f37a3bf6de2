"""Top-k search by blocks with bounds against the search through all postings."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataflow.operators import blockmax, retrieval, scan


def corpus(spark, n, topics, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        topic = rng.randrange(topics)
        words = rng.choices([f"w{j}" for j in range(12)], k=rng.randint(3, 30)) + [f"t{topic}x{rng.randrange(8)}" for _ in range(rng.randint(5, 40))]
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, "w1"), (n + 3, "w1")]
    return spark.createDataFrame(rows, "doc long, body string")


def ranked(df):
    return sorted((r.query, r.doc, r.rank, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("block", [1, 7, 32])
def test_block_search_is_the_search(spark, block):
    docs = corpus(spark, 600, 20)
    asked = spark.createDataFrame([(1, "t3x1 t3x2 w1"), (2, "w0 w1 w2"), (3, "nothing of this"), (4, None), (5, "t7x0"), (6, "w1 w1 T3X1, t9x5")], "q int, text string")
    index = blockmax.block_index(docs, "doc", "body", block)
    assert ranked(index.search(asked, "q", "text", 5, probe=1)) == ranked(retrieval.bm25(docs, asked, "doc", "body", "q", "text", 5))


def test_blocks_out_of_reach_are_not_read(spark):
    docs = corpus(spark, 3000, 60)
    asked = spark.createDataFrame([(k, f"t{k}x1 t{k}x2 t{k}x3 w1 w2") for k in range(40)], "q int, text string")
    index = blockmax.block_index(docs, "doc", "body", 16)
    found, cost = index.searched(asked, "q", "text")
    assert ranked(found) == ranked(retrieval.bm25(docs, asked, "doc", "body", "q", "text"))
    rows = cost.collect()
    assert sum(r.read for r in rows) < 0.2 * sum(r.postings for r in rows)


def test_block_index_of_nothing(spark):
    index = blockmax.block_index(corpus(spark, 1, 1).where("doc < 0"), "doc", "body")
    assert index.search(spark.createDataFrame([(1, "w1")], "q int, text string"), "q", "text").count() == 0


def test_a_search_keeps_no_row_for_each_query_and_block(spark, monkeypatch):
    docs = corpus(spark, 1200, 5)
    asked = spark.createDataFrame([(k, f"w{k % 12} w{(k + 1) % 12}") for k in range(40)], "q int, text string")
    index, kept, cut = blockmax.block_index(docs, "doc", "body", 1), [], blockmax.cut
    monkeypatch.setattr(blockmax, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    found = ranked(index.search(asked, "q", "text", 5))
    assert found == ranked(retrieval.bm25(docs, asked, "doc", "body", "q", "text", 5))
    # most queries meet most of the 1,202 blocks; a task keeps five documents and a row for each query
    assert max(df.count() for df in kept) <= 40 * 6 * 4 * 2


def test_texts_are_cut_once(spark):
    cuts = spark.sparkContext.accumulator(0)

    def words(text):
        cuts.add(1)
        return text.split()

    index = blockmax.block_index(corpus(spark, 200, 5), "doc", "body", 16, F.udf(words, "array<string>"))
    assert (index.n_docs, cuts.value) == (204, 204)


def test_block_search_of_many_queries_in_shards(spark, monkeypatch):
    docs = corpus(spark, 300, 10).withColumn("doc", F.format_string("d%04d", "doc"))
    asked = spark.createDataFrame([(f"q{k}", f"t{k % 10}x1 w{k % 12} t3x{k % 8}") for k in range(30)] + [("none", "nowhere"), ("empty", "")], "q string, text string")
    monkeypatch.setattr(scan, "PAIRS", 25)
    found = ranked(blockmax.block_index(docs, "doc", "body", 8).search(asked, "q", "text", 7, probe=2))
    monkeypatch.undo()
    assert found == ranked(retrieval.bm25(docs, asked, "doc", "body", "q", "text", 7))


def test_partial_scores_in_turns(spark, monkeypatch):
    docs = corpus(spark, 200, 4)
    index = blockmax.block_index(docs, "doc", "body", 16)
    terms, starts, queries = ["t2x3", "w1", "w2"], np.array([0, 2, 4, 5]), np.array([0, 2, 0, 1, 1])
    idf, whole = np.array([2.0, 0.5, 0.75]), {}
    batches = index.blocks.toArrow().combine_chunks().to_batches()
    for at_once in (1, 7, 2_000_000):
        monkeypatch.setattr(scan, "AT_ONCE", at_once)
        sent = SimpleNamespace(value=(terms, idf, starts, queries, ["a", "b", "c"])), SimpleNamespace(value=np.full(3, -np.inf))
        rows = [r for b in blockmax._scores(*sent, pa.string(), pa.int64(), 4, index.avgdl)(iter(batches)) for r in b.to_pylist()]
        whole[at_once] = sorted((r["query"], r["doc"] or -1, round(r["score"] or 0, 9), r["postings"]) for r in rows)
    assert whole[1] == whole[7] == whole[2_000_000]
    assert sum(r[3] is None for r in whole[1]) == 12
