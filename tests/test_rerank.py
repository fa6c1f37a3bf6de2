"""The trained reranker on questions it has not seen, against overlap of words and against the search's own order."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from strataflow.functions.session import cut
from strataflow.operators import rerank, retrieval


def test_reranker_beats_overlap_on_held_out_questions(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").select(F.col("doc_id").alias("doc"), F.col("text").alias("content"))
    passages = cut(rerank.judged_passages(docs, "doc", "content", 3))
    found = cut(retrieval.bm25(docs, passages, "doc", "content", "query", "question", 40).join(docs, "doc"))
    judged = cut(rerank.judged_candidates(found, passages))
    asked = cut(rerank.questions(passages, "query", "question", cut(rerank.rarity_of(docs, "content"))))
    held = F.pmod(F.xxhash64(F.lit("held"), "query"), F.lit(3)) == 0
    model = rerank.train(judged.where(~held), asked)
    unseen = judged.where(held)
    words = retrieval.top_k(rerank.features(unseen, asked).select("query", "doc", F.col("rerank_words").alias("score")), "query", F.round("score", 9), "doc", 40)
    trained = rerank.mean_reciprocal_rank(rerank.rerank(unseen, asked, model), unseen)
    assert trained > rerank.mean_reciprocal_rank(words, unseen) + 0.03
    assert trained > rerank.mean_reciprocal_rank(unseen, unseen)
    # texts met once give the same features
    short = rerank.placed(found.drop("content"), docs, asked, passages)
    names = ["query", "doc", "relevant", *(f"rerank_{k}" for k in rerank.FEATURES)]
    assert sorted(map(tuple, short.select(names).collect())) == sorted(map(tuple, rerank.features(judged, asked).select(names).collect()))


def test_features_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b c x"), (2, "c b a"), (3, None)], "doc long, content string")
    asked = rerank.questions(spark.createDataFrame([(9, "A b c"), (8, None)], "q long, t string"), "q", "t", rerank.rarity_of(docs, "content"))
    rows = docs.select(F.lit(9).cast("long").alias("query"), "doc", (4.0 - F.col("doc")).alias("score"), F.col("doc").cast("int").alias("rank"), "content").unionByName(docs.select(F.lit(8).cast("long").alias("query"), "doc", F.lit(0.0).alias("score"), F.lit(1).alias("rank"), "content"))
    got = {(r.query, r.doc): r for r in rerank.features(rows, asked).collect()}
    assert [got[9, k].rerank_words for k in (1, 2, 3)] == [1.0, 1.0, 0.0]
    assert [got[9, k].rerank_pairs for k in (1, 2, 3)] == [1.0, 0.0, 0.0]
    assert [got[9, k].rerank_triples for k in (1, 2, 3)] == [1.0, 0.0, 0.0]
    assert [got[9, k].rerank_score for k in (1, 2, 3)] == pytest.approx([1, 2 / 3, 1 / 3])
    assert got[8, 1].rerank_words == got[8, 1].rerank_rarity == 0.0


def test_reranker_without_judgements(spark):
    rows = spark.createDataFrame([], "query long, doc long, score double, rank int, content string, relevant int")
    asked = rerank.questions(spark.createDataFrame([(9, "a")], "q long, t string"), "q", "t", spark.createDataFrame([], "token string, idf double"))
    model = rerank.train(rows, asked)
    assert model.weights == {"words": 4.0}
    one = spark.createDataFrame([(9, 1, 1.0, 1, "a"), (9, 2, 2.0, 2, "b")], "query long, doc long, score double, rank int, content string")
    assert [r.doc for r in rerank.rerank(one, asked, model).orderBy("rank").collect()] == [1, 2]
