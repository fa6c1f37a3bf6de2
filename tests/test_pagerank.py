"""A round of PageRank shuffles what reaches the targets and nothing else; scores against a plain loop."""

import pytest
from pyspark.sql import functions as F

from strataflow.functions.session import cut_by, forget
from strataflow.operators import graph


def test_a_round_leaves_edges_and_scores_where_they_lie(spark):
    share, edges = cut_by(spark.range(4000).select((F.col("id") % 97).alias("src_id"), (F.col("id") % 89).alias("dst_id"), F.lit(0.1).alias("share")).repartition(4, "src_id"), "src_id", 4)
    rank, scores = cut_by(spark.range(97).select("id", F.lit(1.0).alias("score")).repartition(4, "id"), "id", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = rank.join(graph._gained(rank, share), "id", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        forget(spark, edges)
        forget(spark, scores)
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("seeds", [None, ["a", "d"]])
def test_scores(spark, seeds):
    edges = [("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 1.0), ("c", "sink", 3.0), ("a", "b", 1.0)]
    own = None if seeds is None else spark.createDataFrame([(s,) for s in seeds], "node string")
    before, tables = spark.conf.get("spark.sql.shuffle.partitions"), len(spark.catalog.listTables())
    found = {r["node"]: r["score"] for r in graph.pagerank(spark.createDataFrame(edges, "src string, dst string, weight double"), seeds=own).collect()}
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and len(spark.catalog.listTables()) == tables
    nodes = {n for e in edges for n in e[:2]}
    p = {n: (1 / len(nodes) if seeds is None else (1 / len(seeds) if n in seeds else 0.0)) for n in nodes}
    total = {n: sum(w for s, _, w in edges if s == n) for n in nodes}
    score = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(100):
        held = sum(score[n] for n in nodes if not total[n])
        score = {n: 0.15 * p[n] + 0.85 * (sum(score[s] * w / total[s] for s, t, w in edges if t == n) + held * p[n]) for n in nodes}
    assert found == pytest.approx(score, abs=1e-5)
