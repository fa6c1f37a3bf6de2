"""Walks from many seeds as bit sets, and joins on keys that are everywhere."""

import random

from pyspark.sql import functions as F

from strataflow.operators import graph, lookup
from strataflow.operators.skew import frequent, salted_join


def test_bit_sets_give_the_rows_of_single_walks(spark):
    rng = random.Random(7)
    edges = spark.createDataFrame([(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(130)] + [("n1", "n1"), (None, "n2"), ("n3", None)], "src string, dst string")
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(90)] + [("n5",), ("elsewhere",), (None,)], "node string")
    own = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    expected = {tuple(r) for r in graph.bfs(own, seeds.where("node IS NOT NULL"), 4).collect()}
    got = [tuple(r) for r in graph.bfs_of_many(own, seeds, 4).collect()]
    assert len(got) == len(expected) and set(got) == expected
    sizes = {(r.seed, r.depth): r.nodes for r in graph.reach_sizes(own, seeds, 4).collect()}
    count = {}
    for s, _, d in expected:
        count[s, d] = count.get((s, d), 0) + 1
    assert sizes == count
    assert graph.bfs_of_many(own, seeds.limit(0), None).count() == 0 == graph.reach_sizes(own.limit(0), seeds, None).count()


def test_ten_thousand_seeds_take_the_rounds_of_one(spark, monkeypatch):
    edges = spark.range(10_050).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("src"), F.concat(F.lit("n"), (F.col("id") + 1).cast("string")).alias("dst"))
    rounds = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or real(df))
    one = graph.reach_sizes(edges, edges.where("src = 'n0'").select(F.col("src").alias("node")), 3).collect()
    of_one = len(rounds)
    many = graph.reach_sizes(edges, edges.where("CAST(substr(src, 2) AS INT) < 10000").select(F.col("src").alias("node")), 3)
    assert len(rounds) == 2 * of_one and len(one) == 3
    assert many.agg(F.count("*"), F.sum("nodes")).first()[:] == (30_000, 30_000)


def test_a_token_in_every_text_is_spread(spark):
    nodes = spark.range(6_000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node"), F.explode(F.array(F.lit("all"), F.concat(F.lit("t"), (F.col("id") % 3000).cast("string")))).alias("token"))
    asked = spark.createDataFrame([("A", "all"), ("A", "t7"), ("A", "t7"), ("B", "t8"), ("C", None), ("D", "nowhere")], "adr string, token string")
    assert [r.token for r in frequent(nodes, "token").collect()] == ["all"]
    met = salted_join(nodes, asked, "token")
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, nodes.join(asked, "token").select(met.columns).collect()))
    found = lookup.token_links(asked, nodes)
    assert {(r.adr, r.score): r.n for r in found.groupBy("adr", "score").agg(F.count("*").alias("n")).collect()} == {("A", 5): 5998, ("A", 10): 2, ("B", 5): 2}


def test_a_name_defined_everywhere(spark):
    uses = spark.createDataFrame([("u0", "Init"), ("u1", "init"), ("u9", "init"), ("u9", "gone")], "unit string, name string")
    places = [(f"u{i}", "init", f"f{i}", k) for i in range(8) for k in range(4)]
    definitions = spark.createDataFrame([(n, u, f, k) for u, n, f, k in places], "name string, unit string, file string, line int")
    got = {(r.unit, r.rn): r.target for r in graph.resolve_symbols(uses, definitions).collect()}
    expected = {}
    for u in ("u0", "u1", "u9"):
        for k, p in enumerate([p for p in sorted(places, key=lambda p: (p[2], p[3])) if p[0] != u][:3]):
            expected[u, k + 1] = p[0]
    assert got == expected


def test_pagerank_of_nothing_and_of_dangling_nodes(spark):
    edges = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 1.0)], "src string, dst string, weight double")
    assert graph.pagerank(edges.limit(0)).count() == 0
    got = {r.node: r.score for r in graph.pagerank(edges, tolerance=1e-9).collect()}
    a = 1 / (3 + 0.85)
    assert abs(sum(got.values()) - 1) < 1e-8 and abs(got["a"] - a) < 1e-6 and abs(got["b"] - a * (1 + 0.85 * 2 / 3)) < 1e-6
