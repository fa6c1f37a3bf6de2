"""Graph operators on edge tables (src, dst, type, weight): traversal, paths, ranks, risk, resolution.

Iterations are driven from Python, each round one join of the frontier with the edges; lineage is cut by writing
to the shared folder, so a lost executor costs a round and not the whole run.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from strataflow.functions.session import cut, cut_by, forget
from strataflow.operators.ranks import running

#: Edge types that a transitive walk follows.
WALKED = ("calls", "reads", "imports", "references", "instantiates", "assigns")


def reversed_(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "_s", "dst": "src"}).withColumnRenamed("_s", "dst")


def of_types(edges: DataFrame, types: Sequence[str] | None) -> DataFrame:
    return edges if types is None else edges.where(F.col("type").isin(*types))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int | None = 10) -> DataFrame:
    """(seed, node, depth): nodes within `depth` hops along the edges (None: any number), by their least distance; the seed itself is not among them."""
    step = edges.select("src", "dst").distinct()
    visited = seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("depth", F.lit(0))
    frontier = visited
    for d in itertools.count(1) if depth is None else range(1, depth + 1):
        reached = frontier.join(step, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct().join(visited.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(d))
        frontier = cut(reached)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited.where("depth > 0")


def spread(edges: DataFrame, seeds: DataFrame, depth: int | None = 10) -> tuple[DataFrame, DataFrame]:
    """bfs() from many seeds at once: levels (node, word, depth, bits) and the seeds' places (seed, word, bit).

    A seed is one bit of a word of 64; a node holds the words of the seeds that reach it, so up to 64 seeds that go the same way
    are one row of the frontier. Rounds are those of the farthest seed, whatever the number of seeds.
    """
    step = cut(edges.select("src", "dst").distinct())
    named = running(seeds.select(F.col("node").alias("seed")).where("seed IS NOT NULL").distinct(), [F.col("seed")])
    places = cut(named.select("seed", F.expr("(rank - 1) div 64").alias("word"), F.expr("CAST((rank - 1) % 64 AS INT)").alias("bit")))
    state = cut(places.groupBy(F.col("seed").alias("node"), "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("fresh")).select("node", "word", F.col("fresh").alias("seen"), "fresh"))
    levels = state.select("node", "word", F.lit(0).alias("depth"), F.col("fresh").alias("bits")).where("false")
    for d in itertools.count(1) if depth is None else range(1, depth + 1):
        frontier = state.where("fresh <> 0")
        got = frontier.join(step, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("fresh").alias("got"))
        state = cut(state.drop("fresh").join(got, ["node", "word"], "full").select("node", "word", F.expr("coalesce(seen, 0L) | coalesce(got, 0L)").alias("seen"), F.expr("coalesce(got, 0L) & ~coalesce(seen, 0L)").alias("fresh")))
        level = state.where("fresh <> 0")
        if level.isEmpty():
            break
        levels = levels.unionByName(level.select("node", "word", F.lit(d).alias("depth"), F.col("fresh").alias("bits")))
    return levels, places


def bfs_of_many(edges: DataFrame, seeds: DataFrame, depth: int | None = 10) -> DataFrame:
    """bfs() by bit sets: the same rows (seed, node, depth), made only at the end."""
    levels, places = spread(edges, seeds, depth)
    bits = levels.withColumn("bit", F.explode(F.expr("filter(sequence(0, 63), i -> shiftrightunsigned(bits, i) & 1L = 1L)")))
    return bits.join(places, ["word", "bit"]).select("seed", "node", "depth")


def reach_sizes(edges: DataFrame, seeds: DataFrame, depth: int | None = 10) -> DataFrame:
    """(seed, depth, nodes): how many nodes each seed reaches at each distance, counted bit by bit: no row for a pair of seed and node is made."""
    levels, places = spread(edges, seeds, depth)
    counts = levels.groupBy("word", "depth").agg(F.array(*[F.sum(F.expr(f"shiftrightunsigned(bits, {i}) & 1L")) for i in range(64)]).alias("counts"))
    return counts.select("word", "depth", F.posexplode("counts").alias("bit", "nodes")).where("nodes > 0").join(places, ["word", "bit"]).select("seed", "depth", "nodes")


def shortest_path(edges: DataFrame, source: str, target: str, depth: int = 15) -> DataFrame:
    """The shortest path (hops, path), the least in the order of its nodes among equals; no row if there is none."""
    spark, step = edges.sparkSession, edges.select("src", "dst").distinct()
    frontier = spark.range(1).select(F.lit(source).alias("node"), F.array(F.lit(source)).alias("path"))
    seen = frontier.select("node")
    for hops in range(1, depth + 1):
        reached = frontier.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")).join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        frontier = cut(reached)
        hit = frontier.where(F.col("node") == target)
        if not hit.isEmpty():
            return hit.select(F.lit(hops).alias("hops"), "path")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("node"))
    return spark.range(0).select(F.lit(0).alias("hops"), F.array(F.lit("")).alias("path"))


def simple_paths(edges: DataFrame, seeds: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """(source, target, hops, path): all paths without repeated nodes up to `depth` hops, `most` for each pair if given, shortest first."""
    step = edges.select("src", "dst").distinct()
    frontier = seeds.select(F.col("node").alias("source"), F.col("node").alias("target"), F.array("node").alias("path")).distinct()
    found = None
    for _ in range(depth):
        frontier = cut(frontier.join(step, F.col("target") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select("source", F.col("dst").alias("target"), F.concat("path", F.array("dst")).alias("path")))
        found = frontier if found is None else found.unionByName(frontier)
    found = found.withColumn("hops", F.size("path") - 1)
    if most is None:
        return found
    rank = F.row_number().over(Window.partitionBy("source", "target").orderBy("hops", "path"))
    return found.withColumn("_rn", rank).where(F.col("_rn") <= most).drop("_rn")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out) over distinct edges."""
    own = edges.select("src", "dst", "type").distinct()
    ends = own.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(own.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def dependents(edges: DataFrame) -> DataFrame:
    """Dependents of each node in buckets by type of edge, with HIGH from 10 on, MEDIUM from 4, else LOW."""
    bucket = lambda *types: F.sort_array(F.collect_set(F.when(F.col("type").isin(*types), F.col("src"))))
    found = edges.groupBy(F.col("dst").alias("node")).agg(bucket("calls").alias("callers"), bucket("imports").alias("importers"), bucket("reads").alias("readers"), bucket("instantiates").alias("instantiators"), bucket("fallback_to").alias("fallbacks"), F.count_distinct("src").alias("total"))
    return found.withColumn("level", F.when(F.col("total") >= 10, "HIGH").when(F.col("total") >= 4, "MEDIUM").otherwise("LOW"))


def structural_risk(impacted: Column, depth: Column, critical: Column, subsystems: Column, n_in: Column, n_out: Column) -> Column:
    return F.least(F.lit(100), 2 * impacted + 4 * depth + 5 * critical + 5 * subsystems + 2 * n_in + n_out)


def risk_band(score: Column) -> Column:
    return F.when(score <= 20, "LOW").when(score <= 50, "MEDIUM").when(score <= 80, "HIGH").otherwise("CRITICAL")


def blast_radius(edges: DataFrame, seeds: DataFrame, subsystem: DataFrame, depth: int = 10) -> DataFrame:
    """Impact of each seed over its transitive dependents: counts, depth, subsystems (node, subsystem), critical nodes, score and band."""
    walked = of_types(edges, WALKED)
    reach = bfs(reversed_(walked), seeds, depth)
    rank = degrees(edges)
    critical = F.col("depth") + 2 * F.col("n_in") + F.col("n_out")
    rows = reach.join(rank, "node", "left").join(subsystem, "node", "left").fillna({"n_in": 0, "n_out": 0}).withColumn("criticality", critical)
    total = rows.groupBy("seed").agg(F.count("*").alias("impacted"), F.max("depth").alias("max_depth"), F.count_distinct("subsystem").alias("subsystems"), F.least(F.lit(20), F.count_if(F.col("criticality") >= 10)).alias("critical"))
    own = seeds.select(F.col("node").alias("seed")).distinct().join(total, "seed", "left").fillna(0).join(rank.withColumnRenamed("node", "seed"), "seed", "left").fillna(0)
    score = structural_risk(F.col("impacted"), F.col("max_depth"), F.col("critical"), F.col("subsystems"), F.col("n_in"), F.col("n_out"))
    return own.withColumn("score", score).withColumn("band", risk_band(F.col("score")))


def pagerank(edges: DataFrame, iterations: int = 100, damping: float = 0.85, tolerance: float | None = 1e-6, seeds: DataFrame | None = None) -> DataFrame:
    """(node, score): weighted PageRank; what dangling nodes hold goes to the personalisation vector (uniform without seeds).

    Nodes are numbered, and edges and scores lie in the same buckets of those numbers, so a round is one job that shuffles nothing but what edges bring to
    their targets, summed where it starts; how far scores moved and what dangling nodes hold is observed while it is written. Rounds
    end when scores move by less than `tolerance` in all.
    """
    spark = edges.sparkSession
    weighted = cut(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    nodes = cut(weighted.select(F.col("src").alias("node")).union(weighted.select("dst")).distinct().withColumn("id", F.monotonically_increasing_id()))
    n, parts = nodes.count(), max(4, math.ceil(weighted.count() / 100_000))
    out = weighted.groupBy("src").agg(F.sum("weight").alias("total"))
    number = lambda end: nodes.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id"))
    share = weighted.join(out, "src").join(number("src"), "src").join(number("dst"), "dst").select("src_id", "dst_id", (F.col("weight") / F.col("total")).alias("share"))
    start = nodes if seeds is None else seeds.select("node").distinct()
    size = n if seeds is None else start.count()
    person = nodes.join(start.select("node").withColumn("p", F.lit(1.0 / max(size, 1))), "node", "left").fillna({"p": 0.0})
    person = person.join(weighted.select(F.col("src").alias("node")).distinct().withColumn("follows", F.lit(True)), "node", "left").fillna({"follows": False})
    folders = []

    def kept(rows: DataFrame, key: str) -> DataFrame:
        found, path = cut_by(rows, key, parts)
        folders.append(path)
        return found

    def written(scores: DataFrame) -> tuple[DataFrame, float, float]:
        seen = Observation()
        rows = kept(scores.observe(seen, F.sum(F.when(~F.col("follows"), F.col("score"))).alias("held"), F.sum("moved").alias("moved")), "id")
        return rows, seen.get.get("held") or 0.0, seen.get.get("moved") or 0.0

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        # what reaches the targets is shuffled into the buckets' number of partitions, so it meets the scores where they lie
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        share = kept(share.repartition(parts, "src_id"), "src_id")
        rank, held, moved = written(person.select("id", "p", "follows", F.lit(1.0 / max(n, 1)).alias("score"), F.lit(1.0).alias("moved")).repartition(parts, "id"))
        for _ in range(iterations):
            if tolerance is not None and moved < tolerance:
                break
            gained = _gained(rank, share)
            fresh = (1 - damping) * F.col("p") + damping * (F.coalesce("gain", F.lit(0.0)) + held * F.col("p"))
            rank, held, moved = written(rank.join(gained, "id", "left").select("id", "p", "follows", fresh.alias("score"), F.abs(fresh - F.col("score")).alias("moved")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        for path in folders:
            forget(spark, path)
    return spark.read.schema(rank.schema).parquet(folders[-1]).join(nodes, "id").select("node", "score")


def _gained(rank: DataFrame, share: DataFrame) -> DataFrame:
    """(id, gain): what edges bring to their targets."""
    return rank.select(F.col("id").alias("src_id"), "score").join(share, "src_id").groupBy(F.col("dst_id").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("gain"))


def entry_distance(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, n_in, distance, importance): hops from the nearest node without callers, 999 if none leads there; importance .6 in + .4 / (distance + 1)."""
    rank = degrees(edges)
    # all entries walk together: a node is reached once, by its nearest entry
    entries = rank.where("n_in = 0").select("node")
    step = edges.select("src", "dst").distinct()
    found = cut(entries.withColumn("distance", F.lit(0)))
    frontier = found
    for d in itertools.count(1) if depth is None else range(1, depth + 1):
        frontier = cut(frontier.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(found.select("node"), "node", "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    rows = rank.join(found, "node", "left").fillna({"distance": 999})
    return rows.select("node", "n_in", "distance", (0.6 * F.col("n_in") + 0.4 / (F.col("distance") + 1)).alias("importance"))


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level): longest distance from a node without predecessors, however long; nodes on cycles, or behind one, stay out."""
    step = edges.select("src", "dst").distinct()
    nodes = step.select(F.col("src").alias("node")).union(step.select("dst")).distinct()
    left, done, open_ = cut(step), None, cut(nodes)
    for level in itertools.count():
        ready = cut(open_.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        left = cut(left.join(ready.select(F.col("node").alias("src")), "src", "left_anti"))
        open_ = cut(open_.join(ready.select("node"), "node", "left_anti"))
    return done if done is not None else nodes.withColumn("level", F.lit(0)).limit(0)


def topological_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, place) of a few nodes (node), each after all that lead to it; those on cycles, or behind one, come last, by name."""
    own = nodes.select("node").distinct()
    inner = valid_edges(edges, own)
    linked = inner.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    alone = own.join(linked, "node", "left_anti").withColumn("level", F.lit(0))
    levels = topological_levels(inner).unionByName(alone)
    ranked = own.join(levels, "node", "left").fillna({"level": 1 << 30})
    return ranked.select("node", F.row_number().over(Window.orderBy("level", "node")).alias("place"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node, and which end."""
    a = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst", F.lit("src").alias("missing"))
    b = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", F.lit("dst").alias("missing"))
    return a.unionByName(b)


def governance_score(adrs: Column, intents: Column, neighbours: Column) -> Column:
    return F.least(10 * adrs, F.lit(60)) + F.least(5 * intents, F.lit(40)) + F.least(2 * neighbours, F.lit(20))


def governance_band(score: Column) -> Column:
    return F.when(score <= 10, "LOW").when(score <= 30, "MEDIUM").when(score <= 60, "HIGH").otherwise("CRITICAL")


def resolve_symbols(uses: DataFrame, definitions: DataFrame, most: int = 3) -> DataFrame:
    """Uses (unit, name) to their first `most` definitions (name, unit, file, line), by file and line, the using unit's own excluded.

    Of a name defined ever so often only the first 2 * `most` definitions are joined, a unit's own first `most` at most: no use needs another.
    """
    own = uses.select("unit", F.lower("name").alias("k")).distinct()
    places = definitions.select(F.lower("name").alias("k"), F.col("unit").alias("target"), "file", "line")
    order = ["file", "line", "target"]
    near = places.withColumn("rn", F.row_number().over(Window.partitionBy("k", "target").orderBy(*order))).where(F.col("rn") <= most)
    near = near.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*order))).where(F.col("rn") <= 2 * most).drop("rn")
    met = own.join(near, "k").where("unit <> target")
    rank = F.row_number().over(Window.partitionBy("unit", "k").orderBy(*order))
    return met.withColumn("rn", rank).where(F.col("rn") <= most).select("unit", F.col("k").alias("name"), "target", "rn")


def unique_matches(calls: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """Calls (caller, name) resolved by the first tier (caller, name, target) that has exactly one target for them."""
    left, found = calls.distinct(), None
    for k, tier in enumerate(tiers):
        one = left.join(tier, ["caller", "name"]).groupBy("caller", "name").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).where("n = 1").select("caller", "name", "target", F.lit(k).alias("tier"))
        found = one if found is None else found.unionByName(one)
        left = left.join(one, ["caller", "name"], "left_anti")
    return found


def resolve_calls(calls: DataFrame, units: DataFrame, imports: DataFrame) -> DataFrame:
    """(caller, name, target, tier): calls (caller, name) to the one unit (unit_id, file_path, parent_id, name) of that name: in the caller's container (0), its file (1), a file it imports (2; src, dst), or anywhere (3)."""
    own = units.select(F.col("unit_id").alias("caller"), F.col("file_path").alias("at"), F.col("parent_id").alias("inside"))
    met = calls.distinct().join(own, "caller").join(units.select(F.col("unit_id").alias("target"), "file_path", "parent_id", "name"), "name").where("target <> caller")
    near = met.join(imports.select(F.col("src").alias("at"), F.col("dst").alias("file_path")).distinct(), ["at", "file_path"], "left_semi")
    tiers = [met.where("parent_id = inside"), met.where("file_path = at"), near, met]
    return unique_matches(met.select("caller", "name"), [t.select("caller", "name", "target") for t in tiers])
