"""Incremental view maintenance: a view after each of many batches, from the lifetimes of the rows it joins.

A row lives from the batch that inserts it to the one that deletes it, [lo, hi); a joined row lives where its parts do. The batches are the
leaves of a segment tree. Each lifetime is placed on its canonical nodes, at most two a level, whose leaves are
exactly its batches. Nodes keep mergeable summaries by group: counts, sums, minima, and the exact sets of ids. The
view after a batch is what the nodes on the path from the root to its leaf hold together.

Sets merge without counting an id twice: of the nodes that hold an id of a group only those stay that have no holder
above. No two of these are on one path, so the sizes of the sets simply add up along it.

Groups, ids and nodes are rows of aggregations that combine before the shuffle; nothing is gathered but an id's nodes,
2 * n_batches at most. Joins are salted (`join_lifetimes`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm._shared import materialize
from strataflow.llm._skew import spread_join


def join_lifetimes(left: DataFrame, right: DataFrame, on: Sequence[str], counted: DataFrame | None = None, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The inner join of two frames with lifetimes; a pair lives where both do, and pairs that never do are dropped.

    Frequent values of on[0] on the left are salted; `counted` is a cheaper frame with the same keys to find them in. Null keys
    match nothing; repeated rows count on both sides; other columns must not clash.
    """
    others = right.withColumnsRenamed({lo: "right_lo", hi: "right_hi"})
    pairs = spread_join(left.dropna(subset=list(on)), others.dropna(subset=list(on)), on, counted=None if counted is None else counted.dropna(subset=[on[0]]))
    both = pairs.withColumn(lo, F.greatest(lo, "right_lo")).withColumn(hi, F.least(hi, "right_hi"))
    return both.drop("right_lo", "right_hi").where(F.col(lo) < F.col(hi))


def _levels(n_batches: int) -> int:
    return max(n_batches - 1, 0).bit_length()


def canonical_nodes(lo: Column, hi: Column, n_batches: int) -> Column:
    """The canonical nodes of [lo, hi) as an array: the root is 1, the children of v are 2v and 2v + 1, batch b is leaf 2^levels + b."""
    levels, found = _levels(n_batches), []
    a, b = F.greatest(lo, F.lit(0)).cast("long"), F.least(hi, F.lit(n_batches)).cast("long")
    for k in range(levels + 1):
        # on level k the part not yet placed is [first, stop)
        first, stop = F.shiftright(a + ((1 << k) - 1), k) + (1 << levels - k), F.shiftright(b, k) + (1 << levels - k)
        found.append(F.when((first < stop) & (first % 2 == 1), first))
        if k < levels:
            found.append(F.when((first < stop) & (stop % 2 == 1), stop - 1))
    return F.array_compact(F.array(*found))


def _leaves(node: Column, n_batches: int) -> Column:
    """The batches under a node."""
    levels = _levels(n_batches)
    ranges = F.lit(None).cast("array<long>")
    for k in range(levels, -1, -1):
        first = F.shiftleft(node, k) - (1 << levels)
        ranges = F.when(node >= 1 << levels - k, F.sequence(first, F.least(first + ((1 << k) - 1), F.lit(n_batches - 1).cast("long")))).otherwise(ranges)
    return ranges


def node_summaries(rows: DataFrame, groups: Sequence[str], n_batches: int, sums: Sequence[str] = (), mins: Sequence[str] = (), distinct: Sequence[str] = (), lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(node, g0.., n, s0.., m0.., d0..): what the nodes hold of each group; several rows of a node and group add up.

    Sums and counts add, minima take the least, and d_i counts the ids that no node above holds for the group.
    """
    columns = [*(F.col(c).alias(f"g{i}") for i, c in enumerate(groups)), *(F.col(c).alias(f"s{i}") for i, c in enumerate(sums)), *(F.col(c).alias(f"m{i}") for i, c in enumerate(mins)), *(F.col(c).alias(f"d{i}") for i, c in enumerate(distinct))]
    own = rows.select(F.col(lo).alias("lo"), F.col(hi).alias("hi"), *columns)
    own = own.dropna(subset=["lo", "hi"]).where(F.greatest("lo", F.lit(0)) < F.least("hi", F.lit(n_batches)))
    own = materialize(own, "view-rows")
    g, nodes = [f"g{i}" for i in range(len(groups))], canonical_nodes(F.col("lo"), F.col("hi"), n_batches)
    measures = [*(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(sums))), *(F.min(f"m{i}").alias(f"m{i}") for i in range(len(mins)))]
    found = own.withColumn("node", F.explode(nodes)).groupBy("node", *g).agg(F.count("*").alias("n"), *measures)
    for i in range(len(distinct)):
        holders = own.where(F.col(f"d{i}").isNotNull()).select(*g, f"d{i}", F.explode(nodes).alias("node")).groupBy(*g, f"d{i}").agg(F.collect_set("node").alias("held"))
        above = lambda v: F.array(*[F.shiftright(v, k) for k in range(1, _levels(n_batches) + 1)], F.lit(0).cast("long"))
        top = F.filter("held", lambda v: ~F.arrays_overlap(F.col("held"), above(v)))
        sets = holders.select(*g, F.explode(top).alias("node")).groupBy("node", *g).agg(F.count("*").alias(f"d{i}"))
        found = found.unionByName(sets, allowMissingColumns=True)
    return found


def batch_views(rows: DataFrame, groups: Sequence[str], n_batches: int, sums: Sequence[str] = (), mins: Sequence[str] = (), distinct: Sequence[str] = (), lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The view after each batch: one row (batch, groups.., n_rows, sum_c.., min_c.., distinct_c..) for each group that has rows then.

    rows have lifetimes [lo, hi) in batches 0 to n_batches - 1; n_rows counts repeated rows, sums and minima skip nulls,
    distinct counts the different ids that are not null.

    Defined results: a row without lo or hi, or whose lifetime has no batch, is in no view; a lifetime that reaches beyond the batches is cut;
    null groups are groups; ties and repeated rows count each; other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    held = node_summaries(rows, groups, n_batches, sums, mins, distinct, lo, hi)
    g = [f"g{i}" for i in range(len(groups))]
    path = held.withColumn("leaf", F.explode(_leaves(F.col("node"), n_batches))).groupBy(F.col("leaf").cast("int").alias("batch"), *g)
    measures = [*(F.sum(f"s{i}").alias(f"sum_{c}") for i, c in enumerate(sums)), *(F.min(f"m{i}").alias(f"min_{c}") for i, c in enumerate(mins)), *(F.coalesce(F.sum(f"d{i}"), F.lit(0)).alias(f"distinct_{c}") for i, c in enumerate(distinct))]
    return path.agg(F.sum("n").alias("n_rows"), *measures).select("batch", *[F.col(f"g{i}").alias(c) for i, c in enumerate(groups)], "n_rows", *[f"sum_{c}" for c in sums], *[f"min_{c}" for c in mins], *[f"distinct_{c}" for c in distinct])
