"""Communities of a file graph: folders that grow together, cut to a size, with the best-connected files added last.

Nothing is collected: labels, links of labels and free places are tables, a round is a few joins of them, and what a round leaves is
written to the shared folder. Folders are merged until no two communities are joined by more than `cross` edges; as joining others only
adds edges to a pair, every order of merges ends at the same communities, so a round merges all that may be merged at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.session import cut
from strataflow.operators.ranks import running


def roots(links: DataFrame) -> DataFrame:
    """(label, root) of labels (x, y pairs): each points to its least neighbour, pointers are followed to their end; labels that point nowhere are left out.

    The length of a path of pointers halves in each round. Labels of one connected part may keep several roots: the caller goes on
    while there are links.
    """
    both = links.select(F.col("x").alias("label"), F.col("y").alias("other")).unionByName(links.select(F.col("y").alias("label"), F.col("x").alias("other")))
    up = cut(both.groupBy("label").agg(F.min("other").alias("root")).where("root < label"))
    while True:
        beyond = up.select(F.col("label").alias("root"), F.col("root").alias("beyond"))
        up = cut(up.join(beyond, "root", "left").select("label", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if up.where("moved").isEmpty():
            return up.select("label", "root")
        up = up.select("label", "root")


def merged_labels(labels: DataFrame, links: DataFrame, cross: int) -> DataFrame:
    """(name, label): names (name) under their community's label, once no two labels share more than `cross` of the links (x, y, n; x < y)."""
    own = cut(labels.select("name", F.col("name").alias("label")))
    links = cut(links)
    while True:
        open_ = links.where(F.col("n") > cross)
        if open_.isEmpty():
            return own
        up = roots(open_)
        own = cut(own.join(up, "label", "left").select("name", F.coalesce("root", "label").alias("label")))
        a, b = up.select(F.col("label").alias("x"), F.col("root").alias("rx")), up.select(F.col("label").alias("y"), F.col("root").alias("ry"))
        ends = links.join(a, "x", "left").join(b, "y", "left").select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y"), "n").where("x <> y")
        links = cut(ends.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.sum("n").alias("n")))


def places_by_rank(wishes: DataFrame, rooms: DataFrame, most: int) -> DataFrame:
    """(node, community): each node, in the order of `place`, gets the community it is tied to most (n, then by name) of those that have room.

    wishes: node, place, community, n; rooms: community, room (`most` at most). All ask at once; a community keeps those that come first, the others ask on.
    That gives what serving them one after the other gives, as all communities prefer the same order.
    """
    open_ = cut(wishes.join(rooms.where("room > 0"), "community"))
    first = Window.partitionBy("community").orderBy("place")
    while True:
        asked = open_.groupBy("node", "place").agg(F.min(F.struct((-F.col("n")).alias("k"), "community", "room")).alias("w")).select("node", "place", "w.community", "w.room")
        held = cut(asked.withColumn("seat", F.row_number().over(first)).where(F.col("seat") <= most + 1).where("seat <= room + 1"))
        # the first who finds no seat bars the community to all from there on: seats only go to earlier ones
        full = held.where("seat = room + 1").select("community", F.col("place").alias("bar"))
        if full.isEmpty():
            return held.select("node", "community")
        open_ = cut(open_.join(full, "community", "left").where("bar IS NULL OR place < bar").drop("bar"))


def communities(edges: DataFrame, folder: Callable[[Column], Column], scores: DataFrame | None = None, hub_share: float = 0.05, cross: int = 3, largest: int = 20, least: int = 3) -> DataFrame:
    """(node, community) of a graph (src, dst), a community named by the least of its nodes that are no hubs.

    The `hub_share` of nodes with the highest score (scores: node, score; without them the number of neighbours; ties by name) are
    hubs. The others start as their folders, which merge while more than `cross` edges join two of them. What then has more than
    `largest` members falls back into its folders, and a folder of more into runs of that many by name. Hubs, the highest first,
    join the community that most of their neighbours that are no hubs are in, of those with fewer than `largest` members; hubs without one fill
    what room is left, by name; the rest stand alone. Communities under `least` members are dropped. Direction, repeated edges and loops do not count;
    null ends are ignored; an empty graph has no communities.
    """
    ends = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    pairs = cut(ends)
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    score = both.groupBy("node").agg(F.count("*").alias("score"))
    if scores is not None:
        score = score.select("node").join(scores.select("node", "score"), "node", "left").fillna({"score": 0})
    ranked = cut(running(score, [F.col("score").desc(), F.col("node")]))
    n_hubs = int(ranked.count() * hub_share)
    hubs = ranked.where(F.col("rank") <= n_hubs).select("node", F.col("rank").alias("place"))
    own = cut(ranked.where(F.col("rank") > n_hubs).select("node", F.coalesce(folder(F.col("node")), F.lit("")).alias("folder")))

    a, b = own.select(F.col("node").alias("a"), F.col("folder").alias("fa")), own.select(F.col("node").alias("b"), F.col("folder").alias("fb"))
    links = pairs.join(a, "a").join(b, "b").where("fa <> fb").groupBy(F.least("fa", "fb").alias("x"), F.greatest("fa", "fb").alias("y")).agg(F.count("*").alias("n"))
    labels = merged_labels(own.select(F.col("folder").alias("name")).distinct(), links, cross)
    sizes = own.groupBy("folder").agg(F.count("*").alias("n")).join(labels.withColumnRenamed("name", "folder"), "folder")
    large = sizes.groupBy("label").agg((F.sum("n") > largest).alias("large"))
    placed = running(own, [F.col("folder"), F.col("node")])
    starts = placed.groupBy("folder").agg(F.min("rank").alias("start"))
    parts = placed.join(starts, "folder").join(sizes.join(large, "label").select("folder", "label", "large"), "folder")
    piece = F.when(F.col("large"), F.struct("folder", F.floor((F.col("rank") - F.col("start")) / largest).alias("run")))
    members = cut(parts.select("node", "label", piece.alias("piece")))
    named = members.groupBy("label", "piece").agg(F.min("node").alias("community"), F.count("*").alias("n"))
    named = cut(named)
    every = members.join(named, (members["label"] == named["label"]) & members["piece"].eqNullSafe(named["piece"])).select("node", "community")

    rooms = named.select("community", (largest - F.col("n")).alias("room"))
    wishes = both.join(hubs, "node").join(every.withColumnRenamed("node", "other"), "other").groupBy("node", "place", "community").agg(F.count("*").alias("n"))
    seated = cut(places_by_rank(wishes, rooms, largest))
    left = running(hubs.join(seated, "node", "left_anti"), [F.col("place")])
    taken = seated.groupBy("community").agg(F.count("*").alias("taken"))
    free = running(rooms.join(taken, "community", "left").select("community", (F.col("room") - F.coalesce("taken", F.lit(0))).alias("free")).where("free > 0"), [F.col("community")], ["free"])
    seats = free.select("community", F.explode(F.sequence(F.col("before_free") + 1, F.col("before_free") + F.col("free"))).alias("rank"))
    rest = left.join(seats, "rank", "left").select("node", F.coalesce("community", "node").alias("community"))
    found = cut(every.unionByName(seated).unionByName(rest))
    kept = found.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return found.join(kept.select("community"), "community", "left_semi").select("node", "community")
