"""Communities against a brute force that merges, splits and seats one thing at a time."""

import random

import pytest
from pyspark.sql import functions as F

from strataflow.operators.communities import communities, merged_labels, places_by_rank

FOLDER = lambda c: F.split(c, "/")[0]


def brute_force(edges, share, cross, largest, least, rng):
    pairs = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    ranked = sorted(near, key=lambda n: (-len(near[n]), n))
    hubs = ranked[: int(len(ranked) * share)]
    files = sorted(set(ranked) - set(hubs))
    by_folder = {f.split("/")[0]: [] for f in files}
    for f in files:
        by_folder[f.split("/")[0]].append(f)
    groups = list(by_folder.values())
    while True:
        # one merge at a time, in an order left to chance: every order ends the same
        able = [(i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)) if sum(b in near[a] for a in groups[i] for b in groups[j]) > cross]
        if not able:
            break
        i, j = rng.choice(able)
        groups[i] = groups[i] + groups.pop(j)
    cut = []
    for g in groups:
        if len(g) <= largest:
            cut.append(sorted(g))
            continue
        for folder in sorted({f.split("/")[0] for f in g}):
            own = sorted(f for f in g if f.split("/")[0] == folder)
            cut += [own[k : k + largest] for k in range(0, len(own), largest)]
    names = {g[0]: list(g) for g in cut}
    base = {f: g[0] for g in cut for f in g}
    late = []
    for hub in hubs:
        votes = {}
        for f in near[hub]:
            if f in base and len(names[base[f]]) < largest:
                votes[base[f]] = votes.get(base[f], 0) + 1
        if votes:
            names[min(votes, key=lambda c: (-votes[c], c))].append(hub)
        else:
            late.append(hub)
    for hub in late:
        free = [c for c in sorted(names) if c in base and len(names[c]) < largest]
        names.setdefault(free[0] if free else hub, []).append(hub)
    return {f: c for c, g in names.items() if len(g) >= least for f in g}


@pytest.mark.parametrize(("seed", "share", "largest"), [(1, 0.05, 20), (2, 0.3, 6), (3, 0.5, 3), (4, 0.2, 9)])
def test_against_brute_force(spark, seed, share, largest):
    rng = random.Random(seed)
    files = [f"{d}/f{i:02}" for d in "abcdefgh" for i in range(rng.choice([3, 5, 11]))]
    edges = [(x, y) for _ in range(300) for x, y in [rng.sample(files, 2)] if x[0] == y[0] or (x[0], y[0]) in (("a", "b"), ("h", "d"), ("e", "a")) or rng.random() < 0.06]
    df = spark.createDataFrame([*edges, *edges[:5], (files[0], files[0]), (None, files[1])], "src string, dst string")
    got = {r.node: r.community for r in communities(df, FOLDER, hub_share=share, largest=largest).collect()}
    assert got == brute_force(edges, share, 3, largest, 3, rng)


def test_merges_that_others_bring_about(spark):
    # d has two edges to each of a and b: too few for either, enough for both together; a long chain merges in few rounds
    links = [("a", "b", 4), ("a", "d", 2), ("b", "d", 2), ("d", "e", 3)] + [(f"n{i:03}", f"n{i + 1:03}", 9) for i in range(60)]
    names = sorted({x for a, b, _ in links for x in (a, b)})
    got = {r.name: r.label for r in merged_labels(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(links, "x string, y string, n long"), 3).collect()}
    assert got == {**{n: "n000" for n in names if n[0] == "n"}, "a": "a", "b": "a", "d": "a", "e": "e"}


def test_places_go_to_the_first(spark):
    wishes = [("h1", 1, "c", 5), ("h2", 2, "c", 9), ("h2", 2, "d", 1), ("h3", 3, "d", 2), ("h3", 3, "e", 1), ("h4", 4, "c", 1)]
    got = {(r.node, r.community) for r in places_by_rank(spark.createDataFrame(wishes, "node string, place int, community string, n int"), spark.createDataFrame([("c", 1), ("d", 1), ("e", 2)], "community string, room int"), 2).collect()}
    assert got == {("h1", "c"), ("h2", "d"), ("h3", "e")}


def test_scores_and_empty_graphs(spark):
    edges = spark.createDataFrame([("a/1", "a/2"), ("a/2", "a/3"), ("a/3", "a/4")], "src string, dst string")
    scores = spark.createDataFrame([("a/4", 9.0)], "node string, score double")
    got = {r.node: r.community for r in communities(edges, FOLDER, scores, hub_share=0.25).collect()}
    assert got == {n: "a/1" for n in ("a/1", "a/2", "a/3", "a/4")}
    assert communities(edges.limit(0), FOLDER).count() == 0
