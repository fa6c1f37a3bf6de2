"""The vector index through inserts, deletes and splits: what it holds, and its recall against exact search."""

import numpy as np
import pytest

from strataflow.operators import ivf


def rows(seed, n, start=0, shift=None):
    """Vectors around forty centres; shift moves all of them one way, as new kinds of rows do."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(40, 16))
    own = centres[rng.integers(0, 40, n)] + 0.35 * rng.normal(size=(n, 16)) + (0 if shift is None else shift)
    return [(start + k, [float(x) for x in v]) for k, v in enumerate(own)]


def frame(spark, data):
    return spark.createDataFrame(data, "vec long, e array<double>")


def test_recall_after_a_fifth_has_changed(spark):
    data = rows(1, 2500)
    index = ivf.build(frame(spark, data), "vec", "e")
    before = index.recall(frame(spark, data[::50]))
    fresh = rows(2, 300, 10_000) + rows(3, 200, 20_000, shift=np.full(16, 1.5)) + [(5, data[6][1])]
    gone = [k for k in range(0, 2500, 10)]
    index = index.with_rows(frame(spark, fresh)).without(spark.createDataFrame([(k,) for k in gone], "id long")).split(1.5).compacted()
    held = {**dict(data), **dict(fresh)}
    held = {k: v for k, v in held.items() if k not in set(gone)}
    assert index.n == len(held) and {r.id for r in index.lists.collect()} == set(held) and index.lists.count() == len(held)
    sizes = [r["count"] for r in index.lists.groupBy("cell").count().collect()]
    assert max(sizes) <= 4 * len(held) / len(index.centres)
    asked = frame(spark, [(k, v) for k, v in sorted(held.items())][::40])
    assert before >= 0.9 and index.recall(asked) >= 0.9


def test_only_what_changes_is_coded_again(spark):
    data = rows(4, 600)
    index = ivf.build(frame(spark, data), "vec", "e")
    code = lambda x: {r.id: (r.cell, bytes(r.code)) for r in x.lists.collect()}
    before, more = code(index), index.with_rows(frame(spark, rows(5, 30, 1000)))
    after = code(more)
    assert {k: v for k, v in after.items() if k < 1000} == before and len(after) == 630
    split = more.split(1.2)
    grown = len(split.centres) - len(more.centres)
    assert grown > 0
    moved = {k for k, v in code(split).items() if v != after[k]}
    large = {r["cell"] for r in more.lists.groupBy("cell").count().where(f"count > {1.2 * 630 / len(more.centres)}").collect()}
    assert grown == len(large) and all(after[k][0] in large for k in moved)
    assert code(split.split(1000)) == code(split)


def test_an_index_may_become_empty(spark):
    data = rows(6, 20)
    index = ivf.build(frame(spark, data), "vec", "e").without(spark.createDataFrame([(k,) for k, _ in data], "id long")).compacted()
    assert index.n == 0 and index.search(frame(spark, data[:2])).count() == 0
    again = index.with_rows(frame(spark, data[:5]))
    assert again.n == 5 and again.recall(frame(spark, data[:2]), 3) == pytest.approx(1.0)


def test_a_search_shuffles_no_candidates(spark, monkeypatch):
    """Through all lists with every row a candidate, only the k nearest of a task and query leave it; the rows are those of the exact search."""
    data = rows(7, 1200) + [(5000 + k, [0.0] * 16) for k in range(3)] + [(6000 + k, rows(7, 1)[0][1]) for k in range(15)]
    index = ivf.build(frame(spark, data), "vec", "e", tile_rows=400)
    seen = []
    top = ivf.top_k
    monkeypatch.setattr(ivf, "top_k", lambda found, *a: (seen.append(found.count()), top(found, *a))[1])
    asked = frame(spark, [*data[::60], data[-1], data[1201]])
    found = index.search(asked, 5, probes=len(index.centres), candidates=index.n, block_rows=7)
    got = {(r.query, r["rank"]): r.id for r in found.collect()}
    units = -(-len(data) // 400)
    assert sum(seen) <= asked.count() * (units + 1) * 5
    assert got == {(r.query, r["rank"]): r.id for r in ivf.knn(index.vectors, asked, "vec", "e", 5).collect()}
