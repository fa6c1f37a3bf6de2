"""An approximate vector index: inverted lists with product quantisation, fitted on a bounded sample, holding every row.

A vector belongs to the list of its nearest centroid and is kept as one byte for each group of dimensions (the nearest of 256 codewords of
what the centroid leaves). A query looks at the lists of its nearest centroids, ranks their rows by the distances of codes, and compares
the best of them exactly. Rows come and go without a new build: only they are coded, and lists that have grown are split. Similarities are cosines; vectors are scaled to length 1, and zero vectors have similarity 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.session import cut
from strataflow.operators.retrieval import knn, top_k


def _units(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)


def _matrix(column) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _units(flat.reshape(len(column), -1))


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(1)[None, :] - 2.0 * rows @ centres.T


def k_means(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centres of at most k clusters; an empty one takes the row that is worst off."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        gaps = _distances(rows, centres)
        own = gaps.argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        for empty in np.flatnonzero(n == 0):
            centres[empty] = rows[gaps[np.arange(len(rows)), own].argmax()]
    return centres


def _coded(rows: DataFrame, centres: np.ndarray, books: np.ndarray) -> DataFrame:
    """(id, cell, code) of rows (id, v): the nearest centre, and the nearest codewords of what it leaves."""
    groups, _, width = books.shape

    def of(batches):
        for batch in batches:
            own = _matrix(batch.column(1))
            cell = _distances(own, centres).argmin(1)
            left = own - centres[cell]
            codes = np.stack([_distances(left[:, g * width : (g + 1) * width], books[g]).argmin(1).astype(np.uint8) for g in range(groups)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.array([x.tobytes() for x in codes], pa.binary())], ["id", "cell", "code"])

    return rows.mapInArrow(of, "id long, cell int, code binary")


def _tiled(rows: DataFrame, everything: DataFrame, tile_rows: int) -> DataFrame:
    """Rows with the tile of their list, as many as the list's rows in `everything` need."""
    sizes = everything.groupBy("cell").agg(F.count("*").alias("_n"))
    return rows.join(sizes, "cell").select("id", "cell", F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / tile_rows)).cast("int").alias("tile"), "code")


def _sampled(rows: DataFrame, sample: int) -> np.ndarray:
    """Unit vectors of up to `sample` rows (id, v), chosen by a hash."""
    some = rows.orderBy(F.xxhash64("id")).limit(sample).collect()
    return _units(np.array([r["v"] for r in some], dtype=np.float64).reshape(len(some), -1)) if some else np.zeros((0, 1))


@dataclass
class IvfIndex:
    """The lists (id, cell, tile, code) of an index, its centres and codebooks, and the rows it was built from."""

    lists: DataFrame
    vectors: DataFrame
    key: str
    vector: str
    centres: np.ndarray
    books: np.ndarray  # groups x 256 x dimensions of a group
    n: int
    #: lists to look at and candidates to compare, as the sample needs them for the target recall
    probes: int
    candidates: int
    tile_rows: int = 50_000
    sample: int = 20_000
    target: float = 0.97

    def _own(self, vectors: DataFrame) -> DataFrame:
        return vectors.select(F.col(self.key).cast("long").alias("id"), F.col(self.vector).alias("v"))

    def without(self, ids: DataFrame) -> IvfIndex:
        """The index without the rows whose ids are in the first column of `ids`; nothing else is written again."""
        gone = cut(ids.select(F.col(ids.columns[0]).cast("long").alias("id")).distinct())
        vectors = self.vectors.join(gone.withColumnRenamed("id", self.key), self.key, "left_anti")
        return replace(self, lists=self.lists.join(gone, "id", "left_anti"), vectors=vectors, n=self.n - self.lists.join(gone, "id", "left_semi").count())

    def with_rows(self, vectors: DataFrame) -> IvfIndex:
        """The index with these rows as well, in place of rows of the same ids: only they are coded, with the centres and codewords that are there."""
        rows = vectors.select(self.key, self.vector)
        base = self.without(rows)
        new = cut(_coded(self._own(rows), self.centres, self.books))
        lists = base.lists.unionByName(_tiled(new, base.lists.select("cell").unionByName(new.select("cell")), self.tile_rows))
        return replace(base, lists=lists, vectors=base.vectors.unionByName(rows), n=base.n + new.count())

    def split(self, most: float = 2.0) -> IvfIndex:
        """The index with each list of more than `most` times the mean length in two: their rows alone are coded again.

        A list's two centres are fitted on a bounded sample of its rows; rows go to the nearer. The lists, and so the centres that the
        driver holds, are as many as the build allows and one more for each split.
        """
        sizes = {r["cell"]: r["count"] for r in self.lists.groupBy("cell").count().collect()}
        mean = sum(sizes.values()) / max(len(self.centres), 1)
        large = sorted(c for c, size in sizes.items() if size > max(most * mean, 2))
        if not large:
            return self
        rows = cut(self._own(self.vectors).join(self.lists.where(F.col("cell").isin(large)).select("id", "cell"), "id"))
        place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id")))
        each = max(32, self.sample // len(large))
        some = rows.withColumn("place", place).where(F.col("place") <= each).select("cell", "v").collect()
        centres, into = self.centres.copy(), {}
        for cell in large:
            pair = k_means(_units(np.array([r["v"] for r in some if r["cell"] == cell], dtype=np.float64)), 2)
            centres[cell], into[cell] = pair[0], len(centres)
            centres = np.vstack([centres, pair[-1:]])
        # a row of a list that was split may now be nearest to any centre
        coded = cut(_coded(rows.select("id", "v"), centres, self.books))
        rest = self.lists.where(~F.col("cell").isin(large))
        tiled = _tiled(coded, rest.select("cell").unionByName(coded.select("cell")), self.tile_rows)
        return replace(self, lists=rest.unionByName(tiled), centres=centres)

    def compacted(self) -> IvfIndex:
        """The same index with its lists and rows written anew, so that plans do not grow with the changes; searches set for what it holds now."""
        vectors = cut(self.vectors)
        matrix = _sampled(self._own(vectors), self.sample)
        n = vectors.count()
        needs = _needs(matrix, self.centres, self.books, n, self.target) if len(matrix) else (self.probes, self.candidates)
        return replace(self, lists=cut(self.lists), vectors=vectors, n=n, probes=needs[0], candidates=needs[1])

    def recall(self, queries: DataFrame, k: int = 10) -> float:
        """The share of the true k nearest neighbours of the queries that a search finds."""
        exact = knn(self.vectors, queries, self.key, self.vector, k).select("query", "id")
        found = self.search(queries, k).select("query", "id").withColumn("hit", F.lit(1.0))
        return float(exact.join(found, ["query", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0)))).first()[0] or 0.0)

    def stale(self, rows: int, share: float = 0.2) -> bool:
        """Whether so many rows differ from what was indexed by more than `share`: then build anew."""
        return abs(rows - self.n) > share * max(self.n, 1)

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, candidates: int | None = None, block_rows: int = 4096) -> DataFrame:
        """(query, id, similarity, rank): the k nearest of `candidates` from `probes` lists, by default as many as the index found it needs.

        A task holds lists of about `tile_rows` rows and up to `block_rows` queries; it takes a query's candidates by the codes, compares them exactly
        and gives only its k nearest, so what is shuffled does not grow with candidates or lists looked at.
        """
        centres, books, take = self.centres, self.books, max(candidates or self.candidates, 2 * k)
        near = min(probes or self.probes, len(centres))
        # lists, or tiles of long ones, share a task up to about `tile_rows` rows
        sizes, units, total = self.lists.groupBy("cell", "tile").count().collect(), [], 0
        for cell, tile, n in sorted(tuple(r) for r in sizes):
            units.append((cell, tile, total // self.tile_rows))
            total += n
        of_cell: dict[int, set[int]] = {}
        for cell, _, unit in units:
            of_cell.setdefault(cell, set()).add(unit)

        def asked(batches):
            for batch in batches if of_cell else ():
                rows = _matrix(batch.column(1))
                names, found = batch.column(0).to_pylist(), []
                for row, cells in enumerate(np.argsort(_distances(rows, centres), axis=1, kind="stable")[:, :near].tolist()):
                    met: dict[int, list[int]] = {}
                    for cell in cells:
                        for unit in of_cell.get(cell, ()):
                            met.setdefault(unit, []).append(cell)
                    found += [(names[row], unit, own, rows[row].tobytes()) for unit, own in met.items()]
                columns = list(zip(*found, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary()), strict=True)], ["query", "unit", "cells", "v"])

        def scan(own: pa.Table, wanted: pa.Table) -> pa.Table:
            out = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])
            if not own.num_rows or not wanted.num_rows:
                return out.empty_table()
            ids, cell, rows = own.column("id").to_numpy(), own.column("cell").to_numpy(), _matrix(own.column("v").combine_chunks())
            names, asking = wanted.column("query").to_numpy(), np.frombuffer(b"".join(wanted.column("v").to_pylist()), dtype=np.float64).reshape(wanted.num_rows, -1)
            lists, ranked = wanted.column("cells").to_pylist(), len(ids) > take
            if ranked:
                codes = np.frombuffer(b"".join(own.column("code").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
                # what codes stand for: distances to it are those of the codes
                coded = centres[cell] + np.concatenate([books[g][codes[:, g]] for g in range(len(books))], axis=1)
                square = (coded**2).sum(1)
            found = [], [], []
            step = max(1, 2_000_000 // len(ids))
            for at in range(0, len(names), step):
                q = asking[at : at + step]
                sims = q @ rows.T
                gaps = square[None, :] - 2.0 * q @ coded.T if ranked else None
                for n, name in enumerate(names[at : at + step]):
                    looked = np.zeros(len(centres), dtype=bool)
                    looked[lists[at + n]] = True
                    pick = np.flatnonzero(looked[cell] & (ids != name))
                    if len(pick) > take:
                        pick = pick[np.argpartition(gaps[n, pick], take)[: take + 1]]
                    if len(pick) > k:
                        edge = np.partition(sims[n, pick], len(pick) - k)[len(pick) - k]
                        pick = pick[sims[n, pick] >= edge - 2e-9]  # ties at the edge are settled by id
                    best = pick[np.lexsort((ids[pick], -np.round(sims[n, pick], 9)))][:k]
                    for column, values in zip(found, (np.full(len(best), name), ids[best], sims[n, best]), strict=True):
                        column.append(values)
            return pa.table({f.name: pa.array(np.concatenate(c), f.type) for f, c in zip(out, found, strict=True)}, schema=out)

        wanted = self._own(queries)
        spark = self.lists.sparkSession
        placed = spark.createDataFrame(units, "cell int, tile int, unit int")
        blocks = max(1, math.ceil(wanted.count() / block_rows))
        rows = self.lists.join(F.broadcast(placed), ["cell", "tile"]).join(self._own(self.vectors), "id").select("id", "cell", "code", "v", "unit", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        spread = wanted.mapInArrow(asked, "query long, unit int, cells array<int>, v binary").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
        close = rows.groupBy("unit", "block").cogroup(spread.groupBy("unit", "block")).applyInArrow(scan, "query long, id long, similarity double")
        return top_k(close, "query", F.round("similarity", 9), "id", k)


def _needs(rows: np.ndarray, centres: np.ndarray, books: np.ndarray, n: int, target: float, k: int = 10, most: int = 128) -> tuple[int, int]:
    """How many lists and candidates find the share `target` of the k nearest among the sample's rows, asked by up to `most` of them."""
    if len(rows) < 2:
        return len(centres), 2 * k
    width = books.shape[2]
    cell = _distances(rows, centres).argmin(1)
    left = rows - centres[cell]
    coded = np.concatenate([books[g][_distances(left[:, g * width : (g + 1) * width], books[g]).argmin(1)] for g in range(len(books))], axis=1) + centres[cell]
    lists, ranks = [], []
    for q in range(min(most, len(rows))):
        exact = np.argsort(-(rows @ rows[q]), kind="stable")
        true = exact[exact != q][:k]
        order = np.empty(len(centres), dtype=int)
        order[np.argsort(_distances(rows[q : q + 1], centres)[0], kind="stable")] = np.arange(len(centres))
        lists += (order[cell[true]] + 1).tolist()
        gaps = ((coded - rows[q]) ** 2).sum(1)
        ranks += [(gaps <= gaps[t]).sum() for t in true]
    # a row has to be in a list that is looked at and among the candidates
    share = 1 - (1 - target) / 2
    return int(np.quantile(lists, share, method="higher")), int(math.ceil(np.quantile(ranks, share, method="higher") * max(1.0, n / len(rows)))) + 2 * k


def build(vectors: DataFrame, key: str, vector: str, cells: int | None = None, groups: int = 16, sample: int = 20_000, tile_rows: int = 50_000, target: float = 0.97) -> IvfIndex:
    """An index of all rows. Centres and codewords are fitted on `sample` rows chosen by a hash; lists of more than `tile_rows` rows are cut into tiles.

    What a search looks at is set so that it finds the share `target` of the sample's true neighbours.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    n = rows.count()
    matrix = _sampled(rows, sample) if n else np.zeros((1, groups))
    groups = max(g for g in range(1, groups + 1) if matrix.shape[1] % g == 0)
    centres = k_means(matrix, cells or max(1, min(4096, int(math.sqrt(n)))))
    rest = matrix - centres[_distances(matrix, centres).argmin(1)]
    width = matrix.shape[1] // groups
    books = np.zeros((groups, 256, width))
    for g in range(groups):
        found = k_means(rest[:, g * width : (g + 1) * width], 256, 8, g)
        books[g] = np.vstack([found, np.full((256 - len(found), width), 1e6)])

    lists = cut(_coded(rows, centres, books))
    return IvfIndex(_tiled(lists, lists, tile_rows), vectors.select(key, vector), key, vector, centres, books, n, *_needs(matrix, centres, books, n, target), tile_rows, sample, target)
