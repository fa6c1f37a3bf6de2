"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are cut into groups of correlated bits. If a group i is probed up to t_i flipped bits, every
pair within `distance` bits shares a probe of some group as long as sum(t_i + 1) = distance + 1 (t_i = -1
leaves a group out). How many groups there are and which t_i they get is found by dynamic programming over
the rows to shuffle and the candidates to verify, estimated on a bounded sample; the sample decides
speed only, never which pairs are found.

Equal fingerprints are merged before anything is joined. A probe key that more than `hot` different
fingerprints share is not joined: its members are cut further by pieces of their other bits, one of which near ones
share, and compared within those groups; a group gives back the links of a spanning forest only, so
that n near copies cost n links and not their square.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm._shared import bounded, materialize
from strataflow.llm._text import LOWER_BYTES
from strataflow.llm.components import connected_components

SAMPLE = 4096
#: Shingles whose bits are held at a time.
_SLICE = 1 << 16


def _fingerprint(text: bytes, words: int, seed: int) -> int:
    """The signed 64-bit SimHash of one text."""
    norm = b" ".join(text.translate(LOWER_BYTES).split())
    if not norm:
        return 0
    gaps = np.flatnonzero(np.frombuffer(norm, dtype=np.uint8) == 32)
    if len(gaps) < words:
        starts, stops = [0], [len(norm)]
    else:
        starts = np.concatenate(([0], gaps[: len(gaps) - words + 1] + 1)).tolist()
        stops = np.concatenate((gaps[words - 1 :], [len(norm)])).tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _SLICE):
        raw = b"".join([digest(norm[a:b], seed) for a, b in zip(starts[at : at + _SLICE], stops[at : at + _SLICE], strict=True)])
        ones += np.add.reduce(np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SimHash of the XXH64 of all shingles of `words` words: (id_col, fp long). A text without words has 0. An id is a long or a struct."""

    def of(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_fingerprint(x or b"", words, seed) for x in texts], pa.int64())], ["id", "fp"])

    bounded(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    if not kind.startswith("struct<"):
        own, kind = own.withColumn("id", F.col("id").cast("long")), "long"
    return own.mapInArrow(of, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def bit_groups(fps: DataFrame, m: int, moments: tuple[np.ndarray, int] | None = None) -> list[list[int]]:
    """Cuts the 64 bits into m groups of near equal size, correlated bits together."""
    both, n = moments or bit_moments(fps)
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(phi, 0)
    left, groups = set(range(64)), []
    for g in range(m):
        size = (len(left) + m - g - 1) // (m - g)
        group = [max(left, key=lambda b: (phi[b, sorted(left)].max(), -b))]
        left.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(left), key=lambda b: phi[b, group].mean()))
            left.discard(group[-1])
        groups.append(sorted(group))
    return groups


def bit_moments(fps: DataFrame) -> tuple[np.ndarray, int]:
    """How often each two bits are set together, over all fingerprints, and how many there are."""

    def of(batches):
        both, n = np.zeros((64, 64), dtype=np.int64), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float64)
            both += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, 64), pa.int32()), pa.array(np.append(j, 64), pa.int32()), pa.array(np.append(both[i, j], n), pa.int64())], ["i", "j", "n"])

    table, n = np.zeros((64, 64)), 0
    for row in fps.select("fp").mapInArrow(of, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # 4,097 rows at most
        if row["i"] == 64:
            n = row["n"]
        else:
            table[row["i"], row["j"]] = row["n"]
    return table, n


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def allocate(groups: list[list[int]], sample: np.ndarray, n: int, distance: int, most: int = 2) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) = distance + 1 of the least estimated cost, by dynamic programming."""
    scale = (n / max(len(sample), 1)) ** 2
    costs = []
    for bits in groups:
        part = sample & np.uint64(_mask(bits))
        near = np.zeros(65)
        for x in part:
            near += np.bincount(np.bitwise_count(part ^ x), minlength=65)
        near[0] -= len(part)  # a fingerprint and itself
        costs.append({-1: 0.0} | {t: 4.0 * n * (1 + sum(math.comb(len(bits), k) for k in range(t + 1))) + scale * near[: t + 1].sum() for t in range(most + 1)})
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t, c in cost.items():
                if used + t + 1 <= distance + 1 and (used + t + 1 not in then or total + c < then[used + t + 1][0]):
                    then[used + t + 1] = (total + c, [*chosen, t])
        best = then
    return best.get(distance + 1, (math.inf, []))


def probe_plan(fps: DataFrame, distance: int) -> list[tuple[int, list[int]]]:
    """(mask, flips to probe) of each group that is probed."""
    moments = bit_moments(fps)
    sample = np.array([r["fp"] for r in fps.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    plans = []
    for m in range(2, distance + 2):
        groups = bit_groups(fps, m, moments)
        cost, chosen = allocate(groups, sample, moments[1], distance)
        plans.append((cost, [(g, t) for g, t in zip(groups, chosen, strict=False) if t >= 0]))
    _, plan = min(plans, key=lambda x: x[0])
    return [(_signed(_mask(g)), [_signed(_mask(list(c))) for k in range(t + 1) for c in combinations(g, k)]) for g, t in plan]


def _forest(distance: int):
    def of(table: pa.Table) -> pa.Table:
        nodes = np.unique(table.column("fp").to_numpy()).view(np.uint64)
        left, found = nodes.copy(), []
        while len(left):
            front, left = [left[0]], left[1:]
            while front and len(left):
                x = front.pop()
                near = np.bitwise_count(left ^ x) <= distance
                if near.any():
                    fresh = left[near]
                    found += [(x, y) for y in fresh]
                    front += list(fresh)
                    left = left[~near]
        pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": pa.array(pairs[:, 0].copy()), "b": pa.array(pairs[:, 1].copy())})

    return of


def _pieces(mask: int, n: int) -> list[int]:
    """The bits outside a mask in n pieces."""
    outside = [b for b in range(64) if not mask >> b & 1]
    return [_mask(outside[k::n]) for k in range(n)]


def near_links(fps: DataFrame, distance: int = 4, hot: int = 64, block: int = 2048) -> DataFrame:
    """Links (a, b) between different fingerprints that connect exactly those within `distance` bits.

    fps: distinct (fp long). Under a key that at most `hot` fingerprints share, each near pair is a link; under
    others the links of a spanning forest of each group of at most `block` are, which connect the same fingerprints.
    """
    plan = probe_plan(fps, distance)
    def spread(only_own: bool) -> DataFrame:
        options = [F.struct(F.lit(i).alias("part"), F.lit(mask).cast("long").alias("mask"), F.lit(flip).cast("long").alias("flip")) for i, (mask, flips) in enumerate(plan) for flip in (flips[:1] if only_own else flips)]
        return fps.select("fp", F.explode(F.array(*options)).alias("p")).select("fp", "p.part", F.col("fp").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip")).alias("key"))

    index, probe = spread(True), spread(False)
    size = index.groupBy("part", "key").agg(F.count("*").alias("n"))
    busy = materialize(size.where(F.col("n") > hot), "hot-keys")
    cold = index.join(busy, ["part", "key"], "left_anti")
    pairs = probe.alias("x").join(cold.alias("y"), ["part", "key"]).where((F.col("x.fp") < F.col("y.fp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance))
    links = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    if busy.isEmpty():
        return links
    # members that differ in `distance` bits at most agree in one of distance + 1 pieces of the bits outside the key: a key with
    # more than `block` fingerprints is cut by those first
    members = probe.join(busy, ["part", "key"])
    pieces = F.array(*[F.array(*[F.lit(_signed(x)).cast("long") for x in _pieces(mask, distance + 1)]) for mask, _ in plan])
    whole = members.where(F.col("n") <= block).select("fp", "part", "key", F.lit(-1).alias("piece"), F.lit(0).cast("long").alias("bits"), "n")
    cut = members.where(F.col("n") > block).select("fp", "part", "key", F.posexplode(F.get(pieces, F.col("part"))).alias("piece", "mask")).select("fp", "part", "key", "piece", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"))
    keys = ["part", "key", "piece", "bits"]
    sized = cut.join(cut.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), keys).select("fp", *keys, "n")
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = whole.unionByName(sized).withColumn("own", F.pmod(F.xxhash64("fp"), n_blocks).cast("int"))
    # what agrees in a piece and is too much still is compared in blocks, each two of which meet once
    tiles = dealt.select("fp", *keys, "own", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("other")).select("fp", *keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return links.unionByName(tiles.groupBy(*keys, "i", "j").applyInArrow(_forest(distance), "a long, b long"))


def near_duplicates(docs: DataFrame, distance: int = 4, words: int = 4, seed: int = 42, hot: int = 64, block: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose SimHash fingerprints differ by `distance` bits or fewer.

    Returns id_col, fp (long), component_id (the least id that can be reached, its own included).

    Defined results: null, empty and blank texts have fingerprint 0 and are linked like others; a text
    with fewer words than a shingle is one shingle; of a long text the bits of some shingles are held at a time, besides the text; equal texts and repeated rows share a component; a null id
    keeps its row and is never a component's id unless no other id is in it; other columns are ignored; an
    empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, words, seed, id_col, text_col).withColumnRenamed(id_col, "id"), "fingerprints", compact=True)
    known = materialize(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = connected_components(near_links(known.select("fp"), distance, hot, block)).withColumnRenamed("node", "fp")
    linked = known.join(roots, "fp")
    label = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    every = materialize(known.join(label, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "labelled-fingerprints")
    # at most 1,000 fingerprints can have a thousandth of the rows each: those go to every task, the rest is joined
    total = every.agg(F.sum("n")).first()[0] or 0
    often, seldom = (every.where(c).select("fp", "component_id") for c in (F.col("n") * 1000 >= total, F.col("n") * 1000 < total))
    rest = fps.join(F.broadcast(often.select("fp")), "fp", "left_anti").join(seldom, "fp")
    return fps.join(F.broadcast(often), "fp").select("id", "fp", "component_id").unionByName(rest.select("id", "fp", "component_id")).select(F.col("id").alias(id_col), "fp", "component_id")
