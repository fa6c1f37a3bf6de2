"""Quality by perplexity under an interpolated modified Kneser-Ney model of the bytes of trusted text.

Plan
----
1. Texts are compressed in lots dealt by a hash of the document id (of the text where the id is null) into blocks (one shuffle of
   compressed text; a block has about `block_bytes`, partitions are as many as blocks). Label rows meet their block, so the trusted documents are known without a join of texts.
2. A block counts its n-grams in trusted text and names all n-grams of its texts (the map-side combine). Both travel as
   compressed sorted blobs to shards by n-gram; a shard adds up the counts.
3. The model is built by Spark joins and aggregations on the n-gram tables: highest-order counts, continuation counts of the
   lower orders, discounts from counts of counts, contexts. One join chain per order gives each n-gram that any
   document has its probability.
4. Shards answer each block with the probabilities of its n-grams, in the order it named them; the block sums them by
   document. Perplexities are cut at the quantile of trusted documents of the language.

What is gathered grows with the corpus (each block names its n-grams); nothing but a few sums and one threshold for each
language reaches the driver or is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm._lots import block_count, by_block, packed, unpacked
from strataflow.llm._shared import bounded, materialize, text_bytes
from strataflow.llm._text import buffers, chunks

_U8 = np.uint64(8)
#: Bytes of text whose n-grams are held at a time: eight bytes each, several times over.
_SLICE = 1 << 20


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values).tobytes())


def _unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=kind)


def _deltas(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.zeros(1, dtype=values.dtype))


_LOT = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("text", pa.string())])


def _rows(table: pa.Table) -> pa.Table:
    """The documents of a block, ordered by id, language and text."""
    return unpacked(table, _LOT)


def _grams(part: pa.RecordBatch, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of the texts (zeros before a text), and the offsets of the texts."""
    data, at = buffers(part.column("text"))
    n, pad = len(at) - 1, order - 1
    place = np.arange(len(data)) + np.repeat((np.arange(n) + 1) * pad, np.diff(at))
    padded = np.zeros(len(data) + (n + 1) * pad, dtype=np.uint8)
    padded[place] = data
    grams = np.zeros(len(data), dtype=np.uint64)
    for k in range(order):
        grams <<= _U8
        grams |= padded[place - (pad - k)]
    return grams, at


def _distinct(rows: pa.Table, order: int) -> np.ndarray:
    """All n-grams of a block, a slice of its texts at a time."""
    found = [np.unique(_grams(part, order)[0]) for part in chunks(rows, "text", _SLICE)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def _share(grams: np.ndarray, shards: int) -> np.ndarray:
    """The shard of an n-gram: by a hash, so that shards are even."""
    mixed = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return (mixed * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _named(distinct: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams ordered by shard, then value, and the bounds of the shards."""
    shard = _share(distinct, shards)
    order = np.argsort(shard, kind="stable")
    return distinct[order], shard[order], np.searchsorted(shard[order], np.arange(shards + 1))


def _counted(order: int, shards: int):
    def of_block(table: pa.Table, trusted: pa.Table) -> pa.Table:
        names = ["shard", "block", "grams", "counts"]
        if not table.num_rows:
            return pa.table({"shard": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "grams": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})
        rows = _rows(table)
        by_value = _distinct(rows, order)
        all_, _, bounds = _named(by_value, shards)
        ids = trusted.column("id").to_numpy() if trusted.num_rows else np.zeros(0, dtype=np.int64)
        taught = np.zeros(len(by_value), dtype=np.int64)
        for part in chunks(rows, "text", _SLICE):
            known = part.column("id")
            own = np.isin(known.fill_null(-1).to_numpy(zero_copy_only=False), ids) & known.is_valid().to_numpy(zero_copy_only=False)
            if own.any():
                grams, at = _grams(part, order)
                seen, n = np.unique(grams[np.repeat(own, np.diff(at))], return_counts=True)
                taught[np.searchsorted(by_value, seen)] += n
        counts = taught[np.searchsorted(by_value, all_)].astype(np.uint32)
        block = table.column("block")[0].as_py()
        used = [k for k in range(shards) if bounds[k + 1] > bounds[k]]
        return pa.Table.from_arrays([
            pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int32()),
            pa.array([_pack(_deltas(all_[bounds[k] : bounds[k + 1]])) for k in used], pa.binary()), pa.array([_pack(counts[bounds[k] : bounds[k + 1]]) for k in used], pa.binary()),
        ], names)

    return of_block


def _added(table: pa.Table) -> pa.Table:
    """Counts of a shard over all blocks."""
    grams = np.concatenate([np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in table.column("grams").to_pylist()])
    counts = np.concatenate([_unpack(x, np.uint32) for x in table.column("counts").to_pylist()])
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order].astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()] * len(at), pa.int32()), "g": pa.array(grams[at].view(np.int64)), "c": pa.array(np.add.reduceat(counts, at), pa.int64())})


def _answered(asked: pa.Table, known: pa.Table) -> pa.Table:
    """For each block that asked, the log probabilities of its n-grams of this shard, in its order."""
    order = np.argsort(known.column("g").to_numpy(), kind="stable") if known.num_rows else np.zeros(0, dtype=np.int64)
    grams = known.column("g").to_numpy()[order] if known.num_rows else np.zeros(0, dtype=np.int64)
    logs = known.column("lp").to_numpy()[order] if known.num_rows else np.zeros(0)
    blobs = []
    for x in asked.column("grams").to_pylist():
        own = np.cumsum(_unpack(x, np.uint64), dtype=np.uint64).view(np.int64)
        blobs.append(_pack(logs[np.searchsorted(grams, own)].astype(np.float32)))
    return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "lps": pa.array(blobs, pa.binary())})


class _Lookup:
    """Values of known uint64 keys by hashing: colliding keys go to a next, smaller table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.levels = []
        salt = 0x9E3779B97F4A7C15
        while len(keys):
            bits = max(4, int(len(keys)).bit_length() + 2)
            shift, factor = np.uint64(64 - bits), np.uint64(salt | 1)
            slot = (keys * factor) >> shift
            owner = np.full(1 << bits, -1, dtype=np.int64)
            owner[slot] = np.arange(len(keys))
            won = owner[slot] == np.arange(len(keys))
            key, value = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.float32)
            key[slot[won]], value[slot[won]] = keys[won], values[won]
            # an empty slot must not look like the key 0
            filled = owner >= 0
            if not filled[0 if not len(slot) else int((np.uint64(0) * factor) >> shift)]:
                key[int((np.uint64(0) * factor) >> shift)] = np.uint64(1)
            self.levels.append((factor, shift, key, value))
            keys, values = keys[~won], values[~won]
            salt = (salt * 6364136223846793005 + 1442695040888963407) & ((1 << 64) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out, left, own = np.zeros(len(keys), dtype=np.float32), None, keys
        for factor, shift, key, value in self.levels:
            slot = (own * factor) >> shift
            found = key[slot] == own
            if left is None:
                out = value[slot]
                left = np.flatnonzero(~found)
            else:
                out[left[found]] = value[slot[found]]
                left = left[~found]
            own = keys[left]
            if not len(left):
                break
        return out


def _scored(order: int, shards: int):
    def of_block(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "n_bytes": pa.array([], pa.int64()), "log_prob": pa.array([], pa.float64())})
        rows = _rows(table)
        named, _, _ = _named(_distinct(rows, order), shards)
        got = dict(zip(answers.column("shard").to_pylist(), answers.column("lps").to_pylist(), strict=True))
        values = np.concatenate([_unpack(got[k], np.float32) for k in sorted(got)]) if got else np.zeros(0, dtype=np.float32)
        lookup, sums, sizes = _Lookup(named, values), [], []
        for part in chunks(rows, "text", _SLICE):
            grams, at = _grams(part, order)
            total = np.concatenate(([0.0], np.cumsum(lookup.get(grams), dtype=np.float64)))
            sums.append(total[at[1:]] - total[at[:-1]])
            sizes.append(np.diff(at))
        return pa.table({"id": rows.column("id"), "lang": rows.column("lang"), "n_bytes": pa.array(np.concatenate(sizes), pa.int64()), "log_prob": pa.array(np.concatenate(sums), pa.float64())})

    return of_block


def _discounts(level: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney, from the counts of counts."""
    n = [0, *level.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    ratio = lambda k: n[k + 1] / n[k] if n[k] else 0.0
    return tuple(min(max(k - (k + 1) * y * ratio(k), 0.0), k - 0.01) if n[k] else 0.5 * min(k, 1) for k in (1, 2, 3))


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """(g, lp): the log probability of the last byte of each n-gram after the bytes before it.

    counts: distinct (g long, c long), g the bytes of an n-gram, the oldest highest; c = 0 asks for an n-gram that training
    does not have. Interpolated over all orders down to the uniform distribution over 256 bytes.
    """
    levels, asked = {order: materialize(counts.where("c > 0").select("g", "c"), f"kn-{order}")}, {order: counts.select("g")}
    for k in range(order - 1, 0, -1):
        mask = (1 << (8 * k)) - 1
        levels[k] = materialize(levels[k + 1].groupBy(F.col("g").bitwiseAND(F.lit(mask).cast("long")).alias("g")).agg(F.count("*").alias("c")), f"kn-{k}")
        asked[k] = asked[k + 1].select(F.col("g").bitwiseAND(F.lit(mask).cast("long")).alias("g")).distinct()
    lower = None
    for k in range(1, order + 1):
        d1, d2, d3 = _discounts(levels[k])
        discount = lambda c: F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)  # noqa: B023, E731
        seen = levels[k].withColumn("h", F.shiftright("g", 8))
        context = seen.groupBy("h").agg(F.sum("c").alias("tot"), F.sum(discount(F.col("c"))).alias("mass"))
        mask = (1 << (8 * (k - 1))) - 1
        own = asked[k].select("g", F.shiftright("g", 8).alias("h"), F.col("g").bitwiseAND(F.lit(mask).cast("long")).alias("low"))
        joined = own.join(seen.select("g", "c"), "g", "left").join(context, "h", "left")
        joined = joined.withColumn("p_low", F.lit(1 / 256)) if lower is None else joined.join(lower.select(F.col("g").alias("low"), F.col("p").alias("p_low")), "low", "left")
        p = F.when(F.col("tot").isNull(), F.col("p_low")).otherwise((F.coalesce(F.col("c") - discount(F.col("c")), F.lit(0.0)) + F.col("mass") * F.col("p_low")) / F.col("tot"))
        lower = materialize(joined.select("g", p.alias("p")), f"kn-p{k}")
    return lower.select("g", F.log("p").alias("lp"))


def _thresholds(scored: DataFrame, quantile: float) -> DataFrame:
    """(lang, cut): the quantile of the held-out documents' perplexities, exact to a thousandth of the logarithm; lang null holds the common one."""
    bins = scored.where("role = 'held out' AND n_bytes > 0").select("lang", F.round(F.log("perplexity"), 3).alias("bin"))
    by_lang = bins.groupBy("lang", "bin").agg(F.count("*").alias("n")).where("lang IS NOT NULL")
    every = bins.groupBy("bin").agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "n")
    w = Window.partitionBy("lang")
    ranked = by_lang.unionByName(every).withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    return ranked.where(F.col("upto") >= F.col("all") * quantile).groupBy("lang").agg(F.exp(F.min("bin") + 0.0005).alias("cut"))


def perplexity_filter(docs: DataFrame, trusted: DataFrame, order: int = 5, quantile: float = 0.99, held_out: int = 3, block_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Perplexity (by byte) of each document, and whether it is at most the threshold of its language.

    trusted: (id_col) of the trusted documents. One in `held_out` of them, by a hash of the id, is kept out of training; a
    language's threshold is the `quantile` of the perplexities of its documents held out, so that unseen text is judged by
    unseen text (the largest of them where there are fewer than 1 / (1 - quantile)).
    Returns id_col, lang, n_bytes, log_prob, perplexity, role ("train", "held out" or null), threshold, kept.

    Defined results: null and empty texts have 0 bytes, perplexity 0 and are not kept; only a language without any document
    held out, and the null language, take the quantile of all documents held out; without any trusted text every byte has probability
    1/256 and every text with bytes is kept; rows that share an id are all trusted or none; a null id is never
    trusted; other columns are ignored; an empty table gives no rows.

    `block_bytes` bounds the memory of a task; by default blocks grow with the square root of the corpus, as in substring dedup.
    """
    if not 1 <= order <= 7:
        raise ValueError("order has to be from 1 to 7: an n-gram is packed into a long")
    bounded(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = block_count(text_bytes(own), block_bytes)
    # labels know ids only; a null id is in no label, so its rows are dealt by their texts
    dealt = lambda *keys: F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    block = F.when(F.col("id").isNull(), dealt("lang", "text")).otherwise(dealt("id")).alias("block")
    lots = by_block(own.select(block, "id", "lang", "text").mapInArrow(packed(_LOT, level=6), "block int, blob binary"), n, "block")
    role = F.when(F.pmod(F.xxhash64(F.lit("role"), F.col("id")), F.lit(held_out)) == 0, "held out").otherwise("train")
    marks = trusted.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct().select(dealt("id").alias("block"), "id", role.alias("role"))
    taught = by_block(marks.where("role = 'train'").select("block", "id"), n, "block")
    asked = materialize(lots.groupBy("block").cogroup(taught.groupBy("block")).applyInArrow(_counted(order, n), "shard int, block int, grams binary, counts binary"), "kn-asked")
    counts = materialize(by_block(asked, n, "shard").groupBy("shard").applyInArrow(_added, "shard int, g long, c long"), "kn-counts")
    known = kneser_ney(counts.select("g", "c"), order).join(counts.select("g", "shard"), "g").select("shard", "g", "lp")
    answers = by_block(asked.select("shard", "block", "grams"), n, "shard").groupBy("shard").cogroup(by_block(known, n, "shard").groupBy("shard")).applyInArrow(_answered, "block int, shard int, lps binary")
    answers = by_block(answers, n, "block")
    summed = lots.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(order, n), "id long, lang string, n_bytes long, log_prob double")
    perplexity = F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_prob") / F.col("n_bytes"))).otherwise(0.0)
    summed = materialize(summed.withColumn("perplexity", perplexity), "kn-scores")
    scored = summed.join(marks.select(F.col("id").alias("_mark"), "role"), F.col("id") == F.col("_mark"), "left").drop("_mark")
    cuts = materialize(_thresholds(scored, quantile), "kn-cuts")
    common = cuts.where("lang IS NULL").select(F.col("cut").alias("common"))
    own_cut = cuts.where("lang IS NOT NULL").select(F.col("lang").alias("_lang"), "cut")
    # one row, or none without trusted text
    limit = common.agg(F.first("common").alias("common"))
    joined = scored.join(own_cut, F.col("lang") == F.col("_lang"), "left").join(F.broadcast(limit))
    threshold = F.coalesce(F.col("cut"), F.col("common"), F.lit(257.0))
    return joined.select(F.col("id").alias(id_col), "lang", "n_bytes", "log_prob", "perplexity", "role", threshold.alias("threshold"), ((F.col("n_bytes") > 0) & (F.col("perplexity") <= threshold)).alias("kept"))
