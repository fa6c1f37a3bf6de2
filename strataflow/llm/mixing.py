"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target number of words from its weight (water-filling under a cap of `max_epochs`
times its size). It is taken whole as often as the target allows; the fraction left is a weighted sample
without replacement: every document has the exponential key -ln(u) / quality, where u is a hash of its id,
and documents are taken in the order of their keys until the running sum of their sizes reaches the rest.

The running sum is distributed: keys are cut into ranges, ranges are summed by source (a partial
aggregation), their offsets are a short running sum, and only inside a range are documents ordered. So a
source with a third of all rows is spread over all ranges. Sources themselves are ranked and filled by ranges too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm._shared import bounded, materialize
from strataflow.llm._text import Words, chunks
from strataflow.operators.ranks import running

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """(carry..., id, source, salt, size, quality): words of each text, and words / (words + symbols) as its quality weight."""
    n = len(carry)
    own = docs.select(*[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)], F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).alias("salt"), F.col(text_col).cast("string").alias("text"))
    names = [*own.columns[: n + 3], "size", "quality"]

    def of(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"))
                total = np.concatenate(([0], np.cumsum(_SYMBOL[words.data])))
                symbols, size = total[words.at[1:]] - total[words.at[:-1]], words.counts()
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(n + 3)], pa.array(size, pa.int64()), pa.array((size + 1) / (size + symbols + 1.0), pa.float64())], names)

    bounded(docs.sparkSession)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[: n + 3]]
    return own.mapInArrow(of, ", ".join([*kinds, "size long", "quality double"]))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, budget: float | None = None) -> DataFrame:
    """(source, rank, source_size, target) for sizes (source, size). Weights repeat over the sources by code point, null last.

    With caps c = max_epochs * size, the level a source's weight is multiplied with is the largest of
    (budget - caps of the k sources that fill first) / (weights of the others): what resharing ends at.
    """
    total = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = running(total, [F.col("source").asc_nulls_last()]).withColumn("w", weight).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    filling = materialize(running(ranked.withColumnRenamed("rank", "place"), [(F.col("cap") / F.col("w")).asc(), F.col("place").asc()], ["cap", "w"]), "mix-filling")
    caps, shares, size = filling.agg(F.sum("cap"), F.sum("w"), F.sum("source_size")).first()
    goal = min(float(budget if budget is not None else size or 0), caps or 0.0)
    level = filling.agg(F.max((F.lit(goal) - F.col("before_cap")) / (F.lit(shares or 1.0) - F.col("before_w")))).first()[0]
    return filling.select("source", F.col("place").alias("rank"), "source_size", F.least("cap", F.col("w") * F.lit(level or 0.0)).alias("target"))


def _keyed(own: DataFrame, targets: DataFrame, max_epochs: int, seed: str) -> DataFrame:
    """Rows with their exponential key, their source's target, whole epochs, and what is left of it."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null:"), F.coalesce("salt", F.lit(0)))))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 1) / float((1 << 52) + 1)
    # sources are few beside documents, but their number has no bound, so Spark chooses how to join them
    of = targets.withColumnRenamed("source", "_source")
    keyed = own.join(of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("key", -F.log(u) / F.col("quality"))
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    return keyed.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))


def _placed(docs: DataFrame, weights: Sequence[float], max_epochs: int, budget: float | None, seed: str, ranges: int | None, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Each row with `extra`, whether the fractional epoch of its source takes it; and the targets."""
    own = materialize(measured(docs, id_col, text_col, source_col), "mix-sizes", compact=True)
    targets = materialize(source_targets(own.select("source", "size"), weights, max_epochs, budget), "mix-targets")
    if ranges is None:
        ranges = math.isqrt(own.count()) + 1
    keyed = _keyed(own, targets, max_epochs, seed).withColumn("range", F.least(F.lit(ranges - 1), F.floor((1 - F.exp(-F.col("key"))) * ranges)).cast("int"))
    sums = keyed.groupBy("rank", "range").agg(F.sum("size").alias("own"))
    offsets = sums.select("rank", "range", (F.sum("own").over(Window.partitionBy("rank").orderBy("range")) - F.col("own")).alias("offset"))
    inside = Window.partitionBy("rank", "range").orderBy("key", "id", "size")
    summed = keyed.join(offsets, ["rank", "range"]).withColumn("before", F.col("offset") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return summed.withColumn("extra", (F.col("size") > 0) & (F.col("before") * 2 + F.col("size") <= F.col("rest") * 2) & (F.col("epochs") < max_epochs)), targets


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, budget: float | None = None, seed: str = "mix", ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document: id_col, source, size, source_size, target, quality, copies, taken.

    copies = whole epochs of its source, and one more if the fractional epoch takes it (its middle word lies before
    the end of the rest); taken = copies * size. The same input gives the same mix. Keys are cut into as many
    `ranges` as the square root of the rows, so neither a range nor the running sum over ranges outgrows a task.

    Defined results: null and empty texts have size 0 and are taken in whole epochs only, with 0 words; a null source is a
    source of its own, the last; a null id is replaced by a hash of the text; rows that share an id and a quality share a
    key and are told apart by size, equal rows by chance (which of them is taken makes no difference); other columns are
    ignored; an empty table gives no rows.
    """
    placed, _ = _placed(docs, weights, max_epochs, budget, seed, ranges, id_col, text_col, source_col)
    copies = F.when(F.col("source_size") > 0, F.col("epochs") + F.col("extra").cast("long")).otherwise(0)
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "quality", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, budget: float | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copies_col: str = "copies") -> DataFrame:
    """The documents the mix takes, with all their columns, and how often (`copies_col`, replaced if docs has it).

    The fractional epoch takes a source's documents in the order of their keys up to the last one taken, so that one key for each
    source decides, and texts are not shuffled: a second scan measures them again and compares. Rows equal in id, source and size
    are taken alike; else results are those of mix_sources.
    """
    placed, targets = _placed(docs, weights, max_epochs, budget, seed, None, id_col, text_col, source_col)
    cuts = placed.where("extra").groupBy("rank").agg(F.max(F.struct("key", "id", "size")).alias("cut"))
    limits = materialize(targets.join(cuts, "rank", "left"), "mix-cuts")
    keep = [c for c in docs.columns if c != copies_col]
    own = _keyed(measured(docs, id_col, text_col, source_col, keep), limits, max_epochs, seed)
    extra = F.coalesce((F.col("size") > 0) & (F.struct("key", "id", "size") <= F.col("cut")), F.lit(False))
    copies = F.when(F.col("source_size") > 0, F.col("epochs") + extra.cast("long")).otherwise(0)
    return own.withColumn("_copies", copies).where("_copies > 0").select(*[F.col(f"carry_{i}").alias(c) for i, c in enumerate(keep)], F.col("_copies").alias(copies_col))
