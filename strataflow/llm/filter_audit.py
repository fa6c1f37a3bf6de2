"""Interaction of filters: what each of five filters removes in each of their 120 orders.

One scan measures every text: which of the four filters on the text alone it fails, and a digest by which equal texts meet for the fifth. What
a document fails is a mask of five bits. For every mask and order, a table of 32 by 120 has the step that removes the document; each
task looks its documents' masks up, counts (part, order, step, labels) with np.bincount, and hands on one array of counts
for each part. Spark adds the arrays up.

A text that a third of the corpus shares is counted before it is shuffled; documents meet their text's least id under the
key (id, digest), so its copies are spread by their ids.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm._shared import bounded, materialize
from strataflow.llm._text import chunks

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Good and toxic: a document's labels are one of four.
LABELS = 4

_UPPER = bytes(range(65, 91))
_MARKS = b"#$%&*|"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: A task hands on the counts of so many parts at a time.
_PARTS = 64


def first_failures() -> np.ndarray:
    """[mask, order]: the step, from 0, of the first filter in the order whose bit is in the mask; 5 if none is."""
    at = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    fails = np.arange(1 << len(FILTERS))[:, None, None] >> at[None] & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), len(FILTERS))


def _vocabulary(text: bytes, most: int = 1 << 20) -> tuple[int, set[bytes]]:
    """How many words a text has, and the different ones; its words are split off about `most` bytes at a time."""
    n, different, at = 0, set(), 0
    while at < len(text):
        end = _SPACE.search(text, at + most)
        stop = end.start() if end else len(text)
        words = text[at:stop].split()  # of bytes, so at space and 0x09 to 0x0D only
        n, at = n + len(words), stop
        different.update(words)
    return n, different


def _mask(text: bytes, characters: int, min_words: int, min_distinct: int, most_upper: int) -> int:
    n, different = _vocabulary(text)
    upper = len(text) - len(text.translate(None, _UPPER))
    marked = len(text) != len(text.translate(None, _MARKS))
    return (n < min_words) | (100 * len(different) < min_distinct * n) << 1 | (100 * upper > most_upper * characters) << 2 | marked << 3


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", min_words: int = 100, min_distinct: int = 80, most_upper: int = 10) -> DataFrame:
    """(id, part, mask, digest) of each document: the failures of A to D as bits, and 128 bits of the text's BLAKE2."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def of(batches):
        for batch in batches:
            for rows in chunks(batch, "text"):
                texts = rows.column("text")
                raw = [x.as_py() for x in texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())]
                masks = [_mask(t, n, min_words, min_distinct, most_upper) for t, n in zip(raw, pc.utf8_length(texts).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("part"), pa.array(masks, pa.int32()), pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in raw], pa.binary())], ["id", "part", "mask", "digest"])

    bounded(docs.sparkSession)
    return own.mapInArrow(of, "id long, part string, mask int, digest binary")


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", min_words: int = 100, min_distinct: int = 80, most_upper: int = 10) -> DataFrame:
    """(part, mask, label) of each document; bit 4 of the mask is a text that a document with a smaller id has too."""
    own = materialize(measured(docs, id_col, text_col, part_col, min_words, min_distinct, most_upper), "audit-measures", compact=True)
    known, unknown = own.where("id is not null"), own.where("id is null")
    told = labels.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int").alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int").alias("toxic"))
    told = told.where("id is not null").groupBy("id").agg((F.max("good") + 2 * F.max("toxic")).alias("label"))
    least = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(1))
    found = known.join(told, "id", "left").join(least, ["id", "digest"], "left")
    mask = F.col("mask") + F.when(F.col("first").isNull(), 16).otherwise(0)
    return found.select("part", mask.alias("mask"), F.coalesce("label", F.lit(0)).alias("label")).unionByName(unknown.select("part", "mask", F.lit(0).alias("label")))


def counted(failed: DataFrame) -> DataFrame:
    """(part, cells): arrays of counts for (part, mask, label) rows, several for each part, to be added up.

    A cell is (order * 6 + step) * 4 + label; after these come the documents of each mask.
    """
    table, steps = first_failures(), len(FILTERS) + 1
    grid = len(ORDERS) * steps * LABELS
    base = np.arange(len(ORDERS)) * (steps * LABELS)

    def of(batches):
        cells: dict[str, np.ndarray] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(cells), pa.string()), pa.array([c.tolist() for c in cells.values()], pa.list_(pa.int64()))], ["part", "cells"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                rows = batch.slice(at, 1 << 14)
                names = pc.dictionary_encode(rows.column("part").cast(pa.string()))
                part, mask, label = names.indices.to_numpy(zero_copy_only=False), rows.column("mask").to_numpy(zero_copy_only=False), rows.column("label").to_numpy(zero_copy_only=False)
                for k, name in enumerate(names.dictionary.to_pylist()):
                    mine = part == k
                    places = base[None] + table[mask[mine]] * LABELS + label[mine][:, None]
                    if name not in cells and len(cells) == _PARTS:
                        yield out()
                        cells.clear()
                    one = cells.setdefault(name, np.zeros(grid + len(table), dtype=np.int64))
                    one[:grid] += np.bincount(places.ravel(), minlength=grid)
                    one[grid:] += np.bincount(mask[mine], minlength=len(table))
        if cells:
            yield out()

    bounded(failed.sparkSession)
    return failed.mapInArrow(of, "part string, cells array<long>")


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", min_words: int = 100, min_distinct: int = 80, most_upper: int = 10) -> DataFrame:
    """One row for each part, order of the filters and step: what the step's filter removes, and what it would have.

    Filters: A fewer than min_words words, B fewer than min_distinct % different words, C more than most_upper % of
    `[A-Z]` among the characters, D any of `#$%&*|`, E a text that a document with a smaller id has too.
    Columns: part, filter_order, step (1 to 5), kept (after the step), removed, redundant (failing, but removed earlier), unique_fails (failing this
    filter only), good_lost and toxic_lost (removed with quality 1, with toxic 1), shapley (removed by the filter, over all orders).

    Defined results: a null text is empty, and empty texts are equal; a null part is the part of the empty string; a null id has
    no smaller one, is none, and has no labels; rows that share an id are not each other's earlier copy and
    share labels, and of several labels of an id one that is 1 counts; other columns are ignored whatever their names; an empty table gives no rows.
    """
    sums = counted(failures(docs, labels, id_col, text_col, part_col, min_words, min_distinct, most_upper)).select("part", F.posexplode("cells").alias("cell", "n")).groupBy("part", "cell").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "audit-counts", compact=True)
    steps = len(FILTERS) + 1
    grid = len(ORDERS) * steps * LABELS
    of_label = lambda bit: F.sum(F.when(F.col("cell").bitwiseAND(bit) != 0, F.col("n")).otherwise(0))
    place = F.floor(F.col("cell") / LABELS)
    removed = sums.where(F.col("cell") < grid).groupBy("part", F.floor(place / steps).cast("int").alias("o"), (place % steps + 1).cast("int").alias("step")).agg(F.sum("n").alias("removed"), of_label(1).alias("good_lost"), of_label(2).alias("toxic_lost"))
    along = Window.partitionBy("part", "o").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    named = removed.withColumn("kept", F.sum("removed").over(along)).where(F.col("step") < steps)
    named = named.withColumn("filter_order", F.element_at(F.array(*map(F.lit, ORDERS)), F.col("o") + 1)).withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    named = named.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))
    fails = F.col("mask").bitwiseAND(F.col("bit"))
    of_filter = F.explode(F.array(*[F.struct(F.lit(c).alias("letter"), F.lit(1 << i).alias("bit")) for i, c in enumerate(FILTERS)])).alias("f")
    masks = sums.where(F.col("cell") >= grid).select("part", "n", (F.col("cell") - grid).cast("int").alias("mask"), of_filter).select("part", "n", "mask", "f.*")
    total = masks.groupBy("part", "letter").agg(F.sum(F.when(fails != 0, F.col("n")).otherwise(0)).alias("failing"), F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n")).otherwise(0)).alias("unique_fails"))
    return named.join(total, ["part", "letter"]).select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
