"""Synchronisation of sources into keyed tables: each batch of a stream is applied once, whatever fails in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.sources.keyed import KeyedTable, Written


def synchronise(stream: DataFrame, table: KeyedTable, checkpoint: str, name: str, mark: str | None = None, shape: Callable[[DataFrame], DataFrame] = lambda batch: batch, done: list[Written] | None = None) -> None:
    """Applies what is new in a stream to a table, then stops.

    Spark's checkpoint keeps how far the source has been read, the table's manifest which batch is in it: a run killed
    after the source was read and before the table's version was complete applies the batch again; one killed
    after that, before Spark noted the batch, skips it. mark is a column whose greatest value the version keeps as the
    stream's watermark (`watermarks`); a batch without rows keeps the mark before.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rows = shape(batch)
        latest = table.state()[1].get(name, (None, None))[1]

        def marked(written: DataFrame) -> str | None:
            # of the rows as they have been written, so the source is read once; a mark that the table does not keep is looked up in the batch
            own = None if mark is None else written if mark in written.columns else rows
            found = None if own is None else own.agg(F.max(F.col(mark)).cast("string")).first()[0]
            return max((x for x in (latest, found) if x is not None), default=None)

        written = table.upsert(rows, name, number, marked)
        if done is not None:
            done.append(written)

    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def watermarks(table: KeyedTable) -> DataFrame:
    """(stream, batch, mark): how far each stream has come, as of the version that readers see."""
    rows = [(s, b, m) for s, (b, m) in table.state()[1].items()]
    return table.spark.createDataFrame(rows, "stream string, batch long, mark string")
