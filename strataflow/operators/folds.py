"""Ordered folds over sorted rows: a task reads its keys' rows in order and holds one key's state, whatever the length of its history."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions.session import ship


def sorted_fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], step: Callable, schema: str, finish: Callable | None = None, batch_rows: int = 4096) -> DataFrame:
    """(keys.., what the fold puts out, with `schema`).

    step(state, *values) gives the next state (None at a key's beginning) and a tuple to put out, or None; finish(state) gives a
    tuple at a key's end. Rows are shuffled by key and sorted with spilling; nothing is listed. A key's rows are one task's, in
    order, so give keys as fine as the fold allows. Null keys are keys; ties in `order` are in any order.
    """
    ship(rows.sparkSession)
    n, m = len(keys), len(keys) + len(order)
    own = rows.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate([*keys, *order, *values])])
    dealt = own.repartition(*own.columns[:n]).sortWithinPartitions(*own.columns[:m])
    target = rows.sparkSession.createDataFrame([], ", ".join([*(f"k{i} {own.schema[i].dataType.simpleString()}" for i in range(n)), schema])).schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(target)
        key, state, begun, held = None, None, False, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if not begun or row[:n] != key:
                    if begun and finish is not None:
                        held.append((*key, *finish(state)))
                    key, state, begun = row[:n], None, True
                state, put = step(state, *row[m:])
                if put is not None:
                    held.append((*key, *put))
                if len(held) >= batch_rows:
                    yield out()
                    held.clear()
        if begun and finish is not None:
            held.append((*key, *finish(state)))
        if held:
            yield out()

    found = dealt.mapInArrow(of, target)
    return found.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keys)})
