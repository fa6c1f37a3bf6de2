"""Ranks and running sums over a whole table: ranges of rows hold the work, one row for each range ties them together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.session import cut


def running(rows: DataFrame, order: Sequence[Column], sums: Sequence[str] = (), part_rows: int = 100_000) -> DataFrame:
    """Rows with `rank` from 1 in the order given, and before_c, the sum of c over the rows before.

    Rows are dealt into ranges of about `part_rows`; what lies before a range is a sum over one row for each range.
    """
    parts = rows.count() // part_rows + 1
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_of"), *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in ("n", *sums)])
    inside = Window.partitionBy("_part").orderBy(*order)
    found = dealt.join(offsets, F.col("_part") == F.col("_of")).withColumn("rank", F.col("_n") + F.row_number().over(inside))
    for c in sums:
        found = found.withColumn(f"before_{c}", F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return found.select(*rows.columns, "rank", *[f"before_{c}" for c in sums])
