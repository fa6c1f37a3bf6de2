"""Joins whose left side may have a third of its rows under one key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", counted: DataFrame | None = None, share: int = 1000) -> DataFrame:
    """left joined with right on the columns `on`, sorted and spilling, with frequent values of on[0] dealt over many tasks.

    A value with more than 1 / share of the rows of `counted` (left itself, unless a cheaper frame with its keys is given) is
    frequent: there are fewer than `share` of them, whatever the size, so they go to the driver and are broadcast. Their rows on the left get a
    salt from the row and its task, so equal rows part as well; their rows on the right are repeated once a salt,
    at most 2 * share repeats for all values together. Column names must not begin with `spread_`.
    """
    key, rows = on[0], left if counted is None else counted
    total = rows.count()
    frequent = [(k, math.ceil(n * share / total)) for k, n in rows.groupBy(key).count().where(F.col("count") * share > total).collect()] if total else []
    if not frequent:
        return left.join(right.hint("merge"), list(on), how)
    kind = left.schema[key].dataType.simpleString()
    parts = F.broadcast(left.sparkSession.createDataFrame(frequent, f"spread_key {kind}, spread_parts int"))
    found = lambda side: side.join(parts, F.col(key).eqNullSafe(F.col("spread_key")), "left").drop("spread_key")
    row = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]) + F.spark_partition_id() * 7919
    dealt = found(left).withColumn("spread_salt", F.coalesce(F.pmod(row, F.col("spread_parts")), F.lit(0)).cast("int")).drop("spread_parts")
    repeated = found(right).withColumn("spread_salt", F.explode(F.sequence(F.lit(0), F.coalesce("spread_parts", F.lit(1)) - 1))).drop("spread_parts")
    return dealt.join(repeated.hint("merge"), [*on, "spread_salt"], how).drop("spread_salt")
