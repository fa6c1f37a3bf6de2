"""Joins whose left side may have a large share of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequent(rows: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Keys (key) that hold more than one in `share` of the rows: fewer than `share`, whatever the rows, so they may be broadcast."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).join(F.broadcast(total)).where(F.col("n") * share > F.col("total")).select(key)


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 32, share: int = 1000) -> DataFrame:
    """left.join(right, key), with the rows of the left side's frequent keys dealt over `salts` tasks by what is in them.

    Only the right side's rows of frequent keys are repeated, once for each salt. Rows that are equal stay in one task; make them
    distinct first.
    """
    heavy = F.broadcast(frequent(left, key, share).withColumn("_heavy", F.lit(True)))
    own = F.pmod(F.xxhash64(*[c for c in left.columns]), F.lit(salts)).cast("int")
    dealt = left.join(heavy, key, "left").withColumn("_salt", F.when(F.col("_heavy"), own).otherwise(0)).drop("_heavy")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    met = right.join(heavy, key, "left").withColumn("_salt", F.explode(F.when(F.col("_heavy"), every).otherwise(F.array(F.lit(0))))).drop("_heavy")
    return dealt.join(met, [key, "_salt"]).drop("_salt")
