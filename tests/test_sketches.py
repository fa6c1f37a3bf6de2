"""Summaries by day against the events themselves: errors within what is stated, days added without the events of others."""

import random
from collections import Counter

from pyspark.sql import functions as F

from strataflow.operators import sketches


def events(spark):
    rng = random.Random(8)
    rows = [(f"2024-01-{1 + k % 12:02d}", rng.choice(["a", "b", None]), rng.choice([rng.randrange(3000), None]), rng.choice([rng.gauss(50, 10), None]), f"t{min(int(rng.expovariate(0.15)), 200)}") for k in range(24_000)]
    return rows, spark.createDataFrame(rows, "day string, key string, id int, value double, term string")


def test_merged_days_are_near_the_events(spark, tmp_path):
    rows, df = events(spark)
    kept = sketches.kept(spark, str(tmp_path / "s"), 8)
    for days in (df.where("day <= '2024-01-07'"), df.where("day >= '2024-01-07'"), df.where("day = '2024-01-03'")):
        done = kept.replace_groups(sketches.daily(days, "day", "key", "id", "value"))
    assert len(done.buckets) == 1  # a day that comes again touches its own bucket
    for upto in ("2024-01-12", "2024-01-05"):
        got = {r.key: r for r in sketches.merged(kept.rows().where(F.col("day") <= upto), [0.25, 0.5, 0.75]).collect()}
        for key in ("a", "b", None):
            own = [r for r in rows if r[1] == key and r[0] <= upto]
            ids, values = {r[2] for r in own} - {None}, sorted(r[3] for r in own if r[3] is not None)
            assert got[key].n == len(own) and abs(got[key].different - len(ids)) <= 0.08 * len(ids)
            for q, v in zip((0.25, 0.5, 0.75), got[key].quantiles, strict=True):
                assert abs(sum(x <= v for x in values) / len(values) - q) <= 0.03


def test_frequent_terms_have_their_bounds(spark):
    rows, df = events(spark)
    days = sketches.heavy(df, "day", "key", "term", 0.01)
    assert days.groupBy("day", "key").count().agg(F.max("count")).first()[0] <= 100
    got = {(r.key, r.term): (r.at_least, r.at_most) for r in sketches.frequent(days, 0.02, 0.01).collect()}
    exact, totals = Counter((r[1], r[4]) for r in rows), Counter(r[1] for r in rows)
    assert {k for k, n in exact.items() if n >= 0.02 * totals[k[0]]} <= set(got)
    assert all(a <= exact[k] <= b for k, (a, b) in got.items())


def test_no_events_and_no_values(spark):
    _, df = events(spark)
    assert sketches.merged(sketches.daily(df.where("false"), "day", "key", "id", "value")).count() == 0
    none = df.where("key = 'a'").limit(5).withColumn("value", F.lit(None).cast("double")).withColumn("id", F.lit(None).cast("int"))
    (row,) = sketches.merged(sketches.daily(none, "day", "key", "id", "value")).collect()
    assert row.n == 5 and row.different == 0 and row.quantiles is None
