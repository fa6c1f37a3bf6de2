"""Folds as keyed state against folds over sorted lists: out of order, over many triggers, for a year of minutes."""

import random

import pandas as pd
from compare import assert_same, connect
from conftest import SF
from pyspark.sql import functions as F

from strataflow.operators import runtime
from strataflow.plans import registry
from strataflow.streaming import folds
from strataflow.streaming.streams import drained, event_stream

registry.load()
START = 1_700_000_000_000_000


def kept_by(rows, gap):
    """(component, event) of the events kept, by one pass over each component's events in order."""
    out, last = set(), {}
    for c, t, i in sorted(rows):
        if c not in last or t - last[c] > gap:
            last[c] = t
            out.add((c, i))
    return out


def streamed(spark, tmp_path, parts, fold):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "component_id string, t long, event_id long").select("component_id", F.timestamp_micros("t").alias("ts"), "event_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={k:03d}"))
    with folds.rocks(spark):
        stream = event_stream(spark, str(tmp_path / "in" / "part=*"), 2)
        return drained(fold(stream))


def test_debounce_of_events_out_of_order(spark, tmp_path):
    rng = random.Random(3)
    rows, t = [], START
    for i in range(400):
        t += rng.choice([0, 1, 20, 59, 60, 61, 400]) * 1_000_000
        rows.append((f"c{rng.randint(0, 2)}", t, i))
    parts = [rows[k : k + 80] for k in range(0, 400, 80)]
    for part in parts:
        rng.shuffle(part)
    end = [(f"c{k}", t + 10_000_000_000, 1000 + k) for k in range(3)]
    got = streamed(spark, tmp_path, [*parts, end, [("last", t + 20_000_000_000, 2000)]], lambda s: folds.debounced(s, 60, "10 minutes"))
    expected = {x for x in kept_by(rows, 60_000_000) if x[1] < 1000}
    assert {(r.component_id, r.event_id) for r in got.collect() if r.event_id < 1000} == expected


def test_debounce_of_a_busy_component(spark, tmp_path):
    """An event each minute: one endless session for the fold over lists, a few events of state here."""
    rows = [("busy", START + k * 50_000_000, k) for k in range(30_000)]
    parts = [rows[k : k + 7500] for k in range(0, 30_000, 7500)]
    got = streamed(spark, tmp_path, [*parts, [("busy", START + 10**13, 10**6)]], lambda s: folds.debounced(s, 60, "1 hour"))
    assert {r.event_id for r in got.collect()} - {10**6} == set(range(0, 30_000, 2))
    batch = runtime.debounced(spark.createDataFrame(rows, "component_id string, t long, event_id long").select("component_id", F.timestamp_micros("t").alias("ts"), "event_id"))
    assert {r.event_id for r in batch.collect()} == set(range(0, 30_000, 2))


class Store:
    """State of one key that counts the calls to it."""

    def __init__(self):
        self.calls, self.held, self.map, self.timers = 0, {}, {}, []

    def getValueState(self, name, schema):
        return Value(self, name)

    def getMapState(self, name, keys, values):
        return Entries(self)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return (START + 10**13) // 1000


class Value:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def exists(self):
        self.store.calls += 1
        return self.name in self.store.held

    def get(self):
        self.store.calls += 1
        return self.store.held[self.name]

    def update(self, value):
        self.store.calls += 1
        self.store.held[self.name] = value

    def clear(self):
        self.store.calls += 1
        self.store.held.pop(self.name, None)


class Entries:
    def __init__(self, store):
        self.store = store

    def containsKey(self, key):
        self.store.calls += 1
        return key in self.store.map

    def getValue(self, key):
        self.store.calls += 1
        return self.store.map[key]

    def updateValue(self, key, value):
        self.store.calls += 1
        self.store.map[key] = value

    def removeKey(self, key):
        self.store.calls += 1
        del self.store.map[key]

    def iterator(self):
        yield from list(self.store.map.items())


def test_events_wait_without_a_call_of_the_store_for_each():
    """Ten thousand events, twice the same id among them: a few calls for each batch, and the same events in the same order."""
    rng = random.Random(5)
    rows = [(START + rng.randint(0, 10**12), i, "x") for i in range(10_000)] + [(START, 0, "x"), (START, 0, "x")]
    rng.shuffle(rows)
    store, seen = Store(), []

    def step(held, t, i, kind):
        seen.append((t, i, kind))
        return (t, 0), True

    fold = folds.OrderedFold(step, None)
    fold.init(store)
    batches = [pd.DataFrame(rows[k : k + 5000], columns=["t", "id", "kind"]) for k in range(0, len(rows), 5000)]
    list(fold.handleInputRows(("k",), iter(batches), store))
    put = [x for x in fold.handleExpiredTimer(("k",), store, None) if len(x)]
    assert seen == sorted(rows) and sum(len(x) for x in put) == len(rows)
    assert store.calls < 60 and not store.map


def test_arrivals_in_more_files_than_a_trigger_takes(spark):
    """Where a stretch of time is in more files than a trigger, the watermark must not pass what is left of it."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        for name in ("w11_timed_debounce", "x7_timed_escalations"):
            assert_same(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLE_SQL[name])
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
