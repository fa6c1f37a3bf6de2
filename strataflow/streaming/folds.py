"""Ordered folds as keyed state with timers: what batch gives by a fold over a component's sorted events, in bounded memory.

Events wait in state until the watermark has passed them, so they are folded in the order of their time however they arrive; a timer fires for the
earliest that waits. State is what lies within the watermark's delay, and one small fold state, which is dropped when time
has made it irrelevant. No list of a component's history is ever held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strataflow.functions.session import ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_EVENTS = pa.schema([("t", pa.int64()), ("id", pa.int64()), ("kind", pa.string())])
#: rows of a chunk that is made of what was left of others
_CHUNK_ROWS = 10_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """State with timers needs the RocksDB store; a query keeps the one that it was started with."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class OrderedFold(StatefulProcessor):
    """Folds the events (at, t, id, kind) of a key in the order of t and id.

    step(state, t, id, kind) gives the next state and whether the event is put out; state is a pair of integers, or None at the
    beginning. keep is how long a state matters after its last event, in microseconds (None: for ever); a state older than that is dropped.
    Events wait in chunks, one row of state for each batch of Arrow that brought them, so that an event costs no call of the store.
    """

    def __init__(self, step: Callable, keep: int | None) -> None:
        self.step, self.keep = step, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "a long, b long, t long")
        self.waiting = handle.getMapState("waiting", "chunk long", "first long, events binary")
        self.next = handle.getValueState("next", "chunk long")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            if len(part):
                first = self._wait(pa.Table.from_pandas(part[["t", "id", "kind"]], _EVENTS, preserve_index=False))
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake(earliest // 1000 + 1)
        yield pd.DataFrame()

    def _wait(self, events: pa.Table) -> int:
        """Keeps events as a chunk; gives the time of the earliest."""
        chunk = self.next.get()[0] if self.next.exists() else 0
        self.next.update((chunk + 1,))
        first, sink = pc.min(events.column("t")).as_py(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _EVENTS) as out:
            out.write_table(events)
        self.waiting.updateValue((chunk,), (first, sink.getvalue().to_pybytes()))
        return first

    def _wake(self, at: int) -> None:
        """Sees to it that a timer fires at `at` (milliseconds) or before."""
        held = self.timer.get()[0] if self.timer.exists() else None
        if held is None or at < held:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def _due(self, passed: int) -> tuple[pa.Table, int | None]:
        """The events before the watermark in their order, which no longer wait, and the time of the earliest that does."""
        due, rest, later, read = [], [], None, []
        for (chunk,), (first, events) in self.waiting.iterator():
            if first // 1000 >= passed:
                later = first if later is None else min(later, first)
                continue
            own = pa.ipc.open_stream(bytes(events)).read_all()
            ready = pc.less(own.column("t"), passed * 1000)
            due.append(own.filter(ready))
            rest.append(own.filter(pc.invert(ready)))
            read.append(chunk)
        for chunk in read:
            self.waiting.removeKey((chunk,))
        # what is left of the chunks becomes chunks again, as few as there are rows for
        left = pa.concat_tables([_EVENTS.empty_table(), *rest])
        for at in range(0, left.num_rows, _CHUNK_ROWS):
            first = self._wait(left.slice(at, _CHUNK_ROWS))
            later = first if later is None else min(later, first)
        return pa.concat_tables([_EVENTS.empty_table(), *due]).sort_by([("t", "ascending"), ("id", "ascending")]), later

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        due, later = self._due(passed)
        held, last = (self.state.get()[:2], self.state.get()[2]) if self.state.exists() else (None, None)
        out = []
        for batch in due.to_batches(_CHUNK_ROWS):
            for t, i, kind in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held is not None and self.keep is not None and t - last > self.keep:
                    held = None
                held, put = self.step(held, t, i, kind)
                last = t
                if put:
                    out.append((t, i))
        if held is None:
            self.state.clear()
        elif self.keep is not None and last + self.keep < passed * 1000 and later is None:
            self.state.clear()  # no later event can depend on it
        elif due.num_rows:
            self.state.update((int(held[0]), int(held[1]), int(last)))
        if later is not None:
            self._wake(later // 1000 + 1)
        elif self.state.exists() and self.keep is not None:
            self._wake((last + self.keep) // 1000 + 1)
        yield pd.DataFrame({**{f"k{n}": [v] * len(out) for n, v in enumerate(key)}, "t": [x[0] for x in out], "id": [x[1] for x in out]}) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def folded(events: DataFrame, keys: list[str], at: str, event_id: str, kind: str, step: Callable, keep: int | None, late: str) -> DataFrame:
    """(keys.., t, event_id) of the events that a fold puts out, as they become certain; start the query within `rocks`.

    An event comes out when the watermark, `late` behind the newest event, has passed it; events that come later than that are dropped.
    """
    ship(events.sparkSession)
    time = F.col(at).cast("timestamp")
    own = events.select(*[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)], time.alias("at"), F.unix_micros(time).alias("t"), F.col(event_id).cast("long").alias("id"), F.col(kind).cast("string").alias("kind"))
    schema = ", ".join([*(f"k{n} {own.schema[f'k{n}'].dataType.simpleString()}" for n in range(len(keys))), "t long", "id long"])
    put = own.withWatermark("at", late).groupBy(*[f"k{n}" for n in range(len(keys))]).transformWithStateInPandas(OrderedFold(step, keep), schema, "Append", "EventTime")
    return put.select(*[F.col(f"k{n}").alias(k) for n, k in enumerate(keys)], "t", F.col("id").alias(event_id))


def debounced(events: DataFrame, seconds: int = 60, late: str = "1 hour") -> DataFrame:
    """Events (component_id, ts, event_id) more than `seconds` after the last one kept of their component."""
    gap = seconds * 1_000_000

    def step(held, t, _, kind):
        return ((t, 0), True) if held is None or t - held[0] > gap else (held, False)

    return folded(events.withColumn("kind", F.lit("")), ["component_id"], "ts", "event_id", "kind", step, gap, late)


_RANK = {"RESOLVED": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}


def escalations(incidents: DataFrame, days: int = 14, late: str = "1 day") -> DataFrame:
    """Incidents (entity_id, incident_type, severity, id, created_at) that take the lock of their entity and type."""
    span = days * 86_400_000_000

    def step(held, t, _, severity):
        rank = _RANK[severity]
        if rank == 0:
            return None, False
        if held is None or t - held[0] > span or rank > held[1]:
            return (t, rank), True
        return held, False

    return folded(incidents, ["entity_id", "incident_type"], "created_at", "id", "severity", step, None, late)
