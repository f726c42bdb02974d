"""Windows over several topics that close by event time, although some of the topics are quiet.

The watermark of a topic is its newest event time less the disorder every table declares. Windows close by the least watermark of the topics - but a topic that
has sent nothing for ``idle`` seconds of processing time is left out, so that a quiet one does not hold the windows of the others back. When it
sends again it counts again; the watermark never goes back, and records of windows that have closed are late: they are counted and left out.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livetables.operators.layout import Layout
from livetables.operators.store import TableStore
from livetables.operators.tables import KeyedTable, _Table
from livetables.session import discard, materialize

DELAY = dt.timedelta(milliseconds=180)      # fixed value: bounded disorder every table declares
IDLE = 60.0                                 # seconds


class ClosingWindows:
    """Records per event-time window of several topics: ``open`` windows, still counting, and ``closed`` ones, which never change.

    Counts, closed windows, the offsets of every topic and the watermark commit together, so a replayed batch changes nothing.
    """

    def __init__(self, store: TableStore, name: str, width: str, topics: Sequence[str], idle: float = IDLE, delay: dt.timedelta = DELAY, clock: Callable[[], float] = time.time):
        self.store, self.name, self.width, self.idle, self.delay, self.clock = store, name, width, idle, delay, clock
        self.open = KeyedTable(store, f"{name}.open", ["window_start"])
        self.closed = KeyedTable(store, f"{name}.closed", ["window_start"])
        self.topics = {t: _Table(store, f"{name}.topic.{t}") for t in topics}

    def watermark(self, snapshot: dict | None = None) -> dt.datetime | None:
        value = self._own(snapshot or self.store.snapshot())["watermark"]
        return dt.datetime.fromisoformat(value) if value else None

    def late(self) -> int:
        """Records that came after their window had closed."""
        return self._own(self.store.snapshot())["late"]

    def _own(self, snapshot: dict) -> dict:
        return snapshot["tables"].get(self.name) or {"mode": "clock", "layout": Layout().to_json(), "files": {}, "watermark": None, "late": 0}

    def _advanced(self, states: dict[str, dict], now: float, before: str | None) -> str | None:
        """The watermark after the topics have come to these states."""
        active = [s for s in states.values() if now - s["seen"] <= self.idle]
        if not active or any(s.get("last_record_ts") is None for s in active):
            return before                     # all quiet, or a topic has yet to send its first record and is not given up
        least = min(dt.datetime.fromisoformat(s["last_record_ts"]) for s in active) - self.delay
        return max(filter(None, (before, least.isoformat(timespec="microseconds"))))

    def refresh(self, batches: Mapping[str, DataFrame | None]) -> dict:
        """Take in the new records of the topics and close what their watermarks allow. Call it also when nothing has come: time passes for quiet topics."""
        base, now = self.store.snapshot(), self.clock()
        states, fresh = {}, []
        for topic, table in self.topics.items():
            state = table.state(base) or {"mode": "topic", "layout": Layout().to_json(), "files": {}, "seen": now}
            batch = batches.get(topic)
            staged = None if batch is None else table._stage(batch, base, lambda rows: rows)
            if staged is not None:
                state = {**table._progressed(state, staged.offsets, staged.record_ts), "seen": now}
                fresh.append(staged.changes.select("_timestamp"))
            states[topic] = state
        own = self._own(base)
        before, mark = own["watermark"], self._advanced(states, now, own["watermark"])
        end = F.col("window_start") + F.expr(f"INTERVAL {self.width}")
        passed = lambda m: (end <= F.lit(m).cast("timestamp_ntz")) if m else F.lit(False)
        start = F.window(F.col("_timestamp").cast("timestamp_ntz"), self.width)["start"].alias("window_start")
        counted = [r.groupBy(start).agg(F.count(F.lit(1)).alias("n")).withColumn("new", F.lit(True)) for r in fresh]
        stored = self.open.read(base)
        parts = counted + ([] if stored is None else [stored.withColumn("new", F.lit(False))])
        tables = {**{self.topics[t].name: s for t, s in states.items()}, self.name: {**own, "watermark": mark}}
        if not parts:
            return self.store.commit(base, tables)
        late = passed(before) & F.col("new")
        windows = reduce(DataFrame.unionByName, parts).groupBy("window_start").agg(
            F.sum(F.when(~late, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(late, F.col("n")).otherwise(0)).alias("late"), F.bool_or("new").alias("new"))
        windows = materialize(windows, "windows")
        tables[self.name]["late"] += windows.agg(F.sum("late")).first()[0] or 0
        counts = windows.filter("n > 0").withColumn("_deleted", passed(mark)).filter("new OR _deleted")
        tables[self.open.name] = self.open.write(counts.select("window_start", "n", "_deleted"), base)
        tables[self.closed.name] = self.closed.write(counts.filter("_deleted").select("window_start", "n", F.lit(False).alias("_deleted")), base)
        done = self.store.commit(base, tables)
        discard(self.store.spark, windows._written_to)
        return done

    def read(self) -> DataFrame | None:
        """window_start, n, and whether the window has closed."""
        snapshot = self.store.snapshot()
        parts = [(self.open.read(snapshot), False), (self.closed.read(snapshot), True)]
        found = [df.select("window_start", "n", F.lit(flag).alias("closed")) for df, flag in parts if df is not None]
        return reduce(DataFrame.unionByName, found) if found else None
