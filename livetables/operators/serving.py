"""Lookups on behalf of a caller: visibility first, an audit row always."""

from __future__ import annotations

import datetime as dt
import threading
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livetables.operators.governance import SUPER_ROLES, append_audit
from livetables.operators.lookup import InvalidQuery, NotVisible, Result, fetch, resolve
from livetables.operators.tables import KeyedTable, LogTable

AUDIT_SCHEMA = ("at timestamp_ntz, principal string, roles string, channel string, topic string, query string, outcome string, "
                "row_count long, duration_ms long, error string")
TIMEOUT_SECONDS = 5  # fixed value: how long a lookup may run


class LookupTimeout(TimeoutError):
    """The lookup ran too long and was cancelled."""


@dataclass(frozen=True)
class Caller:
    name: str
    roles: Sequence[str] = ()


def visible_name(requested: str, names: Sequence[str], grants: DataFrame, caller: Caller) -> str:
    """The table a caller means, among those it may see. Only names that could match are checked."""
    candidates = [n for n in names if n.lower() == requested.lower()]
    if candidates and not set(caller.roles) & set(SUPER_ROLES):
        allowed = grants.filter(F.col("role").isin(list(caller.roles)) & F.col("topic").isin(candidates)).select("topic").distinct()
        candidates = [r["topic"] for r in allowed.collect()]
    found = resolve(requested, candidates)
    if found is None:
        raise NotVisible(f"no table {requested} that {caller.name} may read")
    return found


def fetch_within(spark: SparkSession, seconds: float, df: DataFrame | None, *args, **query) -> Result:
    """``fetch``, cancelled after some seconds."""
    group, late = f"lookup-{uuid.uuid4().hex}", threading.Event()

    def cancel() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, cancel)
    spark.sparkContext.setJobGroup(group, "lookup", interruptOnCancel=True)
    timer.start()
    try:
        return fetch(df, *args, **query)
    except Exception as e:
        if late.is_set():
            raise LookupTimeout(f"cancelled after {seconds} s: filter on key columns") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


class AuditSink:
    """Audit rows of many lookups, appended together: every ``seconds``, or as soon as ``most`` wait.

    Rows wait in order until an append has succeeded; one that fails is tried again with the next, so none is lost while the sink lives. ``close``
    appends what is left, and raises if it cannot. Use it as a context.
    """

    def __init__(self, spark: SparkSession, path: str, seconds: float = 1.0, most: int = 10_000):
        self.spark, self.path, self.seconds, self.most = spark, path, seconds, most
        self.last_error: Exception | None = None
        self._rows: list[tuple] = []
        self._held, self._appending, self._closed = threading.Lock(), threading.Lock(), threading.Event()
        self._full = threading.Event()
        self._thread = threading.Thread(target=self._run, name="audit", daemon=True)
        self._thread.start()

    def record(self, row: tuple) -> None:
        if self._closed.is_set():
            raise RuntimeError("the audit sink is closed")
        with self._held:
            self._rows.append(row)
            full = len(self._rows) >= self.most
        if full:
            self._full.set()

    def flush(self) -> None:
        """Append the rows that wait now."""
        with self._appending:
            with self._held:
                rows = self._rows[:]
            if rows:
                append_audit(self.spark.createDataFrame(rows, AUDIT_SCHEMA).coalesce(1), self.path)
                with self._held:
                    del self._rows[:len(rows)]

    def _run(self) -> None:
        while not self._closed.is_set():
            self._full.wait(self.seconds)
            self._full.clear()
            try:
                self.flush()
                self.last_error = None
            except Exception as e:      # kept, and tried again
                self.last_error = e
                self._closed.wait(self.seconds)

    def close(self) -> None:
        self._closed.set()
        self._full.set()
        self._thread.join()
        self.flush()

    def __enter__(self) -> AuditSink:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def rows_for(table: DataFrame | KeyedTable | LogTable | None, name: str, where: tuple | None = None, alias: str | None = None) -> DataFrame | None:
    """What a lookup reads: of a keyed table the buckets of the keys its condition names."""
    if isinstance(table, KeyedTable):
        return table.matching(where, table=name, alias=alias)
    return table.read() if isinstance(table, LogTable) else table


def _outcome(error: Exception | None) -> str:
    if error is None:
        return "OK"
    return "DENIED" if isinstance(error, NotVisible) else "INVALID" if isinstance(error, InvalidQuery) else "ERROR"


def serve(spark: SparkSession, caller: Caller, requested: str, tables: Mapping[str, DataFrame | KeyedTable | LogTable | None], grants: DataFrame,
          audit: str | AuditSink, channel: str = "REST", freshness: Mapping[str, dict] | None = None,
          timeout: float = TIMEOUT_SECONDS, **query) -> Result:
    """Run a lookup for a caller and record it, also when it fails. A table without data answers with a note.

    ``audit`` is a sink, or the path to which each row is appended at once.
    """
    started, error, topic, result = time.monotonic(), None, None, None
    try:
        topic = visible_name(requested, list(tables), grants, caller)
        rows = rows_for(tables[topic], topic, query.get("where"), query.get("alias"))
        result = fetch_within(spark, timeout, rows, (freshness or {}).get(topic), table=topic, **query)
        return result
    except Exception as e:
        error = e
        raise
    finally:
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        row = (now, caller.name, ",".join(caller.roles), channel, topic, repr({"table": requested, **query}), _outcome(error),
               None if result is None else result.row_count, int((time.monotonic() - started) * 1000), None if error is None else str(error))
        if isinstance(audit, AuditSink):
            audit.record(row)
        else:
            append_audit(spark.createDataFrame([row], AUDIT_SCHEMA), audit)
