"""Continuous versions of the table writes."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from livetables.operators.layout import LayoutError
from livetables.operators.tables import KeyedTable, LogTable, piece_sizes
from livetables.session import discard, workdir
from livetables.sources.topics import with_event_time
from livetables.sources.wire import WireFormatError

BATCH_WAIT = "100 milliseconds"   # fixed value: longest wait before a serving batch commits
BATCH_RECORDS = 2000              # fixed value: most records of a serving batch
LAKE_INTERVAL = "10 seconds"      # fixed value: time between lake commits
ATTEMPTS, PAUSE = 4, 1.0          # fixed values: attempts of a write, and the seconds after the first, doubled each time
FINAL = (LayoutError, WireFormatError, AnalysisException)

logger = logging.getLogger(__name__)

ADAPTIVE = "spark.sql.adaptive.enabled"


def _adaptive(batch: DataFrame, apply: Callable[[DataFrame], object]) -> None:
    """A stream's own session has adaptive execution off. The batch jobs of a merge rely on it: it
    splits hot buckets and joins small partitions."""
    conf = batch.sparkSession.conf
    before = conf.get(ADAPTIVE)
    conf.set(ADAPTIVE, "true")
    try:
        apply(batch)
    finally:
        conf.set(ADAPTIVE, before)


def in_pieces(batch: DataFrame, apply: Callable[[DataFrame], object], most: int) -> int:
    """``apply`` on pieces of at most ``most`` records, in the order of their offsets; returns how many there were.

    For sources that cannot bound a batch themselves, such as one large file. Offsets only grow from piece to piece, so a restart skips the pieces that are committed.
    The batch is written once, by piece, and each piece read once. A keyed table takes its pieces by ``merge_pieces``, which writes many of them by one job.
    """
    piece, pieces = piece_sizes(batch, most)
    if pieces <= 1:
        apply(batch)
        return 1
    path = workdir(batch.sparkSession, "pieces")
    batch.withColumn("_piece", piece).write.partitionBy("_piece").parquet(path)
    try:
        for i in range(pieces):
            apply(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/_piece={i}"))
    finally:
        discard(batch.sparkSession, path)
    return pieces


class TableFailed(RuntimeError):
    """A table was set aside after its write had failed."""


class Supervisor:
    """Runs writes of tables: a write that fails is tried again after growing pauses; after the last attempt its table is ``FAILED`` and the others go on.

    What no attempt can mend (a layout, a payload) is not tried again. A table that is set aside takes no batch until ``resume``; its offsets tell
    where it stopped, so that ``catch_up`` brings it what it missed.
    """

    def __init__(self, attempts: int = ATTEMPTS, pause: float = PAUSE, sleep: Callable[[float], object] = time.sleep):
        self.attempts, self.pause, self.sleep = attempts, pause, sleep

    def run(self, table: KeyedTable | LogTable, batch: DataFrame, most: int | None = None) -> bool:
        """Write a batch to a table, a keyed one in commits of at most ``most`` records; False if the table is, or now becomes, ``FAILED``."""
        if table.failure() is not None:
            return False
        write = table.append if isinstance(table, LogTable) else table.merge if most is None else lambda b: table.merge_pieces(b, most)
        for attempt in range(1, self.attempts + 1):
            try:
                write(batch)
                return True
            except Exception as e:
                if attempt == self.attempts or isinstance(e, FINAL):
                    logger.error("%s set aside after %d attempts: %s", table.name, attempt, e)
                    table.store.set_mark(table.name, f"{type(e).__name__}: {e}"[:4000])
                    return False
                logger.warning("write of %s failed (attempt %d of %d): %s", table.name, attempt, self.attempts, e)
                self.sleep(self.pause * 2 ** (attempt - 1))


def catch_up(table: KeyedTable | LogTable, log: DataFrame) -> None:
    """Take a ``FAILED`` table in again, and bring it the records of its log that it has not seen."""
    table.resume()
    if not Supervisor().run(table, log):
        raise TableFailed(f"{table.name}: {table.failure()}")


def start(stream: DataFrame, apply: Callable[[DataFrame], object], checkpoint: str, output_mode: str = "append",
          every: str | None = BATCH_WAIT, most: int | None = None) -> StreamingQuery:
    """Run ``apply`` on each micro-batch; ``every=None`` takes what is there and stops. ``most`` bounds the records that are applied at once.

    The batch number is not used: offsets commit with the data, so a replayed batch is skipped
    even when the checkpoint is lost.
    """
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    bounded = apply if most is None else lambda batch: in_pieces(batch, apply, most)
    return (stream.writeStream.outputMode(output_mode).foreachBatch(lambda batch, _: _adaptive(batch, bounded))
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def supervised(table: KeyedTable | LogTable, supervisor: Supervisor | None = None, most: int | None = None) -> Callable[[DataFrame], None]:
    """The write of one table, tried again where it fails; at the end its stream stops, and the table is ``FAILED``."""
    watch = supervisor or Supervisor()

    def apply(batch: DataFrame) -> None:
        if not watch.run(table, batch, most):
            raise TableFailed(f"{table.name}: {table.failure()}")
    return apply


def stream_tables(stream: DataFrame, tables: Mapping[str, KeyedTable | LogTable], checkpoint: str, topic: str = "topic", columns: Mapping[str, Sequence[str]] | None = None,
                  every: str | None = BATCH_WAIT, most: int | None = None, supervisor: Supervisor | None = None) -> StreamingQuery:
    """One stream of several topics, each into its table. A table whose write fails for good is set aside while the others go on."""
    watch = supervisor or Supervisor()

    def apply(batch: DataFrame) -> None:
        for name, table in tables.items():
            mine = batch.filter(F.col(topic) == name)
            watch.run(table, mine.select(*columns[name]) if columns else mine.drop(topic))
    return start(stream, apply, checkpoint, every=every, most=most)


def run_available(stream: DataFrame, apply: Callable[[DataFrame], object], checkpoint: str, output_mode: str = "append") -> None:
    start(stream, apply, checkpoint, output_mode, every=None).awaitTermination()


def stream_upsert(stream: DataFrame, table: KeyedTable, checkpoint: str, every: str | None = BATCH_WAIT, most: int | None = None) -> StreamingQuery:
    return start(stream, supervised(table, most=most), checkpoint, every=every)


def stream_append(stream: DataFrame, table: LogTable, checkpoint: str, every: str | None = BATCH_WAIT, most: int | None = None) -> StreamingQuery:
    return start(stream, supervised(table), checkpoint, every=every, most=most)


def stream_lake_append(stream: DataFrame, table: LogTable, checkpoint: str, every: str | None = LAKE_INTERVAL) -> StreamingQuery:
    """Every version of every key. The table's own offsets skip what it has, also when the checkpoint is lost."""
    return start(stream, table.append, checkpoint, every=every)


def stream_lake_upsert(stream: DataFrame, table: KeyedTable, checkpoint: str, every: str | None = LAKE_INTERVAL) -> StreamingQuery:
    return start(stream, table.merge, checkpoint, every=every)


def windowed_counts(log: DataFrame, width: str) -> DataFrame:
    """Records per event-time window, on the event time every table declares."""
    return (with_event_time(log).groupBy(F.window("_timestamp", width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n"))


def stream_windowed_counts(log: DataFrame, width: str, table: KeyedTable, checkpoint: str, every: str | None = BATCH_WAIT) -> StreamingQuery:
    """Update mode: a window is written again whenever its count moves, also the last open one."""
    return start(windowed_counts(log, width), table.merge, checkpoint, output_mode="update", every=every)
