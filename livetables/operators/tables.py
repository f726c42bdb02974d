"""Keyed tables and log tables on a ``TableStore``.

A keyed table is split by key hash into buckets. A merge writes the changed rows as one more layer
of the buckets they touch; a bucket whose layers have grown is folded into a fresh base in the same
commit. So a batch costs what it changes, not what the table holds, and a read resolves at most a
few layers.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from copy import deepcopy
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from livetables.operators import changelog
from livetables.operators.lookup import Scope
from livetables.operators.pruning import keys_reached
from livetables.operators.layout import (APPEND, UPSERT, Layout, LayoutError, conform, infer_mode,
                                         merge_layout)
from livetables.operators.store import TableStore
from livetables.session import discard, materialize, workdir

DEFAULT_BUCKETS = 6  # fixed value: partitions of a topic declared without a bucket count
MAX_LAYERS = 8           # a read resolves at most this many layers
FOLD_RATIO = 0.25        # layers of a bucket that hold this share of its base are folded,
FOLD_BYTES = 32 << 20    # if they are worth a rewrite,
FOLD_WORK = 8            # at most this many times the bytes of the batch in one commit
FEW_BUCKETS = 16         # a batch of keys touches them all
GROUP_PIECES = 512       # so many pieces of a batch are one version: a commit shows those that it has reached
FILE_ROWS = 2000         # rows dealt out by key are written as they lie where each task has so many for every bucket,
FILE_BYTES = 64 << 10    # or so many bytes of the buckets that are folded
JOIN_VERSIONS = 8        # so many small versions of a log become one
NO_BASE = ""
GUARD_COLUMNS = ("_partition", "_offset")
BUCKET = StructField("_bucket", IntegerType())
VERSION = StructField("_v", StringType())
DELETED = StructField("_deleted", BooleanType())
PIECE = StructField("_piece", IntegerType())


def bucket_of(columns: Sequence[str | Column], n: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in columns]), F.lit(n)).cast("int")


def piece_sizes(batch: DataFrame, most: int) -> tuple[Column, int]:
    """The number, from 0, of the piece of at most ``most`` records that a record belongs to, and how many pieces there are.

    Each partition of the topic gives a piece the same number of consecutive records, so offsets only grow from piece to piece.
    """
    counts = {r["_partition"]: r["n"] for r in batch.groupBy("_partition").agg(F.count("*").alias("n")).collect()}
    if sum(counts.values()) <= most:
        return F.lit(0).cast("long"), min(1, len(counts))
    if len(counts) > most:
        raise ValueError(f"{len(counts)} partitions do not go into pieces of {most} records")
    share = most // len(counts)
    place = F.row_number().over(Window.partitionBy("_partition").orderBy("_offset"))
    return F.floor((place - 1) / share), -(-max(counts.values()) // share)


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat(timespec="microseconds")


def _greatest(a: str | None, b: str | None) -> str | None:
    return max(filter(None, (a, b)), default=None)


@dataclass
class Staged:
    """A batch that is not committed yet: its changes and how far it read."""
    changes: DataFrame              # with ``_bucket``, if they are to be written as they are dealt out
    offsets: dict[str, int]
    record_ts: str | None
    records: int | None = None      # fresh ones, where offsets tell


@dataclass
class Layer:
    """Changes that are written as a version of a keyed table, and not committed yet."""
    version: str
    layout: Layout
    state: dict                     # of the table with this version on top
    counts: dict[str, int]          # its bytes by bucket
    old: StructField | None = None  # the committed rows that its changes replace, where it holds them too


class _Table:
    def __init__(self, store: TableStore, name: str):
        self.store, self.name, self.spark = store, name, store.spark

    def state(self, snapshot: dict | None = None) -> dict | None:
        return (snapshot or self.store.snapshot())["tables"].get(self.name)

    def status(self) -> str:
        """``FAILED`` until ``resume``, else whether data has arrived."""
        if self.store.mark(self.name) is not None:
            return "FAILED"
        state = self.state()
        return "WAITING_FOR_DATA" if state is None or not state["files"] else "ACTIVE"

    def failure(self) -> str | None:
        """Why the table is ``FAILED``."""
        return self.store.mark(self.name)

    def resume(self) -> None:
        """Take part again after a failure. The next batch starts at the table's own offsets."""
        self.store.set_mark(self.name, None)

    def offsets(self, snapshot: dict | None = None) -> dict[str, int]:
        return (self.state(snapshot) or {}).get("offsets", {})

    def progress(self) -> DataFrame:
        """Committed offsets and times: one row per topic partition."""
        state = self.state() or {}
        rows = [(self.name, int(p), n, state.get("last_record_ts"), state.get("last_ingested_at"))
                for p, n in state.get("offsets", {}).items()]
        return (self.spark.createDataFrame(rows, "topic string, _partition int, next_offset long, last_record_ts string, last_ingested_at string")
                .withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_record_ts", "last_ingested_at")}))

    def guard(self, batch: DataFrame, snapshot: dict) -> DataFrame:
        if not set(GUARD_COLUMNS) <= set(batch.columns):
            return batch
        return changelog.offset_guard(batch, self.offsets(snapshot))

    def _stage(self, batch: DataFrame, snapshot: dict, reduced) -> Staged | None:
        """Skip what is committed, reduce the rest, note offsets and the newest time.

        Offsets and time come from all fresh records, three columns of them, whatever the size of the
        batch: the last record of a partition need not be the last of its key.
        """
        fresh = self.guard(batch, snapshot)
        newest = self._newest(batch)
        if not set(GUARD_COLUMNS) <= set(batch.columns):
            return Staged(reduced(fresh), {}, None)
        ends = fresh.groupBy("_partition").agg((F.max("_offset") + 1).alias("next_offset"), newest.alias("ts"), F.count("*").alias("n")).collect()
        if not ends:
            return None
        ts = max((r["ts"] for r in ends if r["ts"]), default=None)
        offsets = {str(r["_partition"]): r["next_offset"] for r in ends}
        return Staged(reduced(fresh), offsets, ts.isoformat(timespec="microseconds") if ts else None, sum(r["n"] for r in ends))

    @staticmethod
    def _newest(batch: DataFrame) -> Column:
        return F.max(F.col("_timestamp").cast("timestamp_ntz")) if "_timestamp" in batch.columns else F.lit(None).cast("timestamp_ntz")

    def drop(self) -> None:
        self.store.commit(self.store.snapshot(), {self.name: None})

    def _progressed(self, state: dict, offsets: dict[str, int], record_ts: str | None) -> dict:
        merged = dict(state.get("offsets", {}))
        for p, n in offsets.items():
            merged[p] = max(merged.get(p, 0), n)
        return {**state, "offsets": merged, "last_record_ts": _greatest(state.get("last_record_ts"), record_ts),
                "last_ingested_at": _now()}

    def _scan(self, schema: StructType, paths: Iterable[str]) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", self.store.data_path(self.name)).parquet(*paths)


class KeyedTable(_Table):
    """Upsert table: one row per key.

    ``bucket_by`` may name some of the key columns, so that rows read together lie together.
    """

    def __init__(self, store: TableStore, name: str, keys: Sequence[str], buckets: int = DEFAULT_BUCKETS,
                 bucket_by: Sequence[str] | None = None, order: Sequence[str] = changelog.WITHIN_PARTITION,
                 fold_bytes: int = FOLD_BYTES):
        super().__init__(store, name)
        infer_mode(keys, compacted=True)
        self.keys, self.default_buckets, self.order = list(keys), buckets, list(order)
        self.bucket_by = list(bucket_by or keys)
        self.fold_bytes = fold_bytes

    # ---- reading

    def layout(self, snapshot: dict | None = None) -> Layout:
        state = self.state(snapshot)
        return Layout.from_json(state["layout"]) if state else Layout(tuple(self.keys))

    def read(self, snapshot: dict | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """Current rows, of all buckets or some; None while no record has arrived."""
        state = self.state(snapshot)
        if state is None:
            return None
        wanted = state["files"] if buckets is None else {str(b): state["files"][str(b)] for b in buckets if str(b) in state["files"]}
        return self._resolve(state, wanted)

    def _paths(self, state: dict, files: dict[str, list[str]]) -> list[str]:
        """Folders to read: the whole version where all its buckets are wanted, else one per bucket."""
        wanted: dict[str, list[str]] = {}
        for b, versions in files.items():
            for v in versions:
                if v != NO_BASE:
                    wanted.setdefault(v, []).append(b)
        root = self.store.data_path(self.name)
        paths = []
        for v, buckets in wanted.items():
            whole = len(buckets) == state["written"].get(v)
            paths += [f"{root}/_v={v}"] if whole else [f"{root}/_v={v}/_bucket={b}" for b in buckets]
        return paths

    def _resolve(self, state: dict, files: dict[str, list[str]], probe: DataFrame | None = None,
                 on: Sequence[str] = ()) -> DataFrame:
        """The last version of every row.

        A whole read keeps the base where it lies: base rows no layer touches, plus the layered rows.
        With a probe (some key columns) few rows remain, so base and layers are one scan, filtered
        first and then ranked.
        """
        layout = Layout.from_json(state["layout"])
        columns = layout.schema.names
        base = self._paths(state, {b: layers[:1] for b, layers in files.items()})
        layered = self._paths(state, {b: layers[1:] for b, layers in files.items()})
        if not base and not layered:
            return self.spark.createDataFrame([], layout.schema)
        if probe is not None:
            rows = self._changes(state, base + layered).join(probe, list(on), "left_semi")
            if layered:
                rows = self._last(state, rows).filter("_deleted IS NULL OR NOT _deleted")
            return rows.select(*columns)
        base_rows = self._scan(StructType([*layout.schema, BUCKET]), base).select(*columns) if base else None
        if not layered:
            return base_rows
        changes = self._last(state, self._changes(state, layered))
        live = changes.filter("NOT _deleted").select(*columns)
        if base_rows is None:
            return live
        return base_rows.join(changes.select(*self.keys), self.keys, "left_anti").select(*columns).unionByName(live)

    def _changes(self, state: dict, paths: Iterable[str]) -> DataFrame:
        """The rows of versions, tombstones included. Of a version of several pieces those that the state has reached."""
        pieces = state.get("pieces", {})
        rows = self._scan(StructType([*Layout.from_json(state["layout"]).schema, *([PIECE] if pieces else []), DELETED, BUCKET, VERSION]), paths)
        for version, n in pieces.items():
            rows = rows.filter((F.col("_v") != version) | (F.col("_piece") < n))
        return rows

    def _last(self, state: dict, changes: DataFrame) -> DataFrame:
        """The newest row of every key."""
        return changelog.last_change(changes, self.keys, ["_v", "_piece"] if state.get("pieces") else ["_v"])

    def get(self, *key) -> DataFrame | None:
        """Point lookup: reads the one bucket the key hashes to."""
        snapshot = self.store.snapshot()
        state = self.state(snapshot)
        if state is None:
            return None
        schema = Layout.from_json(state["layout"]).schema
        value = dict(zip(self.keys, key, strict=True))
        rows = self.read(snapshot, self._buckets_of(state, [tuple(value[k] for k in state["bucket_by"])]))
        return rows.filter(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v).cast(schema[k].dataType) for k, v in value.items()]))

    def _buckets_of(self, state: dict, keys: Sequence[tuple]) -> list[int]:
        """The buckets of some values of the ``bucket_by`` columns. The relation is local and the values are constants, so no job runs."""
        schema = Layout.from_json(state["layout"]).schema
        hashed = lambda key: bucket_of([F.lit(v).cast(schema[c].dataType) for c, v in zip(state["bucket_by"], key)], state["buckets"])
        one = self.spark.sql("SELECT * FROM VALUES (0) AS t(x)")
        return sorted(set(one.select(F.array(*map(hashed, keys))).collect()[0][0])) if keys else []

    def matching(self, where: tuple | None, snapshot: dict | None = None, table: str = "", alias: str | None = None) -> DataFrame | None:
        """The rows among which those that meet a lookup condition are: of the buckets of the keys it names, or all rows if it leaves the keys open."""
        snapshot = snapshot or self.store.snapshot()
        state = self.state(snapshot)
        if state is None:
            return None
        scope = Scope(Layout.from_json(state["layout"]).schema, table or self.name, alias)
        keys = keys_reached(where, scope, state["bucket_by"])
        return self.read(snapshot, None if keys is None else self._buckets_of(state, keys))

    def read_keys(self, keys_df: DataFrame, snapshot: dict | None = None, on: Sequence[str] | None = None) -> DataFrame | None:
        """Rows of many keys: only their buckets are read, then a semi-join. ``on`` defaults to the key
        columns and may be any columns that include ``bucket_by``."""
        state = self.state(snapshot)
        if state is None:
            return None
        on = list(on or self.keys)
        typed = Layout.from_json(state["layout"]).schema
        probe = keys_df.select(*[F.col(k).cast(typed[k].dataType).alias(k) for k in on])
        files = state["files"]
        if state["buckets"] > FEW_BUCKETS:
            touched = probe.select(bucket_of(state["bucket_by"], state["buckets"]).alias("b")).distinct().collect()
            files = {str(r["b"]): files[str(r["b"])] for r in touched if str(r["b"]) in files}
        return self._resolve(state, files, probe, on)

    # ---- writing

    def collapse(self, changes: DataFrame, bucket: Column | None = None) -> DataFrame:
        """The last change per key, tombstones flagged; with a bucket, those that have a key."""
        if "_deleted" not in changes.columns:
            changes = changes.withColumn("_deleted", F.lit(False))
        if bucket is not None:
            changes = changelog.drop_null_keys(changes, self.keys)
        if set(self.order) <= set(changes.columns):
            changes = changelog.last_change(changes, self.keys, self.order)
        return changes if bucket is None else changes.withColumn("_bucket", bucket)

    def stage(self, batch: DataFrame, snapshot: dict) -> Staged | None:
        """The uncommitted changes of a batch; None if there are none."""
        staged = self._stage(batch, snapshot, lambda fresh: fresh)
        if staged is not None:
            large = staged.records is not None and set(self.order) <= set(batch.columns) and self.wide(staged.records, snapshot)
            staged.changes = self.collapse(staged.changes, self.bucket(snapshot) if large else None)
        return staged

    def bucket(self, snapshot: dict) -> Column:
        state = self.state(snapshot) or {"bucket_by": self.bucket_by, "buckets": self.default_buckets}
        return bucket_of(state["bucket_by"], state["buckets"])

    def wide(self, records: int, snapshot: dict) -> bool:
        """Whether so many records are written as a shuffle by key leaves them: each of its tasks has a
        good share of every bucket, so they are spared one more shuffle by bucket."""
        buckets = (self.state(snapshot) or {"buckets": self.default_buckets})["buckets"]
        return buckets <= FEW_BUCKETS and records >= FILE_ROWS * self._most_files(buckets)

    def _most_files(self, buckets: int) -> int:
        """Of a version whose rows are written as a shuffle leaves them."""
        return buckets * int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def with_old(self, staged: Staged, snapshot: dict, columns: Sequence[str]) -> DataFrame:
        """Changes next to some columns of the committed rows they replace (``_old``), where it takes no more shuffles
        than the rows themselves: the changes are dealt out by key, and not few beside the table."""
        changes, state = staged.changes, self.state(snapshot)
        if state is None or "_bucket" not in changes.columns:
            return changes
        layout = Layout.from_json(state["layout"]).schema
        if not set(columns) <= set(layout.names) or any(changes.schema[k].dataType != layout[k].dataType for k in self.keys):
            return changes
        paths = self._paths(state, {b: layers[:1] for b, layers in state["files"].items()})
        if not paths or staged.records / FOLD_RATIO < self._scan(StructType([BUCKET]), paths).count():      # from the files' footers
            return changes
        old = F.struct(*[F.col(c).cast(changes.schema[c].dataType).alias(c) for c in columns])
        return changes.join(self.read(snapshot).select(*self.keys, old.alias("_old")), self.keys, "left")

    def merge(self, changes: DataFrame) -> dict:
        """Merge one batch and commit it. Replaying a committed batch changes nothing."""
        snapshot = self.store.snapshot()
        state = self.apply(changes, snapshot)
        return snapshot if state is None else self.store.commit(snapshot, {self.name: state})

    def merge_pieces(self, batch: DataFrame, most: int) -> int:
        """Merge a large batch in commits of at most ``most`` records each, in the order of their offsets; returns how many there were.

        The result of every commit is that of ``merge`` on its piece. But all pieces are written by one job, ``GROUP_PIECES`` of them as one version, so a commit costs its manifest,
        whatever the number of pieces. What is committed already is skipped, so the batch may come again after an error.
        """
        snapshot, done = self.store.snapshot(), 0
        fresh = self.guard(batch, snapshot)
        piece, n = piece_sizes(fresh, most)
        if n <= 1:
            self.merge(batch)
            return 1
        rows = materialize(fresh.withColumn("_piece", piece), "pieces")
        ends = workdir(self.spark, "ends")
        staged = f"{self.store.data_path(self.name)}/_v={self.store.new_version(snapshot)}"      # of no commit, so a vacuum takes what is left of it
        try:
            if self.state(snapshot) is None:          # its layout, and the first base
                snapshot, done = self.store.commit(snapshot, {self.name: self.apply(rows.filter("_piece = 0").drop("_piece"), snapshot)}), 1
            layout = self._write_pieces(rows.filter(F.col("_piece") >= done).withColumn("_piece", F.col("_piece") - done), snapshot, staged, ends)
            for first in range(0, n - done, GROUP_PIECES):
                snapshot = self._commit_pieces(snapshot, layout, min(GROUP_PIECES, n - done - first), f"{staged}/_group={first // GROUP_PIECES}", f"{ends}/_group={first // GROUP_PIECES}")
        finally:
            discard(self.spark, rows._written_to, ends, staged)
        return n

    def _write_pieces(self, rows: DataFrame, snapshot: dict, staged: str, ends: str) -> Layout:
        """Write the last change of every key in each piece, by group of pieces and bucket, and how far each piece reads. Both number the pieces of a group from 0."""
        state = self.state(snapshot)
        number = rows["_piece"]
        rows = rows.withColumns({"_group": F.floor(number / GROUP_PIECES).cast("int"), "_piece": F.pmod(number, F.lit(GROUP_PIECES)).cast("int")})
        (rows.groupBy("_group", "_piece", F.col("_partition").cast("long").alias("_partition")).agg((F.max("_offset") + 1).cast("long").alias("next_offset"), self._newest(rows).alias("ts"))
         .hint("rebalance", "_group").write.partitionBy("_group").parquet(ends))
        if "_deleted" not in rows.columns:
            rows = rows.withColumn("_deleted", F.lit(False))
        layout = merge_layout(Layout.from_json(state["layout"]), self._incoming_layout(rows.drop("_piece", "_group")))
        # one shuffle: the ranks, and the files, need no other
        placed = changelog.drop_null_keys(rows, self.keys).withColumn("_bucket", bucket_of(state["bucket_by"], state["buckets"])).repartition("_group", "_bucket")
        order = self.order if set(self.order) <= set(rows.columns) else ["_piece"]
        last = changelog.last_change(placed, ["_group", "_bucket", "_piece", *self.keys], order)
        conform(last, StructType([*layout.schema, PIECE, DELETED, StructField("_group", IntegerType()), BUCKET])).write.partitionBy("_group", "_bucket").parquet(staged)
        return layout

    def _commit_pieces(self, snapshot: dict, layout: Layout, n: int, staged: str, ends: str) -> dict:
        """Commit the pieces of a group one by one. Their rows are one layer, of which each state shows the pieces up to its own; the last state has it without what later pieces replace."""
        reached: dict[int, list] = {}
        for r in self.spark.read.schema("_piece int, _partition long, next_offset long, ts timestamp_ntz").parquet(ends).collect():
            reached.setdefault(r["_piece"], []).append(r)
        state = {**deepcopy(self.state(snapshot)), "layout": layout.to_json()}
        self._shallow(state, snapshot)
        version = self.store.new_version(snapshot, last=True)
        counts = self._bucket_bytes(f"{self.store.data_path(self.name)}/_v={version}") if self.store.adopt(self.name, staged, version) else {}
        for b, count in counts.items():
            if b not in state["files"]:
                state["files"][b], state["bytes"][b] = [NO_BASE], [0]
            state["files"][b].append(version)
            state["bytes"][b].append(count)
        state["written"][version] = len(counts)
        others = state.get("pieces", {})
        for p in range(1, n + 1):
            mine = reached.get(p - 1, [])
            times = [r["ts"] for r in mine if r["ts"]]
            state = self._progressed({**state, "pieces": {**others, version: p}}, {str(r["_partition"]): r["next_offset"] for r in mine},
                                     max(times).isoformat(timespec="microseconds") if times else None)
            if p == n:
                state = deepcopy(state)
                grown = self._grown(state["bytes"], counts)
                if grown:
                    self._fold(state, grown, snapshot)
                self._shallow(state, snapshot)
                for depth in {len(layers) for layers in state["files"].values() if layers[-1] == version and n > 1}:
                    self._join_layers(state, {b for b, layers in state["files"].items() if layers[-1] == version and len(layers) == depth}, snapshot, depth - 1)
            self._tidy(state)
            snapshot = self.store.commit(snapshot, {self.name: state})
        return snapshot

    def _shallow(self, state: dict, snapshot: dict) -> None:
        """Join layers where a bucket has no room for one more."""
        deep = {b for b, layers in state["files"].items() if len(layers) >= MAX_LAYERS}
        if deep:
            self._join_layers(state, deep, snapshot)

    def apply(self, changes: DataFrame, snapshot: dict, definition: str | None = None) -> dict | None:
        """Write one batch and return the table state to commit; None if there is nothing new."""
        staged = self.stage(changes, snapshot)
        if staged is None:
            return None
        return self.write(staged.changes, snapshot, staged.offsets, staged.record_ts, definition)

    def write(self, collapsed: DataFrame, snapshot: dict, offsets: dict[str, int] | None = None,
              record_ts: str | None = None, definition: str | None = None, unique: bool = False) -> dict:
        """Write collapsed changes and return the state to commit. ``unique`` makes a repeated key an error."""
        state = self.settle(self.add_layer(collapsed, snapshot, unique), snapshot, offsets, record_ts)
        if definition is not None:
            state["definition"] = definition
        return state

    def add_layer(self, collapsed: DataFrame, snapshot: dict, unique: bool = False) -> Layer:
        """Write collapsed changes as one version."""
        state = self.state(snapshot)
        incoming = self._incoming_layout(collapsed)
        if state is None:
            state = {"mode": UPSERT, "bucket_by": self.bucket_by, "buckets": self.default_buckets, "files": {}, "bytes": {}, "written": {}}
            layout = incoming
        else:
            layout = merge_layout(Layout.from_json(state["layout"]), incoming)
        dealt = "_bucket" in collapsed.columns
        # rows without a key are dropped, not failed
        keyed = collapsed if dealt else changelog.drop_null_keys(collapsed, self.keys).withColumn("_bucket", bucket_of(state["bucket_by"], state["buckets"]))
        old = keyed.schema["_old"] if "_old" in keyed.columns else None
        rows = conform(keyed, StructType([*layout.schema, *([old] if old else []), DELETED, BUCKET]))
        state = {**state, "layout": layout.to_json(), "files": {b: list(v) for b, v in state["files"].items()},
                 "bytes": {b: list(v) for b, v in state["bytes"].items()}, "written": dict(state["written"])}
        files, sizes = state["files"], state["bytes"]
        first = not files
        version = self.store.new_version(snapshot)
        counts = self._write_version(rows.filter("NOT _deleted").drop("_deleted") if first else rows, version, dealt)
        if unique and counts:
            self._check_unique(layout, version)
        state["written"][version] = len(counts)
        for b, count in counts.items():
            if b not in files:
                files[b], sizes[b] = ([], []) if first else ([NO_BASE], [0])
            files[b].append(version)
            sizes[b].append(count)
        return Layer(version, layout, state, counts, old)

    def layer_rows(self, layer: Layer) -> DataFrame:
        """The changes of a layer, read back: those that have a key. A first one has no tombstones, as there is nothing to delete."""
        old = [layer.old] if layer.old else []
        schema = StructType([*layer.layout.schema, *old, DELETED])
        if not layer.counts:
            return self.spark.createDataFrame([], schema)
        rows = self._scan(StructType([*schema, BUCKET]), [f"{self.store.data_path(self.name)}/_v={layer.version}"])
        return rows.select(*layer.layout.schema.names, *[f.name for f in old], F.coalesce("_deleted", F.lit(False)).alias("_deleted"))

    def settle(self, layer: Layer, snapshot: dict, offsets: dict[str, int] | None = None, record_ts: str | None = None) -> dict:
        """The state to commit with a written layer on top: buckets whose layers have grown are folded, many layers joined."""
        state, counts = layer.state, layer.counts
        grown = self._grown(state["bytes"], counts)
        deep = {b for b in counts if len(state["files"][b]) > MAX_LAYERS} - grown
        if grown:
            self._fold(state, grown, snapshot)
        if deep:
            self._join_layers(state, deep, snapshot)
        self._tidy(state)
        return self._progressed(state, offsets or {}, record_ts)

    def _grown(self, sizes: dict[str, list[int]], counts: dict[str, int]) -> set[str]:
        """Buckets to fold now: their layers are large for their base, the largest share first. The work of
        a commit is bounded by its batch, so folding a large table is spread over many commits; the
        bound exceeds what a batch adds on average, so that folding keeps up."""
        layers = {b: sum(sizes[b][1:]) for b in counts if sum(sizes[b][1:]) >= FOLD_RATIO * sizes[b][0] and len(sizes[b]) > 1}
        if sum(layers.values()) < self.fold_bytes:
            return set()
        budget = max(self.fold_bytes, FOLD_WORK * sum(counts.values()))
        chosen: set[str] = set()
        for b in sorted(layers, key=lambda b: layers[b] / (sizes[b][0] or 1), reverse=True):
            budget -= sum(sizes[b])
            if chosen and budget < 0:
                break
            chosen.add(b)
        return chosen

    def compact(self) -> dict:
        """Fold every layered bucket."""
        snapshot = self.store.snapshot()
        state = deepcopy(self.state(snapshot))
        layered = {b for b, v in state["files"].items() if len(v) > 1}
        if not layered:
            return snapshot
        self._fold(state, layered, snapshot)
        self._tidy(state)
        return self.store.commit(snapshot, {self.name: state})

    def _fold(self, state: dict, buckets: set[str], snapshot: dict) -> None:
        """Rewrite the base of buckets with their layers applied."""
        files = {b: state["files"][b] for b in buckets}
        size = sum(sum(state["bytes"][b]) for b in buckets)
        large = state["buckets"] <= FEW_BUCKETS and size >= FILE_BYTES * self._most_files(state["buckets"])
        dealt = self._folded(state, files) if large else None
        rows = self._resolve(state, files) if dealt is None else dealt
        self._rewrite(state, buckets, rows, snapshot, 0, dealt is not None)

    def _folded(self, state: dict, files: dict[str, list[str]]) -> DataFrame | None:
        """The rows of ``_resolve`` with their bucket, dealt out by key: base and changes meet in one join. None where there is nothing to join."""
        schema = Layout.from_json(state["layout"]).schema
        base = self._paths(state, {b: layers[:1] for b, layers in files.items()})
        layered = self._paths(state, {b: layers[1:] for b, layers in files.items()})
        values = [c for c in schema.names if c not in self.keys]
        if not base or not layered or not values:
            return None
        changes = self._changes(state, layered)
        if any(len(layers) > 2 or layers[-1] in state.get("pieces", {}) for layers in files.values()):       # else the keys of the one layer are unique
            changes = self._last(state, changes)
        changes = changes.select(*self.keys, F.struct(*values).alias("_new"), F.coalesce("_deleted", F.lit(True)).alias("_gone"))
        old = self._scan(schema, base).select(*self.keys, F.struct(*values).alias("_old"))
        rows = old.join(changes, self.keys, "full_outer").filter("_gone IS NULL OR NOT _gone")
        rows = rows.select(*self.keys, *[F.when(F.col("_gone").isNull(), F.col("_old")[c]).otherwise(F.col("_new")[c]).alias(c) for c in values])
        return rows.select(*schema.names, bucket_of(state["bucket_by"], state["buckets"]).alias("_bucket"))

    def _join_layers(self, state: dict, buckets: set[str], snapshot: dict, first: int = 1) -> None:
        """Merge the layers of buckets, or those from ``first`` on, into one, tombstones included; a large base stays as it is."""
        paths = self._paths(state, {b: state["files"][b][first:] for b in buckets})
        rows = self._last(state, self._changes(state, paths)).drop("_v", "_piece")
        self._rewrite(state, buckets, rows, snapshot, first)

    def _rewrite(self, state: dict, buckets: set[str], rows: DataFrame, snapshot: dict, kept: int, dealt: bool = False) -> None:
        """Put rows in place of the versions of buckets, but for the first ``kept``."""
        version = self.store.new_version(snapshot)
        counts = self._write_version(rows if dealt else rows.withColumn("_bucket", bucket_of(state["bucket_by"], state["buckets"])), version, dealt)
        state["written"][version] = len(counts)
        for b in buckets:
            new, size = ([version], [counts[b]]) if b in counts else ([], [])
            state["files"][b], state["bytes"][b] = state["files"][b][:kept] + new, state["bytes"][b][:kept] + size
            if not any(v != NO_BASE for v in state["files"][b]):
                del state["files"][b], state["bytes"][b]

    @staticmethod
    def _tidy(state: dict) -> None:
        used = {v for layers in state["files"].values() for v in layers}
        state["written"] = {v: n for v, n in state["written"].items() if v in used}
        pieces = {v: n for v, n in state.pop("pieces", {}).items() if v in used}
        if pieces:
            state["pieces"] = pieces

    def _check_unique(self, layout: Layout, version: str) -> None:
        rows = self._scan(StructType([*[layout.schema[k] for k in self.keys], BUCKET]), [f"{self.store.data_path(self.name)}/_v={version}"])
        if not rows.groupBy(*self.keys).count().filter("count > 1").isEmpty():
            raise LayoutError(f"{self.name}: several rows for one key")

    def _write_version(self, rows: DataFrame, version: str, dealt: bool = False) -> dict[str, int]:
        """One file set per bucket, sorted by key. REBALANCE lets the engine size the tasks from the
        real bytes: small buckets share one, a bucket with a third of the rows is split over many.
        Rows that are dealt out by key, and come in its order, are written where they are; the engine
        sorts them by bucket only."""
        path = f"{self.store.data_path(self.name)}/_v={version}"
        if not dealt:
            rows = rows.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *self.keys)
        rows.write.partitionBy("_bucket").parquet(path)
        return self._bucket_bytes(path)

    def _bucket_bytes(self, path: str) -> dict[str, int]:
        """Bytes per bucket of a version just written: from the file system for a few buckets, else by a job."""
        few = self.store.folder_bytes(path, "_bucket=", 16 * FEW_BUCKETS)
        if few is not None:
            return few
        written = self.spark.read.schema(StructType([BUCKET])).parquet(path)
        files = written.select("_bucket", "_metadata.file_path", "_metadata.file_size").distinct()
        return {str(r["_bucket"]): r["bytes"] for r in files.groupBy("_bucket").agg(F.sum("file_size").alias("bytes")).collect()}

    def _incoming_layout(self, df: DataFrame) -> Layout:
        hidden = {"_deleted", "_bucket", "_old", *GUARD_COLUMNS}
        missing = [k for k in self.keys if k not in df.columns]
        if missing:
            raise LayoutError(f"key columns {missing} are not in the data")
        fields = {f.name: f for f in df.schema if f.name not in hidden}
        ordered = [fields[k] for k in self.keys] + [f for name, f in fields.items() if name not in self.keys]
        return Layout(tuple(self.keys), StructType([StructField(f.name, f.dataType, True, f.metadata) for f in ordered]))


class LogTable(_Table):
    """Append table: every record once, identified by (partition, offset). With ``deletes``, deletions are records too, marked ``_deleted``."""

    def __init__(self, store: TableStore, name: str, deletes: bool = False):
        super().__init__(store, name)
        self.deletes = deletes

    def read(self, snapshot: dict | None = None) -> DataFrame | None:
        state = self.state(snapshot)
        if state is None:
            return None
        schema = Layout.from_json(state["layout"]).schema
        paths = [f"{self.store.data_path(self.name)}/_v={v}" for v in state["files"].get("0", [])]
        return self._scan(schema, paths).select(*schema.names) if paths else self.spark.createDataFrame([], schema)

    def append(self, batch: DataFrame) -> dict:
        snapshot = self.store.snapshot()
        state = self.apply(batch, snapshot)
        return snapshot if state is None else self.store.commit(snapshot, {self.name: state})

    def apply(self, batch: DataFrame, snapshot: dict) -> dict | None:
        staged = self._stage(batch, snapshot, lambda fresh: fresh)
        if staged is None:
            return None
        fresh = staged.changes
        twice = fresh.groupBy("_partition", "_offset").count().filter("count > 1")
        # a repeated record is rare: look for one on two columns before sorting whole rows
        if not twice.isEmpty():
            fresh = changelog.distinct_records(fresh)
        if "_deleted" in fresh.columns and not self.deletes:
            fresh = fresh.filter("NOT _deleted").drop("_deleted")
        incoming = Layout((), StructType([StructField(f.name, f.dataType, True, f.metadata) for f in fresh.schema]))
        state = self.state(snapshot)
        if state is None:
            state, layout = {"mode": APPEND, "files": {"0": []}, "sizes": []}, incoming
        else:
            layout = merge_layout(Layout.from_json(state["layout"]), incoming)
        version = self.store.new_version(snapshot)
        path = f"{self.store.data_path(self.name)}/_v={version}"
        conform(fresh, layout.schema).write.parquet(path)
        versions, sizes = [*state["files"].get("0", []), version], [*state.get("sizes", []), self.store.bytes_of(path)]
        state = {**state, "layout": layout.to_json(), "files": {"0": versions}, "sizes": sizes}
        first = _small_tail(sizes, JOIN_VERSIONS)
        return self._progressed(state if first is None else self._joined(state, first, snapshot), staged.offsets, staged.record_ts)

    def _joined(self, state: dict, first: int, snapshot: dict) -> dict:
        """The state with the versions from ``first`` on as one."""
        schema = Layout.from_json(state["layout"]).schema
        versions, root = state["files"]["0"], self.store.data_path(self.name)
        version = self.store.new_version(snapshot)
        tail = self._scan(schema, [f"{root}/_v={v}" for v in versions[first:]])
        tail.select(*schema.names).hint("rebalance").write.parquet(f"{root}/_v={version}")
        return {**state, "files": {"0": [*versions[:first], version]}, "sizes": [*state["sizes"][:first], self.store.bytes_of(f"{root}/_v={version}")]}

    def compact(self) -> dict:
        """Rewrite all versions as one. An append joins the newest small ones by itself."""
        snapshot = self.store.snapshot()
        state = self.state(snapshot)
        if state is None or len(state["files"].get("0", [])) < 2:
            return snapshot
        return self.store.commit(snapshot, {self.name: self._joined(state, 0, snapshot)})


def _small_tail(sizes: Sequence[int], least: int) -> int | None:
    """Where the newest versions begin that are worth joining: ``least`` of them or more, none larger than all newer ones together.

    A row is rewritten only with about as many bytes of newer rows, so a log of n commits has some ``least`` * log(n) versions, and each row is rewritten log(n) times.
    """
    total, first = 0, len(sizes)
    while first > 0 and (total == 0 or sizes[first - 1] <= total):
        first -= 1
        total += sizes[first]
    return first if len(sizes) - first >= least else None


def open_table(store: TableStore, name: str, keys: Sequence[str] = (), mode: str | None = None, compacted: bool = False,
               buckets: int = DEFAULT_BUCKETS) -> KeyedTable | LogTable:
    """The table of a topic, in the given mode or the one its compaction implies."""
    chosen = infer_mode(keys, compacted, mode)
    return KeyedTable(store, name, keys, buckets) if chosen == UPSERT else LogTable(store, name)


def set_mode(store: TableStore, name: str, mode: str, log: DataFrame, keys: Sequence[str] = (),
             buckets: int = DEFAULT_BUCKETS) -> KeyedTable | LogTable:
    """Switch a table between append and upsert: data is dropped and the log replayed from the start.

    The new state replaces the old in one commit. The mode it already has keeps the data.
    """
    table = open_table(store, name, keys, mode, buckets=buckets)
    snapshot = store.snapshot()
    state = snapshot["tables"].get(name)
    if state is not None and state["mode"] == mode:
        return table
    empty = {**snapshot, "tables": {k: v for k, v in snapshot["tables"].items() if k != name}}
    rebuilt = table.apply(log, empty)
    store.commit(snapshot, {name: rebuilt})
    return table
