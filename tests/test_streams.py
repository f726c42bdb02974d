"""Bounded batches, supervised writes, and windows over quiet topics."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from livetables.operators import tables
from livetables.operators.layout import LayoutError
from livetables.operators.store import CommitConflict, TableStore
from livetables.operators.tables import KeyedTable, LogTable
from livetables.session import workdir
from livetables.sources.topics import TopicSpec, read_log, write_log
from livetables.streaming import streams
from livetables.streaming.windows import ClosingWindows
from tests.conftest import rows

T = dt.datetime(2026, 1, 1)


def records(spark, n, partitions=2, first=0):
    i = F.col("id") + first
    return spark.range(n).select((i % 7).alias("k"), i.alias("v"), (i % partitions).cast("int").alias("_partition"), (i * 1000).alias("_offset"),
                                 (F.lit(T) + F.make_dt_interval(F.lit(0), F.lit(0), i.cast("int"))).cast("timestamp_ntz").alias("_timestamp"))


def test_a_large_file_commits_in_pieces(spark, store):
    path = workdir(spark, "log")
    write_log(records(spark, 100, 3).coalesce(1), path)
    log = lambda: read_log(spark, path, TopicSpec(), streaming=True, schema=records(spark, 1).schema)
    table, history = KeyedTable(store, "t", ["k"]), LogTable(store, "h")
    streams.stream_upsert(log(), table, workdir(spark, "cp"), every=None, most=10).awaitTermination()
    streams.stream_append(log(), history, workdir(spark, "cp"), every=None, most=40).awaitTermination()
    commits = store.snapshot()["commit"]
    assert 12 + 3 <= commits <= 13 + 4
    assert rows(table.read(), "k", "v") == [(k, max(v for v in range(100) if v % 7 == k)) for k in range(7)] and history.read().count() == 100
    streams.stream_upsert(log(), table, workdir(spark, "cp"), every=None, most=10).awaitTermination()      # its checkpoint is lost
    assert store.snapshot()["commit"] == commits


def test_pieces_are_bounded_and_ordered(spark):
    seen = []
    n = streams.in_pieces(records(spark, 50, 3), lambda b: seen.append(rows(b, "_partition", "_offset")), 7)
    assert n == len(seen) and all(len(s) <= 7 for s in seen) and {x for s in seen for x in s} == set(rows(records(spark, 50, 3), "_partition", "_offset"))
    assert sum(map(len, seen)) == 50
    for p in range(3):
        offsets = [sorted(o for q, o in s if q == p) for s in seen]
        assert [o for s in offsets for o in s] == sorted(o for s in offsets for o in s)
    assert streams.in_pieces(records(spark, 5), lambda b: None, 5) == 1
    with pytest.raises(ValueError):
        streams.in_pieces(records(spark, 50, 9), lambda b: None, 8)


class Broken(KeyedTable):
    """Fails a number of times."""
    left = 0

    def merge(self, changes):
        if self.left:
            self.left -= 1
            raise OSError("no connection")
        return super().merge(changes)


def test_a_write_is_tried_again_with_growing_pauses(spark, store):
    pauses, table = [], Broken(store, "t", ["k"])
    table.left = 3
    assert streams.Supervisor(sleep=pauses.append).run(table, records(spark, 10))
    assert pauses == [1.0, 2.0, 4.0] and table.status() == "ACTIVE" and table.read().count() == 7


def test_a_failed_table_does_not_stop_the_others(spark, store):
    good, bad, pauses = KeyedTable(store, "good", ["k"]), Broken(store, "bad.t", ["k"]), []
    bad.left = 4
    path = workdir(spark, "log")
    log = lambda: read_log(spark, path, TopicSpec(), streaming=True, schema=records(spark, 1).withColumn("topic", F.lit("")).schema)
    cp = workdir(spark, "cp")
    watch = streams.Supervisor(sleep=pauses.append)
    for first in (0, 20):
        batch = records(spark, 20, first=first)
        write_log(batch.withColumn("topic", F.lit("good")).unionByName(batch.withColumn("topic", F.lit("bad"))), path)
        streams.stream_tables(log(), {"bad": bad, "good": good}, cp, every=None, supervisor=watch).awaitTermination()
    assert pauses == [1.0, 2.0, 4.0]
    assert bad.status() == "FAILED" and "no connection" in bad.failure() and good.status() == "ACTIVE"
    want = [(k, max(v for v in range(40) if v % 7 == k)) for k in range(7)]
    assert rows(good.read(), "k", "v") == want and bad.read() is None
    streams.catch_up(bad, records(spark, 40))
    assert bad.status() == "ACTIVE" and rows(bad.read(), "k", "v") == want


def test_what_no_attempt_mends_is_not_tried_again(spark, store):
    pauses, table = [], KeyedTable(store, "t", ["k"])
    table.merge(records(spark, 5))
    watch = streams.Supervisor(sleep=pauses.append)
    assert not watch.run(table, records(spark, 20, first=20).withColumn("v", F.lit("text")))
    assert not pauses and table.status() == "FAILED" and LayoutError.__name__ in table.failure()
    assert not watch.run(table, records(spark, 20, first=20)) and table.read().count() == 5
    table.resume()
    assert watch.run(table, records(spark, 20, first=20)) and table.read().count() == 7
    with pytest.raises(streams.TableFailed):
        streams.supervised(table, watch)(records(spark, 9, first=50).withColumn("v", F.lit(True)))


def test_a_quiet_topic_holds_windows_back_only_until_it_is_idle(spark, store):
    now = [0.0]
    windows = ClosingWindows(store, "w", "10 minutes", ["a", "b"], idle=30, clock=lambda: now[0])
    at = lambda *minutes, start=0: spark.createDataFrame([(0, start + i, T + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)], "_partition int, _offset long, _timestamp timestamp_ntz")
    closed = lambda: [(int((s - T).total_seconds() // 60), n) for s, n, c in rows(windows.read()) if c]
    windows.refresh({"a": at(1, 2, 25)})
    assert closed() == [] and windows.watermark() is None          # b may still send
    now[0] = 31
    windows.refresh({"a": at(26, start=3)})
    assert closed() == [(0, 2)] and windows.watermark() == T + dt.timedelta(minutes=26) - dt.timedelta(milliseconds=180)
    windows.refresh({"a": at(26, start=3), "b": at(3, 22)})           # a's record again; b is back: one record late, one not
    assert closed() == [(0, 2)] and windows.late() == 1 and windows.watermark() == T + dt.timedelta(minutes=26) - dt.timedelta(milliseconds=180)
    windows.refresh({"a": at(55, start=4)})
    before = windows.watermark()
    windows.refresh({"b": at(30, 45, start=2)})
    assert windows.watermark() == max(before, T + dt.timedelta(minutes=45) - dt.timedelta(milliseconds=180))
    now[0] = 100
    windows.refresh({})
    assert windows.watermark() >= before                                # all quiet: it stays
    want = {0: 2, 20: 3, 30: 1, 40: 1, 50: 1}
    assert closed() == [(0, 2), (20, 3), (30, 1)]
    assert {int((s - T).total_seconds() // 60): n for s, n, _ in rows(windows.read())} == want
    again = ClosingWindows(TableStore(spark, store.root), "w", "10 minutes", ["a", "b"], idle=30, clock=lambda: now[0])
    again.refresh({"a": at(1, 2, 25, 26, 55), "b": at(3, 22, 30, 45)})      # everything once more
    assert {int((s - T).total_seconds() // 60): n for s, n, _ in rows(again.read())} == want and again.late() == 1


def test_pieces_of_a_keyed_table_are_written_together(spark, store):
    """Every commit has its piece and no more, but the jobs do not grow with their number."""
    path = workdir(spark, "log")
    log = records(spark, 1500, 3).withColumn("k", F.col("v") % 40).withColumn("_deleted", F.col("v") % 11 == 0)
    write_log(log.coalesce(1), path)
    table = KeyedTable(store, "t", ["k"])
    query = streams.stream_upsert(read_log(spark, path, TopicSpec(), streaming=True, schema=log.schema), table, workdir(spark, "cp"), every=None, most=10)
    query.awaitTermination()
    assert store.snapshot()["commit"] == 167 and len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(query.runId))) < 100
    before, listed = {}, rows(log, "v", "k", "_partition", "_offset", "_deleted")
    for c in range(1, 168):
        snapshot = store.snapshot(c)
        offsets = table.offsets(snapshot)
        new = [r for r in listed if before.get(str(r[2]), 0) <= r[3] < offsets.get(str(r[2]), 0)]
        assert 0 < len(new) <= 10 and all(len(layers) <= 8 for layers in table.state(snapshot)["files"].values())
        before = offsets
        if c in (1, 2, 33, 64, 65, 100, 128, 166, 167):
            last = {r[1]: r for r in sorted(r for r in listed if r[3] < offsets.get(str(r[2]), 0))}
            assert rows(table.read(snapshot), "k", "v") == sorted(((k, r[0]) for k, r in last.items() if not r[4]), key=repr)
    assert sum(before.values()) == sum(1 + max(r[3] for r in listed if r[2] == p) for p in range(3))


def test_a_commit_does_not_list_the_manifests(spark, store):
    table, other = KeyedTable(store, "t", ["k"]), TableStore(spark, store.root)
    table.merge(records(spark, 5))
    store.versions = None      # a listing grows with every commit
    for i in range(1, 4):
        table.merge(records(spark, 5, first=5 * i))
    assert store.newest() == 4 and other.newest() == 4
    KeyedTable(other, "u", ["k"]).merge(records(spark, 5))
    assert store.newest() == 5
    del store.versions
    table.merge(records(spark, 5, first=50))
    assert other.vacuum(keep=1, grace_seconds=-1) is not None and store.versions() == [6] and store.newest() == other.newest() == 6


def local(path):
    return path.removeprefix("file:")


def last_values(listed, offsets):
    """Keys and values of (v, k, partition, offset, deleted) records below some offsets."""
    last = {r[1]: r for r in sorted(r for r in listed if r[3] < offsets.get(str(r[2]), 0))}
    return sorted(((k, r[0]) for k, r in last.items() if not r[4]), key=repr)


def test_the_files_of_a_large_batch_do_not_grow_with_its_commits(spark, store):
    log = records(spark, 1500, 3).withColumn("k", F.col("v") % 40)
    table = KeyedTable(store, "t", ["k"])
    assert table.merge_pieces(log, 10) == 167 and store.snapshot()["commit"] == 167
    assert len([f for f in os.listdir(local(store.data_path("t"))) if f.startswith("_v=")]) <= 4
    assert len(os.listdir(local(f"{store.root}/_manifest"))) == 167        # one file a commit
    assert rows(table.read(), "k", "v") == sorted(((v % 40, v) for v in range(1460, 1500)), key=repr)


@pytest.mark.parametrize("fold_bytes", [0, 1 << 40])
def test_a_group_of_pieces_that_breaks_off_goes_on(spark, store, monkeypatch, fold_bytes):
    """A state shows the pieces it has reached and no more, to every kind of read, also where other batches follow on it."""
    monkeypatch.setattr(tables, "GROUP_PIECES", 16)
    log = records(spark, 400, 2).withColumn("k", F.when(F.col("v") != 5, F.col("v") % 30)).withColumn("_deleted", F.col("v") % 7 == 0)
    listed = rows(log.filter("k IS NOT NULL"), "v", "k", "_partition", "_offset", "_deleted")
    table, commit = KeyedTable(store, "t", ["k"], buckets=3, fold_bytes=fold_bytes), store.commit

    def broken(base, changed):
        if base["commit"] == 21:
            raise OSError("no connection")
        return commit(base, changed)

    def check(snapshot=None):
        want = last_values(listed, table.offsets(snapshot))
        some = spark.range(0, 30, 3).withColumnRenamed("id", "k")
        assert rows(table.read(snapshot), "k", "v") == want
        assert rows(table.read_keys(some, snapshot), "k", "v") == [w for w in want if w[0] % 3 == 0]

    store.commit = broken
    with pytest.raises(OSError):
        table.merge_pieces(log, 10)
    del store.commit
    assert store.snapshot()["commit"] == 21
    for c in (1, 2, 16, 17, 18, 20, 21):
        check(store.snapshot(c))
    table.merge(log.filter("v < 222"))
    check()
    assert table.merge_pieces(log, 10) == 18 and store.snapshot()["commit"] == 40 and sum(table.offsets().values()) == 398_000 + 399_000 + 2
    check()
    check(store.snapshot(30))
    table.compact()
    check()
    used = {v for c in range(1, 42) if c <= store.snapshot()["commit"] for layers in table.state(store.snapshot(c))["files"].values() for v in layers}
    left = {f.removeprefix("_v=") for f in os.listdir(local(store.data_path("t")))} - used
    assert len(left) <= 3 and not any(f.startswith("_group") for v in left for f in os.listdir(f"{local(store.data_path('t'))}/_v={v}"))


def test_pieces_lie_on_top_of_layers_joined_before_them(spark, store):
    table = KeyedTable(store, "t", ["k"], buckets=2, fold_bytes=1 << 40)
    for i in range(8):
        table.merge(records(spark, 7, first=7 * i))
    assert {len(layers) for layers in table.state()["files"].values()} == {8}
    assert table.merge_pieces(records(spark, 200, first=56).filter("v < 63 OR k = 0"), 10) > 1
    assert rows(table.read(), "k", "v") == [(0, 252), *[(k, 56 + k) for k in range(1, 7)]]


@pytest.mark.parametrize("links", [True, False])
def test_a_commit_is_put_in_place_once(spark, store, monkeypatch, links):
    """By a link, or where the file system has none by a rename; a number that is taken is a conflict."""
    if not links:
        def link(source, target):
            raise PermissionError("no links here")
        monkeypatch.setattr(os, "link", link)
    first = store.commit(store.snapshot(), {"t": {"files": {}}})
    other = TableStore(spark, store.root)
    for s in (store, other):
        with pytest.raises(CommitConflict):
            s._put(1, b"{}")
    assert other.commit(first, {"u": {"files": {}}})["commit"] == 2 and store.snapshot(1) == first
    assert sorted(store.commit(first, {"v": {"files": {}}})["tables"]) == ["t", "u", "v"] and store.versions() == [1, 2, 3]
    with pytest.raises(CommitConflict):
        store.commit(store.snapshot(1) | {"tables": {}}, {"t": None})
    assert not [f for f in os.listdir(local(f"{store.root}/_manifest")) if f.startswith("_")]
