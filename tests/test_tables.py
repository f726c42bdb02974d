import datetime as dt
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from livetables import fixtures as fx
from livetables.operators import changelog as cl
from livetables.operators.layout import LayoutError
from livetables.operators.lookup import Col, Lit, Scope, condition, scan
from livetables.operators.pruning import keys_reached
from livetables.operators.store import CommitConflict, TableStore
from livetables.operators.tables import KeyedTable, LogTable, _small_tail, open_table, set_mode
from livetables.plans.catalog import create_view, drop_view, refresh_view
from tests.conftest import rows

LOG = "id int, name string, _partition int, _offset long, _timestamp timestamp_ntz, _deleted boolean"
T = dt.datetime(2026, 1, 1)


def log(spark, *records, schema=LOG):
    """(id, name, offset) records of one partition; a name of None is a tombstone."""
    return spark.createDataFrame([(i, n, 0, o, T + dt.timedelta(minutes=o), n is None) for i, n, o in records], schema)


def test_update_and_tombstone(spark, store):
    table = KeyedTable(store, "it.customers", ["id"])
    assert table.read() is None and table.status() == "WAITING_FOR_DATA"
    table.merge(log(spark, (1, "a", 0), (2, "b", 1), (3, "c", 2)))
    table.merge(log(spark, (2, "B", 3), (3, None, 4), (9, None, 5)))
    assert rows(table.read(), "id", "name") == [(1, "a"), (2, "B")]
    assert table.status() == "ACTIVE"
    assert table.offsets() == {"0": 6}


def test_first_record_a_tombstone(spark, store):
    table = KeyedTable(store, "t", ["id"])
    table.merge(log(spark, (1, None, 0)))
    assert table.read().count() == 0 and table.offsets() == {"0": 1}
    table.merge(log(spark, (1, "a", 1)))
    assert rows(table.read(), "id", "name") == [(1, "a")]


def test_replay_changes_nothing(spark, store):
    table = KeyedTable(store, "t", ["id"])
    first, second = log(spark, (1, "a", 0), (2, "b", 1)), log(spark, (1, None, 2), (2, "c", 3))
    table.merge(first)
    table.merge(second)
    commit = store.snapshot()["commit"]
    for replay in (first, second, first.unionByName(second)):
        table.merge(replay)
    assert store.snapshot()["commit"] == commit
    assert rows(table.read(), "id", "name") == [(2, "c")]


def test_progress_keeps_the_newest_record_time(spark, store):
    table = KeyedTable(store, "t", ["id"])
    late = log(spark, (1, "a", 0), (1, "b", 1)).withColumn("_timestamp", F.when(F.col("_offset") == 0, F.lit(T)).otherwise(F.lit(T - dt.timedelta(days=1))).cast("timestamp_ntz"))
    table.merge(late)
    row = table.progress().first()
    assert (row["next_offset"], row["last_record_ts"]) == (2, T)
    table.merge(log(spark, (2, "x", 2)).withColumn("_timestamp", F.lit(T - dt.timedelta(days=9)).cast("timestamp_ntz")))
    assert table.progress().first()["last_record_ts"] == T


def test_null_keys_are_dropped_but_read(spark, store):
    table = KeyedTable(store, "t", ["id"])
    table.merge(log(spark, (1, "a", 0), (None, "x", 1)))
    assert rows(table.read(), "id") == [(1,)] and table.offsets() == {"0": 2}


def test_evolution(spark, store):
    table = KeyedTable(store, "t", ["id"])
    table.merge(log(spark, (1, "a", 0)))
    table.merge(log(spark, (2, "b", 1)).withColumn("tier", F.lit("gold")))
    table.merge(log(spark, (3, "c", 2)).drop("name"))
    assert rows(table.read(), "id", "name", "tier") == [(1, "a", None), (2, "b", "gold"), (3, None, None)]
    commit = store.snapshot()["commit"]
    with pytest.raises(LayoutError):
        table.merge(log(spark, (4, "d", 3)).withColumn("name", F.lit(1)))
    with pytest.raises(LayoutError):
        KeyedTable(store, "t", ["name"]).merge(log(spark, (4, "d", 3)))
    assert store.snapshot()["commit"] == commit


def test_replaced_row_loses_missing_columns(spark, store):
    table = KeyedTable(store, "t", ["id"])
    table.merge(log(spark, (1, "a", 0)).withColumn("tier", F.lit("gold")))
    table.merge(log(spark, (1, "b", 1)))
    assert rows(table.read(), "id", "name", "tier") == [(1, "b", None)]


@pytest.mark.parametrize("fold_bytes", [0, 1 << 40])
def test_layers_and_folds_agree(spark, store, sf, fold_bytes):
    """Many small batches: folded at once or kept as layers up to the limit, the rows are the same."""
    table = KeyedTable(store, "orders", ["order_id"], buckets=4, fold_bytes=fold_bytes)
    full = fx.orders_cdc(spark, sf).drop("op")
    part = F.pmod(F.xxhash64("order_id"), F.lit(3)) + F.floor(F.col("_offset") / fx.OFFSET_STEP) * 3
    pieces = full.withColumn("_piece", part).withColumn("_offset", F.col("_offset") + F.col("_piece") * 10**15).persist()
    depths = []
    for i in range(9):
        table.merge(pieces.filter(F.col("_piece") == i).drop("_piece"))
        depths.append(max(len(v) for v in table.state()["files"].values()))
    want = rows(cl.latest_by_key(full, ["order_id"]), "order_id", "customer_id", "status", "total")
    assert max(depths) <= 4 if fold_bytes == 0 else depths == [1, 2, 3, 4, 5, 6, 7, 8, 2]
    assert rows(table.read(), "order_id", "customer_id", "status", "total") == want
    assert table.read(store.snapshot(8)).count() > 0  # nine layers deep at most, then joined
    some = spark.range(0, 400, 7).select(F.col("id").alias("order_id"))
    wanted = {r[0] for r in some.collect()}
    assert rows(table.read_keys(some), "order_id", "status") == sorted([(w[0], w[2]) for w in want if w[0] in wanted], key=repr)
    table.compact()
    assert max(len(v) for v in table.state()["files"].values()) == 1
    assert rows(table.read(), "order_id", "customer_id", "status", "total") == want
    assert table.get(7).count() == 1 and table.get(10).count() == 0


def test_key_reads_touch_their_buckets_only(spark, store):
    table = KeyedTable(store, "t", ["id"], buckets=64)
    table.merge(spark.range(5000).withColumn("v", F.col("id") * 2))
    one = table.get(42)
    assert rows(one) == [(42, 84)] and len({p.split("_bucket=")[1].split("/")[0] for p in one.inputFiles()}) == 1
    keys = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert len({p.split("_bucket=")[1].split("/")[0] for p in table.read_keys(keys).inputFiles()}) <= 3
    assert rows(table.read_keys(keys)) == [(1, 2), (2, 4), (3, 6)]


def test_two_writers_cannot_commit_the_same_number(spark, store):
    table = KeyedTable(store, "t", ["id"])
    table.merge(log(spark, (1, "a", 0)))
    base = store.snapshot()
    state = table.apply(log(spark, (2, "b", 1)), base)
    table.merge(log(spark, (3, "c", 1)))
    with pytest.raises(CommitConflict):
        store.commit(base, {"t": state})
    assert rows(table.read(), "id") == [(1,), (3,)]


def test_old_snapshots_stay_readable_until_vacuum(spark, store):
    table = KeyedTable(store, "t", ["id"], fold_bytes=0)
    for i in range(4):
        table.merge(log(spark, (1, f"v{i}", i)))
    assert rows(table.read(store.snapshot(2)), "name") == [("v1",)]
    orphan = f"{store.data_path('t')}/_v={store.new_version({'commit': 0})}"
    spark.range(1).write.parquet(orphan)
    at_work = f"{store.data_path('t')}/_v={store.new_version(store.snapshot())}"
    spark.range(1).write.parquet(at_work)
    assert store.vacuum(keep=1, grace_seconds=-1)
    assert rows(table.read(), "name") == [("v3",)]
    assert not os.path.exists(orphan) and os.path.exists(at_work)
    assert store.versions() == [4]


def test_append_ignores_duplicates_and_tombstones(spark, store):
    table = LogTable(store, "it.clicks")
    hundred = spark.range(100).select(F.col("id").alias("visitor"), (F.col("id") % 2).cast("int").alias("_partition"), F.col("id").alias("_offset"),
                                      F.lit(T).cast("timestamp_ntz").alias("_timestamp"), F.lit(False).alias("_deleted"))
    table.append(hundred.unionByName(hundred))
    assert table.read().count() == 100
    more = hundred.withColumns({c: F.col(c) + 100 for c in ("visitor", "_offset")}).filter("visitor < 150")
    table.append(hundred.unionByName(more))
    assert table.read().count() == 150
    table.append(more.limit(1).withColumn("_offset", F.lit(1000).cast("long")).withColumn("_deleted", F.lit(True)))
    assert table.read().count() == 150
    table.compact()
    assert table.read().count() == 150 and len(table.state()["files"]["0"]) == 1


def test_offsets_come_from_all_records_and_replays_restore_nothing(spark, store):
    """Key 1 moves from partition 0 to partition 1, null keys stand last in two partitions; the batches are read from Parquet, as a stream's are."""
    records = [(1, "old", 0, 10), (1, "new", 1, 50), (2, "b", 1, 20), (None, "x", 0, 11), (None, "y", 1, 51)]
    path = f"{store.root}/log"
    spark.createDataFrame([(i, n, p, o, T + dt.timedelta(minutes=o), False) for i, n, p, o in records], LOG).write.parquet(path)
    batch = spark.read.parquet(path)
    table = KeyedTable(store, "moved", ["id"], order=cl.ACROSS_PARTITIONS)
    table.merge(batch)
    assert table.offsets() == {"0": 12, "1": 52}
    assert table.state()["last_record_ts"].startswith((T + dt.timedelta(minutes=51)).isoformat())
    commit = store.snapshot()["commit"]
    table.merge(batch.filter("_partition = 0"))
    assert store.snapshot()["commit"] == commit and rows(table.read(), "id", "name") == [(1, "new"), (2, "b")]


def test_writers_of_different_tables_do_not_conflict(spark, store):
    def write(name):
        table = KeyedTable(TableStore(spark, store.root), name, ["id"])
        for i in range(2):
            table.merge(log(spark, (i, f"{name}{i}", i)))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, ["a", "b", "c", "d"]))
    for name in "abcd":
        assert rows(KeyedTable(store, name, ["id"]).read(), "id", "name") == [(0, f"{name}0"), (1, f"{name}1")]


def test_log_table_may_keep_deletes(spark, store):
    table = LogTable(store, "history", deletes=True)
    table.compact()
    table.append(log(spark, (1, "a", 0), (1, None, 1)))
    assert rows(table.read(), "id", "name", "_deleted") == [(1, "a", False), (1, None, True)]


def test_fold_work_is_bounded_by_the_batch(spark, store):
    table = KeyedTable(store, "t", ["id"], fold_bytes=100)
    sizes = {str(b): [1000, 300] for b in range(10)} | {"10": [1000, 900], "11": [1000, 10]}
    assert table._grown(sizes, {b: 100 for b in sizes}) == {"10", *[str(b) for b in range(5)]}
    assert table._grown(sizes, {b: 1 for b in sizes}) == {"10"}
    assert table._grown({"0": [1000, 90]}, {"0": 90}) == set()
    assert KeyedTable(store, "t", ["id"], fold_bytes=10**9)._grown(sizes, {b: 100 for b in sizes}) == set()


def test_a_whole_version_is_one_folder(spark, store):
    table = KeyedTable(store, "t", ["id"], buckets=300)
    table.merge(spark.range(5000).withColumn("v", F.col("id") * 2))
    state = table.state()
    assert len(state["files"]) == 300 and len(table._paths(state, state["files"])) == 1
    table.merge(spark.createDataFrame([(1, 0)], "id long, v long"))
    state = table.state()
    assert len(table._paths(state, state["files"])) == 2 and table.read().count() == 5000


def test_modes(spark, store):
    data = log(spark, (1, "a", 0), (1, "b", 1))
    assert isinstance(open_table(store, "a", ["id"], compacted=True), KeyedTable)
    assert isinstance(open_table(store, "a", ["id"]), LogTable)
    open_table(store, "a", ["id"]).append(data)
    table = set_mode(store, "a", "upsert", data, ["id"])
    assert rows(table.read(), "id", "name") == [(1, "b")]
    assert set_mode(store, "a", "append", data).read().count() == 2
    with pytest.raises(LayoutError):
        set_mode(store, "a", "upsert", data)


def test_views(spark, store):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, name string")
    view = create_view(store, "v", ["id"], df, "one")
    assert rows(view.read()) == [(1, "a"), (2, "b")]
    commit = store.snapshot()["commit"]
    create_view(store, "v", ["id"], df, "one")
    assert store.snapshot()["commit"] == commit
    refresh_view(view, df.withColumn("name", F.upper("name")).filter("id = 1"))
    assert rows(view.read()) == [(1, "A"), (2, "b")]
    create_view(store, "v", ["id"], df.select("id"), "two")
    assert rows(view.read()) == [(1,), (2,)]
    with pytest.raises(LayoutError):
        create_view(store, "w", ["id"], df.unionByName(df), "twice")
    with pytest.raises(LayoutError):
        create_view(store, "w", [], df, "no key")
    df.createOrReplaceTempView("source_rows")
    by_sql = create_view(store, "s", ["id"], "SELECT id, upper(name) AS name FROM source_rows")
    assert rows(by_sql.read()) == [(1, "A"), (2, "B")]
    drop_view(view)
    assert view.read() is None


def test_tables_of_a_store_commit_together(spark, store):
    a, b = KeyedTable(store, "a", ["id"]), KeyedTable(store, "b", ["id"])
    base = store.snapshot()
    states = {"a": a.apply(log(spark, (1, "x", 0)), base), "b": b.apply(log(spark, (1, "y", 0)), base)}
    assert a.read() is None
    store.commit(base, states)
    assert store.versions() == [1] and a.read().count() == b.read().count() == 1


def test_latest_by_key_is_limited_before_the_shuffle(spark, sf):
    plan = cl.latest_by_key(fx.orders_cdc(spark, sf), ["order_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the shuffle


def test_guard_unknown_partition(spark):
    batch = spark.createDataFrame([(0, 5), (0, 6), (1, 0)], "_partition int, _offset long")
    assert rows(cl.offset_guard(batch, {"0": 6})) == [(0, 6), (1, 0)]


def test_lag(spark):
    ends = spark.createDataFrame([("a", 0, 10), ("a", 1, 5), ("b", 0, None)], "topic string, _partition int, end_offset long")
    done = spark.createDataFrame([("a", 0, 4), ("a", 1, 9)], "topic string, _partition int, next_offset long")
    assert rows(cl.lag(ends, done)) == [("a", 6), ("b", None)]


def test_store_root_has_no_trailing_slash(spark, store):
    assert TableStore(spark, store.root + "/").root == store.root


def test_vacuum_beside_a_writer_loses_nothing(spark, store):
    """A writer has written but not committed; another one commits twice and vacuums; then the first commits on top."""
    a, b = KeyedTable(store, "a", ["id"]), KeyedTable(store, "b", ["id"])
    a.merge(log(spark, (1, "x", 0)))
    base = store.snapshot()
    state = a.apply(log(spark, (2, "y", 1)), base)
    b.merge(log(spark, (1, "p", 0)))
    b.merge(log(spark, (2, "q", 1)))
    store.vacuum(keep=1)
    assert store.versions() == [1, 2, 3]
    # also where the manifests that stood in its way are gone, the late commit is no old one
    for v in (1, 2):
        os.remove(f"{store.root.removeprefix('file:')}/_manifest/{v:012d}.json")
    store.commit(base, {"a": state})
    assert store.versions() == [3, 4]
    assert rows(a.read(), "id", "name") == [(1, "x"), (2, "y")] and rows(b.read(), "id") == [(1,), (2,)]


def test_appends_join_their_small_versions(spark, store):
    table = LogTable(store, "clicks")
    for i in range(20):
        table.append(log(spark, (i, f"n{i}", i)))
    versions = table.state()["files"]["0"]
    assert len(versions) <= 8 and len(table.state()["sizes"]) == len(versions)
    assert rows(table.read(), "id", "name", "_offset") == sorted([(i, f"n{i}", i) for i in range(20)], key=repr)
    table.append(log(spark, (3, "n3", 3)))
    assert table.read().count() == 20


def test_small_tail():
    assert _small_tail([], 2) is None and _small_tail([5], 2) is None and _small_tail([5, 5], 2) == 0
    assert _small_tail([100, 5, 5, 5], 3) == 1 and _small_tail([100, 5, 5, 5], 4) is None and _small_tail([15, 5, 5, 5], 4) == 0
    sizes, rewritten = [], 0
    for _ in range(2000):
        sizes.append(1)
        if (first := _small_tail(sizes, 8)) is not None:
            rewritten += sum(sizes[first:])
            sizes[first:] = [sum(sizes[first:])]
    assert len(sizes) < 40 and rewritten < 12 * 2000


def test_lookups_read_the_buckets_of_their_keys(spark, store):
    table = KeyedTable(store, "shop.orders", ["id"], buckets=64)
    assert table.matching(("=", "id", 1)) is None
    table.merge(spark.range(5000).withColumn("v", F.col("id") * 2))
    read = lambda where: len({p.split("_bucket=")[1].split("/")[0] for p in table.matching(where).inputFiles()})
    assert read(("=", "id", 42)) == read(("and", (">", "v", 0), ("=", "ID", "42"))) == read(("=", Lit(42), Col("id"))) == 1
    assert read(("in", "id", [1, 2, 3])) <= 3 and read(("not", ("and", ("<>", "id", 7), ("not_in", "id", [8])))) <= 2
    assert read(("and", ("=", "id", 1), ("=", "id", 2))) == 0
    for open_ in (None, (">", "id", 5), ("=", "v", 4), ("or", ("=", "id", 1), ("=", "v", 2)), ("not", ("=", "id", 1)), ("in", "id", list(range(1500))), ("=", Col("id"), Col("v"))):
        assert read(open_) == 64
    where = ("or", ("in", "id", [5, 6]), ("and", ("=", "id", 9), ("=", "v", 1)))
    assert rows(scan(table.matching(where), "*", where)) == [(5, 10), (6, 12)]
    group, tracker = "no-job", spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, "buckets")
    table._buckets_of(table.state(), [("1",), ("2",)])
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not tracker.getJobIdsForGroup(group)


def test_bindings_of_two_columns(spark):
    scope = Scope(StructType.fromDDL("a int, b string, c int"), "t", "x")
    reached = lambda where: keys_reached(where, scope, ["a", "b"])
    assert reached(("and", ("=", "x.a", 1), ("in", "b", ["p", "q"]))) == [("1", "p"), ("1", "q")]
    assert reached(("or", ("and", ("=", "a", 1), ("=", "b", "p")), ("and", ("=", "b", "q"), ("=", "A", 2), (">", "c", 1)))) == [("1", "p"), ("2", "q")]
    assert reached(("=", "a", 1)) is None and reached(("or", ("and", ("=", "a", 1), ("=", "b", "p")), ("=", "a", 3))) is None
    assert reached(("and", ("=", "a", 1), ("=", "nowhere", 2), ("=", "b", "p"))) == [("1", "p")]
    assert reached(("and", ("in", "a", list(range(100))), ("in", "b", [str(i) for i in range(100)]))) is None


def test_bindings_hold_for_random_conditions(spark):
    """Whatever a condition is, each row that meets it has a key that the analysis reaches."""
    rnd = random.Random(5)
    data = [(a, b) for a in range(6) for b in range(4)]
    df = spark.createDataFrame(data, "a int, b int")

    def make(depth):
        kind = rnd.randrange(6 if depth else 3)
        column = rnd.choice("ab")
        return [lambda: ("=", column, rnd.randrange(6)), lambda: (rnd.choice(["in", "not_in"]), column, [rnd.randrange(6) for _ in range(2)]), lambda: (rnd.choice([">", "<>", "<="]), column, rnd.randrange(6)),
                lambda: ("not", make(depth - 1)), lambda: ("and", make(depth - 1), make(depth - 1)), lambda: ("or", make(depth - 1), make(depth - 1))][kind]()
    wheres = [make(3) for _ in range(150)]
    scope = Scope(df)
    met = df.select("a", "b", *[condition(w, scope).alias(f"c{i}") for i, w in enumerate(wheres)]).collect()
    bounded = 0
    for columns in (["a"], ["b"], ["a", "b"]):
        for i, w in enumerate(wheres):
            keys = keys_reached(w, scope, columns)
            bounded += keys is not None
            assert keys is None or {tuple(str(r[c]) for c in columns) for r in met if r[f"c{i}"]} <= set(keys)
    assert bounded > 20
