"""Incremental = batch, for random changes in random batches; replays and reordering change nothing."""

import os
import random

import pytest
from pyspark.sql import functions as F

from livetables.operators import changelog as cl
from livetables.operators import tables
from livetables.operators.store import TableStore
from livetables.operators.tables import KeyedTable
from livetables.plans.views import customer_360, inventory_live
from livetables.session import workdir
from livetables.streaming import incremental
from livetables.streaming.incremental import CustomerView, GroupCount, InventoryView, Refresh
from tests.conftest import rows

CUSTOMERS = ("customer_id long, email string, first_name string, last_name string, country string, tier string, "
             "_partition int, _offset long, _timestamp timestamp_ntz, _deleted boolean")
ORDERS = ("order_id long, customer_id long, status string, total decimal(18,2), created_at timestamp_ntz, "
          "_partition int, _offset long, _timestamp timestamp_ntz, _deleted boolean")


def history(seed, n=120):
    """Random inserts, updates, moves and deletes; a third of the orders belong to one customer."""
    import datetime as dt
    from decimal import Decimal
    rnd = random.Random(seed)
    customers, orders = [], []
    at = dt.datetime(2026, 1, 1)
    for i in range(n):
        if rnd.random() < 0.3:
            cid, gone = rnd.randrange(8), rnd.random() < 0.25
            values = (None,) * 5 if gone else (f"c{cid}@x", "F", f"L{i}", "FR", rnd.choice(["gold", "standard"]))
            customers.append((cid, *values, cid % 2, i, at, gone))
        else:
            oid, gone = rnd.randrange(25), rnd.random() < 0.3
            cid = 1 if rnd.random() < 0.33 else rnd.randrange(10)
            values = (None,) * 4 if gone else (cid, rnd.choice(["open", "shipped", "cancelled"]), Decimal(rnd.randrange(10000)) / 100,
                                               None if rnd.random() < 0.1 else at + dt.timedelta(days=rnd.randrange(5)))
            orders.append((oid, *values, oid % 3, i, at, gone))
    return customers, orders


@pytest.mark.parametrize("seed, small", [(1, incremental.SMALL), (2, -1), (3, 25)])
def test_customer_view_equals_batch(spark, monkeypatch, seed, small):
    """With steps as local rows, as written rows, and with both in turn."""
    monkeypatch.setattr(incremental, "SMALL", small)
    customers, orders = history(seed)
    rnd = random.Random(seed + 100)
    view = CustomerView(TableStore(spark, workdir(spark, "view")), buckets=rnd.choice([1, 3, 20]))
    c_all, o_all = spark.createDataFrame(customers, CUSTOMERS), spark.createDataFrame(orders, ORDERS)
    cuts = sorted(rnd.sample(range(1, 119), 3)) + [10**9]
    start = 0
    for cut in cuts:
        part = lambda df: df.filter((F.col("_offset") >= start) & (F.col("_offset") < cut))
        # a batch may repeat what came before it
        again = (lambda df: df.filter(F.col("_offset") < cut)) if rnd.random() < 0.5 else part
        view.refresh(again(c_all), again(o_all))
        start = cut
    want = customer_360(cl.latest_by_key(c_all, ["customer_id"]), cl.latest_by_key(o_all, ["order_id"]))
    assert rows(view.view.read(), *want.columns) == rows(want)
    tiers = want.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("orders").cast("decimal(38,2)").alias("orders"),
                                     F.sum(F.col("lifetime_value").cast("decimal(18,2)")).cast("decimal(38,2)").alias("revenue"))
    assert rows(view.tiers.read(), "tier", "n", "orders", "revenue") == rows(tiers)
    commit = view.store.snapshot()["commit"]
    view.refresh(c_all, o_all)
    assert view.store.snapshot()["commit"] == commit


def test_order_first_then_customer_then_gone(spark, store):
    customers, orders = history(7, 0)
    view = CustomerView(store)
    import datetime as dt
    t = dt.datetime(2026, 1, 1)
    c = lambda *r: spark.createDataFrame(list(r), CUSTOMERS)
    o = lambda *r: spark.createDataFrame(list(r), ORDERS)
    view.refresh(None, o((1, 5, "open", None, t, 0, 0, t, False), (2, 5, "open", None, t + dt.timedelta(1), 0, 1, t, False)))
    assert view.view.read() is None
    view.refresh(c((5, "e", "A", "B", "FR", "gold", 0, 0, t, False)), None)
    assert rows(view.view.read(), "customer_id", "orders", "last_order_at") == [(5, 2, t + dt.timedelta(1))]
    view.refresh(None, o((2, None, None, None, None, 0, 2, t, True)))  # the newest order goes: MAX steps back
    assert rows(view.view.read(), "customer_id", "orders", "last_order_at") == [(5, 1, t)]
    view.refresh(c((5, None, None, None, None, None, 0, 1, t, True)), None)
    assert view.view.read().count() == 0 and view.tiers.read().count() == 0
    view.refresh(c((5, "e", "A", "B", "FR", "gold", 0, 2, t, False)), None)
    assert rows(view.view.read(), "customer_id", "orders", "open_orders") == [(5, 1, 1)]


def test_crash_before_commit_then_replay(spark, store, monkeypatch):
    customers, orders = history(4, 40)
    view = CustomerView(store)
    c, o = spark.createDataFrame(customers, CUSTOMERS), spark.createDataFrame(orders, ORDERS)
    view.refresh(c, o.filter("_offset < 20"))
    commit = store.commit

    def crash(*_):
        raise RuntimeError("crash")
    monkeypatch.setattr(store, "commit", crash)
    with pytest.raises(RuntimeError):
        view.refresh(c, o)
    monkeypatch.setattr(store, "commit", commit)
    view.refresh(c, o)
    want = customer_360(cl.latest_by_key(c, ["customer_id"]), cl.latest_by_key(o, ["order_id"]))
    assert rows(view.view.read(), *want.columns) == rows(want)


def test_group_count_equals_batch(spark, store):
    _, orders = history(5)
    log = spark.createDataFrame(orders, ORDERS)
    counts = GroupCount(store, KeyedTable(store, "orders", ["order_id"]), "n", ["customer_id"], {"total": F.col("total")})
    for low, high in ((0, 30), (30, 31), (31, 999)):
        counts.refresh(log.filter((F.col("_offset") >= low) & (F.col("_offset") < high)))
    want = cl.latest_by_key(log, ["order_id"]).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.sum("total").cast("decimal(38,2)").alias("total"))
    assert rows(counts.read(), "customer_id", "n", "total") == rows(want)


def test_inventory_view_equals_batch(spark, store):
    rnd = random.Random(6)
    import datetime as dt
    t = dt.datetime(2026, 1, 1)
    P = "product_id long, sku string, name string, category string, price decimal(18,2), _partition int, _offset long, _timestamp timestamp_ntz, _deleted boolean"
    I = "product_id long, warehouse string, on_hand long, reserved long, updated_at timestamp_ntz, _partition int, _offset long, _timestamp timestamp_ntz, _deleted boolean"
    products = [(rnd.randrange(12), *((None,) * 4 if (gone := rnd.random() < 0.3) else ("s", f"n{i}", "c", rnd.randrange(9))), 0, i, t, gone) for i in range(40)]
    stock = [(rnd.randrange(12), *((None,) * 4 if (gone := rnd.random() < 0.3) else ("main", rnd.randrange(20), rnd.randrange(20), t)), 0, i, t, gone) for i in range(40)]
    from decimal import Decimal
    products = [tuple(Decimal(v) if j == 4 and v is not None else v for j, v in enumerate(r)) for r in products]
    p, s = spark.createDataFrame(products, P), spark.createDataFrame(stock, I)
    view = InventoryView(store)
    for low, high in ((0, 10), (10, 25), (25, 99)):
        part = lambda df: df.filter((F.col("_offset") >= low) & (F.col("_offset") < high))
        view.refresh(part(p), None)
        view.refresh(None, part(s))
    want = inventory_live(cl.latest_by_key(p, ["product_id"]), cl.latest_by_key(s, ["product_id"]))
    assert rows(view.view.read(), *want.columns) == rows(want)


def test_empty_refresh(spark, store):
    with Refresh(store) as refresh:
        assert refresh.commit() == {"commit": 0, "tables": {}}


@pytest.mark.parametrize("small", [-1, incremental.SMALL])
def test_an_error_ends_the_writes_and_steps_go(spark, store, monkeypatch, small):
    monkeypatch.setattr(incremental, "SMALL", small)
    customers, orders = history(4, 40)
    view = CustomerView(store)
    c, o = spark.createDataFrame(customers, CUSTOMERS), spark.createDataFrame(orders, ORDERS)
    made, keep = [], Refresh.keep

    def kept(self, df):
        made.append((self, out := keep(self, df)))
        return out
    monkeypatch.setattr(Refresh, "keep", kept)
    monkeypatch.setattr(CustomerView, "_merge_view", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        view.refresh(c, o)
    assert made and all(refresh._pool._shutdown and not any(t.is_alive() for t in refresh._pool._threads) for refresh, _ in made)
    written = {p for refresh, _ in made for p in refresh._steps}
    assert bool(written) == (small < 0) and not any(os.path.exists(p.removeprefix("file:")) for p in written)
    monkeypatch.undo()
    view.refresh(c, o)
    want = customer_360(cl.latest_by_key(c, ["customer_id"]), cl.latest_by_key(o, ["order_id"]))
    assert rows(view.view.read(), *want.columns) == rows(want)


def test_rows_with_null_columns_stay_in_the_views(spark, store):
    customers = spark.createDataFrame([(1, None, "A", "B", "FR", "gold", 0, 0, None, False)], CUSTOMERS)
    view = CustomerView(store)
    view.refresh(customers, None)
    assert rows(view.view.read(), "customer_id", "email", "orders") == [(1, None, 0)]
    stock = InventoryView(TableStore(spark, workdir(spark, "test")))
    products = spark.createDataFrame([(1, "s", "n", "c", 1.0, 0, 0, None, False)],
                                     "product_id long, sku string, name string, category string, price double, _partition int, _offset long, _timestamp timestamp_ntz, _deleted boolean")
    inventory = spark.createDataFrame([(1, "main", None, 3, None, 0, 0, None, False)],
                                      "product_id long, warehouse string, on_hand long, reserved long, updated_at timestamp_ntz, _partition int, _offset long, _timestamp timestamp_ntz, _deleted boolean")
    stock.refresh(products, inventory)
    assert rows(stock.view.read(), "product_id", "available") == [(1, None)]


def test_sums_keep_scale_and_nulls(spark, store):
    from decimal import Decimal
    schema = "id long, k long, v decimal(18,4), _partition int, _offset long, _deleted boolean"
    counts = GroupCount(store, KeyedTable(store, "values", ["id"]), "sums", ["k"], {"v": F.col("v")})
    small = Decimal("0.0040")
    counts.refresh(spark.createDataFrame([(1, 1, small, 0, 0, False), (2, 1, small, 0, 1, False), (3, 2, None, 0, 2, False)], schema))
    assert rows(counts.read(), "k", "n", "v") == [(1, 2, Decimal("0.0080")), (2, 1, None)]
    counts.refresh(spark.createDataFrame([(1, 1, None, 0, 3, False), (2, 1, None, 0, 4, False), (3, 2, small, 0, 5, False)], schema))
    assert rows(counts.read(), "k", "n", "v") == [(1, 2, None), (2, 1, small)]


def test_large_changes_are_written_once(spark, store, monkeypatch):
    """Beyond local rows, the steps of a refresh read the layer that the table has got, not a copy of it; a null key and a tombstone change nothing else."""
    monkeypatch.setattr(incremental, "SMALL", -1)
    _, orders = history(9)
    log = spark.createDataFrame([(None, 1, "open", None, None, 0, 500, None, False), *orders], ORDERS)
    table = KeyedTable(store, "orders", ["order_id"])
    for low, high in ((0, 60), (60, 999)):
        batch = log.filter((F.col("_offset") >= low) & (F.col("_offset") < high))
        with Refresh(store) as refresh:
            changes = refresh.take(table, batch)
            assert changes.inputFiles() and all("/orders/_v=" in f for f in changes.inputFiles()) and not refresh._steps
            last = cl.last_change(batch, ["order_id"]).filter("order_id IS NOT NULL")
            want = last.filter("NOT _deleted") if low == 0 else last
            assert rows(changes, "order_id", "customer_id", "total", "_deleted") == rows(want, "order_id", "customer_id", "total", "_deleted")
            refresh.commit()
    assert rows(table.read(), "order_id", "status") == rows(cl.latest_by_key(log.filter("order_id IS NOT NULL"), ["order_id"]), "order_id", "status")


def test_a_max_that_steps_back_is_worked_out_once(spark, store, monkeypatch):
    """The totals are written and read with their new MAX, and not from the orders by time again."""
    import datetime as dt
    monkeypatch.setattr(incremental, "SMALL", -1)
    t, seen, put = dt.datetime(2026, 1, 1), {}, Refresh.put
    order = lambda i, day, offset, gone=False: (i, *((None,) * 4 if gone else (5, "open", None, t + dt.timedelta(day))), 0, offset, t, gone)
    view = CustomerView(store)
    view.refresh(spark.createDataFrame([(5, "e", "A", "B", "FR", "gold", 0, 0, t, False)], CUSTOMERS),
                 spark.createDataFrame([order(1, 0, 0), order(2, 1, 1), order(3, 2, 2)], ORDERS))
    monkeypatch.setattr(Refresh, "put", lambda self, table, rows: (seen.update({table.name: rows.inputFiles()}), put(self, table, rows)))
    view.refresh(None, spark.createDataFrame([order(3, 2, 3, True)], ORDERS))
    assert seen["orders_by_customer"] and not any("orders_by_time" in f for f in seen["orders_by_customer"])
    assert rows(view.view.read(), "customer_id", "orders", "last_order_at") == [(5, 2, t + dt.timedelta(1))]


def test_rounds_of_a_log_make_the_whole_log(spark, sf):
    from livetables import fixtures as fx
    for log in (fx.customers_cdc, fx.orders_cdc):
        parts = [log(spark, sf, [i]) for i in range(3)]
        assert rows(parts[0].unionByName(parts[1]).unionByName(parts[2])) == rows(log(spark, sf))
        assert all(p.filter(F.floor(F.col("_offset") / fx.OFFSET_STEP) != i).isEmpty() for i, p in enumerate(parts))


def test_a_large_batch_holds_the_rows_it_replaces(spark, store, monkeypatch):
    """Its layer alone gives the signed rows: the table is read once, with the batch, and rows that stay as they are give none."""
    monkeypatch.setattr(incremental, "SMALL", -1)
    monkeypatch.setattr(tables, "FILE_ROWS", 0)
    _, orders = history(11)
    log = spark.createDataFrame([(None, 1, "open", None, None, 0, 500, None, False), *orders], ORDERS)
    table, columns = KeyedTable(store, "orders", ["order_id"]), ["customer_id", "status", "total", "created_at"]
    state = {}
    for low, high in ((0, 60), (60, 999)):
        batch = log.filter((F.col("_offset") >= low) & (F.col("_offset") < high))
        with Refresh(store) as refresh:
            changes = refresh.take(table, batch, columns)
            assert ("_old" in changes.columns) == (low > 0)
            signed = incremental.signed_changes(table, changes, refresh.base, columns)
            assert set(signed.inputFiles()) <= set(changes.inputFiles()) and len({f.split("_v=")[1].split("/")[0] for f in signed.inputFiles()}) == 1
            want, after = [], dict(state)
            for key, *values, _, offset, _, gone in sorted((o for o in orders if low <= o[6] < high), key=lambda o: o[6]):
                after[key] = None if gone else tuple(values)
            for key in after:
                if state.get(key) != after[key]:
                    want += [(*row, w) for row, w in ((state.get(key), -1), (after[key], 1)) if row is not None]
            assert rows(signed, *columns, "_w") == sorted(want, key=repr)
            state = after
            refresh.commit()
    assert rows(table.read(), "order_id", *columns) == sorted(((k, *v) for k, v in state.items() if v is not None), key=repr)


@pytest.mark.parametrize("seed", [21, 22, 23])
def test_large_refreshes_equal_batch(spark, monkeypatch, seed):
    """Every batch written as it is dealt out, every layer folded at once."""
    monkeypatch.setattr(incremental, "SMALL", -1)
    monkeypatch.setattr(tables, "FILE_ROWS", 0)
    monkeypatch.setattr(tables, "FILE_BYTES", 0)
    customers, orders = history(seed, 200)
    c_all, o_all = spark.createDataFrame(customers, CUSTOMERS), spark.createDataFrame(orders, ORDERS)
    view = CustomerView(TableStore(spark, workdir(spark, "view")), buckets=3)
    for table in (view.customers, view.orders, view.times, view.totals, view.view):
        table.fold_bytes = 0 if seed != 22 else 1 << 30      # once with layers that stay
    for low, high in ((0, 80), (80, 150), (150, 200)):
        part = lambda df: df.filter((F.col("_offset") >= low) & (F.col("_offset") < high))
        view.refresh(part(c_all), part(o_all))
    want = customer_360(cl.latest_by_key(c_all, ["customer_id"]), cl.latest_by_key(o_all, ["order_id"]))
    assert rows(view.view.read(), *want.columns) == rows(want)
    assert rows(view.orders.read(), "order_id", "status", "total") == rows(cl.latest_by_key(o_all, ["order_id"]), "order_id", "status", "total")
    times = cl.latest_by_key(o_all, ["order_id"]).dropna(subset=["customer_id", "created_at"]).groupBy("customer_id", "created_at").agg(F.count(F.lit(1)).alias("n"))
    assert rows(view.times.read(), *times.columns) == rows(times)
    counts = GroupCount(TableStore(spark, workdir(spark, "view")), view.orders, "n", ["customer_id"], {"total": F.col("total")})
    counts.source = KeyedTable(counts.store, "orders", ["order_id"])
    for low, high in ((0, 80), (80, 200)):
        counts.refresh(o_all.filter((F.col("_offset") >= low) & (F.col("_offset") < high)))
    want = cl.latest_by_key(o_all, ["order_id"]).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.sum("total").cast("decimal(38,2)").alias("total"))
    assert rows(counts.read(), "customer_id", "n", "total") == rows(want)


def test_a_large_fold_joins_base_and_layer_once(spark, store, monkeypatch):
    """The rows of a fold are those of a read, with many layers and tombstones, and are not shuffled again to be written."""
    monkeypatch.setattr(tables, "FILE_BYTES", 0)
    _, orders = history(31, 200)
    log = spark.createDataFrame(orders, ORDERS)
    table = KeyedTable(store, "orders", ["order_id"], fold_bytes=1 << 30)
    for low, high in ((0, 80), (80, 100), (100, 200)):
        table.merge(log.filter((F.col("_offset") >= low) & (F.col("_offset") < high)))
    before, state = rows(table.read()), table.state()
    assert any(len(layers) > 2 for layers in state["files"].values())
    folded, written, write = table._folded(state, state["files"]), [], KeyedTable._write_version
    assert rows(folded.drop("_bucket"), *table.read().columns) == before
    monkeypatch.setattr(KeyedTable, "_write_version", lambda self, r, v, dealt=False: (written.append(dealt), write(self, r, v, dealt))[1])
    table.compact()
    assert written == [True] and rows(table.read()) == before and all(len(v) == 1 for v in table.state()["files"].values())
