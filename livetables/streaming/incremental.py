"""Views kept current from the changes of their inputs.

Every refresh reads the inputs as of the last commit, works out signed rows from the old and the
new version of the changed keys, and commits inputs, state and view together. A crash in between
leaves the last commit, and the replay sees the same old rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, FractionalType

from livetables.operators.store import TableStore
from livetables.operators.tables import DEFAULT_BUCKETS, KeyedTable, Staged
from livetables.session import discard, materialize
from livetables.plans.views import MONEY, customer_360_rows, inventory_live, is_open, sold_total

SUM = "decimal(38,2)"
ORDER = ["customer_id", "status", "total", "created_at"]     # what the views read of an order
SMALL = 2000        # records of a refresh whose steps are held as local rows


class Refresh:
    """Table states of one commit in the making.

    Tables are written by their own threads while the next step is planned: the writes do not
    depend on each other, only on rows that are kept.

    A step has at most two rows per record (the old and the new one). So with at most ``SMALL`` records,
    counted with their offsets, a kept step goes into the next plans as local rows; beyond that, or where the count is
    not known, it is written to the shared folder, and the changes of a table are read back from the layer
    that its write has added, so they are written once. The rows are the same. A layer that is large beside its table
    also holds the rows it replaces (``KeyedTable.with_old``), for an input that names their columns.
    """

    def __init__(self, store: TableStore):
        self.store, self.base = store, store.snapshot()
        self._writes: dict[str, Future] = {}
        self._changes: dict[str, DataFrame | Future] = {}
        self._steps: list[str] = []
        self._records: list[int | None] = []
        self._pool = ThreadPoolExecutor(4)

    def __enter__(self) -> Refresh:
        return self

    def __exit__(self, *_) -> None:
        """Wait for writes at work, also after an error; then the steps go."""
        self._pool.shutdown(cancel_futures=True)
        discard(self.store.spark, *self._steps)

    def keep(self, df: DataFrame) -> DataFrame:
        """Rows that several steps use, worked out once: it keeps the plans of those steps short."""
        if self.small():
            return df.sparkSession.createDataFrame(df.toArrow(), df.schema)
        out = materialize(df, "step")
        self._steps.append(out._written_to)
        return out

    def records(self) -> int:
        """The fresh records, 0 where the count is not known."""
        return 0 if None in self._records else sum(self._records)

    def small(self) -> bool:
        return None not in self._records and sum(self._records) <= SMALL

    def take(self, table: KeyedTable, batch: DataFrame | None, old: Sequence[str] = ()) -> DataFrame | None:
        """The new changes of an input, one per key, and their write. ``old`` are the columns of replaced rows that a step needs."""
        return self._taken(table, self._staged(table, batch), old)

    def _staged(self, table: KeyedTable, batch: DataFrame | None) -> Staged | None:
        staged = None if batch is None else table.stage(batch, self.base)
        if staged is not None:
            self._records.append(staged.records)
        return staged

    def _taken(self, table: KeyedTable, staged: Staged | None, old: Sequence[str] = ()) -> DataFrame | None:
        if staged is None:
            return None
        if self.small():
            changes = self.keep(staged.changes)
            self._submit(table, changes, staged.offsets, staged.record_ts)
            return changes
        layer = table.add_layer(table.with_old(staged, self.base, old) if old else staged.changes, self.base)
        self._writes[table.name] = self._pool.submit(table.settle, layer, self.base, staged.offsets, staged.record_ts)
        changes = self._changes[table.name] = table.layer_rows(layer)
        return changes

    def take_both(self, *inputs: tuple) -> list[DataFrame | None]:
        """``take`` of several inputs, each with its arguments."""
        staged = [f.result() for f in [self._pool.submit(self._staged, t, b) for t, b, *_ in inputs]]
        return [f.result() for f in [self._pool.submit(self._taken, t, s, *old) for (t, _, *old), s in zip(inputs, staged)]]

    def put(self, table: KeyedTable, rows: DataFrame) -> None:
        self._submit(table, rows)

    def _submit(self, table: KeyedTable, rows: DataFrame, *progress) -> None:
        written = Future()
        self._changes[table.name] = rows if self.small() else written
        self._writes[table.name] = self._pool.submit(self._write, table, rows, written, *progress)

    def _write(self, table: KeyedTable, rows: DataFrame, written: Future, *progress) -> dict:
        try:
            layer = table.add_layer(rows, self.base)
            written.set_result(table.layer_rows(layer))
        except BaseException as e:
            written.set_exception(e)
            raise
        return table.settle(layer, self.base, *progress)

    def changes(self, table: KeyedTable) -> DataFrame | None:
        """What this commit writes to a table so far; waits for its layer, not for folds."""
        rows = self._changes.get(table.name)
        return rows.result() if isinstance(rows, Future) else rows

    def rows(self, table: KeyedTable, ids: DataFrame, on: list[str]) -> DataFrame | None:
        """Rows of some keys as this commit will leave them, without waiting for the commit:
        the committed rows that did not change, and the changed ones."""
        stored = table.read_keys(ids, self.base, on)
        changes = self.changes(table)
        if changes is None:
            return stored
        live = changes.filter("NOT _deleted").join(ids.select(*on), on, "left_semi")
        if stored is None:
            return live
        kept = stored.join(changes.select(*table.keys), table.keys, "left_anti")
        return kept.unionByName(live.select(*[c for c in live.columns if c in kept.columns]), allowMissingColumns=True)

    def commit(self) -> dict:
        pending = {n: w.result() for n, w in self._writes.items()}
        return self.store.commit(self.base, pending) if pending else self.base


def holds_old(changes: DataFrame, columns: list[str]) -> bool:
    return "_old" in changes.columns and set(columns) <= set(changes.schema["_old"].dataType.names)


def old_and_new(table: KeyedTable, changes: DataFrame, base: dict, columns: list[str]) -> DataFrame | None:
    """The committed row of each changed key (``_old``) and its new one (``_new``), null where there is none, without
    those that are alike; None for a table without rows. The layer of a large batch holds both, else they are joined."""
    new = F.when(~F.col("_deleted"), F.struct(*columns)).alias("_new")
    if holds_old(changes, columns):
        pairs = changes.select(new, F.when(F.col("_old").isNotNull(), F.struct(*[F.col(f"_old.{c}").alias(c) for c in columns])).alias("_old"))
    else:
        stored = table.read_keys(changes, base)
        if stored is None:
            return None
        old = F.struct(*[F.col(c).cast(changes.schema[c].dataType).alias(c) for c in columns])
        pairs = changes.select(*table.keys, new).join(stored.select(*table.keys, old.alias("_old")), table.keys, "left")
    kinds = " ".join(changes.schema[c].dataType.simpleString() for c in columns)
    comparable = "map<" not in kinds and "variant" not in kinds
    return pairs.filter(~F.col("_new").eqNullSafe(F.col("_old"))) if comparable else pairs


def signed_changes(table: KeyedTable, changes: DataFrame, base: dict, columns: list[str]) -> DataFrame:
    """Minus the committed rows of the changed keys, plus their new rows, without those that stay as they are.

    Both rows of a key come from one record, so they meet in an aggregation before its shuffle.
    """
    pairs = old_and_new(table, changes, base, columns)
    if pairs is None:
        return changes.filter("NOT _deleted").select(*columns, F.lit(1).cast("long").alias("_w"))
    sides = F.array(*[F.struct(F.lit(w).cast("long").alias("w"), F.col(c).alias("row")) for w, c in ((-1, "_old"), (1, "_new"))])
    rows = pairs.select(F.inline(sides)).filter("row IS NOT NULL")
    return rows.select(*[F.col("row")[c].alias(c) for c in columns], F.col("w").alias("_w"))


def with_stored(delta: DataFrame, table: KeyedTable, base: dict, columns: list[str], kept: bool = True) -> DataFrame:
    """Deltas next to the stored values of their keys, named ``old_<column>``. Those that are not ``kept`` are read once, and the table whole."""
    stored = table.read_keys(delta, base) if kept else table.read(base)
    if stored is None:
        return delta.withColumns({f"old_{c}": F.lit(None) for c in columns})
    return delta.join(stored.select(*table.keys, *[F.col(c).alias(f"old_{c}") for c in columns]), table.keys, "left")


def counted(name: str) -> str:
    return f"{name}_values"


def _sum_type(kind: DataType) -> str:
    if isinstance(kind, DecimalType):
        return f"decimal(38,{kind.scale})"
    return "double" if isinstance(kind, FractionalType) else "long"


def merge_signed(refresh: Refresh, table: KeyedTable, signed: DataFrame, sums: dict[str, Column] | None = None) -> None:
    """Add COUNT and SUM deltas to a stored aggregate; a group without rows is deleted.

    Beside each sum its number of values is stored (``counted``): a sum of nulls only is null. Sums keep the scale of their input.
    """
    sums, w = sums or {}, F.col("_w")
    delta = signed.groupBy(*table.keys).agg(F.sum(w).alias("n"), *[F.sum(w * v).alias(k) for k, v in sums.items()],
                                            *[F.sum(F.when(v.isNotNull(), w)).alias(counted(k)) for k, v in sums.items()])
    columns = ["n", *sums, *map(counted, sums)]
    delta = delta.dropna(subset=table.keys)
    rows = with_stored(refresh.keep(delta) if refresh.small() else delta, table, refresh.base, columns)
    types = {**{c: "long" for c in columns}, **{k: _sum_type(signed.select(v.alias("v")).schema["v"].dataType) for k, v in sums.items()}}
    total = {c: (F.coalesce(F.col(f"old_{c}").cast(types[c]), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))).cast(types[c]) for c in columns}
    total |= {k: F.when(total[counted(k)] > 0, total[k]) for k in sums}
    rows = rows.select(*table.keys, *[v.alias(c) for c, v in total.items()])
    refresh.put(table, rows.withColumn("_deleted", F.col("n") == 0))


class GroupCount:
    """COUNT and SUM per group of a keyed topic, from signed rows alone."""

    def __init__(self, store: TableStore, source: KeyedTable, name: str, keys: list[str],
                 sums: dict[str, Column] | None = None, buckets: int = DEFAULT_BUCKETS):
        self.store, self.source, self.sums = store, source, sums or {}
        self.table = KeyedTable(store, name, keys, buckets)

    def read(self) -> DataFrame:
        """Keys, ``n`` and the sums."""
        return self.table.read().drop(*map(counted, self.sums))

    def refresh(self, batch: DataFrame) -> dict:
        with Refresh(self.store) as refresh:
            changes = refresh.take(self.source, batch, [c for c in batch.columns if not c.startswith("_")])
            if changes is not None:
                columns = [c for c in changes.columns if not c.startswith("_")]
                merge_signed(refresh, self.table, signed_changes(self.source, changes, refresh.base, columns), self.sums)
            return refresh.commit()


class CustomerView:
    """customer_360 and the tier totals above it, under any change of customers and orders.

    State: per customer the count, sum and open orders, and per customer and order time the number
    of orders. The second one answers MAX after a delete from the rows of the customers concerned;
    both are bucketed by customer, so no refresh scans the orders.
    """

    def __init__(self, store: TableStore, buckets: int = DEFAULT_BUCKETS):
        self.store = store
        self.customers = KeyedTable(store, "customers", ["customer_id"], buckets)
        self.orders = KeyedTable(store, "orders", ["order_id"], buckets)
        self.times = KeyedTable(store, "orders_by_time", ["customer_id", "created_at"], buckets, bucket_by=["customer_id"])
        self.totals = KeyedTable(store, "orders_by_customer", ["customer_id"], buckets)
        self.view = KeyedTable(store, "customer_360", ["customer_id"], buckets)
        self.tiers = KeyedTable(store, "tier_totals", ["tier"], 1)

    def refresh(self, customers: DataFrame | None, orders: DataFrame | None) -> dict:
        with Refresh(self.store) as refresh:
            changed_customers, changed_orders = refresh.take_both((self.customers, customers), (self.orders, orders, ORDER))
            affected = [] if changed_customers is None else [changed_customers.select("customer_id")]
            if changed_orders is not None:
                affected.append(self._merge_totals(refresh, changed_orders))
            if affected:
                ids = refresh.keep(affected[0].unionByName(affected[1]).distinct()) if len(affected) == 2 else affected[0]
                self._merge_view(refresh, ids)
            return refresh.commit()

    def _merge_totals(self, refresh: Refresh, changes: DataFrame) -> DataFrame:
        effects, kept = self._effects(refresh, changes)
        if kept:
            moved = effects.filter("n <> 0 AND created_at IS NOT NULL").select("customer_id", "created_at", "n")
        else:
            first = self.times.state(refresh.base) is None
            # the first rows of a large batch are dealt out as they are counted, and written so
            by = [self.times.bucket(refresh.base).alias("_bucket")] if first and self.times.wide(refresh.records(), refresh.base) else []
            signed = signed_changes(self.orders, changes, refresh.base, ["customer_id", "created_at"]).dropna()
            moved = signed.groupBy(*by, "customer_id", "created_at").agg(F.sum("_w").alias("n")).filter("n <> 0")
            if by:
                moved = moved.sortWithinPartitions("_bucket", "customer_id", "created_at")
            elif not first:
                moved = refresh.keep(moved)
        rows = with_stored(moved, self.times, refresh.base, ["n"])
        count = (F.coalesce(F.col("old_n").cast("long"), F.lit(0)) + F.col("n"))
        bucket = [c for c in rows.columns if c == "_bucket"]
        refresh.put(self.times, rows.select(*bucket, "customer_id", "created_at", count.alias("n")).withColumn("_deleted", F.col("n") == 0))

        delta = effects.groupBy("customer_id").agg(
            F.sum("n").alias("n"), F.sum("sold").alias("sold"), F.sum("open_orders").alias("open_orders"),
            F.max(F.when(F.col("n") > 0, F.col("created_at"))).alias("added"),
            F.max(F.when(F.col("n") < 0, F.col("created_at"))).alias("removed"))
        columns = ["orders", "sold", "open_orders", "last_order_at"]
        rows = with_stored(delta, self.totals, refresh.base, columns, kept)
        old = lambda c, t: F.coalesce(F.col(f"old_{c}").cast(t), F.lit(0))
        latest = F.greatest(F.col("old_last_order_at").cast("timestamp_ntz"), F.col("added"))
        seen = Observation()
        rows = refresh.keep(rows.select(
            "customer_id",
            (old("orders", "long") + F.col("n")).alias("orders"),
            (old("sold", SUM) + F.coalesce("sold", F.lit(0))).cast(SUM).alias("sold"),
            (old("open_orders", "long") + F.col("open_orders")).alias("open_orders"),
            latest.alias("last_order_at"),
            F.coalesce(F.col("removed") >= latest, F.lit(False)).alias("max_left"),
        ).observe(seen, F.count_if("max_left").alias("left")))
        if seen.get["left"]:
            left = rows.filter("max_left").select("customer_id")
            again = (refresh.rows(self.times, left, ["customer_id"])
                     .groupBy("customer_id").agg(F.max("created_at").alias("again")))
            # kept again: the table, its keys and the view all read it
            rows = refresh.keep(rows.join(again, "customer_id", "left")
                                .withColumn("last_order_at", F.when(F.col("max_left"), F.col("again")).otherwise(F.col("last_order_at")))
                                .drop("again"))
        refresh.put(self.totals, rows.drop("max_left").withColumn("_deleted", F.col("orders") == 0))
        return rows.select("customer_id")

    def _effects(self, refresh: Refresh, changes: DataFrame) -> tuple[DataFrame, bool]:
        """What the changed orders add to their customers: ``n`` orders at a time, ``sold`` and ``open_orders``; and whether that is kept.

        An order that keeps customer and time is one row, with ``n`` 0; else its old row counts -1 and its new one 1. If a layer alone
        gives them, each step reads it. Else they are kept, per customer and time: an update that keeps both cancels
        out, and a customer with a third of the changes is spread over its times.
        """
        key = ("customer_id", "created_at")

        def effect(row: str, n: int, sold: Column, open_orders: Column) -> list[Column]:
            return [*[F.col(f"{row}{c}").alias(c) for c in key], F.lit(n).cast("long").alias("n"), sold.alias("sold"), open_orders.cast("long").alias("open_orders")]

        pairs = old_and_new(self.orders, changes, refresh.base, ORDER)
        if pairs is None:
            rows = changes.filter("NOT _deleted").select(*effect("", 1, sold_total(), is_open()))
        else:
            was, now, none = sold_total("_old."), sold_total("_new."), F.lit(0).cast(MONEY)
            stays = F.col("_new").isNotNull() & F.col("_old").isNotNull()
            for c in key:
                stays &= F.col(f"_new.{c}").eqNullSafe(F.col(f"_old.{c}"))
            one = effect("_new.", 0, F.coalesce(now, none) - F.coalesce(was, none), is_open("_new.") - is_open("_old."))
            both = effect("_old.", -1, none - was, -is_open("_old.")), effect("_new.", 1, none + now, is_open("_new."))     # of one type
            rows = pairs.select(F.inline(F.when(stays, F.array(F.struct(*one))).otherwise(F.array(*[F.struct(*r) for r in both]))))
        # without a customer: an order of nobody, or no old or no new row
        some = "n <> 0 OR sold <> 0 OR open_orders <> 0"
        rows = rows.filter(f"customer_id IS NOT NULL AND ({some})")
        if not refresh.small() and (pairs is None or holds_old(changes, ORDER)):
            return rows, False
        sums = [F.sum("n").alias("n"), F.coalesce(F.sum("sold"), F.lit(0)).alias("sold"), F.sum("open_orders").alias("open_orders")]
        return refresh.keep(rows.groupBy(*key).agg(*sums).filter(some)), True

    def _merge_view(self, refresh: Refresh, ids: DataFrame) -> None:
        customers = refresh.rows(self.customers, ids, ["customer_id"])
        if customers is None:
            return
        totals = refresh.rows(self.totals, ids, ["customer_id"])
        if totals is None:
            schema = f"customer_id long, orders long, sold {SUM}, open_orders long, last_order_at timestamp_ntz"
            totals = ids.sparkSession.createDataFrame([], schema)
        rows = customer_360_rows(customers, totals).withColumn("_there", F.lit(True))
        # an affected customer that is not there has no view row: an order may come first, or stay behind
        changes = refresh.keep(ids.join(rows, "customer_id", "left").withColumn("_deleted", F.col("_there").isNull()).drop("_there"))
        refresh.put(self.view, changes)
        signed = signed_changes(self.view, changes, refresh.base, ["tier", "orders", "lifetime_value"])
        merge_signed(refresh, self.tiers, signed, {"orders": F.col("orders"), "revenue": F.col("lifetime_value").cast(MONEY)})


class InventoryView:
    """inventory_live under any change of products and stock: both have the key of the view."""

    def __init__(self, store: TableStore, buckets: int = DEFAULT_BUCKETS):
        self.store = store
        self.products = KeyedTable(store, "products", ["product_id"], buckets)
        self.inventory = KeyedTable(store, "inventory", ["product_id"], buckets)
        self.view = KeyedTable(store, "inventory_live", ["product_id"], buckets)

    def refresh(self, products: DataFrame | None, inventory: DataFrame | None) -> dict:
        with Refresh(self.store) as refresh:
            return self._merged(refresh, products, inventory)

    def _merged(self, refresh: Refresh, products: DataFrame | None, inventory: DataFrame | None) -> dict:
        taken = refresh.take_both((self.products, products), (self.inventory, inventory))
        changed = [c.select("product_id") for c in taken if c is not None]
        if not changed:
            return refresh.commit()
        ids = refresh.keep(changed[0].unionByName(changed[1]).distinct() if len(changed) == 2 else changed[0])
        left, right = (refresh.rows(t, ids, ["product_id"]) for t in (self.products, self.inventory))
        if left is not None and right is not None:
            rows = inventory_live(left, right).withColumn("_there", F.lit(True))
            changes = ids.join(rows, "product_id", "left").withColumn("_deleted", F.col("_there").isNull()).drop("_there")
            refresh.put(self.view, changes)
        return refresh.commit()

