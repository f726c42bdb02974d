"""Views as keyed tables: create, refresh, rebuild on a changed definition."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame

from livetables.operators.layout import LayoutError
from livetables.operators.store import TableStore
from livetables.operators.tables import DEFAULT_BUCKETS, KeyedTable


def definition_hash(*parts: str) -> str:
    """Same identity as ``functions.scalars.hash8``, for the definition at hand."""
    return hashlib.sha256(b"".join(p.encode() + b"\0" for p in parts)).hexdigest()[:8]


def create_view(store: TableStore, name: str, pk: Sequence[str], df: DataFrame | str, definition: str | None = None,
                buckets: int = DEFAULT_BUCKETS) -> KeyedTable:
    """Keyed table of a query. The same definition leaves the table alone, another one rebuilds it.

    The query is a DataFrame with a text that identifies it, or SQL on the session's views. A primary
    key that is not unique in the result is an error, not a coin toss.
    """
    if isinstance(df, str):
        df, definition = store.spark.sql(df), definition or df
    if definition is None:
        raise LayoutError(f"{name}: a DataFrame needs a definition text")
    if not pk:
        raise LayoutError(f"{name}: a view needs a primary key")
    table = KeyedTable(store, name, pk, buckets)
    snapshot = store.snapshot()
    state = table.state(snapshot)
    identity = definition_hash(name, ",".join(pk), definition)
    if state is not None and state.get("definition") == identity:
        return table
    empty = {**snapshot, "tables": {k: v for k, v in snapshot["tables"].items() if k != name}}
    store.commit(snapshot, {name: table.write(table.collapse(df), empty, definition=identity, unique=True)})
    return table


def refresh_view(table: KeyedTable, df: DataFrame) -> KeyedTable:
    """Insert the query into its table again: idempotent by key."""
    snapshot = table.store.snapshot()
    table.store.commit(snapshot, {table.name: table.write(table.collapse(df), snapshot, unique=True)})
    return table


def drop_view(table: KeyedTable) -> None:
    """Drop a view and its table; ``TableStore.vacuum`` removes the files."""
    table.drop()
