"""The scalar functions views and jobs use, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash8(*parts: Column | str) -> Column:
    """Identity of a definition: first eight hex digits of SHA-256 over the parts, each ended by a zero byte."""
    zero = F.unhex(F.lit("00"))
    pieces = [piece for p in parts for piece in (F.encode(_col(p), "UTF-8"), zero)]
    return F.substring(F.sha2(F.concat(*pieces), 256), 1, 8)


def topic_to_table(name: Column | str) -> Column:
    return F.translate(_col(name), ".", "_")


def padded(c: Column | str, width: int) -> Column:
    return F.lpad(_col(c).cast("string"), width, "0")


def pick(values: list[str], index: Column) -> Column:
    """Element of a literal array, counted from 1."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def plus_interval(ts: Column | str, days: Column | int = 0, hours: Column | int = 0) -> Column:
    as_int = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("int")
    return _col(ts) + F.make_dt_interval(as_int(days), as_int(hours))


def recent(ts: Column | str, now: str, minutes: int) -> Column:
    """Within the last minutes before a given "now"."""
    return _col(ts) > F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))


def iso_time(c: Column | str, data_type: str, shortest: bool = True) -> Column:
    """A temporal value as ISO-8601 text: seconds and micros only where they are not zero, or else (not ``shortest``) always, with three or six digits."""
    c = _col(c)
    if data_type == "date":
        return F.date_format(c, "yyyy-MM-dd")
    # the zero offset of an instant is written Z; a local timestamp has none
    zone = "X" if data_type == "timestamp" else ""
    fraction = F.when(F.date_format(c, "SSSSSS").endswith("000"), F.date_format(c, f"yyyy-MM-dd'T'HH:mm:ss.SSS{zone}")) \
        .otherwise(F.date_format(c, f"yyyy-MM-dd'T'HH:mm:ss.SSSSSS{zone}"))
    if not shortest:
        return fraction
    whole = c == F.date_trunc("second", c)
    minute = c == F.date_trunc("minute", c)
    return (F.when(minute, F.date_format(c, f"yyyy-MM-dd'T'HH:mm{zone}"))
            .when(whole, F.date_format(c, f"yyyy-MM-dd'T'HH:mm:ss{zone}")).otherwise(fraction))


def json_value(c: Column | str, path: str = "$") -> Column:
    return F.get_json_object(_col(c), path)
