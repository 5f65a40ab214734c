"""Column helpers whose results must agree bit for bit on every path."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = 1_000_000


def round_even(value: Column, digits: int) -> Column:
    """Round half to even on the scaled double; the same rule as numpy's ``round``."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def default_if_null(value: Column, default: float) -> Column:
    return F.coalesce(value.cast("double"), F.lit(float(default)))


def default_if_empty(value: Column, default: float) -> Column:
    """Default for null and for zero."""
    number = value.cast("double")
    return F.when(number.isNull() | (number == 0.0), F.lit(float(default))).otherwise(number)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _session_is_utc() -> bool:
    zone = SparkSession.active().conf.get("spark.sql.session.timeZone")
    return zone in ("UTC", "Etc/UTC", "Z", "GMT", "+00:00")


def epoch_micros(at: Column, dtype: T.DataType) -> Column:
    """Microseconds since 1970, independent of the session zone for zone-less input."""
    if not isinstance(dtype, T.TimestampNTZType) or _session_is_utc():
        return F.unix_micros(at.cast("timestamp"))
    day = F.unix_date(at.cast("date"))
    seconds = F.hour(at) * 3600 + F.minute(at) * 60
    fraction = F.date_part(F.lit("SECOND"), at) * MICROS
    return day.cast("long") * F.lit(86_400 * MICROS) + (
        seconds.cast("long") * F.lit(MICROS) + fraction.cast("long")
    )


def at_micros(micros: Column, dtype: T.DataType) -> Column:
    """The time of ``dtype`` for microseconds since 1970; the inverse of ``epoch_micros``."""
    if not isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_micros(micros)
    # Whole seconds and the rest apart: an interval's seconds are a decimal.
    seconds = (F.pmod(micros, F.lit(86_400 * MICROS)).cast("decimal(20,0)") / MICROS).cast("decimal(18,6)")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / F.lit(86_400 * MICROS)).cast("int"))
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def iso_time(at: Column, dtype: T.DataType) -> Column:
    """ISO-8601 text; an offset is written only for zoned time."""
    zone = "" if isinstance(dtype, T.TimestampNTZType) else "XXX"
    return F.date_format(at, f"yyyy-MM-dd'T'HH:mm:ss.SSSSSS{zone}")


def micros_of(at: dt.datetime) -> int:
    """Microseconds since 1970 of a moment; zone-less input is taken as UTC."""
    aware = at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return (aware - epoch) // dt.timedelta(microseconds=1)


def moment(micros: int, dtype: T.DataType) -> Column:
    """The literal of ``dtype`` for microseconds since 1970."""
    if isinstance(dtype, T.TimestampNTZType):
        at = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=micros)
        return F.lit(at.isoformat(sep=" ", timespec="microseconds")).cast("timestamp_ntz")
    return F.timestamp_micros(F.lit(micros))
