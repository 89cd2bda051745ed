"""Reading the tables and the meaning of their ids and instants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table of a data directory. ``timestamp_ntz`` columns become instants (the session's zone is UTC)."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    naive = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def clean_id(column: str | Column) -> Column:
    """The comparable form of an id: blanks (U+0020) off both ends, lower case; null for null, empty and blank."""
    value = F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
    return F.when(value != "", value)


def floor_div(micros: Column, unit: int) -> Column:
    """Whole units since the epoch, rounding down also before 1970."""
    return F.call_function("div", micros - F.pmod(micros, F.lit(unit)), F.lit(unit))


def utc_day(instant: str | Column) -> Column:
    """Days since the epoch (int) of the instant's UTC day."""
    micros = F.unix_micros(F.col(instant) if isinstance(instant, str) else instant)
    return floor_div(micros, MICROS_PER_DAY).cast("int")


def utc_hour(instant: str | Column) -> Column:
    """Hours since the epoch (bigint) of the instant's UTC hour."""
    micros = F.unix_micros(F.col(instant) if isinstance(instant, str) else instant)
    return floor_div(micros, MICROS_PER_HOUR).cast("bigint")


def day_text(day: Column) -> Column:
    """``YYYY-MM-DD`` of days since the epoch."""
    return F.date_from_unix_date(day).cast("string")


def hour_instant(hour: Column) -> Column:
    """The instant at which an hour since the epoch begins."""
    return F.timestamp_micros(hour * F.lit(MICROS_PER_HOUR))
