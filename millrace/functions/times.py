"""Time units and formats.

Change records carry seconds, log records milliseconds. Formatting follows the
session zone; parsing is tied to an offset of its own (+08:00 by default).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE, DATETIME, PARTITION = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd"
DAY_MS = 86_400_000


def from_seconds(ts: Column) -> Column:
    return F.timestamp_seconds(ts)


def from_millis(ts: Column) -> Column:
    return F.timestamp_millis(ts)


def date_of_millis(ts: Column) -> Column:
    """yyyy-MM-dd in the session zone."""
    return F.date_format(F.timestamp_millis(ts), DATE)


def datetime_of_millis(ts: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss in the session zone."""
    return F.date_format(F.timestamp_millis(ts), DATETIME)


def partition_of_millis(ts: Column) -> Column:
    """yyyyMMdd in the session zone."""
    return F.date_format(F.timestamp_millis(ts), PARTITION)


def millis_of_datetime(text: Column, offset: str = "+08:00") -> Column:
    """Epoch milliseconds of yyyy-MM-dd HH:mm:ss at a fixed offset."""
    return F.unix_millis(F.to_timestamp(F.concat(text, F.lit(offset)), "yyyy-MM-dd HH:mm:ssXXX"))


def millis_of_date(text: Column, offset: str = "+08:00") -> Column:
    """Epoch milliseconds of the midnight that begins yyyy-MM-dd at a fixed offset."""
    return millis_of_datetime(F.concat(text, F.lit(" 00:00:00")), offset)


def whole_days_between(later_ms: Column, earlier_ms: Column) -> Column:
    """Milliseconds apart, in whole days (integer division)."""
    return F.floor((later_ms - earlier_ms) / DAY_MS)


def today_partition() -> Column:
    """Today as the integer yyyyMMdd."""
    return F.date_format(F.current_date(), PARTITION).cast("int")


def processing_time() -> Column:
    """The time of the micro-batch or query that reads the row, for auditing; results don't hang on it."""
    return F.current_timestamp()
