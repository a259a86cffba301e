"""Visitors: new-visitor repair, daily uniques, log-ins and back-flow, cart users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.strings import is_empty, not_empty


def repair_is_new(df: DataFrame, mid: str = "mid", is_new: str = "is_new", date: str = "date", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """is_new='1' becomes '0' where the visitor's first-visit date is another day.

    The date is set by the visitor's first record: its own day if that record
    says new, else the day before; it never changes afterwards. It is a
    pre-aggregated minimum that is joined back, so busy visitors don't fill a task.
    """
    first = df.groupBy(mid).agg(F.min_by(F.struct(is_new, date), F.struct(*order)).alias("_first"))
    seen = F.when(F.col(f"_first.{is_new}") == "1", F.col(f"_first.{date}")).otherwise(F.date_format(F.date_sub(F.col(f"_first.{date}").cast("date"), 1), "yyyy-MM-dd"))
    fixed = F.when((F.col(is_new) == "1") & (seen != F.col(date)), F.lit("0")).otherwise(F.col(is_new))
    return df.join(first, mid, "left").withColumn(is_new, fixed).select(*df.columns)


def first_of_day(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The first row of each key by order, as keys, order and kept columns."""
    cols = list(dict.fromkeys([*order, *keep]))
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("f"))
    return best.select(*keys, *(F.col(f"f.{c}").alias(c) for c in cols if c not in keys))


def traffic_measures(df: DataFrame, dims: list[str], mid: str, date: str, time: str, order: list[str], starts: Column, during: Column) -> DataFrame:
    """Contributions (dims, time, uv_ct, sv_ct, pv_ct, dur_sum) of page views.

    Every view counts a page and its duration, a session where `starts`; a
    visitor's first view of a day counts a unique visitor as a row of its own.
    """
    views = df.select(*dims, time, F.lit(0).cast("long").alias("uv_ct"), F.when(starts, 1).otherwise(0).cast("long").alias("sv_ct"), F.lit(1).cast("long").alias("pv_ct"), during.alias("dur_sum"))
    firsts = first_of_day(df, [mid, date], order, [*dims, time])
    kind = views.schema["dur_sum"].dataType
    unique = firsts.select(*dims, time, F.lit(1).cast("long").alias("uv_ct"), F.lit(0).cast("long").alias("sv_ct"), F.lit(0).cast("long").alias("pv_ct"), F.lit(0).cast(kind).alias("dur_sum"))
    return views.unionByName(unique)


def is_login(uid: Column, last_page: Column) -> Column:
    """A view by a known user that follows the log-in page or none at all."""
    return not_empty(uid) & (is_empty(last_page) | (last_page == "login"))


def logins(df: DataFrame, uid: str, date: str, time: str, gap_days: int = 8) -> DataFrame:
    """(uid, date, time, uu_ct, back_ct): each user's first log-in of a day.

    uu_ct is 1; back_ct is 1 if at least `gap_days` whole days lie between the
    midnight of the previous log-in day and this log-in. One row per user and day
    enters the window, so a busy user's rows stay few.
    """
    days = df.groupBy(uid, date).agg(F.min(time).alias(time))
    before = F.lag(date).over(Window.partitionBy(uid).orderBy(time))
    gap = F.datediff(F.col(time).cast("date"), F.col("_before").cast("date"))
    return days.withColumn("_before", before).select(uid, date, time, F.lit(1).cast("long").alias("uu_ct"), F.when(gap >= gap_days, 1).otherwise(0).cast("long").alias("back_ct"))


def daily_users(df: DataFrame, user: str, date: str, time: str) -> DataFrame:
    """(user, date, time): each user's first row of a day."""
    return df.groupBy(user, date).agg(F.min(time).alias(time))
