"""Streaming twins of the warehouse jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.strings import is_empty
from ..functions.times import from_seconds
from ..operators.cdc import current_config, dimension_gate, of_table, parse_changes, project, route_dimensions
from ..operators.joins import enrich
from ..operators.logs import parse_logs, split_logs
from ..operators.visits import is_login
from ..operators.windows import distinct_in_stream, tumble
from ..plans import dwd, dws
from ..plans.dwd import ORDER_DETAIL, day
from ..sources import sinks
from . import stateful


def split_to_folders(lines: DataFrame, path: str, checkpoint: str, repair: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """The five-way log split: records are parsed once a batch, then written per topic."""

    def write(df: DataFrame, batch: int) -> None:
        logs = parse_logs(df)
        if repair is not None:
            logs = repair(logs)
        logs = logs.persist()
        try:
            for topic, rows in split_logs(logs).items():
                rows.write.mode("overwrite").parquet(f"{path}/{topic}/batch={batch}")
        finally:
            logs.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def order_detail_stream(changes: DataFrame, delay: str = "3 seconds", keep: str = "10 seconds") -> DataFrame:
    """Order lines from a stream of changes: inner, then two left joins.

    Both sides of each join have a watermark and a bound on event time, so state
    is dropped after `keep`; an unmatched left row comes out once, at that time.
    """
    c = changes.withWatermark("et", delay)
    money = "decimal(16,2)"
    total = (F.col("data")["sku_num"].cast(money) * F.col("data")["order_price"].cast(money)).cast("string")
    detail = project(of_table(c, "order_detail", "insert"), ["id", "order_id", "sku_id", "sku_name", "create_time", "sku_num", "split_total_amount", "split_activity_amount", "split_coupon_amount"], split_original_amount=total)

    def side(table: str, keys: dict[str, str], tag: str) -> DataFrame:
        return of_table(c, table, "insert").select(*(F.col("data")[k].alias(v) for k, v in keys.items()), F.col("et").alias(f"{tag}_et"))

    near = lambda tag: F.expr(f"{tag}_et between et - interval {keep} and et + interval {keep}")
    info = side("order_info", {"id": "i_order", "user_id": "user_id", "province_id": "province_id"}, "i")
    activity = side("order_detail_activity", {"order_detail_id": "a_id", "activity_id": "activity_id", "activity_rule_id": "activity_rule_id"}, "a")
    coupon = side("order_detail_coupon", {"order_detail_id": "c_id", "coupon_id": "coupon_id"}, "c")
    out = detail.join(info, (F.col("order_id") == F.col("i_order")) & near("i"))
    out = out.join(activity, (F.col("id") == F.col("a_id")) & near("a"), "left")
    out = out.join(coupon, (F.col("id") == F.col("c_id")) & near("c"), "left")
    return out.withColumn("date_id", day(F.col("create_time"))).select(*ORDER_DETAIL, "et")


def order_cancel_stream(changes: DataFrame, detail: DataFrame, delay: str = "3 seconds", before: str = "1805 seconds") -> DataFrame:
    """Lines of cancelled orders; `detail` is a stream of lines with et and a watermark."""
    return dwd.order_cancel(changes.withWatermark("et", delay), detail, (before, "5 seconds"))


def pay_success_stream(changes: DataFrame, detail: DataFrame, dic: DataFrame, delay: str = "3 seconds") -> DataFrame:
    """Lines of paid orders: an interval join of two streams, and a look-up in a table."""
    return dwd.pay_success(changes.withWatermark("et", delay), detail, dic)


def order_refund_stream(changes: DataFrame, dic: DataFrame, delay: str = "3 seconds", near: str = "5 seconds") -> DataFrame:
    return dwd.order_refund(changes.withWatermark("et", delay), dic, (near, near))


def refund_pay_stream(changes: DataFrame, dic: DataFrame, delay: str = "3 seconds", near: str = "5 seconds") -> DataFrame:
    return dwd.refund_pay_success(changes.withWatermark("et", delay), dic, (near, near))


def keyword_stream(pages: DataFrame, size: str = dws.SIZE, dictionary: tuple[str, ...] = ()) -> DataFrame:
    """Searches by keyword; the batch job runs on a stream as it is."""
    return dws.keyword_page_view(pages, size, dictionary)


def traffic_stream(pages: DataFrame, size: str = dws.SIZE) -> DataFrame:
    """Unique visitors, sessions, views and durations by version, channel, area and newness."""
    x = stateful.first_of_day(dws.page_views(pages), ["mid"])
    count = lambda c: F.sum(F.when(c, 1).otherwise(0).cast("long"))
    return tumble(x, "et", size, ["vc", "ch", "ar", "is_new"], uv_ct=count(F.col("first")), sv_ct=count(is_empty(F.col("last_page_id"))), pv_ct=F.count("*"), dur_sum=F.sum("during_time"))


def home_detail_stream(pages: DataFrame, size: str = dws.SIZE) -> DataFrame:
    """Daily unique visitors of the home page and of product pages."""
    x = stateful.first_of_day(dws.page_views(pages).where(F.col("page_id").isin("home", "good_detail")), ["mid", "page_id"]).where("first")
    one = lambda p: F.sum((F.col("page_id") == p).cast("long"))
    return tumble(x, "et", size, [], home_uv_ct=one("home"), good_detail_uv_ct=one("good_detail"))


def user_login_stream(pages: DataFrame, size: str = dws.SIZE) -> DataFrame:
    """Users that logged in, and those back after eight days or more."""
    x = dws.page_views(pages).where(is_login(F.col("uid"), F.col("last_page_id")))
    return tumble(stateful.logins(x), "et", size, [], back_ct=F.sum("back_ct"), uu_ct=F.sum("uu_ct"))


def _line_versions(detail: DataFrame, *columns: str) -> DataFrame:
    """What versions of order lines add and take back: `columns`, sign and et; lines that
    have an et have its watermark, too."""
    if "et" not in detail.columns:
        detail = detail.withColumn("et", from_seconds(F.col("ts"))).withWatermark("et", "0 seconds")
    body = F.struct(*(F.col(c).cast("string").alias(c) for c in columns))
    out = stateful.versions(detail.select(F.col("id").cast("string").alias("id"), F.to_json(body).alias("body"), F.col("split_total_amount").cast(dws.AMOUNT).alias("amount"), "et"))
    return out.select(F.from_json("body", ", ".join(f"{c} string" for c in columns)).alias("v"), "sign", "et").select("v.*", "sign", "et")


def province_order_stream(detail: DataFrame, province: DataFrame | None = None, size: str = dws.SIZE) -> DataFrame:
    """Orders and amounts per window and province; lines count by their last version."""
    x = _line_versions(detail, "order_id", "province_id", "split_total_amount")
    amount = F.col("split_total_amount").cast(dws.AMOUNT) * F.col("sign")
    out = tumble(x, "et", size, ["province_id"], order_count=distinct_in_stream(F.col("order_id")), order_amount=F.sum(amount).cast(dws.AMOUNT))
    return out if province is None else enrich(out, province, "province_id", "id", {"name": "province_name"})


def sku_order_stream(detail: DataFrame, size: str = dws.SIZE) -> DataFrame:
    """Amounts by product; `dws.with_product` adds the dimensions to each micro-batch."""
    x = _line_versions(detail, "sku_id", "split_original_amount", "split_activity_amount", "split_coupon_amount", "split_total_amount")
    money = lambda c: F.sum(F.coalesce(F.col(c).cast(dws.AMOUNT) * F.col("sign"), F.lit(0).cast(dws.AMOUNT))).cast(dws.AMOUNT)
    return tumble(x, "et", size, ["sku_id"], original_amount=money("split_original_amount"), activity_reduce_amount=money("split_activity_amount"), coupon_reduce_amount=money("split_coupon_amount"), order_amount=money("split_total_amount"))


def daily_users_stream(rows: DataFrame, user: str, size: str = dws.SIZE) -> DataFrame:
    """Users per window, each once a day; `rows` has et and date. A user's state goes after a day."""
    once = stateful.first_of_day(rows.withWatermark("et", "0 seconds"), [user]).where("first")
    return tumble(once, "et", size, [], cart_add_uu_ct=F.count("*"))


def dimension_stream(lines: DataFrame, config: Callable[[], DataFrame], database: str, path: str, checkpoint: str, apply: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Dimension rows from a stream of changes, under a configuration that lives.

    `config` gives all configuration changes (source_table, sink_table, sink_columns,
    sink_row_key, op, ts_ms) as they are at the time; each micro-batch reads them anew,
    hands them to `apply` (which creates and drops tables), and routes by what is in force.
    """
    merge = sinks.dimension_merge(path)

    def write(df: DataFrame, batch: int) -> None:
        changes = config()
        if apply is not None:
            apply(changes)
        routed = route_dimensions(dimension_gate(parse_changes(df), database), current_config(changes, "source_table"))
        merge(routed.withColumn("seq", F.struct("ts", F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("n"))), batch)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(df: DataFrame, path: str, checkpoint: str, seconds: int = 120) -> None:
    """Run a stream over all that is there into a Parquet folder, for at most so long."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    try:
        if not q.awaitTermination(seconds):
            raise TimeoutError(f"the stream didn't end within {seconds} s")
    finally:
        q.stop()
