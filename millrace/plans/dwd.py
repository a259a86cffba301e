"""Fact jobs over change records: each takes parsed changes and returns a fact table.

`changes` are rows of `operators.cdc.parse_changes`; `dic` has dic_code and
dic_name. The functions run on batches; the streaming twins add watermarks
(see `streaming.jobs`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cdc import became, data, grew, of_table, old, project, route_dimensions, route_facts, went
from ..operators.joins import interval_join, lookup_join

MONEY = "decimal(16,2)"


def day(text: Column) -> Column:
    return F.date_format(text, "yyyy-MM-dd")


def _meet(left: DataFrame, right: DataFrame, keys: list[str], near: tuple[str, str] | None) -> DataFrame:
    """Rows with equal keys; with `near`, the right time must be within (before, after) of
    the left one, which lets a stream drop its state."""
    if near is None:
        return left.join(right.drop("et"), keys)
    return interval_join(left, right, keys, *near).drop(*(f"r_{k}" for k in keys), "r_et")


def cart_add(changes: DataFrame) -> DataFrame:
    """Cart insertions, and the growth of a cart line's number."""
    rows = of_table(changes, "cart_info").where((F.col("type") == "insert") | ((F.col("type") == "update") & grew("sku_num")))
    number = F.when(F.col("type") == "insert", data("sku_num")).otherwise((data("sku_num").cast("int") - old("sku_num").cast("int")).cast("string"))
    return rows.select(data("id").alias("id"), data("user_id").alias("user_id"), data("sku_id").alias("sku_id"), number.alias("sku_num"), "ts")


def comment_info(changes: DataFrame, dic: DataFrame) -> DataFrame:
    rows = of_table(changes, "comment_info", "insert").select(*(data(k).alias(k) for k in ("id", "user_id", "sku_id", "appraise", "comment_txt")), "ts")
    return lookup_join(rows, dic, "appraise", "dic_code", "dic_name", "appraise_name").select("id", "user_id", "sku_id", "appraise", "appraise_name", "comment_txt", "ts")


def order_detail(changes: DataFrame) -> DataFrame:
    """Order lines with their order, and their activity and coupon if any."""
    detail = project(
        of_table(changes, "order_detail", "insert"),
        ["id", "order_id", "sku_id", "sku_name", "create_time", "source_id", "source_type", "sku_num", "split_total_amount", "split_activity_amount", "split_coupon_amount"],
        split_original_amount=(data("sku_num").cast(MONEY) * data("order_price").cast(MONEY)).cast("string"),
    )
    info = of_table(changes, "order_info", "insert").select(data("id").alias("order_id"), data("user_id").alias("user_id"), data("province_id").alias("province_id"))
    activity = of_table(changes, "order_detail_activity", "insert").select(data("order_detail_id").alias("id"), data("activity_id").alias("activity_id"), data("activity_rule_id").alias("activity_rule_id"))
    coupon = of_table(changes, "order_detail_coupon", "insert").select(data("order_detail_id").alias("id"), data("coupon_id").alias("coupon_id"))
    out = detail.join(info, "order_id").join(activity, "id", "left").join(coupon, "id", "left").withColumn("date_id", day(F.col("create_time")))
    return out.select(*ORDER_DETAIL)


ORDER_DETAIL = [
    "id", "order_id", "user_id", "sku_id", "sku_name", "province_id", "activity_id", "activity_rule_id", "coupon_id", "date_id", "create_time",
    "sku_num", "split_original_amount", "split_activity_amount", "split_coupon_amount", "split_total_amount", "ts",
]


def order_cancel(changes: DataFrame, detail: DataFrame, near: tuple[str, str] | None = None) -> DataFrame:
    """Lines of orders whose status went from 1001 to 1003."""
    gone = of_table(changes, "order_info", "update").where(went("order_status", "1001", "1003")).select(data("id").alias("order_id"), data("operate_time").alias("cancel_time"), F.col("ts").alias("_ts"), "et")
    out = _meet(gone, detail.drop("date_id", "ts"), ["order_id"], near).withColumns({"date_id": day(F.col("cancel_time")), "ts": F.col("_ts")})
    return out.select(*("cancel_time" if c == "create_time" else c for c in ORDER_DETAIL))


def pay_success(changes: DataFrame, detail: DataFrame, dic: DataFrame) -> DataFrame:
    """Lines of paid orders: created at most 30 minutes before and 5 seconds after the payment."""
    paid = of_table(changes, "payment_info", "update").where(became("payment_status", "1602")).select(
        data("user_id").alias("user_id"), data("order_id").alias("order_id"), data("payment_type").alias("payment_type_code"), data("callback_time").alias("callback_time"), "ts", "et"
    )
    lines = detail.select(*(F.col(c).alias(f"d_{c}") for c in detail.columns if c not in ("date_id", "create_time", "et")), (F.col("et") if "et" in detail.columns else F.timestamp_seconds(F.col("ts"))).alias("d_et"))
    near = (F.col("order_id") == F.col("d_order_id")) & (F.col("d_et") >= F.col("et") - F.expr("interval 30 minutes")) & (F.col("d_et") <= F.col("et") + F.expr("interval 5 seconds"))
    out = lookup_join(paid.join(lines, near), dic, "payment_type_code", "dic_code", "dic_name", "payment_type_name")
    return out.select(
        F.col("d_id").alias("order_detail_id"), "order_id", "user_id", *(F.col(f"d_{c}").alias(c) for c in ("sku_id", "sku_name", "province_id", "activity_id", "activity_rule_id", "coupon_id")),
        "payment_type_code", "payment_type_name", "callback_time", F.col("d_sku_num").alias("sku_num"), *(F.col(f"d_{c}").alias(c) for c in ("split_original_amount", "split_activity_amount", "split_coupon_amount")),
        F.col("d_split_total_amount").alias("split_payment_amount"), "ts",
    )


def order_refund(changes: DataFrame, dic: DataFrame, near: tuple[str, str] | None = None) -> DataFrame:
    """Refund requests of orders whose status became 1005; two look-ups in one dictionary."""
    refund = of_table(changes, "order_refund_info", "insert").select(*(data(k).alias(k) for k in ("id", "user_id", "order_id", "sku_id", "refund_type", "refund_num", "refund_amount", "refund_reason_type", "refund_reason_txt", "create_time")), "ts", "et")
    info = of_table(changes, "order_info", "update").where(became("order_status", "1005")).select(data("id").alias("order_id"), data("province_id").alias("province_id"), "et")
    out = _meet(refund, info, ["order_id"], near)
    out = lookup_join(out, dic, "refund_type", "dic_code", "dic_name", "refund_type_name")
    out = lookup_join(out, dic, "refund_reason_type", "dic_code", "dic_name", "refund_reason_type_name")
    return out.select(
        "id", "user_id", "order_id", "sku_id", "province_id", day(F.col("create_time")).alias("date_id"), "create_time", F.col("refund_type").alias("refund_type_code"), "refund_type_name",
        F.col("refund_reason_type").alias("refund_reason_type_code"), "refund_reason_type_name", "refund_reason_txt", "refund_num", "refund_amount", "ts",
    )


def refund_pay_success(changes: DataFrame, dic: DataFrame, near: tuple[str, str] | None = None) -> DataFrame:
    """Refunds that were paid, with the refunded line and its order."""
    paid = of_table(changes, "refund_payment", "update").where(became("refund_status", "1602")).select(*(data(k).alias(k) for k in ("id", "order_id", "sku_id", "payment_type", "callback_time", "total_amount")), "ts", "et")
    line = of_table(changes, "order_refund_info", "update").where(became("refund_status", "0705")).select(*(data(k).alias(k) for k in ("order_id", "sku_id", "refund_num")), "et")
    info = of_table(changes, "order_info", "update").where(became("order_status", "1006")).select(data("id").alias("order_id"), data("user_id").alias("user_id"), data("province_id").alias("province_id"), "et")
    out = lookup_join(_meet(_meet(paid, line, ["order_id", "sku_id"], near), info, ["order_id"], near), dic, "payment_type", "dic_code", "dic_name", "payment_type_name")
    return out.select("id", "user_id", "order_id", "sku_id", "province_id", F.col("payment_type").alias("payment_type_code"), "payment_type_name", day(F.col("callback_time")).alias("date_id"), "callback_time", "refund_num", F.col("total_amount").alias("refund_amount"), "ts")


def dim_routing(changes: DataFrame, config: DataFrame) -> DataFrame:
    return route_dimensions(changes, config)


def fact_routing(changes: DataFrame, config: DataFrame) -> DataFrame:
    return route_facts(changes, config)
