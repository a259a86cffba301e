"""Windowed summaries over fact tables, with the names and columns of the warehouse's results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import is_empty
from ..functions.text import explode_keywords
from ..functions.times import date_of_millis, from_millis, from_seconds
from ..operators.dedup import latest
from ..operators.joins import enrich, snowflake
from ..operators.visits import daily_users, first_of_day, is_login, logins, traffic_measures
from ..operators.windows import tumble

SIZE = "10 seconds"
AMOUNT = "decimal(38,4)"


def page_views(pages: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Page rows with their fields flat, `et` and `date`; of a stream, with a watermark."""
    fields = {"mid": "common.mid", "uid": "common.uid", "vc": "common.vc", "ch": "common.ch", "ar": "common.ar", "is_new": "common.is_new"}
    fields |= {x: f"page.{x}" for x in ("page_id", "last_page_id", "item", "item_type", "during_time")}
    out = pages.select(*(F.col(p).alias(n) for n, p in fields.items()), "ts", from_millis(F.col("ts")).alias("et"), date_of_millis(F.col("ts")).alias("date"))
    return out.withWatermark("et", delay) if pages.isStreaming else out


def keyword_page_view(pages: DataFrame, size: str = SIZE, dictionary: tuple[str, ...] = ()) -> DataFrame:
    """Searches counted by keyword."""
    found = page_views(pages).where((F.col("last_page_id") == "search") & (F.col("item_type") == "keyword") & F.col("item").isNotNull())
    return tumble(explode_keywords(found, "item", "keyword", dictionary), "et", size, ["keyword"], keyword_count=F.count("*"))


def traffic_page_view(pages: DataFrame, size: str = SIZE) -> DataFrame:
    """Unique visitors, sessions, views and durations by version, channel, area and newness."""
    dims = ["vc", "ch", "ar", "is_new"]
    x = traffic_measures(page_views(pages), dims, "mid", "date", "et", ["ts", "page_id"], is_empty(F.col("last_page_id")), F.col("during_time"))
    return tumble(x, "et", size, dims, uv_ct=F.sum("uv_ct"), sv_ct=F.sum("sv_ct"), pv_ct=F.sum("pv_ct"), dur_sum=F.sum("dur_sum"))


def home_detail_page_view(pages: DataFrame, size: str = SIZE) -> DataFrame:
    """Daily unique visitors of the home page and of product pages, apart from each other."""
    x = page_views(pages).where(F.col("page_id").isin("home", "good_detail"))
    firsts = first_of_day(x, ["mid", "page_id", "date"], ["ts"], ["et"])
    one = lambda p: F.sum((F.col("page_id") == p).cast("long"))
    return tumble(firsts, "et", size, [], home_uv_ct=one("home"), good_detail_uv_ct=one("good_detail"))


def user_login(pages: DataFrame, size: str = SIZE) -> DataFrame:
    """Users that logged in, and those back after eight days or more."""
    x = page_views(pages).where(is_login(F.col("uid"), F.col("last_page_id")))
    return tumble(logins(x, "uid", "date", "et"), "et", size, [], back_ct=F.sum("back_ct"), uu_ct=F.sum("uu_ct"))


def cart_add_users(cart_add: DataFrame, size: str = SIZE) -> DataFrame:
    """Users that added to a cart, each once a day."""
    x = cart_add.withColumns({"et": from_seconds(F.col("ts")), "date": F.date_format(from_seconds(F.col("ts")), "yyyy-MM-dd")})
    return tumble(daily_users(x, "user_id", "date", "et"), "et", size, [], cart_add_uu_ct=F.count("*"))


def _last_lines(detail: DataFrame, *columns: str) -> DataFrame:
    """The last version of each line by time, then by amount as a number, with `et`;
    only what is needed travels."""
    total = F.col("split_total_amount").cast(AMOUNT).alias("split_total_amount")
    return latest(detail.select("id", "ts", total, *columns), ["id"], ["ts", "split_total_amount"]).withColumn("et", from_seconds(F.col("ts")))


def province_order(detail: DataFrame, province: DataFrame, size: str = SIZE) -> DataFrame:
    """Orders and amounts by province; repeated lines count once, with their last version."""
    x = _last_lines(detail, "province_id", "order_id")
    # one row per order first: the distinct count becomes a sum
    orders = x.groupBy("province_id", "order_id", F.window("et", size).alias("w")).agg(F.sum("split_total_amount").alias("amount"))
    orders = orders.select("province_id", "amount", F.col("w.start").alias("et"))
    out = tumble(orders, "et", size, ["province_id"], order_count=F.count("*"), order_amount=F.sum("amount"))
    named = enrich(out, province, "province_id", "id", {"name": "province_name"}).withColumn("province_name", F.coalesce("province_name", F.lit("")))
    return named.select("stt", "edt", "cur_date", "province_id", "province_name", "order_count", "order_amount")


def sku_order(detail: DataFrame, dims: dict[str, DataFrame], size: str = SIZE) -> DataFrame:
    """Amounts by product, summed before the chain of dimension joins."""
    x = _last_lines(detail, "sku_id", "split_original_amount", "split_activity_amount", "split_coupon_amount")
    money = lambda c: F.sum(F.coalesce(F.col(c).cast(AMOUNT), F.lit(0).cast(AMOUNT)))
    out = tumble(x, "et", size, ["sku_id"], original_amount=money("split_original_amount"), activity_reduce_amount=money("split_activity_amount"), coupon_reduce_amount=money("split_coupon_amount"), order_amount=money("split_total_amount"))
    return with_product(out, dims)


def with_product(sums: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Sums by sku_id with the product, its group, its trademark and its categories."""
    out = snowflake(
        sums,
        (dims["sku"], "sku_id", "id", {"sku_name": "sku_name", "spu_id": "spu_id", "category3_id": "category3_id", "tm_id": "trademark_id"}),
        (dims["spu"], "spu_id", "id", {"spu_name": "spu_name"}),
        (dims["trademark"], "trademark_id", "id", {"tm_name": "trademark_name"}),
        (dims["category3"], "category3_id", "id", {"name": "category3_name", "category2_id": "category2_id"}),
        (dims["category2"], "category2_id", "id", {"name": "category2_name", "category1_id": "category1_id"}),
        (dims["category1"], "category1_id", "id", {"name": "category1_name"}),
    )
    return out.select(
        "stt", "edt", "cur_date", "trademark_id", "trademark_name", "category1_id", "category1_name", "category2_id", "category2_name", "category3_id", "category3_name",
        "sku_id", "sku_name", "spu_id", "spu_name", "original_amount", "activity_reduce_amount", "coupon_reduce_amount", "order_amount",
    )
