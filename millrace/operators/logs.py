"""Log records: parsing and the five-way split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import date_of_millis
from .visits import repair_is_new

COMMON = "struct<mid:string,uid:string,vc:string,ch:string,ar:string,is_new:string,ba:string,md:string,os:string>"
PAGE = "struct<page_id:string,last_page_id:string,item:string,item_type:string,during_time:bigint>"
START = "struct<entry:string,loading_time:bigint,open_ad_id:bigint,open_ad_ms:bigint,open_ad_skip_ms:bigint>"
ERR = "struct<error_code:bigint,msg:string>"
LOG = f"common {COMMON}, page {PAGE}, displays array<map<string,string>>, actions array<map<string,string>>, start {START}, err {ERR}, ts bigint"


def parse_logs(df: DataFrame, value: str = "value") -> DataFrame:
    """Columns of LOG and `dirty`: the text of a record that isn't readable JSON, else null."""
    x = F.from_json(F.col(value).cast("string"), LOG + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return df.where(F.col(value).isNotNull()).select(F.col(value).cast("string").alias("_text"), x.alias("c")).select("c.*", F.when(F.col("c._bad").isNotNull() | F.col("c").isNull(), F.col("_text")).alias("dirty")).drop("_bad")


def repair_visitors(logs: DataFrame) -> DataFrame:
    """Readable records with common.is_new repaired."""
    flat = logs.where("dirty is null").withColumns({"mid": F.col("common.mid"), "is_new": F.col("common.is_new"), "date": date_of_millis(F.col("ts"))})
    fixed = repair_is_new(flat)
    return fixed.withColumn("common", F.col("common").withField("is_new", F.col("is_new"))).drop("mid", "is_new", "date")


def split_logs(logs: DataFrame) -> dict[str, DataFrame]:
    """dirty, err, start, display, action and page rows.

    A record with `err` gives one err row (the whole record) and goes on without
    it. One with `start` gives a start row and nothing else. Any other gives its
    displays (each with common, page and ts), its actions (with common and page,
    without ts) and a page row, displays and actions or none.
    """
    good = logs.where("dirty is null")
    err = good.where("err is not null").select("common", "page", "displays", "actions", "start", "err", "ts")
    start = good.where("start is not null").select("common", "start", "ts")
    pages = good.where("start is null")
    return {
        "dirty": logs.where("dirty is not null").select(F.col("dirty").alias("value")),
        "err": err,
        "start": start,
        "display": pages.select("common", "page", F.explode("displays").alias("display"), "ts"),
        "action": pages.select("common", "page", F.explode("actions").alias("action")),
        "page": pages.select("common", "page", "ts"),
    }
