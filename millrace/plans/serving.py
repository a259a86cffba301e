"""Daily summaries served from result tables partitioned by cur_date.

The tables are Parquet folders written by `sources.sinks.append_by_date`; a
date filter on `cur_date` prunes partitions.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the measures in the answers.
AMOUNT_NAME, CHANNEL_NAME = "交易额", "渠道"


def _day(spark: SparkSession, path: str, date: int) -> DataFrame:
    """Rows of one day, given as yyyyMMdd; 0 is today."""
    day = F.to_date(F.lit(str(date)), "yyyyMMdd") if date else F.current_date()
    return spark.read.parquet(path).where(F.col("cur_date").cast("date") == day)


def gmv(spark: SparkSession, provinces: str, date: int = 0) -> DataFrame:
    """(order_amount) of a day; null if there is none."""
    return _day(spark, provinces, date).agg(F.sum("order_amount").alias("order_amount"))


def province_amounts(spark: SparkSession, provinces: str, date: int = 0) -> DataFrame:
    """(province_name, order_amount) of a day."""
    return _day(spark, provinces, date).groupBy("province_name").agg(F.sum("order_amount").alias("order_amount"))


def top_channels(spark: SparkSession, traffic: str, date: int = 0, limit: int = 10) -> DataFrame:
    """(ch, uv_ct) of the channels with most unique visitors; ties by name."""
    return _day(spark, traffic, date).groupBy("ch").agg(F.sum("uv_ct").alias("uv_ct")).orderBy(F.desc("uv_ct"), "ch").limit(limit)


def gmv_json(df: DataFrame) -> str:
    row = df.first()
    value = row.order_amount if row else None
    return json.dumps({"status": 0, "data": None if value is None else float(value)})


def province_json(df: DataFrame) -> str:
    rows = [{"name": r.province_name, "value": float(r.order_amount)} for r in df.orderBy("province_name").toLocalIterator()]
    return json.dumps({"status": 0, "data": {"mapData": rows, "valueName": AMOUNT_NAME}}, ensure_ascii=False)


def channel_json(df: DataFrame) -> str:
    rows = df.collect()  # at most `limit` rows
    return json.dumps({"status": 0, "data": {"categories": [r.ch for r in rows], "series": [{"name": CHANNEL_NAME, "data": [int(r.uv_ct) for r in rows]}]}}, ensure_ascii=False)


def routes(spark: SparkSession, provinces: str, traffic: str) -> Callable[[str], str | None]:
    """What the service answers to a path: /gmv, /province and /ch, each with an optional
    date (yyyyMMdd; today without one), /ch with a limit, too. Other paths have no answer."""

    def answer(url: str) -> str | None:
        parts = urlsplit(url)
        given = {k: int(v[-1]) for k, v in parse_qs(parts.query).items() if k in ("date", "limit")}
        date = given.get("date", 0)
        if parts.path == "/gmv":
            return gmv_json(gmv(spark, provinces, date))
        if parts.path == "/province":
            return province_json(province_amounts(spark, provinces, date))
        if parts.path == "/ch":
            return channel_json(top_channels(spark, traffic, date, given.get("limit", 10)))
        return None

    return answer


def server(answer: Callable[[str], str | None], port: int = 8070, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """An HTTP server of the routes; `serve_forever` runs it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            try:
                body, status = answer(self.path), 200
            except ValueError:
                body, status = None, 400
            body, status = ("{}", 404 if status == 200 else status) if body is None else (body, status)
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
