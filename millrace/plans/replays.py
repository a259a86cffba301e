"""The fact and summary jobs over change and log records built from the fixtures, each with its SQL.

The queries of `catalogue` show an operator each; these run the jobs of `dwd` and
`dws` as they stand, from JSON lines to result columns.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cdc import bad_records, config_rows, current_config, dimension_gate, fact_gate, parse_changes
from ..operators.logs import parse_logs, split_logs
from ..sources.sinks import keyed, latest_per_key
from . import dwd, dws
from .catalogue import _SHORT, MONEY, query, read

_DIC = [("1101", "account"), ("1102", "bank"), ("1103", "card"), ("1201", "good"), ("1202", "fair"), ("1203", "bad"), ("1301", "late"), ("1302", "broken"), ("1501", "refund"), ("1502", "return")]
_DIC_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _DIC) + ") dic(dic_code, dic_name)"


def _dic(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_DIC, "dic_code string, dic_name string")


def _text(c: Column) -> Column:
    return c.cast("string")


def _time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _seconds(c: Column) -> Column:
    return F.unix_timestamp(c.cast("timestamp"))


def _money(name: str) -> Column:
    return _text(F.col(name).cast(MONEY))


def _records(df: DataFrame, table: str, kind: str, ts: Column, data: dict[str, Column], old: dict[str, Column] | None = None) -> DataFrame:
    """One JSON line (value) per row."""
    as_map = lambda fields: F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))))
    parts = [F.lit("shop").alias("database"), F.lit(table).alias("table"), F.lit(kind).alias("type"), ts.alias("ts"), as_map(data).alias("data")]
    return df.select(F.to_json(F.struct(*parts, *([as_map(old).alias("old")] if old else []))).alias("value"))


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").withColumns({"id": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "ts": _seconds(F.col("l_shipdate"))})


def _detail(spark: SparkSession, d: str) -> DataFrame:
    """Order lines by `dwd.order_detail`."""
    lines, orders = _lines(spark, d), read(spark, d, "orders").where("o_orderkey % 3 <> 0")
    price = _money("l_extendedprice")
    fields = {"id": F.col("id"), "order_id": F.col("l_orderkey"), "sku_id": F.col("l_partkey"), "sku_name": F.concat(F.lit("sku"), _text(F.col("l_partkey"))), "create_time": _time(F.col("l_shipdate")), "sku_num": F.col("l_quantity").cast("int"), "order_price": price, "split_total_amount": price, "split_activity_amount": _money("l_discount"), "split_coupon_amount": _money("l_tax")}
    changes = _union(
        _records(lines, "order_detail", "insert", F.col("ts"), fields),
        _records(orders, "order_info", "insert", _seconds(F.col("o_orderdate")), {"id": F.col("o_orderkey"), "user_id": F.col("o_custkey"), "province_id": F.col("o_custkey") % 34}),
        _records(lines.where("l_partkey % 4 = 0"), "order_detail_activity", "insert", F.col("ts"), {"order_detail_id": F.col("id"), "activity_id": F.col("l_partkey") % 8, "activity_rule_id": F.col("l_linenumber")}),
        _records(lines.where("l_suppkey % 5 = 0"), "order_detail_coupon", "insert", F.col("ts"), {"order_detail_id": F.col("id"), "coupon_id": F.col("l_suppkey")}),
    )
    return dwd.order_detail(parse_changes(changes))


_LINE = "SELECT *, cast(l_orderkey * 10 + l_linenumber AS varchar) AS id, epoch(l_shipdate)::BIGINT AS ts, cast(cast(l_extendedprice AS decimal(16,2)) AS varchar) AS price FROM lineitem"
_DETAIL = f"""SELECT l.id, cast(l_orderkey AS varchar) AS order_id, cast(o_custkey AS varchar) AS user_id, cast(l_partkey AS varchar) AS sku_id, 'sku' || l_partkey AS sku_name, cast(o_custkey % 34 AS varchar) AS province_id,
  a.activity_id, a.activity_rule_id, c.coupon_id, strftime(l_shipdate, '%Y-%m-%d') AS date_id, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS create_time, cast(cast(l_quantity AS int) AS varchar) AS sku_num,
  cast(cast(cast(l_quantity AS int) AS decimal(16,2)) * cast(price AS decimal(16,2)) AS varchar) AS split_original_amount, cast(cast(l_discount AS decimal(16,2)) AS varchar) AS split_activity_amount,
  cast(cast(l_tax AS decimal(16,2)) AS varchar) AS split_coupon_amount, price AS split_total_amount, l.ts
FROM ({_LINE}) l JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 3 <> 0
LEFT JOIN (SELECT id, cast(l_partkey % 8 AS varchar) AS activity_id, cast(l_linenumber AS varchar) AS activity_rule_id FROM ({_LINE}) WHERE l_partkey % 4 = 0) a ON a.id = l.id
LEFT JOIN (SELECT id, cast(l_suppkey AS varchar) AS coupon_id FROM ({_LINE}) WHERE l_suppkey % 5 = 0) c ON c.id = l.id"""


@query(_DETAIL)
def job_order_detail(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with order, activity and coupon."""
    return _detail(spark, d)


@query(f"""SELECT d.* EXCLUDE (create_time) REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS date_id, epoch(o_orderdate)::BIGINT + 60 AS ts), strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS cancel_time
FROM ({_DETAIL}) d JOIN orders ON cast(o_orderkey AS varchar) = d.order_id WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0""")
def job_order_cancel(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders that went from 1001 to 1003, and from no other status."""
    orders = read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "1003").otherwise("1004")
    changes = _records(orders, "order_info", "update", _seconds(F.col("o_orderdate")) + 60, {"id": F.col("o_orderkey"), "order_status": status, "operate_time": _time(F.col("o_orderdate"))}, {"order_status": F.when(F.col("o_custkey") % 2 == 0, "1001").otherwise("1002")})
    return dwd.order_cancel(parse_changes(changes), _detail(spark, d))


@query(f"""WITH p AS (SELECT cast(l_suppkey AS varchar) AS user_id, cast(l_orderkey AS varchar) AS order_id, '110' || (l_partkey % 4 + 1) AS code, ts + l_partkey % 4 * 900 AS ts, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS callback_time
  FROM ({_LINE}) WHERE l_linenumber = 1 AND l_suppkey % 2 = 0)
SELECT d.id AS order_detail_id, p.order_id, p.user_id, sku_id, sku_name, province_id, activity_id, activity_rule_id, coupon_id, code AS payment_type_code, dic_name AS payment_type_name, callback_time, sku_num,
  split_original_amount, split_activity_amount, split_coupon_amount, split_total_amount AS split_payment_amount, p.ts
FROM p JOIN ({_DETAIL}) d ON d.order_id = p.order_id AND d.ts BETWEEN p.ts - 1800 AND p.ts + 5 JOIN {_DIC_SQL} ON dic_code = code""")
def job_pay_success(spark: SparkSession, d: str) -> DataFrame:
    """Lines of payments that became 1602, by an interval of event time."""
    lines = _lines(spark, d).where("l_linenumber = 1")
    paid = {"user_id": F.col("l_suppkey"), "order_id": F.col("l_orderkey"), "payment_type": F.concat(F.lit("110"), _text(F.col("l_partkey") % 4 + 1)), "callback_time": _time(F.col("l_shipdate")), "payment_status": F.when(F.col("l_suppkey") % 2 == 0, "1602").otherwise("1601")}
    changes = _records(lines, "payment_info", "update", F.col("ts") + F.col("l_partkey") % 4 * 900, paid, {"payment_status": F.lit("1601")})
    return dwd.pay_success(parse_changes(changes), _detail(spark, d), _dic(spark))


_REFUND = {"type": "'150' || (l_linenumber % 3 + 1)", "reason": "'130' || (l_partkey % 2 + 1)"}


@query(f"""SELECT l.id, cast(l_suppkey AS varchar) AS user_id, cast(l_orderkey AS varchar) AS order_id, cast(l_partkey AS varchar) AS sku_id, cast(o_custkey % 34 AS varchar) AS province_id, strftime(l_shipdate, '%Y-%m-%d') AS date_id,
  strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS create_time, {_REFUND["type"]} AS refund_type_code, a.dic_name AS refund_type_name, {_REFUND["reason"]} AS refund_reason_type_code, b.dic_name AS refund_reason_type_name,
  'why ' || l.id AS refund_reason_txt, cast(cast(l_quantity AS int) AS varchar) AS refund_num, price AS refund_amount, l.ts
FROM ({_LINE}) l JOIN orders ON o_orderkey = l_orderkey JOIN {_DIC_SQL.replace(" dic(", " a(")} ON a.dic_code = {_REFUND["type"]} JOIN {_DIC_SQL.replace(" dic(", " b(")} ON b.dic_code = {_REFUND["reason"]}
WHERE l_returnflag = 'R' AND o_orderstatus <> 'O'""")
def job_order_refund(spark: SparkSession, d: str) -> DataFrame:
    """Refund requests of orders that became 1005, with two look-ups in one dictionary."""
    lines, orders = _lines(spark, d).where("l_returnflag = 'R'"), read(spark, d, "orders")
    fields = {"id": F.col("id"), "user_id": F.col("l_suppkey"), "order_id": F.col("l_orderkey"), "sku_id": F.col("l_partkey"), "refund_type": F.expr(_REFUND["type"]), "refund_num": F.col("l_quantity").cast("int"), "refund_amount": _money("l_extendedprice"), "refund_reason_type": F.expr(_REFUND["reason"]), "refund_reason_txt": F.concat(F.lit("why "), _text(F.col("id"))), "create_time": _time(F.col("l_shipdate"))}
    changes = _union(
        _records(lines, "order_refund_info", "insert", F.col("ts"), fields),
        _records(orders, "order_info", "update", _seconds(F.col("o_orderdate")), {"id": F.col("o_orderkey"), "province_id": F.col("o_custkey") % 34, "order_status": F.when(F.col("o_orderstatus") == "O", "1004").otherwise("1005")}, {"order_status": F.lit("1002")}),
        # a change of another column, and an insertion, are no change to 1005
        _records(orders, "order_info", "update", _seconds(F.col("o_orderdate")), {"id": F.col("o_orderkey"), "province_id": F.lit("x"), "order_status": F.lit("1005")}, {"operate_time": F.lit("y")}),
        _records(orders, "order_info", "insert", _seconds(F.col("o_orderdate")), {"id": F.col("o_orderkey"), "province_id": F.lit("x"), "order_status": F.lit("1005")}),
    )
    return dwd.order_refund(parse_changes(changes), _dic(spark))


@query(f"""WITH r AS (SELECT * FROM ({_LINE}) WHERE l_returnflag = 'R')
SELECT p.id, cast(o_custkey AS varchar) AS user_id, cast(p.l_orderkey AS varchar) AS order_id, cast(p.l_partkey AS varchar) AS sku_id, cast(o_custkey % 34 AS varchar) AS province_id, '110' || (p.l_partkey % 4 + 1) AS payment_type_code, dic_name AS payment_type_name,
  strftime(p.l_shipdate, '%Y-%m-%d') AS date_id, strftime(p.l_shipdate, '%Y-%m-%d %H:%M:%S') AS callback_time, cast(cast(r.l_quantity AS int) AS varchar) AS refund_num, p.price AS refund_amount, p.ts
FROM r p JOIN r ON r.l_orderkey = p.l_orderkey AND r.l_partkey = p.l_partkey JOIN orders ON o_orderkey = p.l_orderkey JOIN {_DIC_SQL} ON dic_code = '110' || (p.l_partkey % 4 + 1) WHERE p.l_linenumber <= 2 AND o_orderstatus = 'O'""")
def job_refund_pay(spark: SparkSession, d: str) -> DataFrame:
    """Refunds that were paid, with the refunded line and its order."""
    lines, orders = _lines(spark, d).where("l_returnflag = 'R'"), read(spark, d, "orders")
    paid = {"id": F.col("id"), "order_id": F.col("l_orderkey"), "sku_id": F.col("l_partkey"), "payment_type": F.concat(F.lit("110"), _text(F.col("l_partkey") % 4 + 1)), "callback_time": _time(F.col("l_shipdate")), "total_amount": _money("l_extendedprice"), "refund_status": F.when(F.col("l_linenumber") <= 2, "1602").otherwise("1603")}
    changes = _union(
        _records(lines, "refund_payment", "update", F.col("ts"), paid, {"refund_status": F.lit("1601")}),
        _records(lines, "order_refund_info", "update", F.col("ts"), {"order_id": F.col("l_orderkey"), "sku_id": F.col("l_partkey"), "refund_num": F.col("l_quantity").cast("int"), "refund_status": F.lit("0705")}, {"refund_status": F.lit("0701")}),
        _records(orders, "order_info", "update", _seconds(F.col("o_orderdate")), {"id": F.col("o_orderkey"), "user_id": F.col("o_custkey"), "province_id": F.col("o_custkey") % 34, "order_status": F.when(F.col("o_orderstatus") == "O", "1006").otherwise("1005")}, {"order_status": F.lit("1002")}),
    )
    return dwd.refund_pay_success(parse_changes(changes), _dic(spark))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").withColumn("at", _seconds(F.col("ts")))


@query("""SELECT cast(event_id AS varchar) AS id, cast(user_id AS varchar) AS user_id, cast(event_id % 9 AS varchar) AS sku_id, cast(CASE WHEN event_id % 3 = 0 THEN n ELSE n - m END AS varchar) AS sku_num, epoch_us(ts) // 1000000 AS ts
FROM (SELECT *, cast(floor(value) AS int) % 11 AS n, cast(floor(value) AS int) % 7 AS m FROM events WHERE event_type = 'purchase') WHERE event_id % 3 = 0 OR (event_id % 3 = 1 AND n > m)""")
def job_cart_add(spark: SparkSession, d: str) -> DataFrame:
    """Cart insertions and growth; shrinking and changes of other columns are left out."""
    e = _events(spark, d).where("event_type = 'purchase'")
    n, m = F.floor("value").cast("int") % 11, F.floor("value").cast("int") % 7
    fields = {"id": F.col("event_id"), "user_id": F.col("user_id"), "sku_id": F.col("event_id") % 9, "sku_num": n}
    changes = _union(
        _records(e.where("event_id % 3 = 0"), "cart_info", "insert", F.col("at"), fields),
        _records(e.where("event_id % 3 = 1"), "cart_info", "update", F.col("at"), fields, {"sku_num": m}),
        _records(e.where("event_id % 3 = 2"), "cart_info", "update", F.col("at"), fields, {"is_checked": F.lit("1")}),
    )
    return dwd.cart_add(parse_changes(changes))


@query(f"""SELECT cast(event_id AS varchar) AS id, cast(user_id AS varchar) AS user_id, cast(event_id % 9 AS varchar) AS sku_id, '120' || (event_id % 4 + 1) AS appraise, dic_name AS appraise_name, 'text ' || event_id AS comment_txt, epoch_us(ts) // 1000000 AS ts
FROM events JOIN {_DIC_SQL} ON dic_code = '120' || (event_id % 4 + 1) WHERE event_type = 'view'""")
def job_comment(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).where("event_type = 'view'")
    fields = {"id": F.col("event_id"), "user_id": F.col("user_id"), "sku_id": F.col("event_id") % 9, "appraise": F.concat(F.lit("120"), _text(F.col("event_id") % 4 + 1)), "comment_txt": F.concat(F.lit("text "), _text(F.col("event_id")))}
    return dwd.comment_info(parse_changes(_records(e, "comment_info", "insert", F.col("at"), fields)), _dic(spark))


#: Configuration changes: (op, before, after, ts_ms), of which clicks are kept, views dropped and purchases changed.
_CONFIG = [
    ("r", None, ("click", "dim_click", "user_id,value", "id"), 1),
    ("r", None, ("view", "dim_view", "id", "id"), 1),
    ("c", None, ("purchase", "dim_old", "id", "id"), 2),
    ("u", ("purchase", "dim_old", "id", "id"), ("purchase", "dim_purchase", "id,value,absent", "user_id"), 5),
    ("d", ("view", "dim_view", "id", "id"), None, 4),
]


def _config(spark: SparkSession) -> DataFrame:
    names = ("source_table", "sink_table", "sink_columns", "sink_row_key")
    row = lambda x: None if x is None else dict(zip(names, x, strict=True))
    lines = [(json.dumps({"before": row(b), "after": row(a), "op": op, "ts_ms": ts, "source": {"db": "config"}}),) for op, b, a, ts in _CONFIG]
    return current_config(config_rows(spark.createDataFrame(lines, "value string"), "source_table string, sink_table string, sink_columns string, sink_row_key string"), "source_table")


def _event_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON changes; every 50th is broken, every 51st null, every 7th a bootstrap record, every 13th of another database."""
    e = _events(spark, d)
    data = F.create_map(F.lit("id"), _text(F.col("event_id")), F.lit("user_id"), _text(F.col("user_id")), F.lit("value"), F.get_json_object("props", "$.k"))
    kind = F.when(F.col("event_id") % 7 == 0, "bootstrap-insert").when(F.col("event_id") % 3 == 0, "update").when(F.col("event_id") % 11 == 0, "bootstrap-start").otherwise("insert")
    base = F.when(F.col("event_id") % 13 == 0, "other").otherwise("shop")
    good = F.to_json(F.struct(base.alias("database"), F.col("event_type").alias("table"), kind.alias("type"), F.col("at").alias("ts"), F.when(F.col("event_id") % 17 != 0, data).alias("data")))
    return e.select("event_id", F.when(F.col("event_id") % 51 == 0, F.lit(None)).when(F.col("event_id") % 50 == 0, F.lit('{"database": "shop", ')).otherwise(good).alias("value"))


_KIND = "CASE WHEN event_id % 7 = 0 THEN 'bootstrap-insert' WHEN event_id % 3 = 0 THEN 'update' WHEN event_id % 11 = 0 THEN 'bootstrap-start' ELSE 'insert' END"
_READABLE = f"SELECT *, {_KIND} AS kind, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 51 <> 0 AND event_id % 50 <> 0"


@query(f"""SELECT CASE event_type WHEN 'click' THEN 'dim_click' ELSE 'dim_purchase' END AS sink_table, cast(CASE event_type WHEN 'click' THEN event_id ELSE user_id END AS varchar) AS row_key, kind AS op,
  CASE WHEN event_type = 'purchase' THEN cast(event_id AS varchar) END AS id, CASE WHEN event_type = 'click' THEN cast(user_id AS varchar) END AS user_id, k AS value, epoch_us(ts) // 1000000 AS ts
FROM ({_READABLE}) WHERE event_type IN ('click', 'purchase') AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND kind <> 'bootstrap-start'""")
def job_dim_routing(spark: SparkSession, d: str) -> DataFrame:
    """Changes that pass the gate, routed by the configuration in force."""
    out = dwd.dim_routing(dimension_gate(parse_changes(_event_lines(spark, d)), "shop"), _config(spark))
    return out.select("sink_table", "row_key", "op", *(F.col("data")[k].alias(k) for k in ("id", "user_id", "value")), "ts")


@query(f"""SELECT 'dwd_click' AS topic, cast(user_id AS varchar) AS user_id, k AS value, cast(epoch_us(ts) // 1000000 AS varchar) AS sent FROM ({_READABLE}) WHERE event_type = 'click' AND kind = 'insert' AND event_id % 17 <> 0
UNION ALL SELECT 'dwd_view', NULL, k, cast(epoch_us(ts) // 1000000 AS varchar) FROM ({_READABLE}) WHERE event_type = 'view' AND kind = 'update' AND event_id % 17 <> 0""")
def job_fact_routing(spark: SparkSession, d: str) -> DataFrame:
    """Changes of configured tables and types, without bootstrap records, as JSON for topics."""
    config = spark.createDataFrame([("click", "insert", "dwd_click", "user_id,value"), ("view", "update", "dwd_view", "value"), ("error", "bootstrap-insert", "dwd_error", "id")], "source_table string, source_type string, sink_table string, sink_columns string")
    out = dwd.fact_routing(fact_gate(parse_changes(_event_lines(spark, d)).where("data is not null")), config)
    m = F.from_json("value", "map<string,string>")
    return out.select("topic", m["user_id"].alias("user_id"), m["value"].alias("value"), m["ts"].alias("sent"))


@query("""SELECT event_id FROM events WHERE event_id % 51 <> 0 AND event_id % 50 = 0""")
def job_dirty_changes(spark: SparkSession, d: str) -> DataFrame:
    """Records that aren't readable; null messages are none."""
    return bad_records(_event_lines(spark, d)).select("event_id")


def _page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as log lines: searches, home and product pages, log-ins."""
    e = read(spark, d, "events")
    text = lambda c: c.cast("string")
    id_ = F.col("event_id")
    common = F.struct(text(F.col("user_id")).alias("mid"), F.when(id_ % 4 != 0, text(F.col("user_id") % 7)).alias("uid"), F.concat(F.lit("v"), text(F.col("user_id") % 3)).alias("vc"), F.col("event_type").alias("ch"), text(F.col("user_id") % 5).alias("ar"), F.when(F.col("user_id") % 2 == 0, "1").otherwise("0").alias("is_new"))
    last = F.when(id_ % 5 == 0, "search").when(id_ % 5 == 1, "login").when(id_ % 5 == 2, "home")
    item = F.concat(F.lit("Red apple "), F.get_json_object("props", "$.k"))
    page = F.struct(F.when(id_ % 3 == 0, "home").when(id_ % 3 == 1, "good_detail").otherwise("cart").alias("page_id"), last.alias("last_page_id"), F.when(id_ % 2 == 0, "keyword").otherwise("sku_id").alias("item_type"), item.alias("item"), (id_ % 1000).alias("during_time"))
    return e.select(F.to_json(F.struct(common.alias("common"), page.alias("page"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))).alias("value"))


def _page_rows(spark: SparkSession, d: str) -> DataFrame:
    return split_logs(parse_logs(_page_lines(spark, d)))["page"]


_PAGES = """SELECT *, epoch_ms(epoch_us(ts) // 1000) AS et, cast(user_id AS varchar) AS mid, CASE WHEN event_id % 4 <> 0 THEN cast(user_id % 7 AS varchar) END AS uid, CASE event_id % 5 WHEN 0 THEN 'search' WHEN 1 THEN 'login' WHEN 2 THEN 'home' END AS last_page,
  CASE event_id % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'good_detail' ELSE 'cart' END AS page_id, json_extract_string(props, '$.k') AS k FROM events"""
_BUCKET = "time_bucket(interval 10 second, {0})"


@query(f"""SELECT {_SHORT}, keyword, count(*) AS keyword_count FROM (SELECT {_BUCKET.format("et")} AS w, unnest(['red', 'apple', k]) AS keyword FROM ({_PAGES}) WHERE event_id % 5 = 0 AND event_id % 2 = 0) GROUP BY w, keyword""")
def job_keyword(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of searches: a view that comes from the search page and whose item is one."""
    return dws.keyword_page_view(_page_rows(spark, d))


@query(f"""SELECT {_SHORT}, vc, ch, ar, is_new, sum(uv)::BIGINT AS uv_ct, sum(sv)::BIGINT AS sv_ct, count(*) AS pv_ct, sum(dur)::BIGINT AS dur_sum FROM (SELECT {_BUCKET.format("et")} AS w, 'v' || user_id % 3 AS vc, event_type AS ch, cast(user_id % 5 AS varchar) AS ar, CASE WHEN user_id % 2 = 0 THEN '1' ELSE '0' END AS is_new,
  (row_number() OVER (PARTITION BY mid, date_trunc('day', et) ORDER BY epoch_us(ts) // 1000, page_id) = 1)::INT AS uv, (last_page IS NULL)::INT AS sv, event_id % 1000 AS dur FROM ({_PAGES})) GROUP BY w, vc, ch, ar, is_new""")
def job_traffic(spark: SparkSession, d: str) -> DataFrame:
    return dws.traffic_page_view(_page_rows(spark, d))


@query(f"""SELECT {_SHORT}, home_uv_ct, good_detail_uv_ct FROM (SELECT {_BUCKET.format("t")} AS w, sum((page_id = 'home')::INT)::BIGINT AS home_uv_ct, sum((page_id = 'good_detail')::INT)::BIGINT AS good_detail_uv_ct
FROM (SELECT mid, page_id, date_trunc('day', et), min(et) AS t FROM ({_PAGES}) WHERE page_id <> 'cart' GROUP BY 1, 2, 3) GROUP BY 1)""")
def job_home_detail(spark: SparkSession, d: str) -> DataFrame:
    return dws.home_detail_page_view(_page_rows(spark, d))


@query(f"""SELECT {_SHORT}, back_ct, uu_ct FROM (SELECT {_BUCKET.format("t")} AS w, sum(CASE WHEN date_diff('day', before, dd) >= 8 THEN 1 ELSE 0 END)::BIGINT AS back_ct, count(*) AS uu_ct
FROM (SELECT uid, dd, t, lag(dd) OVER (PARTITION BY uid ORDER BY dd) AS before FROM (SELECT uid, date_trunc('day', et) AS dd, min(et) AS t FROM ({_PAGES}) WHERE uid IS NOT NULL AND (last_page IS NULL OR last_page = 'login') GROUP BY 1, 2)) GROUP BY 1)""")
def job_user_login(spark: SparkSession, d: str) -> DataFrame:
    """Users that logged in: known ones, from the log-in page or from none."""
    return dws.user_login(_page_rows(spark, d))


@query(f"""SELECT {_SHORT}, cart_add_uu_ct FROM (SELECT {_BUCKET.format("t")} AS w, count(*) AS cart_add_uu_ct FROM (SELECT user_id, date_trunc('day', ts), min(date_trunc('second', ts)) AS t FROM events WHERE event_type = 'click' GROUP BY 1, 2) GROUP BY 1)""")
def job_cart_users(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).where("event_type = 'click'")
    changes = _records(e, "cart_info", "insert", F.col("at"), {"id": F.col("event_id"), "user_id": F.col("user_id"), "sku_id": F.lit("1"), "sku_num": F.lit("1")})
    return dws.cart_add_users(dwd.cart_add(parse_changes(changes)))


_LAST = "(SELECT * FROM (SELECT id, order_id, sku_id, province_id, cast(split_original_amount AS decimal(38,4)) AS o, cast(split_activity_amount AS decimal(38,4)) AS a, cast(split_coupon_amount AS decimal(38,4)) AS c, cast(split_total_amount AS decimal(38,4)) AS t, ts FROM ({0})) QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, t DESC) = 1)".format(_DETAIL)


@query(f"""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS stt, strftime(w + interval 10 second, '%Y-%m-%d %H:%M:%S') AS edt, strftime(w, '%Y-%m-%d') AS cur_date, province_id, coalesce(n_name, '') AS province_name, order_count, order_amount
FROM (SELECT {_BUCKET.format("to_timestamp(ts)::TIMESTAMP")} AS w, province_id, count(DISTINCT order_id) AS order_count, sum(t) AS order_amount FROM {_LAST} GROUP BY 1, 2) LEFT JOIN nation ON cast(n_nationkey AS varchar) = province_id""", ("order_amount",))
def job_province_order(spark: SparkSession, d: str) -> DataFrame:
    """Orders and amounts by province, repeated lines by their last version."""
    return dws.province_order(_detail(spark, d), read(spark, d, "nation").select(_text(F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name")))


_LEVELS = """(SELECT cast(p_partkey AS varchar) AS id, p_name AS sku_name, cast(p_partkey % 50 AS varchar) AS spu_id, 'spu' || p_partkey % 50 AS spu_name, cast(p_partkey % 9 AS varchar) AS trademark_id, CASE WHEN p_partkey % 9 < 8 THEN 'tm' || p_partkey % 9 END AS trademark_name,
  cast(p_size AS varchar) AS category3_id, 'c3-' || p_size AS category3_name, cast(p_size % 10 AS varchar) AS category2_id, CASE WHEN p_size % 10 <> 3 THEN 'c2-' || p_size % 10 END AS category2_name,
  CASE WHEN p_size % 10 <> 3 THEN cast(p_size % 10 % 4 AS varchar) END AS category1_id, CASE WHEN p_size % 10 <> 3 THEN 'c1-' || p_size % 10 % 4 END AS category1_name FROM part)"""


@query(f"""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS stt, strftime(w + interval 10 second, '%Y-%m-%d %H:%M:%S') AS edt, strftime(w, '%Y-%m-%d') AS cur_date, trademark_id, trademark_name, category1_id, category1_name, category2_id, category2_name, category3_id, category3_name,
  sku_id, sku_name, spu_id, spu_name, original_amount, activity_reduce_amount, coupon_reduce_amount, order_amount
FROM (SELECT {_BUCKET.format("to_timestamp(ts)::TIMESTAMP")} AS w, sku_id, sum(o) AS original_amount, sum(a) AS activity_reduce_amount, sum(c) AS coupon_reduce_amount, sum(t) AS order_amount FROM {_LAST} GROUP BY 1, 2) LEFT JOIN {_LEVELS} p ON p.id = sku_id""", ("original_amount", "activity_reduce_amount", "coupon_reduce_amount", "order_amount"))
def job_sku_order(spark: SparkSession, d: str) -> DataFrame:
    """Amounts by product, and its product group, trademark and three category levels; a missing parent leaves the chain null."""
    part = read(spark, d, "part")
    named = lambda expr, name, *more: part.select(_text(F.expr(expr)).alias("id"), F.expr(name).alias("name"), *more).distinct()
    dims = {
        "sku": part.select(_text(F.col("p_partkey")).alias("id"), F.col("p_name").alias("sku_name"), _text(F.col("p_partkey") % 50).alias("spu_id"), _text(F.col("p_size")).alias("category3_id"), _text(F.col("p_partkey") % 9).alias("tm_id")),
        "spu": named("p_partkey % 50", "concat('spu', p_partkey % 50)").withColumnRenamed("name", "spu_name"),
        "trademark": named("p_partkey % 9", "concat('tm', p_partkey % 9)").withColumnRenamed("name", "tm_name").where("id < '8'"),
        "category3": named("p_size", "concat('c3-', p_size)", _text(F.col("p_size") % 10).alias("category2_id")),
        "category2": named("p_size % 10", "concat('c2-', p_size % 10)", _text(F.col("p_size") % 10 % 4).alias("category1_id")).where("id <> '3'"),
        "category1": named("p_size % 10 % 4", "concat('c1-', p_size % 10 % 4)"),
    }
    return dws.sku_order(_detail(spark, d), dims)


@query("""SELECT cast(user_id AS varchar) AS key, arg_max(event_type, event_id) AS event_type, arg_max(cast(event_id AS varchar), event_id) AS event_id FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """What an upsert topic holds: the last message of each key, none where that is a deletion."""
    op = F.when(F.col("event_type") == "error", "-D").otherwise("+I")
    sent = read(spark, d, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("userId"), F.col("event_type").alias("eventType"), _text(F.col("event_id")).alias("eventId"))
    last = latest_per_key(keyed(sent, "userId", order="seq"), "seq")
    return last.select("key", *(F.get_json_object("value", f"$.{c}").alias(c) for c in ("event_type", "event_id")))
