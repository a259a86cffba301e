"""Queries of the warehouse operators over the fixture tables, and the SQL they are held against."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import kept_columns, not_empty
from ..functions.text import explode_keywords
from ..operators.cdc import grew, merge_rows, went
from ..operators.dedup import latest, retractions
from ..operators.joins import changelog_left_join, enrich, interval_join, lookup_join, snowflake
from ..operators.visits import daily_users, first_of_day, logins, repair_is_new, traffic_measures
from ..operators.windows import tumble

MONEY = "decimal(16,2)"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, money: tuple[str, ...] = ()):
    """Registers a query under its name, with its SQL if there is any.

    Sums are exact decimals; `money` columns leave as doubles, in the SQL too.
    """

    def keep(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, d: str) -> DataFrame:
            return fn(spark, d).withColumns({c: F.col(c).cast("double") for c in money}) if money else fn(spark, d)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE[fn.__name__] = f"SELECT * REPLACE ({', '.join(f'cast({c} AS double) AS {c}' for c in money)}) FROM ({sql})" if money else sql
        return fn

    return keep


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _amount() -> F.Column:
    return F.col("l_extendedprice").cast(MONEY) * (F.lit(1).cast("int") - F.col("l_discount").cast(MONEY))


_DISCOUNTED = "cast(l_extendedprice as decimal(16,2)) * (1 - cast(l_discount as decimal(16,2)))"
_WINDOW = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS stt, strftime({0} + interval {1}, '%Y-%m-%d %H:%M:%S') AS edt, strftime({0}, '%Y-%m-%d') AS cur_date"
_DAY = _WINDOW.format("w", "1 day")
_SHORT = _WINDOW.format("w", "10 second")


def _province_orders(spark: SparkSession, d: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Per day and nation: orders and amount, of the days from `first` to `last` if named.
    Lines are summed per order before any other join, so that counting orders needs no
    distinct; a bound on days reaches the scan of orders, and only their lines are summed."""
    lines, orders = read(spark, d, "lineitem"), read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if first is not None:
        orders = orders.where((F.col("o_orderdate") >= F.lit(first).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")))
        lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    lines = lines.groupBy("l_orderkey").agg(F.sum(_amount()).alias("amount"))
    orders = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    placed = orders.join(read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("province_id")), F.col("o_custkey") == F.col("c_custkey"))
    out = tumble(placed, "o_orderdate", "1 day", ["province_id"], order_count=F.count("*"), order_amount=F.sum("amount"))
    return enrich(out, read(spark, d, "nation"), "province_id", "n_nationkey", {"n_name": "province_name"})


_PROVINCE = f"""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS stt, strftime(w + interval 1 day, '%Y-%m-%d %H:%M:%S') AS edt, strftime(w, '%Y-%m-%d') AS cur_date,
  c_nationkey AS province_id, order_count, order_amount, n_name AS province_name FROM (
  SELECT date_trunc('day', o_orderdate) AS w, c_nationkey, count(DISTINCT o_orderkey) AS order_count, sum({_DISCOUNTED}) AS order_amount
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) LEFT JOIN nation ON n_nationkey = c_nationkey"""


@query(_PROVINCE, ("order_amount",))
def dws_province_order(spark: SparkSession, d: str) -> DataFrame:
    return _province_orders(spark, d)


_LATEST = """(SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1)"""
_VERSION = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(f"SELECT * FROM {_LATEST}")
def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last version of each order line."""
    return latest(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], _VERSION)


@query(f"""SELECT strftime(l_shipdate, '%Y-%m') AS month, sum(cast(l_extendedprice as decimal(16,2))) AS price, sum(cast(l_quantity as decimal(16,2))) AS quantity
FROM {_LATEST} GROUP BY 1""", ("price", "quantity"))
def dedup_retract(spark: SparkSession, d: str) -> DataFrame:
    """Sums over versions and retractions, which telescope to the last versions'."""
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_VERSION, F.col("l_extendedprice").cast(MONEY).alias("price"), F.col("l_quantity").cast(MONEY).alias("quantity"))
    # a version's month is its own: the retraction keeps the month of what it takes back
    rows = rows.withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    return retractions(rows, ["l_orderkey", "l_linenumber"], _VERSION, ["price", "quantity"]).groupBy("month").agg(F.sum("price").alias("price"), F.sum("quantity").alias("quantity"))


@query(f"""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS stt, strftime(w + interval 1 day, '%Y-%m-%d %H:%M:%S') AS edt, strftime(w, '%Y-%m-%d') AS cur_date, l_partkey AS sku_id,
  p_name AS sku_name, p_brand AS trademark_name, upper(p_brand) AS trademark_label, p_type AS category_name, r.sizes AS brand_sizes,
  original_amount, activity_reduce_amount, order_amount
FROM (SELECT date_trunc('day', l_shipdate) AS w, l_partkey, sum(cast(l_extendedprice as decimal(16,2))) AS original_amount,
  sum(cast(l_extendedprice as decimal(16,2)) * cast(l_discount as decimal(16,2))) AS activity_reduce_amount, sum({_DISCOUNTED}) AS order_amount
  FROM {_LATEST} GROUP BY 1, 2) LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN (SELECT p_brand AS b, count(DISTINCT p_size) AS sizes FROM part GROUP BY 1) r ON r.b = p_brand""", ("original_amount", "activity_reduce_amount", "order_amount"))
def dws_sku_order(spark: SparkSession, d: str) -> DataFrame:
    """Amounts by product and day, then product, brand and category by a chain of joins."""
    lines = latest(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], _VERSION).withColumnRenamed("l_partkey", "sku_id")
    price, discount = F.col("l_extendedprice").cast(MONEY), F.col("l_discount").cast(MONEY)
    out = tumble(lines, "l_shipdate", "1 day", ["sku_id"], original_amount=F.sum(price), activity_reduce_amount=F.sum(price * discount), order_amount=F.sum(_amount()))
    part = read(spark, d, "part")
    brands = part.groupBy(F.col("p_brand").alias("id")).agg(F.count_distinct("p_size").alias("sizes")).withColumn("label", F.upper("id"))
    return snowflake(
        out,
        (part, "sku_id", "p_partkey", {"p_name": "sku_name", "p_brand": "trademark_name", "p_type": "category_name"}),
        (brands, "trademark_name", "id", {"label": "trademark_label", "sizes": "brand_sizes"}),
    )


@query("""SELECT o_orderkey AS order_id, l_linenumber AS line, o_custkey AS user_id, l_partkey AS sku_id, strftime(o_orderdate, '%Y-%m-%d') AS date_id, p_name AS activity, s_name AS coupon,
  cast(cast(l_quantity as decimal(16,2)) * cast(l_extendedprice as decimal(16,2)) as varchar) AS split_original_amount
FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN (SELECT * FROM part WHERE p_size < 10) ON p_partkey = l_partkey
LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey""")
def dwd_order_detail(spark: SparkSession, d: str) -> DataFrame:
    """Inner join, then two left joins."""
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    out = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    out = enrich(out, read(spark, d, "part").where("p_size < 10"), "l_partkey", "p_partkey", {"p_name": "activity"})
    out = enrich(out, read(spark, d, "supplier").where("s_acctbal > 0"), "l_suppkey", "s_suppkey", {"s_name": "coupon"})
    total = (F.col("l_quantity").cast(MONEY) * F.col("l_extendedprice").cast(MONEY)).cast("string")
    return out.select(F.col("o_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("sku_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_id"), "activity", "coupon", total.alias("split_original_amount"))


@query("""SELECT o_orderkey AS order_id, l_linenumber AS line, strftime(o_orderdate, '%Y-%m-%d') AS date_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0""")
def dwd_order_cancel(spark: SparkSession, d: str) -> DataFrame:
    """An exact transition of status (from 1001 to 1003), joined to lines."""
    status = {"O": "1001", "P": "1002", "F": "1003"}
    code = F.coalesce(*(F.when(F.col("o_orderstatus") == k, v) for k, v in status.items()))
    changes = read(spark, d, "orders").withColumns({"data": F.create_map(F.lit("order_status"), code), "old": F.create_map(F.lit("order_status"), F.when(F.col("o_custkey") % 2 == 0, "1001").otherwise("1002"))})
    gone = changes.where(went("order_status", "1001", "1003"))
    out = gone.join(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), F.col("o_orderkey") == F.col("l_orderkey"))
    return out.select(F.col("o_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_id"))


@query("""SELECT o_orderkey AS order_id, l_linenumber AS line, c_custkey AS user_id, n_name AS payment_type_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  AND l_shipdate >= o_orderdate - interval 30 day AND l_shipdate <= o_orderdate + interval 5 day JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def dwd_pay_suc(spark: SparkSession, d: str) -> DataFrame:
    """An interval join on event time, both ends included, and a dictionary look-up."""
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("et"))
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("et"))
    out = interval_join(orders, lines, ["order_id"], "30 days", "5 days")
    out = out.join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("user_id") == F.col("c_custkey"))
    return lookup_join(out, read(spark, d, "nation"), "c_nationkey", "n_nationkey", "n_name", "payment_type_name").select("order_id", "line", "user_id", "payment_type_name")


@query("""SELECT l_orderkey AS order_id, l_linenumber AS line, a.n_name AS refund_type_name, b.n_name AS refund_reason_name, cast(l_extendedprice as decimal(16,2)) AS refund_amount
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = c_nationkey
JOIN supplier ON s_suppkey = l_suppkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE l_returnflag = 'R'""", ("refund_amount",))
def dwd_order_refund(spark: SparkSession, d: str) -> DataFrame:
    """Two look-ups in one dictionary."""
    lines = read(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    out = lines.join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    out = out.join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).join(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    dic = read(spark, d, "nation")
    out = lookup_join(lookup_join(out, dic, "c_nationkey", "n_nationkey", "n_name", "refund_type_name"), dic, "s_nationkey", "n_nationkey", "n_name", "refund_reason_name")
    return out.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), "refund_type_name", "refund_reason_name", F.col("l_extendedprice").cast(MONEY).alias("refund_amount"))


@query("""WITH a AS (SELECT l_orderkey AS order_id, l_partkey AS sku_id, sum(cast(l_quantity as decimal(16,2))) AS refund_num FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_orderkey AS order_id, l_partkey AS sku_id, sum(cast(l_extendedprice as decimal(16,2))) AS refund_amount FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT order_id, sku_id, refund_num, refund_amount FROM a JOIN b USING (order_id, sku_id)""", ("refund_num", "refund_amount"))
def dwd_refund_pay(spark: SparkSession, d: str) -> DataFrame:
    """A join on two keys of sums over one table: one aggregation, of which the pairs
    with a refunded line stay."""
    refunded = F.col("l_returnflag") == "R"
    sums = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku_id")).agg(
        F.sum(F.col("l_quantity").cast(MONEY)).alias("refund_num"),
        F.sum(F.when(refunded, F.col("l_extendedprice").cast(MONEY))).alias("refund_amount"),
        F.max(refunded).alias("_refunded"),
    )
    return sums.where("_refunded").drop("_refunded")


@query("""SELECT event_id AS id, user_id, cast(n as varchar) AS sku_num, before IS NULL AS inserted FROM (
  SELECT event_id, user_id, cast(floor(value) as int) AS n, lag(cast(floor(value) as int)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR n > before""")
def dwd_cart_add(spark: SparkSession, d: str) -> DataFrame:
    """The first value of a user, and values that grew."""
    from pyspark.sql.window import Window

    before = F.lag(F.floor("value").cast("int")).over(Window.partitionBy("user_id").orderBy("event_id"))
    changes = read(spark, d, "events").withColumns({"data": F.create_map(F.lit("sku_num"), F.floor("value").cast("int").cast("string")), "old": F.create_map(F.lit("sku_num"), before.cast("string"))})
    first = F.col("old")["sku_num"].isNull()
    return changes.where(first | grew("sku_num")).select(F.col("event_id").alias("id"), "user_id", F.col("data")["sku_num"].alias("sku_num"), first.alias("inserted"))


_TYPES = [("click", "1201", "tapped"), ("view", "1202", "seen"), ("purchase", "1203", "bought")]
_TYPES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _TYPES) + ") t(kind, dic_code, dic_name)"


@query(f"SELECT event_id AS id, user_id, event_type AS appraise, dic_name AS appraise_name FROM events JOIN {_TYPES_SQL} ON kind = event_type")
def dwd_comment(spark: SparkSession, d: str) -> DataFrame:
    """An inner look-up: codes that the dictionary doesn't have are dropped."""
    dic = spark.createDataFrame(_TYPES, "kind string, dic_code string, dic_name string")
    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("appraise"))
    return lookup_join(rows, dic, "appraise", "kind", "dic_name", "appraise_name")


def _log_records(spark: SparkSession, d: str) -> DataFrame:
    """Events as log JSON: errors carry `err`, sign-ups `start`, clicks an action, views a display and a page."""
    e = read(spark, d, "events")
    kind = F.col("event_type")
    common = F.struct(F.col("user_id").cast("string").alias("mid"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("vc"), F.when(F.col("event_id") % 2 == 0, "1").otherwise("0").alias("is_new"))
    page = F.struct(kind.alias("page_id"), F.when(F.col("event_id") % 5 == 0, "search").alias("last_page_id"), F.col("event_id").alias("during_time"))
    item = F.create_map(F.lit("item"), F.get_json_object("props", "$.k"))
    good = F.to_json(F.struct(common.alias("common"), page.alias("page"), F.when(kind == "view", F.array(item, item)).alias("displays"), F.when(kind == "click", F.array(item)).alias("actions"), F.when(kind == "signup", F.struct(F.lit("icon").alias("entry"))).alias("start"), F.when(kind == "error", F.struct(F.lit(500).alias("error_code"))).alias("err"), (F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts")))
    return e.select("event_id", F.when(F.col("event_id") % 97 == 0, F.lit('{"common":')).otherwise(good).alias("value"))


def _split(spark: SparkSession, d: str, which: str) -> DataFrame:
    from ..operators.logs import parse_logs, split_logs

    return split_logs(parse_logs(_log_records(spark, d)))[which]


_LOGS = "SELECT *, cast(user_id as varchar) AS mid, CASE WHEN event_id % 5 = 0 THEN 'search' END AS last_page_id, epoch_us(ts) // 1000 AS ms, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 97 <> 0"


@query("""SELECT '{"common":' AS value FROM events WHERE event_id % 97 = 0""")
def dwd_log_split_dirty(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, "dirty")


@query(f"SELECT mid, 500::BIGINT AS error_code, event_type AS page_id, ms AS ts FROM ({_LOGS}) WHERE event_type = 'error'")
def dwd_log_split_err(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, "err").select("common.mid", "err.error_code", "page.page_id", "ts")


@query(f"SELECT mid, 'icon' AS entry, ms AS ts FROM ({_LOGS}) WHERE event_type = 'signup'")
def dwd_log_split_start(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, "start").select("common.mid", "start.entry", "ts")


@query(f"SELECT mid, k AS item, ms AS ts FROM ({_LOGS}), range(2) WHERE event_type = 'view'")
def dwd_log_split_display(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, "display").select("common.mid", F.col("display")["item"].alias("item"), "ts")


@query(f"SELECT mid, k AS item, event_type AS page_id FROM ({_LOGS}) WHERE event_type = 'click'")
def dwd_log_split_action(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, "action").select("common.mid", F.col("action")["item"].alias("item"), "page.page_id")


@query(f"SELECT mid, event_type AS page_id, last_page_id, event_id AS during_time, ms AS ts FROM ({_LOGS}) WHERE event_type <> 'signup'")
def dwd_log_split_page(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, "page").select("common.mid", "page.page_id", "page.last_page_id", "page.during_time", "ts")


_ROUTES = [("click", "dim_click", "user_id,value", "id"), ("purchase", "dim_purchase", "id,value,absent", "user_id")]


def _event_changes(spark: SparkSession, d: str) -> DataFrame:
    payload = F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("user_id"), F.col("user_id").cast("string"), F.lit("value"), F.get_json_object("props", "$.k"))
    return read(spark, d, "events").select(F.lit("shop").alias("database"), F.col("event_type").alias("table"), F.when(F.col("event_id") % 3 == 0, "update").otherwise("insert").alias("type"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), payload.alias("data"))


@query("""SELECT CASE event_type WHEN 'click' THEN 'dim_click' ELSE 'dim_purchase' END AS sink_table, cast(CASE event_type WHEN 'click' THEN event_id ELSE user_id END as varchar) AS row_key,
  CASE WHEN event_id % 3 = 0 THEN 'update' ELSE 'insert' END AS op, CASE WHEN event_type = 'purchase' THEN cast(event_id as varchar) END AS id, CASE WHEN event_type = 'click' THEN cast(user_id as varchar) END AS user_id,
  json_extract_string(props, '$.k') AS value FROM events WHERE event_type IN ('click', 'purchase')""")
def dim_route(spark: SparkSession, d: str) -> DataFrame:
    """Changes routed and pruned by a configuration table."""
    from ..operators.cdc import dimension_gate, route_dimensions

    config = spark.createDataFrame(_ROUTES, "source_table string, sink_table string, sink_columns string, sink_row_key string")
    out = route_dimensions(dimension_gate(_event_changes(spark, d), "shop"), config)
    return out.select("sink_table", "row_key", "op", *(F.col("data")[k].alias(k) for k in ("id", "user_id", "value")))


@query("""SELECT 'dwd_click' AS topic, cast(user_id as varchar) AS user_id, json_extract_string(props, '$.k') AS value, cast(epoch_us(ts) // 1000000 as varchar) AS ts, 3::INT AS fields
FROM events WHERE event_type = 'click' AND event_id % 3 <> 0""")
def dwd_route(spark: SparkSession, d: str) -> DataFrame:
    """Changes routed by table and type to topics, as pruned JSON with the change's time."""
    from ..operators.cdc import fact_gate, route_facts

    config = spark.createDataFrame([("click", "insert", "dwd_click", "user_id,value")], "source_table string, source_type string, sink_table string, sink_columns string")
    out = route_facts(fact_gate(_event_changes(spark, d)), config)
    m = F.from_json("value", "map<string,string>")
    return out.select("topic", m["user_id"].alias("user_id"), m["value"].alias("value"), m["ts"].alias("ts"), F.size(m).alias("fields"))


@query("""WITH g AS (SELECT user_id, max(event_id) AS gone FROM events WHERE event_type = 'error' GROUP BY 1),
e AS (SELECT * FROM events LEFT JOIN g USING (user_id) WHERE event_type <> 'error' AND (gone IS NULL OR event_id > gone)),
v AS (SELECT user_id, arg_max(cast(event_id as varchar), event_id) FILTER (event_type = 'click') AS clicked, arg_max(json_extract_string(props, '$.k'), event_id) FILTER (event_type = 'view' AND json_extract_string(props, '$.k') <> '7') AS viewed FROM e GROUP BY 1)
SELECT cast(user_id as varchar) AS row_key, clicked, viewed FROM v WHERE clicked IS NOT NULL OR viewed IS NOT NULL""")
def dim_merge(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a dimension after puts (empty cells aren't written) and deletes."""
    e = read(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    cells = F.create_map(F.lit("clicked"), F.when(F.col("event_type") == "click", F.col("event_id").cast("string")), F.lit("viewed"), F.when(F.col("event_type") == "view", F.when(k == "7", "").otherwise(k)))
    routed = e.select(F.lit("dim_user").alias("sink_table"), F.col("user_id").cast("string").alias("row_key"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"), cells.alias("data"), F.col("event_id").alias("seq"))
    return merge_rows(routed).select("row_key", F.col("data")["clicked"].alias("clicked"), F.col("data")["viewed"].alias("viewed"))


@query("""WITH e AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN event_id % 2 = 0 THEN '1' ELSE '0' END AS is_new FROM events),
f AS (SELECT *, first_value(is_new) OVER w AS n0, first_value(date) OVER w AS d0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, user_id, date, CASE WHEN is_new = '1' AND date <> (CASE WHEN n0 = '1' THEN d0 ELSE strftime(cast(d0 as date) - 1, '%Y-%m-%d') END) THEN '0' ELSE is_new END AS is_new FROM f""")
def fix_is_new(spark: SparkSession, d: str) -> DataFrame:
    """New-visitor flags repaired by the visitor's first-visit date."""
    rows = read(spark, d, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.when(F.col("event_id") % 2 == 0, "1").otherwise("0").alias("is_new"))
    return repair_is_new(rows, "user_id", order=("event_id",))


def _traffic(spark: SparkSession, d: str, size: str) -> DataFrame:
    rows = read(spark, d, "events").select("event_id", "user_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_type").alias("ch"), F.col("value").cast(MONEY).alias("during"))
    x = traffic_measures(rows, ["ch"], "user_id", "date", "ts", ["event_id"], F.col("event_id") % 5 == 0, F.col("during"))
    return tumble(x, "ts", size, ["ch"], uv_ct=F.sum("uv_ct"), sv_ct=F.sum("sv_ct"), pv_ct=F.sum("pv_ct"), dur_sum=F.sum("dur_sum"))


def _traffic_sql(bucket: str, window: str) -> str:
    return f"""SELECT {window}, ch, uv_ct, sv_ct, pv_ct, dur_sum FROM (SELECT {bucket} AS w, event_type AS ch, sum(u)::BIGINT AS uv_ct, sum((event_id % 5 = 0)::INT)::BIGINT AS sv_ct, count(*) AS pv_ct,
  sum(cast(value as decimal(16,2))) AS dur_sum FROM (SELECT *, (row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id) = 1)::INT AS u FROM events) GROUP BY 1, 2)"""


@query(_traffic_sql("time_bucket(interval 10 second, ts)", _SHORT), ("dur_sum",))
def dws_traffic_view(spark: SparkSession, d: str) -> DataFrame:
    """Unique visitors, sessions, views and durations per channel and 10 seconds."""
    return _traffic(spark, d, "10 seconds")


@query(_traffic_sql("date_trunc('day', ts)", _DAY), ("dur_sum",))
def dws_traffic_view_day(spark: SparkSession, d: str) -> DataFrame:
    return _traffic(spark, d, "1 day")


@query(f"""SELECT {_SHORT}, home_uv_ct, good_detail_uv_ct FROM (SELECT time_bucket(interval 10 second, t) AS w, sum((event_type = 'view')::INT)::BIGINT AS home_uv_ct, sum((event_type = 'click')::INT)::BIGINT AS good_detail_uv_ct
FROM (SELECT user_id, event_type, date_trunc('day', ts) AS dd, min(ts) AS t FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2, 3) GROUP BY 1)""")
def dws_home_detail_uv(spark: SparkSession, d: str) -> DataFrame:
    """Daily unique visitors of two pages, independently."""
    rows = read(spark, d, "events").where(F.col("event_type").isin("view", "click")).select("user_id", "event_type", "ts", F.date_format("ts", "yyyy-MM-dd").alias("date"))
    firsts = first_of_day(rows, ["user_id", "event_type", "date"], ["ts"], ["ts"])
    one = lambda p: F.sum((F.col("event_type") == p).cast("long"))
    return tumble(firsts, "ts", "10 seconds", [], home_uv_ct=one("view"), good_detail_uv_ct=one("click"))


@query(f"""SELECT {_DAY}, back_ct, uu_ct FROM (SELECT date_trunc('day', t) AS w, sum((date_diff('day', before, dd) >= 8)::INT)::BIGINT AS back_x, sum(CASE WHEN before IS NOT NULL AND date_diff('day', before, dd) >= 8 THEN 1 ELSE 0 END)::BIGINT AS back_ct, count(*) AS uu_ct
FROM (SELECT user_id, dd, t, lag(dd) OVER (PARTITION BY user_id ORDER BY dd) AS before FROM (SELECT user_id, date_trunc('day', ts) AS dd, min(ts) AS t FROM events WHERE event_type = 'signup' GROUP BY 1, 2)) GROUP BY 1)""")
def dws_user_login(spark: SparkSession, d: str) -> DataFrame:
    """Users per day, and those back after eight days."""
    rows = read(spark, d, "events").where("event_type = 'signup'").select("user_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("date"))
    return tumble(logins(rows, "user_id", "date", "ts"), "ts", "1 day", [], back_ct=F.sum("back_ct"), uu_ct=F.sum("uu_ct"))


@query(f"""SELECT {_SHORT}, cart_add_uu_ct FROM (SELECT time_bucket(interval 10 second, t) AS w, count(*) AS cart_add_uu_ct FROM (SELECT user_id, date_trunc('day', ts), min(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) GROUP BY 1)""")
def dws_cart_uu(spark: SparkSession, d: str) -> DataFrame:
    """Users with a purchase, once a day."""
    rows = read(spark, d, "events").where("event_type = 'purchase'").select("user_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("date"))
    return tumble(daily_users(rows, "user_id", "date", "ts"), "ts", "10 seconds", [], cart_add_uu_ct=F.count("*"))


@query("""SELECT keyword, count(*) AS keyword_count FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS keyword FROM documents WHERE lang = 'en') GROUP BY 1""")
def keyword_count(spark: SparkSession, d: str) -> DataFrame:
    """Words of texts, counted by a lateral join."""
    texts = read(spark, d, "documents").where("lang = 'en'").select("text")
    return explode_keywords(texts, "text").groupBy("keyword").agg(F.count("*").alias("keyword_count"))


@query(f"SELECT sum(order_amount) AS order_amount FROM ({_PROVINCE}) WHERE cur_date = '1995-03-15'", ("order_amount",))
def ads_gmv(spark: SparkSession, d: str) -> DataFrame:
    """One day's amount."""
    return _province_orders(spark, d, "1995-03-15", "1995-03-15").agg(F.sum("order_amount").alias("order_amount"))


@query(f"SELECT province_name, sum(order_amount) AS order_amount FROM ({_PROVINCE}) WHERE cur_date BETWEEN '1995-03-01' AND '1995-03-31' GROUP BY 1", ("order_amount",))
def ads_province(spark: SparkSession, d: str) -> DataFrame:
    """Amounts by province over a month."""
    return _province_orders(spark, d, "1995-03-01", "1995-03-31").groupBy("province_name").agg(F.sum("order_amount").alias("order_amount"))


@query(f"SELECT ch, sum(uv_ct)::BIGINT AS uv_ct FROM ({_traffic_sql('date_trunc(' + chr(39) + 'day' + chr(39) + ', ts)', _DAY)}) WHERE cur_date = '2024-01-02' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def ads_channel_topn(spark: SparkSession, d: str) -> DataFrame:
    """The ten channels with most unique visitors of a day; ties by name."""
    return _traffic(spark, d, "1 day").where("cur_date = '2024-01-02'").groupBy("ch").agg(F.sum("uv_ct").alias("uv_ct")).orderBy(F.desc("uv_ct"), "ch").limit(10)


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, 2::INT AS kept, coalesce(nullif(event_type, 'view'), 'none') AS label, 'user:' || user_id AS cache_key FROM events""")
def json_map_ops(spark: SparkSession, d: str) -> DataFrame:
    """JSON to a map, look-up, pruning by a list, and the empty-as-null convention."""
    m = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type")))
    rows = read(spark, d, "events").withColumn("m", m)
    return rows.select("event_id", F.col("m")["k"].alias("k"), F.size(kept_columns(F.col("m"), F.lit("k,user,absent"))).alias("kept"), F.when(not_empty(F.nullif("event_type", F.lit("view"))), F.col("event_type")).otherwise("none").alias("label"), F.concat(F.lit("user:"), F.col("m")["user"]).alias("cache_key"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date_id, strftime(o_orderdate, '%Y%m%d') AS partition_id, epoch_ms(o_orderdate - interval 8 hour) AS ms_at_east8,
  date_diff('day', o_orderdate, timestamp '2000-01-01') AS days FROM orders""")
def date_fns(spark: SparkSession, d: str) -> DataFrame:
    """Formats, partition numbers, parsing at +08:00 and whole days between."""
    from ..functions.times import millis_of_datetime, partition_of_millis, whole_days_between

    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_id"), partition_of_millis(ms).alias("partition_id"), millis_of_datetime(text).alias("ms_at_east8"), whole_days_between(F.lit(946684800000), ms).cast("long").alias("days"))


@query("""SELECT l_orderkey, l_linenumber, cast(cast(l_quantity as decimal(16,2)) * cast(l_extendedprice as decimal(16,2)) as varchar) AS product, -cast(l_extendedprice as decimal(16,2)) AS taken_back, cast(l_quantity as int) AS number FROM lineitem""", ("taken_back",))
def decimal_cast(spark: SparkSession, d: str) -> DataFrame:
    """Decimal products as text, and negation of numbers (never of text)."""
    price, number = F.col("l_extendedprice").cast(MONEY), F.col("l_quantity").cast(MONEY)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (number * price).cast("string").alias("product"), (-price).alias("taken_back"), F.col("l_quantity").cast("int").alias("number"))


@query("""WITH l AS (SELECT o_orderkey AS k, o_custkey AS c, epoch(o_orderdate)::BIGINT AS t FROM orders), r AS (SELECT l_orderkey AS k, l_linenumber AS line, epoch(l_shipdate)::BIGINT AS t FROM lineitem),
f AS (SELECT k, min(t) AS first FROM r GROUP BY 1)
SELECT '+I' AS op, greatest(l.t, r.t) AS at, l.k AS order_id, r.line AS r_line FROM l JOIN r ON l.k = r.k
UNION ALL SELECT '+I', l.t, l.k, NULL FROM l LEFT JOIN f ON l.k = f.k WHERE first IS NULL OR first > l.t
UNION ALL SELECT '-D', first, l.k, NULL FROM l JOIN f ON l.k = f.k WHERE first > l.t""")
def outer_join_changelog(spark: SparkSession, d: str) -> DataFrame:
    """The messages of an eager left join: insertions and what later matches retract."""
    left = read(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("t"))
    right = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("t"))
    return changelog_left_join(left, right, "order_id", "t", "t").select("op", "at", "order_id", "r_line")


@query("""SELECT coalesce(c_custkey, s_suppkey) AS id, c_name AS customer, s_name AS supplier FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) FULL JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 = 0) ON c_custkey = s_suppkey""")
def full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Full outer join: rows of either side without a partner stay."""
    c = read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("customer"))
    s = read(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("supplier"))
    return c.join(s, "id", "full")


from . import replays  # noqa: E402, F401  the jobs register themselves here, too
