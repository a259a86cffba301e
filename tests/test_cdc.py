"""Change records: parsing, gates, routes, merges and the fact jobs."""

import json

from pyspark.sql import functions as F

from millrace.operators import cdc
from millrace.plans import dwd
from millrace.sources.readers import csv_columns, elements


def change(table, type_, ts=1718278525, database="shop", data=None, old=None):
    return json.dumps({"database": database, "table": table, "type": type_, "ts": ts, "data": data, "old": old})


def parsed(spark, *records):
    return cdc.parse_changes(elements(spark, [(r,) for r in records], "value string"))


def test_parse_keeps_readable_records_and_counts_seconds(spark):
    df = parsed(spark, change("a", "insert", data={"id": 1, "n": {"x": 1}}), "{bad", None)
    row = df.select("data", F.unix_timestamp("et").alias("s")).collect()
    assert len(row) == 1 and row[0].s == 1718278525 and row[0].data["id"] == "1"
    bad = cdc.bad_records(elements(spark, [("{bad",), (change("a", "insert", data={}),)], "value string"))
    assert [r.value for r in bad.collect()] == ["{bad"]


def test_gates(spark):
    df = parsed(
        spark, change("a", "bootstrap-insert", data={"id": 1}), change("a", "bootstrap-start", data={"id": 1}), change("a", "insert", database="other", data={"id": 1}), change("a", "update", data={}), change("a", "delete", data={"id": 2})
    )
    assert sorted(r.type for r in cdc.dimension_gate(df, "shop").collect()) == ["bootstrap-insert", "delete"]
    assert sorted(r.type for r in cdc.fact_gate(df).collect()) == ["delete", "insert", "update"]


def test_config_and_routing(spark):
    conf = [
        {"before": None, "after": {"source_table": "a", "sink_table": "dim_a", "sink_columns": "id,name", "sink_row_key": "id", "sink_family": "info"}, "op": "r", "ts_ms": 1},
        {"before": None, "after": {"source_table": "b", "sink_table": "dim_b", "sink_columns": "id", "sink_row_key": "id", "sink_family": "info"}, "op": "c", "ts_ms": 1},
        {"before": {"source_table": "b", "sink_table": "dim_b", "sink_columns": "id", "sink_row_key": "id", "sink_family": "info"}, "after": None, "op": "d", "ts_ms": 2},
        {"before": None, "after": {"source_table": "a", "sink_table": "dim_a", "sink_columns": "id, extra", "sink_row_key": "id", "sink_family": "info"}, "op": "u", "ts_ms": 3},
    ]
    rows = elements(spark, [(json.dumps(c),) for c in conf], "value string")
    now = cdc.current_config(cdc.config_rows(rows, "source_table string, sink_table string, sink_columns string, sink_row_key string, sink_family string"), "source_table")
    assert [(r.source_table, r.sink_columns) for r in now.collect()] == [("a", "id, extra")]
    out = cdc.route_dimensions(parsed(spark, change("a", "insert", data={"id": 7, "name": "x", "extra": 1}), change("b", "insert", data={"id": 1})), now).collect()
    # names aren't trimmed: ' extra' names no column
    assert len(out) == 1 and out[0].row_key == "7" and out[0].data == {"id": "7"} and out[0].op == "insert"


def test_fact_routing_adds_ts(spark):
    conf = elements(spark, [("a", "insert", "dwd_a", "id")], "source_table string, source_type string, sink_table string, sink_columns string")
    out = cdc.route_facts(parsed(spark, change("a", "insert", ts=5, data={"id": 1, "x": 2}), change("a", "update", data={"id": 1})), conf).collect()
    assert [(r.topic, json.loads(r.value)) for r in out] == [("dwd_a", {"id": "1", "ts": "5"})]


def test_merge_is_per_cell_since_the_last_delete(spark):
    rows = [("t", "1", "insert", {"a": "1", "b": "2"}, 1), ("t", "1", "update", {"a": "", "b": "3"}, 2), ("t", "1", "update", {"a": None}, 3), ("t", "2", "insert", {"a": "1"}, 1), ("t", "2", "delete", {"a": "1"}, 2), ("t", "3", "insert", {"a": "1"}, 1), ("t", "3", "delete", {}, 2), ("t", "3", "insert", {"b": "9"}, 3)]
    df = elements(spark, rows, "sink_table string, row_key string, op string, data map<string,string>, seq bigint")
    assert {r.row_key: r.data for r in cdc.merge_rows(df).collect()} == {"1": {"a": "1", "b": "3"}, "3": {"b": "9"}}


def test_cart_add(spark):
    df = parsed(
        spark,
        change("cart_info", "insert", data={"id": 1, "user_id": 2, "sku_id": 3, "sku_num": 4}),
        change("cart_info", "update", data={"id": 1, "user_id": 2, "sku_id": 3, "sku_num": 10}, old={"sku_num": 9}),
        change("cart_info", "update", data={"id": 1, "user_id": 2, "sku_id": 3, "sku_num": 2}, old={"sku_num": 10}),
        change("cart_info", "update", data={"id": 1, "user_id": 2, "sku_id": 3, "sku_num": 2}, old={"is_checked": 1}),
        change("cart_info", "delete", data={"id": 1, "user_id": 2, "sku_id": 3, "sku_num": 2}),
    )
    assert sorted(r.sku_num for r in dwd.cart_add(df).collect()) == ["1", "4"]


ORDER = [
    change("order_detail", "insert", 100, data={"id": 1, "order_id": 10, "sku_id": 5, "sku_name": "n", "create_time": "2024-06-11 19:35:25", "sku_num": "1", "order_price": "6999.0", "split_total_amount": "6499.0", "split_activity_amount": "500.0", "split_coupon_amount": "0.0"}),
    change("order_detail", "insert", 100, data={"id": 2, "order_id": 11, "sku_id": 5, "sku_name": "n", "create_time": "2024-06-11 19:35:25", "sku_num": "2", "order_price": "10", "split_total_amount": "20"}),
    change("order_info", "insert", 100, data={"id": 10, "user_id": 3, "province_id": 17}),
    change("order_detail_activity", "insert", 101, data={"order_detail_id": 1, "activity_id": 8, "activity_rule_id": 9}),
]


def test_order_detail_and_what_follows(spark):
    df = parsed(spark, *ORDER)
    detail = dwd.order_detail(df)
    row = detail.collect()
    assert len(row) == 1 and row[0].split_original_amount == "6999.0000" and row[0].activity_id == "8" and row[0].coupon_id is None and row[0].date_id == "2024-06-11"
    later = parsed(
        spark,
        change("order_info", "update", 200, data={"id": 10, "user_id": 3, "province_id": 17, "order_status": "1003", "operate_time": "2024-06-12 00:00:01"}, old={"order_status": "1001"}),
        change("payment_info", "update", 1900, data={"order_id": 10, "user_id": 3, "payment_type": "1101", "callback_time": "x", "payment_status": "1602"}, old={"payment_status": "1601"}),
        change("payment_info", "update", 1901, data={"order_id": 10, "user_id": 3, "payment_type": "1101", "callback_time": "y", "payment_status": "1602"}, old={"payment_status": "1601"}),
        change("payment_info", "update", 95, data={"order_id": 10, "user_id": 3, "payment_type": "1101", "callback_time": "z", "payment_status": "1602"}, old={"payment_status": "1601"}),
        change("payment_info", "update", 94, data={"order_id": 10, "user_id": 3, "payment_type": "1101", "callback_time": "w", "payment_status": "1602"}, old={"payment_status": "1601"}),
        change("payment_info", "update", 300, data={"order_id": 10, "user_id": 3, "payment_type": "1101", "payment_status": "1602"}, old={"callback_time": "q"}),
    )
    dic = elements(spark, [("1101", "alpha")], "dic_code string, dic_name string")
    assert [(r.date_id, r.ts) for r in dwd.order_cancel(later, detail).collect()] == [("2024-06-12", 200)]
    # 30 minutes before and 5 seconds after, both included
    assert sorted(r.callback_time for r in dwd.pay_success(later, detail, dic).collect()) == ["x", "z"]


def test_refunds_and_comments(spark):
    df = parsed(
        spark,
        change("order_refund_info", "insert", 5, data={"id": 1, "user_id": 3, "order_id": 10, "sku_id": 5, "refund_type": "1501", "refund_num": 1, "refund_amount": "9.5", "refund_reason_type": "1301", "create_time": "2024-06-11 00:00:00"}),
        change("order_info", "update", 5, data={"id": 10, "province_id": 17, "user_id": 3, "order_status": "1005"}, old={"order_status": "1002"}),
        change("refund_payment", "update", 6, data={"id": 4, "order_id": 10, "sku_id": 5, "payment_type": "1101", "callback_time": "2024-06-12 00:00:00", "total_amount": "9.5", "refund_status": "1602"}, old={"refund_status": "1601"}),
        change("order_refund_info", "update", 6, data={"order_id": 10, "sku_id": 5, "refund_num": 1, "refund_status": "0705"}, old={"refund_status": "0702"}),
        change("order_info", "update", 6, data={"id": 10, "province_id": 17, "user_id": 3, "order_status": "1006"}, old={"order_status": "1005"}),
        change("comment_info", "insert", 7, data={"id": 1, "user_id": 3, "sku_id": 5, "appraise": "1201", "comment_txt": "ok"}),
        change("comment_info", "insert", 7, data={"id": 2, "user_id": 3, "sku_id": 5, "appraise": "9999", "comment_txt": "?"}),
    )
    dic = elements(spark, [("1101", "alpha"), ("1201", "good"), ("1301", "late"), ("1501", "money")], "dic_code string, dic_name string")
    r = dwd.order_refund(df, dic).collect()
    assert [(x.refund_type_name, x.refund_reason_type_name, x.date_id) for x in r] == [("money", "late", "2024-06-11")]
    assert [(x.payment_type_name, x.refund_amount, x.date_id) for x in dwd.refund_pay_success(df, dic).collect()] == [("alpha", "9.5", "2024-06-12")]
    assert [x.appraise_name for x in dwd.comment_info(df, dic).collect()] == ["good"]


def test_csv_columns(spark):
    assert csv_columns(elements(spark, [("1, x,5",)], "value string"), "empno int, ename string, ts bigint").collect()[0].asDict() == {"empno": 1, "ename": "x", "ts": 5}
