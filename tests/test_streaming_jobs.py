"""Streaming jobs replayed file by file against their batch twins, and the end of state."""

import json

from pyspark.sql import functions as F
from test_streaming import FLUSH, T0, change, event, events, feed

from millrace.functions.times import from_seconds
from millrace.operators.cdc import config_rows, parse_changes
from millrace.operators.logs import parse_logs, split_logs
from millrace.plans import dwd, dws
from millrace.sources.readers import elements, text_lines
from millrace.streaming import jobs, stateful

LATER = 40 * 86_400


def update(table, ts, data, old):
    return json.dumps({"database": "shop", "table": table, "type": "update", "ts": T0 + ts, "data": data, "old": old})


def drained(spark, df, tmp_path, name):
    jobs.drain(df, str(tmp_path / f"out_{name}"), str(tmp_path / f"cp_{name}"), 240)
    return spark.read.schema(df.schema).parquet(str(tmp_path / f"out_{name}"))


def same(got, want, *but):
    cols = [c for c in want.columns if c not in but]
    return sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


DETAIL = "id string, order_id string, user_id string, sku_id string, sku_name string, province_id string, activity_id string, activity_rule_id string, coupon_id string, date_id string, create_time string, sku_num string, split_original_amount string, split_activity_amount string, split_coupon_amount string, split_total_amount string, ts bigint"


def line(i, order, ts, **more):
    row = {"id": str(i), "order_id": str(order), "user_id": "1", "sku_id": str(i % 3), "sku_name": "n", "province_id": "17", "create_time": "2024-06-13 00:00:00", "sku_num": "2", "split_original_amount": "7.0000", "split_total_amount": "7.50", "ts": T0 + ts}
    return json.dumps(row | more)


def details(spark, path, stream):
    rows = text_lines(spark, path, stream).select(F.from_json("value", DETAIL).alias("v")).select("v.*").withColumn("et", from_seconds(F.col("ts")))
    return rows.withWatermark("et", "3 seconds") if stream else rows


def test_paid_and_cancelled_orders(spark, tmp_path):
    lines = feed(tmp_path / "d", [line(1, 10, 0), line(2, 10, 0)], [line(3, 11, 5), line(4, 12, 6)], [line(9, 99, LATER)])
    paid = lambda o, ts, code="1101": update("payment_info", ts, {"user_id": "1", "order_id": o, "payment_type": code, "callback_time": "2024-06-13 00:10:00", "payment_status": "1602"}, {"payment_status": "1601"})
    gone = lambda o, ts, old="1001": update("order_info", ts, {"id": o, "operate_time": "2024-06-13 00:20:00", "order_status": "1003"}, {"order_status": old})
    path = feed(tmp_path / "c", [paid("10", 600), gone("11", 30)], [paid("11", 1806), gone("12", 40, "1002")], [paid("12", 1807, "9"), gone("10", 1700)], [paid("98", LATER), gone("98", LATER)])
    dic = elements(spark, [("1101", "account")], "dic_code string, dic_name string")
    c = lambda stream: parse_changes(text_lines(spark, path, stream))
    want = dwd.pay_success(c(False), details(spark, lines, False), dic)
    assert want.count() == 2
    assert same(drained(spark, jobs.pay_success_stream(c(True), details(spark, lines, True), dic), tmp_path, "pay"), want)
    want = dwd.order_cancel(c(False), details(spark, lines, False))
    assert want.count() == 3
    assert same(drained(spark, jobs.order_cancel_stream(c(True), details(spark, lines, True)), tmp_path, "cancel"), want)


def test_refunds_and_their_payment(spark, tmp_path):
    info = lambda o, ts, status: update("order_info", ts, {"id": o, "user_id": "1", "province_id": "17", "order_status": status}, {"order_status": "1002"})
    ask = lambda i, o, ts: change("order_refund_info", ts, {"id": i, "user_id": "1", "order_id": o, "sku_id": "5", "refund_type": "1501", "refund_num": "1", "refund_amount": "2.00", "refund_reason_type": "1301", "refund_reason_txt": "t", "create_time": "2024-06-13 00:00:00"})
    done = lambda o, ts: update("order_refund_info", ts, {"order_id": o, "sku_id": "5", "refund_num": "1", "refund_status": "0705"}, {"refund_status": "0701"})
    paid = lambda i, o, ts: update("refund_payment", ts, {"id": i, "order_id": o, "sku_id": "5", "payment_type": "1101", "callback_time": "2024-06-14 00:00:00", "total_amount": "2.00", "refund_status": "1602"}, {"refund_status": "1601"})
    path = feed(tmp_path / "in", [ask("1", "10", 0), info("10", 2, "1005")], [info("11", 3, "1005"), ask("2", "11", 3)], [paid("3", "10", 60), done("10", 61), info("10", 62, "1006")], [change("other", LATER, {"id": 1})], [change("other", LATER + 60, {"id": 1})])
    dic = elements(spark, [("1101", "account"), ("1501", "refund"), ("1301", "late")], "dic_code string, dic_name string")
    c = lambda stream: parse_changes(text_lines(spark, path, stream))
    want = dwd.order_refund(c(False), dic)
    assert want.count() == 2 and same(drained(spark, jobs.order_refund_stream(c(True), dic), tmp_path, "refund"), want)
    want = dwd.refund_pay_success(c(False), dic)
    assert want.count() == 1 and same(drained(spark, jobs.refund_pay_stream(c(True), dic), tmp_path, "paid"), want)


def test_page_jobs(spark, tmp_path):
    def view(mid, s, page="home", last=None, uid=None, item=None):
        return json.dumps({"common": {"mid": mid, "uid": uid, "vc": "1", "ch": "c", "ar": "a", "is_new": "1"}, "page": {"page_id": page, "last_page_id": last, "item_type": "keyword" if item else None, "item": item, "during_time": 7}, "ts": (T0 + s) * 1000})

    # each job's filter reaches the source, so its own rows move its watermark
    path = feed(
        tmp_path / "in",
        [view("a", 0, uid="u"), view("a", 1, "good_detail", "home"), view("b", 2, "list", "search", item="Red apple")],
        [view("a", 12, "good_detail", "home"), view("b", 13, "list", "search", item="red pear"), view("c", 14, "home", "login", "w")],
        [view("a", 9 * 86_400, uid="u"), view("c", 9 * 86_400 + 1, "home", "login", "w")],
        *([view("z", at, uid="z"), view("z", at, "list", "search", item="end")] for at in (FLUSH, FLUSH + 60)),
    )
    pages = lambda stream: split_logs(parse_logs(text_lines(spark, path, stream)))["page"]
    old = "cur_date < '2024-07-01'"
    for live, batch in ((jobs.keyword_stream, dws.keyword_page_view), (jobs.traffic_stream, dws.traffic_page_view), (jobs.home_detail_stream, dws.home_detail_page_view), (jobs.user_login_stream, dws.user_login)):
        want = batch(pages(False)).where(old)
        assert want.count() > 1 and same(drained(spark, live(pages(True)), tmp_path, live.__name__).where(old), want), live.__name__


def test_amounts_by_last_versions(spark, tmp_path):
    more = {"split_total_amount": "10.25"}
    path = feed(tmp_path / "in", [line(1, 10, 0), line(2, 10, 1)], [line(1, 10, 0, **more), line(1, 10, 0), line(3, 11, 3, split_total_amount="9.00")], [line(8, 99, FLUSH)], [line(9, 98, FLUSH + 60)])
    old = "cur_date < '2024-07-01'"
    names = elements(spark, [("17", "north")], "id string, name string")
    want = dws.province_order(details(spark, path, False), names).where(old)
    assert [(r.order_count, float(r.order_amount)) for r in want.collect()] == [(2, 26.75)]
    assert same(drained(spark, jobs.province_order_stream(details(spark, path, True), names), tmp_path, "province").where(old), want)
    got = drained(spark, jobs.sku_order_stream(details(spark, path, True)), tmp_path, "sku").where(old)
    assert {(r.sku_id, float(r.order_amount), float(r.original_amount)) for r in got.collect()} == {("1", 10.25, 7.0), ("2", 7.5, 7.0), ("0", 9.0, 7.0)}


def test_dimensions_under_a_live_configuration(spark, tmp_path):
    columns = "source_table string, sink_table string, sink_columns string, sink_row_key string, sink_family string"
    row = lambda t: {"source_table": "user", "sink_table": t, "sink_columns": "id,name", "sink_row_key": "id", "sink_family": "info"}
    log = [{"op": "r", "after": row("dim_user"), "ts_ms": 1}]
    config = lambda: config_rows(spark.createDataFrame([(json.dumps(x),) for x in log], "value string"), columns)
    seen = []
    run = lambda: jobs.dimension_stream(text_lines(spark, str(tmp_path / "in"), True), config, "shop", str(tmp_path / "dim"), str(tmp_path / "cp"), lambda df: seen.append(df.count())).awaitTermination(120)
    feed(tmp_path / "in", [change("user", 0, {"id": "1", "name": "a", "age": "3"}), change("user", 1, {"id": "2", "name": "b"}), change("none", 1, {"id": "2"})])
    assert run()
    log.append({"op": "u", "before": row("dim_user"), "after": row("dim_people"), "ts_ms": 2})
    (tmp_path / "in" / "001.txt").write_text("\n".join([change("user", 5, {"id": "1", "name": "c"}), change("user", 6, {"id": "3", "name": ""})]))
    assert run()
    last = max((tmp_path / "dim" / "rows").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    rows = {(r.sink_table, r.row_key): r.data for r in spark.read.parquet(str(last)).collect()}
    assert rows == {("dim_user", "1"): {"id": "1", "name": "a"}, ("dim_user", "2"): {"id": "2", "name": "b"}, ("dim_people", "1"): {"id": "1", "name": "c"}, ("dim_people", "3"): {"id": "3"}}
    assert seen == [1, 2]


def test_dimension_versions_follow_the_rows(spark, tmp_path):
    from millrace.operators.cdc import merge_rows
    from millrace.sources.sinks import dimension_merge

    schema = "sink_table string, row_key string, op string, data map<string,string>, seq bigint"
    batches = [
        [("t", "1", "insert", {"a": "1", "b": "2"}, 1), ("t", "2", "insert", {"a": "9"}, 2)],
        [("t", "1", "update", {"a": "5", "b": ""}, 3), ("t", "2", "delete", {"a": "9"}, 4)],
        [("t", "2", "insert", {"c": "7"}, 5), ("t", "1", "delete", {}, 6), ("t", "1", "insert", {"d": "8"}, 7), ("t", "3", "update", {"a": ""}, 8)],
    ]
    merge = dimension_merge(str(tmp_path / "dim"))
    for i, rows in enumerate(batches):
        for _ in range(2):
            merge(elements(spark, rows, schema), i)
    got = {r.row_key: r.data for r in spark.read.parquet(str(tmp_path / "dim" / "rows" / "version=2")).collect()}
    want = {r.row_key: r.data for r in merge_rows(elements(spark, [x for b in batches for x in b], schema)).collect()}
    assert got == want == {"1": {"d": "8"}, "2": {"c": "7"}}
    assert sorted(p.name for p in (tmp_path / "dim" / "rows").iterdir()) == ["version=1", "version=2"]


def test_state_ends(spark, tmp_path):
    """A visitor who comes back after the time to live is new again."""
    day = 86_400
    path = feed(tmp_path / "in", [event("a", 0, is_new="1"), event("b", 0, is_new="1")], [event("b", day, is_new="0"), event("z", day, is_new="0")], [event("z", 3 * day + 60, is_new="0")], [event("b", 3 * day + 70, is_new="1"), event("z", 4 * day, is_new="0")], [event("a", 6 * day, is_new="1"), event("b", 6 * day, is_new="1")])
    rows = events(spark, path, True, ", is_new string").withWatermark("et", "0 seconds")
    got = drained(spark, stateful.repair_is_new(rows, "user_id", keep_days=3), tmp_path, "repair")
    fixed = {(r.user_id, (r.ts - T0) // day): r.is_new for r in got.collect()}
    # b was seen within three days each time and is known; a wasn't
    assert fixed["a", 6] == "1" and fixed["b", 3] == "0" and fixed["b", 6] == "0"
