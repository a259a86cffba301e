"""Streams replayed file by file give what the batch twins give."""

import json
import os
import time

from pyspark.sql import functions as F

from millrace.functions.times import from_seconds
from millrace.operators.cdc import parse_changes
from millrace.operators.logs import parse_logs
from millrace.plans import dwd, dws, serving
from millrace.sources import sinks
from millrace.sources.readers import elements, text_lines
from millrace.streaming import jobs, stateful

T0 = 1718236800


def feed(path, *batches):
    os.makedirs(path)
    for i, lines in enumerate(batches):
        with open(f"{path}/{i:03d}.txt", "w") as f:
            f.write("\n".join(lines))
        os.utime(f"{path}/{i:03d}.txt", (time.time() + i, time.time() + i))
    return str(path)


def event(user, seconds, **more):
    return json.dumps({"user_id": user, "ts": T0 + seconds} | more)


def events(spark, path, stream, more=""):
    rows = text_lines(spark, path, stream).select(F.from_json("value", f"user_id string, ts bigint{more}").alias("v")).select("v.*")
    return rows.withColumns({"et": from_seconds(F.col("ts")), "date": F.date_format(from_seconds(F.col("ts")), "yyyy-MM-dd")})


FLUSH = 30 * 86_400


def test_daily_users(spark, tmp_path):
    path = feed(tmp_path / "in", [event("a", 0), event("b", 1)], [event("a", 15), event("c", 16)], [event("a", 86_401)], [event("z", FLUSH)], [event("z", FLUSH + 60)])
    jobs.drain(jobs.daily_users_stream(events(spark, path, True), "user_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = dws.cart_add_users(events(spark, path, False))
    want = sorted(tuple(r) for r in batch.where("cur_date < '2024-07-01'").collect())
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("cur_date < '2024-07-01'").collect()) == want


def test_first_of_day_repair_and_log_ins(spark, tmp_path):
    path = feed(tmp_path / "in", [event("a", 0, is_new="1"), event("a", 5, is_new="1")], [event("a", 86_401, is_new="1"), event("b", 86_402, is_new="0")], [event("b", 86_403, is_new="1"), event("a", 9 * 86_400, is_new="0")], [event("z", FLUSH, is_new="0")])
    rows = lambda stream: events(spark, path, stream, ", is_new string")
    live = rows(True).withWatermark("et", "0 seconds")
    jobs.drain(stateful.first_of_day(live, ["user_id"]), str(tmp_path / "o1"), str(tmp_path / "c1"))
    got = sorted((r.user_id, r.ts - T0) for r in spark.read.parquet(str(tmp_path / "o1")).where("first").collect())
    assert got == [("a", 0), ("a", 86_401), ("a", 9 * 86_400), ("b", 86_402), ("z", FLUSH)]
    jobs.drain(stateful.repair_is_new(rows(True).withWatermark("et", "0 seconds"), "user_id"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    from millrace.operators.visits import logins, repair_is_new

    want = sorted((r.user_id, r.ts, r.is_new) for r in repair_is_new(rows(False), "user_id").collect())
    assert sorted((r.user_id, r.ts, r.is_new) for r in spark.read.parquet(str(tmp_path / "o2")).collect()) == want
    jobs.drain(stateful.logins(rows(True).withWatermark("et", "0 seconds"), "user_id"), str(tmp_path / "o3"), str(tmp_path / "c3"))
    want = sorted((r.user_id, r.date, r.back_ct) for r in logins(rows(False), "user_id", "date", "et").collect())
    assert sorted((r.user_id, r.date, r.back_ct) for r in spark.read.parquet(str(tmp_path / "o3")).collect()) == want


def change(table, ts, data):
    return json.dumps({"database": "shop", "table": table, "type": "insert", "ts": T0 + ts, "data": data})


def test_order_detail_stream(spark, tmp_path):
    line = lambda i, o: {"id": i, "order_id": o, "sku_id": 5, "sku_name": "n", "create_time": "2024-06-13 00:00:00", "sku_num": 2, "order_price": "3.5", "split_total_amount": "7"}
    path = feed(
        tmp_path / "in",
        [change("order_detail", 0, line(1, 10)), change("order_info", 0, {"id": 10, "user_id": 1, "province_id": 2}), change("order_detail", 0, line(2, 10))],
        [change("order_detail_activity", 2, {"order_detail_id": 1, "activity_id": 8, "activity_rule_id": 9})],
        [change("order_detail_coupon", 4, {"order_detail_id": 2, "coupon_id": 6})],
        [change("order_detail", 3600, line(90, 91)), change("order_info", 3600, {"id": 91, "user_id": 1, "province_id": 2}), change("order_detail_activity", 3600, {"order_detail_id": 0}), change("order_detail_coupon", 3600, {"order_detail_id": 0})],
        [change("other", 7200, {"id": 1})],
        [change("other", 7300, {"id": 1})],
    )
    jobs.drain(jobs.order_detail_stream(parse_changes(text_lines(spark, path, True))), str(tmp_path / "out"), str(tmp_path / "cp"), 240)
    cols = dwd.ORDER_DETAIL
    want = sorted(map(str, dwd.order_detail(parse_changes(text_lines(spark, path))).where("id <> '90'").select(cols).collect()))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).where("id <> '90'").select(cols).collect())) == want


def test_log_split_to_folders(spark, tmp_path):
    rec = lambda mid, **k: json.dumps({"common": {"mid": mid, "is_new": "1"}, "page": {"page_id": "home"}, "ts": T0 * 1000} | k)
    path = feed(tmp_path / "in", [rec("a", displays=[{"item": "1"}])], [rec("b", start={"entry": "icon"}), "{oops"])
    q = jobs.split_to_folders(text_lines(spark, path, True), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    count = lambda t: spark.read.parquet(str(tmp_path / "out" / t)).count()
    assert {t: count(t) for t in ("dirty", "err", "start", "display", "action", "page")} == {"dirty": 1, "err": 0, "start": 1, "display": 1, "action": 0, "page": 1}
    assert parse_logs(text_lines(spark, path)).where("dirty is not null").count() == 1


def test_sinks_are_idempotent(spark, tmp_path):
    df = elements(spark, [("t1", "x"), ("t2", "y")], "topic string, value string")
    write = sinks.by_topic(str(tmp_path / "topics"))
    write(df, 0)
    write(df, 0)
    assert spark.read.parquet(str(tmp_path / "topics")).count() == 2
    merge = sinks.dimension_merge(str(tmp_path / "dim"))
    schema = "sink_table string, row_key string, op string, data map<string,string>, seq bigint"
    merge(elements(spark, [("t", "1", "insert", {"a": "1", "b": "2"}, 1)], schema), 0)
    for _ in range(2):
        merge(elements(spark, [("t", "1", "update", {"a": "5", "b": ""}, 2)], schema), 1)
    assert spark.read.parquet(str(tmp_path / "dim" / "rows" / "version=1")).collect()[0].data == {"a": "5", "b": "2"}
    up = sinks.keyed(elements(spark, [("1", "+I", 1), ("1", "-D", 2), ("2", "+I", 3)], "id string, op string, n int"), "id").withColumn("at", F.monotonically_increasing_id())
    assert [r.key for r in sinks.latest_per_key(up, "at").collect()] == ["2"]
    did = []
    conf = elements(spark, [("r", "dim_a", "info", 1), ("u", "dim_a", "info", 2), ("d", "dim_a", "info", 3)], "op string, sink_table string, sink_family string, ts_ms bigint")
    sinks.dimension_tables(conf, lambda t: did.append(("drop", t)), lambda t, f: did.append(("create", t)))
    assert did == [("create", "dim_a"), ("drop", "dim_a"), ("create", "dim_a"), ("drop", "dim_a")]


def test_serving(spark, tmp_path):
    p, t = str(tmp_path / "province"), str(tmp_path / "traffic")
    sinks.append_by_date(elements(spark, [("2024-06-13", "north", 2.5), ("2024-06-13", "north", 1.0), ("2024-06-14", "south", 9.0)], "cur_date string, province_name string, order_amount double"), p)
    sinks.append_by_date(elements(spark, [("2024-06-13", "b", 3), ("2024-06-13", "a", 3), ("2024-06-13", "c", 9)], "cur_date string, ch string, uv_ct bigint"), t)
    assert json.loads(serving.gmv_json(serving.gmv(spark, p, 20240613))) == {"status": 0, "data": 3.5}
    assert json.loads(serving.gmv_json(serving.gmv(spark, p, 20200101)))["data"] is None
    assert json.loads(serving.province_json(serving.province_amounts(spark, p, 20240613)))["data"]["mapData"] == [{"name": "north", "value": 3.5}]
    assert json.loads(serving.channel_json(serving.top_channels(spark, t, 20240613, 2)))["data"]["categories"] == ["c", "a"]


def test_latest_version_after_a_wait(spark, tmp_path):
    line = lambda i, t, v: json.dumps({"id": i, "ts": T0 + t, "body": v})
    path = feed(tmp_path / "in", [line("1", 0, "a"), line("2", 0, "x")], [line("1", 2, "b")], [line("9", 60, "z")], [line("9", 120, "z")], [line("9", 180, "z")])
    rows = text_lines(spark, path, True).select(F.from_json("value", "id string, ts bigint, body string").alias("v")).select("v.*").withColumn("et", from_seconds(F.col("ts"))).withWatermark("et", "0 seconds")
    jobs.drain(stateful.latest(rows), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.id, r.body) for r in spark.read.parquet(str(tmp_path / "out")).where("id <> '9'").collect())
    assert got == [("1", "b"), ("2", "x")]


def test_province_orders_stream(spark, tmp_path):
    line = lambda i, o, t, v: json.dumps({"id": i, "order_id": o, "province_id": "17", "split_total_amount": v, "ts": T0 + t})
    path = feed(tmp_path / "in", [line("1", "10", 0, "2.50"), line("2", "10", 1, "1.00")], [line("1", "10", 2, "2.50"), line("3", "11", 3, "4.00")], [line("8", "99", 600, "1")], [line("9", "99", 1200, "1")])
    schema = "id string, order_id string, province_id string, split_total_amount string, ts bigint"
    rows = lambda stream: text_lines(spark, path, stream).select(F.from_json("value", schema).alias("v")).select("v.*")
    jobs.drain(jobs.province_order_stream(rows(True)), str(tmp_path / "out"), str(tmp_path / "cp"))
    names = elements(spark, [("17", "north")], "id string, name string")
    want = [(r.stt, r.order_count, r.order_amount) for r in dws.province_order(rows(False), names).where("stt < '2024-06-13 00:05:00'").collect()]
    assert [(r.stt, r.order_count, r.order_amount) for r in spark.read.parquet(str(tmp_path / "out")).where("stt < '2024-06-13 00:05:00'").collect()] == want
