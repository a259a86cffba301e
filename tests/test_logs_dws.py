"""Log split, visitor state and windowed summaries."""

import json

from pyspark.sql import functions as F

from millrace.functions import strings, text, times
from millrace.operators.dedup import retractions
from millrace.operators.joins import changelog_left_join
from millrace.operators.logs import parse_logs, repair_visitors, split_logs
from millrace.plans import dws
from millrace.sources.readers import elements

DAY = 86_400_000
T0 = 1718236800000  # 2024-06-13 00:00:00 UTC


def log(mid="m1", ts=T0, is_new="1", page=None, uid=None, **parts):
    return json.dumps({"common": {"mid": mid, "uid": uid, "vc": "v1", "ch": "c1", "ar": "1", "is_new": is_new}, "page": page or {"page_id": "home"}, "ts": ts} | parts)


def logs(spark, *records):
    return parse_logs(elements(spark, [(r,) for r in records], "value string"))


def test_split(spark):
    df = logs(
        spark, log(displays=[{"item": "1"}, {"item": "2"}], actions=[{"action_id": "a"}]), log(start={"entry": "icon"}, displays=[{"item": "3"}]), log(err={"error_code": 5}, displays=[]), '{"common": {', None
    )
    out = {k: v.collect() for k, v in split_logs(df).items()}
    assert {k: len(v) for k, v in out.items()} == {"dirty": 1, "err": 1, "start": 1, "display": 2, "action": 1, "page": 2}
    assert "ts" not in out["action"][0].asDict() and out["display"][0].ts == T0 and out["err"][0].err.error_code == 5


def test_new_visitors(spark):
    df = logs(spark, log("a", T0), log("a", T0 + 1), log("a", T0 + DAY), log("b", T0, "0"), log("b", T0 + 5, "1"), log("c", T0, "0"))
    got = sorted((r.common.mid, r.ts, r.common.is_new) for r in repair_visitors(df).collect())
    # b's first record isn't new: its date becomes the day before, so a later '1' is wrong
    assert got == [("a", T0, "1"), ("a", T0 + 1, "1"), ("a", T0 + DAY, "0"), ("b", T0, "0"), ("b", T0 + 5, "0"), ("c", T0, "0")]


def pages(spark, *records):
    return split_logs(logs(spark, *records))["page"]


def test_traffic_sums_skip_null_durations(spark):
    df = pages(spark, log("a", T0, page={"page_id": "home", "during_time": 5}), log("a", T0 + 1000, page={"page_id": "home", "last_page_id": "x"}), log("b", T0 + 2000, page={"page_id": "home", "during_time": 7}), log("a", T0 + DAY))
    rows = sorted(tuple(r) for r in dws.traffic_page_view(df).collect())
    assert rows[0] == ("2024-06-13 00:00:00", "2024-06-13 00:00:10", "2024-06-13", "v1", "c1", "1", "1", 2, 2, 3, 12)
    assert rows[1][7:10] == (1, 1, 1)


def test_home_and_detail_uniques_are_apart(spark):
    df = pages(spark, log("a", T0), log("a", T0 + 1), log("a", T0 + 2, page={"page_id": "good_detail"}), log("b", T0 + 3), log("a", T0 + 4, page={"page_id": "cart"}))
    assert [tuple(r)[3:] for r in dws.home_detail_page_view(df).collect()] == [(2, 1)]


def test_log_in_and_back(spark):
    at = lambda d, **k: log("m", T0 + d * DAY, uid="u", page={"page_id": "home", **k})
    df = pages(spark, at(0), at(0, last_page_id="login"), at(7), at(15, last_page_id="login"), at(40, last_page_id="cart"), log("m", T0, page={"page_id": "home"}))
    assert sorted(tuple(r)[2:] for r in dws.user_login(df).collect()) == [("2024-06-13", 0, 1), ("2024-06-20", 0, 1), ("2024-06-28", 1, 1)]


def test_keywords(spark):
    df = pages(spark, log(page={"page_id": "list", "last_page_id": "search", "item_type": "keyword", "item": "Red phone red"}), log(page={"page_id": "list", "last_page_id": "search", "item_type": "keyword", "item": "--"}))
    assert sorted((r.keyword, r.keyword_count) for r in dws.keyword_page_view(df).collect()) == [("phone", 1), ("red", 2)]
    cut = elements(spark, [("小米手机5G",), (None,)], "t string").select(text.keywords(F.col("t"), ("小米", "手机", "米手")).alias("k")).collect()
    assert cut[0].k == ["小米", "手机", "5g"] and cut[1].k == []


DETAIL = "id string, order_id string, sku_id string, province_id string, split_original_amount string, split_activity_amount string, split_coupon_amount string, split_total_amount string, ts bigint"


def test_province_and_sku_orders_count_the_last_version(spark):
    s = T0 // 1000
    rows = [("1", "10", "5", "17", "10.0000", None, "0.0", "8.0", s), ("1", "10", "5", "17", "10.0000", "1.0", "0.0", "9.0", s), ("2", "10", "6", "17", "5", "0", "0", "5", s + 1), ("3", "11", "5", "99", "1", "0", "0", "1", s + 1)]
    df = elements(spark, rows, DETAIL)
    got = sorted((r.province_id, r.province_name, r.order_count, float(r.order_amount)) for r in dws.province_order(df, elements(spark, [("17", "north")], "id string, name string")).collect())
    assert got == [("17", "north", 1, 14.0), ("99", "", 1, 1.0)]
    e = lambda rows, schema: elements(spark, rows, schema)
    dims = {
        "sku": e([("5", "n5", "s1", "c3", "t1"), ("6", "n6", "s9", "c9", "t9")], "id string, sku_name string, spu_id string, category3_id string, tm_id string"), "spu": e([("s1", "spu")], "id string, spu_name string"), "trademark": e([("t1", "tm")], "id string, tm_name string"),
        "category3": e([("c3", "three", "c2")], "id string, name string, category2_id string"), "category2": e([("c2", "two", "c1")], "id string, name string, category1_id string"), "category1": e([("c1", "one")], "id string, name string"),
    }
    out = {r.sku_id: r for r in dws.sku_order(df, dims).collect()}
    assert float(out["5"].order_amount) == 10.0 and float(out["5"].activity_reduce_amount) == 1.0 and out["5"].category1_name == "one" and out["6"].category1_name is None and out["6"].sku_name == "n6"


def test_cart_users_once_a_day(spark):
    s = T0 // 1000
    df = elements(spark, [("1", s), ("1", s + 5), ("2", s + 5), ("1", s + 86400)], "user_id string, ts bigint")
    assert sorted(tuple(r)[2:] for r in dws.cart_add_users(df).collect()) == [("2024-06-13", 2), ("2024-06-14", 1)]


def test_retractions_telescope_with_nulls_and_negatives(spark):
    df = elements(spark, [("1", 1, None), ("1", 2, -5), ("1", 3, 7), ("2", 1, 4)], "id string, v int, amount int")
    out = retractions(df, ["id"], ["v"], ["amount"])
    assert {r.id: r.s for r in out.groupBy("id").agg(F.sum("amount").alias("s")).collect()} == {"1": 7, "2": 4}


def test_outer_join_messages(spark):
    left = elements(spark, [("a", 5), ("b", 1), ("c", 1)], "k string, t int")
    right = elements(spark, [("a", 3), ("b", 4), ("b", 6)], "k string, t int")
    got = sorted((r.k, r.at, r.op, r.r_t is None) for r in changelog_left_join(left, right, "k", "t", "t").collect())
    assert got == [("a", 5, "+I", False), ("b", 1, "+I", True), ("b", 4, "+I", False), ("b", 4, "-D", True), ("b", 6, "+I", False), ("c", 1, "+I", True)]


def test_names_times_and_json(spark):
    assert strings.to_camel("sku_order_ct") == "skuOrderCt" and strings.to_snake("skuOrderCt") == "sku_order_ct"
    df = elements(spark, [("2024-06-13 19:35:25", None, 3)], "dateTime string, skuName string, ts int")
    r = df.select(times.millis_of_datetime(F.col("dateTime")).alias("ms"), strings.bean_json(df, hidden=("ts",)).alias("j")).collect()[0]
    assert r.ms == 1718278525000 and json.loads(r.j) == {"date_time": "2024-06-13 19:35:25"}
    assert spark.range(1).select(times.date_of_millis(F.lit(T0)).alias("d"), times.today_partition().alias("p")).collect()[0].d == "2024-06-13"


def test_keyword_table_function_equals_the_expression(spark):
    df = elements(spark, [(1, "Red phone 小米手机5G red"), (2, "--"), (3, None)], "id int, t string")
    text.register_keyword_function(spark, "cut", ("小米", "手机"))
    df.createOrReplaceTempView("searches")
    got = sorted(tuple(r) for r in spark.sql("select id, word from searches, lateral cut(searches.t)").collect())
    assert got == sorted(tuple(r) for r in text.explode_keywords(df, "t", "word", ("小米", "手机")).select("id", "word").collect()) and len(got) == 6
