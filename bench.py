"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from millrace.plans.catalogue import QUERIES
from millrace.session import session

HEADLINE = ["dws_province_order", "dws_sku_order", "dwd_order_detail", "dwd_pay_suc", "dwd_order_refund", "dwd_refund_pay", "dwd_cart_add", "dwd_log_split_page", "dim_merge", "fix_is_new", "dws_traffic_view", "dws_user_login", "dws_home_detail_uv", "dws_cart_uu", "dedup_latest", "dedup_retract", "keyword_count", "ads_channel_topn", "outer_join_changelog"]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    extra = {"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    spark = session("bench", master=f"local[{cpus}]", **extra)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["dws_province_order"](spark, path).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(path.rsplit("sf", 1)[-1])}))
    spark.stop()


if __name__ == "__main__":
    main()
