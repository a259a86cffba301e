"""Sources and the service against servers of their own."""

import json
import socket
import threading
import time
import urllib.error
import urllib.request

import pytest

from millrace.plans import serving
from millrace.sources import readers, sinks


def test_socket_lines_as_columns(spark, tmp_path):
    with socket.create_server(("127.0.0.1", 0)) as listening:

        def feed():
            conn, _ = listening.accept()
            with conn:
                conn.sendall(b"1, ann ,2.5\n2,bob,x3\n3,cid,4.0\n")
                time.sleep(15)

        threading.Thread(target=feed, daemon=True).start()
        rows = readers.socket_csv(spark, "127.0.0.1", listening.getsockname()[1], "id int, name string, amount string")
        got = []
        q = rows.writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            end = time.time() + 60
            while len(got) < 3 and time.time() < end:
                time.sleep(0.2)
        finally:
            q.stop()
    assert sorted(got) == [(1, "ann", "2.5"), (2, "bob", "x3"), (3, "cid", "4.0")]


def test_database_rows(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        spark.createDataFrame([(1, "a"), (2, "b")], "order_id int, user_name string").write.format("jdbc").options(url=url, dbtable="orders", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    except Exception as e:
        if "ClassNotFound" in str(e) or "No suitable driver" in str(e):
            pytest.skip("no embedded database here")
        raise
    out = readers.jdbc_rows(spark, url, 'select "order_id", "user_name" from orders where "order_id" > 1', camel=True, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert out.columns == ["orderId", "userName"] and [tuple(r) for r in out.collect()] == [(2, "b")]


def test_service_routes(spark, tmp_path):
    p, t = str(tmp_path / "province"), str(tmp_path / "traffic")
    sinks.append_by_date(readers.elements(spark, [("2024-06-13", "north", 2.5), ("2024-06-13", "south", 1.0), ("2024-06-14", "south", 9.0)], "cur_date string, province_name string, order_amount double"), p)
    sinks.append_by_date(readers.elements(spark, [("2024-06-13", "b", 3), ("2024-06-13", "a", 3), ("2024-06-13", "c", 9)], "cur_date string, ch string, uv_ct bigint"), t)
    server = serving.server(serving.routes(spark, p, t), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda path: json.loads(urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", timeout=60).read())
    try:
        assert get("/gmv?date=20240613") == {"status": 0, "data": 3.5} and get("/gmv") == {"status": 0, "data": None}
        assert get("/province?date=20240613")["data"]["mapData"] == [{"name": "north", "value": 2.5}, {"name": "south", "value": 1.0}]
        assert get("/ch?date=20240613&limit=2")["data"] == {"categories": ["c", "a"], "series": [{"name": serving.CHANNEL_NAME, "data": [9, 3]}]}
        for path, code in (("/none", 404), ("/gmv?date=x", 400)):
            with pytest.raises(urllib.error.HTTPError) as e:
                get(path)
            assert e.value.code == code
    finally:
        server.shutdown()


def test_processing_time_is_one_for_a_query(spark):
    from millrace.functions.times import processing_time, today_partition

    rows = spark.range(1000).select(processing_time().alias("at"), today_partition().alias("day")).distinct().collect()
    assert len(rows) == 1 and rows[0].day // 10_000 >= 2024
