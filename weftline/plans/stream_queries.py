"""Streams over the events table, run to their end; and user functions, retries, caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import add
from weftline.operators import control as C
from weftline.session import scratch_dir, table
from weftline.streaming import events as E


def _events(s, d):
    """The events as a stream of Parquet files, ordered by time in four files."""
    path = scratch_dir(s)
    e = table(s, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round("value", 2).alias("value"))
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{path}/in")
    return E.read_files(s, f"{path}/in", 2), f"{path}/out"


def _run(s, d, build, mode):
    stream, out = _events(s, d)
    return E.run_to(build(stream), out, mode)


_US = lambda c: F.unix_micros(c)
add("stream_tumbling_hours", lambda s, d: _run(s, d, lambda e: E.tumbling(e, "ts", "1 hour", ["event_type"], "30 days", F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")), "complete").select(_US("start").alias("start"), "event_type", "n", "cents"),
    "SELECT epoch_us(time_bucket(INTERVAL 1 hour, ts::TIMESTAMP)) AS start, event_type, count(*) AS n, sum(round(round(value, 2) * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2")
add("stream_sliding_windows", lambda s, d: _run(s, d, lambda e: E.sliding(e, "ts", "6 hours", "3 hours", [], "30 days", F.count(F.lit(1)).alias("n")), "complete").select(_US("start").alias("start"), "n"),
    "SELECT epoch_us(w) AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 3 hour, ts::TIMESTAMP), time_bucket(INTERVAL 3 hour, ts::TIMESTAMP) - INTERVAL 3 hour]) AS w FROM events) GROUP BY 1")
add("stream_sessions", lambda s, d: _run(s, d, lambda e: E.sessions(e, "ts", "2 hours", ["user_id"], "60 days", F.count(F.lit(1)).alias("n")), "complete").select("user_id", _US("start").alias("start"), _US("end").alias("finish"), "n"),
    "SELECT user_id, min(t) AS start, max(t) + 7200000000 AS finish, count(*) AS n FROM (SELECT user_id, t, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, g")
add("stream_closed_windows", lambda s, d: _run(s, d, lambda e: E.tumbling(e, "ts", "1 day", [], "1 hour", F.count(F.lit(1)).alias("n")), "append").select(_US("start").alias("start"), "n"),
    "SELECT epoch_us(w) AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 day, ts::TIMESTAMP) AS w FROM events) GROUP BY w HAVING w + INTERVAL 1 day <= (SELECT max(ts)::TIMESTAMP - INTERVAL 1 hour FROM events)")
add("stream_first_seen", lambda s, d: _run(s, d, lambda e: E.first_seen(e, ["user_id"], "ts", "400 days"), "append").select("user_id"), "SELECT DISTINCT user_id FROM events")
add("stream_running_counts", lambda s, d: _run(s, d, lambda e: E.running_counts(e.select("user_id", "ts", F.lit(1.0).alias("value")), "user_id", "ts", "1 day", 86_400_000 * 400), "update").groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select("user_id", "x.n", "x.total"),
    "SELECT user_id, count(*) AS n, count(*)::DOUBLE AS total FROM events GROUP BY 1")
add("stream_static_join", lambda s, d: _run(s, d, lambda e: E.with_static(e.select("event_id", (F.col("user_id") % 25).alias("n_nationkey")), table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"), ["n_nationkey"]), "append").select("event_id", "n_name"), "SELECT event_id, n_name FROM events JOIN nation ON user_id % 25 = n_nationkey")


def _within(s, d):
    clicks = lambda e: e.where("event_type = 'click'").select(F.col("event_id").alias("c"), "user_id", F.col("ts").alias("cts"))
    views = lambda e: e.where("event_type = 'view'").select(F.col("event_id").alias("v"), "user_id", F.col("ts").alias("vts"))
    stream, out = _events(s, d)
    return E.run_to(E.within(clicks(stream), views(stream), ["user_id"], "cts", "vts", "1 HOUR", "60 days").select("c", "v"), out, "append")


add("stream_stream_join", _within, "SELECT a.event_id AS c, b.event_id AS v FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 0 AND 3600000000")

# ---- user functions and flow control
add("parallel_map_orders", lambda s, d: C.parallel_map(table(s, d, "orders").select("o_orderkey", "o_totalprice"), lambda f: f.assign(o_totalprice=f["o_totalprice"].astype(float) * 2), "o_orderkey long, o_totalprice double").select("o_orderkey", F.round("o_totalprice", 2).alias("v")), "SELECT o_orderkey, round(o_totalprice::DOUBLE * 2, 2) AS v FROM orders")
add("executor_map_parts", lambda s, d: C.threaded_map(table(s, d, "part").select("p_partkey", "p_name"), "p_name", len, "long", 4).select("p_partkey", "result"), "SELECT p_partkey, length(p_name)::BIGINT AS result FROM part")
add("gather_any_row", lambda s, d: C.first_finished(table(s, d, "region").select(F.lit(1).alias("one"))), "SELECT 1 AS one")
add("retrier_schedule", lambda s, d: C.wait_times(s, 1, 5, 2, 3), "SELECT * FROM (VALUES (0::BIGINT, 1.0::DOUBLE), (1, 2), (2, 3), (3, 3)) t(attempt, wait)")


def _counted(s, d):
    df, seen = C.counted(table(s, d, "orders"))
    df.write.format("noop").mode("overwrite").save()
    return s.createDataFrame([(seen.get["n"],)], "n long")


add("count_iter_observed", _counted, "SELECT count(*) AS n FROM orders")


def _cached(s, d):
    root, built = scratch_dir(s), []

    def build():
        built.append(1)
        return table(s, d, "region").select("r_name")

    for _ in range(3):
        out = C.cached(s, root, ("regions", d), build)
    return out.withColumn("built", F.lit(len(built)))


add("cache_region_table", _cached, "SELECT r_name, 1 AS built FROM region")
add("compose_transforms", lambda s, d: C.compose(lambda x: x.select("n_nationkey"), lambda x: x.where("n_regionkey < 3"))(table(s, d, "nation")), "SELECT n_nationkey FROM nation WHERE n_regionkey < 3")
add("multiapply_transforms", lambda s, d: C.apply_all([lambda x: x.where("n_regionkey = 1"), lambda x: x.select("n_name")], table(s, d, "nation")), "SELECT n_name FROM nation WHERE n_regionkey = 1")
add("default_except_divide", lambda s, d: table(s, d, "nation").select("n_nationkey", C.default_on_error("divide(100, n_regionkey)", F.lit(-1.0)).alias("v")), "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN -1.0::DOUBLE ELSE 100.0::DOUBLE / n_regionkey END AS v FROM nation")
add("iter_except_quarantine", lambda s, d: C.good_and_bad(table(s, d, "documents"), F.length("text") > 500)[1].select("doc_id"), "SELECT doc_id FROM documents WHERE coalesce(length(text) <= 500, true)")
add("list_except_permissive", lambda s, d: s.createDataFrame([("1",), ("x",), ("3",)], "t string").select("t", F.col("t").try_cast("int").alias("v")), "SELECT * FROM (VALUES ('1', 1), ('x', NULL), ('3', 3)) t(t, v)")
