"""Counters, costs, windows over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.operators import telemetry as ops
from stowage.plans import fixtures as fx
from stowage.plans.registry import query


def _counters(spark, d):
    """Cumulative counters of each user, from the events' ids."""
    return fx.table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_id") * 3).alias("bytes"), F.expr("event_id div 2").alias("frames"))


@query("SELECT event_id, user_id, ts, event_id * 3 AS bytes, event_id // 2 AS frames, event_id * 3 - lag(event_id * 3) OVER w AS d_bytes, event_id // 2 - lag(event_id // 2) OVER w AS d_frames FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def counter_diff(spark, d):
    """W11, T7."""
    return ops.counter_rates(_counters(spark, d), ["user_id"], ["ts", "event_id"], ["bytes", "frames"])


@query("""
WITH f AS (SELECT shard, frame, CAST(sum(size) AS BIGINT) AS in_bytes, any_value(clen) AS clen FROM fr GROUP BY shard, frame), p AS (SELECT shard, frame, min(path) AS first FROM fr GROUP BY shard, frame)
SELECT f.shard, f.frame, (frame_s * 1.0) AS seconds, round(in_bytes / 1e6 / greatest(frame_s, 1e-9), 3) AS mb_s, round(clen / greatest(in_bytes, 1), 4) AS ratio, concat(string_split(first, '/')[1], '/', string_split(first, '/')[2]) AS root
FROM (SELECT *, CAST((frame % 50 + 1) * 1000000 AS DOUBLE) / 1e9 AS frame_s FROM f) f LEFT JOIN p ON f.shard = p.shard AND f.frame = p.frame""")
def frame_costs(spark, d):
    """J11, V16, X23."""
    f = fx.framed(spark, d)
    frames = f.groupBy("shard", "frame").agg(F.sum("size").cast("long").alias("in_bytes"), F.max("clen").alias("clen"))
    frames = frames.withColumn("t0_ns", F.lit(fx.T0)).withColumn("t1_ns", F.lit(fx.T0) + (F.col("frame") % 50 + 1) * 1_000_000)
    return ops.frame_costs(frames, f, by=("shard", "frame"))


@query("""
WITH s AS (SELECT CAST(sum(1000) AS DOUBLE) AS w, CAST(sum(event_id % 700) AS DOUBLE) AS c, CAST(sum(event_id % 100) AS DOUBLE) AS r, CAST(sum(user_id % 90) AS DOUBLE) AS wr, CAST(sum(event_id % 40) AS DOUBLE) AS i FROM ev),
h AS (SELECT round(c / w, 6) AS compress, round(r / w, 6) AS read, round(wr / w, 6) AS write, round(i / w, 6) AS idle FROM s)
SELECT *, CASE WHEN compress >= 0.85 THEN 'cpu' WHEN write >= 0.5 THEN 'sink' WHEN read >= 0.5 THEN 'source' WHEN idle >= 0.5 THEN 'planner' ELSE 'balanced' END AS bottleneck FROM h""")
def perf_report(spark, d):
    """A15."""
    e = fx.table(spark, d, "events")
    return ops.bottleneck(e.select(F.lit(1000).alias("worker_ns"), F.expr("event_id % 700").alias("compress_ns"), F.expr("event_id % 100").alias("read_ns"), F.expr("user_id % 90").alias("write_ns"), F.expr("event_id % 40").alias("idle_ns")))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM ev GROUP BY 1, 2")
def events_tumbling(spark, d):
    """T7, windows."""
    e = fx.table(spark, d, "events")
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "cents")


@query("SELECT time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes' AS start, count(*) AS n FROM ev, (VALUES (0), (1), (2), (3)) v(k) GROUP BY 1")
def events_sliding(spark, d):
    """Hour windows, one each quarter."""
    g = fx.table(spark, d, "events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""
WITH f AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS nw FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM f)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS finish, count(*) AS n FROM s GROUP BY user_id, s""")
def events_session(spark, d):
    """Sessions of 30 minutes."""
    g = fx.table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("finish"), "n")
