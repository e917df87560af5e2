"""Snapshots, retention, live frames, roots, replication."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.operators import retention as ops
from stowage.plans import fixtures as fx
from stowage.plans.registry import query

DAY = "strftime(make_timestamp(time_ns // 1000), '%Y-%m-%d')"
WEEK = "strftime(make_timestamp(time_ns // 1000), '%G-%V')"
MONTH = "strftime(make_timestamp(time_ns // 1000), '%Y-%m')"


@query(f"""
WITH b AS (SELECT *, {DAY} AS d, {WEEK} AS w, {MONTH} AS mo FROM snap),
r AS (SELECT *, row_number() OVER (ORDER BY "at" DESC) AS n, dense_rank() OVER (ORDER BY d DESC) AS dr, row_number() OVER (PARTITION BY d ORDER BY "at" DESC) AS dn,
    dense_rank() OVER (ORDER BY w DESC) AS wr, row_number() OVER (PARTITION BY w ORDER BY "at" DESC) AS wn, dense_rank() OVER (ORDER BY mo DESC) AS mr, row_number() OVER (PARTITION BY mo ORDER BY "at" DESC) AS mn FROM b)
SELECT "at", time_ns, n <= 3 OR (dn = 1 AND dr <= 7) OR (wn = 1 AND wr <= 4) OR (mn = 1 AND mr <= 2) AS kept FROM r""")
def retention(spark, d):
    """A16, V14."""
    return ops.retain(fx.snapshots(spark, d).select("at", "time_ns"), last=3, daily=7, weekly=4, monthly=2)


@query(f'SELECT "at", {DAY} AS day, {WEEK} AS week, {MONTH} AS month FROM snap')
def calendar(spark, d):
    """X10 (UTC)."""
    s = fx.snapshots(spark, d)
    return s.select("at", ops._bucket("daily").alias("day"), ops._bucket("weekly").alias("week"), ops._bucket("monthly").alias("month"))


@query("""
WITH RECURSIVE c AS (SELECT "at" AS newest, 0 AS depth, "at", prev FROM snap WHERE "at" NOT IN (SELECT prev FROM snap WHERE prev IS NOT NULL)
    UNION ALL SELECT c.newest, c.depth + 1, s."at", s.prev FROM c JOIN snap s ON s."at" = c.prev)
SELECT newest, depth, "at" FROM c""")
def snapshot_chain(spark, d):
    """Each snapshot names the one before; whole chains, newest first."""
    return ops.chains(fx.snapshots(spark, d), ["store"]).filter("linked").select("newest", "depth", "at")


def _mixed(spark, d):
    f = fx.framed(spark, d)
    part = lambda k: F.struct((F.col("coff") + k * 7).alias("coff"), (F.col("clen") + k).alias("clen"), F.lit(0).cast("long").alias("in_off"), F.col("size").alias("len"), F.lit(0).cast("long").alias("out_off"), F.col("shard"))
    return f.select("path", "shard", F.when(F.col("doc_id") % 7 == 0, -4).when(F.col("doc_id") % 5 == 0, -1).otherwise(F.col("frame")).alias("frame"), "coff", "clen", F.array(part(0), part(1)).alias("extents"))


LIVE = """
WITH x AS (SELECT path, shard, CASE WHEN doc_id % 7 = 0 THEN -4 WHEN doc_id % 5 = 0 THEN -1 ELSE frame END AS frame, coff, clen FROM fr),
l AS (SELECT shard, coff, clen FROM x WHERE frame >= 0 UNION SELECT shard, coff, clen FROM x WHERE frame = -4 UNION SELECT shard, coff + 7, clen + 1 FROM x WHERE frame = -4)
"""


@query(LIVE + "SELECT shard, coff, clen FROM l")
def live_frames(spark, d):
    """U6, U5."""
    return ops.live_frames(_mixed(spark, d))


@query(LIVE + "SELECT shard, coff, clen, CAST(coalesce(sum(clen) OVER (PARTITION BY shard ORDER BY coff, clen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_coff FROM l")
def gc_moves(spark, d):
    """V14, X25."""
    return ops.moved(ops.live_frames(_mixed(spark, d)))


@query("""
WITH b AS (SELECT path, frame, coff, clen, size AS in_off, frame // 5 AS batch FROM fr), l AS (SELECT path, frame, coff, clen, size + CASE WHEN doc_id % 97 = 0 THEN 1 ELSE 0 END AS in_off FROM fr)
SELECT batch, count(*) AS rows, count(*) = count(l.path) AS reused FROM b LEFT JOIN l ON b.path = l.path AND b.frame = l.frame AND b.coff = l.coff AND b.clen = l.clen AND b.in_off = l.in_off GROUP BY batch""")
def batch_reuse(spark, d):
    """J10."""
    f = fx.framed(spark, d)
    b = f.select("path", "frame", "coff", "clen", F.col("size").alias("in_off"), F.expr("frame div 5").alias("batch"))
    latest = f.select("path", "frame", "coff", "clen", (F.col("size") + F.when(F.col("doc_id") % 97 == 0, 1).otherwise(0)).alias("in_off"))
    return ops.reusable_batches(b, latest)


@query("SELECT shard, frame, count(*) AS members, count(*) FILTER (doc_id % 10 <> 0) AS checked, count(*) FILTER (doc_id % 10 = 0) AS undigested, count(*) FILTER (doc_id % 10 <> 0 AND doc_id % 23 = 0) AS mismatched, any_value(clen) < CAST(sum(size) AS BIGINT) // 3 AS truncated FROM fr GROUP BY shard, frame")
def verify_counts(spark, d):
    """Counts over told and found digests of each frame."""
    from stowage.operators.verify import summary

    f = fx.framed(spark, d)
    told = f.select("shard", "frame", "size", F.when(F.col("doc_id") % 10 == 0, -1).otherwise(F.col("doc_id")).alias("digest"), F.when(F.col("doc_id") % 23 == 0, -5).otherwise(F.col("doc_id")).alias("found"), F.col("clen").alias("declared"))
    return summary(told, ["shard", "frame"], 3)


@query("SELECT s.shard, s.frame, s.bytes FROM (SELECT shard, frame, CAST(sum(size) AS BIGINT) AS bytes FROM fr GROUP BY ALL) s ANTI JOIN (SELECT DISTINCT shard, frame FROM fr WHERE frame % 3 = 0) r ON s.shard = r.shard AND s.frame = r.frame")
def push_segments(spark, d):
    """Segments that the other side lacks."""
    f = fx.framed(spark, d)
    mine = f.groupBy("shard", "frame").agg(F.sum("size").cast("long").alias("bytes"))
    return mine.join(f.filter("frame % 3 = 0").select("shard", "frame").distinct(), ["shard", "frame"], "left_anti")
