"""Offsets, frames, pieces, batches and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.functions import paths
from stowage.operators import layout as ops
from stowage.plans import fixtures as fx
from stowage.plans.registry import query


@query("SELECT path, source, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM m")
def prefix_offsets(spark, d):
    """W1."""
    return fx.members(spark, d).select("path", "source", ops.before("size", ["source"], ["path"]).alias("off"))


@query("""
WITH c AS (SELECT path, source, size, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 65536 AS cell FROM m),
f AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY cell) - 1 AS frame FROM c)
SELECT path, source, frame, CAST(coalesce(sum(size) OVER (PARTITION BY source, frame ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS in_off FROM f""")
def frame_grid(spark, d):
    """W1, W3, W13, V17."""
    return ops.grid_frames(fx.members(spark, d).select("path", "source", "size"), ["source"], ["path"], 65536).select("path", "source", "frame", "in_off")


@query("""
WITH RECURSIVE o AS (SELECT path, source, size, row_number() OVER (PARTITION BY source ORDER BY path) AS rn FROM m),
g AS (SELECT path, source, size, rn, CAST(0 AS BIGINT) AS frame, CAST(0 AS BIGINT) AS in_off, size AS filled FROM o WHERE rn = 1
    UNION ALL SELECT o.path, o.source, o.size, o.rn, CASE WHEN g.filled + o.size > 20000 THEN g.frame + 1 ELSE g.frame END,
        CASE WHEN g.filled + o.size > 20000 THEN 0 ELSE g.filled END, CASE WHEN g.filled + o.size > 20000 THEN o.size ELSE g.filled + o.size END
    FROM g JOIN o ON o.source = g.source AND o.rn = g.rn + 1)
SELECT path, source, frame, in_off FROM g""")
def frame_greedy(spark, d):
    """W2, W4."""
    return ops.greedy_frames(fx.members(spark, d).select("path", "source", "size"), ["source"], ["path"], 20000).select("path", "source", "frame", "in_off")


TAR = """
WITH l AS (SELECT path, CASE WHEN doc_id % 6 = 0 THEN repeat('x', CAST(doc_id % 300 AS INT)) ELSE '' END AS link, size, frame FROM fr),
h AS (SELECT *, CAST(512 + CASE WHEN strlen(path) > 100 THEN 512 + ((strlen(path) + 1 + 511) // 512) * 512 ELSE 0 END + CASE WHEN strlen(link) > 100 THEN 512 + ((strlen(link) + 1 + 511) // 512) * 512 ELSE 0 END AS BIGINT) AS hlen FROM l)
"""


def _linked(spark, d):
    return fx.framed(spark, d).select("path", F.when(F.col("doc_id") % 6 == 0, F.repeat(F.lit("x"), F.expr("cast(doc_id % 300 as int)"))).otherwise("").alias("link"), "size", "frame")


@query(TAR + "SELECT path, hlen, ((size + 511) // 512) * 512 AS padded FROM h")
def tar_lengths(spark, d):
    """X6, X7."""
    return _linked(spark, d).select("path", paths.header_length(F.col("path"), F.col("link")).alias("hlen"), paths.padded(F.col("size")).alias("padded"))


@query(TAR + "SELECT path, frame, CAST(coalesce(sum(hlen + ((size + 511) // 512) * 512) OVER (PARTITION BY frame ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + hlen AS BIGINT) AS body_off FROM h")
def body_offsets(spark, d):
    """W9."""
    return ops.tar_offsets(_linked(spark, d)).select("path", "frame", "body_off")


@query("""
WITH n AS (SELECT path, size, CASE WHEN size = 0 THEN 1 WHEN size % 2000 = 0 THEN size // 2000 WHEN size % 2000 < 300 AND size > 2000 THEN size // 2000 ELSE size // 2000 + 1 END AS n FROM m),
p AS (SELECT path, size, n, unnest(range(0, n)) AS no FROM n)
SELECT path, CAST(no AS INT) AS no, CAST(no * 2000 AS BIGINT) AS src_off, CAST(CASE WHEN no = n - 1 THEN size - no * 2000 ELSE 2000 END AS BIGINT) AS len FROM p""")
def pieces(spark, d):
    """X20."""
    return ops.pieces(fx.members(spark, d).select("path", "size"), 2000, 300).select("path", "no", "src_off", "len")


@query("SELECT path, no, CAST(coalesce(sum(len) OVER (PARTITION BY path ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS out_off, list(len) OVER (PARTITION BY path ORDER BY off ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS last_two FROM ch")
def extent_offsets(spark, d):
    """W6."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("path").orderBy("off").rowsBetween(-1, 0)
    return fx.chunks(spark, d).select("path", "no", ops.before("len", ["path"], ["off"]).alias("out_off"), F.collect_list("len").over(w).alias("last_two"))


@query("SELECT path, frame, (row_number() OVER (PARTITION BY source ORDER BY path) - 1) // 16 AS chunk FROM (SELECT m.path, m.source, fr.frame FROM m JOIN fr ON m.path = fr.path)")
def row_chunks(spark, d):
    """W7."""
    from pyspark.sql.window import Window

    f = fx.framed(spark, d).select("path", "frame", F.element_at(F.split("path", "/"), 2).alias("source"))
    return f.select("path", "frame", F.expr("(row_number() OVER (PARTITION BY source ORDER BY path) - 1) div 16").alias("chunk"))


@query("""
WITH f AS (SELECT frame, count(*) AS n FROM fr GROUP BY frame), a AS (SELECT frame, coalesce(sum(n) OVER (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_row FROM f),
b AS (SELECT frame, dense_rank() OVER (ORDER BY begin_row // 100) - 1 AS batch FROM a)
SELECT fr.path, fr.frame, b.batch FROM fr JOIN b ON fr.frame = b.frame""")
def footer_batches(spark, d):
    """Cuts every 100 rows, moved on to the next frame."""
    return ops.batches(fx.framed(spark, d).select("path", "frame"), 100).select("path", "frame", "batch")


@query("""
WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS nw FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, run, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first FROM (SELECT *, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS run FROM f) GROUP BY user_id, run""")
def run_islands(spark, d):
    """W5."""
    e = ops.runs(fx.table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    return e.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("""
WITH r AS (SELECT source, doc_id * 3000 AS off, size AS len FROM m),
k AS (SELECT *, max(off + len) OVER (PARTITION BY source ORDER BY off, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR off > reach + 65536 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY off, len) - 1 AS BIGINT) AS island FROM k)
SELECT source, island, min(off) AS off, max(off + len) - min(off) AS len, count(*) AS n FROM i GROUP BY source, island""")
def range_coalesce(spark, d):
    """W14, S19."""
    r = fx.members(spark, d).select("source", F.expr("doc_id * 3000").alias("off"), F.col("size").alias("len"))
    return ops.coalesced(r, ["source"])
