"""Differences, incremental runs, lookups and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.operators import delta as ops
from stowage.plans import fixtures as fx
from stowage.plans.registry import query
from stowage.schema import union_eras

DIFF = """
WITH s AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed'
    WHEN a.size = b.size AND a.mtime_ns // 1000000000 = b.mtime_ns // 1000000000 THEN 'unchanged' ELSE 'changed' END AS status
    FROM ta a FULL JOIN tb b ON a.path = b.path)
"""


@query(DIFF + "SELECT status, count(*) AS n FROM s GROUP BY status")
def delta_diff(spark, d):
    """Classes of paths between two trees."""
    return ops.diff_trees(fx.tree_a(spark, d), fx.tree_b(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(DIFF + "SELECT path, status FROM s")
def delta_paths(spark, d):
    """J4, V9."""
    return ops.diff_trees(fx.tree_a(spark, d), fx.tree_b(spark, d))


INCREMENTAL = "SELECT a.path, a.size, coalesce((p.frame >= 0 OR p.frame = -4) AND a.size = p.size AND a.mtime_ns = p.mtime_ns, false) AS unchanged FROM ta a LEFT JOIN prior p ON a.path = p.path"


@query(INCREMENTAL)
def wal_unchanged(spark, d):
    """J1, J2."""
    return ops.incremental(fx.tree_a(spark, d), fx.prior(spark, d)).select("path", "size", "unchanged")


@query(f"WITH i AS ({INCREMENTAL}) SELECT path, size FROM i WHERE NOT unchanged")
def wal_changed(spark, d):
    """J1."""
    return ops.incremental(fx.tree_a(spark, d), fx.prior(spark, d)).filter("NOT unchanged").select("path", "size")


@query("SELECT path, frame FROM prior WHERE path NOT IN (SELECT path FROM ta)")
def wal_deleted(spark, d):
    """J3."""
    return ops.deleted(fx.tree_a(spark, d), fx.prior(spark, d)).select("path", "frame")


@query("""
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'delete' WHEN b.path IS NULL OR a.size <> b.size OR a.mtime_ns <> b.mtime_ns THEN 'send' ELSE 'keep' END AS action
FROM ta a FULL JOIN tb b ON a.path = b.path""")
def sync_actions(spark, d):
    """J6, V10."""
    return ops.sync_plan(fx.tree_a(spark, d), fx.tree_b(spark, d), [F.col("size"), F.col("mtime_ns")])


@query("SELECT path, 'missing' AS problem FROM ta WHERE path NOT IN (SELECT path FROM tb) UNION ALL SELECT path, 'extra' FROM tb WHERE path NOT IN (SELECT path FROM ta)")
def verify_complete(spark, d):
    """J14, V3."""
    return ops.missing_and_extra(fx.tree_a(spark, d), fx.tree_b(spark, d))


@query("SELECT a.path, a.size, coalesce(m.digest, '') AS digest FROM ta a LEFT JOIN (SELECT path, digest FROM m WHERE doc_id % 4 <> 0) m ON a.path = m.path")
def digest_join(spark, d):
    """J7."""
    told = fx.members(spark, d).filter("doc_id % 4 <> 0").select("path", "digest")
    return fx.tree_a(spark, d).join(told, "path", "left").select("path", "size", F.coalesce("digest", F.lit("")).alias("digest"))


@query("SELECT c.path, c.no, c.off, o.id FROM ch c LEFT JOIN co o ON c.path = o.path AND c.no = o.no")
def piece_chunks(spark, d):
    """J8."""
    old = fx.old_chunks(spark, d).select("path", "no", "id")
    return fx.chunks(spark, d).join(old, ["path", "no"], "left").select("path", "no", "off", "id")


@query("SELECT f.path, f.frame, l.coff, l.clen FROM fr f LEFT JOIN (SELECT DISTINCT shard, frame, coff, clen FROM fr WHERE frame % 9 <> 0) l ON f.frame = l.frame AND f.shard = l.shard")
def locators(spark, d):
    """Plan with the places of its frames; a frame that wasn't made has none."""
    f = fx.framed(spark, d)
    done = f.filter("frame % 9 <> 0").select("shard", "frame", "coff", "clen").distinct()
    return f.select("path", "shard", "frame").join(done, ["shard", "frame"], "left").select("path", "frame", "coff", "clen")


EXTENTS = "SELECT path, size, doc_id, unnest(range(0, size, 2000)) AS out_off FROM m WHERE size > 0"


@query(f"""
WITH x AS ({EXTENTS}), e AS (SELECT path, out_off, least(2000, size - out_off) AS elen, out_off * 3 + doc_id AS coff FROM x WHERE (out_off // 2000) % 4 <> 3)
SELECT c.path, c.off, c.len, e.out_off, e.coff + c.off - e.out_off AS coff, c.off + c.len <= e.out_off + e.elen AS contained FROM ch c ASOF JOIN e ON c.path = e.path AND c.off >= e.out_off""")
def range_lookup(spark, d):
    """J12."""
    x = fx.members(spark, d).filter("size > 0").select("path", "size", "doc_id", F.explode(F.expr("sequence(0L, size - 1, 2000L)")).alias("out_off")).filter("(out_off div 2000) % 4 <> 3")
    e = x.select("path", "out_off", F.expr("least(2000L, size - out_off)").alias("elen"), F.expr("out_off * 3 + doc_id").alias("coff"))
    return ops.locate(fx.chunks(spark, d), e)


MATCH = """
WITH o AS (SELECT path, id, arg_min(off, no) AS ooff, arg_min(len, no) AS olen FROM co GROUP BY path, id),
j AS (SELECT n.path, n.no, n.off, n.len, n.id, CASE WHEN o.olen = n.len THEN o.ooff END AS old_off FROM cn n LEFT JOIN o ON n.path = o.path AND n.id = o.id)
"""
SEGMENTS = MATCH + """
, f AS (SELECT *, old_off IS NOT NULL AS is_old, coalesce(old_off - off, 0) AS shift FROM j),
g AS (SELECT *, CASE WHEN lag(is_old) OVER w IS NULL OR lag(is_old) OVER w <> is_old OR lag(shift) OVER w <> shift THEN 1 ELSE 0 END AS nw FROM f WINDOW w AS (PARTITION BY path ORDER BY no)),
s AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY path ORDER BY no) AS BIGINT) AS seg FROM g),
t AS (SELECT path, seg, is_old, min(off) AS off, CAST(sum(len) AS BIGINT) AS len, min(old_off) AS old_off, count(*) AS n FROM s GROUP BY path, seg, is_old)
"""


@query(MATCH + "SELECT path, no, off, len, id, old_off FROM j")
def chunk_lookup(spark, d):
    """J13, B2."""
    return ops.match_chunks(fx.new_chunks(spark, d), fx.old_chunks(spark, d))


@query(SEGMENTS + "SELECT path, seg, is_old, off, len, old_off, n FROM t")
def chunk_segments(spark, d):
    """W12."""
    return ops.segments(ops.match_chunks(fx.new_chunks(spark, d), fx.old_chunks(spark, d)))


@query(SEGMENTS + """, p AS (SELECT path, coalesce(sum(len) FILTER (is_old), 0) AS old, sum(len) AS al FROM t GROUP BY path)
SELECT CASE WHEN old = al THEN 'carried' WHEN old > 0 THEN 'delta' ELSE 'full' END AS class, count(*) AS members, CAST(sum(old) AS BIGINT) AS carried_bytes, CAST(sum(al - old) AS BIGINT) AS literal_bytes FROM p GROUP BY 1""")
def delta_summary(spark, d):
    """A18."""
    from stowage.operators.telemetry import delta_summary as summary

    return summary(ops.segments(ops.match_chunks(fx.new_chunks(spark, d), fx.old_chunks(spark, d))))


@query("SELECT path, size FROM ta EXCEPT ALL SELECT path, size FROM tb")
def except_all(spark, d):
    """U3."""
    return fx.tree_a(spark, d).select("path", "size").exceptAll(fx.tree_b(spark, d).select("path", "size"))


@query("SELECT path, size FROM ta INTERSECT SELECT path, size FROM tb")
def intersect(spark, d):
    """U3."""
    return fx.tree_a(spark, d).select("path", "size").intersect(fx.tree_b(spark, d).select("path", "size"))


@query("SELECT path, size, 420 AS mode, -1 AS digest, '' AS link FROM ta UNION ALL SELECT path, size, doc_id, doc_id, 'x' FROM tb")
def schema_union(spark, d):
    """Tables of two eras."""
    old = fx.tree_a(spark, d).select("path", "size", "mtime_ns", F.lit(0).alias("frame"))
    new = fx.tree_b(spark, d).select("path", "size", "mtime_ns", F.lit(0).alias("frame"), F.col("doc_id").alias("mode"), F.col("doc_id").alias("digest"), F.lit("x").alias("link"))
    return union_eras(old, new).select("path", "size", "mode", "digest", "link")


@query("SELECT DISTINCT concat(lang, '/', source) AS path, 'dir' AS kind FROM m UNION ALL SELECT path, 'file' FROM m UNION ALL SELECT concat(path, '.lnk'), 'symlink' FROM m WHERE doc_id % 10 = 0")
def typed_union(spark, d):
    """U2."""
    m = fx.members(spark, d)
    dirs = m.select(F.concat("lang", F.lit("/"), "source").alias("path"), F.lit("dir").alias("kind")).distinct()
    return dirs.unionByName(m.select("path", F.lit("file").alias("kind"))).unionByName(m.filter("doc_id % 10 = 0").select(F.concat("path", F.lit(".lnk")).alias("path"), F.lit("symlink").alias("kind")))


@query("SELECT CAST('a' AS VARCHAR) AS store, path, size FROM ta UNION ALL SELECT 'b', path, size FROM tb")
def store_union(spark, d):
    """U4, S12."""
    side = lambda name, t: t.select(F.lit(name).alias("store"), "path", "size")
    return side("a", fx.tree_a(spark, d)).unionByName(side("b", fx.tree_b(spark, d)))
