"""Scans, filters, projections and aggregates of member tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.functions import globs, paths
from stowage.operators import members as ops
from stowage.plans import fixtures as fx
from stowage.plans.registry import query
from stowage.schema import kind


@query("SELECT path, size, mtime_ns, doc_id, digest, lang, source FROM m")
def members(spark, d):
    """S1, F1, X11."""
    return fx.members(spark, d)


@query("SELECT path, CAST(false AS BOOLEAN) AS is_dir FROM m")
def scan_names(spark, d):
    """Only names are read, so the scan needs no text."""
    return fx.members(spark, d).select("path", F.lit(False).alias("is_dir"))


@query("SELECT CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files FROM m")
def disk_usage(spark, d):
    """A1."""
    return ops.disk_usage(fx.members(spark, d))


@query("SELECT source, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM m GROUP BY ROLLUP (source)")
def scan_totals(spark, d):
    """A2."""
    return ops.scan_totals(fx.members(spark, d), "source")


@query(r"SELECT path, size FROM m WHERE regexp_matches(path, '^en/.*/d0000000.\.txt$') OR regexp_matches(path, '^.*/src1/.*$')")
def glob_filter(spark, d):
    """F2, F3."""
    return fx.members(spark, d).filter(globs.glob_any(F.col("path"), ["en/*/d0000000?.txt", "*/src1/*"])).select("path", "size")


@query(r"SELECT path, size FROM m WHERE regexp_matches(path, '^en/.*$') AND NOT regexp_matches(path, '^.*/src1.*$') AND size >= 800")
def member_filter(spark, d):
    """F4."""
    return fx.members(spark, d).filter(globs.member_filter(F.col("path"), F.col("size"), ["en/*"], ["*/src1*"], 800)).select("path", "size")


@query(rf"SELECT path, size FROM m WHERE regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^d.*5\.txt$') AND size >= 100 AND size <= 4000 AND mtime_ns > {fx.T0 + 50 * fx.STEP}")
def find(spark, d):
    """sorted."""
    wanted = globs.find(F.col("path"), F.col("size"), F.col("mtime_ns"), "d*5.txt", 100, 4000, fx.T0 + 50 * fx.STEP)
    return fx.members(spark, d).filter(wanted).select("path", "size").orderBy("path")


@query(r"""
WITH x AS (SELECT path, regexp_matches(path, '^(?:.*/)?src1.$') AS f1, regexp_matches(path, '^(?:.*/)?.*7\.txt$') AS f2,
    regexp_matches(path, '^de/src2/.*$') AS f3, regexp_matches(path, '^de/src2/.*7\.txt$') AS keep, string_split(path, '/')[2] AS s FROM m)
SELECT path, regexp_matches(s, '^src1.$') OR (f2 AND NOT keep) OR (f3 AND NOT keep) AS ignored FROM x
""")
def ignore_rules(spark, d):
    """A directory that is ignored takes all below it along; the last rule that fits decides on a path."""
    rules = globs.ignore_rules(["# names", "src1?/", "*7.txt", "de/src2/**", "!de/src2/*7.txt"])
    return fx.members(spark, d).select("path", globs.ignored_below(F.col("path"), rules).alias("ignored"))


@query("SELECT path, size FROM m WHERE contains(string_split(path, '/')[3], '0012') ORDER BY path LIMIT 20 OFFSET 5")
def search_page(spark, d):
    """F6, O3."""
    return ops.page(ops.search(fx.members(spark, d), q="0012"), ["path"], 5, 20).select("path", "size")


@query(r"""
SELECT path, list_extract(string_split(path, '/'), -1) AS name, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS ext,
    concat(lang, '/', source) AS dir, lang AS top, concat(lang, '/', source) AS top2, CAST(2 AS INT) AS depth,
    CAST(strlen(path) AS INT) AS bytes, concat('root/', path) AS rooted FROM m""")
def path_parts(spark, d):
    """X1-X5, O7."""
    p = F.col("path")
    return fx.members(spark, d).select("path", paths.basename(p).alias("name"), paths.extension(p).alias("ext"), paths.dirname(p).alias("dir"), paths.head(p, 1).alias("top"), paths.head(p, 2).alias("top2"), paths.depth(p).alias("depth"), F.octet_length(p).alias("bytes"), F.concat(F.lit("root/"), p).alias("rooted"))


@query("""
SELECT path, CASE frame WHEN -4 THEN 'extents' WHEN -2 THEN 'symlink' ELSE 'file' END AS kind FROM prior""")
def kinds(spark, d):
    """F7."""
    return fx.prior(spark, d).select("path", kind().alias("kind"))


@query("SELECT path, CAST((33188 + doc_id) & 4095 AS BIGINT) AS bits, CAST(mtime_ns // 1000000000 AS BIGINT) AS seconds, CAST(mtime_ns % 1000000000 AS BIGINT) AS nanos FROM m")
def mode_bits(spark, d):
    """F10, X9."""
    return fx.members(spark, d).select("path", (F.lit(33188) + F.col("doc_id")).bitwiseAND(0o7777).cast("long").alias("bits"), F.expr("mtime_ns div 1000000000").alias("seconds"), F.pmod("mtime_ns", F.lit(1_000_000_000)).alias("nanos"))


@query("SELECT m.path, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM m LEFT JOIN labels l USING (doc_id)")
def filled(spark, d):
    """F11, X26."""
    labels = fx.table(spark, d, "labels")
    return fx.members(spark, d).join(labels, "doc_id", "left").select("path", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("quality", "toxic")])


@query("SELECT frame, path FROM fr WHERE frame % 4 = 1")
def frame_modulo(spark, d):
    """F12."""
    return fx.framed(spark, d).filter(F.pmod("frame", F.lit(4)) == 1).select("frame", "path")


@query("SELECT * FROM m SEMI JOIN labels USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_anti(spark, d):
    """F8, J16."""
    labels = fx.table(spark, d, "labels")
    return fx.members(spark, d).join(labels, "doc_id", "left_semi").join(labels.filter("toxic = 1"), "doc_id", "left_anti").select("path", "size", "mtime_ns", "doc_id", "digest", "lang", "source")


@query("""
WITH f AS (SELECT shard, coff, clen, CAST(sum(size) AS BIGINT) AS payload FROM fr GROUP BY ALL), g AS (SELECT *, payload > 0 AND clen > 64 AS good FROM f)
SELECT count(*) FILTER (good) AS frames, CAST(coalesce(sum(payload) FILTER (good), 0) AS BIGINT) AS payload, CAST(coalesce(sum(clen) FILTER (good), 0) AS BIGINT) AS stored,
    CAST(sum(clen) FILTER (good) AS DOUBLE) / CAST(sum(payload) FILTER (good) AS DOUBLE) AS ratio, median(CAST(clen AS DOUBLE) / payload) FILTER (good) AS median_ratio,
    count(*) FILTER (NOT good) AS bogus_frames, CAST(coalesce(sum(payload) FILTER (NOT good), 0) AS BIGINT) AS bogus_payload FROM g""")
def store_stats(spark, d):
    """A3."""
    return ops.store_stats(fx.framed(spark, d))


@query("""
WITH f AS (SELECT shard, coff, clen, CAST(sum(size) AS BIGINT) AS payload FROM fr GROUP BY ALL), r AS (SELECT *, CAST(clen AS DOUBLE) / CAST(payload AS DOUBLE) AS ratio FROM f WHERE payload > 0 AND clen > 64),
e AS (SELECT [0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 1.001, 1e9]::DOUBLE[] AS e), b AS (SELECT unnest(range(0, 14)) AS i, e FROM e)
SELECT CAST(i AS INT) AS bucket, e[i + 1] AS low, e[i + 2] AS high, count(*) AS frames, CAST(sum(payload) AS BIGINT) AS payload FROM r JOIN b ON ratio >= e[i + 1] AND ratio < e[i + 2] GROUP BY ALL""")
def ratio_histogram(spark, d):
    """A3."""
    return ops.ratio_histogram(fx.framed(spark, d))


@query("SELECT frame, min_by(path, path) AS first, CAST(sum(size) AS BIGINT) AS bytes, list(path ORDER BY path) AS paths, string_agg(list_extract(string_split(path, '/'), -1), ' ' ORDER BY list_extract(string_split(path, '/'), -1)) AS names FROM fr GROUP BY frame")
def frame_lists(spark, d):
    """A4, A5, A6."""
    name = paths.basename(F.col("path"))
    return fx.framed(spark, d).groupBy("frame").agg(F.min_by("path", "path").alias("first"), F.sum("size").cast("long").alias("bytes"), F.array_sort(F.collect_list("path")).alias("paths"), F.array_join(F.array_sort(F.collect_list(name)), " ").alias("names"))


@query("WITH u AS (SELECT path, size, 1 AS seq FROM ta UNION ALL SELECT path, size, 2 FROM tb) SELECT path, size, seq FROM u QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1")
def keep_last(spark, d):
    """A7, S15."""
    both = fx.tree_a(spark, d).select("path", "size", F.lit(1).alias("seq")).unionByName(fx.tree_b(spark, d).select("path", "size", F.lit(2).alias("seq")))
    return ops.keep_last(both, ["path"], [F.col("seq")])


@query("SELECT DISTINCT lang, source, size // 1000 AS kb FROM m")
def distinct_rows(spark, d):
    """A8."""
    return fx.members(spark, d).select("lang", "source", F.expr("size div 1000").alias("kb")).distinct()


@query("SELECT source AS value, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, value LIMIT 16")
def source_topk(spark, d):
    """A9, O4."""
    return ops.value_counts(fx.members(spark, d), F.col("source"), 16)


@query("SELECT count(DISTINCT frame) AS frames, count(DISTINCT (shard, frame)) AS stored_frames, max(coff + clen) AS cursor, min(coff) AS first FROM fr")
def distinct_frames(spark, d):
    """A10, A11."""
    return fx.framed(spark, d).agg(F.count_distinct("frame").alias("frames"), F.count_distinct(F.struct("shard", "frame")).alias("stored_frames"), F.max(F.col("coff") + F.col("clen")).alias("cursor"), F.min("coff").alias("first"))


@query("""
WITH x AS (SELECT concat(lang, '/', source) AS dir, size FROM m), l2 AS (SELECT dir, count(*) AS n, CAST(sum(size) AS BIGINT) AS b FROM x GROUP BY dir), l1 AS (SELECT string_split(dir, '/')[1] AS dir, count(*) AS n FROM l2 GROUP BY 1)
SELECT dir, CAST(2 AS INT) AS depth, n AS child_count, b AS dir_total_size FROM l2 UNION ALL SELECT dir, CAST(1 AS INT), n, CAST(0 AS BIGINT) FROM l1 UNION ALL SELECT '', CAST(0 AS INT), count(*), CAST(0 AS BIGINT) FROM l1""")
def dir_aggregates(spark, d):
    """A12, S3."""
    return ops.directories(fx.members(spark, d))


@query("""
WITH f AS (SELECT *, first_value(path) OVER (PARTITION BY dev, ino ORDER BY path) AS first FROM ino)
SELECT dev, ino, nlink, path, CASE WHEN path = first THEN 'file' ELSE 'hardlink' END AS link_kind, CASE WHEN path = first THEN '' ELSE first END AS link FROM f""")
def hardlink_canonical(spark, d):
    """J15, S1."""
    return ops.hardlinks(fx.inodes(spark, d))


@query("""
WITH f AS (SELECT *, first_value(path) OVER (PARTITION BY dev, ino ORDER BY path) AS first FROM ino), k AS (SELECT path, first FROM f WHERE ino % 5 <> 0 OR path <> first)
SELECT a.path, a.first AS target, b.path IS NOT NULL AS resolved FROM (SELECT * FROM k WHERE path <> first) a LEFT JOIN (SELECT * FROM k WHERE path = first) b ON a.first = b.path""")
def link_targets(spark, d):
    """Hardlinks whose file is there."""
    h = ops.hardlinks(fx.inodes(spark, d)).filter("ino % 5 <> 0 OR link_kind = 'hardlink'")
    files = h.filter("link_kind = 'file'").select(F.col("path").alias("target"), F.lit(True).alias("there"))
    return h.filter("link_kind = 'hardlink'").select("path", F.col("link").alias("target")).join(files, "target", "left").select("path", "target", F.coalesce("there", F.lit(False)).alias("resolved"))


@query("SELECT path, size FROM m ORDER BY md5(concat(path, ':', '0')), path LIMIT 25")
def sample_members(spark, d):
    """O5, X24."""
    return ops.sample(fx.members(spark, d).select("path", "size"), F.col("path"), 25)


@query("SELECT part, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT size, CAST(CAST(concat('0x', substr(md5(concat(path, ':', '3')), 1, 8)) AS BIGINT) % 6 AS INT) AS part FROM m) GROUP BY part")
def shuffled_split(spark, d):
    """O6."""
    return fx.members(spark, d).groupBy(ops.split_by_hash(F.col("path"), 6, 3).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("bytes"))


@query("SELECT path, length(path) - length(replace(path, '/', '')) AS depth FROM ta WHERE size > 5000 ORDER BY depth DESC, path")
def depth_order(spark, d):
    """O1, O2, X3."""
    return fx.tree_a(spark, d).filter("size > 5000").select("path", paths.depth(F.col("path")).cast("long").alias("depth")).orderBy(F.desc("depth"), "path")


@query("SELECT path, row_number() OVER (ORDER BY path) - 1 AS id FROM m")
def row_ids(spark, d):
    """W8."""
    return ops.numbered(fx.members(spark, d).select("path"), ["path"])
