"""Member tables derived from the driver's tables, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

T0, STEP = 1_700_000_000_000_000_000, 1_000_000_007

#: DuckDB views that queries may name; each is put in front of a query's SQL when it is used.
VIEWS = {
    "m": f"""SELECT concat(lang, '/', source, '/d', lpad(CAST(doc_id AS VARCHAR), 8, '0'), '.txt') AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size,
        CAST({T0} + doc_id * {STEP} AS BIGINT) AS mtime_ns, doc_id, sha256(text) AS digest, lang, source FROM documents""",
    "ta": "SELECT path, size, mtime_ns, doc_id FROM m WHERE doc_id % 11 <> 0",
    "tb": "SELECT path, size + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size, mtime_ns + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS mtime_ns, doc_id FROM m WHERE doc_id % 7 <> 0",
    "prior": "SELECT path, size, mtime_ns, CASE WHEN doc_id % 17 = 0 THEN -4 WHEN doc_id % 19 = 0 THEN -2 ELSE doc_id // 8 END AS frame FROM tb",
    "fr": """SELECT path, size, doc_id, doc_id % 3 AS shard, doc_id // 8 AS frame, (doc_id // 8) * 100000 AS coff,
        CAST(sum(size) OVER (PARTITION BY doc_id % 3, doc_id // 8) * (30 + (doc_id // 8) % 70) // 100 AS BIGINT) AS clen FROM m""",
    "ch": "SELECT path, doc_id, no, off, len FROM (SELECT path, doc_id, size, unnest(range(0, size, 700)) AS off FROM m) s, LATERAL (SELECT CAST(off // 700 AS BIGINT) AS no, least(700, size - off) AS len)",
    "cn": "SELECT path, no, off, len, (doc_id * 31 + no * (1 + doc_id % 2)) % 1000 AS id FROM ch",
    "co": "SELECT path, no, off + CASE WHEN no > 2 THEN 64 ELSE 0 END AS off, len, (doc_id * 31 + no) % 1000 AS id FROM ch WHERE doc_id % 3 <> 0",
    "ino": "SELECT conv_id % 7 AS dev, conv_id AS ino, count(*) OVER (PARTITION BY conv_id) AS nlink, concat('c', CAST(conv_id % 7 AS VARCHAR), '/t', lpad(CAST(turn AS VARCHAR), 4, '0'), '-', CAST(conv_id AS VARCHAR)) AS path FROM conversations",
    "snap": """SELECT CAST(o_orderkey AS BIGINT) AS "at", CAST(epoch_us(o_orderdate) * 1000 AS BIGINT) AS time_ns, o_custkey AS store, lag(CAST(o_orderkey AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders""",
    "ev": "SELECT event_id, ts, user_id, event_type, value FROM events",
}


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        F.concat("lang", F.lit("/"), "source", F.lit("/d"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        (F.lit(T0) + F.col("doc_id") * F.lit(STEP)).cast("long").alias("mtime_ns"),
        "doc_id",
        F.sha2("text", 256).alias("digest"),
        "lang",
        "source",
    )


def tree_a(spark, sf_dir):
    return members(spark, sf_dir).filter("doc_id % 11 <> 0").select("path", "size", "mtime_ns", "doc_id")


def tree_b(spark, sf_dir):
    b = members(spark, sf_dir).filter("doc_id % 7 <> 0")
    return b.select("path", (F.col("size") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("size"), (F.col("mtime_ns") + F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0)).alias("mtime_ns"), "doc_id")


def prior(spark, sf_dir):
    frame = F.when(F.col("doc_id") % 17 == 0, -4).when(F.col("doc_id") % 19 == 0, -2).otherwise(F.expr("doc_id div 8")).cast("long")
    return tree_b(spark, sf_dir).select("path", "size", "mtime_ns", frame.alias("frame"))


def framed(spark, sf_dir):
    """Members of three shards in frames of eight, with a stored length per frame."""
    m = members(spark, sf_dir).select("path", "size", "doc_id", F.expr("doc_id % 3").alias("shard"), F.expr("doc_id div 8").alias("frame"))
    stored = m.groupBy("shard", "frame").agg(F.expr("cast(sum(size) * (30 + frame % 70) div 100 as bigint)").alias("clen"))
    return m.join(stored, ["shard", "frame"]).withColumn("coff", F.expr("frame * 100000"))


def chunks(spark, sf_dir):
    c = members(spark, sf_dir).filter("size > 0").select("path", "doc_id", "size", F.explode(F.expr("sequence(0L, size - 1, 700L)")).alias("off"))
    return c.select("path", "doc_id", F.expr("off div 700").alias("no"), "off", F.expr("least(700L, size - off)").alias("len"))


def new_chunks(spark, sf_dir):
    return chunks(spark, sf_dir).select("path", "no", "off", "len", F.expr("(doc_id * 31 + no * (1 + doc_id % 2)) % 1000").alias("id"))


def old_chunks(spark, sf_dir):
    return chunks(spark, sf_dir).filter("doc_id % 3 <> 0").select("path", "no", F.expr("off + CASE WHEN no > 2 THEN 64 ELSE 0 END").alias("off"), "len", F.expr("(doc_id * 31 + no) % 1000").alias("id"))


def inodes(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("nlink"))
    path = F.concat(F.lit("c"), F.expr("conv_id % 7").cast("string"), F.lit("/t"), F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit("-"), F.col("conv_id").cast("string"))
    return c.join(n, "conv_id").select(F.expr("conv_id % 7").alias("dev"), F.col("conv_id").alias("ino"), "nlink", path.alias("path"))


def snapshots(spark, sf_dir):
    """All orders as snapshots; a customer's orders are the chain of one store."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = F.col("o_orderkey").cast("long")
    return o.select(at.alias("at"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("time_ns"), F.col("o_custkey").alias("store"), F.lag(at).over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("prev"))


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
