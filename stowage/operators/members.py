"""Member tables: totals, statistics, dedup, links, directories, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.functions.paths import basename, depth, dirname, extension

#: Edges of the ratio histogram, closed to the left.
RATIO_EDGES = (0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 1.001, 1e9)


def disk_usage(members: DataFrame) -> DataFrame:
    """bytes, files of all rows that are no directories."""
    return members.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.count(F.lit(1)).alias("files"))


def scan_totals(members: DataFrame, store: str) -> DataFrame:
    """Files and bytes of each store, and of all (store null)."""
    return members.rollup(store).agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"))


def keep_last(df: DataFrame, key: list[str], seq: list[Column]) -> DataFrame:
    """The newest row of each key. One aggregation with a map-side part, not a window that sorts a hot key."""
    newest = F.max(F.struct(*[c.alias(f"s{i}") for i, c in enumerate(seq)], F.struct(*df.columns).alias("row")))
    return df.groupBy(*key).agg(newest.alias("m")).select("m.row.*")


def frame_ratios(members: DataFrame) -> DataFrame:
    """payload, stored and ratio of each frame."""
    g = members.groupBy("shard", "coff", "clen").agg(F.sum("size").cast("long").alias("payload"))
    return g.select("shard", "coff", F.col("clen").alias("stored"), "payload", F.try_divide(F.col("clen").cast("double"), F.col("payload").cast("double")).alias("ratio"))


def _good() -> Column:
    return (F.col("payload") > 0) & (F.col("stored") > 64)


def store_stats(members: DataFrame) -> DataFrame:
    """Counts, total ratio and median ratio of the frames of a store; frames that can't be right are counted apart."""
    f = frame_ratios(members)
    return f.agg(
        F.count(F.when(_good(), 1)).alias("frames"),
        F.coalesce(F.sum(F.when(_good(), F.col("payload"))), F.lit(0)).cast("long").alias("payload"),
        F.coalesce(F.sum(F.when(_good(), F.col("stored"))), F.lit(0)).cast("long").alias("stored"),
        F.try_divide(F.sum(F.when(_good(), F.col("stored"))).cast("double"), F.sum(F.when(_good(), F.col("payload"))).cast("double")).alias("ratio"),
        F.percentile(F.when(_good(), F.col("ratio")), F.lit(0.5)).alias("median_ratio"),
        F.count(F.when(~_good(), 1)).alias("bogus_frames"),
        F.coalesce(F.sum(F.when(~_good(), F.col("payload"))), F.lit(0)).cast("long").alias("bogus_payload"),
    )


def ratio_histogram(members: DataFrame) -> DataFrame:
    """bucket, low, high, frames, payload; empty buckets are left out."""
    bucket = F.lit(None).cast("int")
    for i in reversed(range(len(RATIO_EDGES) - 1)):
        bucket = F.when((F.col("ratio") >= RATIO_EDGES[i]) & (F.col("ratio") < RATIO_EDGES[i + 1]), F.lit(i)).otherwise(bucket)
    h = frame_ratios(members).filter(_good()).withColumn("bucket", bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("frames"), F.sum("payload").cast("long").alias("payload"))
    edges = F.array(*[F.lit(e) for e in RATIO_EDGES])
    return h.select("bucket", F.get(edges, F.col("bucket")).alias("low"), F.get(edges, F.col("bucket") + 1).alias("high"), "frames", "payload")


def value_counts(df: DataFrame, value: Column, n: int) -> DataFrame:
    """The ``n`` most frequent values; ties by value."""
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def page(df: DataFrame, order: list[str], offset: int, limit: int, most: int = 500) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(min(limit, most))


def search(df: DataFrame, q: str | None = None, ext: str | None = None, coll: str | None = None) -> DataFrame:
    """By a literal part of the name, an extension, a directory."""
    if q:
        df = df.filter(basename(F.col("path")).contains(q))
    if ext is not None:
        df = df.filter(extension(F.col("path")) == ext)
    if coll is not None:
        df = df.filter(dirname(F.col("path")) == coll)
    return df


def hardlinks(inodes: DataFrame) -> DataFrame:
    """Rows (dev, ino, nlink, path, ...) with link_kind and link: the smallest path of an inode is the file.

    Only inodes with several links are aggregated and joined, so ordinary files don't move.
    """
    shared = inodes.filter("nlink > 1")
    first = shared.groupBy("dev", "ino").agg(F.min("path").alias("first"))
    linked = shared.join(first, ["dev", "ino"]).select(*inodes.columns, F.when(F.col("path") == F.col("first"), "file").otherwise("hardlink").alias("link_kind"), F.when(F.col("path") == F.col("first"), "").otherwise(F.col("first")).alias("link"))
    return inodes.filter("nlink <= 1 OR nlink IS NULL").select("*", F.lit("file").alias("link_kind"), F.lit("").alias("link")).unionByName(linked)


def directories(files: DataFrame) -> DataFrame:
    """dir, child_count, dir_total_size of every directory above a file: its direct children, and the bytes of direct files."""
    direct = files.select(dirname(F.col("path")).alias("dir"), "size").groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("bytes"))
    # every directory that stands above one with files, from the distinct ones only
    parts = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    every = direct.select(F.explode(above).alias("dir")).distinct()
    subdirs = every.filter("dir <> ''").groupBy(dirname(F.col("dir")).alias("dir")).agg(F.count(F.lit(1)).alias("subdirs"))
    return every.join(direct, "dir", "left").join(subdirs, "dir", "left").select("dir", depth_of("dir"), (F.coalesce("n", F.lit(0)) + F.coalesce("subdirs", F.lit(0))).alias("child_count"), F.coalesce("bytes", F.lit(0)).alias("dir_total_size"))


def depth_of(dir_column: str) -> Column:
    return F.when(F.col(dir_column) == "", 0).otherwise(depth(F.col(dir_column)) + 1).cast("int").alias("depth")


def sample(df: DataFrame, key: Column, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows, the same each time: those whose keys hash lowest."""
    return df.withColumn("__h", F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))).orderBy("__h", key).limit(n).drop("__h")


def split_by_hash(key: Column, parts: int, seed: int = 0) -> Column:
    """Which of ``parts`` an item goes to, in an order that has nothing to do with its key's."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long"), F.lit(parts)).cast("int")


def numbered(df: DataFrame, order: list[str], name: str = "id", start: int = 0, per_range: int = 100_000) -> DataFrame:
    """Gapless numbers in a total order, without sorting all rows in one task.

    Cut points come from a sample of the first column by hash (20 a range), and are constants of the plan, so
    every part of it sees the same ranges. A window numbers the rows of one range; the rows of the ranges
    before (one count each) are added. Rows that tie in ``order`` must be equal.
    """
    first, n = F.col(order[0]), df.count()
    ranges = min(1024, n // per_range + 1)
    keys = df.select(first.alias("k")).filter("k IS NOT NULL").orderBy(F.xxhash64("k"), "k").limit(20 * ranges).collect() if ranges > 1 else []
    keys = sorted(r.k for r in keys)
    cuts = sorted(set(keys[20::20]))
    at = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= first)), F.lit(0)) if cuts else F.lit(0)
    df = df.withColumn("__range", at)
    counts = df.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"))
    inside = Window.partitionBy("__range").orderBy(*order)
    return df.withColumn("__r", F.row_number().over(inside) - 1).join(F.broadcast(counts), "__range").withColumn(name, (F.col("__b") + F.col("__r") + start).cast("long")).drop("__range", "__b", "__r")
