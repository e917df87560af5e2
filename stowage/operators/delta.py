"""Differences between trees, incremental runs, and chunk lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECOND = 1_000_000_000


def diff_trees(a: DataFrame, b: DataFrame) -> DataFrame:
    """path, status of two trees (path, size, mtime_ns): added, removed, changed, unchanged; times in whole seconds."""
    x = a.select("path", F.col("size").alias("a_size"), F.expr(f"mtime_ns div {SECOND}").alias("a_s"), F.lit(1).alias("in_a"))
    y = b.select("path", F.col("size").alias("b_size"), F.expr(f"mtime_ns div {SECOND}").alias("b_s"), F.lit(1).alias("in_b"))
    same = F.col("a_size").eqNullSafe(F.col("b_size")) & F.col("a_s").eqNullSafe(F.col("b_s"))
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return x.join(y, "path", "full_outer").select("path", status.alias("status"))


def incremental(scan: DataFrame, prior: DataFrame) -> DataFrame:
    """The rows of a scan with ``unchanged``: known before, alive (frame not below 0, or extents) and of the same size and exact time."""
    old = prior.select("path", F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_mtime"), F.col("frame").alias("old_frame"))
    live = (F.col("old_frame") >= 0) | (F.col("old_frame") == -4)
    same = live & (F.col("size") == F.col("old_size")) & (F.col("mtime_ns") == F.col("old_mtime"))
    return scan.join(old, "path", "left").select(*scan.columns, F.coalesce(same, F.lit(False)).alias("unchanged"))


def deleted(scan: DataFrame, prior: DataFrame) -> DataFrame:
    return prior.join(scan.select("path"), "path", "left_anti")


def sync_plan(source: DataFrame, target: DataFrame, key: list[Column]) -> DataFrame:
    """path, action ('send', 'delete', 'keep') where both sides have ``key``'s values to agree in."""
    x = source.select("path", F.struct(*key).alias("a"))
    y = target.select("path", F.struct(*key).alias("b"))
    action = F.when(F.col("a").isNull(), "delete").when(F.col("b").isNull() | ~F.col("a").eqNullSafe(F.col("b")), "send").otherwise("keep")
    return x.join(y, "path", "full_outer").select("path", action.alias("action"))


def missing_and_extra(live: DataFrame, stored: DataFrame) -> DataFrame:
    """path, problem: what a store lacks of a tree, and holds besides."""
    lost = live.select("path").join(stored.select("path"), "path", "left_anti").select("path", F.lit("missing").alias("problem"))
    more = stored.select("path").join(live.select("path"), "path", "left_anti").select("path", F.lit("extra").alias("problem"))
    return lost.unionByName(more)


def locate(chunks: DataFrame, extents: DataFrame) -> DataFrame:
    """For chunks (path, off, len) the extent (path, out_off, elen, coff) that holds their first byte, and whether all of them.

    Both sides meet by path and time-line: one sort by offset in each path, and the last extent seen so
    far. No pair of chunk and extent is formed but the right one.
    """
    e = extents.select("path", F.col("out_off").alias("at"), F.lit(0).alias("kind"), F.struct("out_off", "elen", "coff").alias("ext"), F.lit(None).cast("long").alias("len"))
    c = chunks.select("path", F.col("off").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(e.schema["ext"].dataType).alias("ext"), F.col("len").cast("long").alias("len"))
    w = Window.partitionBy("path").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(c).withColumn("ext", F.last("ext", ignorenulls=True).over(w)).filter("kind = 1 AND ext IS NOT NULL")
    inside = F.col("at") + F.col("len") <= F.col("ext.out_off") + F.col("ext.elen")
    return both.select("path", F.col("at").alias("off"), "len", "ext.out_off", (F.col("ext.coff") + F.col("at") - F.col("ext.out_off")).alias("coff"), inside.alias("contained"))


def match_chunks(new: DataFrame, old: DataFrame) -> DataFrame:
    """New chunks (path, no, off, len, id) with old_off: where the same path's old version first held the id, if the length agrees."""
    first = old.groupBy("path", "id").agg(F.min_by(F.struct("off", "len"), "no").alias("o"))
    joined = new.join(first, ["path", "id"], "left")
    return joined.select("path", "no", "off", "len", "id", F.when(F.col("o.len") == F.col("len"), F.col("o.off")).alias("old_off"))


def segments(matched: DataFrame) -> DataFrame:
    """Runs of chunks that are all old and contiguous there, or all new: path, seg, is_old, off, len, old_off, n."""
    w = Window.partitionBy("path").orderBy("no")
    is_old = F.col("old_off").isNotNull()
    m = matched.withColumn("is_old", is_old).withColumn("shift", F.coalesce(F.col("old_off") - F.col("off"), F.lit(0)))
    new_run = F.lag("is_old").over(w).isNull() | (F.lag("is_old").over(w) != F.col("is_old")) | (F.lag("shift").over(w) != F.col("shift"))
    m = m.withColumn("seg", F.sum(new_run.cast("int")).over(w).cast("long"))
    return m.groupBy("path", "seg", "is_old").agg(F.min("off").alias("off"), F.sum("len").cast("long").alias("len"), F.min("old_off").alias("old_off"), F.count(F.lit(1)).alias("n"))
