"""Where bytes go: offsets, frames, pieces, batches, runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.functions.paths import header_length, padded

#: The shortest piece that stands alone, and the gap over which byte ranges are read as one.
SHORTEST_PIECE, RANGE_GAP = 128 << 10, 64 << 10


def before(value: str | Column, by: list[str], order: list[str]) -> Column:
    """Exclusive prefix sum in an order."""
    value = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long")


def grid_frames(df: DataFrame, by: list[str], order: list[str], cap: int, size: str = "size") -> DataFrame:
    """Add frame (dense from 0, by the grid cell in which a row starts) and in_off."""
    w = Window.partitionBy(*by).orderBy("__cell")
    df = df.withColumn("__cell", F.floor(before(size, by, order) / cap).cast("long"))
    df = df.withColumn("frame", (F.dense_rank().over(w) - 1).cast("long"))
    return df.withColumn("in_off", before(size, [*by, "frame"], order)).drop("__cell")


def greedy_frames(df: DataFrame, by: list[str], order: list[str], cap: int, size: str = "size") -> DataFrame:
    """Add frame and in_off: a frame closes when the next row would pass ``cap``; a larger row is a frame alone.

    The recurrence is sequential in each group of ``by``, so groups are the unit of parallelism: rows are
    dealt by group and sorted, and a stream over Arrow batches carries the running sum. No group is held.
    """
    names = list(df.columns)

    def cut(batches):
        group, frame, filled = None, -1, 0
        for batch in batches:
            sizes = batch.column(names.index(size)).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = list(zip(*[batch.column(names.index(c)).to_pylist() for c in by])) if by else [()] * len(sizes)
            frames, offs = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            i, n = 0, len(sizes)
            while i < n:
                if keys[i] != group:
                    group, frame, filled = keys[i], -1, 0
                j = i  # end of this group in the batch
                while j < n and keys[j] == group:
                    j += 1
                upto = np.cumsum(sizes[i:j])
                k = 0
                while k < j - i:
                    base = upto[k - 1] if k else 0
                    if frame < 0 or filled + sizes[i + k] > cap:
                        frame, filled = frame + 1, 0
                    m = max(k + 1, int(np.searchsorted(upto, base + cap - filled, side="right")))
                    frames[i + k : i + m] = frame
                    offs[i + k : i + m] = filled + np.concatenate([[0], upto[k : m - 1] - base]) if m > k + 1 else filled
                    filled += int(upto[m - 1] - base)
                    k = m
                i = j
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(frames), pa.array(offs)], names=[*names, "frame", "in_off"])

    dealt = df.repartition(*by) if by else df.coalesce(1)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return dealt.sortWithinPartitions(*by, *order).mapInArrow(cut, f"{schema}, frame long, in_off long")


def pieces(df: DataFrame, cap: int, shortest: int = SHORTEST_PIECE, size: str = "size") -> DataFrame:
    """One row per piece: no, src_off, len. A last piece under ``shortest`` is part of the one before."""
    whole = F.floor(F.col(size) / cap).cast("long")
    rest = F.col(size) - whole * cap
    n = F.when(F.col(size) == 0, 1).when(rest == 0, whole).when((rest < shortest) & (whole > 0), whole).otherwise(whole + 1)
    df = df.withColumn("__n", n.cast("int")).withColumn("no", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    off = (F.col("no") * F.lit(cap)).cast("long")
    return df.withColumn("src_off", off).withColumn("len", F.when(F.col("no") == F.col("__n") - 1, F.col(size) - off).otherwise(F.lit(cap)).cast("long")).drop("__n")


def tar_offsets(df: DataFrame) -> DataFrame:
    """Add hlen and body_off: within its frame, a member stands behind the headers and padded bodies before it."""
    df = df.withColumn("hlen", header_length(F.col("path"), F.col("link")))
    start = before(F.col("hlen") + padded(F.col("size")), ["frame"], ["path"])
    return df.withColumn("body_off", start + F.col("hlen"))


def batches(df: DataFrame, rows_per_batch: int) -> DataFrame:
    """Add batch to rows in (frame, path) order: cut each ``rows_per_batch`` rows, moved on to the next frame.

    Cuts are found on frames and their row counts, which are far fewer than rows.
    """
    frames = df.groupBy("frame").agg(F.count(F.lit(1)).alias("__rows"))
    frames = frames.withColumn("__at", before("__rows", [], ["frame"]))
    # a frame's batch counts the targets at or before its first row, each of which was moved on to a frame start
    frames = frames.select("frame", F.floor(F.col("__at") / rows_per_batch).cast("long").alias("__cell"))
    frames = frames.withColumn("batch", (F.dense_rank().over(Window.orderBy("__cell")) - 1).cast("long")).drop("__cell")
    return df.join(frames, "frame")


def runs(df: DataFrame, by: list[str], order: list[str], same: list[str], name: str = "run") -> DataFrame:
    """Add the number of the run of equal ``same`` that a row is in, from 0 in each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    now = F.struct(*same)
    first = F.lag(F.lit(1)).over(w).isNull() | ~F.lag(now).over(w).eqNullSafe(now)
    return df.withColumn("__new", first.cast("int")).withColumn(name, (F.sum("__new").over(w) - 1).cast("long")).drop("__new")


def coalesced(ranges: DataFrame, by: list[str], gap: int = RANGE_GAP) -> DataFrame:
    """Byte ranges (off, len) read together: island, off, len, n where the next starts within ``gap`` of all before."""
    w = Window.partitionBy(*by).orderBy("off", "len")
    reach = F.max(F.col("off") + F.col("len")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = ranges.withColumn("__new", (reach.isNull() | (F.col("off") > reach + gap)).cast("int"))
    r = r.withColumn("island", (F.sum("__new").over(w) - 1).cast("long"))
    g = r.groupBy(*by, "island").agg(F.min("off").alias("off"), F.max(F.col("off") + F.col("len")).alias("__end"), F.count(F.lit(1)).alias("n"))
    return g.select(*by, "island", "off", (F.col("__end") - F.col("off")).cast("long").alias("len"), "n")
