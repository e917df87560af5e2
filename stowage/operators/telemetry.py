"""Counters, frame costs, and what limits a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counter_rates(samples: DataFrame, by: list[str], order: list[str], counters: list[str]) -> DataFrame:
    """Differences of cumulative counters to the sample before (``d_<name>``); the first sample has none."""
    w = Window.partitionBy(*by).orderBy(*order)
    return samples.select("*", *[(F.col(c) - F.lag(c).over(w)).alias(f"d_{c}") for c in counters])


def frame_costs(frames: DataFrame, members: DataFrame, root_depth: int = 2, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Frames (``by``, t0_ns, t1_ns, in_bytes, clen) with seconds, mb_s, ratio, and the root of their first path."""
    first = members.groupBy(*by).agg(F.min("path").alias("first"))
    s = (F.col("t1_ns") - F.col("t0_ns")) / 1e9
    return frames.join(first, list(by), "left").select(
        *by,
        s.alias("seconds"),
        F.round(F.col("in_bytes") / 1e6 / F.greatest(s, F.lit(1e-9)), 3).alias("mb_s"),
        F.round(F.col("clen") / F.greatest(F.col("in_bytes"), F.lit(1)), 4).alias("ratio"),
        F.substring_index("first", "/", root_depth).alias("root"),
    )


#: Shares from which on a part of the machinery counts as the limit.
BUSY, WAITING, QUEUE_EMPTY = 0.85, 0.5, 0.5


def bottleneck(perf: DataFrame) -> DataFrame:
    """One row of shares (compress, read, write, idle of all worker time) and the first rule that holds.

    ``perf``: worker_ns, compress_ns, read_ns, write_ns, idle_ns per sample.
    """
    g = perf.agg(*[F.sum(c).cast("double").alias(c) for c in ("worker_ns", "compress_ns", "read_ns", "write_ns", "idle_ns")])
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("worker_ns")), F.lit(0.0)), 6)
    g = g.select(share("compress_ns").alias("compress"), share("read_ns").alias("read"), share("write_ns").alias("write"), share("idle_ns").alias("idle"))
    limit = F.when(F.col("compress") >= BUSY, "cpu").when(F.col("write") >= WAITING, "sink").when(F.col("read") >= WAITING, "source").when(F.col("idle") >= QUEUE_EMPTY, "planner").otherwise("balanced")
    return g.withColumn("bottleneck", limit)


def delta_summary(segments: DataFrame) -> DataFrame:
    """Bytes carried over and literal, and how many members are carried whole, changed in part, or new."""
    m = segments.groupBy("path").agg(F.coalesce(F.sum(F.when(F.col("is_old"), F.col("len"))), F.lit(0)).alias("old"), F.sum("len").alias("all"))
    kind = F.when(F.col("old") == F.col("all"), "carried").when(F.col("old") > 0, "delta").otherwise("full")
    return m.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("members"), F.sum("old").cast("long").alias("carried_bytes"), F.sum(F.col("all") - F.col("old")).cast("long").alias("literal_bytes"))
