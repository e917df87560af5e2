"""Snapshots: their chain, which of them to keep, and what they keep alive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERIODS = {"daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}


def _bucket(period: str):
    t = F.timestamp_micros(F.expr("time_ns div 1000"))
    if period == "weekly":
        year = F.extract(F.lit("YEAROFWEEK"), t)
        return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))
    return F.date_format(t, {"daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "yearly": "yyyy"}[period])


def retain(snapshots: DataFrame, last: int = 0, daily: int = 0, weekly: int = 0, monthly: int = 0, yearly: int = 0) -> DataFrame:
    """Snapshots (at, time_ns) with kept: the newest, the ``last`` newest, and the newest of the newest n days, weeks, months, years (UTC).

    Only the names that stay are gathered, at most as many as the policy keeps; snapshots without a time stay by ``last`` alone.
    """
    stay = snapshots.select("at").orderBy(F.desc("at")).limit(max(1, last))
    for period, n in (("daily", daily), ("weekly", weekly), ("monthly", monthly), ("yearly", yearly)):
        if n > 0:
            newest = snapshots.filter("time_ns IS NOT NULL").groupBy(_bucket(period).alias("period")).agg(F.max("at").alias("at"))
            stay = stay.unionByName(newest.orderBy(F.desc("period")).limit(n).select("at"))
    stay = F.broadcast(stay.distinct().select(F.col("at").alias("stays")))  # the policy's numbers bound it
    return snapshots.join(stay, F.col("at") == F.col("stays"), "left").select(*snapshots.columns, F.col("stays").isNotNull().alias("kept"))


def chains(snapshots: DataFrame, by: list[str]) -> DataFrame:
    """Snapshots (at, prev) with the newest of their chain, how many are newer (depth), and whether each one but the oldest names the one before (linked)."""
    back = Window.partitionBy(*by).orderBy(F.desc("at"))
    whole = Window.partitionBy(*by)
    out = snapshots.select("*", F.max("at").over(whole).alias("newest"), (F.row_number().over(back) - 1).alias("depth"), F.lead("at").over(back).alias("before"))
    return out.withColumn("linked", F.col("prev").eqNullSafe(F.col("before"))).drop("before")


def live_frames(members: DataFrame) -> DataFrame:
    """shard, coff, clen of all frames that members or their extents need."""
    direct = members.filter("frame >= 0").select("shard", "coff", "clen")
    parts = members.filter("frame = -4").select(F.inline("extents")).select("shard", "coff", "clen")
    return direct.unionByName(parts).distinct()


def moved(live: DataFrame) -> DataFrame:
    """Live frames with new_coff: packed one behind the other in each shard, in their old order."""
    w = Window.partitionBy("shard").orderBy("coff", "clen").rowsBetween(Window.unboundedPreceding, -1)
    return live.withColumn("new_coff", F.coalesce(F.sum("clen").over(w), F.lit(0)).cast("long"))


def reusable_batches(batches: DataFrame, latest: DataFrame) -> DataFrame:
    """batch, rows, reused: whether all rows of an index batch stand in the latest state as they are."""
    key = ["path", "frame", "coff", "clen", "in_off"]
    held = batches.join(latest.select(*key, F.lit(1).alias("__there")), key, "left")
    g = held.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.count("__there").alias("there"))
    return g.select("batch", "rows", (F.col("rows") == F.col("there")).alias("reused"))
