"""Streams: tree diffs that let go of finished parts, resumable runs, telemetry windows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Rows of a diff stream: side ('a' or 'b'), part, path, size, mtime_ns; a row without a path ends its side of the part.
DIFF_INPUT = "side string, part string, path string, size long, mtime_ns long"


class PartDiff(StatefulProcessor):
    """Keeps both sides of a part until both have ended, then emits their differences and forgets them."""

    def init(self, handle):
        self.handle = handle
        self.rows = handle.getMapState("rows", "side string, path string", "size long, second long")
        self.ends = handle.getMapState("ends", "side string", "n int")

    def handleInputRows(self, key, rows, timers):
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if r.path is None or r.path != r.path:
                    self.ends.updateValue((r.side,), (1,))
                else:
                    self.rows.updateValue((r.side, r.path), (int(r.size), int(r.mtime_ns) // 1_000_000_000))
        if all(self.ends.containsKey((s,)) for s in "ab"):
            sides = {"a": {}, "b": {}}
            for (side, path), value in self.rows.iterator():
                sides[side][path] = tuple(value)
            a, b = sides["a"], sides["b"]
            out = [(key[0], p, "removed" if p not in b else "added" if p not in a else "unchanged" if a[p] == b[p] else "changed") for p in sorted(a.keys() | b.keys())]
            self.rows.clear()
            self.ends.clear()
            yield pd.DataFrame(out, columns=["part", "path", "status"])

    def close(self):
        pass


def diff_stream(rows: DataFrame) -> DataFrame:
    """part, path, status of a stream of ``DIFF_INPUT`` rows; needs the RocksDB state store."""
    return rows.groupBy("part").transformWithStateInPandas(PartDiff(), "part string, path string, status string", "append", "none")


def resumable(rows: DataFrame, out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], key: list[str], trigger: dict | None = None):
    """Run ``step`` over a stream batch by batch, each written once under its number.

    A batch that is sent again after a crash replaces its own folder, and rows whose key an earlier batch
    has written are left out, so the output holds each key once however often the run is resumed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(out)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        before = [str(f.getPath()) for f in fs.listStatus(root) if f.getPath().getName().startswith("batch=") and int(f.getPath().getName()[6:]) < number and fs.exists(hadoop.Path(f.getPath(), "_SUCCESS"))] if fs.exists(root) else []
        new = step(batch).dropDuplicates(key)
        if before:
            new = new.join(spark.read.parquet(*before).select(*key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def rates(events: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "2 hours", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums in tumbling windows; rows later than ``late`` are dropped and windows let go."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    g = e.groupBy(F.window(ts, window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").alias("start"), *by, "n", "value")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "2 hours", by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    g = e.groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")


def once_each(events: DataFrame, key: list[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Each key once among rows that are at most ``late`` apart."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
