"""Shared plumbing of the training-data operators: tables, scratch storage, ranks."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters that separate words; every operator here uses the same six.
SPACES = " \t\n\x0b\x0c\r"

#: What a broadcast side may hold: its rows, counted as they were written, times the width of one.
BROADCAST_BYTES = 8 << 20

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables below ``sf_dir``, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, one is made for a master that runs on this machine alone, and becomes the
    session's checkpoint folder; a cluster must name its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stowage-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, wherever the shared file system is."""
    fs, p = _path(spark, path)
    fs.delete(p, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session is gone already
            pass


atexit.register(_sweep)


class Scratch:
    """Written tables of one run of one operator. They cut lineage and outlive lost executors.

    They stay until ``drop``, ``drop_but`` or ``close``, or the end of the process: results are lazy and read them.
    """

    def __init__(self, spark: SparkSession, op: str):
        self.spark = spark
        self.dir = f"{scratch_root(spark)}/stowage-{op}-{uuid.uuid4().hex[:12]}"
        self.paths: list[str] = []
        _made.append((spark, self.dir))

    def write(self, df: DataFrame, name: str = "t") -> str:
        path = f"{self.dir}/{len(self.paths):03d}-{name}"
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return path

    def keep(self, df: DataFrame, name: str = "t", **sums: Column) -> DataFrame:
        """``df``, written and read again. Its rows are counted on the way (``rows_of``), and ``sums`` added up (``sum_of``)."""
        seen = Observation()
        path = self.write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(f"sum_{k}") for k, c in sums.items()]), name)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path, out._seen = path, seen.get
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete what ``keep`` wrote, once nothing that is still to run reads it."""
        for df in frames:
            remove(self.spark, df._scratch_path)
            self.paths = [p if p != df._scratch_path else "" for p in self.paths]

    def drop_but(self, *frames: DataFrame) -> None:
        """Delete all that was written but what ``keep`` returned as ``frames``."""
        stay = {df._scratch_path for df in frames}
        for i, p in enumerate(self.paths):
            if p and p not in stay:
                remove(self.spark, p)
                self.paths[i] = ""

    def close(self) -> None:
        """Delete all that was written."""
        remove(self.spark, self.dir)


def rows_of(kept: DataFrame) -> int:
    """The rows of what ``Scratch.keep`` returned, without a job."""
    return kept._seen["rows"]


def sum_of(kept: DataFrame, name: str) -> int:
    return kept._seen[f"sum_{name}"] or 0


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def column(name: str) -> Column:
    """A column by its whole name, whatever marks it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def words(text: str | Column) -> Column:
    """The ``[^\\x20\\x09-\\x0D]+`` pieces of a text, in order; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5), " "), "")


def word_count(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that what uses one several times doesn't compute it again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def broadcast_if_small(df: DataFrame, n_rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint for at most BROADCAST_BYTES (rows counted, width bounded); beyond, Spark shuffles."""
    return F.broadcast(df) if n_rows * row_bytes <= BROADCAST_BYTES else df


def bucket_count(n_rows: int, per_bucket: int = 20_000, least: int = 64) -> int:
    """Hash buckets such that a bucket holds about ``per_bucket`` rows at any input size."""
    return max(least, -(-n_rows // per_bucket))


def hash_bucket(x: Column, buckets: int) -> Column:
    """The bucket of a number from 0 to 2**32 - 1; buckets ascend with it."""
    return F.shiftright(x.cast("long") * F.lit(buckets), 32).cast("int")


def ranked(df: DataFrame, group: list[str], order: list[Column], buckets: int, scratch: Scratch, out: str = "rank", weights: dict[str, Column] | None = None, spread: Column | None = None, totals_of: DataFrame | None = None) -> DataFrame:
    """Gapless ranks from 0 in each group, and under each name of ``weights`` the weight ahead of a row, in no single task per group.

    Rows are ordered by a bucket, then by ``order`` inside the bucket. A window sorts one bucket of one
    group at a time; the offsets of the buckets come from a table of bucket totals. The bucket is that of
    ``spread`` (0 to 2**32 - 1), or of a hash of ``order``; if ``spread`` ascends with ``order``, the ranks are
    those in ``order``. Rows that tie in ``order`` must be equal in all that matters. ``totals_of`` may
    name narrower rows with the same groups, weights and ``spread``, to count the totals from.
    """
    b, keys, sums = "__bucket", [*group, "__bucket"], {"__rank": F.lit(1).cast("long"), **(weights or {})}
    bucket = hash_bucket(F.xxhash64(*order).bitwiseAND((1 << 32) - 1) if spread is None else spread, buckets)
    totals = (df if totals_of is None else totals_of).withColumn(b, bucket).groupBy(*keys).agg(*[F.sum(w).alias(f"__t{i}") for i, w in enumerate(sums.values())])
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(keys)], *[F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).alias(f"__o{i}") for i in range(len(sums))])
    totals = scratch.keep(totals, "totals")
    totals = broadcast_if_small(totals, rows_of(totals), 64 + 64 * len(sums))
    inside = Window.partitionBy(*keys).orderBy(*order)
    here = inside.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(b, bucket).withColumns({"__r0": F.row_number().over(inside) - 1, **{f"__r{i}": F.coalesce(F.sum(w).over(here), F.lit(0)) for i, w in enumerate(sums.values()) if i}})
    same = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(keys)]
    joined = df.join(totals, on=same, how="left")
    joined = joined.withColumns({(out if not i else name): (F.col(f"__o{i}") + F.col(f"__r{i}")).cast("long") for i, name in enumerate(sums)})
    return joined.drop(b, *[f"__g{i}" for i in range(len(keys))], *[f"__{k}{i}" for k in "or" for i in range(len(sums))])
