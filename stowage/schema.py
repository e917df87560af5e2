"""Schemas of member tables, their sentinels, and reading tables of other eras."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, S = T.LongType(), T.StringType()

EXTENT = T.StructType([T.StructField(n, L) for n in ("coff", "clen", "in_off", "len", "out_off", "shard")])
CHUNK = T.StructType([T.StructField("len", L), T.StructField("id", T.BinaryType())])

#: One row per file, directory or link; ``frame`` is the frame's number, or a kind below 0.
STAT = T.StructType(
    [T.StructField("path", S), *[T.StructField(n, L) for n in ("size", "mode", "mtime_ns", "uid", "gid", "frame", "in_off", "coff", "clen", "digest")], T.StructField("link", S), T.StructField("chunks", T.ArrayType(CHUNK)), T.StructField("extents", T.ArrayType(EXTENT)), T.StructField("shard", L)]
)

DIR, SYMLINK, HARDLINK, EXTENTS = -1, -2, -3, -4
KINDS = {DIR: "dir", SYMLINK: "symlink", HARDLINK: "hardlink", EXTENTS: "extents"}

#: What a column that an older table lacks stands for.
BACKFILL = {"digest": -1, "link": "", "in_off": -1, "coff": -1, "clen": -1, "shard": 0, "uid": 0, "gid": 0, "mode": 0o644, "chunks": None, "extents": None}


def kind(frame="frame"):
    """'file', or what a negative frame number stands for."""
    out = F.lit("file")
    for code, name in KINDS.items():
        out = F.when(F.col(frame) == code, name).otherwise(out)
    return out


def conform(df: DataFrame, schema: T.StructType = STAT) -> DataFrame:
    """The columns of ``schema`` in order; missing ones are filled in, unknown missing ones refused."""
    out = []
    for f in schema.fields:
        if f.name in df.columns:
            value = F.col(f.name).cast(f.dataType)
            fill = BACKFILL.get(f.name)
            out.append((F.coalesce(value, F.lit(fill).cast(f.dataType)) if fill is not None else value).alias(f.name))
        elif f.name in BACKFILL:
            out.append(F.lit(BACKFILL[f.name]).cast(f.dataType).alias(f.name))
        else:
            raise ValueError(f"column {f.name} is missing and has no default")
    return df.select(*out)


def union_eras(*tables: DataFrame, schema: T.StructType = STAT) -> DataFrame:
    """All rows of tables that were written with fewer or more columns."""
    out = conform(tables[0], schema)
    for t in tables[1:]:
        out = out.unionByName(conform(t, schema))
    return out
