"""Fixed-width binary records: frame telemetry as it is appended, and cumulative counters.

Files may still grow: a record that is not whole yet is left out. Files are read in whole numbers of records by
Spark's binary file source, so any file system will do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The fields of a frame's record, in order, and their widths (unsigned and signed 64 bits, signed 32 bits).
FRAME_RECORD = (("frame", "u8"), ("coff", "u8"), ("clen", "u8"), ("t0_ns", "i8"), ("t1_ns", "i8"), ("in_bytes", "i8"), ("jq_depth", "i4"), ("busy", "i4"), ("worker", "i4"), ("sink", "i4"))


def read_records(spark: SparkSession, pattern: str, fields: tuple[tuple[str, str], ...] = FRAME_RECORD) -> DataFrame:
    """file, no, and the fields (all long) of every whole record."""
    kind = np.dtype([(n, "<" + t) for n, t in fields])

    def parse(batches):
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = np.frombuffer(raw, kind, len(raw) // kind.itemsize)
                cols = [pa.array(rows[n].astype(np.int64)) for n, _ in fields]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(np.arange(len(rows))), *cols], names=["file", "no", *[n for n, _ in fields]])

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInArrow(parse, "file string, no long, " + ", ".join(f"{n} long" for n, _ in fields))


def write_records(rows: list[dict], path: str, fields: tuple[tuple[str, str], ...] = FRAME_RECORD) -> None:
    """Append records to a local file."""
    kind = np.dtype([(n, "<" + t) for n, t in fields])
    with open(path, "ab") as f:
        f.write(np.array([tuple(r[n] for n, _ in fields) for r in rows], kind).tobytes())
