"""Tar archives and Arrow files as tables.

``tar``: one partition per archive, ``.tar`` or ``.tar.zst``, read as a stream; long names and PAX records as
Python's tarfile knows them. Option ``content`` false leaves bodies out. ``feather``: one partition per record
batch of an Arrow IPC file; only asked columns are read, through option ``columns``.
"""

from __future__ import annotations

import glob
import os
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TAR = pa.schema([("archive", pa.string()), ("no", pa.int64()), ("path", pa.string()), ("kind", pa.string()), ("link", pa.string()), ("size", pa.int64()), ("mode", pa.int32()), ("mtime_ns", pa.int64()), ("uid", pa.int32()), ("gid", pa.int32()), ("content", pa.binary())])
KINDS = {tarfile.DIRTYPE: "dir", tarfile.SYMTYPE: "symlink", tarfile.LNKTYPE: "hardlink"}
BATCH_BYTES = 8 << 20


def paths(pattern: str) -> list[str]:
    return sorted(p for x in pattern.removeprefix("file://").split(",") for p in (glob.glob(x) or [x]))


def open_stream(path: str):
    f = open(path, "rb")
    magic = f.read(6)
    f.seek(0)
    if magic[:4] == b"\x28\xb5\x2f\xfd" or magic[:1] in b"\x50\x51\x52\x53\x54\x55\x56\x57\x58\x59\x5a\x5b\x5c\x5d\x5e\x5f" and magic[1:4] == b"\x2a\x4d\x18":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True)
    if magic[:2] == b"\x1f\x8b" or magic[:6] == b"\xfd7zXZ\x00" or magic[:3] == b"BZh":
        raise ValueError(f"{path}: only plain and Zstandard archives can be read")
    return f


def tar_rows(path: str, content: bool):
    with open_stream(path) as f, tarfile.open(fileobj=f, mode="r|", errorlevel=1) as t:
        for no, m in enumerate(t):
            kind = KINDS.get(m.type, "file" if m.isreg() or m.type == tarfile.CONTTYPE else None)
            if kind is None:
                continue
            body = t.extractfile(m).read() if content and kind == "file" else None
            yield {"archive": path, "no": no, "path": m.name.removeprefix("./"), "kind": kind, "link": m.linkname, "size": m.size if kind == "file" else 0, "mode": m.mode & 0o7777, "mtime_ns": int(round(float(m.pax_headers.get("mtime", m.mtime)) * 1e9)) if "mtime" in m.pax_headers else int(m.mtime) * 10**9, "uid": m.uid, "gid": m.gid, "content": body}


class Part(InputPartition):
    def __init__(self, path: str, batch: int = 0):
        self.path, self.batch = path, batch


class TarReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.content = paths(options["path"]), options.get("content", "true").lower() == "true"

    def partitions(self):
        return [Part(p) for p in self.paths]

    def read(self, part: Part):
        rows, held = [], 0
        for row in tar_rows(part.path, self.content):
            rows.append(row)
            held += len(row["content"] or b"") + 200
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, TAR)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, TAR)


class Tar(DataSource):
    @classmethod
    def name(cls):
        return "tar"

    def schema(self):
        return "archive string, no long, path string, kind string, link string, size long, mode int, mtime_ns long, uid int, gid int, content binary"

    def reader(self, schema):
        return TarReader(self.options)


class FeatherReader(DataSourceReader):
    def __init__(self, options, columns):
        self.paths, self.columns = paths(options["path"]), columns

    def partitions(self):
        out = []
        for p in self.paths:
            with pa.memory_map(p) as f:
                out += [Part(p, i) for i in range(pa.ipc.open_file(f).num_record_batches)]
        return out

    def read(self, part: Part):
        with pa.memory_map(part.path) as f:
            r = pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=[pa.ipc.open_file(f).schema.get_field_index(c) for c in self.columns]))
            yield r.get_batch(part.batch).select(self.columns)


class Feather(DataSource):
    @classmethod
    def name(cls):
        return "feather"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        with pa.memory_map(paths(self.options["path"])[0]) as f:
            s = pa.ipc.open_file(f).schema
        asked = [c for c in self.options.get("columns", "").split(",") if c]
        return from_arrow_schema(pa.schema([s.field(c) for c in asked]) if asked else s)

    def reader(self, schema):
        return FeatherReader(self.options, schema.names)


def read_tar(spark: SparkSession, pattern: str, content: bool = True) -> DataFrame:
    spark.dataSource.register(Tar)
    return spark.read.format("tar").option("content", str(content)).load(pattern)


def read_feather(spark: SparkSession, pattern: str, columns: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(Feather)
    return spark.read.format("feather").option("columns", ",".join(columns or [])).load(pattern)


def write_feather(df: DataFrame, path: str, compression: str | None = "zstd") -> int:
    """One Arrow IPC file from a result of bounded size, batch by batch; returns its rows."""
    table = df.toArrow()
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, table.schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as w:
        w.write_table(table, max_chunksize=64 * 1024)
    return table.num_rows
