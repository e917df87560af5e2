"""Archives of Zstandard frames with an index behind them, as a table, and written from one.

The file is a sequence of Zstandard frames, each of whole members (with tar headers, if the archive is to be
readable as ``.tar.zst``), then the index in skippable frames: Arrow IPC files of member rows, each compressed,
then a directory of these, then the directory's length and a magic word at the very end. Later snapshots append
data and another index that names the end of the one before; a set of files ``out``, ``out.1``, ... holds shards.

``read`` gives one partition per index batch and inflates nothing else. ``contents`` inflates each needed frame
once. ``write`` compresses frames in parallel, then streams each shard's frames, and the index, in one task each.
"""

from __future__ import annotations

import glob
import hashlib
import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stowage.functions.content import commit_hash, fold, frame_bytes, header_bytes
from stowage.functions.paths import header_length, padded
from stowage.operators import layout, members
from stowage.schema import EXTENTS

#: Fixed values of the format: words that mark the end and skippable frames, and the bit of extents with shards.
END_WORD, SKIPPABLE, WITH_SHARD = b"NOCKZC01", 0x184D2A50, 0x80000000
#: Kinds of chunk ids in manifests; 2 is the only one of existing files.
MANIFEST_KIND = 2
STORED_NAMES = {"frame_coff": "coff", "frame_clen": "clen"}
DEFAULTS = {"digest": -1, "link": "", "shard": 0, "in_off": -1, "coff": -1, "clen": -1, "uid": 0, "gid": 0, "mode": 0o644, "chunks": None, "extents": None}
FIELDS = "store string, path string, size long, mode long, mtime_ns long, uid long, gid long, frame long, in_off long, coff long, clen long, digest long, link string, chunks array<struct<len:long,id:binary>>, extents array<struct<coff:long,clen:long,in_off:long,len:long,out_off:long,shard:long>>, shard long"
EXTENT_NAMES = ("coff", "clen", "in_off", "len", "out_off", "shard")
BODY = pa.schema([("store", pa.string()), ("path", pa.string()), *[(n, pa.int64()) for n in ("size", "mode", "mtime_ns", "uid", "gid", "frame", "in_off", "coff", "clen", "digest")], ("link", pa.string()), ("chunks", pa.list_(pa.struct([("len", pa.int64()), ("id", pa.binary())]))), ("extents", pa.list_(pa.struct([(n, pa.int64()) for n in EXTENT_NAMES]))), ("shard", pa.int64())])


def pack_extents(extents: list[dict]) -> bytes:
    return struct.pack("<I", WITH_SHARD | len(extents)) + b"".join(struct.pack("<6Q", *(e[n] for n in EXTENT_NAMES)) for e in extents)


def parse_extents(raw: bytes | None) -> list[dict] | None:
    """Both record widths: without a shard it is 0."""
    if not raw:
        return None
    (n,) = struct.unpack_from("<I", raw)
    names = EXTENT_NAMES if n & WITH_SHARD else EXTENT_NAMES[:5]
    record = struct.Struct(f"<{len(names)}Q")
    return [{"shard": 0} | dict(zip(names, x)) for x in record.iter_unpack(raw[4 : 4 + (n & ~WITH_SHARD) * record.size])]


def pack_chunks(chunks: list[dict]) -> bytes:
    return struct.pack("<B3xI", MANIFEST_KIND, len(chunks)) + b"".join(struct.pack("<I16s", c["len"], c["id"]) for c in chunks)


def parse_chunks(raw: bytes | None) -> list[dict] | None:
    if not raw:
        return None
    kind, n = struct.unpack_from("<B3xI", raw)
    if kind != MANIFEST_KIND:
        raise ValueError(f"chunk ids of kind {kind} are not known")
    return [{"len": size, "id": cid} for size, cid in struct.iter_unpack("<I16s", raw[8 : 8 + 20 * n])]


def shard_file(out: str, shard: int) -> str:
    return f"{out}.{shard}" if shard else out


def index_file(store: str) -> str:
    """Where the index is: in a file of its own if there is one, else behind the data."""
    return f"{store}.footer" if os.path.exists(f"{store}.footer") else store


def directory(store: str, at: int | None = None) -> dict:
    """batches (offset, length, first row, rows), prev, time_ns, root, commit, leaves of the index that ends at ``at``."""
    with open(index_file(store), "rb") as f:
        end = at or os.fstat(f.fileno()).st_size
        f.seek(max(0, end - 16))
        tail = f.read(16)
        if len(tail) < 16 or tail[8:] != END_WORD:
            raise ValueError(f"{store}: no index at its end")
        size = struct.unpack("<Q", tail[:8])[0]
        f.seek(end - 16 - size)
        raw = f.read(size)
    (n,) = struct.unpack_from("<I", raw)
    out = {"at": end, "batches": list(struct.iter_unpack("<4Q", raw[4 : 4 + 32 * n])), "prev": None, "time_ns": None, "root": None, "commit": None, "leaves": None}
    more = raw[4 + 32 * n :]
    if len(more) >= 16:
        out["prev"], out["time_ns"] = (x or None for x in struct.unpack_from("<Qq", more))
    if len(more) >= 80 + 32 * n:
        out["root"], out["commit"] = more[16:48], more[48:80]
        out["leaves"] = [more[80 + 32 * i : 112 + 32 * i] for i in range(n)]
    return out


def snapshots(spark: SparkSession, store: str) -> DataFrame:
    """at, time_ns, prev_at, root, commit, newest first: the chain is walked from the end."""
    rows, at = [], None
    while True:
        d = directory(store, at)
        rows.append((d["at"], d["time_ns"], d["prev"], d["root"] and d["root"].hex(), d["commit"] and d["commit"].hex()))
        at = d["prev"]
        if not at:
            return spark.createDataFrame(rows, "at long, time_ns long, prev_at long, root string, commit string")


def authentic(store: str, at: int | None = None) -> dict:
    """Whether batches, root and commit of an index are what they say: bad batches, root_ok, commit_ok."""
    import zstandard  # noqa: F401  a store without it can't be read anyway

    d = directory(store, at)
    with open(index_file(store), "rb") as f:
        found = []
        for off, size, _, _ in d["batches"]:
            f.seek(off)
            found.append(hashlib.blake2b(f.read(size), digest_size=32).digest())
    if d["leaves"] is None:
        return {"bad": [], "root_ok": None, "commit_ok": None}
    before = directory(store, d["prev"])["commit"] if d["prev"] else None
    commit = commit_hash(d["root"], before or b"\0" * 32, d["time_ns"] or 0)
    return {"bad": [i for i, (a, b) in enumerate(zip(found, d["leaves"])) if a != b], "root_ok": fold(found) == d["root"], "commit_ok": commit == d["commit"]}


class Batch(InputPartition):
    def __init__(self, store: str, offset: int, length: int):
        self.store, self.offset, self.length = store, offset, length


class IndexReader(DataSourceReader):
    def __init__(self, options):
        pattern = options["path"].removeprefix("file://")
        self.stores = sorted(glob.glob(pattern)) or [pattern]
        self.at = int(options["at"]) if options.get("at") else None

    def partitions(self):
        return [Batch(s, b[0], b[1]) for s in self.stores for b in directory(s, self.at)["batches"]]

    def read(self, part: Batch):
        import zstandard

        with open(index_file(part.store), "rb") as f:
            f.seek(part.offset)
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(f.read(part.length))
        table = pa.ipc.open_file(raw).read_all()
        table = table.rename_columns([STORED_NAMES.get(c, c) for c in table.column_names])
        columns = []
        for field in BODY:
            if field.name == "store":
                columns.append(pa.array([part.store] * len(table), pa.string()))
            elif field.name in ("chunks", "extents"):
                parse = parse_chunks if field.name == "chunks" else parse_extents
                raw_column = table.column(field.name).to_pylist() if field.name in table.column_names else [None] * len(table)
                columns.append(pa.array([parse(x) for x in raw_column], field.type))
            elif field.name in table.column_names:
                column = table.column(field.name).combine_chunks().cast(field.type)
                columns.append(column.fill_null(DEFAULTS[field.name]) if DEFAULTS.get(field.name) is not None else column)
            elif field.name in DEFAULTS:
                columns.append(pa.array([DEFAULTS[field.name]] * len(table), field.type))
            else:
                raise ValueError(f"{part.store}: its index lacks {field.name}, for which there is no default")
        yield pa.RecordBatch.from_arrays(columns, schema=BODY)


class FrameArchive(DataSource):
    @classmethod
    def name(cls):
        return "frame_archive"

    def schema(self):
        return FIELDS

    def reader(self, schema):
        return IndexReader(self.options)


def read(spark: SparkSession, pattern: str, at: int | None = None) -> DataFrame:
    """The members of a store, or of all that a glob names; of an older snapshot, if ``at`` is its end."""
    spark.dataSource.register(FrameArchive)
    r = spark.read.format("frame_archive")
    return (r.option("at", at) if at else r).load(pattern)


def contents(index: DataFrame) -> DataFrame:
    """store, path, content of rows of ``read``: each frame they need is read and inflated once."""
    one = index.filter("frame >= 0").select("store", "path", "shard", "coff", "clen", "in_off", F.col("size").alias("len"), F.lit(0).cast("long").alias("out_off"))
    many = index.filter(f"frame = {EXTENTS}").select("store", "path", F.inline("extents")).select(*one.columns)

    def cut(key: tuple[pa.Scalar, ...], places: pa.Table) -> pa.Table:
        import zstandard

        store, shard, coff, clen = (k.as_py() for k in key)
        with open(shard_file(store, shard), "rb") as f:
            f.seek(coff)
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(f.read(clen))
        bodies = [raw[o : o + n] for o, n in zip(places.column("in_off").to_pylist(), places.column("len").to_pylist())]
        return pa.table({"store": places.column("store"), "path": places.column("path"), "out_off": places.column("out_off"), "body": pa.array(bodies, pa.binary())})

    parts = one.unionByName(many).groupBy("store", "shard", "coff", "clen").applyInArrow(cut, "store string, path string, out_off long, body binary")
    g = parts.groupBy("store", "path").agg(F.sort_array(F.collect_list(F.struct("out_off", "body"))).alias("s"))
    return g.select("store", "path", F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["body"])).alias("content"))


def _index_bytes(columns: dict, level: int) -> bytes:
    import zstandard

    sink = pa.BufferOutputStream()
    table = pa.table(columns)
    with pa.ipc.new_file(sink, table.schema) as w:
        w.write_table(table)
    return zstandard.ZstdCompressor(level=level).compress(sink.getvalue().to_pybytes())


def write(rows: DataFrame, out: str, frame_bytes_cap: int = 1 << 20, shards: int = 1, level: int = 6, tar: bool = True, rows_per_batch: int = 10_000, time_ns: int = 0) -> DataFrame:
    """A new store of files (path, content, mode, mtime_ns, uid, gid); returns its index.

    With ``tar``, shard 0 is a valid ``.tar.zst`` if there is one shard: members carry tar headers, and a frame of
    two empty blocks ends the data.
    """
    spark, out = rows.sparkSession, out.removeprefix("file://")
    head = header_length(F.col("path"), F.lit("")) if tar else F.lit(0).cast("long")
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    rows = rows.select("path", "content", *[F.col(c).cast("long").alias(c) for c in ("mode", "mtime_ns", "uid", "gid")], size.alias("size"), head.alias("hlen"), members.split_by_hash(F.col("path"), shards).cast("long").alias("shard"))
    rows = rows.withColumn("room", F.col("hlen") + (padded(F.col("size")) if tar else F.col("size")))
    plan = layout.greedy_frames(rows.select("path", "shard", "room"), ["shard"], ["path"], frame_bytes_cap, "room").select("path", "frame", F.col("in_off").alias("start"))
    placed = rows.join(plan, "path")

    def pack(table: pa.Table) -> pa.Table:
        parts = []
        for i in np.argsort(table.column("start").to_numpy(), kind="stable").tolist():
            r = {c: table.column(c)[i].as_py() for c in table.column_names}
            body = r["content"] or b""
            parts += [header_bytes(r["path"], r["size"], r["mtime_ns"] // 10**9, r["mode"]), body, b"\0" * (-len(body) % 512)] if tar else [body]
        return pa.table({"shard": table.column("shard").slice(0, 1), "frame": table.column("frame").slice(0, 1), "payload": pa.array([frame_bytes(b"".join(parts), level)], pa.binary())})

    packed = placed.groupBy("shard", "frame").applyInArrow(pack, "shard long, frame long, payload binary")

    def store_frames(batches):
        cursor, opened, done = {}, {}, []
        for batch in batches:
            for shard, frame, payload in zip(*(batch.column(i) for i in range(3))):
                k, raw = shard.as_py(), payload.as_py()
                if k not in opened:
                    opened[k], cursor[k] = open(f"{shard_file(out, k)}.part", "wb"), 0
                opened[k].write(raw)
                done.append({"shard": k, "frame": frame.as_py(), "coff": cursor[k], "clen": len(raw)})
                cursor[k] += len(raw)
        for k, f in opened.items():
            if tar:
                f.write(frame_bytes(b"\0" * 1024, level))
            f.close()
            os.replace(f.name, shard_file(out, k))
        yield pa.RecordBatch.from_pylist(done, pa.schema([(n, pa.int64()) for n in ("shard", "frame", "coff", "clen")]))

    os.makedirs(os.path.dirname(out) or ".", exist_ok=True)
    for old in glob.glob(f"{out}*"):
        if old == out or old[len(out) + 1 :].isdigit() or old == f"{out}.footer":
            os.remove(old)
    stored = packed.repartition(shards, "shard").sortWithinPartitions("shard", "frame").mapInArrow(store_frames, "shard long, frame long, coff long, clen long")
    places = spark.createDataFrame(stored.toArrow())  # one narrow row per frame
    # frames are numbered through all shards, in the order of the index
    places = places.withColumn("no", F.expr("row_number() OVER (ORDER BY shard, frame) - 1").cast("long"))
    index = placed.join(places, ["shard", "frame"]).select("path", "size", "mode", "mtime_ns", "uid", "gid", F.col("no").alias("frame"), (F.col("start") + F.col("hlen")).alias("in_off"), F.col("coff").alias("frame_coff"), F.col("clen").alias("frame_clen"), F.lit(-1).cast("long").alias("digest"), F.lit("").alias("link"), F.lit(None).cast("binary").alias("chunks"), F.lit(None).cast("binary").alias("extents"), "shard")
    target = out if shards == 1 else f"{out}.footer"
    end = os.path.getsize(out) if shards == 1 and os.path.exists(out) else 0

    def store_index(batches):
        with open(target, "r+b" if end else "wb") as f:
            f.truncate(end)  # what a lost attempt has written goes
            f.seek(end)
            base, at, entries, leaves, held, first = f.tell(), f.tell(), [], [], [], 0

            def flush(table: pa.Table) -> None:
                nonlocal at, first
                raw = _index_bytes({c: table.column(c).cast(pa.large_string() if table.schema.field(c).type == pa.string() else pa.large_binary() if table.schema.field(c).type == pa.binary() else table.schema.field(c).type) for c in table.column_names}, 3)
                f.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
                entries.append((at + 8, len(raw), first, len(table)))
                leaves.append(hashlib.blake2b(raw, digest_size=32).digest())
                at, first = at + 8 + len(raw), first + len(table)

            for batch in batches:
                held.append(batch)
                table = pa.Table.from_batches(held)
                while len(table) > rows_per_batch:
                    frames = table.column("frame").to_numpy()
                    later = np.flatnonzero(frames[rows_per_batch:] != frames[rows_per_batch - 1])
                    if not len(later):
                        break
                    n = rows_per_batch + int(later[0])
                    flush(table.slice(0, n))
                    table = table.slice(n)
                held = table.to_batches()
            rest = pa.Table.from_batches(held) if held else None
            if rest is not None and len(rest):
                flush(rest)
            root = fold(leaves)
            book = struct.pack("<I", len(entries)) + b"".join(struct.pack("<4Q", *e) for e in entries) + struct.pack("<Qq", 0, time_ns) + root + commit_hash(root, b"\0" * 32, time_ns) + b"".join(leaves)
            f.write(struct.pack("<II", SKIPPABLE, len(book)) + book + struct.pack("<Q", len(book)) + END_WORD)
        yield pa.RecordBatch.from_pylist([{"batches": len(entries), "bytes": at - base}], pa.schema([("batches", pa.int64()), ("bytes", pa.int64())]))

    index.repartition(1).sortWithinPartitions("frame", "path").mapInArrow(store_index, "batches long, bytes long").collect()
    return read(spark, out)
