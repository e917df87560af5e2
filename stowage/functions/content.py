"""What only bytes can tell: digests, content-defined chunks, frames, tar headers, roots.

Spark has no BLAKE2, no Zstandard function and no rolling hash, so these are Arrow functions over batches.
A batch of contents (10,000 rows or 64 MB) is held once, as Arrow; Python takes one content at a time out of it.
The rolling hash of a whole content is made by six shifted additions of numpy arrays, not byte by byte.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

#: Fixed values of chunking: sizes, seed of the gear table, shift of the masks, and the size below which a file is one chunk.
MIN_CHUNK, AVG_CHUNK, MAX_CHUNK, ONE_CHUNK = 16 << 10, 64 << 10, 512 << 10, 128 << 10
GEAR_SEED, MASK_SHIFT = 0x2545F4914F6CDD1D, 44
#: Fixed values of the probe: least length, window, span per window, most windows, and the gain that counts.
PROBE_LEAST, PROBE_WINDOW, PROBE_SPAN, PROBE_MOST, PROBE_GAIN = 256 << 10, 128 << 10, 2 << 20, 16, 32


def gear_table() -> np.ndarray:
    """256 outputs of the 64-bit xorshift-multiply generator."""
    x, out, mod = GEAR_SEED, [], 1 << 64
    for _ in range(256):
        for step in (lambda v: v >> 12, lambda v: v << 25, lambda v: v >> 27):
            x = (x ^ step(x)) % mod
        out.append(x * GEAR_SEED % mod)
    return np.array(out, np.uint64)


GEAR = gear_table()


def _rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash over the last 64 bytes (older ones are shifted out)."""
    h, reach = GEAR[data], 1
    while reach < 64:
        more = h.copy()
        more[reach:] += h[:-reach] << np.uint64(reach)
        h, reach = more, reach * 2
    return h


def cut_points(content: bytes, least: int = MIN_CHUNK, average: int = AVG_CHUNK, most: int = MAX_CHUNK) -> list[int]:
    """Ends of the content-defined chunks. The hash starts anew ``least`` bytes into every chunk."""
    data, n, bits = np.frombuffer(content, np.uint8), len(content), int(average).bit_length() - 1
    strict, easy = (np.uint64(((1 << b) - 1) << MASK_SHIFT) for b in (bits + 2, bits - 2))
    ends, start = [], 0
    if n > least:
        h = _rolling(data)
        hard, soft = np.flatnonzero((h & strict) == 0), np.flatnonzero((h & easy) == 0)
    while start < n:
        if n - start <= least:
            ends.append(n)
            break
        begin, middle, stop = start + least, min(n, start + average), min(n, start + most)
        end, warm, run = stop, min(begin + 64, stop), np.uint64(0)
        with np.errstate(over="ignore"):
            for i in range(begin, warm):  # the window is not full yet
                run = (run << np.uint64(1)) + GEAR[data[i]]
                if not run & (strict if i < middle else easy):
                    end = i + 1
                    break
            else:
                k = int(np.searchsorted(hard, warm))
                at = int(hard[k]) if k < len(hard) and hard[k] < middle else None
                if at is None:
                    k = int(np.searchsorted(soft, max(warm, middle)))
                    at = int(soft[k]) if k < len(soft) and soft[k] < stop else None
                end = stop if at is None else at + 1
        ends.append(end)
        start = end
    return ends


def chunked(docs: DataFrame, key: str = "doc_id", content: str = "content", average: int = AVG_CHUNK) -> DataFrame:
    """key, no, off, len, id (BLAKE2b-128) of all chunks; sizes keep the proportions of the usual ones."""
    least, most = average // 4, average * 8

    def run(batches):
        for batch in batches:
            keys, rows = batch.column(0), []
            for i, value in enumerate(batch.column(1)):
                raw = value.as_py() or b""
                a = 0
                for no, b in enumerate(cut_points(raw, least, average, most)):
                    rows.append((i, no, a, b - a, hashlib.blake2b(raw[a:b], digest_size=16).digest()))
                    a = b
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())], names=[key, "no", "off", "len", "id"])

    named = docs.select(key, content)
    return named.mapInArrow(run, f"{key} {named.schema[key].dataType.simpleString()}, no int, off long, len long, id binary")


def chunk_set_delta(new: DataFrame, old: DataFrame) -> DataFrame:
    """chunks and bytes of all new chunks, and of those whose id no old chunk has."""
    known = old.select("id").distinct().withColumn("known", F.lit(True))
    j = new.join(known, "id", "left")
    return j.agg(F.count(F.lit(1)).alias("chunks"), F.sum("len").alias("bytes"), F.count(F.when(F.col("known").isNull(), 1)).alias("new_chunks"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("len"))), F.lit(0)).alias("new_bytes"))


def each(f, contents: pa.Array, kind: pa.DataType) -> pa.Array:
    """f of every content, null of null; only one content at a time is a Python object."""
    return pa.array((None if (raw := x.as_py()) is None else f(raw) for x in contents), kind)


@arrow_udf(T.LongType())
def digest64(content: pa.Array) -> pa.Array:
    """The first eight bytes of a BLAKE2b digest, little-endian and signed; null for null."""
    return each(lambda x: struct.unpack("<q", hashlib.blake2b(x, digest_size=32).digest()[:8])[0], content, pa.int64())


@arrow_udf(T.BinaryType())
def blake2b256(content: pa.Array) -> pa.Array:
    return each(lambda x: hashlib.blake2b(x, digest_size=32).digest(), content, pa.binary())


def incompressible(raw: bytes) -> bool:
    """Whether the median of evenly spaced windows gains less than a 32nd at level 1."""
    import zstandard

    if len(raw) < PROBE_LEAST:
        return False
    n = min(max(1, min(PROBE_MOST, len(raw) // PROBE_SPAN)), len(raw) // PROBE_WINDOW)
    step = (len(raw) - PROBE_WINDOW) // (n - 1) if n > 1 else 0
    c = zstandard.ZstdCompressor(level=1)
    sizes = sorted(len(c.compress(raw[i * step : i * step + PROBE_WINDOW])) for i in range(n))
    return sizes[n // 2] >= PROBE_WINDOW - PROBE_WINDOW // PROBE_GAIN


def stored_frame(raw: bytes) -> bytes:
    """A valid Zstandard frame of raw blocks of 128 KiB."""
    out = [struct.pack("<IBQ", 0xFD2FB528, 0xE0, len(raw))]
    for i in range(0, max(1, len(raw)), 128 << 10):
        part = raw[i : i + (128 << 10)]
        last = i + (128 << 10) >= len(raw)
        out += [(len(part) << 3 | last).to_bytes(3, "little"), part]
    return b"".join(out)


def frame_bytes(raw: bytes, level: int = 3) -> bytes:
    import zstandard

    return stored_frame(raw) if incompressible(raw) else zstandard.ZstdCompressor(level=level).compress(raw)


def frame_size(frame: bytes) -> int:
    """The content size that a frame's header declares; nothing is inflated."""
    import zstandard

    return zstandard.get_frame_parameters(frame).content_size


@arrow_udf(T.LongType())
def zstd_declared(frame: pa.Array) -> pa.Array:
    """``frame_size`` of every frame."""
    return each(frame_size, frame, pa.int64())


def framed_again(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """key, size, declared, same: each content put in one Zstandard frame, the size in its header, and whether the same comes out.

    Frame and copy live for one row. As columns they would go between Spark and Python, a batch of each at once.
    """

    def run(batches):
        import zstandard

        d = zstandard.ZstdDecompressor()

        def one(raw: bytes) -> dict:
            frame = frame_bytes(raw)
            return {"size": len(raw), "declared": frame_size(frame), "same": d.decompress(frame) == raw}

        kind = pa.struct([("size", pa.int32()), ("declared", pa.int64()), ("same", pa.bool_())])
        for batch in batches:
            found = each(one, batch.column(1), kind)
            keys = batch.column(0).take(pa.array(range(len(found)), pa.int64()))
            del batch  # a copy of the keys lets the contents go before the next batch comes
            yield pa.RecordBatch.from_arrays([keys, *found.flatten()], names=[key, "size", "declared", "same"])

    named = docs.select(key, content)
    return named.mapInArrow(run, f"{key} {named.schema[key].dataType.simpleString()}, size int, declared long, same boolean")


def header_bytes(path: str, size: int, mtime: int, mode: int = 0o644, link: str = "", kind: bytes = tarfile.REGTYPE) -> bytes:
    """A tar header in GNU format, with long-name records where names need them."""
    t = tarfile.TarInfo(path)
    t.size, t.mtime, t.mode, t.linkname, t.type = size, mtime, mode, link, kind
    return t.tobuf(tarfile.GNU_FORMAT, "utf-8", "surrogateescape")


@pandas_udf(T.BinaryType())
def tar_header(path: pd.Series, size: pd.Series, mtime: pd.Series) -> pd.Series:
    return pd.Series([header_bytes(*x) for x in zip(path, size.astype(int), mtime.astype(int))])


def fold(leaves: list[bytes]) -> bytes:
    """The BLAKE2b-256 root: neighbours are joined level by level, an odd last one moves up as it is."""
    h = lambda x: hashlib.blake2b(x, digest_size=32).digest()
    if not leaves:
        return h(b"")
    while len(leaves) > 1:
        joined = [h(a + b) for a, b in zip(leaves[::2], leaves[1::2])]
        leaves = joined + leaves[-1:] if len(leaves) % 2 else joined
    return leaves[0]


def merkle(rows: DataFrame, order: str, leaf, block: int = 4096) -> DataFrame:
    """root (hex), leaves: aligned blocks of a power of two are folded in parallel, then their roots, until one is left."""
    from stowage.operators.members import numbered

    def sub(batch: pa.Table) -> pa.Table:
        at = np.argsort(batch.column("id").to_numpy())
        leaves = batch.column("leaf").to_pylist()
        return pa.table({"block": pa.array([batch.column("block")[0].as_py()], pa.int64()), "root": pa.array([fold([leaves[i] for i in at])], pa.binary()), "n": pa.array([len(leaves)], pa.int64())})

    level = numbered(rows.select(F.col(order).alias("k"), leaf.alias("leaf")), ["k"], "id").select("id", "leaf", F.lit(1).cast("long").alias("n"))
    spark = rows.sparkSession
    blocks = level.withColumn("block", F.expr(f"id div {block}")).groupBy("block").applyInArrow(sub, "block long, root binary, n long").collect()  # one row per 4096 leaves
    blocks.sort(key=lambda r: r.block)
    return spark.createDataFrame([(fold([bytes(r.root) for r in blocks]).hex(), sum(r.n for r in blocks))], "root string, leaves long")


def commit_hash(root: bytes, before: bytes, time_ns: int) -> bytes:
    """The name of a state in a chain: over its root, the name before, and its time."""
    return hashlib.blake2b(root + before + struct.pack("<q", time_ns), digest_size=32).digest()


def cap_sweep(docs: DataFrame, caps: tuple[int, ...], levels: tuple[int, ...], near: float = 0.02, sample: float | None = None) -> DataFrame:
    """level, cap, in_bytes, out_bytes, ratio, knee: frames of up to ``cap`` bytes inside each partition, per level."""

    def run(batches):
        import zstandard

        total: dict[tuple[int, int], list[int]] = {(lv, c): [0, 0] for lv in levels for c in caps}
        held = {k: io.BytesIO() for k in total}

        def close(k):
            raw = held[k].getvalue()
            if raw:
                total[k][0] += len(raw)
                total[k][1] += len(zstandard.ZstdCompressor(level=k[0]).compress(raw))
            held[k] = io.BytesIO()

        for batch in batches:
            for value in batch.column(0):
                raw = value.as_py() or b""
                for k in total:
                    if held[k].tell() and held[k].tell() + len(raw) > k[1]:
                        close(k)
                    held[k].write(raw)
        for k in total:
            close(k)
        yield pa.RecordBatch.from_pylist([{"level": lv, "cap": c, "i": a, "o": b} for (lv, c), (a, b) in total.items()], schema=pa.schema([("level", pa.int32()), ("cap", pa.int64()), ("i", pa.int64()), ("o", pa.int64())]))

    docs = docs if sample is None else docs.sample(sample, 0)
    g = docs.select("content").mapInArrow(run, "level int, cap long, i long, o long").groupBy("level", "cap").agg(F.sum("i").alias("in_bytes"), F.sum("o").alias("out_bytes"))
    g = g.withColumn("ratio", F.round(F.try_divide(F.col("out_bytes").cast("double"), F.col("in_bytes").cast("double")), 4))
    best = g.groupBy("level").agg(F.min("ratio").alias("best"))
    knee = g.join(best, "level").filter(F.col("ratio") <= F.col("best") + near).groupBy("level").agg(F.min("cap").alias("knee"))
    return g.join(knee, "level").select("level", "cap", "in_bytes", "out_bytes", "ratio", (F.col("cap") == F.col("knee")).alias("knee"))


def literal_bytes(old: bytes, new: bytes, block: int) -> int:
    """Bytes of ``new`` that no whole block of ``old`` covers, matched greedily from the left by weak and strong sums."""
    strong = lambda x: hashlib.blake2b(x, digest_size=16).digest()
    known: dict[int, set[bytes]] = {}

    def weak(data: np.ndarray) -> np.ndarray:
        """At each offset, the two running sums of a window of ``block`` bytes, as one number."""
        x = data.astype(np.int64)
        s = np.concatenate([[0], np.cumsum(x)])
        p = np.concatenate([[0], np.cumsum(x * np.arange(len(x)))])
        n = len(x) - block + 1
        a = s[block:] - s[:n]
        b = (np.arange(n) + block) * a - (p[block:] - p[:n])
        return (a & 0xFFFF) | ((b & 0xFFFF) << 16)

    o, n = np.frombuffer(old, np.uint8), np.frombuffer(new, np.uint8)
    if len(o) < block or len(n) < block:
        return len(new)
    for i, w in zip(range(0, len(o) - block + 1, block), weak(o)[::block].tolist()):
        known.setdefault(w, set()).add(strong(old[i : i + block]))
    sums = weak(n)
    likely = np.flatnonzero(np.isin(sums, np.fromiter(known, np.int64, len(known))))
    at, matched = 0, 0
    for i in likely.tolist():
        if i >= at and strong(new[i : i + block]) in known[int(sums[i])]:
            matched, at = matched + block, i + block
    return len(new) - matched


def rolling_literal(old: str, new: str, block: int):
    @arrow_udf(T.LongType())
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array((literal_bytes(x.as_py() or b"", y.as_py() or b"", block) for x, y in zip(a, b)), pa.int64())

    return count(old, new)
