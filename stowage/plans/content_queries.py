"""Digests, chunks, frames, headers and roots of contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.functions import content as ops
from stowage.plans import fixtures as fx
from stowage.plans.registry import query


def _docs(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))


@query("SELECT doc_id, substr(hex(encode(text)), 21, 80) AS slice, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents")
def member_slices(spark, d):
    """X18, X4, X12."""
    return _docs(spark, d).select("doc_id", F.hex(F.substring("content", 11, 40)).alias("slice"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


@query()
def content_digests(spark, d):
    """BLAKE2b digests (hashlib in tests)."""
    return _docs(spark, d).select("doc_id", ops.digest64("content").alias("digest"), ops.blake2b256("content").alias("blake2b"))


@query()
def content_chunks(spark, d):
    """Content-defined chunks."""
    return ops.chunked(_docs(spark, d), average=1024)


@query()
def chunk_delta(spark, d):
    """B2: bytes of chunks that no document with a smaller id in the same pair holds."""
    c = ops.chunked(_docs(spark, d), average=1024)
    return ops.chunk_set_delta(c.filter("doc_id % 2 = 0"), c.filter("doc_id % 2 = 1"))


@query()
def zstd_frames(spark, d):
    """Frames with declared size, and what comes out of them again."""
    return ops.framed_again(_docs(spark, d))


@query()
def tar_headers(spark, d):
    """Header bytes, one or more blocks."""
    m = fx.members(spark, d)
    return m.select("path", ops.tar_header("path", "size", F.expr("mtime_ns div 1000000000")).alias("header"))


@query()
def merkle_root(spark, d):
    """The root over all members' digests, in path order."""
    return ops.merkle(fx.members(spark, d), "path", F.unhex("digest"))


@query()
def frame_cap_sweep(spark, d):
    """Ratio by frame cap and level; the knee is the smallest cap near the best."""
    return ops.cap_sweep(_docs(spark, d), caps=(16_384, 65_536, 262_144), levels=(1, 6))


@query()
def rolling_delta(spark, d):
    """Bytes that a rolling-checksum delta sends for each document after an edit."""
    docs = _docs(spark, d).withColumn("new", F.concat(F.substring("content", 1, 700), F.encode(F.lit("edited"), "utf-8"), F.expr("substring(content, 701)")))
    return docs.select("doc_id", F.octet_length("new").alias("size"), ops.rolling_literal("content", "new", 256).alias("literal"))
