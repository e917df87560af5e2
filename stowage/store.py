"""A member store: compressed frames, an index per snapshot, and a chain of snapshots.

Below one folder on any file system that Spark reads:

* ``frames/snapshot=K/``: shard, frame, raw_len, payload; a frame is one Zstandard frame of whole pieces;
* ``index/snapshot=K/``: one row per member (``schema.STAT``); ``frame`` numbers are unique in the store,
  ``coff`` repeats the frame, ``clen`` is its stored length;
* ``snapshots/K``: a small JSON file, made last and in one step: what isn't there didn't happen.

A backup reads only what changed. A changed file of 128 KiB or more is cut into content-defined chunks;
those that its last version had stay where they are, and the member becomes a list of extents.
"""

from __future__ import annotations

import hashlib
import json
import os
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import content as ct
from stowage.functions.globs import member_filter
from stowage.operators import delta, layout, members, retention
from stowage.schema import EXTENTS, HARDLINK, STAT, SYMLINK, conform

FRAME_CAP = 64 << 20
PIECE = pa.schema([("path", pa.string()), ("size", pa.int64()), ("digest", pa.int64()), ("chunks", pa.list_(pa.struct([("len", pa.int64()), ("id", pa.binary())]))), ("no", pa.int32()), ("out_off", pa.int64()), ("len", pa.int64()), ("old", pa.struct([(n, pa.int64()) for n in ("coff", "clen", "in_off", "shard")])), ("shard", pa.int64()), ("body", pa.binary())])
PIECE_SQL = "path string, size long, digest long, chunks array<struct<len:long,id:binary>>, no int, out_off long, len long, old struct<coff:long,clen:long,in_off:long,shard:long>, shard long, body binary"


def digest64(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=32).digest()[:8], "little", signed=True)


def chunk_list(raw: bytes) -> list[dict]:
    ends = ct.cut_points(raw)
    return [{"len": b - a, "id": hashlib.blake2b(raw[a:b], digest_size=16).digest()} for a, b in zip([0, *ends], ends)]


def plan_pieces(raw: bytes, chunks: list[dict], old_chunks: list[dict] | None, old_extents: list[dict] | None, cap: int) -> list[tuple[int, int, dict | None]]:
    """(out_off, len, old place or None) of a file: runs of its chunks that are stored already, and new pieces of at most ``cap``."""
    known, at = {}, 0
    starts = [e["out_off"] for e in old_extents or []]
    for c in old_chunks or []:
        i = int(np.searchsorted(starts, at, side="right")) - 1
        if i >= 0 and at + c["len"] <= old_extents[i]["out_off"] + old_extents[i]["len"]:
            e = old_extents[i]
            known.setdefault(bytes(c["id"]), (c["len"], {"coff": e["coff"], "clen": e["clen"], "shard": e["shard"], "in_off": e["in_off"] + at - e["out_off"]}))
        at += c["len"]
    runs: list[list] = []
    at = 0
    for c in chunks or [{"len": len(raw), "id": b""}]:
        found = known.get(bytes(c["id"]))
        place = found[1] if found and found[0] == c["len"] else None
        last = runs[-1] if runs else None
        joins = last and ((place is None and last[2] is None) or (place and last[2] and all(place[k] == last[2][k] for k in ("coff", "shard")) and place["in_off"] == last[2]["in_off"] + last[1]))
        if joins:
            last[1] += c["len"]
        else:
            runs.append([at, c["len"], place])
        at += c["len"]
    out = []
    for off, n, place in runs:
        if place is not None or n <= cap:
            out.append((off, n, place))
            continue
        cuts = list(range(0, n, cap))
        if len(cuts) > 1 and n - cuts[-1] < layout.SHORTEST_PIECE:
            cuts.pop()
        out += [(off + a, b - a, None) for a, b in zip(cuts, [*cuts[1:], n])]
    return out


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/") if "://" in root else "file://" + os.path.abspath(root)

    # files

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def chain(self) -> list[dict]:
        """Snapshots, newest first: at, time_ns, prev, root, commit, files."""
        fs, p = self._fs(f"{self.root}/snapshots")
        if not fs.exists(p):
            return []
        out = []
        for f in fs.listStatus(p):
            if f.getPath().getName().isdigit():
                stream = fs.open(f.getPath())
                out.append(json.loads(bytes(stream.readAllBytes()).decode()))
                stream.close()
        return sorted(out, key=lambda s: -s["at"])

    def snapshots(self) -> DataFrame:
        rows = [(s["at"], s["time_ns"], s["prev"], s["root"], s["commit"]) for s in self.chain()]
        return self.spark.createDataFrame(rows, "at long, time_ns long, prev long, root string, commit string")

    def members(self, at: int | None = None) -> DataFrame:
        """The index of a snapshot, the newest if none is named; no frame is read."""
        chain = self.chain()
        if not chain:
            return self.spark.createDataFrame([], STAT)
        at = chain[0]["at"] if at is None else at
        return conform(self.spark.read.parquet(f"{self.root}/index/snapshot={at}"))

    def frames(self) -> DataFrame:
        done = [f"{self.root}/frames/snapshot={s['at']}" for s in self.chain()]
        return self.spark.read.schema("shard long, frame long, raw_len long, payload binary").parquet(*done)

    def _commit(self, at: int, index: DataFrame, time_ns: int, prev: dict | None) -> dict:
        index.repartitionByRange("path").sortWithinPartitions("path").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/index/snapshot={at}")
        root = self.index_root(at)
        commit = ct.commit_hash(bytes.fromhex(root), bytes.fromhex(prev["commit"]) if prev else b"\0" * 32, time_ns)
        record = {"at": at, "time_ns": time_ns, "prev": prev["at"] if prev else None, "root": root, "commit": commit.hex()}
        fs, p = self._fs(f"{self.root}/snapshots/{at}")
        stream = fs.create(p, False)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        return record

    def index_root(self, at: int) -> str:
        rows = conform(self.spark.read.parquet(f"{self.root}/index/snapshot={at}"))
        leaf = F.unhex(F.sha2(F.to_json(F.struct(*[c for c in rows.columns])), 256))
        return ct.merkle(rows, "path", leaf).first().root

    # writing

    def write(self, files: DataFrame, others: DataFrame | None = None, carried: DataFrame | None = None, bodies=None, frame_cap: int = FRAME_CAP, shards: int = 1, level: int = 6, time_ns: int | None = None) -> dict:
        """One snapshot from changed files (path, size, mode, mtime_ns, uid, gid, [content]), links and directories, and unchanged rows.

        ``bodies``: a function (path) -> bytes where ``files`` has no content; called on the executors.
        """
        chain = self.chain()
        prev, at = (chain[0] if chain else None), (chain[0]["at"] + 1 if chain else 0)
        prior = self.members().select("path", F.col("chunks").alias("old_chunks"), "frame", "size", "shard", "coff", "clen", "in_off", "extents")
        whole = F.array(F.struct("coff", "clen", "in_off", F.col("size").alias("len"), F.lit(0).cast("long").alias("out_off"), "shard"))
        places = prior.select("path", "old_chunks", F.when(F.col("frame") == EXTENTS, F.col("extents")).when(F.col("frame") >= 0, whole).alias("old_extents"))
        cols = ["path", "content"] if "content" in files.columns else ["path"]
        todo = files.select(*cols, members.split_by_hash(F.col("path"), shards).cast("long").alias("shard")).join(places, "path", "left")

        def read(batches):
            rows, held = [], 0
            for batch in batches:
                for r in batch.to_pylist():
                    raw = r["content"] if "content" in r else bodies(r["path"])
                    raw = raw or b""
                    chunks = chunk_list(raw) if len(raw) >= ct.ONE_CHUNK else None
                    for no, (off, n, old) in enumerate(plan_pieces(raw, chunks, r["old_chunks"], r["old_extents"], frame_cap)):
                        body = None if old else raw[off : off + n]
                        rows.append({"path": r["path"], "size": len(raw), "digest": digest64(raw), "chunks": chunks, "no": no, "out_off": off, "len": n, "old": old, "shard": r["shard"], "body": body})
                        held += len(body or b"") + 300
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, PIECE)
                            rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, PIECE)

        work = f"{self.root}/work/{at}"
        todo.mapInArrow(read, PIECE_SQL).write.mode("overwrite").option("compression", "zstd").parquet(f"{work}/pieces")
        pieces = self.spark.read.schema(PIECE_SQL).parquet(f"{work}/pieces")
        plan = layout.greedy_frames(pieces.filter("old IS NULL").select("shard", "path", "no", "len"), ["shard"], ["path", "no"], frame_cap, "len")
        plan.withColumn("frame", F.col("frame") + F.lit(at << 32)).write.mode("overwrite").parquet(f"{work}/plan")
        plan = self.spark.read.parquet(f"{work}/plan")

        def pack(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("in_off").to_numpy(), kind="stable")
            raw = b"".join(table.column("body")[int(i)].as_py() for i in order)
            return pa.table({"shard": table.column("shard").slice(0, 1), "frame": table.column("frame").slice(0, 1), "raw_len": pa.array([len(raw)], pa.int64()), "payload": pa.array([ct.frame_bytes(raw, level)], pa.binary())})

        bodies_in = pieces.filter("old IS NULL").select("path", "no", "body").join(plan, ["path", "no"])
        framed = bodies_in.select("shard", "frame", "in_off", "body").groupBy("shard", "frame").applyInArrow(pack, "shard long, frame long, raw_len long, payload binary")
        framed.write.mode("overwrite").option("compression", "none").parquet(f"{self.root}/frames/snapshot={at}")
        made = self.spark.read.parquet(f"{self.root}/frames/snapshot={at}").select("shard", "frame", F.octet_length("payload").cast("long").alias("made_clen"))
        placed = pieces.drop("body").join(plan.select("path", "no", "frame", "in_off"), ["path", "no"], "left").join(made, ["shard", "frame"], "left")
        pick = lambda old, new: F.coalesce(F.col(f"old.{old}"), F.col(new))
        extent = F.struct(pick("coff", "frame").alias("coff"), pick("clen", "made_clen").alias("clen"), pick("in_off", "in_off").alias("in_off"), "len", "out_off", pick("shard", "shard").alias("shard"))
        packed = placed.groupBy("path").agg(F.max("size").alias("new_size"), F.max("digest").alias("digest"), F.max_by("chunks", "no").alias("chunks"), F.sort_array(F.collect_list(F.struct("no", extent.alias("e")))).alias("e"))
        packed = packed.withColumn("extents", F.transform("e", lambda x: x["e"]))
        one = (F.size("extents") == 1) & F.get("extents", F.lit(0))["len"].eqNullSafe(F.col("new_size"))
        first = F.get("extents", F.lit(0))
        kind = lambda c: F.when(one, first[c]).otherwise(F.lit(-1))
        rows = files.drop("content", "size").join(packed, "path").select(
            *[c for c in ("path", "mode", "mtime_ns", "uid", "gid") if c in files.columns], F.col("new_size").alias("size"), "digest", "chunks",
            F.when(one, first["coff"]).otherwise(F.lit(EXTENTS)).alias("frame"), kind("in_off").alias("in_off"), kind("coff").alias("coff"), kind("clen").alias("clen"), F.when(one, first["shard"]).otherwise(F.lit(0)).alias("shard"),
            F.when(one, F.lit(None).cast(STAT["extents"].dataType)).otherwise(F.col("extents")).alias("extents"),
        )
        index = conform(rows)
        for more in (carried, others):
            if more is not None:
                index = index.unionByName(conform(more))
        record = self._commit(at, index, time_ns or time.time_ns(), prev)
        fs, p = self._fs(work)
        fs.delete(p, True)
        return record

    # reading

    def slices(self, at: int | None = None, wanted=None) -> DataFrame:
        """path, out_off, body of all pieces of the wanted members: each frame is inflated once."""
        m = self.members(at)
        m = m.filter(wanted) if wanted is not None else m
        one = m.filter("frame >= 0").select("path", "shard", F.col("coff").alias("frame"), "in_off", F.col("size").alias("len"), F.lit(0).cast("long").alias("out_off"))
        many = m.filter(f"frame = {EXTENTS}").select("path", F.inline("extents")).select("path", "shard", F.col("coff").alias("frame"), "in_off", "len", "out_off")

        def cut(places: pa.Table, frames: pa.Table) -> pa.Table:
            import zstandard

            if not frames.num_rows or not places.num_rows:
                return pa.table({"path": pa.array([], pa.string()), "out_off": pa.array([], pa.int64()), "body": pa.array([], pa.binary())})
            raw = zstandard.ZstdDecompressor().decompress(frames.column("payload")[0].as_py(), max_output_size=frames.column("raw_len")[0].as_py())
            bodies = [raw[o : o + n] for o, n in zip(places.column("in_off").to_pylist(), places.column("len").to_pylist())]
            return pa.table({"path": places.column("path"), "out_off": places.column("out_off"), "body": pa.array(bodies, pa.binary())})

        places, frames = one.unionByName(many), self.frames()
        if wanted is not None:  # payloads of other frames don't move
            frames = frames.join(places.select("shard", "frame").distinct(), ["shard", "frame"], "left_semi")
        return places.groupBy("shard", "frame").cogroup(frames.groupBy("shard", "frame")).applyInArrow(cut, "path string, out_off long, body binary")

    def contents(self, at: int | None = None, wanted=None) -> DataFrame:
        """path, content of the wanted members."""
        whole = F.sort_array(F.collect_list(F.struct("out_off", "body")))
        g = self.slices(at, wanted).groupBy("path").agg(whole.alias("s"))
        return g.select("path", F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["body"])).alias("content"))

    # checking

    def verify(self, at: int | None = None, sample: int | None = None) -> DataFrame:
        """path, status ('ok', 'mismatched', 'undigested', 'lost') of all file members, or of those of ``sample`` members by hash."""
        m = self.members(at).filter(f"frame >= 0 OR frame = {EXTENTS}").select("path", "size", "digest")
        if sample is not None:
            m = members.sample(m, F.col("path"), sample)
        got = self.contents(at).select("path", ct.digest64("content").alias("found"), F.octet_length("content").cast("long").alias("n"))
        j = m.join(got, "path", "left")
        status = F.when(F.col("found").isNull(), "lost").when(F.col("digest") == -1, "undigested").when((F.col("digest") == F.col("found")) & (F.col("n") == F.col("size")), "ok").otherwise("mismatched")
        return j.select("path", status.alias("status"))

    def truncated(self, at: int | None = None) -> DataFrame:
        """Frames whose declared size is below what members take from them; nothing is inflated."""
        m = self.members(at)
        need = m.filter("frame >= 0").select("shard", F.col("coff").alias("frame"), (F.col("in_off") + F.col("size")).alias("e")).unionByName(m.filter(f"frame = {EXTENTS}").select(F.inline("extents")).select("shard", F.col("coff").alias("frame"), (F.col("in_off") + F.col("len")).alias("e")))
        need = need.groupBy("shard", "frame").agg(F.max("e").alias("need"))
        have = self.frames().select("shard", "frame", ct.zstd_declared("payload").alias("have"))
        return need.join(have, ["shard", "frame"], "left").filter("have IS NULL OR have < need")

    def verify_merkle(self) -> list[int]:
        """Snapshots whose index or place in the chain isn't what their names say."""
        chain, bad = self.chain(), []
        by = {s["at"]: s for s in chain}
        for s in chain:
            prev = by.get(s["prev"])
            before = bytes.fromhex(prev["commit"]) if prev else b"\0" * 32
            if self.index_root(s["at"]) != s["root"] or ct.commit_hash(bytes.fromhex(s["root"]), before, s["time_ns"]).hex() != s["commit"]:
                bad.append(s["at"])
        return bad

    def stats(self, at: int | None = None) -> DataFrame:
        return members.store_stats(self.located(at))

    def located(self, at: int | None = None) -> DataFrame:
        """All pieces of members with their frames, extents included: path, size, shard, coff, clen."""
        m = self.members(at)
        one = m.filter("frame >= 0").select("path", "size", "shard", "coff", "clen")
        return one.unionByName(m.filter(f"frame = {EXTENTS}").select("path", F.inline("extents")).select("path", F.col("len").alias("size"), "shard", "coff", "clen"))

    # upkeep

    def gc(self, **policy) -> list[int]:
        """Keep the snapshots of a retention policy and the frames they need; the chain is named anew. Returns what was kept."""
        chain = self.chain()
        if not chain:
            return []
        kept = {r.at for r in retention.retain(self.snapshots().select("at", "time_ns"), **policy).filter("kept").collect()}
        new = Store(self.spark, f"{self.root}.gc")
        fs, p = self._fs(new.root)
        fs.delete(p, True)
        live = None
        for s in chain:
            if s["at"] in kept:
                f = retention.live_frames(self.members(s["at"])).select("shard", F.col("coff").alias("frame"))
                live = f if live is None else live.unionByName(f)
        live = live.distinct()
        for s in chain:  # frames stay with the snapshot that made them, or go to the oldest kept one
            f = self.spark.read.schema("shard long, frame long, raw_len long, payload binary").parquet(f"{self.root}/frames/snapshot={s['at']}")
            home = min((k for k in kept if k >= s["at"]), default=max(kept))
            f.join(live, ["shard", "frame"], "left_semi").write.mode("append").option("compression", "none").parquet(f"{new.root}/frames/snapshot={home}")
        prev = None
        for at in sorted(kept):
            index = self.members(at)
            prev = new._commit(at, index, next(s["time_ns"] for s in chain if s["at"] == at), prev)
        fs, old = self._fs(self.root)
        _, fresh = self._fs(new.root)
        _, aside = self._fs(f"{self.root}.old")
        fs.delete(aside, True)
        fs.rename(old, aside)
        fs.rename(fresh, old)
        fs.delete(aside, True)
        return sorted(kept)

    def push(self, url: str) -> list[int]:
        """Copy the snapshots that the other side lacks, each one's name last; returns them. ``pull`` is the other store's push."""
        other = Store(self.spark, url)
        there = {s["at"]: s["commit"] for s in other.chain()}
        mine = sorted(self.chain(), key=lambda s: s["at"])
        if any(there.get(s["at"], s["commit"]) != s["commit"] for s in mine) or set(there) - {s["at"] for s in mine}:
            raise ValueError("the other side has another history")
        util = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        sent = [s["at"] for s in mine if s["at"] not in there]
        for at in sent:
            for part in (f"frames/snapshot={at}", f"index/snapshot={at}", f"snapshots/{at}"):
                (fs, a), (gs, b) = self._fs(f"{self.root}/{part}"), other._fs(f"{other.root}/{part}")
                gs.mkdirs(b.getParent())
                gs.delete(b, True)
                if fs.exists(a):
                    util.copy(fs, a, gs, b, False, True, conf)
        return sent


# verbs that make snapshots


def _file_reader(root: str):
    def read(path: str) -> bytes:
        with open(os.path.join(root, path), "rb") as f:
            return f.read()

    return read


def backup(spark: SparkSession, root: str, out: str, ignore: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None, min_size: int = 0, **how) -> dict:
    """A snapshot of a mounted tree: unchanged members keep their places, changed ones are read. Returns counts and the snapshot."""
    from stowage.sources import fs

    store = Store(spark, out)
    scanned = fs.with_links(fs.scan(spark, root, ignore)).filter("path <> '' AND err = 0")
    keep = member_filter(F.col("path"), F.col("size"), include, exclude, min_size)
    scanned = scanned.filter((F.col("kind") != "file") | keep)
    files = scanned.filter("kind = 'file'").select("path", "size", "mode", "mtime_ns", "uid", "gid")
    prior = store.members()
    inc = delta.incremental(files, prior.select("path", "size", "mtime_ns", "frame"))
    code = F.when(F.col("kind") == "dir", -1).when(F.col("kind") == "symlink", SYMLINK).otherwise(HARDLINK)
    others = scanned.filter("kind <> 'file'").select("path", F.when(F.col("kind") == "dir", 0).otherwise(F.col("size")).alias("size"), "mode", "mtime_ns", "uid", "gid", code.alias("frame"), "link")
    carried = prior.join(inc.filter("unchanged").select("path"), "path", "left_semi")
    changed = inc.filter("NOT unchanged").drop("unchanged")
    counts = inc.groupBy("unchanged").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r.unchanged: r.n for r in counts}
    gone = delta.deleted(files, prior.filter(f"frame >= 0 OR frame = {EXTENTS}")).count()
    record = store.write(changed, others, carried, _file_reader(root), **how)
    return {"unchanged": counts.get(True, 0), "packed": counts.get(False, 0), "deleted": gone, **record}


def recompress(spark: SparkSession, archives: str, out: str, include: list[str] | None = None, exclude: list[str] | None = None, min_size: int = 0, **how) -> dict:
    """A snapshot of the members of tar archives; of members of one path, the last of the last archive holds."""
    from stowage.sources.archives import read_tar

    t = read_tar(spark, archives)
    t = members.keep_last(t, ["path"], [F.col("archive"), F.col("no")])
    files = t.filter("kind = 'file'").filter(member_filter(F.col("path"), F.col("size"), include, exclude, min_size))
    code = F.when(F.col("kind") == "dir", -1).when(F.col("kind") == "symlink", SYMLINK).otherwise(HARDLINK)
    others = t.filter("kind <> 'file'").select("path", "size", "mode", "mtime_ns", "uid", "gid", code.alias("frame"), "link")
    return Store(spark, out).write(files.select("path", "size", "mode", "mtime_ns", "uid", "gid", "content"), others, **how)
