"""Verbs that change a mounted tree: unpack, copy, remove, sync.

Every step is one distributed action over a table of paths, safe to run again: files are written under a
temporary name and renamed, what is gone already counts as removed. Order comes from separate actions:
directories by depth, files, hardlinks, symlinks, and the directories' own times last.
"""

from __future__ import annotations

import os
import shutil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions.globs import glob_any
from stowage.functions.paths import depth
from stowage.operators import delta
from stowage.schema import EXTENTS, kind
from stowage.sources import fs
from stowage.store import Store

DONE = "path string, err string"


def each(rows: DataFrame, step) -> list[tuple[str, str]]:
    """Run ``step(row)`` on the executors; returns (path, error) of the rows that failed."""

    def run(batches):
        for batch in batches:
            bad = []
            for r in batch.to_pylist():
                try:
                    step(r)
                except OSError as e:
                    bad.append({"path": r["path"], "err": str(e)})
            yield pa.RecordBatch.from_pylist(bad, pa.schema([("path", pa.string()), ("err", pa.string())]))

    return [(r.path, r.err) for r in rows.mapInArrow(run, DONE).collect()]


def _settle(full: str, r: dict) -> None:
    """Owner (where allowed), then mode, then times."""
    try:
        os.chown(full, r["uid"], r["gid"], follow_symlinks=False)
    except PermissionError:
        pass
    os.chmod(full, r["mode"])
    os.utime(full, ns=(r["mtime_ns"], r["mtime_ns"]))


def _replace(full: str, make) -> None:
    os.makedirs(os.path.dirname(full), exist_ok=True)
    temporary = f"{full}.stowage-{os.getpid()}"
    if os.path.lexists(temporary):
        os.remove(temporary)
    make(temporary)
    os.replace(temporary, full)


def make_links(rows: DataFrame, dest: str) -> list[tuple[str, str]]:
    """Hardlinks first, then symlinks; ``rows``: path, kind, link."""
    hard = each(rows.filter("kind = 'hardlink'").select("path", "link"), lambda r: _replace(os.path.join(dest, r["path"]), lambda t: os.link(os.path.join(dest, r["link"]), t)))
    soft = each(rows.filter("kind = 'symlink'").select("path", "link"), lambda r: _replace(os.path.join(dest, r["path"]), lambda t: os.symlink(r["link"], t)))
    return hard + soft


def make_dirs(rows: DataFrame, dest: str) -> list[tuple[str, str]]:
    return each(rows.filter("kind = 'dir'").select("path"), lambda r: os.makedirs(os.path.join(dest, r["path"]), exist_ok=True))


def settle_dirs(rows: DataFrame, dest: str) -> list[tuple[str, str]]:
    return each(rows.filter("kind = 'dir' AND path <> ''").select("path", "mode", "mtime_ns", "uid", "gid"), lambda r: _settle(os.path.join(dest, r["path"]), r))


def unpack(spark: SparkSession, store: str, dest: str, at: int | None = None, globs: list[str] | None = None) -> dict:
    """Members of a snapshot into a tree; returns counts and errors. Each frame is inflated once, and each piece written at its place."""
    s = Store(spark, store)
    dest = os.path.abspath(dest)
    os.makedirs(dest, exist_ok=True)
    wanted = glob_any(F.col("path"), globs)
    m = s.members(at).filter(wanted).withColumn("kind", kind())
    errors = make_dirs(m, dest)
    files = m.filter(f"frame >= 0 OR frame = {EXTENTS}")

    def blank(r):
        full = os.path.join(dest, r["path"])
        os.makedirs(os.path.dirname(full), exist_ok=True)
        if os.path.islink(full) or (os.path.exists(full) and os.stat(full).st_nlink > 1):
            os.remove(full)
        with open(full, "ab") as f:
            f.truncate(r["size"])

    def put(r):
        with open(os.path.join(dest, r["path"]), "r+b") as f:
            f.seek(r["out_off"])
            f.write(r["body"])

    errors += each(files.select("path", "size"), blank)
    errors += each(s.slices(at, wanted), put)
    errors += each(files.select("path", "mode", "mtime_ns", "uid", "gid"), lambda r: _settle(os.path.join(dest, r["path"]), r))
    errors += make_links(m, dest)
    errors += settle_dirs(m, dest)
    n = {r.kind: r.n for r in m.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"files": n.get("file", 0) + n.get("extents", 0), "symlinks": n.get("symlink", 0), "hardlinks": n.get("hardlink", 0), "dirs": n.get("dir", 0), "errors": errors}


def _copy_files(rows: DataFrame, src: str, dest: str) -> list[tuple[str, str]]:
    def copy(r):
        def make(t):
            shutil.copyfile(os.path.join(src, r["path"]), t)
            _settle(t, r)

        _replace(os.path.join(dest, r["path"]), make)

    return each(rows.select("path", "mode", "mtime_ns", "uid", "gid"), copy)


def cp(spark: SparkSession, src: str, dest: str) -> dict:
    """A tree with modes, times, symlinks and hardlinks."""
    t = fs.with_links(fs.scan(spark, src)).filter("err = 0")
    os.makedirs(dest, exist_ok=True)
    errors = make_dirs(t.filter("path <> ''"), dest) + _copy_files(t.filter("kind = 'file'"), src, dest) + make_links(t, dest) + settle_dirs(t, dest)
    n = t.filter("kind <> 'dir'").count()
    return {"copied": n - len(errors), "errors": errors}


def _gone(step, full: str) -> None:
    try:
        step(full)
    except FileNotFoundError:
        pass


def _remove_dirs(spark: SparkSession, dirs: DataFrame, root: str) -> list[tuple[str, str]]:
    """Deepest first, a level at a time."""
    dirs = dirs.select("path", depth(F.col("path")).alias("d")).cache()
    errors = []
    for (d,) in dirs.select("d").distinct().orderBy(F.desc("d")).collect():
        errors += each(dirs.filter(F.col("d") == d).select("path"), lambda r: _gone(os.rmdir, os.path.join(root, r["path"])))
    dirs.unpersist()
    return errors


def rm(spark: SparkSession, root: str) -> dict:
    """A tree, its root included; only names are read."""
    t = fs.scan(spark, root, names=True).select("path", "is_dir").cache()
    n = t.filter("NOT is_dir").count()
    errors = each(t.filter("NOT is_dir").select("path"), lambda r: _gone(os.unlink, os.path.join(root, r["path"])))
    errors += _remove_dirs(spark, t.filter("is_dir AND path <> ''"), root)
    t.unpersist()
    if not errors:
        _gone(os.rmdir, root)
    return {"removed": n - len(errors), "errors": errors}


def sync(spark: SparkSession, src: str, dest: str) -> dict:
    """Make ``dest`` like ``src``: send what differs in size or exact time, links that differ, directories; delete the rest."""
    os.makedirs(dest, exist_ok=True)
    a = fs.with_links(fs.scan(spark, src)).filter("err = 0 AND path <> ''").cache()
    b = fs.with_links(fs.scan(spark, dest)).filter("path <> ''").cache()
    b.count()
    keys = {"file": [F.col("size"), F.col("mtime_ns")], "symlink": [F.col("link")], "hardlink": [F.col("link")], "dir": [F.col("mode"), F.col("mtime_ns")]}
    plans = {k: delta.sync_plan(a.filter(F.col("kind") == k), b.filter(F.col("kind") == k), on) for k, on in keys.items()}
    send = {k: a.filter(F.col("kind") == k).join(p.filter("action = 'send'").select("path"), "path", "left_semi") for k, p in plans.items()}
    gone = [p.filter("action = 'delete'").select("path") for k, p in plans.items() if k != "dir"]
    old = gone[0].unionByName(gone[1]).unionByName(gone[2]).join(a.filter("kind <> 'dir'").select("path"), "path", "left_anti")
    old_n = old.count()
    errors = each(old, lambda r: _gone(os.unlink, os.path.join(dest, r["path"])))
    errors += _remove_dirs(spark, plans["dir"].filter("action = 'delete'"), dest)
    errors += make_dirs(a, dest)
    sent = send["file"].count()
    errors += _copy_files(send["file"], src, dest)
    links = send["hardlink"].unionByName(send["symlink"])
    n_links = links.count()
    errors += make_links(links, dest)
    errors += settle_dirs(a, dest)
    a.unpersist()
    b.unpersist()
    return {"sent": sent, "links": n_links, "deleted": old_n, "errors": errors}


__all__ = ["cp", "rm", "sync", "unpack"]
