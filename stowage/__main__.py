"""The verbs on the command line: ``python -m stowage VERB ...``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stowage")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(verb_name: str, *args: str, **options):
        v = sub.add_parser(verb_name)
        for a in args:
            v.add_argument(a)
        for o, how in options.items():
            v.add_argument("--" + o.replace("_", "-"), **how)

    many, number = {"action": "append"}, {"type": int}
    filters = {"glob": many, "exclude": many, "min_size": {"type": int, "default": 0}}
    packing = {"level": {"type": int, "default": 6}, "frame_cap": {"type": int, "default": 64 << 20}, "shards": {"type": int, "default": 1}}
    verb("scan", "store", glob=many)
    verb("find", "root", name={}, min_size=number, max_size=number, newer={})
    verb("du", "root")
    verb("diff", "a", "b")
    verb("backup", "root", "store", ignore=many, **filters, **packing)
    verb("recompress", "archives", "store", **filters, **packing)
    verb("unpack", "store", "dest", glob=many, snapshot={"type": int, "default": 0})
    verb("verify", "store", sample=number, merkle={"action": "store_true"}, complete={})
    verb("stats", "store")
    verb("snapshots", "store")
    verb("gc", "store", **{k: {"type": int, "default": 0} for k in ("last", "daily", "weekly", "monthly", "yearly")})
    verb("push", "store", "url")
    verb("pull", "url", "store")
    verb("cp", "src", "dest")
    verb("sync", "src", "dest")
    verb("rm", "root")
    verb("serve", "store", port={"type": int, "default": 8756})
    return p


def tree(spark: SparkSession, side: str):
    """path, size, mtime_ns of a tree, a store, or tar archives (``fs:``, ``store:``, ``tar:``, or by what is there)."""
    from stowage.sources import archives, fs
    from stowage.store import Store

    how, _, rest = side.partition(":")
    if how not in ("fs", "store", "tar"):
        rest = side
        how = "store" if os.path.isdir(os.path.join(side, "snapshots")) and os.path.isdir(os.path.join(side, "index")) else "tar" if os.path.isfile(side) else "fs"
    if how == "fs":
        t = fs.scan(spark, rest).filter("NOT is_dir AND err = 0")
    elif how == "tar":
        t = archives.read_tar(spark, rest, content=False).filter("kind <> 'dir'")
    else:
        t = Store(spark, rest).members().filter("frame <> -1")
    return t.select("path", "size", "mtime_ns")


def run(spark: SparkSession, a: argparse.Namespace):
    """The answer of a verb: rows or a dictionary."""
    from stowage import actions
    from stowage import store as st
    from stowage.functions import globs
    from stowage.operators import delta, members
    from stowage.sources import fs

    s = st.Store(spark, a.store) if hasattr(a, "store") else None
    filters = {"include": getattr(a, "glob", None), "exclude": getattr(a, "exclude", None), "min_size": getattr(a, "min_size", 0) or 0}
    how = {"level": getattr(a, "level", 6), "frame_cap": getattr(a, "frame_cap", 0), "shards": getattr(a, "shards", 1)}
    if a.verb == "scan":
        m = s.members().filter("frame >= 0 OR frame = -4").filter(globs.glob_any(F.col("path"), a.glob))
        return members.disk_usage(m)
    if a.verb == "find":
        newer = os.stat(a.newer).st_mtime_ns if a.newer else None
        t = fs.scan(spark, a.root).filter("NOT is_dir")
        return t.filter(globs.find(F.col("path"), F.col("size"), F.col("mtime_ns"), a.name, a.min_size, a.max_size, newer)).select("path", "size").orderBy("path")
    if a.verb == "du":
        return members.disk_usage(fs.scan(spark, a.root).filter("NOT is_dir"))
    if a.verb == "diff":
        return delta.diff_trees(tree(spark, a.a), tree(spark, a.b)).filter("status <> 'unchanged'").orderBy("path")
    if a.verb == "backup":
        return st.backup(spark, a.root, a.store, a.ignore, **filters, **how)
    if a.verb == "recompress":
        return st.recompress(spark, a.archives, a.store, **filters, **how)
    if a.verb == "unpack":
        return actions.unpack(spark, a.store, a.dest, s.chain()[a.snapshot]["at"], a.glob)
    if a.verb == "verify":
        if a.merkle:
            return {"bad_snapshots": s.verify_merkle()}
        if a.complete:
            return delta.missing_and_extra(tree(spark, a.complete), s.members().filter("frame <> -1"))
        counts = {r.status: r.n for r in s.verify(sample=a.sample).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        return counts | {"truncated_frames": s.truncated().count()}
    if a.verb == "stats":
        return members.ratio_histogram(s.located())
    if a.verb == "snapshots":
        return s.snapshots()
    if a.verb == "gc":
        return {"kept": s.gc(**{k: getattr(a, k) for k in ("last", "daily", "weekly", "monthly", "yearly")})}
    if a.verb == "push":
        return {"sent": s.push(a.url)}
    if a.verb == "pull":
        return {"sent": st.Store(spark, a.url).push(a.store)}
    if a.verb == "serve":
        from stowage.serve import Browser, server

        server(Browser(spark, a.store), a.port).serve_forever()
    return {"cp": lambda: actions.cp(spark, a.src, a.dest), "sync": lambda: actions.sync(spark, a.src, a.dest), "rm": lambda: actions.rm(spark, a.root)}[a.verb]()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.python.filterPushdown.enabled", "true").getOrCreate()
    out = run(spark, a)
    if isinstance(out, dict):
        print(json.dumps(out, default=str))
        return int(bool(out.get("errors") or out.get("bad_snapshots") or out.get("mismatched") or out.get("lost") or out.get("truncated_frames")))
    for row in out.toLocalIterator():
        print(json.dumps(row.asDict(), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
