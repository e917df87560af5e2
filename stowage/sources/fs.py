"""A mounted file tree as a table of stats.

``spark.read.format("fs_stat").load(root)``; register with ``register(spark)``. Options: ``mode`` (``stat`` or
``names``, which doesn't stat), ``ignore`` (rules, one a line), ``split_depth`` (how deep the driver lists to
make partitions, 1 by default). Each partition walks its subtrees and yields Arrow batches; nothing is
gathered. Rows: regular files, links and directories; sockets, pipes and devices are left out. What can't be
read keeps a row with its error number.

A predicate ``is_dir = false`` (or true) is taken over by the source, so those rows are never made.
"""

from __future__ import annotations

import fnmatch
import os
import re
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

SCHEMA = "path string, link string, size long, blocks long, mtime_ns long, atime_ns long, ctime_ns long, ino long, parent_ino long, dev long, mode int, uid int, gid int, nlink int, depth int, is_dir boolean, is_link boolean, err int"
ARROW = pa.schema(
    [("path", pa.string()), ("link", pa.string()), *[(n, pa.int64()) for n in ("size", "blocks", "mtime_ns", "atime_ns", "ctime_ns", "ino", "parent_ino", "dev")], *[(n, pa.int32()) for n in ("mode", "uid", "gid", "nlink", "depth")], ("is_dir", pa.bool_()), ("is_link", pa.bool_()), ("err", pa.int32())]
)
BATCH = 10_000


class Ignore:
    """The rules of an ignore file on relative paths: the last rule that fits decides; what is below an ignored directory isn't looked at."""

    def __init__(self, lines: list[str]):
        self.rules = []
        for line in (x.rstrip() for x in lines):
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.removeprefix("!")
            dirs, line = line.endswith("/"), line.rstrip("/")
            anchored, line = "/" in line, line.lstrip("/").replace("**", "*")
            body = re.compile(fnmatch.translate(line if anchored else "*/" + line))
            self.rules.append((body, anchored, keep, dirs))

    def __call__(self, path: str, is_dir: bool) -> bool:
        out = False
        for body, anchored, keep, dirs in self.rules:
            if (is_dir or not dirs) and body.match(path if anchored else "/" + path):
                out = not keep
        return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def entry(root: str, path: str, depth: int, parent: int, names: bool, kind: os.DirEntry | None) -> dict | None:
    """The row of one path, or None for what is no file, link or directory."""
    full = os.path.join(root, path) if path else root
    row = dict.fromkeys(ARROW.names, 0) | {"path": path, "link": "", "depth": depth, "parent_ino": parent, "is_dir": False, "is_link": False}
    if names and kind is not None:
        row["is_dir"], row["is_link"] = kind.is_dir(follow_symlinks=False), kind.is_symlink()
        return row if row["is_dir"] or row["is_link"] or kind.is_file(follow_symlinks=False) else None
    try:
        s = os.lstat(full)
    except OSError as e:
        return row | {"err": e.errno or 5}
    if not (stat.S_ISREG(s.st_mode) or stat.S_ISDIR(s.st_mode) or stat.S_ISLNK(s.st_mode)):
        return None
    row |= {"size": s.st_size, "blocks": s.st_blocks, "mtime_ns": s.st_mtime_ns, "atime_ns": s.st_atime_ns, "ctime_ns": s.st_ctime_ns, "ino": _signed(s.st_ino), "dev": _signed(s.st_dev), "mode": s.st_mode & 0o7777, "uid": s.st_uid, "gid": s.st_gid, "nlink": s.st_nlink, "is_dir": stat.S_ISDIR(s.st_mode), "is_link": stat.S_ISLNK(s.st_mode)}
    if row["is_link"]:
        row["link"] = os.readlink(full)
    return row


def walk(root: str, top: str, deep: bool, ignore: Ignore, names: bool, depth: int = 0, parent: int = 0) -> Iterator[dict]:
    """Rows of ``top`` and (if ``deep``) all below it."""
    todo = [(top, depth, parent, None)]
    while todo:
        path, level, above, kind = todo.pop()
        row = entry(root, path, level, above, names, kind)
        if row is None:
            continue
        if row["is_dir"] and (deep or path == top):
            try:
                with os.scandir(os.path.join(root, path) if path else root) as it:
                    below = [(f"{path}/{e.name}" if path else e.name, level + 1, row["ino"], e) for e in it]
                if deep:
                    todo += [x for x in below if not ignore(x[0], x[3].is_dir(follow_symlinks=False))]
            except OSError as e:
                row["err"] = e.errno or 5
        yield row


class Part(InputPartition):
    def __init__(self, top: str, deep: bool, depth: int, parent: int):
        self.top, self.deep, self.depth, self.parent = top, deep, depth, parent


class FsReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.names = options.get("mode", "stat") == "names"
        self.lines = options.get("ignore", "").split("\n")
        self.split = int(options.get("split_depth", "1"))
        self.only_dirs: bool | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and tuple(f.attribute) == ("is_dir",) and self.only_dirs is None:
                self.only_dirs = bool(f.value)
            else:
                yield f

    def partitions(self):
        """One for each directory down to ``split_depth`` by itself, and one for each subtree or file below."""
        ignore, out, level = Ignore(self.lines), [], [("", 0, 0)]
        for depth in range(self.split):
            following = []
            for path, _, parent in level:
                out.append(Part(path, False, depth, parent))
                full = os.path.join(self.root, path) if path else self.root
                try:
                    ino = _signed(os.lstat(full).st_ino)
                    with os.scandir(full) as it:
                        entries = sorted(it, key=lambda e: e.name)
                except OSError:
                    continue
                for e in entries:
                    p = f"{path}/{e.name}" if path else e.name
                    if ignore(p, e.is_dir(follow_symlinks=False)):
                        continue
                    if e.is_dir(follow_symlinks=False):
                        following.append((p, depth + 1, ino))
                    else:
                        out.append(Part(p, True, depth + 1, ino))
            level = following
        return out + [Part(p, True, d, ino) for p, d, ino in level] or [Part("", True, 0, 0)]

    def read(self, part: Part):
        ignore, rows = Ignore(self.lines), []
        for row in walk(self.root, part.top, part.deep, ignore, self.names, part.depth, part.parent):
            if self.only_dirs is not None and row["is_dir"] != self.only_dirs:
                continue
            rows.append(row)
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class FsStat(DataSource):
    @classmethod
    def name(cls):
        return "fs_stat"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FsReader(self.options)


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, names: bool = False, split_depth: int = 1) -> DataFrame:
    """The table of a tree, with ``.stowageignore`` of its root and further rules applied."""
    lines = list(ignore or [])
    try:
        with open(os.path.join(root, ".stowageignore")) as f:
            lines = f.read().split("\n") + lines
    except OSError:
        pass
    spark.dataSource.register(FsStat)
    return spark.read.format("fs_stat").option("mode", "names" if names else "stat").option("ignore", "\n".join(lines)).option("split_depth", split_depth).load(root)


def with_links(scanned: DataFrame) -> DataFrame:
    """A scan with kind ('file', 'dir', 'symlink', 'hardlink') and link; the smallest path of an inode is the file."""
    from stowage.operators.members import hardlinks

    plain = scanned.filter("is_dir OR is_link").withColumn("kind", F.when(F.col("is_dir"), "dir").otherwise("symlink"))
    files = hardlinks(scanned.filter("NOT is_dir AND NOT is_link").drop("link"))
    return plain.unionByName(files.withColumnRenamed("link_kind", "kind"))


def with_totals(scanned: DataFrame) -> DataFrame:
    """Directories of a scan with child_count and dir_total_size of their direct children."""
    inside = scanned.filter("depth > 0").groupBy(F.col("parent_ino").alias("ino"), F.col("dev")).agg(F.count(F.lit(1)).alias("child_count"), F.sum(F.when(~F.col("is_dir"), F.col("size"))).alias("t"))
    return scanned.filter("is_dir").join(inside, ["ino", "dev"], "left").withColumn("child_count", F.coalesce("child_count", F.lit(0))).withColumn("dir_total_size", F.coalesce("t", F.lit(0))).drop("t")
