"""Globs, member filters and ignore rules as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.functions.paths import basename

SPECIAL = set(r"\.^$+{}[]()|")


def glob_regex(glob: str) -> str:
    """Anchored; ``*`` is any run (also over ``/``), ``?`` one character, all else itself."""
    return "^" + "".join("[^\\n]*" if c == "*" else "[^\\n]" if c == "?" else "\\" + c if c in SPECIAL else c for c in glob) + "\\z"


def glob_any(path: Column, globs: list[str] | None) -> Column:
    """Whether a path fits one of the globs; without globs, every path does."""
    if globs is None:
        return F.lit(True)
    return F.regexp_like(path, F.lit("|".join(f"({glob_regex(g)})" for g in globs))) if globs else F.lit(False)


def member_filter(path: Column, size: Column, include: list[str] | None = None, exclude: list[str] | None = None, min_size: int = 0) -> Column:
    kept = glob_any(path, include)
    if exclude:
        kept = kept & ~glob_any(path, exclude)
    return kept & (size >= min_size) if min_size else kept


def find(path: Column, size: Column, mtime_ns: Column, name: str | None = None, min_size: int | None = None, max_size: int | None = None, newer_than_ns: int | None = None) -> Column:
    """By name of the last part, inclusive sizes, and strictly newer times."""
    kept = F.lit(True) if name is None else glob_any(basename(path), [name])
    if min_size is not None:
        kept = kept & (size >= min_size)
    if max_size is not None:
        kept = kept & (size <= max_size)
    if newer_than_ns is not None:
        kept = kept & (mtime_ns > newer_than_ns)
    return kept


@dataclass(frozen=True)
class IgnoreRule:
    regex: str
    keep: bool
    dirs_only: bool


def ignore_rules(lines: list[str]) -> list[IgnoreRule]:
    """Rules of an ignore file: comments, ``!`` keeps, a closing ``/`` is for directories, an opening or inner one anchors."""
    out = []
    for line in lines:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.removeprefix("!")
        dirs, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.lstrip("/")
        body = glob_regex(line.replace("**", "*"))
        out.append(IgnoreRule(body if anchored else "^(?:[^\\n]*/)?" + body[1:], keep, dirs))
    return out


def ignored(path: str | Column, is_dir: Column, rules: list[IgnoreRule]) -> Column:
    """Whether the last rule that fits a path itself ignores it (true, false)."""
    path = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for r in rules:
        fits = F.regexp_like(path, F.lit(r.regex))
        out = F.when(fits & is_dir if r.dirs_only else fits, F.lit(not r.keep)).otherwise(out)
    return out


def ignored_below(path: Column, rules: list[IgnoreRule]) -> Column:
    """Whether a file's path or any directory above it is ignored; a rule can't bring back what is below one."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("p"), (k < F.size(parts)).alias("d")))
    return F.exists(above, lambda x: ignored(x["p"], x["d"], rules))
