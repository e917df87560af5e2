"""Paths and sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 512
LONGEST_NAME = 100


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """All but the last part; empty at the top."""
    return F.when(F.instr(path, "/") > 0, F.substring(path, F.lit(1), F.length(path) - F.length(basename(path)) - 1)).otherwise("")


def extension(path: Column) -> Column:
    """Small letters behind the last dot of the name; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def head(path: Column, n: int) -> Column:
    """The first ``n`` parts."""
    return F.substring_index(path, "/", n)


def depth(path: Column) -> Column:
    return (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("int")


def padded(size: Column, to: int = BLOCK) -> Column:
    """Up to the next multiple."""
    return (size + (to - 1) - F.pmod(size + (to - 1), F.lit(to))).cast("long")


def header_length(path: Column, link: Column) -> Column:
    """Bytes of a tar header: one block, and a long-name record for each of path and link that needs it."""
    long_name = lambda x: F.when(F.octet_length(x) > LONGEST_NAME, BLOCK + padded((F.octet_length(x) + 1).cast("long"))).otherwise(0)
    return (BLOCK + long_name(path) + long_name(link)).cast("long")
