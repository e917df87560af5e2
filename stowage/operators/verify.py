"""Checks of stored members against what the index says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(told: DataFrame, by: list[str], least_share: int = 1) -> DataFrame:
    """members, checked, undigested, mismatched, truncated of rows (size, digest, found, declared).

    ``digest`` -1: none was stored. A frame whose declared length is below the sum of its members (over
    ``least_share``) is truncated.
    """
    has = F.col("digest") != -1
    return told.groupBy(*by).agg(
        F.count(F.lit(1)).alias("members"),
        F.count(F.when(has, 1)).alias("checked"),
        F.count(F.when(~has, 1)).alias("undigested"),
        F.count(F.when(has & (F.col("digest") != F.col("found")), 1)).alias("mismatched"),
        (F.min("declared") < F.floor(F.sum("size") / least_share)).alias("truncated"),
    )
