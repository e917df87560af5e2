"""Exact duplicates by distributed most-significant-digit radix partitioning.

Two texts are equal when they are identical after deleting the six white-space characters. The digits are
runs of bytes of that normalised text. The first digit is its byte length with its first bytes; every
further level splits the groups that are left by the next, four times longer run of bytes. A group leaves
the recursion when it holds a single row, or when its text has ended: all rows of a group have the same
length, so they end together. No digest decides anything; ``text_sha256`` is only a column of the result.

Each level is one aggregation by (group, digit), which adds up copies before the shuffle, and one join of
the groups that are left back to the rows. The groups are a written table: while they are small (rows
times the digit's width, checked) they are broadcast, so a hot group's rows don't move at all; beyond,
both sides are shuffled for the join alone, and Spark's adaptive skew join splits a hot group. Rows that
leave carry no text further. Levels are written tables in the shared scratch folder.

Defined cases: null and empty texts are equal (nothing is left of them), and so are texts of white space
only. Of equal texts the row with the most code points in the original stays, then the smallest doc_id
(null last); of rows equal in both, one stays. A text of any length is compared to its end. Columns
besides ``doc_id`` and ``text`` are not touched. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import SPACES, Scratch, broadcast_if_small, column, rows_of, sum_of, table

FIRST_DIGIT = 32
GROWTH = 4


def _digit(start: int, width: int):
    return F.substring("rest", start + 1, width)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (and ``carry``). The result reads ``scratch``."""
    carry, s = carry or [], scratch or Scratch(docs.sparkSession, "exact")
    plain = F.coalesce(column(text), F.lit(""))
    whole = F.translate(plain, SPACES, "").cast("binary")
    head = docs.select(whole.alias("rest")).select(F.octet_length("rest").alias("size"), _digit(0, FIRST_DIGIT).alias("head"))
    shared = s.keep(head.groupBy("size", "head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("size", "head"), "heads")
    shared_n = rows_of(shared)
    near = broadcast_if_small(shared.select("size", "head", F.lit(True).alias("shared")), shared_n, 128)

    rows = docs.select(column(doc_id).alias("doc_id"), *[column(c).alias(f"c_{c}") for c in carry], F.length(plain).alias("points"), whole.alias("rest"))
    rows = rows.select("*", F.octet_length("rest").alias("size"), _digit(0, FIRST_DIGIT).alias("head"), F.sha2("rest", 256).alias("text_sha256"))
    rows = rows.join(near, ["size", "head"], "left").withColumn("rest", F.when(F.col("shared"), F.col("rest")))
    rows = s.keep(rows.withColumn("head", F.when(F.col("shared"), F.col("head"))).withColumn("uid", F.monotonically_increasing_id()), "rows")

    live = rows.filter("shared").select("uid", "doc_id", "points", "size", "head", "rest")
    first = s.keep(live.groupBy("size", "head").agg(F.min("uid").alias("gid")), "first")
    live = live.join(broadcast_if_small(first, shared_n, 160), ["size", "head"]).select("uid", "doc_id", "points", "size", "gid", F.expr(f"substring(rest, {FIRST_DIGIT} + 1)").alias("rest"))
    start, width, ended = FIRST_DIGIT, FIRST_DIGIT * GROWTH, []
    while shared_n:
        live = s.keep(live, "live", going=(F.col("size") > start).cast("int"))
        done = live.filter(F.col("size") <= start).select("uid", "doc_id", "points", "gid")
        ended.append(done)
        going = live.filter(F.col("size") > start)
        if not sum_of(live, "going"):
            break
        keyed = going.withColumn("digit", _digit(0, width))
        splits = keyed.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("next")).filter("n > 1")
        splits = s.keep(splits.select("gid", "digit", "next"), "splits")
        live = keyed.join(broadcast_if_small(splits, rows_of(splits), 96 + width), ["gid", "digit"])
        live = live.select("uid", "doc_id", "points", "size", F.col("next").alias("gid"), F.expr(f"substring(rest, {width} + 1)").alias("rest"))
        start, width = start + width, width * GROWTH
    names = [F.col(f"c_{c}").alias(c) for c in carry]
    alone = rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "uid", *[f"c_{c}" for c in carry])
    if not shared_n:
        return alone.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", *names)
    members = ended[0]
    for x in ended[1:]:
        members = members.unionByName(x)
    best = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("uid").alias("u"))
    groups = members.groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("b")).filter("n > 1")
    groups = s.keep(groups.select("gid", "n", F.col("b.d").alias("keep"), F.col("b.u").alias("first")), "groups")
    told = members.select("uid", "gid").join(broadcast_if_small(groups, rows_of(groups), 96), "gid").select("uid", "n", "keep", "first")
    told = s.keep(told, "told")
    s.drop_but(rows, told)
    alone = alone.join(broadcast_if_small(told, rows_of(told), 64), "uid", "left")
    in_group = F.col("n").isNotNull()
    return alone.select(
        "doc_id",
        F.when(in_group, F.col("keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", "group_size").alias("group_size"),
        F.coalesce(F.col("first") == F.col("uid"), F.lit(True)).alias("kept"),
        "text_sha256",
        *names,
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The rows that stay, with the columns of ``docs``. The result reads ``scratch``."""
    whole = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column(doc_id).alias("id"), column(text).alias("text"))
    kept = classes(whole, "id", "text", ["row"], scratch).filter("kept")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op9: one row per row of ``documents``."""
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER k AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    row_number() OVER k = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW k AS (PARTITION BY t ORDER BY points DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
