"""K-d tree partitioning of documents into shards of near-equal bytes, in DataFrame expressions only.

Every document has four metadata coordinates: language, source, logarithm of its size, and doc_id, each
scaled to 24 bits. A node that is to hold k leaves is cut across its widest dimension at the weighted
quantile that gives k div 2 leaves to one side and the rest to the other, so leaves reach the target
bytes together. Equal coordinates are told apart by a hash of id and text, so a hot source, a frequent
length or a group of copies is cut like anything else.

Quantiles are exact and distributed: the 62-bit keys of all nodes of a level are counted together by
their next 12 bits, the bin that holds the quantile is refined, until it holds one row or no bits are
left. Only the bins on the cuts (one per node) come to the driver. The finished tree is one CASE
expression over the coordinates, so documents are not shuffled while it is built.

Law: ``bytes``. Defined cases: a null text has no bytes (size 8, checksum 0), null ids, languages and
sources stand first. Very long texts count by their size. Rows that repeat in all columns are split by
their place in the table. Fewer rows than shards leave shards empty. Other columns are not touched. An
empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.llm.common import Scratch, bucket_count, ranked, table

SHARDS = 24
OVERHEAD = 8
DIMENSIONS = ("lang", "source", "length", "id")
COORDINATE_BITS, TAIL_BITS, DIGIT_BITS = 24, 38, 12
KEY_BITS = COORDINATE_BITS + TAIL_BITS


@dataclass
class Node:
    leaves: int
    first_leaf: int
    dimension: str = ""
    cut: int = 0
    low: Node | None = None
    high: Node | None = None


def coordinates(docs: DataFrame, scratch: Scratch, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    """doc_id, size, text_crc32, the four coordinates and the tail of the key; a written table."""
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(plain) + OVERHEAD).cast("long").alias("size"), F.crc32(plain).alias("text_crc32"), F.col(lang).cast("string").alias("l"), F.col(source).cast("string").alias("s"))
    rows = scratch.keep(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    lo_hi = rows.agg(F.min("doc_id").cast("double").alias("i0"), F.max("doc_id").cast("double").alias("i1"), F.log(F.min("size").cast("double")).alias("s0"), F.log(F.max("size").cast("double")).alias("s1")).first()
    most = (1 << COORDINATE_BITS) - 1

    def scaled(x: Column, lo: float | None, hi: float | None) -> Column:
        if lo is None or hi is None or hi <= lo:
            return F.lit(0).cast("long")
        return F.greatest(F.lit(0), F.least(F.lit(most), F.coalesce(F.floor((x - lo) / (hi - lo) * most), F.lit(0)))).cast("long")

    code = lambda c: F.shiftright(F.crc32(F.coalesce(F.col(c), F.lit(""))), 32 - COORDINATE_BITS)
    tail = F.shiftleft(F.shiftright(F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string"))), 8), 14).bitwiseOR(F.pmod(F.xxhash64("uid"), F.lit(1 << 14)))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        code("l").alias("lang"),
        code("s").alias("source"),
        scaled(F.log(F.col("size").cast("double")), lo_hi.s0, lo_hi.s1).alias("length"),
        scaled(F.col("doc_id").cast("double"), lo_hi.i0, lo_hi.i1).alias("id"),
        tail.cast("long").alias("tail"),
    )


def _key(dimension: str) -> Column:
    return F.shiftleft(F.col(dimension), TAIL_BITS).bitwiseOR(F.col("tail"))


def place(node: Node, of_leaf) -> Column:
    """The tree as an expression: ``of_leaf`` of the leaf (or unfinished node) that a row falls into."""
    if node.low is None:
        return of_leaf(node)
    return F.when(_key(node.dimension) < F.lit(node.cut), place(node.low, of_leaf)).otherwise(place(node.high, of_leaf))


def _cuts(rows: DataFrame, nodes: dict[int, tuple[str, float]]) -> dict[int, int]:
    """The key of each node at which the weight below is nearest to its aim.

    ``nodes``: number to (dimension, aimed weight); ``rows`` has node, size and the coordinates.
    """
    fixed = {i: (0, 0, aim) for i, (_, aim) in nodes.items()}  # bits fixed so far, their value, weight still to go
    cuts: dict[int, int] = {}
    keyed = rows.withColumn("key", F.coalesce(*[F.when(F.col("node") == i, _key(d)) for i, (d, _) in nodes.items()]))
    for done in range(0, KEY_BITS, DIGIT_BITS):
        if not fixed:
            break
        width = min(DIGIT_BITS, KEY_BITS - done)
        inside = F.lit(False)
        for i, (_, value, _) in fixed.items():
            inside = inside | ((F.col("node") == i) & (F.shiftright("key", KEY_BITS - done) == value) if done else (F.col("node") == i))
        digit = F.shiftright("key", KEY_BITS - done - width).bitwiseAND((1 << width) - 1)
        bins = keyed.filter(inside).groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("node").orderBy("digit")
        aim = F.coalesce(*[F.when(F.col("node") == i, F.lit(float(x[2]))) for i, x in fixed.items()])
        bins = bins.withColumn("upto", F.sum("w").over(upto)).withColumn("last", F.lead("digit").over(upto).isNull())
        on_cut = bins.filter(((F.col("upto") >= aim) & (F.col("upto") - F.col("w") < aim)) | (F.col("last") & (F.col("upto") < aim))).collect()  # a row per node
        following = {}
        for r in on_cut:
            _, value, togo = fixed[r.node]
            value = (value << width) | r.digit
            left = KEY_BITS - done - width
            below = togo - (r.upto - r.w)
            if r.n == 1 or left == 0:
                cuts[r.node] = (value + (below > r.w / 2)) << left
            else:
                following[r.node] = (done + width, value, below)
        fixed = following
    return cuts


def grow(rows: DataFrame, leaves: int) -> Node:
    """The tree over all rows, level by level; per level some aggregations of one row or bin per node."""
    root = Node(leaves, 0)
    level = [root] if leaves > 1 else []
    while level:
        number = {id(n): i for i, n in enumerate(level)}
        held = rows.withColumn("node", place(root, lambda n: F.lit(number.get(id(n), -1)))).filter("node >= 0")
        spans = held.groupBy("node").agg(F.sum("size").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).collect()
        spans = {r.node: r for r in spans}
        aims = {}
        for i, n in enumerate(level):
            if r := spans.get(i):
                n.dimension = max(DIMENSIONS, key=lambda d: r[d])
                aims[i] = (n.dimension, r.w * (n.leaves // 2) / n.leaves)
        cuts = _cuts(held, aims) if aims else {}
        following = []
        for i, n in enumerate(level):
            n.dimension, n.cut = n.dimension or DIMENSIONS[0], cuts.get(i, 0)
            n.low = Node(n.leaves // 2, n.first_leaf)
            n.high = Node(n.leaves - n.leaves // 2, n.first_leaf + n.leaves // 2)
            following += [x for x in (n.low, n.high) if x.leaves > 1]
        level = following
    return root


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``shards`` leaves, or as many as give leaves of about ``target_bytes``.
    """
    s = Scratch(docs.sparkSession, "kdtree")
    rows = s.keep(coordinates(docs, s, doc_id, text, lang, source), "coordinates")
    total = rows.agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).first()
    if shards is None:
        shards = max(1, round((total.w or 0) / (target_bytes or 1)))
    tree = grow(rows, shards)
    put = rows.withColumn("shard", place(tree, lambda n: F.lit(n.first_leaf)).cast("int"))
    put = put.select("doc_id", "size", "text_crc32", "shard", "tail")
    put = ranked(put, ["shard"], [F.col("tail"), F.col("doc_id"), F.col("text_crc32")], bucket_count(total.n // shards), s, "slot")
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: all ``documents`` in 24 shards."""
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), SHARDS)
