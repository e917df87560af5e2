"""Mixing sources to target weights by a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight schedule, a line from its weight at time 0 to its
weight at time 1; integrated and scaled to the source's target, that is the source's cumulative token
demand ``D(t)``. The documents of a source stand in an order by a hash (MD5) of their ids, as often as the target is larger
than the source, so the words ahead of a copy of a document are known; inverting ``D`` at them gives the
copy's training position, and the corpus is range-sorted by position.

Targets share all words of the corpus by weight (sources in order of code points, null last, weigh 1, 2,
3, 1, 2, 3, ...); a target stops at three times its source's size, and the excess is shared again by weight.

The words ahead of a document come from hash buckets: a window inside one bucket of one source, plus the
total of the buckets before; so a source with a third of all rows is spread over many tasks.

A source is read as many whole times as its target allows. Of the rest, each class of sizes (over a
quarter of the rest, over a 16th, over a 64th, all others) gives its share, from the front of the order by
hash; what a class of large documents took too much or too little of, the next one makes up for. So the
words that are taken come as near to the target as the smallest documents allow, and no size is favoured.
Extra copies are spread over the rest of the demand in the same order.

Defined cases: a null or empty text has no words and is never taken; its position is null. A null source
is a source of its own. Rows that repeat count each. Ties in the order are rows that are equal in all
that matters. The largest multiple of a document is its source's bound of three, as ``taken`` shows.
An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.llm.common import Scratch, broadcast_if_small, bucket_count, column, ranked, rows_of, sum_of, table, word_count

MOST_EPOCHS = 3
#: Slope of the schedule by the source's weight: heavier sources are shown more towards the end.
SLOPES = {1: -0.6, 2: 0.0, 3: 0.6}


def targets(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """source, source_size, weight, target, from one row per source (source, source_size).

    All targets that would pass their bound are set to it, and the rest shares what is left by weight,
    until none passes. The sources are a small table of totals; only one number per round is read.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    t = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    t = scratch.keep(t.withColumn("bound", (F.col("source_size") * MOST_EPOCHS).cast("double")), "sources", size=F.col("source_size"))
    total, capped = sum_of(t, "size"), -1
    share = 0.0
    while True:
        held = F.col("bound") <= F.col("weight") * F.lit(share)
        got = t.agg(F.coalesce(F.sum(F.when(held, F.col("bound"))), F.lit(0.0)).alias("b"), F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0.0)).alias("w"), F.count(F.when(held, 1)).alias("n")).first()
        if got.n == capped or not got.w:
            break
        capped, share = got.n, (total - got.b) / got.w
    return t.select("source", "source_size", "weight", F.least("bound", F.col("weight") * F.lit(share)).alias("target"))


def _position(ahead: Column, target: Column, slope: Column) -> Column:
    """The time t with D(t) = ahead, where D(t) = target * (t * (1 - slope) + slope * t * t)."""
    x = F.least(F.lit(1.0), F.try_divide(ahead, target))
    b = 1 - slope
    root = F.try_divide(F.sqrt(b * b + 4 * slope * x) - b, 2 * slope)
    return F.when(slope == 0, x).otherwise(root)


#: Size classes: a document is of the first class whose share of the rest it exceeds.
CLASSES = (4, 16, 64)


def _mixed(s: Scratch, docs: DataFrame, doc_id: str, text: str, source: str, keep: list[str]) -> DataFrame:
    """``keep`` (or doc_id) and size, source_size, target, taken, copies, positions of every row.

    The totals of sources, buckets and classes come from a narrow written table. With nothing to keep, so
    do the rows; else the rows are read again and go through one window with what is to be kept.
    """
    turn = F.md5(F.coalesce(column(doc_id).cast("string"), F.lit("")))
    spread = F.conv(F.substring("turn", 1, 8), 16, 10).cast("long")
    wide = docs.select(*[column(c).alias(f"k_{c}") for c in keep], column(doc_id).alias("doc_id"), column(source).cast("string").alias("source"), word_count(column(text)).alias("size"), turn.alias("turn"), F.xxhash64(column(text)).alias("h"))
    narrow = s.keep(wide.select("doc_id", "source", "size", "turn", "h"), "narrow")
    n = rows_of(narrow)
    plan = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), s)
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = s.keep(plan.withColumnRenamed("source", "of"), "targets")
    n_sources = rows_of(plan)
    same = F.col("source").eqNullSafe(F.col("of"))

    def classed(rows: DataFrame, plan: DataFrame) -> DataFrame:
        kind = F.lit(len(CLASSES))
        for i, k in reversed(list(enumerate(CLASSES))):
            kind = F.when(F.col("size") * k > F.col("rest"), i).otherwise(kind)
        rows = rows.join(broadcast_if_small(plan, n_sources, 256), same, "left").drop("of").withColumn("class", kind)
        of_class = {f"c{i}": F.when(F.col("class") == i, F.col("size")).otherwise(0) for i in range(len(CLASSES) + 1)}
        rows = ranked(rows, ["source"], [F.col("turn"), F.col("doc_id"), F.col("h")], bucket_count(n), s, "rank", {"ahead": F.col("size"), **of_class}, spread, counts_of)
        return rows.withColumn("class_ahead", F.coalesce(*[F.when(F.col("class") == i, F.col(f"c{i}")) for i in range(len(CLASSES) + 1)])).drop(*of_class)

    counts_of = None
    placed = s.keep(classed(narrow, plan), "placed")
    by_class = placed.groupBy(F.col("source").alias("of")).agg(*[F.sum(F.when(F.col("class") == i, F.col("size")).otherwise(0)).alias(f"w{i}") for i in range(len(CLASSES) + 1)])
    plan = s.keep(plan.join(by_class.withColumnRenamed("of", "of2"), F.col("of").eqNullSafe(F.col("of2")), "left").drop("of2"), "classes")
    # what each class is to give: its share of the rest, and what the classes before it left open
    given, share = F.lit(0).cast("long"), F.coalesce(F.try_divide(F.col("rest"), F.col("source_size")), F.lit(0.0))
    upto = F.lit(0).cast("long")
    for i in range(len(CLASSES) + 1):
        upto = upto + F.col(f"w{i}")
        aim = F.col("rest") - given if i == len(CLASSES) else upto * share - given
        plan = plan.withColumn(f"aim{i}", aim.cast("double"))
        got = placed.filter(F.col("class") == i).join(broadcast_if_small(plan.select("of", f"aim{i}"), n_sources, 128), same)
        got = got.filter(F.col("class_ahead") + F.col("size") / 2 <= F.col(f"aim{i}")).groupBy(F.col("of").alias("of2")).agg(F.sum("size").alias(f"got{i}"))
        plan = s.keep(plan.join(got, F.col("of").eqNullSafe(F.col("of2")), "left").drop("of2").fillna({f"got{i}": 0}), "classes")
        given = given + F.col(f"got{i}")
    if keep:
        counts_of = placed.drop("ahead", "rank", "class_ahead")
        placed = classed(wide, plan)
    else:
        placed = placed.select("source", "doc_id", "size", "turn", "h", "class", "ahead", "class_ahead").join(broadcast_if_small(plan, n_sources, 256), same, "left").drop("of")
    aim = F.coalesce(*[F.when(F.col("class") == i, F.col(f"aim{i}")) for i in range(len(CLASSES) + 1)])
    extra = (F.col("epochs") < MOST_EPOCHS) & (F.col("class_ahead") + F.col("size") / 2 <= aim)
    placed = placed.withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + extra.cast("long")).otherwise(0).cast("int"))
    slope = F.create_map(*[x for k, v in SLOPES.items() for x in (F.lit(float(k)), F.lit(v))])[F.col("weight")]
    start = lambda e: F.when(e < F.col("epochs"), e * F.col("source_size") + F.col("ahead")).otherwise(F.col("epochs") * F.col("source_size") + F.col("ahead") * F.try_divide(F.col("rest"), F.col("source_size")))
    starts = F.transform(F.filter(F.sequence(F.lit(0), F.lit(MOST_EPOCHS - 1)), lambda e: e < F.col("copies")), lambda e: _position(start(e), F.col("target"), slope))
    return placed.select(*([F.col(f"k_{c}").alias(c) for c in keep] or ["doc_id"]), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", starts.alias("positions"))


def curriculum(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies, and the positions of its copies."""
    return _mixed(scratch or Scratch(docs.sparkSession, "mixing"), docs, doc_id, text, source, [])


def training_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """The corpus as it is to be read: each taken copy is a row with the columns of ``docs``, range-sorted by position. The result reads ``scratch``."""
    whole = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column(doc_id).alias("id"), column(text).alias("text"), column(source).alias("source"))
    copies = _mixed(scratch or Scratch(docs.sparkSession, "mixing"), whole, "id", "text", "source", ["row"]).select("row", F.explode("positions").alias("at"))
    return copies.repartitionByRange("at").sortWithinPartitions("at").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op4: one row per row of ``documents`` with what the mix takes of it, range-sorted by first position."""
    mixed = curriculum(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    mixed = mixed.withColumn("position", F.get("positions", F.lit(0))).drop("positions")
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position")


def _sql_classes() -> str:
    """One table per size class: what it is to give, and gives, after those before it."""
    n = len(CLASSES)
    out = [f"b AS (SELECT source, any_value(source_size) AS source_size, any_value(rest) AS rest, {', '.join(f'coalesce(sum(size) FILTER (class = {i}), 0) AS w{i}' for i in range(n + 1))} FROM q GROUP BY source)"]
    for i in range(n + 1):
        given = " + ".join(["0", *[f"got{j}" for j in range(i)]])
        share = "CASE WHEN source_size > 0 THEN rest / source_size ELSE 0.0 END"
        aim = f"rest - ({given})" if i == n else f"({' + '.join(f'w{j}' for j in range(i + 1))}) * ({share}) - ({given})"
        out.append(f"m{i} AS (SELECT *, CAST({aim} AS DOUBLE) AS aim{i} FROM {f'a{i - 1}' if i else 'b'})")
        out.append(f"a{i} AS (SELECT m.*, coalesce(g.got, 0) AS got{i} FROM m{i} m LEFT JOIN (SELECT q.source, sum(q.size) AS got FROM q JOIN m{i} y ON q.source IS NOT DISTINCT FROM y.source WHERE q.class = {i} AND q.class_ahead + q.size / 2 <= y.aim{i} GROUP BY q.source) g ON m.source IS NOT DISTINCT FROM g.source)")
    return ",\n".join(out) + ","


ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS turn FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight FROM s),
-- sources in the order in which they reach their bound; the share per weight once those before are held
r AS (SELECT *, {MOST_EPOCHS} * source_size AS bound, row_number() OVER o AS k, coalesce(sum({MOST_EPOCHS} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open, sum(source_size) OVER () AS total
    FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
h AS (SELECT CAST(total - held AS DOUBLE) / CAST(open AS DOUBLE) AS share FROM r WHERE bound >= weight * (CAST(total - held AS DOUBLE) / CAST(open AS DOUBLE)) ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CAST(weight AS INT) AS weight, least(CAST(bound AS DOUBLE), weight * (SELECT share FROM h)) AS target FROM w JOIN (SELECT source AS s2, bound FROM r) ON source IS NOT DISTINCT FROM s2),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
x AS (SELECT *, target - epochs * source_size AS rest FROM e),
p AS (SELECT d.doc_id, d.size, d.turn, d.source, x.source_size, x.target, x.weight, x.epochs, x.rest,
    CASE {' '.join(f'WHEN d.size * {k} > x.rest THEN {i}' for i, k in enumerate(CLASSES))} ELSE {len(CLASSES)} END AS class,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY turn, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
    FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source),
q AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source, class ORDER BY turn, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS class_ahead FROM p),
{_sql_classes()}
c AS (SELECT q.*, CAST(CASE WHEN size > 0 THEN q.epochs + CASE WHEN q.epochs < {MOST_EPOCHS} AND class_ahead + size / 2 <= CASE class {' '.join(f'WHEN {i} THEN aim{i}' for i in range(len(CLASSES) + 1))} END THEN 1 ELSE 0 END ELSE 0 END AS INT) AS copies,
    CASE weight {' '.join(f'WHEN {k} THEN {v}' for k, v in SLOPES.items())} END AS slope,
    least(1.0, (CASE WHEN q.epochs > 0 THEN CAST(ahead AS DOUBLE) ELSE ahead * (q.rest / q.source_size) END) / q.target) AS x FROM q JOIN a{len(CLASSES)} z ON q.source IS NOT DISTINCT FROM z.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies,
    CASE WHEN copies = 0 THEN NULL WHEN slope = 0 THEN x
        ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * x) - (1 - slope)) / (2 * slope) END AS position
FROM c
""".replace("\\\\", "\\")
