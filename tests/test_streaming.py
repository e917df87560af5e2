"""Streams give what batches give."""

from collections import Counter

from pyspark.sql import functions as F

from compare import SMALL
from stowage.operators import delta
from stowage.plans import fixtures as fx
from stowage.streaming import flows


def run(query, name):
    query.processAllAvailable()
    query.stop()


def test_diff_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    a, b = fx.tree_a(spark, SMALL), fx.tree_b(spark, SMALL)
    part = F.substring_index("path", "/", 2)
    rows = lambda side, t: t.select(F.lit(side).alias("side"), part.alias("part"), "path", "size", "mtime_ns")
    both = rows("a", a).unionByName(rows("b", b))
    ends = both.select("part").distinct().select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("side"), "part", F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("mtime_ns"))
    both.write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema(flows.DIFF_INPUT).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in/*")
    q = flows.diff_stream(stream).writeStream.format("memory").queryName("diffs").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    assert spark.table("diffs").count() == 0  # no part has ended
    ends.write.parquet(f"{tmp_path}/in/2")
    run(q, "diffs")
    want = Counter((r.path, r.status) for r in delta.diff_trees(a, b).collect())
    assert Counter((r.path, r.status) for r in spark.table("diffs").collect()) == want


def test_resumed_run_writes_each_key_once(spark, tmp_path):
    m = fx.members(spark, SMALL).select("path", "size")
    m.write.parquet(f"{tmp_path}/in/1")
    out, cp = f"file://{tmp_path}/out", f"{tmp_path}/cp"
    go = lambda checkpoint: flows.resumable(spark.readStream.schema("path string, size long").parquet(f"{tmp_path}/in/*"), out, checkpoint, lambda b: b.withColumn("twice", F.col("size") * 2), ["path"]).awaitTermination()
    go(cp)
    m.union(m.selectExpr("concat(path, '.new')", "size")).write.parquet(f"{tmp_path}/in/2")
    go(cp)
    got = spark.read.parquet(out)
    assert got.count() == 2 * m.count() == got.select("path").distinct().count()


def test_windows(spark, tmp_path):
    e = fx.table(spark, SMALL, "events")
    e.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/e")
    stream = lambda: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/e").schema).parquet(f"{tmp_path}/e")
    for name, flow in (("rates", flows.rates), ("sessions", flows.sessions)):
        batch = flow(spark.read.parquet(f"{tmp_path}/e"))
        mode = "append" if name == "sessions" else "complete"
        q = flow(stream()).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        keys = [c for c in batch.columns if c != "value"]
        got, want = (Counter(tuple(r) for r in x.select(*keys).collect()) for x in (spark.table(name), batch))
        assert not got - want and (mode == "append" or got == want)
    twice = stream().union(stream())
    q = flows.once_each(twice, ["event_id"]).writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/o").start()
    q.awaitTermination()
    assert spark.table("once").count() == e.count()
