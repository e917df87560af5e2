"""General coverage on the star schema: joins, semi joins, ranking, grouping sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.plans.fixtures import table
from stowage.plans.registry import query


@query("""
SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(12, 2)))::DOUBLE AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double").alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL""")
def star_join(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders").filter("o_orderpriority = '1-URGENT'"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def customers_semi_anti(spark, d):
    o = table(spark, d, "orders")
    big, open_ = o.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_semi").join(open_, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT c_nationkey, c_custkey, c_acctbal, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer QUALIFY place <= 3")
def top_customers(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal", F.rank().over(w).cast("long").alias("place")).filter("place <= 3")


@query("SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority, year(o_orderdate))")
def orders_cube(spark, d):
    return table(spark, d, "orders").withColumn("y", F.year("o_orderdate").cast("long")).cube("o_orderstatus", "o_orderpriority", "y").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, p_type, count(*) AS n, grouping_id(p_brand, p_type) AS g FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
def grouping_sets(spark, d):
    return table(spark, d, "part").groupingSets([["p_brand"], ["p_type"], []], "p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.grouping_id("p_brand", "p_type").alias("g"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, o_totalprice - lag(o_totalprice) OVER w AS step, ntile(4) OVER w AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def order_steps(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (F.col("o_totalprice") - F.lag("o_totalprice").over(w)).alias("step"), F.ntile(4).over(w).cast("long").alias("quarter"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def top_lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)
