"""Extensions: relational and event-time queries with no counterpart in the catalogue proper, named x_."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tunerline.plans.catalog import query, table


@query("SELECT r_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY ALL")
def x_star_join(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customers = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    orders = t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", "r_name")
    items = t("lineitem").where("l_shipdate >= timestamp '1996-01-01'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("r_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("revenue"))


@query("SELECT c_nationkey, count(*) AS customers, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS buyers FROM customer GROUP BY c_nationkey")
def x_semi_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    buys = c.join(o, "c_custkey", "left_semi").withColumn("b", F.lit(1)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("b", F.lit(0)))
    return buys.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.sum("b").cast("long").alias("buyers"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k")
def x_full_outer(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("a"))
    b = table(spark, sf_dir, "supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "k", "full").select("k", F.coalesce("a", F.lit(0)).alias("customers"), F.coalesce("b", F.lit(0)).alias("suppliers"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def x_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, row_number() OVER w AS nth, lag(event_type) OVER w AS before, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def x_windows(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(w).cast("long").alias("nth"), F.lag("event_type").over(w).alias("before"), F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("last3"))


@query("WITH e AS (SELECT event_id, user_id, ts, event_type FROM events), s AS (SELECT * FROM e WHERE event_type = 'signup') SELECT e.event_id, max(s.ts) AS last_signup FROM e LEFT JOIN s ON s.user_id = e.user_id AND s.ts <= e.ts WHERE e.event_type = 'purchase' GROUP BY e.event_id")
def x_as_of(spark, sf_dir):
    """As-of join by a running last value: one shuffle by user, no theta join."""
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase"))
    return e.withColumn("last_signup", F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).over(w)).where("event_type = 'purchase'").select("event_id", "last_signup")


@query("SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION ALL (SELECT c_nationkey, 'customers only' FROM customer EXCEPT SELECT s_nationkey, 'customers only' FROM supplier)")
def x_set_operations(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customers only")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def x_tumbling(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def x_sessions(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
