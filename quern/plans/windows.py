"""Window functions and time series."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern import functions as Q
from quern.plans.base import query



def by_customer():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


def by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("orders", sql="""SELECT o_orderkey, (row_number() OVER w)::INTEGER AS rn, (rank() OVER p)::INTEGER AS rk, (dense_rank() OVER p)::INTEGER AS dr FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), p AS (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderpriority)""")
def win_rank_family(orders):
    p = Window.partitionBy("o_orderstatus", "o_custkey").orderBy("o_orderpriority")
    return orders.select("o_orderkey", Q.row_number().over(by_customer()).alias("rn"), Q.rank().over(p).alias("rk"), Q.dense_rank().over(p).alias("dr"))


@query("customer", sql="SELECT c_custkey, (ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey))::INTEGER AS quarter FROM customer")
def win_ntile(customer):
    return customer.select("c_custkey", Q.ntile(4).over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")).alias("quarter"))


@query("events", sql="""SELECT event_id, lag(event_type) OVER w AS before, lead(value, 2, -1.0) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_lag_lead_default(events):
    return events.select("event_id", Q.lag("event_type").over(by_user()).alias("before"), Q.lead("value", 2, -1.0).over(by_user()).alias("after"))


@query("orders", sql="""SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def win_first_last_nth(orders):
    w = Q.whole(by_customer())
    return orders.select("o_orderkey", Q.first_value("o_orderkey").over(w).alias("f"), Q.last_value("o_orderkey").over(w).alias("l"), Q.nth_value("o_orderkey", 2).over(w).alias("n"))


@query("orders", sql="""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders""")
def win_running_sum(orders):
    w = by_customer().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return orders.select("o_orderkey", F.round(Q.sum("o_totalprice").over(w), 2).alias("running"))


@query("events", sql="""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 5) AS smooth FROM events""")
def win_sliding_rows(events):
    return events.select("event_id", F.round(F.avg("value").over(by_user().rowsBetween(-2, 2)), 5).alias("smooth"))


@query("part", sql="SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part")
def win_range_frame(part):
    w = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, 5)
    return part.select("p_partkey", F.count(F.lit(1)).over(w).alias("near"))


@query("customer", sql="SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS gap FROM customer")
def win_partition_avg(customer):
    return customer.select("c_custkey", F.round(F.col("c_acctbal") - F.avg("c_acctbal").over(Window.partitionBy("c_nationkey")), 4).alias("gap"))


@query("supplier", sql="""SELECT s_suppkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal)""")
def win_percent_cume(supplier):
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal")
    return supplier.select("s_suppkey", F.round(Q.percent_rank().over(w), 6).alias("pr"), F.round(Q.cume_dist().over(w), 6).alias("cd"))


@query("events", sql="SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ts_daily_rollup(events):
    return events.groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("events", sql="""SELECT event_type, day, round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS week FROM
    (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)""")
def ts_moving_avg(events):
    daily = events.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return daily.select("event_type", "day", F.round(F.avg("n").over(Window.partitionBy("event_type").orderBy("day").rowsBetween(-6, 0)), 4).alias("week"))


@query("orders", sql="""SELECT o_orderstatus, m, total, round(total - lag(total) OVER (PARTITION BY o_orderstatus ORDER BY m), 2) AS delta FROM
    (SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL)""")
def ts_mom_delta(orders):
    monthly = orders.groupBy("o_orderstatus", Q.trunc(F.col("o_orderdate").cast("date"), "month").alias("m")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    gap = F.col("total") - F.lag("total").over(Window.partitionBy("o_orderstatus").orderBy("m"))
    return monthly.select("o_orderstatus", "m", "total", F.round(gap, 2).alias("delta"))


@query("events", sql="""SELECT event_id, coalesce(date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) > 86400, false) AS gap FROM events""")
def ts_gap_flags(events):
    wait = F.timestamp_diff("SECOND", F.date_trunc("second", F.lag("ts").over(by_user())), F.date_trunc("second", F.col("ts")))
    return events.select("event_id", F.coalesce(wait > 86400, F.lit(False)).alias("gap"))


@query("events", sql="""SELECT user_id, max(s)::BIGINT AS sessions, count(*) AS events FROM (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
    (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id""")
def ts_sessionize_30m(events):
    fresh = F.when(F.lag("ts").over(by_user()) >= F.col("ts") - F.expr("INTERVAL 30 MINUTES"), 0).otherwise(1)
    flagged = events.withColumn("f", fresh)
    return flagged.groupBy("user_id").agg(F.sum("f").alias("sessions"), F.count(F.lit(1)).alias("events"))


@query("events", sql="""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def win_tumbling_batch(events):
    return events.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("events", sql="""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
    (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 1 HOUR THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, s""")
def win_session_batch(events):
    return events.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
