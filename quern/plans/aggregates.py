"""Grouping, aggregate functions, grouping sets and pivots."""

from pyspark.sql import functions as F

from quern import functions as Q
from quern.plans.base import query


@query("orders", sql="SELECT o_orderstatus, round(sum(o_totalprice), 2) AS sum_o_totalprice, count(*) AS count, max(o_custkey) AS max_o_custkey FROM orders GROUP BY o_orderstatus")
def agg_dict_names(orders):
    return orders.groupBy("o_orderstatus").agg({"o_totalprice": "sum", "*": "count", "o_custkey": "max"}).withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


@query("orders", sql="""SELECT o_orderpriority, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 4) AS mean, count(o_custkey) AS n FROM orders GROUP BY o_orderpriority""")
def agg_columns(orders):
    return orders.groupBy("o_orderpriority").agg(Q.min("o_totalprice").alias("low"), Q.max("o_totalprice").alias("high"), F.round(Q.mean("o_totalprice"), 4).alias("mean"), Q.count("o_custkey").alias("n"))


@query("part", sql="SELECT p_brand, sum(p_size)::BIGINT AS sum_p_size, max(p_retailprice) AS top FROM part GROUP BY p_brand")
def agg_convenience(part):
    sums = part.groupBy("p_brand").sum("p_size")
    return sums.join(part.groupBy("p_brand").max("p_retailprice").withColumnRenamed("max_p_retailprice", "top"), "p_brand")


@query("orders", sql="SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def agg_having(orders):
    return orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 15")


@query("lineitem", sql="SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, round(sum(DISTINCT l_quantity), 2) AS quantities FROM lineitem GROUP BY l_returnflag")
def agg_distinct(lineitem):
    return lineitem.groupBy("l_returnflag").agg(Q.count_distinct("l_suppkey").alias("suppliers"), F.round(Q.sum_distinct("l_quantity"), 2).alias("quantities"))


@query("events", sql="SELECT user_id % 10 AS g, count(DISTINCT row(nullif(event_type, 'view'), user_id)) AS pairs FROM events GROUP BY ALL")
def agg_multi_distinct_struct(events):
    return events.groupBy((F.col("user_id") % 10).alias("g")).agg(Q.count_distinct(F.nullif("event_type", F.lit("view")), "user_id").alias("pairs"))


@query("orders", sql="SELECT o_custkey % 100 AS g, bool_and(o_totalprice > 5000) AS every_one, bool_or(o_totalprice > 400000) AS some_one FROM orders GROUP BY ALL")
def agg_bool(orders):
    return orders.groupBy((F.col("o_custkey") % 100).alias("g")).agg(Q.every(F.col("o_totalprice") > 5000).alias("every_one"), Q.any(F.col("o_totalprice") > 400000).alias("some_one"))


@query("events", sql="SELECT event_type, count_if(value > 50)::BIGINT AS n FROM events GROUP BY event_type")
def agg_count_if(events):
    return events.groupBy("event_type").agg(Q.count_if(F.col("value") > 50).alias("n"))


@query("orders", sql="SELECT o_orderstatus, max_by(o_orderkey, o_totalprice * 1000000 + o_orderkey % 1000) AS top, min_by(o_orderkey, o_totalprice * 1000000 + o_orderkey % 1000) AS low FROM orders GROUP BY o_orderstatus")
def agg_min_by_max_by(orders):
    key = F.col("o_totalprice") * 1000000 + F.col("o_orderkey") % 1000
    return orders.groupBy("o_orderstatus").agg(Q.max_by("o_orderkey", key).alias("top"), Q.min_by("o_orderkey", key).alias("low"))


@query("events", sql="SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id")
def agg_first_last_ordered(events):
    at = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(Q.min_by("event_type", at).alias("first_type"), Q.max_by("event_type", at).alias("last_type"))


@query("lineitem", sql="""SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 5) AS v, round(var_pop(l_quantity), 5) AS vp FROM lineitem GROUP BY l_returnflag""")
def agg_spread(lineitem):
    x = "l_quantity"
    return lineitem.groupBy("l_returnflag").agg(F.round(Q.stddev(x), 6).alias("sd"), F.round(Q.stddev_pop(x), 6).alias("sdp"), F.round(Q.var(x), 5).alias("v"), F.round(Q.var_pop(x), 5).alias("vp"))


@query("lineitem", sql="""SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_extendedprice), 2) AS c, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp FROM lineitem GROUP BY l_linestatus""")
def agg_corr_covar(lineitem):
    x, y = "l_quantity", "l_extendedprice"
    return lineitem.groupBy("l_linestatus").agg(F.round(Q.corr(x, y), 6).alias("r"), F.round(Q.covar_samp(x, y), 2).alias("c"), F.round(Q.covar_pop(x, y), 2).alias("cp"))


@query("lineitem", sql="SELECT l_returnflag, CAST(NULL AS DOUBLE) AS r FROM lineitem GROUP BY l_returnflag")
def agg_corr_constant(lineitem):
    return lineitem.groupBy("l_returnflag").agg(Q.corr(F.lit(3.0), "l_quantity").alias("r"))


@query("orders", sql="""SELECT o_orderpriority, round(skewness(o_totalprice), 5) AS s, round(kurtosis(o_totalprice), 5) AS k FROM orders GROUP BY o_orderpriority""")
def agg_skew_kurt(orders):
    return orders.groupBy("o_orderpriority").agg(F.round(Q.skewness("o_totalprice"), 5).alias("s"), F.round(Q.kurtosis("o_totalprice"), 5).alias("k"))


@query("lineitem", sql="""SELECT l_suppkey, round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_suppkey""")
def agg_median_percentile(lineitem):
    x = "l_extendedprice"
    return lineitem.groupBy("l_suppkey").agg(F.round(Q.median(x), 4).alias("med"), F.round(Q.percentile(x, 0.25), 4).alias("q1"), F.round(Q.percentile_approx(x, 0.9), 4).alias("p90"))


@query("nation", sql="SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, count(*) AS n FROM nation GROUP BY n_regionkey")
def agg_collect_sorted(nation):
    return nation.groupBy("n_regionkey").agg(F.array_join(F.sort_array(Q.collect_list("n_name")), ",").alias("names"), F.size(Q.collect_set("n_name")).cast("bigint").alias("n"))


@query("lineitem")
def agg_approx_distinct(lineitem):
    return lineitem.groupBy("l_returnflag").agg(Q.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("orders", sql="SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS gid FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_sum(orders):
    return orders.cube("o_orderstatus", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("gid"))


@query("customer", "nation", sql="SELECT n_regionkey, n_name, round(sum(c_acctbal), 2) AS total, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)")
def rollup_sum(customer, nation):
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_regionkey", "n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@query("lineitem", sql="SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets_count(lineitem):
    return lineitem.groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("orders", sql="""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY o_orderpriority""")
def pivot_values(orders):
    return orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.count(F.lit(1))).fillna(0)


@query("events", sql="""SELECT user_id % 20 AS g, round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'error'), 4) AS error,
    round(sum(value) FILTER (event_type = 'purchase'), 4) AS purchase, round(sum(value) FILTER (event_type = 'signup'), 4) AS signup, round(sum(value) FILTER (event_type = 'view'), 4) AS view FROM events GROUP BY ALL""")
def pivot_discovered(events):
    return events.groupBy((F.col("user_id") % 20).alias("g")).pivot("event_type").agg(F.round(F.sum("value"), 4))
