"""Set operations, deduplication, reshaping, nulls and statistics."""

from pyspark.sql import functions as F

from quern import functions as Q
from quern.plans.base import query

#: Events with nulls by rule, for the null operators.
SPARSE = "SELECT event_id, nullif(event_type, 'view') AS kind, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events"


def sparse(events):
    return events.select("event_id", F.nullif("event_type", F.lit("view")).alias("kind"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))


@query("supplier", "customer", sql="SELECT s_name AS name, s_nationkey AS nation FROM supplier UNION ALL SELECT c_name, c_nationkey FROM customer")
def union_all(supplier, customer):
    return supplier.selectExpr("s_name AS name", "s_nationkey AS nation").union(customer.select("c_name", "c_nationkey"))


@query("supplier", "customer", sql="SELECT s_name AS name, s_nationkey AS nation FROM supplier UNION ALL SELECT c_name, c_nationkey FROM customer")
def union_by_name(supplier, customer):
    return supplier.selectExpr("s_name AS name", "s_nationkey AS nation").unionByName(customer.selectExpr("c_nationkey AS nation", "c_name AS name"))


@query("supplier", "customer", sql="SELECT s_name AS name, s_nationkey AS nation, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_name, NULL, c_mktsegment FROM customer")
def union_missing(supplier, customer):
    return supplier.selectExpr("s_name AS name", "s_nationkey AS nation").unionByName(customer.selectExpr("c_name AS name", "c_mktsegment AS segment"), allowMissingColumns=True)


@query("orders", sql="SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(orders):
    return orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("orders", sql="SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def dedup_subset(orders):
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus").dropDuplicates(["o_custkey", "o_orderstatus"])


@query("part", sql="SELECT 'p_size' AS label, CAST(p_size AS DOUBLE) AS value, p_partkey FROM part UNION ALL SELECT 'p_retailprice', p_retailprice, p_partkey FROM part")
def unpivot_cols(part):
    return part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice").unpivot("label", "value", "p_size", "p_retailprice")


@query("lineitem", sql="""SELECT l_orderkey, l_linenumber, 'l_discount' AS variable, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")
def melt_cols(lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_tax").melt(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query("lineitem", sql="""SELECT _label, round(sum(_value), 2) AS total FROM (SELECT 'price' AS _label, l_extendedprice AS _value FROM lineitem UNION ALL SELECT 'quantity', l_quantity FROM lineitem) GROUP BY _label""")
def stack_rows(lineitem):
    return lineitem.select(Q.stack(2, "price", "l_extendedprice", "quantity", "l_quantity")).groupBy("_label").agg(F.round(F.sum("_value"), 2).alias("total"))


@query("nation", sql="""SELECT n_regionkey, trim(x) AS names FROM (SELECT n_regionkey, unnest(string_split(string_agg(n_name || ' , ', ''), ',')) AS x FROM nation GROUP BY n_regionkey) WHERE trim(x) <> ''""")
def explode_split(nation):
    joined = nation.groupBy("n_regionkey").agg(F.array_join(F.collect_list(F.concat("n_name", F.lit(" , "))), "").alias("names"))
    return joined.explode("names")


@query("orders", "customer", sql="SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(orders, customer):
    return customer.select("c_custkey").intersect(orders.selectExpr("o_custkey AS c_custkey"))


@query("orders", "customer", sql="SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(orders, customer):
    return customer.select("c_custkey").subtract(orders.selectExpr("o_custkey AS c_custkey"))


@query("orders")
def sample_fraction(orders):
    return orders.sample(0.1, seed=7).select("o_orderkey")


@query("orders", sql="SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, true AS apart FROM orders")
def random_split_partition(orders):
    keys = orders.select("o_orderkey")
    parts = keys.randomSplit([0.5, 0.3, 0.2], seed=11)
    whole = parts[0].union(parts[1]).union(parts[2])
    return whole.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys")).withColumn("apart", F.col("n") == F.col("keys"))


@query("events", sql=f"SELECT 'any' AS rule, count(*) AS n FROM ({SPARSE}) WHERE kind IS NOT NULL AND v IS NOT NULL UNION ALL SELECT 'all', count(*) FROM ({SPARSE}) WHERE kind IS NOT NULL OR v IS NOT NULL UNION ALL SELECT 'two', count(*) FROM ({SPARSE}) WHERE kind IS NOT NULL OR v IS NOT NULL")
def na_drop_any_all_thresh(events):
    rows, n = sparse(events), F.count(F.lit(1)).alias("n")
    kept = [("any", rows.na.drop()), ("all", rows.na.drop("all", subset=["kind", "v"])), ("two", rows.dropna(thresh=2))]
    parts = [f.agg(n).select(F.lit(name).alias("rule"), "n") for name, f in kept]
    return parts[0].union(parts[1]).union(parts[2])


@query("events", sql=f"SELECT event_id, coalesce(kind, 'none') AS kind, coalesce(v, 0.5) AS v FROM ({SPARSE})")
def na_fill(events):
    return sparse(events).fillna({"kind": "none", "v": 0.5})


@query("events", sql="SELECT event_id, CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'hit' ELSE event_type END AS event_type FROM events")
def na_replace(events):
    return events.select("event_id", "event_type").na.replace({"view": "seen", "click": "hit"})


@query("customer", sql="""SELECT summary, CAST(round(v, 4) AS DOUBLE) AS c_acctbal FROM (SELECT 'count' AS summary, count(c_acctbal)::DOUBLE AS v FROM customer UNION ALL SELECT 'mean', avg(c_acctbal) FROM customer
    UNION ALL SELECT 'stddev', stddev(c_acctbal) FROM customer UNION ALL SELECT 'min', min(c_acctbal) FROM customer UNION ALL SELECT 'max', max(c_acctbal) FROM customer)""")
def describe_cols(customer):
    return customer.describe("c_acctbal").select("summary", F.round(F.col("c_acctbal").cast("double"), 4).alias("c_acctbal"))


@query("customer", sql="""SELECT summary, CAST(round(v, 4) AS DOUBLE) AS c_acctbal FROM (SELECT '25%' AS summary, quantile_cont(c_acctbal, 0.25) AS v FROM customer UNION ALL SELECT '50%', median(c_acctbal) FROM customer
    UNION ALL SELECT '75%', quantile_cont(c_acctbal, 0.75) FROM customer UNION ALL SELECT 'count', count(c_acctbal) FROM customer)""")
def summary_exact(customer):
    return customer.select("c_acctbal").summary("count", "25%", "50%", "75%").select("summary", F.round(F.col("c_acctbal").cast("double"), 4).alias("c_acctbal"))


@query("orders", sql="""SELECT o_orderstatus AS o_orderstatus_p, count(*) FILTER (p = '1') AS "1", count(*) FILTER (p = '2') AS "2", count(*) FILTER (p = '3') AS "3", count(*) FILTER (p = '4') AS "4", count(*) FILTER (p = '5') AS "5"
    FROM (SELECT o_orderstatus, left(o_orderpriority, 1) AS p FROM orders) GROUP BY o_orderstatus""")
def crosstab_ab(orders):
    return orders.select("o_orderstatus", F.left("o_orderpriority", F.lit(1)).alias("p")).stat.crosstab("o_orderstatus", "p")


@query("lineitem", sql="SELECT l_quantity, count(*) AS count FROM lineitem GROUP BY l_quantity HAVING count(*) >= 100")
def freq_counts(lineitem):
    return lineitem.stat.freqItems("l_quantity", 100)


@query("orders", sql="SELECT round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders")
def approx_quantile_exact(orders):
    q = F.percentile("o_totalprice", [0.1, 0.5, 0.99])
    return orders.agg(q.alias("q")).select(*(F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p10", "p50", "p99"))))


@query("events")
def sample_by(events):
    return events.stat.sampleBy("event_type", {"click": 0.2, "error": 1.0}, seed=3).select("event_id", "event_type")


@query("orders", sql="SELECT count(*) - count(o_custkey) AS o_custkey, count(*) - count(o_totalprice) AS o_totalprice, count(*) - count(o_orderpriority) AS o_orderpriority FROM orders")
def dq_null_counts(orders):
    return orders.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in ("o_custkey", "o_totalprice", "o_orderpriority")))


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dq_duplicate_keys(lineitem):
    return lineitem.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1").withColumnRenamed("count", "n")


@query("lineitem", "orders", sql="SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def dq_orphans(lineitem, orders):
    done = orders.where("o_orderstatus = 'F'")
    return lineitem.join(done, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey").distinct()


@query("customer", sql="SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY c_mktsegment")
def dq_domain(customer):
    return customer.where(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("lineitem", sql="SELECT count(*) FILTER (l_discount > 0.08) AS held, count(*) FILTER (NOT l_discount > 0.08) AS passed, count(*) AS n, true AS whole FROM lineitem")
def dq_quarantine_reconcile(lineitem):
    bad = F.col("l_discount") > 0.08
    counts = lineitem.agg(F.count_if(bad).alias("held"), F.count_if(~bad).alias("passed"), F.count(F.lit(1)).alias("n"))
    return counts.withColumn("whole", F.col("held") + F.col("passed") == F.col("n"))
