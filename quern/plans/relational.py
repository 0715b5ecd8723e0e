"""Scans, projections, filters, sorts and joins."""

from pyspark.sql import functions as F

from quern import functions as Q
from quern.plans.base import query

def price():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("lineitem", sql="""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
    round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def q1_pricing_summary(lineitem):
    return lineitem.where(F.col("l_shipdate") <= ts("1998-09-02")).groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(price()), 2).alias("sum_disc_price"),
        F.round(F.sum(price() * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"),
    )


@query("lineitem", sql="""SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def q6_forecast_revenue(lineitem):
    kept = lineitem.where((F.col("l_shipdate") >= ts("1996-01-01")) & (F.col("l_shipdate") < ts("1997-01-01")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return kept.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("customer", "orders", "lineitem", sql="""SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def q3_top_unshipped(customer, orders, lineitem):
    open_orders = customer.where("c_mktsegment = 'BUILDING'").join(orders.where(F.col("o_orderdate") < ts("1998-03-15")), F.col("c_custkey") == F.col("o_custkey"))
    sold = open_orders.join(lineitem.where(F.col("l_shipdate") > ts("1998-03-15")), F.col("l_orderkey") == F.col("o_orderkey"))
    return sold.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(price()), 2).alias("revenue")).orderBy("revenue DESC", "l_orderkey").limit(10)


@query("customer", "orders", "lineitem", "supplier", "nation", "region", sql="""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey
    JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey AND c_nationkey = s_nationkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def q5_local_supplier_volume(customer, orders, lineitem, supplier, nation, region):
    near = region.where("r_name = 'ASIA'").join(nation, F.col("r_regionkey") == F.col("n_regionkey")).join(supplier, F.col("s_nationkey") == F.col("n_nationkey"))
    sold = lineitem.join(near, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    local = sold.join(customer, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return local.groupBy("n_name").agg(F.round(F.sum(price()), 2).alias("revenue"))


@query("orders", sql="SELECT o_orderkey, o_totalprice * 2 AS doubled, upper(o_orderstatus) AS status FROM orders")
def select_expr(orders):
    return orders.selectExpr("o_orderkey", "o_totalprice * 2 AS doubled", "upper(o_orderstatus) AS status")


@query("orders", sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
def filter_string(orders):
    return orders.filter("o_totalprice > 200000 AND o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")


@query("orders", sql="SELECT o_orderkey, o_custkey FROM orders WHERE (o_totalprice < 50000 OR o_orderstatus = 'F') AND NOT o_orderpriority = '1-URGENT'")
def filter_column(orders):
    return orders.where(((F.col("o_totalprice") < 50000) | (F.col("o_orderstatus") == "F")) & ~(F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_custkey")


@query("part", sql="SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23')")
def between_isin(part):
    return part.where(F.col("p_size").between(10, 20) & F.col("p_brand").isin(["Brand#11", "Brand#12", "Brand#23"])).select("p_partkey", "p_size")


@query("part", sql="""SELECT p_partkey, p_name LIKE '%a%' AS has_a, p_type ILIKE '%STEEL%' AS steel, regexp_matches(p_brand, '#[1-3]') AS low FROM part""")
def like_ilike_rlike(part):
    return part.select("p_partkey", F.col("p_name").like("%a%").alias("has_a"), F.col("p_type").ilike("%STEEL%").alias("steel"), F.col("p_brand").rlike("#[1-3]").alias("low"))


@query("part", sql="SELECT p_partkey, contains(p_name, 'e') AS c, starts_with(p_brand, 'Brand#1') AS s, ends_with(p_brand, '3') AS e FROM part")
def contains_starts_ends(part):
    return part.select("p_partkey", Q.contains("p_name", "e").alias("c"), Q.startswith("p_brand", "Brand#1").alias("s"), Q.endswith("p_brand", "3").alias("e"))


@query("lineitem", sql="""SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem""")
def with_columns_chain(lineitem):
    added = lineitem.withColumns({"net": "l_extendedprice * (1 - l_discount)", "gross": "net * (1 + l_tax)"})
    return added.select("l_orderkey", "l_linenumber", "net", "gross")


@query("nation", sql="SELECT n_nationkey AS id, n_name AS name FROM nation")
def rename_drop(nation):
    return nation.withColumnRenamed("n_nationkey", "id").withColumnsRenamed({"n_name": "name"}).drop("n_regionkey", "no_such_column")


@query("orders", sql="SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS text, CAST(o_orderdate AS DATE) AS day FROM orders")
def cast_types(orders):
    return orders.select("o_orderkey", F.round("o_totalprice").cast("bigint").alias("whole"), Q.cast("o_orderkey", "string").alias("text"), F.col("o_orderdate").cast("date").alias("day"))


@query("orders", sql="SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS class FROM orders")
def case_when(orders):
    return orders.select("o_orderkey", Q.when(F.col("o_totalprice") > 300000, "high").when(F.col("o_totalprice") > 100000, "middle").otherwise("low").alias("class"))


@query("events", sql="SELECT event_id, nullif(event_type, 'view') IS NOT DISTINCT FROM NULL AS is_view FROM events")
def null_safe_eq(events):
    return events.select("event_id", F.nullif("event_type", F.lit("view")).eqNullSafe(None).alias("is_view"))


@query("supplier", sql="SELECT s_suppkey, s_acctbal, s_acctbal / nullif(s_suppkey % 3, 0) AS share FROM supplier")
def divide_by_zero(supplier):
    return supplier.select("s_suppkey", "s_acctbal", Q.divide(F.col("s_acctbal"), F.col("s_suppkey") % 3).alias("share"))


@query("supplier", sql="SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def order_multi(supplier):
    return supplier.orderBy(F.col("s_nationkey").asc(), F.desc("s_acctbal"), "s_suppkey").select("s_suppkey", "s_nationkey", "s_acctbal")


@query("orders", sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def order_string_desc(orders):
    return orders.orderBy("o_totalprice DESC", "o_orderkey ASC").limit(25).select("o_orderkey", "o_totalprice")


@query("events", sql="SELECT event_id, v FROM (SELECT event_id, nullif(event_type, 'view') AS v FROM events) ORDER BY v NULLS LAST, event_id LIMIT 40")
def order_nulls_first_last(events):
    return events.select("event_id", F.nullif("event_type", F.lit("view")).alias("v")).orderBy("v ASC NULLS LAST", "event_id").limit(40)


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def topk_total_order(lineitem):
    return lineitem.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("orders", sql="SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def tail_rows(orders):
    return orders.select("o_orderkey", "o_custkey").tailRows(7, "o_orderkey")


@query("customer", "nation", sql="SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_inner(customer, nation):
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("customer", "orders", sql="""SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def join_left(customer, orders):
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_outer").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("orders", "customer", sql="SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 350000) RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right(orders, customer):
    return orders.where("o_totalprice > 350000").join(customer, F.col("o_custkey") == F.col("c_custkey"), "right").select("o_orderkey", "c_custkey")


@query("customer", "supplier", sql="""SELECT c_nationkey, s_nationkey, c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 9000) FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON c_nationkey = s_nationkey""")
def join_full(customer, supplier):
    left, right = customer.where("c_acctbal > 9000"), supplier.where("s_acctbal > 5000")
    return left.join(right, F.col("c_nationkey") == F.col("s_nationkey"), "fullouter").select("c_nationkey", "s_nationkey", "c_custkey", "s_suppkey")


@query("customer", "orders", sql="SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(customer, orders):
    return customer.join(orders.where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "leftsemi").select("c_custkey")


@query("customer", "orders", sql="SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(customer, orders):
    return customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("region", "nation", sql="SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(region, nation):
    return region.crossJoin(nation).select("r_name", "n_name")


@query("part", "supplier", sql="SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size >= s_nationkey + 20 AND p_size < s_nationkey + 23")
def join_theta_range(part, supplier):
    # Sizes are whole numbers, so the range is three of them, and parts meet suppliers by equal keys.
    # A part has thousands of matches, so a small file of parts is dealt out to all cores first.
    sizes = F.sequence(F.col("s_nationkey") + 20, F.col("s_nationkey") + 22)
    return part.repartition("p_partkey").join(supplier.select("s_suppkey", F.explode(sizes).alias("size")), F.col("p_size") == F.col("size")).select("p_partkey", "s_suppkey")


@query("lineitem", sql="""SELECT a.l_orderkey, a.l_linenumber, n FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY ALL) b USING (l_orderkey, l_linenumber)""")
def join_multi_key(lineitem):
    counts = lineitem.where("l_quantity > 25").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return lineitem.select("l_orderkey", "l_linenumber").join(counts, ["l_orderkey", "l_linenumber"])


@query("nation", sql="SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(nation):
    a, b = nation.alias("a"), nation.alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("one"), F.col("b.n_name").alias("two"))


@query("events", sql="""SELECT a.event_id, b.k FROM (SELECT event_id, nullif(event_type, 'view') AS k FROM events) a JOIN (SELECT DISTINCT nullif(event_type, 'view') AS k FROM events) b ON a.k IS NOT DISTINCT FROM b.k""")
def join_null_safe(events):
    kind = F.nullif("event_type", F.lit("view"))
    a, b = events.select("event_id", kind.alias("ka")), events.select(kind.alias("k")).distinct()
    return a.join(b, F.col("ka").eqNullSafe(F.col("k"))).select("event_id", "k")


@query("lineitem", "part", sql="SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 15 GROUP BY p_brand")
def join_broadcast(lineitem, part):
    return lineitem.join(Q.broadcast(part.where("p_size = 15").df), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("nation", "region", sql="SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_suffixed(nation, region):
    both = nation.withColumnRenamed("n_regionkey", "k").joinSuffixed(region.withColumnRenamed("r_regionkey", "k"), "k")
    return both.withColumnsRenamed({"k": "n_regionkey", "k_1": "r_regionkey"})


@query("customer", "orders", "nation", sql="""SELECT n_name, count(DISTINCT c_custkey) AS customers, count(*) AS orders, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def join_three_way(customer, orders, nation):
    all_ = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return all_.groupBy("n_name").agg(F.count_distinct("c_custkey").alias("customers"), F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
