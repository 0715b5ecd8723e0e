"""Operators of the facade that the other plans don't call, each against SQL."""

import pyarrow as pa
from pyspark.sql import functions as F

from quern import functions as Q
from quern.plans.base import query
from quern.plans.io_sql import folder, session_of
from quern.sources import io


@query("region", "nation", sql="SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def api_attributes(region, nation):
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(joined.n_nationkey, joined["n_name"], joined.r_name)


@query("nation", sql="SELECT n_nationkey AS k, n_name AS n, n_regionkey AS r FROM nation WHERE n_regionkey <> 2")
def api_transform_todf(nation):
    return nation.transform(lambda f: f.filter(F.col("n_regionkey") != 2)).toDF("k", "n", "r")


@query("orders", sql="SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders")
def api_col_regex(orders):
    return orders.select(orders.colRegex("o_order(key|status|date)"))


@query("part", sql="""SELECT p_partkey, 2 * p_size AS a, p_size / 4.0 AS b, p_size % 7 AS c, 100 - p_size AS d, 1 + p_size AS e, CAST(p_size AS VARCHAR) AS f, substr(p_name, 2, 3) AS g,
    p_brand IS NOT NULL AS h, isnan(p_retailprice) AS i, p_type AS j FROM part""")
def api_column_operators(part):
    x = F.col("p_size")
    return part.select(
        "p_partkey", (2 * x).alias("a"), (x / 4.0).alias("b"), (x % 7).alias("c"), (100 - x).alias("d"), (1 + x).alias("e"), x.astype("string").alias("f"), F.col("p_name").substr(2, 3).alias("g"),
        F.col("p_brand").isNotNull().alias("h"), F.isnan("p_retailprice").alias("i"), F.col("p_type").name("j"),
    )


@query("customer", sql="SELECT c_custkey, rank FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment ASC NULLS FIRST, c_acctbal DESC NULLS FIRST, c_custkey) AS rank FROM customer) WHERE rank <= 20")
def api_sort_keys(customer):
    keys = [F.col("c_mktsegment").asc_nulls_first(), F.col("c_acctbal").desc_nulls_first(), "c_custkey"]
    top = customer.sort(*keys).limit(20).take(20)
    rows = [(r["c_custkey"], i) for i, r in enumerate(top, 1)]
    assert customer.order_by(*keys).head(1)[0]["c_custkey"] == rows[0][0]
    return session_of(customer).createDataFrame(rows, "c_custkey long, rank long")


@query("supplier", sql="SELECT count(*) AS n, FALSE AS empty, TRUE AS none FROM supplier")
def api_count_is_empty(supplier):
    rows = [(supplier.count(), supplier.isEmpty(), supplier.filter("s_suppkey < 0").isEmpty())]
    return session_of(supplier).createDataFrame(rows, "n long, empty boolean, none boolean")


@query("nation", sql="SELECT * FROM nation")
def api_collect_tuples(nation):
    rows = [tuple(r) for r in nation.collect()]
    return session_of(nation).createDataFrame(rows, "n_nationkey int, n_name string, n_regionkey int")


@query("nation", sql="SELECT n_nationkey, n_name, n_regionkey FROM nation")
def api_arrow_pandas(nation):
    session = session_of(nation)
    arrow = session.createDataFrame(pa.Table.from_batches(nation.to_arrow().to_batches()))
    pandas = io.from_pandas(nation.to_pandas(), session)
    return arrow.select(*nation.columns).unionAll(pandas).drop_duplicates(["n_nationkey"])


@query("region", sql="SELECT r_regionkey, r_name FROM region")
def api_create_from_dicts(region):
    return session_of(region).createDataFrame([r.asDict() for r in region.collect()]).select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


@query("nation", sql="SELECT n_nationkey, n_name, n_regionkey, 'csv' AS via FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'json' FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'parquet' FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'orc' FROM nation")
def io_read_functions(nation):
    session, path = session_of(nation), folder(session_of(nation))
    for kind in ("csv", "json", "parquet", "orc"):
        getattr(nation.write, kind)(f"{path}/{kind}")
    read = {"csv": io.read_csv(f"{path}/csv", session=session), "json": io.read_json(f"{path}/json", session=session), "parquet": io.read_parquet(f"{path}/parquet", session=session), "orc": io.read_table(f"{path}/orc", format="orc", session=session)}
    out = None
    for kind, frame in read.items():
        rows = frame.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"), F.lit(kind).alias("via"))
        out = rows if out is None else out.union(rows)
    return out


@query("supplier", sql="SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey UNION ALL SELECT s_nationkey, 0 FROM (SELECT DISTINCT s_nationkey FROM supplier)")
def sql_read_functions(supplier):
    session = session_of(supplier)
    supplier.createOrReplaceTempView("api_supplier")
    counted = io.read_sql("SELECT s_nationkey, count(*) AS n FROM api_supplier GROUP BY s_nationkey", index_col="s_nationkey", session=session)
    zeros = io.read_sql_table("api_supplier", session=session).select("s_nationkey").distinct().withColumn("n", F.lit(0).cast("long"))
    return counted.union(zeros)


@query("region", sql="SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 3 UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey >= 3")
def io_save_insert(region):
    session, name = session_of(region), "api_region_table"
    session.spark.sql(f"DROP TABLE IF EXISTS {name}")
    region.filter("r_regionkey < 3").write.mode("overwrite").saveAsTable(name)
    region.filter("r_regionkey >= 3").write.mode("append").insertInto(name)
    rows = [tuple(r) for r in session.read.table(name).collect()]
    session.spark.sql(f"DROP TABLE {name}")
    return session.createDataFrame(rows, "r_regionkey int, r_name string")


@query("orders", sql="SELECT o_orderstatus, round(covar_samp(o_totalprice, o_custkey), 4) AS covariance FROM orders GROUP BY o_orderstatus")
def agg_covariance(orders):
    return orders.group_by("o_orderstatus").agg(F.round(Q.covar_samp("o_totalprice", "o_custkey"), 4).alias("covariance"))


@query("lineitem", sql="SELECT round(covar_samp(l_quantity, l_extendedprice), 2) AS covariance FROM lineitem")
def stat_cov(lineitem):
    return session_of(lineitem).createDataFrame([(round(lineitem.stat.cov("l_quantity", "l_extendedprice"), 2),)], "covariance double")


@query("lineitem", sql="""SELECT l_returnflag, bool_and(l_quantity > 1) AS a, bool_or(l_quantity > 49) AS b, bool_or(l_tax > 0.07) AS c, round(stddev_samp(l_tax), 9) AS d, round(stddev_samp(l_tax), 9) AS e,
    round(var_samp(l_tax), 9) AS f, round(var_samp(l_tax), 9) AS g, count(DISTINCT l_linenumber) AS h, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS i, round(quantile_cont(l_quantity, 0.5), 6) AS j, max(l_quantity) AS k FROM lineitem GROUP BY l_returnflag""")
def agg_aliases(lineitem):
    r = lambda c: F.round(c, 9)
    return lineitem.groupBy("l_returnflag").agg(
        Q.bool_and(F.col("l_quantity") > 1).alias("a"), Q.bool_or(F.col("l_quantity") > 49).alias("b"), Q.some(F.col("l_tax") > 0.07).alias("c"), r(Q.std("l_tax")).alias("d"), r(Q.stddev_samp("l_tax")).alias("e"),
        r(Q.variance("l_tax")).alias("f"), r(Q.var_samp("l_tax")).alias("g"), Q.countDistinct("l_linenumber").alias("h"), Q.sumDistinct(F.col("l_linenumber").cast("long")).alias("i"), F.round(Q.quantile("l_quantity", 0.5), 6).alias("j"), Q.max("l_quantity").alias("k"),
    )


@query("events", sql="""SELECT event_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us, minute(ts) AS mi, second(ts) AS se, day(ts) AS d, year(ts) AS y,
    CAST(ts AS DATE) + 3 AS later, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days FROM events""")
def dt_unix_family(events):
    t = F.col("ts").cast("timestamp")
    return events.select(
        "event_id", Q.unix_seconds(t).alias("s"), Q.unix_millis(t).alias("ms"), Q.unix_micros(t).alias("us"), Q.minute("ts").cast("long").alias("mi"), Q.second("ts").cast("long").alias("se"), Q.dayofmonth("ts").cast("long").alias("d"),
        Q.extract("year", F.col("ts")).cast("long").alias("y"), Q.dateadd(F.to_date("ts"), 3).alias("later"), Q.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("days"),
    )


@query("orders", sql="""SELECT o_orderkey, make_timestamp(o_orderkey * 1000000) AS a, make_timestamp(o_orderkey * 1000) AS b, make_timestamp(o_orderkey) AS c, DATE '1970-01-01' + CAST(o_orderkey % 9999 AS INTEGER) AS d,
    strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%d %H:%M:%S') AS e FROM orders""")
def dt_from_epoch(orders):
    k = F.col("o_orderkey")
    return orders.select(
        "o_orderkey", Q.timestamp_seconds(k).cast("timestamp_ntz").alias("a"), Q.timestamp_millis(k).cast("timestamp_ntz").alias("b"), Q.timestamp_micros(k).cast("timestamp_ntz").alias("c"),
        Q.date_from_unix_date((k % 9999).cast("int")).alias("d"), Q.from_unixtime(k).alias("e"),
    )


@query("customer", sql="""SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS a, c_nationkey IS NOT NULL AS b, c_nationkey IS NOT DISTINCT FROM 3 AS c, CASE WHEN isnan(c_acctbal) THEN 0 ELSE c_acctbal END AS d,
    lower(c_name) AS e, upper(c_mktsegment) AS f, length(c_name) AS g, position('0' IN c_name) AS h, repeat(' ', 2) || c_mktsegment AS i, chr(65 + c_nationkey) AS j, substr(c_name, 3, 4) AS k, c_acctbal ** 2 AS m, sign(c_acctbal)::DOUBLE AS n,
    -c_acctbal AS o, CAST(ceil(c_acctbal) AS BIGINT) AS p FROM customer""")
def fn_aliases(customer):
    n, a = F.col("c_nationkey"), F.col("c_acctbal")
    return customer.select(
        "c_custkey", Q.ifnull(Q.nullif(n, F.lit(3)), F.lit(-1)).alias("a"), Q.isnotnull(n).alias("b"), Q.equal_null(n, F.lit(3)).alias("c"), Q.nanvl(a, F.lit(0.0)).alias("d"),
        Q.lcase("c_name").alias("e"), Q.ucase("c_mktsegment").alias("f"), Q.char_length("c_name").alias("g"), Q.locate("0", F.col("c_name")).alias("h"), Q.concat(Q.space(2), F.col("c_mktsegment")).alias("i"), Q.chr((n + 65).cast("long")).alias("j"), Q.substr("c_name", 3, 4).alias("k"),
        Q.power(a, F.lit(2)).alias("m"), Q.signum(a).alias("n"), Q.negate(a).alias("o"), Q.ceiling(a).alias("p"),
    )


@query("region", sql="SELECT length(CAST(uuid() AS VARCHAR)) AS a, TRUE AS b, TRUE AS c, TRUE AS d, TRUE AS e FROM region WHERE r_regionkey = 0")
def fn_random_and_now(region):
    return region.filter("r_regionkey = 0").select(
        F.length(Q.uuid()).alias("a"), Q.rand(1).between(0, 1).alias("b"), (Q.current_date() <= F.current_date()).alias("c"), (Q.now() <= F.current_timestamp()).alias("d"), Q.randn(1).between(-40, 40).alias("e")
    )


@query("nation", sql="SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT -1, sum(n_nationkey) FROM nation UNION ALL SELECT -2, max(n_nationkey) FROM nation")
def rdd_operators(nation):
    spark = nation.df.sparkSession
    rdd = nation.df.rdd.map(lambda r: (r["n_regionkey"], r["n_nationkey"]))
    counts = rdd.flatMap(lambda x: [x]).filter(lambda x: x[1] >= 0).map(lambda x: x[0]).countByValue()
    keys = rdd.map(lambda x: x[1])
    assert keys.union(keys).distinct().count() == keys.count() == keys.intersection(keys).count() and not keys.isEmpty()
    assert keys.sortBy(lambda x: -x).first() == keys.takeOrdered(1, key=lambda x: -x)[0] and len(keys.glom().collect()) == keys.getNumPartitions()
    rows = [*counts.items(), (-1, keys.reduce(lambda a, b: a + b)), (-2, keys.sortBy(lambda x: -x).first())]
    return spark.createDataFrame(rows, "k int, n long")


@query("orders", sql="SELECT o_orderkey, coalesce(o_orderstatus, 'none') AS o_orderstatus FROM orders WHERE o_totalprice IS NOT NULL")
def na_accessors(orders):
    return orders.select("o_orderkey", "o_orderstatus", "o_totalprice").na_drop(subset=["o_totalprice"]).na.fill({"o_orderstatus": "none"}).drop("o_totalprice")


@query("lineitem", sql="SELECT unnest([0.1, 0.5, 0.9]) AS p, round(unnest(quantile_cont(l_extendedprice, [0.1, 0.5, 0.9])), 4) AS value FROM lineitem")
def stat_approx_quantile(lineitem):
    values = lineitem.stat.approxQuantile("l_extendedprice", [0.1, 0.5, 0.9])
    return session_of(lineitem).createDataFrame(list(zip([0.1, 0.5, 0.9], values, strict=True)), "p double, value double").withColumn("value", F.round("value", 4))


@query("supplier", sql="SELECT s_suppkey, s_acctbal FROM supplier")
def sql_registered_view(supplier):
    supplier.registerTempTable("api_suppliers_too")
    session = session_of(supplier)
    assert session.catalog.tableExists("api_suppliers_too") and "s_suppkey" in supplier.columns and dict(supplier.dtypes)["s_suppkey"] == "bigint"
    return session.table("api_suppliers_too").select("s_suppkey", "s_acctbal")


@query("orders", sql="SELECT o_orderstatus, count(*) AS n, count(*) AS kept FROM orders GROUP BY 1")
def agg_approx_within_error(orders):
    """The sketch of distinct keys lies within six of its standard errors of the exact number."""
    rows = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), Q.approx_count_distinct("o_orderkey").alias("sketch"))
    return rows.select("o_orderstatus", "n", F.when(F.abs(F.col("sketch") - F.col("n")) <= F.greatest(0.3 * F.col("n"), F.lit(2)), F.col("n")).alias("kept"))
