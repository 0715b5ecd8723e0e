"""Readers, writers, views, SQL text and user-defined functions.

Files go to the folder that the session shares for checkpoints, else (one
process) to a temporary one.
"""

import tempfile
import uuid

import pandas as pd
from pyspark.sql import functions as F

from quern import functions as Q
from quern.operators.rdds import Rdd
from quern.plans.base import query
from quern.session import Session


def folder(session: Session) -> str:
    context = session.spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(session.spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="files-"))
    return f"{context.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def session_of(frame) -> Session:
    return Session(frame.df.sparkSession)


@query("nation", sql="SELECT * FROM nation")
def io_csv_roundtrip(nation):
    session, path = session_of(nation), folder(session_of(nation))
    nation.write.csv(path)
    return session.read.csv(path, schema=", ".join(f"{n} {t}" for n, t in nation.dtypes))


@query("region", sql="SELECT r_name, CAST(r_regionkey AS BIGINT) AS r_regionkey FROM region")
def io_json_roundtrip(region):
    session, path = session_of(region), folder(session_of(region))
    region.write.json(path)
    return session.read.json(path)


@query("orders", sql="SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus")
def io_parquet_roundtrip(orders):
    session, path = session_of(orders), folder(session_of(orders))
    orders.write.partitionBy("o_orderstatus").parquet(path)
    return session.read.parquet(path).where("o_orderstatus <> 'P'").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("supplier", sql="SELECT s_nationkey, 2 * count(*) AS n FROM supplier GROUP BY s_nationkey")
def io_save_modes(supplier):
    session, path = session_of(supplier), folder(session_of(supplier))
    supplier.write.mode("overwrite").parquet(path)
    supplier.write.mode("ignore").parquet(path)
    supplier.write.mode("append").parquet(path)
    return session.read.parquet(path).groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("region", sql="SELECT r_regionkey, r_name FROM region")
def io_foreign_view(region):
    session, path = session_of(region), folder(session_of(region))
    region.write.parquet(path)
    return session.read.parquet(path, foreign=True, name=f"regions_{uuid.uuid4().hex[:8]}").select("r_regionkey", "r_name")


@query("orders", sql="SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey")
def sql_temp_view(orders):
    name = f"big_orders_{uuid.uuid4().hex[:8]}"
    orders.where("o_totalprice > 100000").createOrReplaceTempView(name)
    return session_of(orders).sql(f"SELECT o_custkey, count(*) AS n FROM {name} GROUP BY o_custkey")


@query("customer", "nation", sql="SELECT n_name, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def sql_frame_param(customer, nation):
    text = "SELECT n_name, round(avg(c_acctbal), 4) AS mean FROM {c} JOIN {n} ON c_nationkey = n_nationkey GROUP BY n_name"
    return session_of(customer).sql(text, c=customer, n=nation)


@query("region", sql="SELECT true AS found, false AS other")
def catalog_tables(region):
    session, name = session_of(region), f"seen_{uuid.uuid4().hex[:8]}"
    region.createOrReplaceTempView(name)
    found = (session.catalog.tableExists(name), session.catalog.tableExists(f"{name}_other"))
    return session.spark.range(1).select(F.lit(found[0]).alias("found"), F.lit(found[1]).alias("other"))


@query("nation", sql="SELECT n_nationkey, n_nationkey * 10 + length(n_name) AS code FROM nation")
def udf_scalar(nation):
    session = session_of(nation)

    def code(key: int, name: str) -> int:
        return key * 10 + len(name)

    session.udf.register("nation_code", code)
    return nation.select("n_nationkey", session.udf.call("nation_code", "n_nationkey", "n_name").alias("code"))


@query("part", sql="SELECT p_partkey, p_retailprice * 1.1 AS raised FROM part")
def udf_pandas(part):
    def raised(price: pd.Series) -> pd.Series:
        return price * 1.1

    return part.select("p_partkey", F.pandas_udf(raised, "double")("p_retailprice").alias("raised"))


@query("nation", sql="SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, sum(n_nationkey)::BIGINT AS total FROM nation GROUP BY n_regionkey")
def rdd_roundtrip(nation):
    pairs = Rdd(nation.df.rdd, nation.df.sparkSession).map(lambda r: (r["n_regionkey"], r["n_nationkey"]))
    return pairs.reduceByKey(lambda a, b: a + b).toDF(["n_regionkey", "total"])


@query("region", sql="SELECT 'Q' AS s")
def sql_constant(region):
    return session_of(region).sql("SELECT upper('q') AS s").select(Q.col("s"))
