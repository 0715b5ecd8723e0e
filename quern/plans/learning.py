"""Machine learning over the driver tables."""

from pyspark.sql import functions as F

from quern import ml
from quern.ml.evaluation import area_under_roc
from quern.plans.base import query


def r(name, digits=6):
    return F.round(name, digits).alias(name)


@query("part", sql="SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev(p_retailprice) OVER (), 6) AS z FROM part")
def ml_standard_scale(part):
    return ml.StandardScaler("p_retailprice", "z").fit(part).transform(part).select("p_partkey", r("z"))


@query("customer", sql="SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS u, round(c_acctbal / max(abs(c_acctbal)) OVER (), 6) AS m FROM customer")
def ml_minmax_maxabs(customer):
    scaled = ml.Pipeline([ml.MinMaxScaler("c_acctbal", "u"), ml.MaxAbsScaler("c_acctbal", "m")]).fit(customer).transform(customer)
    return scaled.select("c_custkey", r("u"), r("m"))


@query("customer", sql="SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS i, c_mktsegment AS back FROM customer")
def ml_string_index(customer):
    model = ml.StringIndexer("c_mktsegment", "i").fit(customer)
    both = ml.IndexToString("i", "back", model.labels).transform(model.transform(customer))
    return both.select("c_custkey", "i", "back")


@query("customer", sql="SELECT c_custkey, array_to_string([CASE WHEN i = k THEN 1 ELSE 0 END for k in range((SELECT count(DISTINCT c_mktsegment) FROM customer) - 1)], ',') AS hot FROM (SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS i FROM customer)")
def ml_one_hot(customer):
    indexed = ml.StringIndexer("c_mktsegment", "i").fit(customer).transform(customer)
    return ml.OneHotEncoder("i", "hot").fit(indexed).transform(indexed).select("c_custkey", F.array_join("hot", ",").alias("hot"))


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 30 THEN 1.0::DOUBLE ELSE 0.0 END AS b FROM lineitem")
def ml_binarize(lineitem):
    return ml.Binarizer("l_quantity", "b", 30.0).transform(lineitem).select("l_orderkey", "l_linenumber", "b")


@query("events", sql="""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events)
    SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM e)), 6) AS a, round(coalesce(v, (SELECT median(v) FROM e)), 6) AS m FROM e""")
def ml_impute(events):
    holes = events.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    filled = ml.Pipeline([ml.Imputer("v", "a"), ml.Imputer("v", "m", "median")]).fit(holes).transform(holes)
    return filled.select("event_id", r("a"), r("m"))


@query("orders", sql="""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders)
    SELECT o_orderkey, CASE WHEN o_totalprice < a THEN 0 WHEN o_totalprice < b THEN 1 WHEN o_totalprice < c THEN 2 ELSE 3 END AS bucket FROM orders, q""")
def ml_quantile_buckets(orders):
    return ml.QuantileDiscretizer(4, "o_totalprice", "bucket").fit(orders).transform(orders).select("o_orderkey", "bucket")


@query("lineitem", sql="SELECT round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def ml_linear_fit(lineitem):
    model = ml.LinearRegression(["l_quantity"], "l_extendedprice").fit(lineitem)
    return lineitem.df.sparkSession.range(1).select(F.round(F.lit(model.coefficients[0]), 5).alias("slope"), F.round(F.lit(model.intercept), 4).alias("intercept"))


@query("lineitem", sql="""WITH p AS (SELECT l_extendedprice AS y, regr_slope(l_extendedprice, l_quantity) OVER () * l_quantity + regr_intercept(l_extendedprice, l_quantity) OVER () AS p FROM lineitem)
    SELECT round(avg(abs(y - p)), 3) AS mae, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 5) AS r2 FROM p""")
def ml_eval_regression(lineitem):
    scored = ml.LinearRegression(["l_quantity"], "l_extendedprice").fit(lineitem).transform(lineitem)
    metrics = ml.RegressionEvaluator(labelCol="l_extendedprice").metrics(scored)
    return metrics.select(F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), F.round("r2", 5).alias("r2"))


@query("labels", "documents", sql="""WITH p AS (SELECT quality AS y, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT count(*) AS n, count_if(p = 1 AND y = 1) AS tp, count_if(p = 1 AND y = 0) AS fp, count_if(p = 0 AND y = 1) AS fn, count_if(p = 0 AND y = 0) AS tn FROM p)
    SELECT round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def ml_eval_binary(labels, documents):
    scored = labels.join(documents, "doc_id").select(F.col("quality").alias("label"), F.when(F.col("n_chars") > 500, 1.0).otherwise(0.0).alias("prediction"))
    return ml.BinaryClassificationEvaluator().metrics(scored.df).select(r("accuracy"), r("precision"), r("recall"), r("f1"))


@query("labels", "documents", sql="""WITH p AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)), k AS (SELECT y, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0) AS rk FROM p)
    SELECT round((sum(rk) FILTER (y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0) / (count_if(y = 1) * count_if(y <> 1)), 6) AS auc FROM k""")
def ml_auc_ranksum(labels, documents):
    scored = labels.join(documents, "doc_id").select("quality", "n_chars")
    return area_under_roc(scored.df, "n_chars", "quality").select(r("auc"))


@query("labels", "documents")
def ml_logistic(labels, documents):
    rows = labels.join(documents, "doc_id").select("doc_id", F.col("quality").alias("label"), F.log1p("n_chars").alias("size"))
    return ml.LogisticRegression(["size"], "label").fit(rows).transform(rows).select("doc_id", "prediction")


COMPONENTS = 64


@query("embeddings")
def ml_knn_vote(embeddings):
    names = [f"x{i}" for i in range(COMPONENTS)]
    points = embeddings.select("vec_id", "label", *(F.get("embedding", F.lit(i)).alias(n) for i, n in enumerate(names)))
    return ml.KNeighborsClassifier(names, "label", k=5).fit(points).transform(points).select("vec_id", "label", "prediction")


@query("part")
def ml_random_forest(part):
    rows = part.select("p_partkey", F.col("p_size").cast("double").alias("size"), "p_retailprice", (F.col("p_retailprice") > 1200).cast("int").alias("label"))
    return ml.RandomForestClassifier(["size", "p_retailprice"], "label", numTrees=5).fit(rows).transform(rows).select("p_partkey", "label", "prediction")
