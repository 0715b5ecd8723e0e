import warnings

import pytest
from pyspark.sql import functions as F

from quern import functions as Q


def values(frame, *names):
    return [tuple(r[n] for n in names) for r in frame.collect()]


def test_projection_and_filter(vendas):
    assert vendas.select("id").filter("id > 10").count() == 2
    assert vendas[["id", "valor"]].columns == ["id", "valor"]
    assert vendas[vendas["valor"] > 200].count() == 2
    assert vendas.drop("nothing", "id").columns == ["cidade", "estado", "valor", "data"]
    assert vendas.colRegex("^d|dad") == ["cidade", "data"]
    assert vendas.transform(lambda f: f.limit(3)).count() == 3
    with pytest.raises(ValueError):
        vendas.transform(3)
    assert vendas.toDF() is vendas


def test_order_strings(vendas):
    assert values(vendas.orderBy("valor DESC").limit(2), "id") == [(7,), (5,)]
    assert values(vendas.orderBy("valor", ascending=False).limit(1), "id") == [(7,)]
    assert values(vendas.orderBy("estado asc nulls last", "id desc").limit(1), "id") == [(12,)]
    assert [r["id"] for r in vendas.orderBy("id").head(2)] == [1, 2]
    assert values(vendas.tailRows(2, "id"), "id") == [(11,), (12,)]


def test_group_names_and_errors(vendas):
    out = vendas.groupBy("estado").agg({"valor": "sum", "*": "count"})
    assert out.columns == ["estado", "sum_valor", "count"]
    assert dict(values(out, "estado", "count")) == {"SP": 6, "RJ": 3, "MG": 3}
    assert vendas.groupBy("estado").sum().columns == ["estado", "sum_id", "sum_valor"]
    with pytest.raises(ValueError):
        vendas.groupBy("estado").agg()
    with pytest.raises(ValueError):
        vendas.groupBy("estado").agg({"valor": "nonsense"})
    assert vendas.groupBy("estado").count().filter("count > 3").count() == 1


def test_cube_rollup_pivot(vendas):
    assert vendas.cube("estado").agg(F.sum("valor").alias("v")).count() == 4
    assert vendas.rollup("estado", "cidade").agg(F.sum("valor").alias("v")).count() == 1 + 3 + 7
    wide = vendas.groupBy("cidade").pivot("estado").agg(F.sum("valor"))
    assert wide.columns == ["cidade", "MG", "RJ", "SP"]


def test_joins(session, vendas):
    left = session.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], ["id", "cidade"])
    right = session.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (5, "w")], ["id", "nome"])
    counts = {how: left.join(right, "id", how).count() for how in ("inner", "left", "right", "full_outer", "left_semi", "leftanti")}
    assert counts == {"inner": 3, "left": 4, "right": 4, "full_outer": 5, "left_semi": 3, "leftanti": 1}
    assert left.join(right).count() == 16
    assert left.joinSuffixed(right, "id").columns == ["id", "cidade", "id_1", "nome"]
    with pytest.raises(ValueError):
        left.join(right, "id", "sideways")
    with pytest.raises(ValueError):
        left.join(right, how="left")
    assert left.join(right.filter("id < 2"), "id").count() == 1  # filters of the right side hold


def test_sets_and_dedup(session):
    a, b = session.createDataFrame([(1, 2), (3, 4)], ["x", "y"]), session.createDataFrame([(2, 1)], ["y", "x"])
    assert values(a.unionByName(b).distinct().orderBy("x"), "x", "y") == [(1, 2), (3, 4)]
    with pytest.raises(ValueError):
        a.unionByName(session.createDataFrame([(1,)], ["z"]))
    dup = session.createDataFrame([(1, 20), (1, 10), (2, 20), (2, 20), (3, 30)], ["a", "b"])
    assert dup.distinct().count() == 4
    assert sorted(values(dup.dropDuplicates(["a"]), "a", "b")) == [(1, 10), (2, 20), (3, 30)]


def test_splits_and_samples(session):
    frame = session.createDataFrame([(i,) for i in range(1000)], ["i"])
    parts = frame.randomSplit([1, 1, 2], seed=1)
    ids = [set(r["i"] for r in p.collect()) for p in parts]
    assert sum(map(len, ids)) == 1000 and len(set.union(*ids)) == 1000
    for bad in ([], [-1, 2], [0, 0]):
        with pytest.raises(ValueError):
            frame.randomSplit(bad)
    assert 50 < frame.sample(0.1, seed=2).count() < 160


def test_reshape(session):
    wide = session.createDataFrame([(1, 10, 20), (2, 30, 40)], ["k", "a", "b"])
    long = wide.unpivot("name", "value", "a", "b")
    assert long.columns == ["name", "value", "k"] and long.count() == 4
    assert wide.melt(["k"]).columns == ["k", "variable", "value"]
    assert wide.stack(first="a", second="b").columns == ["_label", "_value", "k"]
    with pytest.raises(ValueError):
        wide.unpivot("n", "v", "zz")
    texts = session.createDataFrame([(1, " x, y ,,"), (2, None), (3, "  ")], "k int, t string")
    assert values(texts.explode("t").orderBy("t"), "k", "t") == [(1, "x"), (1, "y")]


def test_nulls(session):
    frame = session.createDataFrame([(1, None, 1.0), (2, "b", None), (3, None, None)], "id int, nome string, valor double")
    assert frame.dropna().count() == 0
    assert frame.na.drop("all", subset=["nome", "valor"]).count() == 2
    assert values(frame.fillna(0.0).orderBy("id"), "nome", "valor")[2] == (None, 0.0)
    assert values(frame.na.replace("b", "c").orderBy("id"), "nome")[1] == ("c",)
    assert values(frame.na_replace([1.0, 2.0], [5.0, 6.0], ["valor"]).orderBy("id"), "valor")[0] == (5.0,)
    with pytest.raises(ValueError):
        frame.na_replace([1], [1, 2])
    with pytest.raises(ValueError):
        frame.na_replace(1, 2, ["zz"])


def test_statistics(session, vendas):
    described = {r["summary"]: r["valor"] for r in vendas.describe("valor").collect()}
    assert float(described["mean"]) == pytest.approx(159.1667, abs=1e-3) and described["count"] == "12"
    assert [r["summary"] for r in vendas.summary("min", "50%").collect()] == ["min", "50%"]
    assert vendas.approxQuantile("valor", [0.5]) == [155.0]
    assert vendas.stat.crosstab("estado", "cidade").count() == 3
    assert vendas.stat.freqItems("estado", 4).count() == 1
    line = session.createDataFrame([(float(i), 2.0 * i) for i in range(5)], ["x", "y"])
    assert line.stat.corr("x", "y") == pytest.approx(1.0)
    assert line.stat.cov("x", "y") == pytest.approx(5.0)
    assert session.createDataFrame([(1.0, None)], "x double, y double").stat.corr("x", "y") is None


def test_exact_quantiles(spark, monkeypatch):
    import numpy as np

    from quern.operators import statistics

    monkeypatch.setattr(statistics, "FEW", 5)
    monkeypatch.setattr(statistics, "BINS", 16)
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=500), np.repeat([1.0, 2.0, 7.0], 40), np.exp(8 * rng.normal(size=200)), np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
        shares = [0.0, 0.1, 0.5, 0.77, 1.0]
        assert np.allclose(statistics.exact_quantiles(df, "x", shares), np.quantile(values, shares))
    assert statistics.exact_quantiles(df.where("x is null"), "x", [0.5]) == [None]
    with pytest.raises(ValueError):
        statistics.exact_quantiles(df, "x", [2])


def test_lineage_plan_and_export(vendas):
    frame = vendas.filter("id > 1").select("id")
    assert [s["op"] for s in frame.lineage()][-2:] == ["filter", "select"]
    assert "Project" in frame.to_sql() and "Physical Plan" in frame.plan()
    assert frame.to_arrow().num_rows == 11
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        frame.to_pandas(warn_threshold=5)
    assert any("to_pandas" in str(w.message) for w in seen)


def test_views_and_sql(session, vendas):
    vendas.filter("estado = 'SP'").createOrReplaceTempView("sp_only")
    assert session.sql("SELECT count(*) AS n FROM sp_only").first()["n"] == 6  # the view keeps the filter
    assert session.sql("SELECT max(valor) AS m FROM {v}", v=vendas).first()["m"] == 300.0
    assert "sp_only" in session.catalog.listTables() and not session.catalog.tableExists("nothing_here")
    session.config("observability", True)
    session.sql("SELECT 1 AS one")
    assert session.metrics[-1]["query"] == "SELECT 1 AS one"


def test_create_dataframe(session):
    assert session.createDataFrame([{"a": "1", "b": "x"}, {"a": "2"}], infer_numbers=True).dtypes == [("a", "bigint"), ("b", "string")]
    assert session.createDataFrame([{"a": "1"}]).dtypes == [("a", "string")]
    with pytest.raises(ValueError):
        session.createDataFrame([{"a": 1, "b": 2}], ["a"])


def test_when_chain(vendas):
    out = vendas.select("id", Q.when(F.col("valor") > 200, "high").otherwise("low").alias("c")).where("c = 'high'")
    assert sorted(values(out, "id")) == [(5,), (7,)]
