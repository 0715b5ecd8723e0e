import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import ml
from quern.ml import neighbors
from quern.ml.store import ModelStore


@pytest.fixture(scope="module")
def line(session):
    return session.createDataFrame([(float(x), 2.0 * x + 1) for x in range(1, 9)], ["x", "y"])


@pytest.fixture(scope="module")
def credit(session):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), int(a + b + rng.normal(0, 0.3) > 0)) for a, b in rng.normal(size=(200, 2))]
    return session.createDataFrame(rows, ["a", "b", "label"])


def test_linear(line):
    model = ml.LinearRegression(["x"], "y").fit(line)
    assert model.coefficients[0] == pytest.approx(2.0) and model.intercept == pytest.approx(1.0)
    assert model.evaluate(line).r2 == pytest.approx(1.0)
    x, y = np.arange(1.0, 9), 2 * np.arange(1.0, 9) + 1
    weight = ((x - x.mean()) @ (y - y.mean())) / ((x - x.mean()) @ (x - x.mean()) + 3.0)
    assert ml.LinearRegression(["x"], "y", regParam=3.0).fit(line).coefficients[0] == pytest.approx(weight)
    with pytest.raises(ValueError):
        ml.LinearRegression(["x"], "y").fit(line.filter("x > 100"))


def test_large_offset(session):
    rows = session.createDataFrame([(1e9 + i, 3.0 * i) for i in range(20)], ["x", "y"])
    assert ml.LinearRegression(["x"], "y").fit(rows).coefficients[0] == pytest.approx(3.0, rel=1e-6)


def test_logistic_and_metrics(credit):
    model = ml.LogisticRegression(["a", "b"], "label").fit(credit)
    summary = model.evaluate(credit)
    assert summary.accuracy > 0.85 and summary.areaUnderROC > 0.9 and summary.numInstances == 200
    pairs = [(r["probability"], r["label"]) for r in summary.predictions.collect()]
    pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert summary.areaUnderROC == pytest.approx(brute)


def test_features(session):
    frame = session.createDataFrame([("b", 1.0), ("a", None), (None, 3.0), ("b", 3.0)], "s string, v double")
    index = ml.StringIndexer("s", "i").fit(frame)
    assert index.labels == [None, "a", "b"]
    assert [r["i"] for r in index.transform(frame).collect()] == [2.0, 1.0, 0.0, 2.0]
    unseen = session.createDataFrame([("z",)], "s string")
    assert index.transform(unseen).first()["i"] is None
    assert ml.StringIndexer("s", "i", handleInvalid="keep").fit(frame).transform(unseen).first()["i"] == 3.0
    for strategy, value in (("mean", 7 / 3), ("median", 3.0), ("mode", 3.0)):
        filled = ml.Imputer("v", "f", strategy).fit(frame).transform(frame)
        assert filled.where("s = 'a'").first()["f"] == pytest.approx(value)
    with pytest.raises(ValueError):
        ml.Imputer("v", "f", "guess")
    flat = session.createDataFrame([(5.0,), (5.0,)], ["v"])
    for scaler in (ml.StandardScaler("v", "o"), ml.MinMaxScaler("v", "o")):
        assert scaler.fit(flat).transform(flat).first()["o"] == 0.0
    assert [r["o"] for r in ml.Binarizer("v", "o", 1.5).transform(frame).collect()] == [0.0, 0.0, 1.0, 1.0]
    buckets = ml.QuantileDiscretizer(2, "v", "o").fit(frame).transform(frame)
    assert [r["o"] for r in buckets.collect()] == [0, 1, 1, 1]
    hot = ml.OneHotEncoder("i", "h").fit(index.transform(frame)).transform(index.transform(frame))
    assert [r["h"] for r in hot.collect()] == [[0, 0], [0, 1], [1, 0], [0, 0]]
    with pytest.raises(ValueError):
        ml.OneHotEncoder("s", "h").fit(frame)
    with pytest.raises(ValueError):
        ml.VectorAssembler(["zz"], "o").transform(frame)
    assert ml.VectorAssembler(["v"], "o").transform(frame).first()["o"].toArray().tolist() == [1.0]
    assert ml.SQLTransformer("SELECT v + 1 AS w FROM __THIS__").transform(frame).columns == ["w"]


def test_many_labels_are_joined(session):
    frame = session.createDataFrame([(f"n{i:03d}",) for i in range(100)], ["s"])
    out = ml.StringIndexer("s", "i").fit(frame).transform(frame)
    assert out.where("i = cast(substr(s, 2) as double)").count() == 100


def test_neighbors(credit, session):
    points = [(r["a"], r["b"], r["label"]) for r in credit.collect()]
    model = ml.KNeighborsClassifier(["a", "b"], "label", k=3).fit(credit)
    for row in model.transform(credit.limit(20)).collect():
        near = sorted(((row["a"] - a) ** 2 + (row["b"] - b) ** 2, y) for a, b, y in points)[:3]
        assert row["prediction"] == float(sum(y for _, y in near) >= 2)
    mean = ml.KNeighborsRegressor(["a", "b"], "label", k=1).fit(credit).transform(credit)
    assert mean.where("prediction <> label").count() == 0


def test_neighbors_measure_few_rows():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(30, 16)), rng.normal(size=(5000, 16))
    b[4000:4010] = b[7] = a[3]
    row, at, gap = neighbors._candidates(a, b, 5)
    every = sum((a[:, j, None] - b[None, :, j]) ** 2 for j in range(16))
    assert len(row) < 0.01 * every.size and (gap == every[row, at]).all()
    for i in range(30):
        assert set(np.flatnonzero(every[i] <= np.sort(every[i])[4])) <= set(at[row == i])
    b[0, 0], a[1, 1] = np.inf, 1e200
    for one, two in ((a, b), (a[:1], b[1:4])):  # products can't hold these; fewer rows than k
        row, at, gap = neighbors._candidates(one, two, 5)
        assert set(row) == set(range(len(one))) and (np.bincount(row) >= min(5, len(two))).all()


def test_neighbors_of_many_ties_in_blocks(session, monkeypatch):
    monkeypatch.setattr(neighbors, "TRAIN_ROWS", 90)
    monkeypatch.setattr(neighbors, "QUERY_ROWS", 40)
    rng = np.random.default_rng(5)
    rows = [(*map(float, p), int(y)) for p, y in zip(rng.integers(0, 8, (400, 3)), rng.integers(0, 4, 400), strict=True)]
    table = session.createDataFrame([*rows, (None, 1.0, 1.0, 2), (9.0, 9.0, 9.0, None)], "a double, b double, c double, label int")
    found = {(r["a"], r["b"], r["c"]): (r["prediction"], r["mean"]) for r in ml.KNeighborsRegressor(["a", "b", "c"], "label", "mean", k=7).fit(table).transform(ml.KNeighborsClassifier(["a", "b", "c"], "label", k=7).fit(table).transform(table)).collect()}
    assert found[None, 1.0, 1.0] == (None, None)
    for x in {r[:3] for r in rows} | {(9.0, 9.0, 9.0)}:
        near = [y for _, y in sorted((sum((p - q) ** 2 for p, q in zip(x, r, strict=False)), r[3]) for r in rows)[:7]]
        assert found[x] == (min(set(near), key=lambda v: (-near.count(v), v)), pytest.approx(sum(near) / 7))


def test_ensembles_and_tuning(credit):
    forest = ml.RandomForestClassifier(["a", "b"], "label", numTrees=5).fit(credit).transform(credit)
    assert forest.where(F.col("prediction") == F.col("label")).count() > 170
    grid = ml.ParamGridBuilder().addGrid("regParam", [0.0, 10.0]).build()
    tuned = ml.CrossValidator(ml.LogisticRegression(["a", "b"], "label"), grid, ml.BinaryClassificationEvaluator(), 2).fit(credit)
    assert len(tuned.avgMetrics) == 2 and tuned.transform(credit).count() == 200
    split = ml.TrainValidationSplit(ml.LinearRegression(["a"], "b"), [{}], ml.RegressionEvaluator(labelCol="b")).fit(credit)
    assert split.bestParams == {}


def test_automl(credit):
    assert ml.AutoMLRegressor(["a"], "b").fit(credit).transform(credit).count() == 200


def test_pipeline_store(session, line, tmp_path):
    model = ml.Pipeline([ml.LinearRegression(["x"], "y")]).fit(line)
    store = ModelStore(session.spark, str(tmp_path / "models"))
    key = store.save(model, "line")
    again = store.load_by_name("line")
    assert again.transform(line).where("abs(prediction - y) > 1e-6").count() == 0 and store.list_models().count() == 1
    store.delete_model(key)
    with pytest.raises(KeyError):
        store.load(key)
    with pytest.raises(ValueError):
        store.save(ml.RandomForestRegressor(["x"], "y", numTrees=2).fit(line), "forest")
    scaled = ml.Pipeline([ml.StandardScaler("x", "z"), ml.QuantileDiscretizer(3, "z", "q"), ml.OneHotEncoder("q", "h"), ml.Binarizer("z", "b")]).fit(line)
    again = store.load(store.save(scaled, "features"))
    assert again.transform(line).collect() == scaled.transform(line).collect()


def test_params():
    scaler = ml.StandardScaler("x", "y")
    assert scaler.getInputCol() == "x" and scaler.setInputCol("z").inputCol == "z" and scaler.copy({"outputCol": "w"}).outputCol == "w"
    with pytest.raises(ValueError):
        scaler.set("nothing", 1)
    assert "inputCol" in scaler.explainParams()
