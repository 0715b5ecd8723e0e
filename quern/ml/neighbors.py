"""k nearest neighbours, exact, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.ml.base import Estimator, Model, features_of, given

#: Training rows and queries that meet in a task, and queries of it that are held against all of its rows at once.
TRAIN_ROWS, QUERY_ROWS, ROWS = 50_000, 10_000, 256
#: Training rows of which the least rough distance bounds that of the k-th nearest.
GROUP = 32


def _candidates(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, squared distance): for each row of ``a`` its k nearest rows of ``b`` at least, by row of ``a``.

    Distances from inner products are off by rounding; what lies within that of
    a bound on the k-th one is measured component by component.
    """
    far, size = (b * b).sum(axis=1), (a * a).sum(axis=1)
    slack = 16 * (a.shape[1] + 8) * np.finfo(float).eps * (size + far.max())
    if len(b) > k and np.isfinite(slack).all():
        rough = a @ b.T
        rough *= -2
        rough += far
        whole = len(b) // GROUP * GROUP
        least = np.concatenate((rough[:, :whole].reshape(len(a), -1, GROUP).min(axis=2), rough[:, whole:]), axis=1)
        if least.shape[1] < k:
            least = rough
        bound = np.partition(least, k - 1, axis=1)[:, k - 1] + slack
        row, at = np.nonzero(rough <= bound[:, None])
    else:  # few rows, or values that products can't hold
        every = np.zeros((len(a), len(b)))
        for j in range(a.shape[1]):
            every += (a[:, j, None] - b[None, :, j]) ** 2
        row, at = np.nonzero(every <= np.partition(every, k - 1, axis=1)[:, k - 1 : k] if len(b) > k else np.ones(every.shape, dtype=bool))
        return row, at, every[row, at]
    gap = np.zeros(len(row))
    for j in range(a.shape[1]):
        gap += (a[row, j] - b[at, j]) ** 2
    return row, at, gap


class KNeighborsModel(Model):
    """Vote (ties: the smaller label) or mean of the k nearest training rows.

    Training rows are dealt into parts; each part is met by each block of
    queries and returns k candidates a query, which are then merged.
    """

    def __init__(self, featuresCol, labelCol: str, predictionCol: str, k: int, vote: bool, train: DataFrame, parts: int) -> None:  # noqa: N803
        super().__init__(**given({k2: v for k2, v in locals().items() if k2 not in ("train", "parts")}))
        self._train, self._parts = train, parts

    def _transform(self, df: DataFrame) -> DataFrame:
        names, k, vote = features_of(self.featuresCol), self.k, self.vote
        point = F.array(*(F.col(c).cast("double") for c in names))
        queries = df.select(point.alias("x")).where(F.forall("x", lambda v: v.isNotNull())).distinct()
        blocks = max(1, -(-queries.count() // QUERY_ROWS))
        left = queries.select("x", F.pmod(F.xxhash64("x"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(self._parts - 1))).alias("part"))
        right = self._train.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def near(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
            if q.empty or t.empty:
                return pd.DataFrame({"x": [], "best": []})
            a, b, y = np.stack(q["x"].to_numpy()), np.stack(t["x"].to_numpy()), t["y"].to_numpy()
            out = []
            for i in range(0, len(a), ROWS):
                row, at, gap = _candidates(a[i : i + ROWS], b, k)
                order = np.lexsort((y[at], gap, row))
                begin = np.searchsorted(row[order], np.arange(len(a[i : i + ROWS]) + 1))
                for j, (m, n) in enumerate(zip(begin[:-1], begin[1:], strict=True), i):
                    best = order[m : min(m + k, n)]
                    out.append((a[j], [{"d": d, "y": v} for d, v in zip(gap[best].tolist(), y[at[best]].tolist(), strict=True)]))
            return pd.DataFrame(out, columns=["x", "best"])

        found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(near, "x array<double>, best array<struct<d:double,y:double>>")
        merged = found.groupBy("x").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)["y"].alias("ys"))
        if vote:
            times = F.transform(F.array_distinct("ys"), lambda v: F.struct(F.size(F.filter("ys", lambda u: u == v)).alias("n"), (-v).alias("less")))
            answer = merged.select("x", (-F.array_max(times)["less"]).alias("__p"))
        else:
            answer = merged.select("x", (F.aggregate("ys", F.lit(0.0), lambda one, v: one + v) / F.size("ys")).alias("__p"))
        return df.withColumn("__x", point).join(answer.withColumnRenamed("x", "__x"), "__x", "left").withColumnRenamed("__p", self.predictionCol).drop("__x")


class _Neighbors(Estimator):
    _vote = True

    def __init__(self, featuresCol, labelCol: str, predictionCol: str = "prediction", k: int = 5) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _fit(self, df: DataFrame) -> KNeighborsModel:
        point = F.array(*(F.col(c).cast("double") for c in features_of(self.featuresCol)))
        rows = df.select(point.alias("x"), F.col(self.labelCol).cast("double").alias("y")).where(F.forall("x", lambda v: v.isNotNull()) & F.col("y").isNotNull())
        parts = max(1, -(-rows.count() // TRAIN_ROWS))
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(parts)).cast("int"))
        return KNeighborsModel(self.featuresCol, self.labelCol, self.predictionCol, self.k, self._vote, dealt, parts)


class KNeighborsClassifier(_Neighbors):
    pass


class KNeighborsRegressor(_Neighbors):
    _vote = False

