"""Linear regression from sufficient statistics of one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.ml.base import Estimator, Model, features_of, given


def linear(features: Sequence[str], coefficients: Sequence[float], intercept: float) -> Column:
    out = F.lit(float(intercept))
    for name, weight in zip(features, coefficients, strict=True):
        out = out + F.lit(float(weight)) * F.col(name)
    return out


class LinearRegressionModel(Model):
    def __init__(self, featuresCol, labelCol: str, predictionCol: str, coefficients: list[float], intercept: float) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.predictionCol, linear(features_of(self.featuresCol), self.coefficients, self.intercept))

    def evaluate(self, df):
        from quern.ml.evaluation import RegressionSummary

        return RegressionSummary(self, df, self.predictionCol, self.labelCol)


class LinearRegression(Estimator):
    """Ridge regression: (X'X + regParam I) b = X'y, the intercept free.

    Sums are taken about a first row's values, which keeps large offsets exact
    enough; rows with a null take no part.
    """

    def __init__(self, featuresCol, labelCol: str, predictionCol: str = "prediction", regParam: float = 0.0) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _fit(self, df: DataFrame) -> LinearRegressionModel:
        names = features_of(self.featuresCol)
        full = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)), F.col(self.labelCol).cast("double").alias("y")).dropna()
        columns = [*(f"x{i}" for i in range(len(names))), "y"]
        means = full.agg(*(F.avg(c) for c in columns)).first()
        if means[0] is None:
            raise ValueError("no complete rows")
        centred = {c: F.col(c) - F.lit(m) for c, m in zip(columns, means, strict=True)}
        pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
        sums = full.agg(*(F.sum(centred[a] * centred[b]) for a, b in pairs)).first()
        cross = np.zeros((len(columns), len(columns)))
        for (a, b), s in zip(pairs, sums, strict=True):
            i, j = columns.index(a), columns.index(b)
            cross[i, j] = cross[j, i] = s
        left = cross[:-1, :-1] + self.regParam * np.eye(len(names))
        try:
            weights = np.linalg.solve(left, cross[:-1, -1])
        except np.linalg.LinAlgError:
            weights = np.linalg.lstsq(left, cross[:-1, -1], rcond=None)[0]
        intercept = means[-1] - float(np.dot(weights, means[:-1]))
        return LinearRegressionModel(names, self.labelCol, self.predictionCol, [float(w) for w in weights], intercept)
