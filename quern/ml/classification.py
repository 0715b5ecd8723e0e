"""Binary logistic regression."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression as _Logistic
from pyspark.ml.feature import VectorAssembler as _Assembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.ml.base import Estimator, Model, features_of, given
from quern.ml.regression import linear


class LogisticRegressionModel(Model):
    def __init__(self, featuresCol, labelCol: str, predictionCol: str, probabilityCol: str, coefficients: list[float], intercept: float, threshold: float) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _transform(self, df: DataFrame) -> DataFrame:
        logit = linear(features_of(self.featuresCol), self.coefficients, self.intercept)
        scored = df.withColumn(self.probabilityCol, F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))
        return scored.withColumn(self.predictionCol, F.when(F.col(self.probabilityCol) >= self.threshold, 1.0).otherwise(0.0))

    def evaluate(self, df):
        from quern.ml.evaluation import BinaryClassificationSummary

        return BinaryClassificationSummary(self, df, self.predictionCol, self.labelCol, self.probabilityCol)


class LogisticRegression(Estimator):
    """Fit to convergence by Spark's optimizer; the probability is that of class 1."""

    def __init__(self, featuresCol, labelCol: str, predictionCol: str = "prediction", probabilityCol: str = "probability", regParam: float = 0.0, maxIter: int = 100, threshold: float = 0.5) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _fit(self, df: DataFrame) -> LogisticRegressionModel:
        names = features_of(self.featuresCol)
        rows = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)), F.col(self.labelCol).cast("double").alias("label")).dropna()
        vectors = _Assembler(inputCols=[f"x{i}" for i in range(len(names))], outputCol="features").transform(rows)
        model = _Logistic(maxIter=self.maxIter, regParam=self.regParam, standardization=True, family="binomial").fit(vectors)
        return LogisticRegressionModel(names, self.labelCol, self.predictionCol, self.probabilityCol, [float(c) for c in model.coefficients], float(model.intercept), self.threshold)
