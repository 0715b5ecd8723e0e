"""Tree ensembles of Spark ML over lists of feature columns, and a choice among models."""

from __future__ import annotations

from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler as _Assembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.ml.base import Estimator, Model, features_of, given
from quern.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator


class VectorModel(Model):
    """A Spark ML model over a list of feature columns."""

    def __init__(self, featuresCol, predictionCol: str, inner) -> None:  # noqa: N803
        super().__init__(featuresCol=featuresCol, predictionCol=predictionCol)
        self.inner = inner

    def _transform(self, df: DataFrame) -> DataFrame:
        made = self.inner.setPredictionCol(self.predictionCol).transform(_vectors(df, self.featuresCol))
        return made.select(*df.columns, self.predictionCol)


def _vectors(df: DataFrame, features) -> DataFrame:
    return _Assembler(inputCols=features_of(features), outputCol="__features", handleInvalid="keep").transform(df)


class _Vector(Estimator):
    _kind, _own = None, {}

    def __init__(self, featuresCol, labelCol: str, predictionCol: str = "prediction", **settings) -> None:  # noqa: N803
        super().__init__(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, settings={**self._own, **settings})

    def _fit(self, df: DataFrame) -> VectorModel:
        rows = _vectors(df.dropna(subset=[*features_of(self.featuresCol), self.labelCol]), self.featuresCol).withColumn("__label", F.col(self.labelCol).cast("double"))
        return VectorModel(self.featuresCol, self.predictionCol, self._kind(featuresCol="__features", labelCol="__label", **self.settings).fit(rows))


class RandomForestClassifier(_Vector):
    _kind, _own = C.RandomForestClassifier, {"numTrees": 100, "seed": 0}


class RandomForestRegressor(_Vector):
    _kind, _own = R.RandomForestRegressor, {"numTrees": 100, "seed": 0}


class GBTClassifier(_Vector):
    """Boosted trees."""

    _kind, _own = C.GBTClassifier, {"maxIter": 100, "seed": 0}


class GBTRegressor(_Vector):
    _kind, _own = R.GBTRegressor, {"maxIter": 100, "seed": 0}


class _Auto(Estimator):
    """The best of a few estimators on a held-out part, fit again on all rows."""

    def __init__(self, featuresCol, labelCol: str, predictionCol: str = "prediction", trainRatio: float = 0.75, seed: int = 0) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _candidates(self) -> list[Estimator]:
        raise NotImplementedError

    def _fit(self, df: DataFrame) -> Model:
        from quern.ml.tuning import TrainValidationSplit

        scored = []
        for estimator in self._candidates():
            found = TrainValidationSplit(estimator, [{}], self._evaluator(), self.trainRatio, self.seed).fit(df)
            scored.append((found.validationMetrics[0], found.bestModel))
        key = lambda x: x[0]
        return (max if self._evaluator().isLargerBetter() else min)(scored, key=key)[1]


class AutoMLClassifier(_Auto):
    def _evaluator(self):
        return BinaryClassificationEvaluator(self.predictionCol, self.labelCol, metricName="accuracy")

    def _candidates(self) -> list[Estimator]:
        from quern.ml.classification import LogisticRegression

        common = (self.featuresCol, self.labelCol, self.predictionCol)
        return [LogisticRegression(*common), RandomForestClassifier(*common, numTrees=20), GBTClassifier(*common, maxIter=10)]


class AutoMLRegressor(_Auto):
    def _evaluator(self):
        return RegressionEvaluator(self.predictionCol, self.labelCol)

    def _candidates(self) -> list[Estimator]:
        from quern.ml.regression import LinearRegression

        common = (self.featuresCol, self.labelCol, self.predictionCol)
        return [LinearRegression(*common), RandomForestRegressor(*common, numTrees=20), GBTRegressor(*common, maxIter=10)]
