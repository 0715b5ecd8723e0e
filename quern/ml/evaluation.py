"""Metrics as aggregates; the ROC area by rank sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.frame import unwrap
from quern.ml.base import Params, given


class RegressionEvaluator(Params):
    def __init__(self, predictionCol: str = "prediction", labelCol: str = "label", metricName: str = "rmse") -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def isLargerBetter(self) -> bool:  # noqa: N802
        return self.metricName == "r2"

    def metrics(self, df: DataFrame) -> DataFrame:
        """One row: mae, mse, rmse and r2."""
        pairs = unwrap(df).select(F.col(self.labelCol).cast("double").alias("y"), F.col(self.predictionCol).cast("double").alias("p")).dropna()
        gap = F.col("y") - F.col("p")
        sums = pairs.agg(F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"), F.var_pop("y").alias("spread"))
        return sums.select("mae", "mse", F.sqrt("mse").alias("rmse"), (1 - F.try_divide("mse", "spread")).alias("r2"))

    def evaluate(self, df: DataFrame) -> float:
        return self.metrics(df).first()[self.metricName]


def area_under_roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row (auc) by the Mann-Whitney rank sum.

    Scores are grouped first; ranks are running counts over distinct scores,
    taken in two levels so that no task sorts all of them.
    """
    points = df.select(F.col(score).cast("double").alias("s"), (F.col(label) == 1).cast("long").alias("y")).dropna()
    groups = points.groupBy("s").agg(F.sum("y").alias("pos"), (F.count(F.lit(1)) - F.sum("y")).alias("neg"))
    low, high = points.agg(F.min("s"), F.max("s")).first()
    width = (high - low) / 1024 if low is not None and high > low else 1.0
    binned = groups.withColumn("b", F.floor((F.col("s") - F.lit(low or 0.0)) / F.lit(width)))
    by_bin = binned.groupBy("b").agg(F.sum("neg").alias("n"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # over at most 1025 bins
    offsets = by_bin.select("b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("under"))
    inside = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = binned.withColumn("less", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(F.broadcast(offsets), "b")
    wins = F.sum(F.col("pos") * (F.col("under") + F.col("less") + F.col("neg") / 2.0))
    return ranked.agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auc"))


class BinaryClassificationEvaluator(Params):
    def __init__(self, predictionCol: str = "prediction", labelCol: str = "label", probabilityCol: str = "probability", metricName: str = "areaUnderROC") -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def isLargerBetter(self) -> bool:  # noqa: N802
        return True

    def metrics(self, df: DataFrame) -> DataFrame:
        """One row: accuracy, precision, recall and f1 of class 1."""
        p, y = F.col("p") == 1, F.col("y") == 1
        pairs = unwrap(df).select(F.col(self.labelCol).cast("double").alias("y"), F.col(self.predictionCol).cast("double").alias("p")).dropna()
        counts = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
        zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
        return counts.select(
            zero(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"), zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
            zero(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        )

    def evaluate(self, df: DataFrame) -> float:
        if self.metricName == "areaUnderROC":
            return area_under_roc(unwrap(df), self.probabilityCol, self.labelCol).first()["auc"]
        return self.metrics(df).first()[self.metricName]


class _Summary:
    def __init__(self, model, df, predictionCol: str, labelCol: str, probabilityCol: str = "") -> None:  # noqa: N803
        self.predictions = model.transform(df)
        self._names = {"predictionCol": predictionCol, "labelCol": labelCol} | ({"probabilityCol": probabilityCol} if probabilityCol else {})

    @property
    def numInstances(self) -> int:  # noqa: N802
        return unwrap(self.predictions).count()


class RegressionSummary(_Summary):
    def _metric(self, name: str) -> float:
        return RegressionEvaluator(**self._names, metricName=name).evaluate(self.predictions)

    meanAbsoluteError = property(lambda self: self._metric("mae"))  # noqa: N815
    meanSquaredError = property(lambda self: self._metric("mse"))  # noqa: N815
    rootMeanSquaredError = property(lambda self: self._metric("rmse"))  # noqa: N815
    r2 = property(lambda self: self._metric("r2"))


class BinaryClassificationSummary(_Summary):
    def _metric(self, name: str) -> float:
        return BinaryClassificationEvaluator(**self._names, metricName=name).evaluate(self.predictions)

    accuracy = property(lambda self: self._metric("accuracy"))
    precision = property(lambda self: self._metric("precision"))
    recall = property(lambda self: self._metric("recall"))
    f1 = property(lambda self: self._metric("f1"))
    areaUnderROC = property(lambda self: self._metric("areaUnderROC"))  # noqa: N815
