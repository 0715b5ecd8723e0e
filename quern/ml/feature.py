"""Feature transformers; every model is a column expression or a small join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler as _Assembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quern.ml.base import Estimator, Model, Transformer, features_of, given
from quern.operators.statistics import exact_quantiles

#: Up to so many labels are looked up in an expression; more are joined.
EXPRESSION_LABELS = 64


class VectorAssembler(Transformer):
    """A vector column from numeric columns; rows with nulls give a null vector value (NaN)."""

    def __init__(self, inputCols: Sequence[str], outputCol: str) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _transform(self, df: DataFrame) -> DataFrame:
        names = features_of(self.inputCols)
        if missing := [c for c in names if c not in df.columns]:
            raise ValueError(f"no column {missing[0]!r}")
        filled = {f"__v{i}": F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for i, c in enumerate(names)}
        return _Assembler(inputCols=list(filled), outputCol=self.outputCol, handleInvalid="keep").transform(df.withColumns(filled)).drop(*filled)


class _ColumnModel(Model):
    """A model that adds one column, an expression of its parameters."""

    def _column(self) -> Column:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.outputCol, self._column())


class ScalerModel(_ColumnModel):
    """(x - shift) / scale; 0 if scale is 0."""

    def __init__(self, inputCol: str, outputCol: str, shift: float, scale: float) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _column(self) -> Column:
        x = F.col(self.inputCol)
        return (x - F.lit(float(self.shift))) / F.lit(float(self.scale)) if self.scale else F.when(x.isNotNull(), 0.0)


class OneHotEncoderModel(_ColumnModel):
    def __init__(self, inputCol: str, outputCol: str, size: int) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _column(self) -> Column:
        if not self.size:
            return F.array().cast("array<int>")
        return F.transform(F.sequence(F.lit(0), F.lit(self.size - 1)), lambda i: F.when(F.col(self.inputCol) == i, 1).otherwise(0))


class ImputerModel(_ColumnModel):
    def __init__(self, inputCol: str, outputCol: str, replacement: float) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _column(self) -> Column:
        return F.coalesce(F.col(self.inputCol), F.lit(self.replacement))


class QuantileDiscretizerModel(_ColumnModel):
    def __init__(self, inputCol: str, outputCol: str, boundaries: list[float]) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _column(self) -> Column:
        out = F.lit(len(self.boundaries))
        for i, cut in reversed(list(enumerate(self.boundaries))):
            out = F.when(F.col(self.inputCol) < cut, i).otherwise(out)
        return out


class StringIndexerModel(Model):
    def __init__(self, inputCol: str, outputCol: str, labels: list[str | None], handleInvalid: str) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _transform(self, df: DataFrame) -> DataFrame:
        other = F.lit(float(len(self.labels)) if self.handleInvalid == "keep" else None).cast("double")
        text = F.col(self.inputCol).cast("string")
        if len(self.labels) <= EXPRESSION_LABELS:
            out = F.lit(None).cast("double") if self.handleInvalid != "keep" else other
            for i, label in reversed(list(enumerate(self.labels))):
                out = F.when(text.eqNullSafe(F.lit(label).cast("string")), F.lit(float(i))).otherwise(out)
            return df.withColumn(self.outputCol, out)
        rows = df.sparkSession.createDataFrame([(x, float(i)) for i, x in enumerate(self.labels)], "__label string, __index double")
        return df.join(rows, text.eqNullSafe(F.col("__label")), "left").withColumn(self.outputCol, F.coalesce("__index", other)).drop("__label", "__index")


class StringIndexer(Estimator):
    """Index of a value among the distinct values in alphabetical order; null, if present, is the first label."""

    def __init__(self, inputCol: str, outputCol: str, handleInvalid: str = "error") -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _fit(self, df: DataFrame) -> StringIndexerModel:
        labels = [r[0] for r in df.select(F.col(self.inputCol).cast("string")).distinct().collect()]
        ordered = sorted(labels, key=lambda x: (x is not None, x or ""))
        return StringIndexerModel(self.inputCol, self.outputCol, ordered, self.handleInvalid)


class IndexToString(Transformer):
    def __init__(self, inputCol: str, outputCol: str, labels: Sequence[str]) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _transform(self, df: DataFrame) -> DataFrame:
        names = F.array(*(F.lit(x).cast("string") for x in self.labels))
        return df.withColumn(self.outputCol, F.get(names, F.col(self.inputCol).cast("int")))


class OneHotEncoder(Estimator):
    """Array of 0/1 for indexes 0 to n - 1, n the number of distinct ones (less one with dropLast)."""

    def __init__(self, inputCol: str, outputCol: str, dropLast: bool = True) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _fit(self, df: DataFrame) -> Model:
        if not isinstance(df.schema[self.inputCol].dataType, NumericType):
            raise ValueError("OneHotEncoder takes a numeric index column")
        size = max(0, df.agg(F.count_distinct(self.inputCol)).first()[0] - bool(self.dropLast))
        return OneHotEncoderModel(self.inputCol, self.outputCol, size)


class StandardScaler(Estimator):
    """(x - mean) / sample deviation; 0 without spread."""

    def __init__(self, inputCol: str, outputCol: str, withMean: bool = True, withStd: bool = True) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _fit(self, df: DataFrame) -> Model:
        mean, std = df.agg(F.avg(self.inputCol), F.stddev(self.inputCol)).first()
        return ScalerModel(self.inputCol, self.outputCol, (mean or 0.0) if self.withMean else 0.0, (std or 0.0) if self.withStd else 1.0)


class MinMaxScaler(Estimator):
    """(x - min) / (max - min); 0 without spread."""

    def __init__(self, inputCol: str, outputCol: str) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _fit(self, df: DataFrame) -> Model:
        low, high = df.agg(F.min(self.inputCol), F.max(self.inputCol)).first()
        return ScalerModel(self.inputCol, self.outputCol, float(low or 0.0), float(high) - float(low) if high is not None else 0.0)


class MaxAbsScaler(Estimator):
    """x over the greatest magnitude; 0 if that is 0."""

    def __init__(self, inputCol: str, outputCol: str) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _fit(self, df: DataFrame) -> Model:
        most = df.agg(F.max(F.abs(self.inputCol))).first()[0]
        return ScalerModel(self.inputCol, self.outputCol, 0.0, float(most or 0.0))


class Imputer(Estimator):
    """Nulls by mean, median or mode (ties: the smallest); 0 if all are null."""

    def __init__(self, inputCol: str, outputCol: str, strategy: str = "mean") -> None:  # noqa: N803
        if strategy not in ("mean", "median", "mode"):
            raise ValueError(f"unknown strategy {strategy!r}")
        super().__init__(**given(locals()))

    def _fit(self, df: DataFrame) -> Model:
        if self.strategy == "mode":
            row = df.where(F.col(self.inputCol).isNotNull()).groupBy(self.inputCol).count().orderBy(F.desc("count"), self.inputCol).select(self.inputCol).first()
        else:
            row = df.agg(F.avg(self.inputCol)).first() if self.strategy == "mean" else exact_quantiles(df, self.inputCol, [0.5])
        return ImputerModel(self.inputCol, self.outputCol, float(row[0]) if row and row[0] is not None else 0.0)


class Binarizer(Transformer):
    """1.0 above the threshold, else (null too) 0.0."""

    def __init__(self, inputCol: str, outputCol: str, threshold: float = 0.0) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.outputCol, F.when(F.col(self.inputCol) > self.threshold, 1.0).otherwise(0.0))


class QuantileDiscretizer(Estimator):
    """Bucket by exact quantile cuts: i if x is below cut i, the last bucket for null."""

    def __init__(self, numBuckets: int, inputCol: str, outputCol: str) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _fit(self, df: DataFrame) -> Model:
        shares = [i / self.numBuckets for i in range(1, self.numBuckets)]
        cuts = [c for c in exact_quantiles(df, self.inputCol, shares) if c is not None]
        return QuantileDiscretizerModel(self.inputCol, self.outputCol, cuts)


class SQLTransformer(Transformer):
    """A statement over ``__THIS__``."""

    def __init__(self, statement: str) -> None:
        super().__init__(statement=statement)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.sql(self.statement.replace("__THIS__", "{__this}"), __this=df)
