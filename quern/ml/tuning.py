"""Parameter grids, cross-validation and a single held-out part."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from quern.ml.base import Estimator, Model, given
from quern.operators.reshape import random_split


class ParamGridBuilder:
    def __init__(self) -> None:
        self._grid: dict[str, list] = {}

    def addGrid(self, name: str, values: Sequence) -> ParamGridBuilder:  # noqa: N802
        self._grid[name] = list(values)
        return self

    def build(self) -> list[dict[str, object]]:
        return [dict(zip(self._grid, values, strict=True)) for values in itertools.product(*self._grid.values())]


class TunedModel(Model):
    def __init__(self, bestModel: Model, bestParams: Mapping, metrics: list[float]) -> None:  # noqa: N803
        super().__init__(bestParams=dict(bestParams), avgMetrics=metrics, validationMetrics=metrics)
        self.bestModel = bestModel

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.bestModel.transform(df)


class _Tuner(Estimator):
    def _splits(self, df: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
        raise NotImplementedError

    def _fit(self, df: DataFrame) -> TunedModel:
        grid, totals = list(self.estimatorParamMaps) or [{}], []
        splits = self._splits(df)
        for params in grid:
            scores = [self.evaluator.evaluate(self.estimator.fit(train, params or None).transform(test)) for train, test in splits]
            totals.append(sum(scores) / len(scores))
        best = (max if self.evaluator.isLargerBetter() else min)(range(len(grid)), key=totals.__getitem__)
        return TunedModel(self.estimator.fit(df, grid[best] or None), grid[best], totals)


class CrossValidator(_Tuner):
    """Folds by a seeded hash of the row."""

    def __init__(self, estimator: Estimator, estimatorParamMaps: Sequence[Mapping], evaluator, numFolds: int = 3, seed: int = 0) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _splits(self, df: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
        folds = random_split(df, [1.0] * self.numFolds, self.seed)
        out = []
        for i, test in enumerate(folds):
            rest = [f for j, f in enumerate(folds) if j != i]
            train = rest[0]
            for other in rest[1:]:
                train = train.unionAll(other)
            out.append((train, test))
        return out


class TrainValidationSplit(_Tuner):
    def __init__(self, estimator: Estimator, estimatorParamMaps: Sequence[Mapping], evaluator, trainRatio: float = 0.75, seed: int = 0) -> None:  # noqa: N803
        super().__init__(**given(locals()))

    def _splits(self, df: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
        return [tuple(random_split(df, [self.trainRatio, 1 - self.trainRatio], self.seed))]
