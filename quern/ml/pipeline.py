"""Stages fit and applied in turn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from quern.ml.base import Estimator, Model, Transformer


class PipelineModel(Model):
    def __init__(self, stages: Sequence[Transformer]) -> None:
        super().__init__(stages=list(stages))

    def _transform(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = stage.transform(df)
        return df


class Pipeline(Estimator):
    def __init__(self, stages: Sequence[Estimator | Transformer]) -> None:
        super().__init__(stages=list(stages))

    def _fit(self, df: DataFrame) -> PipelineModel:
        done = []
        for i, stage in enumerate(self.stages):
            done.append(stage.fit(df) if isinstance(stage, Estimator) else stage)
            if i < len(self.stages) - 1:
                df = done[-1].transform(df)
        return PipelineModel(done)
