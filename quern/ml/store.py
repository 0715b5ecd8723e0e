"""Models whose state is plain values, kept as JSON rows of a table by name."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.ml.base import Model
from quern.ml.classification import LogisticRegressionModel
from quern.ml.feature import (
    Binarizer,
    ImputerModel,
    IndexToString,
    OneHotEncoderModel,
    QuantileDiscretizerModel,
    ScalerModel,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
)
from quern.ml.pipeline import PipelineModel
from quern.ml.regression import LinearRegressionModel

KINDS = {
    k.__name__: k
    for k in (
        LinearRegressionModel, LogisticRegressionModel, StringIndexerModel, ScalerModel, ImputerModel, OneHotEncoderModel,
        QuantileDiscretizerModel, Binarizer, IndexToString, SQLTransformer, VectorAssembler,
    )
}
SCHEMA = "model_id string, name string, kind string, state string, saved_at timestamp"


def _state(model: Model) -> dict:
    if isinstance(model, PipelineModel):
        return {"kind": "PipelineModel", "stages": [_state(s) for s in model.stages]}
    if type(model).__name__ not in KINDS:
        raise ValueError(f"{type(model).__name__} can't be stored")
    return {"kind": type(model).__name__, "params": model.extractParamMap()}


def _model(state: dict) -> Model:
    if state["kind"] == "PipelineModel":
        return PipelineModel([_model(s) for s in state["stages"]])
    return KINDS[state["kind"]](**state["params"])


class ModelStore:
    """A folder of Parquet files, one for each saved model; deletion marks a model."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder.rstrip("/")

    def save(self, model: Model, name: str) -> str:
        model_id, state = uuid.uuid4().hex, _state(model)
        row = self._spark.createDataFrame([(model_id, name, state["kind"], json.dumps(state))], "model_id string, name string, kind string, state string")
        row.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self._folder)
        return model_id

    def _live(self):
        rows = self._spark.read.schema(SCHEMA).parquet(self._folder)
        gone = rows.where("kind = 'deleted'").select("model_id")
        return rows.where("kind <> 'deleted'").join(gone, "model_id", "left_anti")

    def load(self, model_id: str) -> Model:
        return self._one(self._live().where(F.col("model_id") == model_id), model_id)

    def load_by_name(self, name: str) -> Model:
        """The one saved last under this name."""
        return self._one(self._live().where(F.col("name") == name).orderBy(F.desc("saved_at")), name)

    def _one(self, rows, what: str) -> Model:
        row = rows.select("state").first()
        if row is None:
            raise KeyError(what)
        return _model(json.loads(row[0]))

    def list_models(self):
        return self._live().select("model_id", "name", "kind", "saved_at")

    def delete_model(self, model_id: str) -> None:
        row = self._spark.createDataFrame([(model_id, None, "deleted", None)], "model_id string, name string, kind string, state string")
        row.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self._folder)
