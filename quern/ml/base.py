"""Parameters, transformers, estimators and models."""

from __future__ import annotations

import copy
import inspect
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from quern.frame import Frame, unwrap


class Params:
    """Constructor arguments as parameters: attributes, getX(), setX(value), explainParams()."""

    def __init__(self, **params) -> None:
        self._params = dict(params)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        params = self.__dict__.get("_params", {})
        if name in params:
            return params[name]
        stem = name[3:4].lower() + name[4:]
        if name[:3] == "get" and stem in params:
            return lambda: params[stem]
        if name[:3] == "set" and stem in params:
            return lambda value: self.set(stem, value)
        raise AttributeError(name)

    def set(self, name: str, value) -> Params:
        if name not in self._params:
            raise ValueError(f"{type(self).__name__} has no parameter {name!r}")
        self._params[name] = value
        return self

    def getOrDefault(self, name: str):  # noqa: N802
        return self._params[name]

    def hasParam(self, name: str) -> bool:  # noqa: N802
        return name in self._params

    def extractParamMap(self) -> dict[str, object]:  # noqa: N802
        return dict(self._params)

    def explainParams(self) -> str:  # noqa: N802
        return "\n".join(f"{k}: {v!r}" for k, v in sorted(self._params.items()))

    def copy(self, extra: Mapping[str, object] | None = None):
        out = copy.copy(self)
        out._params = {**self._params, **(extra or {})}
        return out


class Transformer(Params):
    def transform(self, df: Frame | DataFrame):
        """The same kind of frame as given, with the output columns added."""
        out = self._transform(unwrap(df))
        return df._next(out, type(self).__name__) if isinstance(df, Frame) else out

    def _transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


class Model(Transformer):
    pass


class Estimator(Params):
    def fit(self, df: Frame | DataFrame, params: Mapping[str, object] | Sequence[Mapping[str, object]] | None = None):
        if isinstance(params, (list, tuple)):
            return [self.copy(p)._fit(unwrap(df)) for p in params]
        return (self.copy(params) if params else self)._fit(unwrap(df))

    def _fit(self, df: DataFrame) -> Model:
        raise NotImplementedError


def features_of(features: str | Sequence[str]) -> list[str]:
    """A vector here is a list of column names; names may be joined by commas."""
    return [c.strip() for c in features.split(",")] if isinstance(features, str) else list(features)


def given(values: Mapping) -> dict:
    """Arguments of a constructor, without self."""
    return {k: v for k, v in values.items() if k not in ("self", "__class__")}


def signature_of(kind: type) -> list[str]:
    return [p for p in inspect.signature(kind.__init__).parameters if p != "self"]
