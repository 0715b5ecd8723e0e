"""Replacement of values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType


def _fits(value: object, kind: DataType) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, NumericType)
    return isinstance(kind, StringType)


def replace(df: DataFrame, to_replace, value=None, subset: Sequence[str] | None = None) -> DataFrame:
    """Values by a scalar, a dict or parallel lists, in columns whose type fits the old value."""
    if isinstance(to_replace, Mapping):
        pairs = list(to_replace.items())
    elif isinstance(to_replace, (list, tuple)):
        values = value if isinstance(value, (list, tuple)) else [value] * len(to_replace)
        if len(values) != len(to_replace):
            raise ValueError("as many replacements as values are needed")
        pairs = list(zip(to_replace, values, strict=True))
    else:
        pairs = [(to_replace, value)]
    if missing := set(subset or ()) - set(df.columns):
        raise ValueError(f"no column {sorted(missing)[0]!r}")
    changed = {}
    for field in df.schema.fields:
        if subset and field.name not in subset:
            continue
        column, out = F.col(f"`{field.name}`"), None
        for old, new in pairs:
            if _fits(old, field.dataType):
                out = (F if out is None else out).when(column == F.lit(old), F.lit(new).cast(field.dataType))
        if out is not None:
            changed[field.name] = out.otherwise(column)
    return df.withColumns(changed) if changed else df
