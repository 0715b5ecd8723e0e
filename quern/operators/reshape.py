"""Deduplication, splits and wide-to-long reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """First row of each key in the order of all columns; all columns: distinct rows.

    A least row is kept where the rows lie before any are shuffled, so a key
    that holds much of the table sends one row a task.
    """
    if not subset:
        return df.distinct()
    keys = df.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(subset)), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    return keys.groupBy(*(f"k{i}" for i in range(len(subset)))).agg(F.min("row").alias("row")).select("row.*")


def random_split(df: DataFrame, weights: Sequence[float], seed: int | None = None) -> list[DataFrame]:
    """Disjoint parts by a seeded hash of the whole row, so recomputation can't move a row."""
    if not weights or any(w < 0 for w in weights) or not sum(weights) > 0:
        raise ValueError("weights must be zero or more, and some above zero")
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed or 0), *(F.col(f"`{c}`") for c in df.columns)), 11) / F.lit(float(1 << 53))
    keyed, total, low, parts = df.withColumn("__u", unit), float(sum(weights)), 0.0, []
    for i, weight in enumerate(weights):
        high = low + weight / total
        inside = F.col("__u") >= low if i == len(weights) - 1 else (F.col("__u") >= low) & (F.col("__u") < high)
        parts.append(keyed.where(inside).drop("__u"))
        low = high
    return parts


def _known(df: DataFrame, cols: Sequence[str]) -> None:
    if missing := [c for c in cols if c not in df.columns]:
        raise ValueError(f"no column {missing[0]!r}")


def unpivot(df: DataFrame, label: str, value: str, cols: Sequence[str]) -> DataFrame:
    """Columns ``cols`` as rows (label, value, other columns) from one scan."""
    _known(df, cols)
    others = [c for c in df.columns if c not in cols]
    return df.unpivot(others, list(cols), label, value).select(label, value, *others)


def melt(df: DataFrame, id_vars: Sequence[str] | None, value_vars: Sequence[str] | None, var_name: str, value_name: str) -> DataFrame:
    ids = list(id_vars or [c for c in df.columns if c not in (value_vars or ())]) if id_vars or value_vars else []
    values = list(value_vars or [c for c in df.columns if c not in ids])
    _known(df, [*ids, *values])
    return df.unpivot(ids, values, var_name, value_name)


def stack(df: DataFrame, labelled: Mapping[str, str]) -> DataFrame:
    """Rows (_label, _value, other columns) from {label: column}."""
    _known(df, list(labelled.values()))
    others = [c for c in df.columns if c not in labelled.values()]
    cells = [cell for label, column in labelled.items() for cell in (F.lit(label), F.col(column))]
    return df.select(F.stack(F.lit(len(labelled)), *cells).alias("_label", "_value"), *others)


def explode_text(df: DataFrame, column: str) -> DataFrame:
    parts = df.withColumn(column, F.explode(F.split(F.col(column), ","))).withColumn(column, F.trim(column))
    return parts.where(F.col(column) != "")
