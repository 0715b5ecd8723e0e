"""Descriptive statistics, cross tables and frequencies."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Bins of a narrowing histogram, and how many values are few enough to bring to the driver.
BINS, FEW = 1024, 10_000


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float | None]:
    """Interpolated quantiles of a whole column, exact at any size.

    The order statistics are found by histograms that narrow around all of
    them at once; no task or driver holds more than BINS counts or FEW values
    for each, where an aggregate would hold every distinct value.  Nulls and
    NaNs take no part; an empty column gives None.
    """
    if any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities must lie in [0, 1]")
    x = df.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    n, low, high = x.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(probabilities)
    ranks = {r for p in probabilities for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}
    found: dict[int, float] = {}
    open_ = {r: (low, high, 0, n) for r in ranks}  # range, values below it, values in it
    while open_:
        spans = sorted({(lo, hi, below, size) for lo, hi, below, size in open_.values()})
        for lo, hi, below, size in spans:
            if lo == hi:
                found.update((r, lo) for r, s in open_.items() if s[:2] == (lo, hi))
            elif size <= FEW:
                values = sorted(r[0] for r in x.where(F.col("x").between(lo, hi)).collect())
                found.update((r, values[r - below]) for r, s in open_.items() if s[:2] == (lo, hi))
        open_ = {r: s for r, s in open_.items() if r not in found}
        wide = sorted({s[:2] for s in open_.values()})
        if not wide:
            break
        cells = [F.when(F.col("x").between(lo, hi), F.struct(F.lit(i).alias("i"), F.least(F.floor((F.col("x") - lo) / ((hi - lo) / BINS)), F.lit(BINS - 1)).alias("b"))) for i, (lo, hi) in enumerate(wide)]
        one = x.select("x", F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c"))
        bins = one.groupBy("c.i", "c.b").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        narrowed = {}
        for rank, (lo, hi, below, _) in open_.items():
            at = below
            for cell in sorted((c for c in bins if c["i"] == wide.index((lo, hi))), key=lambda c: c["b"]):
                if rank < at + cell["n"]:
                    narrowed[rank] = (cell["lo"], cell["hi"], at, cell["n"])
                    break
                at += cell["n"]
        open_ = narrowed
    out = []
    for p in probabilities:
        at = p * (n - 1)
        a, b = found[math.floor(at)], found[math.ceil(at)]
        out.append(a + (b - a) * (at - math.floor(at)))
    return out


def _statistic(name: str, column: str, numeric: bool) -> Column:
    plain = {"count": F.count, "min": F.min, "max": F.max}
    if name in plain:
        return plain[name](column).cast("string")
    if not numeric:
        return F.lit(None).cast("string")
    if name in ("mean", "stddev"):
        return (F.avg if name == "mean" else F.stddev)(column).cast("string")
    if name.endswith("%"):
        return F.percentile(column, float(name[:-1]) / 100).cast("string")
    raise ValueError(f"unknown statistic {name!r}")


def summarize(df: DataFrame, columns: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """One row for each statistic, from one aggregation."""
    numeric = {f.name: isinstance(f.dataType, NumericType) for f in df.schema.fields}
    rows = [F.struct(F.lit(s).alias("summary"), *(_statistic(s, c, numeric[c]).alias(c) for c in columns)) for s in stats]
    return df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts of each pair: one row for each value of ``row``, one column for each of ``col``."""
    text = df.select(F.coalesce(F.col(row).cast("string"), F.lit("null")).alias(f"{row}_{col}"), F.coalesce(F.col(col).cast("string"), F.lit("null")).alias("__c"))
    values = sorted(r[0] for r in text.select("__c").distinct().collect())
    return text.groupBy(f"{row}_{col}").pivot("__c", values).count().fillna(0)


def frequent(df: DataFrame, cols: Sequence[str], support: int = 1) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= support)
