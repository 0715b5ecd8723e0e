"""What functions there are, how tables lie, and whether the environment works."""

from __future__ import annotations

import argparse
import inspect
import os
import platform
import sys
from collections.abc import Iterable
from dataclasses import dataclass

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import functions as Q
from quern.frame import unwrap

#: Columns of at most this many values, or this share of the rows, suit partitions.
FEW_VALUES, FEW_SHARE = 100, 0.1


@dataclass(frozen=True)
class FunctionDefinition:
    name: str
    category: str
    engine: str
    native: bool
    doc: str


_CATEGORIES = {
    "window": ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead", "first_value", "last_value", "nth_value"),
    "aggregate": ("sum", "avg", "mean", "count", "min", "max", "std", "stddev", "stddev_samp", "stddev_pop", "variance", "var", "var_samp", "var_pop", "count_distinct", "countDistinct", "sum_distinct", "sumDistinct", "approx_count_distinct", "bool_and", "bool_or", "every", "any", "some", "count_if", "first", "last", "max_by", "min_by", "skewness", "kurtosis", "covar_samp", "covar_pop", "corr", "median", "percentile", "quantile", "percentile_approx", "approx_percentile", "collect_list", "collect_set"),
}


def _registry() -> dict[str, FunctionDefinition]:
    out = {}
    for name in dir(Q):
        fn = getattr(Q, name)
        if name.startswith("_") or not inspect.isfunction(fn):
            continue
        native = fn.__module__.startswith("pyspark")
        category = next((c for c, names in _CATEGORIES.items() if name in names), "scalar")
        out[name] = FunctionDefinition(name, category, "catalyst", native, (inspect.getdoc(fn) or "").split("\n")[0])
    return out


def list_functions(category: str | None = None) -> list[FunctionDefinition]:
    return [d for _, d in sorted(_registry().items()) if category in (None, d.category)]


def get_function(name: str) -> FunctionDefinition | None:
    return _registry().get(name)


def explain_function(name: str) -> str:
    found = get_function(name)
    if found is None:
        return f"{name}: unknown"
    return f"{name} ({found.category}): {'native' if found.native else 'defined here over native expressions'}. {found.doc}"


def generate_compatibility_markdown() -> str:
    rows = "\n".join(f"| {d.name} | {d.category} | {'native' if d.native else 'composed'} |" for d in list_functions())
    return f"| function | category | form |\n|-|-|-|\n{rows}\n"


def generate_migration_markdown() -> str:
    """Functions whose definition differs from the native one of that name."""
    rows = "\n".join(f"| {d.name} | {d.doc} |" for d in list_functions() if not d.native)
    return f"| function | here |\n|-|-|\n{rows}\n"


def table_stats(df: DataFrame) -> dict[str, object]:
    df = unwrap(df)
    plan = df._jdf.queryExecution().optimizedPlan()
    return {"rows": df.count(), "columns": len(df.columns), "bytes": int(str(plan.stats().sizeInBytes()))}


def suggest_layout(df: DataFrame, filtered: Iterable[str] = (), equal: Iterable[str] = (), grouped: Iterable[str] = (), ordered: Iterable[str] = ()) -> dict[str, list[str]]:
    """Columns to partition by (equality, few values) and to bucket or sort by (other keys)."""
    df, equal = unwrap(df), list(dict.fromkeys(equal))
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(equal))).first()
    few = [c for i, c in enumerate(equal) if counts[f"d{i}"] <= max(FEW_VALUES, FEW_SHARE * counts["n"])]
    keys = [c for c in dict.fromkeys([*filtered, *grouped, *ordered]) if c not in few]
    return {"partition_by": few, "bucket_or_sort_by": keys}


def run(args: list[str] | None = None) -> int:
    """Prints versions and settings and runs a small job; 0 if it works."""
    parser = argparse.ArgumentParser(description="check the environment")
    parser.add_argument("--master", default="local[2]")
    master = parser.parse_args(args).master
    print(f"python {platform.python_version()} at {sys.executable}")
    print(f"pyspark {pyspark.__version__}, JAVA_HOME {os.environ.get('JAVA_HOME', 'not set')}")
    spark = SparkSession.getActiveSession() or SparkSession.builder.master(master).config("spark.ui.enabled", "false").getOrCreate()
    for key in ("spark.sql.ansi.enabled", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        print(f"{key} = {spark.conf.get(key)}")
    fine = spark.range(10).agg(F.sum("id")).first()[0] == 45
    print("ok" if fine else "a small job gave a wrong result")
    return int(not fine)


if __name__ == "__main__":
    sys.exit(run())
