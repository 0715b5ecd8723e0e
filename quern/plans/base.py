"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.frame import Frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(*tables: str, sql: str | None = None):
    """Registers a function of frames of the named tables under its own name."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            frames = [Frame(spark.read.parquet(f"{sf_dir}/{t}.parquet"), (("table", t),)) for t in tables]
            out = fn(*frames)
            return out.df if isinstance(out, Frame) else out

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap
