"""Session: the entry point over a SparkSession."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.frame import Frame, unwrap
from quern.functions.udfs import Functions

_active: Session | None = None


def get_active_session() -> Session | None:
    """The session set last, or one over Spark's active session."""
    if _active is not None:
        return _active
    spark = SparkSession.getActiveSession()
    return Session(spark) if spark else None


def set_active_session(session: Session | None) -> None:
    global _active
    _active = session


class Catalog:
    """Names of tables and views."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark

    def listTables(self, dbName: str | None = None) -> list[str]:  # noqa: N802, N803
        return sorted(t.name for t in self._spark.catalog.listTables(dbName))

    def tableExists(self, tableName: str, dbName: str | None = None) -> bool:  # noqa: N802, N803
        return self._spark.catalog.tableExists(f"{dbName}.{tableName}" if dbName else tableName)


class Builder:
    """Fluent settings; ``getOrCreate`` builds the Spark session."""

    def __init__(self) -> None:
        self._settings: dict[str, object] = {}
        self._master: str | None = None
        self._name = "quern"

    def master(self, value: str) -> Builder:
        self._master = value
        return self

    def appName(self, value: str) -> Builder:  # noqa: N802
        self._name = value
        return self

    def config(self, key: str, value: object) -> Builder:
        self._settings[key] = value
        return self

    def getOrCreate(self) -> Session:  # noqa: N802
        builder = SparkSession.builder.appName(self._name)
        builder = builder.master(self._master) if self._master else builder
        for key, value in self._settings.items():
            builder = builder.config(key, value)
        session = Session(builder.getOrCreate())
        set_active_session(session)
        return session


class _BuilderProperty:
    def __get__(self, instance, owner) -> Builder:
        return Builder()


class Session:
    """Tables, SQL text, readers, functions and settings of one Spark session."""

    builder = _BuilderProperty()

    def __init__(self, spark: SparkSession | None = None) -> None:
        self.spark = spark or SparkSession.builder.getOrCreate()
        self._settings: dict[str, object] = {}
        self._views: list[str] = []
        self.metrics: list[dict[str, object]] = []
        self._udf = Functions(self.spark)

    def table(self, name: str) -> Frame:
        return Frame(self.spark.table(name), (("table", name),))

    def sql(self, query: str, **frames: Frame | DataFrame) -> Frame:
        """SQL text; ``{name}`` stands for a frame given by name.  Lazy."""
        began = time.perf_counter()
        df = self.spark.sql(query, **{k: unwrap(v) for k, v in frames.items()}) if frames else self.spark.sql(query)
        if self._settings.get("observability"):
            self.metrics.append({"query": query, "elapsed_ms": (time.perf_counter() - began) * 1000})
        return Frame(df, (("sql", query),))

    def createDataFrame(self, data, schema=None, infer_numbers: bool = False) -> Frame:  # noqa: N802
        """From pandas, Arrow, polars or dask frames, tuples or dicts.

        ``infer_numbers``: text columns that hold only numbers become numbers.
        """
        if hasattr(data, "compute"):
            data = data.compute()
        if hasattr(data, "to_arrow"):
            data = data.to_arrow()
        if isinstance(data, Sequence) and data and isinstance(data[0], Mapping):
            names = list(dict.fromkeys(k for row in data for k in row)) if schema is None else list(schema.names if hasattr(schema, "names") else schema)
            if unknown := {k for row in data for k in row} - set(names):
                raise ValueError(f"unknown column {sorted(unknown)[0]!r}")
            rows = [tuple(row.get(n) for n in names) for row in data]
            df = self.spark.createDataFrame(rows, schema if hasattr(schema, "fields") else names)
        else:
            df = self.spark.createDataFrame(data, schema)
        return Frame(_numbers(df) if infer_numbers else df)

    @property
    def read(self):
        from quern.sources.readers import Readers

        return Readers(self)

    @property
    def udf(self) -> Functions:
        return self._udf

    @property
    def catalog(self) -> Catalog:
        return Catalog(self.spark)

    @property
    def sparkContext(self):  # noqa: N802
        from quern.operators.rdds import Context

        return Context(self.spark)

    @property
    def foreign(self):
        from quern.sources.foreign import ForeignTables

        return ForeignTables(self)

    def config(self, key: str, value: object = None) -> object:
        """Reads a setting, or sets it; ``observability`` records each SQL text in ``metrics``."""
        if value is None:
            return self._settings.get(key, self.spark.conf.get(key, None))
        self._settings[key] = value
        if key.startswith("spark."):
            self.spark.conf.set(key, value)
        return value

    def track_view(self, name: str) -> None:
        self._views.append(name)

    def close(self) -> None:
        """Drops the temporary views made through this session; Spark goes on."""
        for name in self._views:
            self.spark.catalog.dropTempView(name)
        self._views.clear()
        if get_active_session() is self:
            set_active_session(None)


def _numbers(df: DataFrame) -> DataFrame:
    """Text columns whose values are all numbers as long or double, found in one pass."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not texts:
        return df
    whole = [F.bool_and(F.coalesce(F.col(c).try_cast("long").isNotNull(), F.lit(False)) | F.col(c).isNull()).alias(f"i{i}") for i, c in enumerate(texts)]
    real = [F.bool_and(F.col(c).try_cast("double").isNotNull() | F.col(c).isNull()).alias(f"d{i}") for i, c in enumerate(texts)]
    row = df.agg(*whole, *real).first()
    kinds = {c: "long" if row[f"i{i}"] else "double" for i, c in enumerate(texts) if row[f"d{i}"]}
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}) if kinds else df
