"""User-defined functions: types from annotations and a small registry."""

from __future__ import annotations

import datetime
import decimal
import inspect
import types
import typing
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    LongType,
    MapType,
    StringType,
    TimestampType,
)

#: Python annotations and their types; anything else is a string.
PLAIN = {str: StringType(), int: LongType(), float: DoubleType(), bool: BooleanType(), bytes: BinaryType(), datetime.datetime: TimestampType(), datetime.date: DateType(), decimal.Decimal: DecimalType(38, 18)}


def type_of(annotation: object) -> DataType:
    """The Spark type of an annotation; optional types are unwrapped."""
    if isinstance(annotation, DataType):
        return annotation
    if isinstance(annotation, str):
        names = {k.__name__: v for k, v in PLAIN.items()} | {"list": ArrayType(StringType()), "dict": MapType(StringType(), StringType())}
        return names.get(annotation.split("|")[0].strip(), StringType())
    origin, args = typing.get_origin(annotation), typing.get_args(annotation)
    if origin in (typing.Union, types.UnionType):
        return type_of(next(a for a in args if a is not type(None)))
    if annotation is list or origin is list:
        return ArrayType(type_of(args[0]) if args else StringType())
    if annotation is dict or origin is dict:
        return MapType(type_of(args[0]) if args else StringType(), type_of(args[1]) if args else StringType())
    return PLAIN.get(annotation, StringType())


class Functions:
    """Named functions of a session, for SQL text and for columns."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._local: dict[str, Callable] = {}

    def register(self, name: str, fn: Callable | None = None, returnType: object = None):  # noqa: N803
        """As a call or as a decorator; ``returnType`` outweighs the annotation."""
        if fn is None:
            return lambda f: self.register(name, f, returnType)
        kind = returnType or type_of(inspect.signature(fn).return_annotation)
        self._local[name] = fn
        return self._spark.udf.register(name, fn, kind)

    def register_vectorized(self, name: str, fn: Callable, returnType: object):  # noqa: N803
        """A function of pandas Series, run on Arrow batches."""
        wrapped = F.pandas_udf(fn, returnType)
        self._local[name] = fn
        return self._spark.udf.register(name, wrapped)

    def call(self, name: str, *columns: Column | str) -> Column:
        return F.call_function(name, *(F.col(c) if isinstance(c, str) else c for c in columns))

    def execute_fallback(self, name: str, *args: object) -> object:
        """Runs the Python function here, on plain values."""
        if name not in self._local:
            raise KeyError(name)
        return self._local[name](*args)

    def is_pushdown(self, name: str) -> bool:
        """True for names that Spark evaluates without Python."""
        return name not in self._local and self._spark.catalog.functionExists(name)
