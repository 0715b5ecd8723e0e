"""Types: Spark's own under one name."""

from pyspark.sql.types import (  # noqa: F401
    ArrayType,
    BinaryType,
    BooleanType,
    ByteType,
    CharType,
    DataType,
    DateType,
    DayTimeIntervalType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    NullType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
    VarcharType,
)
