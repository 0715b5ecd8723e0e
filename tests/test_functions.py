import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern import functions as Q
from quern.functions.udfs import type_of
from quern.types import ArrayType, DoubleType, LongType, StringType


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def agg(spark, rows, schema, *columns):
    return tuple(spark.createDataFrame(rows, schema).agg(*columns).first())


@pytest.mark.parametrize("values", [[1.0, 2.0, 4.0, 9.0, 20.0], [1.0, 1.0, 1.0, 1.0], [1.0, 2.0], [], [3.0], [1e9, 1e9 + 1, 1e9 + 5, 1e9 + 9]])
def test_moments_match_pandas(spark, values):
    s, k = agg(spark, [(v,) for v in values], "x double", Q.skewness("x"), Q.kurtosis("x"))
    series = pd.Series(values, dtype=float)
    for ours, theirs in ((s, series.skew()), (k, series.kurt())):
        assert ours is None if np.isnan(theirs) else ours == pytest.approx(theirs, abs=1e-5)


def test_corr(spark):
    rows = [(1.0, 2.0), (2.0, 4.0), (3.0, 7.0), (None, 1.0)]
    assert agg(spark, rows, "a double, b double", Q.corr("a", "b"))[0] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1])
    assert agg(spark, [(1.0, 2.0), (1.0, 3.0)], "a double, b double", Q.corr("a", "b"))[0] is None
    assert agg(spark, [], "a double, b double", Q.corr("a", "b"))[0] is None


def test_corr_of_equal_values_in_several_partitions(spark):
    """187 values of 3.0 a partition: 3.0 / 187 * 187 isn't 3.0, so merged sums have a rest of spread."""
    rows = spark.range(0, 2 * 187, 1, 2).union(spark.range(7)).select(F.lit(3.0).alias("a"), F.col("id").cast("double").alias("b"), F.lit(float("nan")).alias("c"))
    found = rows.agg(Q.corr("a", "b"), Q.corr("b", "a"), Q.corr("b", "b"), Q.corr("b", "c")).first()
    assert found[0] is None and found[1] is None and found[2] == pytest.approx(1.0) and np.isnan(found[3])


def test_percentiles(spark):
    rows = [(float(x),) for x in (1, 2, 3, 4, 10)]
    assert agg(spark, rows, "x double", Q.median("x"), Q.percentile("x", 0.25), Q.percentile_approx("x", 0.1)) == (3.0, 2.0, pytest.approx(1.4))
    with pytest.raises(ValueError):
        Q.percentile("x", 1.5)


def test_distinct_and_extremes(spark):
    rows = [(1, None), (1, None), (1, 2), (None, None)]
    assert agg(spark, rows, "a int, b int", Q.count_distinct("a", "b"), Q.count_distinct("a")) == (3, 1)
    rows = [(None, 9), ("x", 1), ("y", 5)]
    assert agg(spark, rows, "v string, k int", Q.max_by("v", "k"), Q.min_by("v", "k"), Q.first("v")) == ("y", "x", "x")
    assert agg(spark, [], "v int", Q.count_if(F.col("v") > 1)) == (0,)


def test_strings(spark):
    assert one(spark, Q.eq(F.lit(None).cast("int"), None)) and one(spark, Q.ne(F.lit(1), None)) and not one(spark, Q.eq(F.lit(1), 2))
    assert one(spark, Q.elt(2, F.lit("a"), F.lit("b"))) == "b" and one(spark, Q.elt(5, F.lit("a"))) is None and one(spark, Q.elt(0, F.lit("a"))) is None
    assert one(spark, Q.charindex("l", F.lit("hello"), 4)) == 4 and one(spark, Q.charindex("z", F.lit("hello"))) == 0
    with pytest.raises(ValueError):
        Q.charindex("a", "b", 0)
    assert one(spark, Q.lpad(F.lit("ab"), 5, "")) == "ab" and one(spark, Q.lpad(F.lit("abc"), 2)) == "ab"
    assert one(spark, Q.space(3)) == "   " and one(spark, Q.regexp_extract(F.lit("ab12"), "[0-9]+")) == "12" and one(spark, Q.regexp_extract(F.lit("ab"), "[0-9]+")) == ""
    assert one(spark, Q.startswith(F.lit("a%c"), "a%")) is True and one(spark, Q.startswith(F.lit("abc"), "a%")) is False
    assert one(spark, Q.split_flat(F.lit("a1b2c"), "[0-9]")) == "a,b,c"
    assert one(spark, Q.soundex(F.lit("Tymczak"))) == "T522" and one(spark, Q.initcap(F.lit("aB cD"))) == "Ab Cd"
    assert one(spark, Q.parse_url(F.lit("http://h.com/p?a=1#f"), "HOST")) == "h.com" and one(spark, Q.parse_url_key(F.lit("http://h.com/p?a=1"), "QUERY", "a")) == "1"
    assert one(spark, Q.parse_url(F.lit("http://[bad"), "HOST")) is None
    assert one(spark, Q.find_in_set(F.lit("b"), F.lit("a,b"))) == 2 and one(spark, Q.concat_ws("-", F.lit("a"), F.lit(None), F.lit("b"))) == "a-b"
    assert one(spark, Q.bit_length(F.lit("é"))) == 16 and one(spark, Q.sha2(F.lit("a"), 0)) == one(spark, Q.sha2(F.lit("a"), 256))
    assert one(spark, Q.conv(F.lit("-1"), 10, 16)) == "FFFFFFFFFFFFFFFF"


def test_math(spark):
    assert one(spark, Q.divide(F.lit(1.0), F.lit(0.0))) is None and one(spark, Q.mod(F.lit(1), F.lit(0))) is None
    assert one(spark, Q.width_bucket(F.lit(5.0), 10.0, 0.0, 5)) == 0 and one(spark, Q.width_bucket(F.lit(5.0), 0.0, 10.0, 5)) == 3
    assert one(spark, Q.pmod(F.lit(-7), F.lit(3))) == 2 and one(spark, Q.round(F.lit(2.675), 2)) == 2.68
    assert np.isnan(one(spark, Q.asin(F.lit(2.0)))) and 3.0 <= one(spark, Q.uniform(1, 3, 4)) < 4.0


def test_dates(spark):
    day = F.lit("2024-02-29").cast("date")
    assert one(spark, Q.trunc(day, "mm")) == datetime.date(2024, 2, 1) and one(spark, Q.trunc(day, "quarter")) == datetime.date(2024, 1, 1)
    assert one(spark, Q.to_date(F.lit("31/12/2023"), "DD/MM/YYYY")) == datetime.date(2023, 12, 31) and one(spark, Q.to_date(F.lit("x"))) is None
    assert Q.java_pattern("YYYY-MM-DD HH24:MI:SS") == "yyyy-MM-dd HH:mm:ss" and Q.java_pattern("yyyy/MM") == "yyyy/MM"
    assert one(spark, Q.months_between(F.lit("2024-02-29 10:00:00").cast("timestamp"), F.lit("2024-01-31").cast("timestamp"))) == 1.0
    assert one(spark, Q.timestampdiff("MONTH", F.to_timestamp(F.lit("2024-01-31")), F.to_timestamp(F.lit("2024-02-29")))) == 0
    assert one(spark, Q.extract("year", day)) == 2024
    for bad in (lambda: Q.extract("era", day), lambda: Q.trunc(day, "hour"), lambda: Q.timestampdiff("EON", day, day)):
        with pytest.raises(ValueError):
            bad()
    assert one(spark, Q.next_day(day, "Mon")) == datetime.date(2024, 3, 4) and one(spark, Q.date_sub(day, 1)) == datetime.date(2024, 2, 28)


def test_windows(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "k int, v int")
    w = Window.partitionBy("k").orderBy("v")
    out = rows.select(Q.last_value("v").over(Q.whole(w)).alias("l"), Q.nth_value("v", 2).over(Q.whole(w)).alias("n")).collect()
    assert {tuple(r) for r in out} == {(3, 2)}


def test_stack_and_explode(spark):
    rows = spark.createDataFrame([(1, 2)], "a int, b int")
    assert [tuple(r) for r in rows.select(Q.stack(2, "x", "a", "y", "b")).collect()] == [("x", 1), ("y", 2)]
    with pytest.raises(ValueError):
        Q.stack(2, "x", "a")
    assert spark.range(1).select(Q.explode(F.lit("a,b"))).count() == 2


def test_udfs(session):
    @session.udf.register("twice")
    def twice(x: int) -> int:
        return 2 * x

    @Q.udf
    def thrice(x: float) -> float:
        return 3 * x

    row = session.sql("SELECT twice(4) AS a, thrice(2.0D) AS b").first()
    assert tuple(row) == (8, 6.0) and session.udf.execute_fallback("twice", 5) == 10 and not session.udf.is_pushdown("twice") and session.udf.is_pushdown("upper")
    assert type_of(int) == LongType() and type_of(float | None) == DoubleType() and type_of(list[int]) == ArrayType(LongType()) and type_of(object) == StringType()
    with pytest.raises(KeyError):
        session.udf.execute_fallback("nothing")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=12))
def test_median_equals_numpy(spark, values):
    assert agg(spark, [(float(v),) for v in values], "x double", Q.median("x"))[0] == pytest.approx(float(np.median(values)))
