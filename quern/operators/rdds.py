"""RDD helpers where they differ from Spark's; everything else is the RDD's own."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark import RDD
from pyspark.sql import SparkSession

from quern.frame import Frame


class Rdd:
    def __init__(self, rdd: RDD, spark: SparkSession) -> None:
        self.rdd, self._spark = rdd, spark

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        found = getattr(self.rdd, name)
        if not callable(found):
            return found

        def call(*args, **kwargs):
            out = found(*(a.rdd if isinstance(a, Rdd) else a for a in args), **kwargs)
            return Rdd(out, self._spark) if isinstance(out, RDD) else out

        return call

    def sample(self, withReplacement: bool, fraction: float, seed: int | None = None) -> Rdd:  # noqa: N803
        """Exactly int(count * fraction) elements without replacement; elsewise Spark's sample.

        Elements are ranked by a seeded random key that is sorted across the cluster.
        """
        if withReplacement:
            return Rdd(self.rdd.sample(True, fraction, seed), self._spark)
        n, key = int(self.rdd.count() * fraction), 0 if seed is None else seed
        numbered = self.rdd.zipWithIndex().map(lambda x: (_scatter(x[1], key), x[0]))
        ranked = numbered.sortByKey().zipWithIndex()
        return Rdd(ranked.filter(lambda x: x[1] < n).map(lambda x: x[0][1]), self._spark)

    def takeOrdered(self, n: int, key: Callable | None = None, ascending: bool = True) -> list:  # noqa: N802
        return self.rdd.takeOrdered(n, key) if ascending else self.rdd.top(n, key)

    def first(self):
        if self.rdd.isEmpty():
            raise IndexError("the RDD is empty")
        return self.rdd.first()

    def toDF(self, schema=None) -> Frame:  # noqa: N802
        """Rows from tuples, dicts or plain values; names are col_0, col_1, ... or value."""
        one = self.first()
        if isinstance(one, Mapping):
            names = list(one)
            rows = self.rdd.map(lambda d: tuple(d.get(n) for n in names))
            return Frame(self._spark.createDataFrame(rows, schema or names))
        if isinstance(one, (list, tuple)):
            return Frame(self._spark.createDataFrame(self.rdd.map(tuple), schema or [f"col_{i}" for i in range(len(one))]))
        return Frame(self._spark.createDataFrame(self.rdd.map(lambda x: (x,)), schema or ["value"]))


def _scatter(index: int, seed: int) -> int:
    """A bijection of 64-bit numbers that orders indexes at random."""
    x = (index + (seed + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    return x ^ (x >> 31)


class Context:
    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark

    def parallelize(self, data, numSlices: int | None = None) -> Rdd:  # noqa: N803
        return Rdd(self._spark.sparkContext.parallelize(data, numSlices), self._spark)

    def textFile(self, path: str, minPartitions: int | None = None) -> Rdd:  # noqa: N802, N803
        return Rdd(self._spark.sparkContext.textFile(path, minPartitions), self._spark)

    def broadcast(self, value):
        return self._spark.sparkContext.broadcast(value)

    def accumulator(self, value=0):
        return self._spark.sparkContext.accumulator(value)
