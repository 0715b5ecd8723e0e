"""Frame: a Spark DataFrame under this library's naming and conventions.

Every method builds on the DataFrame API and stays lazy; whatever isn't defined
here is the DataFrame's own method, wrapped.  ``frame.df`` is the DataFrame.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quern.operators import nulls, reshape, statistics

#: Aggregate names that a dict may use.
AGGREGATES = ("sum", "count", "avg", "min", "max", "mean", "stddev", "variance", "stddev_samp", "var_samp", "kurtosis", "skewness")
JOINS = {"inner": "inner", "cross": "cross", "full": "full", "fullouter": "full", "outer": "full", "left": "left", "leftouter": "left", "right": "right", "rightouter": "right", "leftsemi": "left_semi", "semi": "left_semi", "leftanti": "left_anti", "anti": "left_anti"}
_ORDER = re.compile(r"^\s*(?P<name>.+?)(?:\s+(?P<way>asc|desc))?(?:\s+nulls\s+(?P<nulls>first|last))?\s*$", re.IGNORECASE)


def unwrap(value):
    return value.df if isinstance(value, Frame) else value


def sort_key(key: Column | str) -> Column:
    """A column, or text like ``amount DESC NULLS LAST``."""
    if isinstance(key, Column):
        return key
    parts = _ORDER.match(key)
    column, way, at = F.col(parts["name"]), (parts["way"] or "asc").lower(), (parts["nulls"] or "").lower()
    return getattr(column, f"{way}_nulls_{at}" if at else way)()


def dict_aggregates(spec: Mapping[str, str]) -> list[Column]:
    """{column: function} as columns named function_column; {'*': 'count'} as count."""
    from quern import functions as Q

    out = []
    for name, how in spec.items():
        if how not in AGGREGATES:
            raise ValueError(f"unknown aggregate {how!r}")
        if name == "*":
            out.append(F.count(F.lit(1)).alias("count"))
        else:
            out.append(getattr(Q, how)(name).alias(f"{how}_{name}"))
    return out


class Grouped:
    """Groups of a frame; convenience aggregates are named function_column."""

    def __init__(self, frame: Frame, grouped: GroupedData, keys: Sequence[str] = ()) -> None:
        self._frame, self._grouped, self._keys = frame, grouped, tuple(keys)

    def agg(self, *exprs: Column | Mapping[str, str]) -> Frame:
        if not exprs:
            raise ValueError("agg takes at least one expression")
        columns = dict_aggregates(exprs[0]) if isinstance(exprs[0], Mapping) else list(exprs)
        return self._frame._next(self._grouped.agg(*columns), "agg", str(columns))

    def pivot(self, column: str, values: Sequence | None = None) -> Grouped:
        """One output column for each value, in sorted order if not given."""
        if values is None:
            values = sorted(r[0] for r in self._frame.df.select(column).where(F.col(column).isNotNull()).distinct().collect())
        return Grouped(self._frame, self._grouped.pivot(column, list(values)), self._keys)

    def _each(self, how: str, names: Sequence[str]) -> Frame:
        names = names or [f.name for f in self._frame.df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in self._keys]
        return self.agg({n: how for n in names})

    def sum(self, *names: str) -> Frame:
        return self._each("sum", names)

    def avg(self, *names: str) -> Frame:
        return self._each("avg", names)

    def mean(self, *names: str) -> Frame:
        return self._each("mean", names)

    def min(self, *names: str) -> Frame:
        return self._each("min", names)

    def max(self, *names: str) -> Frame:
        return self._each("max", names)

    def count(self) -> Frame:
        return self.agg({"*": "count"})

    def applyInPandas(self, fn: Callable, schema) -> Frame:  # noqa: N802
        return self._frame._next(self._grouped.applyInPandas(fn, schema), "applyInPandas")


class Frame:
    def __init__(self, df: DataFrame, steps: Sequence[tuple[str, str]] = (("source", ""),)) -> None:
        self._df, self._steps = unwrap(df), tuple(steps)

    @property
    def df(self) -> DataFrame:
        return self._df

    def _next(self, df: DataFrame, op: str, detail: str = "") -> Frame:
        return Frame(df, (*self._steps, (op, detail)))

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        found = getattr(self._df, name)
        if not callable(found) or isinstance(found, Column):
            return found

        def call(*args, **kwargs):
            out = found(*map(unwrap, args), **{k: unwrap(v) for k, v in kwargs.items()})
            return self._next(out, name, ", ".join(map(str, args))) if isinstance(out, DataFrame) else out

        return call

    def __getitem__(self, item):
        return self.select(*item) if isinstance(item, (list, tuple)) else self._next(self._df.filter(item), "filter") if isinstance(item, Column) else self._df[item]

    def __len__(self) -> int:
        return self._df.count()

    # Projection and filter

    def select(self, *cols) -> Frame:
        return self._next(self._df.select(*cols), "select", ", ".join(map(str, cols)))

    def filter(self, condition) -> Frame:
        return self._next(self._df.filter(condition), "filter", str(condition))

    where = filter

    def withColumns(self, specs: Mapping[str, Column | str]) -> Frame:  # noqa: N802
        """Columns or SQL text; later ones see earlier ones."""
        df = self._df
        for name, spec in specs.items():
            df = df.withColumn(name, F.expr(spec) if isinstance(spec, str) else spec)
        return self._next(df, "withColumns", ", ".join(specs))

    def toDF(self, *names: str) -> Frame:  # noqa: N802
        return self._next(self._df.toDF(*names), "toDF") if names else self

    def transform(self, func: Callable[[Frame], Frame], *args, **kwargs) -> Frame:
        if not callable(func):
            raise ValueError("transform takes a function")
        return func(self, *args, **kwargs)

    def colRegex(self, pattern: str) -> list[str]:  # noqa: N802
        """Names of the columns in which the pattern is found."""
        return [c for c in self._df.columns if re.search(pattern, c)]

    # Joins

    def join(self, other: Frame | DataFrame, on=None, how: str = "inner") -> Frame:
        kind = JOINS.get(how.lower().replace("_", ""))
        if kind is None:
            raise ValueError(f"unknown join {how!r}")
        right = unwrap(other)
        if on is None:
            if kind not in ("inner", "cross"):
                raise ValueError(f"a {how} join needs a condition")
            return self._next(self._df.crossJoin(right), "crossJoin")
        return self._next(self._df.join(right, on, kind), "join", f"{kind} {on}")

    def joinSuffixed(self, other: Frame | DataFrame, on: str | Sequence[str], how: str = "inner", suffix: str = "_1") -> Frame:  # noqa: N802
        """Join that keeps both sides' columns, repeated right ones with a suffix."""
        right, keys = unwrap(other), [on] if isinstance(on, str) else list(on)
        left_names = {c.lower() for c in self._df.columns}
        renamed = right.toDF(*(c + suffix if c.lower() in left_names else c for c in right.columns))
        names = dict(zip(right.columns, renamed.columns, strict=True))
        condition = [self._df[k] == renamed[names[k]] for k in keys]
        return self._next(self._df.join(renamed, condition, JOINS[how.lower().replace("_", "")]), "join", f"{how} {keys}")

    def crossJoin(self, other: Frame | DataFrame) -> Frame:  # noqa: N802
        return self._next(self._df.crossJoin(unwrap(other)), "crossJoin")

    # Grouping

    def groupBy(self, *cols) -> Grouped:  # noqa: N802
        return Grouped(self._next(self._df, "groupBy", ", ".join(map(str, cols))), self._df.groupBy(*cols), [c for c in cols if isinstance(c, str)])

    group_by = groupby = groupBy

    def cube(self, *cols) -> Grouped:
        return Grouped(self._next(self._df, "cube"), self._df.cube(*cols), [c for c in cols if isinstance(c, str)])

    def rollup(self, *cols) -> Grouped:
        return Grouped(self._next(self._df, "rollup"), self._df.rollup(*cols), [c for c in cols if isinstance(c, str)])

    def groupingSets(self, sets: Sequence[Sequence[str]], *cols: str) -> Grouped:  # noqa: N802
        return Grouped(self._next(self._df, "groupingSets"), self._df.groupingSets([[F.col(c) for c in s] for s in sets], *cols), cols)

    def agg(self, *exprs) -> Frame:
        return Grouped(self, self._df.groupBy()).agg(*exprs)

    # Sort, limit and actions

    def orderBy(self, *keys, ascending: bool | Sequence[bool] = True) -> Frame:  # noqa: N802
        keys = keys[0] if len(keys) == 1 and isinstance(keys[0], (list, tuple)) else keys
        columns = [sort_key(k) for k in keys]
        if ascending is not True:
            ways = [ascending] * len(keys) if isinstance(ascending, bool) else list(ascending)
            columns = [c if not isinstance(k, str) or up else F.col(k).desc() for k, c, up in zip(keys, columns, ways, strict=True)]
        return self._next(self._df.orderBy(*columns), "orderBy", ", ".join(map(str, keys)))

    order_by = sort = orderBy

    def head(self, n: int = 1) -> list:
        return self._df.take(n)

    def take(self, n: int) -> list:
        return self._df.take(n)

    def tailRows(self, n: int, *keys) -> Frame:  # noqa: N802
        """The last n rows in the order of the keys (first column if none), in that order."""
        columns = [sort_key(k) for k in (keys or self._df.columns[:1])]
        flipped = [_flip(k) for k in (keys or self._df.columns[:1])]
        return self._next(self._df.orderBy(*flipped).limit(n).orderBy(*columns), "tail", str(n))

    def show(self, n: int = 10, truncate: bool = True) -> None:
        self._df.show(n, truncate)

    def to_arrow(self):
        return self._df.toArrow()

    def to_pandas(self, warn_threshold: int | None = 100_000):
        """pandas copy on the driver; warns past ``warn_threshold`` rows."""
        if warn_threshold is not None and len(self._df.select(F.lit(1)).take(warn_threshold + 1)) > warn_threshold:
            warnings.warn(f"to_pandas brings more than {warn_threshold} rows to the driver", stacklevel=2)
        return self._df.toPandas()

    toPandas = to_pandas

    def to_polars(self):
        try:
            import polars
        except ImportError as e:
            raise RuntimeError("to_polars needs polars") from e
        return polars.from_arrow(self.to_arrow())

    toPolars = to_polars

    # Set operations, deduplication, sampling and reshaping

    def union(self, other) -> Frame:
        return self._next(self._df.union(unwrap(other)), "union")

    unionAll = union

    def unionByName(self, other, allowMissingColumns: bool = False) -> Frame:  # noqa: N802, N803
        right = unwrap(other)
        if not allowMissingColumns and set(self._df.columns) != set(right.columns):
            raise ValueError("columns differ; allow missing columns to fill them with nulls")
        return self._next(self._df.unionByName(right, allowMissingColumns), "unionByName")

    def dropDuplicates(self, subset: Sequence[str] | None = None) -> Frame:  # noqa: N802
        """First row of each key in the order of all columns."""
        return self._next(reshape.drop_duplicates(self._df, subset), "dropDuplicates", str(subset))

    drop_duplicates = dropDuplicates

    def sample(self, fraction: float, withReplacement: bool = False, seed: int | None = None) -> Frame:  # noqa: N803
        return self._next(self._df.sample(withReplacement, fraction, seed), "sample", str(fraction))

    def randomSplit(self, weights: Sequence[float], seed: int | None = None) -> list[Frame]:  # noqa: N802
        """Disjoint parts that hold every row: each row's part hangs on its values alone."""
        return [self._next(df, "randomSplit", str(w)) for df, w in zip(reshape.random_split(self._df, weights, seed), weights, strict=True)]

    def unpivot(self, label: str, value: str, *cols: str) -> Frame:
        return self._next(reshape.unpivot(self._df, label, value, cols), "unpivot", ", ".join(cols))

    def melt(self, id_vars: Sequence[str] | None = None, value_vars: Sequence[str] | None = None, var_name: str = "variable", value_name: str = "value") -> Frame:
        return self._next(reshape.melt(self._df, id_vars, value_vars, var_name, value_name), "melt")

    def stack(self, **labelled: str) -> Frame:
        return self._next(reshape.stack(self._df, labelled), "stack")

    def explode(self, column: str) -> Frame:
        """One row for each part of a comma-separated column, trimmed; null and blank parts drop out."""
        return self._next(reshape.explode_text(self._df, column), "explode", column)

    # Nulls and statistics

    def dropna(self, how: str = "any", thresh: int | None = None, subset: Sequence[str] | None = None) -> Frame:
        return self._next(self._df.dropna(how, thresh, subset), "dropna")

    def na_drop(self, subset: Sequence[str] | None = None) -> Frame:
        return self.dropna(subset=subset)

    def fillna(self, value, subset: Sequence[str] | None = None) -> Frame:
        return self._next(self._df.fillna(value, subset), "fillna")

    na_fill = fillna

    def na_replace(self, to_replace, value=None, subset: Sequence[str] | None = None) -> Frame:
        return self._next(nulls.replace(self._df, to_replace, value, subset), "replace")

    replace = na_replace

    @property
    def na(self) -> Nulls:
        return Nulls(self)

    @property
    def stat(self) -> Statistics:
        return Statistics(self)

    def describe(self, *cols: str) -> Frame:
        """count, mean, stddev, min and max as text; numeric columns if none are named."""
        names = cols or [f.name for f in self._df.schema.fields if isinstance(f.dataType, NumericType)]
        return self._next(statistics.summarize(self._df, names, ("count", "mean", "stddev", "min", "max")), "describe")

    def summary(self, *stats: str) -> Frame:
        """describe with exact quartiles over all columns."""
        return self._next(statistics.summarize(self._df, self._df.columns, stats or ("count", "mean", "stddev", "min", "25%", "50%", "75%", "max")), "summary")

    def approxQuantile(self, col: str, probabilities: Sequence[float], relativeError: float = 0.0) -> list[float]:  # noqa: N802, N803
        """Exact interpolated quantiles, whatever the size of the column."""
        return statistics.exact_quantiles(self._df, col, [float(p) for p in probabilities])

    # Names, views, output

    def createOrReplaceTempView(self, name: str) -> None:  # noqa: N802
        self._df.createOrReplaceTempView(name)

    def registerTempTable(self, name: str) -> None:  # noqa: N802
        self._df.createOrReplaceTempView(name)

    @property
    def write(self):
        from quern.sources.writers import Writer

        return Writer(self._df)

    def lineage(self, show: bool = False) -> list[dict[str, str]]:
        steps = [{"op": op, "desc": desc} for op, desc in self._steps]
        if show:
            for i, step in enumerate(steps):
                print(f"{i}. {step['op']} {step['desc']}")
        return steps

    def plan(self, mode: str = "formatted") -> str:
        """The plan that ``explain`` prints."""
        execution = self._df._jdf.queryExecution()
        return self._df.sparkSession._jvm.PythonSQLUtils.explainString(execution, mode)

    def to_sql(self, pretty: bool = False) -> str:
        """The optimized plan as text."""
        text = self._df._jdf.queryExecution().optimizedPlan().toString()
        return text if pretty else " ".join(text.split())

    def explain(self, extended: bool | str | None = None) -> None:
        for step in self.lineage():
            print(f"{step['op']}: {step['desc']}")
        self._df.explain(extended if isinstance(extended, (bool, str)) else "formatted")


def _flip(key: Column | str) -> Column:
    """The reverse of a sort key given as text; a plain column is taken as ascending."""
    if isinstance(key, Column):
        return key.desc()
    parts = _ORDER.match(key)
    column, down, at = F.col(parts["name"]), (parts["way"] or "asc").lower() == "desc", (parts["nulls"] or "").lower()
    nulls_first = at == "first" if at else not down
    return (column.asc_nulls_last() if nulls_first else column.asc_nulls_first()) if down else (column.desc_nulls_last() if nulls_first else column.desc_nulls_first())


class Nulls:
    def __init__(self, frame: Frame) -> None:
        self._frame = frame

    def drop(self, how: str = "any", thresh: int | None = None, subset: Sequence[str] | None = None) -> Frame:
        return self._frame.dropna(how, thresh, subset)

    def fill(self, value, subset: Sequence[str] | None = None) -> Frame:
        return self._frame.fillna(value, subset)

    def replace(self, to_replace, value=None, subset: Sequence[str] | None = None) -> Frame:
        return self._frame.na_replace(to_replace, value, subset)


class Statistics:
    def __init__(self, frame: Frame) -> None:
        self._frame = frame

    def corr(self, col1: str, col2: str) -> float | None:
        from quern import functions as Q

        return self._frame.df.agg(Q.corr(col1, col2)).first()[0]

    def cov(self, col1: str, col2: str) -> float | None:
        return self._frame.df.agg(F.covar_samp(col1, col2)).first()[0]

    def crosstab(self, row: str, col: str) -> Frame:
        return self._frame._next(statistics.crosstab(self._frame.df, row, col), "crosstab")

    def freqItems(self, cols: str | Iterable[str], support: int = 1) -> Frame:  # noqa: N802
        """Exact counts of the values (or tuples) that occur ``support`` times or more."""
        return self._frame._next(statistics.frequent(self._frame.df, [cols] if isinstance(cols, str) else list(cols), support), "freqItems")

    def sampleBy(self, col: str, fractions: Mapping, seed: int | None = None) -> Frame:  # noqa: N802
        return self._frame._next(self._frame.df.stat.sampleBy(col, dict(fractions), seed), "sampleBy")

    def approxQuantile(self, col: str, probabilities: Sequence[float], relativeError: float = 0.0) -> list[float]:  # noqa: N802, N803
        return self._frame.approxQuantile(col, probabilities, relativeError)
