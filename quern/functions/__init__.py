"""Column functions: Spark's own, and those whose definition here differs.

A string argument names a column where a column is meant and is a literal where
a value is meant (search strings, pads, formats, defaults).
"""

from __future__ import annotations

import inspect

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import (  # noqa: A004, F401
    abs,
    acos,
    acosh,
    add_months,
    approx_count_distinct,
    asc,
    ascii,
    asin,
    asinh,
    atan,
    atan2,
    atanh,
    avg,
    bit_length,
    bool_and,
    bool_or,
    broadcast,
    cbrt,
    ceil,
    ceiling,
    char,
    char_length,
    chr,
    coalesce,
    col,
    collect_list,
    collect_set,
    column,
    concat,
    concat_ws,
    conv,
    cos,
    cosh,
    count,
    count_if,
    covar_pop,
    covar_samp,
    crc32,
    cume_dist,
    curdate,
    current_date,
    current_time,
    current_timestamp,
    current_user,
    date_add,
    date_diff,
    date_from_unix_date,
    date_sub,
    dateadd,
    datediff,
    day,
    dayname,
    dayofmonth,
    dayofweek,
    dayofyear,
    degrees,
    dense_rank,
    desc,
    e,
    equal_null,
    every,
    exp,
    expm1,
    expr,
    first_value,
    floor,
    format_string,
    from_utc_timestamp,
    greatest,
    grouping,
    grouping_id,
    hour,
    initcap,
    isnan,
    isnotnull,
    isnull,
    lag,
    last_day,
    lcase,
    lead,
    least,
    length,
    levenshtein,
    lit,
    ln,
    localtimestamp,
    log,
    log1p,
    log2,
    log10,
    lower,
    ltrim,
    max,
    md5,
    mean,
    min,
    minute,
    month,
    monthname,
    nanvl,
    negate,
    negative,
    now,
    ntile,
    nullifzero,
    percent_rank,
    pi,
    pmod,
    positive,
    pow,
    power,
    printf,
    quarter,
    radians,
    rand,
    randn,
    random,
    rank,
    reverse,
    round,
    row_number,
    rtrim,
    second,
    sha,
    sha1,
    sha2,
    sign,
    signum,
    sin,
    sinh,
    some,
    soundex,
    split,
    sqrt,
    std,
    stddev,
    stddev_pop,
    stddev_samp,
    sum,
    sum_distinct,
    sumDistinct,
    tan,
    tanh,
    timestamp_micros,
    timestamp_millis,
    timestamp_seconds,
    to_unix_timestamp,
    to_utc_timestamp,
    trim,
    ucase,
    unix_date,
    unix_micros,
    unix_millis,
    unix_seconds,
    unix_timestamp,
    upper,
    uuid,
    var_pop,
    var_samp,
    variance,
    weekday,
    weekofyear,
    when,
    year,
    zeroifnull,
)

any = bool_or  # noqa: A001
var = var_samp
#: Native approximate percentile; ``percentile_approx`` here is exact.
native_percentile_approx = F.percentile_approx
native_skewness, native_kurtosis = F.skewness, F.kurtosis


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _lit(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


# Casts, conditionals and null handling


def eq(value: Column | str, other: object) -> Column:
    """Equality; with None it asks for null."""
    return _col(value).isNull() if other is None else _col(value) == _lit(other)


def ne(value: Column | str, other: object) -> Column:
    """Inequality; with None it asks for anything but null."""
    return _col(value).isNotNull() if other is None else _col(value) != _lit(other)


def cast(value: Column | str, data_type: object) -> Column:
    return _col(value).cast(data_type)


def try_cast(value: Column | str, data_type: object) -> Column:
    """Cast that gives null where ``cast`` raises."""
    return _col(value).try_cast(data_type)


def ifnull(value: Column | str, default: object) -> Column:
    return F.coalesce(_col(value), _lit(default))


nvl = ifnull


def nvl2(value: Column | str, if_set: object, if_null: object) -> Column:
    return F.when(_col(value).isNotNull(), _lit(if_set)).otherwise(_lit(if_null))


def nullif(value: Column | str, other: object) -> Column:
    return F.nullif(_col(value), _lit(other))


# Math


def width_bucket(value: Column | str, low: object, high: object, buckets: object) -> Column:
    """Bucket 1..n; 0 below ``low``, n + 1 from ``high`` on, and 0 if high <= low."""
    low, high = _lit(low), _lit(high)
    return F.when(high <= low, F.lit(0).cast("bigint")).otherwise(F.width_bucket(_col(value), low, F.when(high > low, high).otherwise(low + 1), _lit(buckets).cast("bigint")))


def uniform(seed: int, low: float, high: float) -> Column:
    """Uniform doubles in [low, high)."""
    return F.lit(float(low)) + F.rand(seed) * F.lit(float(high) - float(low))


def divide(a: Column | str, b: Column | str) -> Column:
    """Quotient that is null for a zero divisor."""
    return F.try_divide(_col(a), _col(b))


def mod(a: Column | str, b: Column | str) -> Column:
    return F.try_mod(_col(a), _col(b))


# Strings


def instr(value: Column | str, part: str) -> Column:
    return F.instr(_col(value), part)


def locate(part: str, value: Column | str, pos: int = 1) -> Column:
    return F.locate(part, _col(value), pos)


def position(part: str, value: Column | str) -> Column:
    return F.locate(part, _col(value), 1)


def charindex(part: str, value: Column | str, start: int | None = None) -> Column:
    if start is not None and start < 1:
        raise ValueError("start must be 1 or more")
    return F.locate(part, _col(value), start or 1)


def startswith(value: Column | str, prefix: object) -> Column:
    return _col(value).startswith(_lit(prefix))


def endswith(value: Column | str, suffix: object) -> Column:
    return _col(value).endswith(_lit(suffix))


def contains(value: Column | str, part: object) -> Column:
    return _col(value).contains(_lit(part))


def left(value: Column | str, n: object) -> Column:
    return F.left(_col(value), _lit(n))


def right(value: Column | str, n: object) -> Column:
    return F.right(_col(value), _lit(n))


def substring(value: Column | str, pos: object, n: object) -> Column:
    return F.substr(_col(value), _lit(pos), _lit(n))


substr = substring


def repeat(value: Column | str, n: object) -> Column:
    return F.repeat(_col(value), _lit(n))


def space(n: object) -> Column:
    return F.repeat(F.lit(" "), _lit(n))


def replace(value: Column | str, search: object, replacement: object = "") -> Column:
    return F.replace(_col(value), _lit(search), _lit(replacement))


def lpad(value: Column | str, n: object, pad: object = " ") -> Column:
    return F.lpad(_col(value), _lit(n), _lit(pad))


def rpad(value: Column | str, n: object, pad: object = " ") -> Column:
    return F.rpad(_col(value), _lit(n), _lit(pad))


def elt(n: object, *values: Column | str) -> Column:
    """The n-th of the values, null out of range."""
    index = _lit(n) if not isinstance(n, str) else F.col(n)
    return F.when(index > 0, F.try_element_at(F.array(*map(_col, values)), index.cast("int")))


def find_in_set(value: Column | str, members: Column | str) -> Column:
    return F.find_in_set(_col(value), _col(members))


def regexp_extract(value: Column | str, pattern: str, idx: int = 0) -> Column:
    return F.regexp_extract(_col(value), pattern, idx)


def regexp_replace(value: Column | str, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(_col(value), pattern, replacement)


def split_flat(value: Column | str, pattern: str) -> Column:
    """Parts of a regex split as one comma-joined string."""
    return F.array_join(F.split(_col(value), pattern), ",")


def collect_list_flat(value: Column | str) -> Column:
    return F.array_join(F.collect_list(_col(value).cast("string")), ",")


def collect_set_flat(value: Column | str) -> Column:
    return F.array_join(F.sort_array(F.collect_set(_col(value).cast("string"))), ",")


def parse_url(url: Column | str, part: str) -> Column:
    """Part of a URL; null for a malformed one."""
    return F.try_parse_url(_col(url), _lit(part))


def parse_url_key(url: Column | str, part: str, key: str) -> Column:
    return F.try_parse_url(_col(url), _lit(part), _lit(key))


# Dates and times

#: Date pattern tokens and their Java letters.
DATE_TOKENS = {"YYYY": "yyyy", "YY": "yy", "MONTH": "MMMM", "MON": "MMM", "MM": "MM", "DD": "dd", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "FF": "SSSSSS", "AM": "a", "PM": "a", "DAY": "EEEE", "DY": "EEE"}
#: Fields of ``extract``.
DATE_FIELDS = ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "QUARTER", "WEEK", "DOY", "DOW", "DAYOFYEAR", "DAYOFWEEK")
DIFF_UNITS = ("SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR")
#: Units of ``trunc`` and their other names.
TRUNC_UNITS = {"year": ("year", "yyyy", "yy"), "quarter": ("quarter",), "month": ("month", "mon", "mm"), "week": ("week",)}


def java_pattern(pattern: str) -> str:
    """A pattern like YYYY-MM-DD HH24:MI:SS in Java letters; lower-case letters are Java's already."""
    out, at = "", 0
    tokens = sorted(DATE_TOKENS, key=len, reverse=True)
    while at < len(pattern):
        token = next((t for t in tokens if pattern.startswith(t, at)), None)
        out += DATE_TOKENS[token] if token else pattern[at]
        at += len(token) if token else 1
    return out


def to_date(value: Column | str, fmt: str = "YYYY-MM-DD") -> Column:
    """Date by pattern; null where the text doesn't fit."""
    return F.try_to_date(_col(value), java_pattern(fmt))


def date_format(value: Column | str, fmt: str = "YYYY-MM-DD") -> Column:
    return F.date_format(_col(value), java_pattern(fmt))


def extract(field: str, source: Column | str) -> Column:
    if field.upper() not in DATE_FIELDS:
        raise ValueError(f"unknown field {field!r}")
    return F.extract(F.lit(field.upper()), _col(source))


date_part = datepart = extract


def trunc(value: Column | str, unit: str) -> Column:
    """First day of the year, quarter, month or week."""
    name = next((u for u, names in TRUNC_UNITS.items() if unit.lower() in names), None)
    if name is None:
        raise ValueError(f"unknown unit {unit!r}")
    return F.trunc(_col(value), name)


def timestampdiff(unit: str, start: Column | str, end: Column | str) -> Column:
    """Whole units from start to end, cut towards zero."""
    if unit.upper() not in DIFF_UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    return F.timestamp_diff(unit.upper(), _col(start), _col(end))


def months_between(later: Column | str, earlier: Column | str) -> Column:
    """Months between dates; times of day don't count."""
    return F.months_between(_col(later).cast("date"), _col(earlier).cast("date"))


def next_day(value: Column | str, day_of_week: str) -> Column:
    return F.next_day(_col(value), day_of_week)


def from_unixtime(value: Column | str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.from_unixtime(_col(value), fmt)


# Aggregates


def count_distinct(first: Column | str, *more: Column | str) -> Column:
    """Distinct values, or distinct tuples, of which those with nulls count too."""
    return F.count_distinct(F.struct(_col(first), *map(_col, more))) if more else F.count_distinct(_col(first))


countDistinct = count_distinct


def first(value: Column | str, ignorenulls: bool = True) -> Column:
    return F.first(_col(value), ignorenulls=ignorenulls)


def last(value: Column | str, ignorenulls: bool = True) -> Column:
    return F.last(_col(value), ignorenulls=ignorenulls)


def max_by(value: Column | str, order: Column | str) -> Column:
    """Value at the greatest key; rows with a null value are left out."""
    return F.max_by(_col(value), F.when(_col(value).isNotNull(), _col(order)))


def min_by(value: Column | str, order: Column | str) -> Column:
    return F.min_by(_col(value), F.when(_col(value).isNotNull(), _col(order)))


def skewness(value: Column | str) -> Column:
    """Bias-corrected; null under 3 values, 0 without spread."""
    x, n = _col(value).cast("double"), F.count(_col(value)).cast("double")
    corrected = F.skewness(x) * F.try_divide(F.sqrt(F.greatest(n * (n - 1), F.lit(0.0))), n - 2)
    return F.when(n < 3, None).when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(corrected)


def kurtosis(value: Column | str) -> Column:
    """Bias-corrected excess; null under 4 values, 0 without spread."""
    x, n = _col(value).cast("double"), F.count(_col(value)).cast("double")
    corrected = ((n + 1) * F.kurtosis(x) + 6) * F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when(n < 4, None).when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(corrected)


def corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation of the pairs without nulls; null without spread."""
    both = _col(a).isNotNull() & _col(b).isNotNull()
    x, y = F.when(both, _col(a).cast("double")), F.when(both, _col(b).cast("double"))
    # Merged sums of equal values can leave a rest, so spread is told from the values; NaN stays NaN.
    spread = [(F.min(v) < F.max(v)) | F.isnan(F.max(v)) for v in (x, y)]
    return F.when(spread[0] & spread[1], F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def percentile(value: Column | str, p: float) -> Column:
    """Exact, with linear interpolation."""
    if not 0 <= p <= 1:
        raise ValueError("p must lie in [0, 1]")
    return F.percentile(_col(value), p)


quantile = percentile


def median(value: Column | str) -> Column:
    return F.percentile(_col(value), 0.5)


def percentile_approx(value: Column | str, p: float, accuracy: int | None = None) -> Column:
    """The exact percentile; ``native_percentile_approx`` is Spark's sketch."""
    return percentile(value, p)


approx_percentile = percentile_approx


# Windows and generators


def last_value(value: Column | str) -> Column:
    """Last value; give the window a full frame (see ``whole``)."""
    return F.last_value(_col(value))


def nth_value(value: Column | str, n: int) -> Column:
    return F.nth_value(_col(value), n)


def whole(window):
    """The window with a frame from its first to its last row."""
    from pyspark.sql import Window

    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def explode(value: Column | str) -> Column:
    """One row for each part of a comma-separated string."""
    return F.explode(F.split(_col(value), ","))


def stack(n: int, *pairs: object) -> Column:
    """n rows (_label, _value) from n label and column pairs."""
    if len(pairs) != 2 * n:
        raise ValueError(f"stack({n}) takes {n} label and value pairs")
    cells = [cell for i in range(0, len(pairs), 2) for cell in (_lit(pairs[i]), _col(pairs[i + 1]))]
    return F.stack(F.lit(n), *cells).alias("_label", "_value")


def udf(fn=None, returnType=None):  # noqa: N803
    """Decorator: registers a function in the active session and makes it a column function.

    Without ``returnType`` the result type comes from the annotation.
    """
    from quern.functions.udfs import type_of

    def wrap(function):
        session = SparkSession.getActiveSession()
        if session is None:
            raise RuntimeError("udf needs an active session")
        kind = returnType or type_of(inspect.signature(function).return_annotation)
        return session.udf.register(function.__name__, function, kind)

    return wrap if fn is None else wrap(fn)
