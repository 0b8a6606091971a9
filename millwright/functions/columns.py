"""Column expressions that the operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def col(name: str | Column) -> Column:
    return F.col(f"`{name}`") if isinstance(name, str) else name


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def is_time(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def number(df: DataFrame, name: str) -> Column:
    """The column as double; text that is no plain number, and NaN, become null."""
    c = col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.when(c.rlike(NUMBER), F.expr(f"try_cast(`{name}` as double)"))
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """Null instead of NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def divide(a, b) -> Column:
    """a / b, null where b is 0 or null."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    return a / F.when(b != 0, b)


def correlation(x: Column, y: Column, over=None) -> Column:
    """Pearson's correlation of the rows where both are known; null when either does not vary."""
    on = lambda c: c.over(over) if over is not None else c
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return divide(on(F.covar_pop(x, y)), on(F.stddev_pop(x)) * on(F.stddev_pop(y)))


def hours(later: Column, earlier: Column) -> Column:
    """Hours between two timestamps with or without zone, exact to the microsecond."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(3.6e9)


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def portable_hash(*parts) -> Column:
    """32 bits of md5: the same in every SQL engine, so that splits can be checked elsewhere."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
