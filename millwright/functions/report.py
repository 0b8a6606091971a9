"""Reports as plain Python values, and the shared checks of arguments."""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, Row

LIST_LIMIT = 50


def to_jsonable(value: Any) -> Any:
    """A copy of plain dicts, lists, strings and finite numbers; what JSON cannot hold becomes None or text."""
    if value is None or isinstance(value, (str, bool)):
        return value
    if hasattr(value, "item") and not hasattr(value, "__len__"):
        return to_jsonable(value.item())
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, Row):
        return to_jsonable(value.asDict())
    if isinstance(value, DataFrame):
        return [to_jsonable(r) for r in value.collect()]
    if isinstance(value, Mapping):
        return {str(k): to_jsonable(v) for k, v in value.items()}
    if hasattr(value, "tolist"):
        return to_jsonable(value.tolist())
    if isinstance(value, Iterable):
        return [to_jsonable(v) for v in value]
    return str(value)


def finite_number(value: Any, name: str) -> float:
    """The value as a finite float, or ValueError."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be a number, got {value!r}.") from None
    if not math.isfinite(number):
        raise ValueError(f"{name} must be a finite number, got {value!r}.")
    return number


def positive_number(value: Any, name: str) -> float:
    if isinstance(value, bool) or (number := finite_number(value, name)) <= 0:
        raise ValueError(f"{name} must be finite and > 0, got {value!r}.")
    return number


def require(df: Any, name: str, *columns: str) -> None:
    """ValueError unless df is a DataFrame with these columns."""
    if not isinstance(df, DataFrame):
        raise ValueError(f"{name} must be a Spark DataFrame.")
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{name} is missing column(s) {missing}. Columns present: {df.columns}.")


def capped(values: list, limit: int = LIST_LIMIT) -> list:
    """At most ``limit`` values and a note of how many more there are."""
    return values if len(values) <= limit else [*values[:limit], f"... and {len(values) - limit} more"]


def as_error(f):
    """A report function that returns {"error": sentence} instead of raising on bad arguments."""
    import functools

    @functools.wraps(f)
    def run(*args, **kwargs):
        try:
            return f(*args, **kwargs)
        except (ValueError, TypeError, OverflowError) as e:
            return {"error": str(e)}

    return run
