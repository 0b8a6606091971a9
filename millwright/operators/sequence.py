"""Failure labels and causal window features over sensor logs.

Windows share one partitioning (asset) and one order (time), so Spark sorts and
exchanges once for a whole set of features. No window looks ahead of a reading;
only the label does, by meaning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.columns import col, hours, is_numeric, is_time
from millwright.functions.report import require, to_jsonable

STATS = ("mean", "std", "slope", "delta_baseline")


def next_event(readings: DataFrame, events: DataFrame, asset_col: str, time_col: str, event_time_col: str, event_asset_col: str | None = None, to: str = "next_event") -> DataFrame:
    """As-of join: each reading with its asset's first event strictly later, or null.

    Events and readings are one stream per asset, sorted backwards in time; an
    event sorts behind the readings of its own time. A window carries the last
    event seen along the stream, in time proportional to the rows. Each reading
    stays one row, however many events there are.
    """
    names = readings.columns
    row = F.struct(*(col(c) for c in names))
    kind = readings.schema[time_col].dataType
    a = readings.select(col(asset_col).cast("string").alias("_asset"), col(time_col).alias("_at"), F.lit(1).alias("_kind"), row.alias("_row"))
    b = events.select(col(event_asset_col or asset_col).cast("string").alias("_asset"), col(event_time_col).cast(kind).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row")).where("_asset is not null and _at is not null")
    later = Window.partitionBy("_asset").orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, -1)
    found = F.last(F.when(F.col("_kind") == 0, F.col("_at")), ignorenulls=True).over(later)
    return a.unionByName(b).withColumn("_next", found).where("_kind = 1").select(*(F.col("_row")[c].alias(c) for c in names), F.col("_next").alias(to))


def _duration(value: Any, name: str, timed: bool) -> float:
    """Hours of a duration, or the number itself where times are numbers."""
    if timed:
        try:
            out = pd.to_timedelta(value)
        except Exception:
            raise ValueError(f"{name} must be a duration for a time column, got {value!r}.") from None
        out = math.nan if pd.isna(out) else out.total_seconds() / 3600
    else:
        try:
            out = math.nan if isinstance(value, bool) else float(value)
        except (TypeError, ValueError):
            out = math.nan
    if not math.isfinite(out):
        raise ValueError(f"{name} must be a finite {'duration' if timed else 'number'}, got {value!r}.")
    return out


def label_failures(readings: DataFrame, events: DataFrame, asset_col: str, time_col: str, horizon: float, event_time_col="failed_at", event_asset_col=None, label_col="failure", lead_time: float = 0.0) -> DataFrame:
    """All readings with the label and time_to_event (hours between timestamps); label 1 if lead_time < time_to_event <= horizon."""
    rows = next_event(readings, events, asset_col, time_col, event_time_col, event_asset_col, "_next")
    gap = hours(F.col("_next"), col(time_col)) if is_time(readings, time_col) else (F.col("_next") - col(time_col)).cast("double")
    rows = rows.withColumn("time_to_event", gap).drop("_next")
    t = F.col("time_to_event")
    return rows.withColumn(label_col, F.coalesce((t > lead_time) & (t <= horizon), F.lit(False)).cast(T.ByteType()))


def unmatched(readings: DataFrame, events: DataFrame) -> DataFrame:
    """All assets of either side, in a row each: columns of ``readings`` (asset) and of ``events`` (event_asset), null where a side lacks the asset."""
    return readings.join(events, F.col("asset").cast("string") == F.col("event_asset").cast("string"), "full_outer")


def build_failure_labels(readings: DataFrame, events: DataFrame, asset_col: str, time_col: str, horizon: Any, event_time_col="failed_at", event_asset_col: str | None = None, label_col="failure", lead_time: Any = 0) -> tuple[DataFrame, dict]:
    """The labelled readings and a report of what the labels rest on. Bad arguments raise."""
    event_asset = event_asset_col or asset_col
    require(readings, "readings", asset_col, time_col)
    require(events, "events", event_asset, event_time_col)
    for c in (label_col, "time_to_event"):
        if c in readings.columns:
            raise ValueError(f"Column {c!r} is already in readings.")
    kinds = [(is_time(df, c), is_numeric(df, c)) for df, c in ((readings, time_col), (events, event_time_col))]
    if kinds[0] != kinds[1] or not any(kinds[0]):
        raise ValueError(f"The time columns do not match: {readings.schema[time_col].dataType} and {events.schema[event_time_col].dataType}.")
    timed = kinds[0][0]
    h, lead = _duration(horizon, "horizon", timed), _duration(lead_time, "lead_time", timed)
    if h <= 0:
        raise ValueError(f"horizon must be positive, got {horizon!r}.")
    if lead < 0:
        raise ValueError(f"lead_time must not be negative, got {lead_time!r}.")
    if lead >= h:
        raise ValueError(f"lead_time ({lead_time!r}) must be less than horizon ({horizon!r}).")
    for c in (time_col, asset_col):
        if readings.where(col(c).isNull()).take(1):
            raise ValueError(f"readings[{c!r}] contains null values.")
    labelled = label_failures(readings, events, asset_col, time_col, h, event_time_col, event_asset, label_col, lead)
    t = F.col("time_to_event")
    per = labelled.groupBy(col(asset_col).alias("asset")).agg(F.count("*").alias("rows"), F.sum(col(label_col).cast("long")).alias("positives"), F.sum(t.isNull().cast("long")).alias("censored"), F.sum(F.coalesce((t > 0) & (t <= lead), F.lit(False)).cast("long")).alias("inside"))
    seen = events.where(col(event_asset).isNotNull()).groupBy(col(event_asset).alias("event_asset")).agg(F.count(col(event_time_col)).alias("events"))
    both = unmatched(per, seen).cache()
    total = both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "positives", "censored", "inside")), F.count("asset").alias("assets"), F.coalesce(F.sum(F.when(F.col("asset").isNotNull(), F.col("events"))), F.lit(0)).alias("used")).first()
    ids = lambda where, c: [r[0] for r in both.where(where).select(c).orderBy(F.col(c).cast("string")).limit(51).collect()]
    count = lambda where: both.where(where).count()
    lists = {}
    for name, where, c in (("assets_without_events", "asset is not null and coalesce(events, 0) = 0", "asset"), ("events_without_readings", "asset is null", "event_asset")):
        found = ids(where, c)
        lists[name] = found if len(found) <= 50 else [*found[:50], f"... and {count(where) - 50} more"]
    top = both.where("asset is not null").orderBy(F.desc("rows"), F.col("asset").cast("string")).limit(200).collect()
    both.unpersist()
    rate = round(total["positives"] / total["rows"], 6) if total["rows"] else 0.0
    warning = None
    if rate < 0.005:
        warning = f"The share of positives is {rate:.6f}; the horizon ({horizon}) may be too short."
    elif rate > 0.5:
        warning = f"The share of positives is {rate:.6f}; the horizon ({horizon}) may be so long that it labels normal operation."
    report = {
        "label_col": label_col, "horizon": str(horizon) if isinstance(horizon, pd.Timedelta) else horizon, "lead_time": str(lead_time) if isinstance(lead_time, pd.Timedelta) else lead_time, "rows": total["rows"], "positives": total["positives"], "positive_rate": rate,
        "assets": total["assets"], "events_used": total["used"], **lists, "censored_rows": total["censored"], "rows_inside_lead_time": total["inside"],
        "per_asset": {r["asset"]: {"rows": r["rows"], "positives": r["positives"], "events": r["events"] or 0} for r in top}, "horizon_warning": warning,
    }
    if total["assets"] > 200:
        report["per_asset_truncated"] = True
    return labelled, to_jsonable(report)


def window_features(readings: DataFrame, asset_col: str, time_col: str, value_cols: Sequence[str], windows: Sequence[int] = (12, 24), stats: Sequence[str] = STATS, baseline_n: int = 100, tie_break: Sequence[str] = ()) -> DataFrame:
    """All readings with ``{c}_w{w}_mean|std|slope`` and ``{c}_vs_baseline``; null where a frame is not full."""
    order = Window.partitionBy(asset_col).orderBy(time_col, *tie_break)
    whole = Window.partitionBy(asset_col)
    rows = readings.withColumn("_rn", F.row_number().over(order))
    rows = rows.withColumns({f"_d_{c}": col(c) - F.lag(col(c)).over(order) for c in value_cols} if "slope" in stats else {})
    new = {}
    for c in value_cols:
        x = F.when(~F.isnan(col(c).cast("double")), col(c).cast("double"))
        for w in windows:
            frame = order.rowsBetween(1 - w, 0)
            full = F.count(x).over(frame) == w
            if "mean" in stats:
                new[f"{c}_w{w}_mean"] = F.when(full, F.avg(x).over(frame))
            if "std" in stats:
                new[f"{c}_w{w}_std"] = F.when(full, F.stddev_samp(x).over(frame))
            if "slope" in stats:
                d = F.col(f"_d_{c}")
                new[f"{c}_w{w}_slope"] = F.when(F.count(d).over(frame) == w, F.avg(d).over(frame))
        if "delta_baseline" in stats:
            base = F.avg(F.when(F.col("_rn") <= baseline_n, x)).over(whole)
            new[f"{c}_vs_baseline"] = F.when((F.col("_rn") > baseline_n) & (F.count("*").over(whole) >= baseline_n), x - base)
    if clash := [c for c in new if c in readings.columns]:
        raise ValueError(f"The readings hold columns of these names already: {clash}.")
    return rows.withColumns(new).drop("_rn", *(f"_d_{c}" for c in value_cols))


def add_window_features(readings: DataFrame, asset_col: str, time_col: str, value_cols: Sequence[str] | None = None, windows: Sequence[int] = (12, 24), stats: Sequence[str] = STATS, baseline_n: int = 100, label_col: str | None = None, drop_incomplete: bool = True) -> tuple[DataFrame, dict]:
    """The readings with features and a report of what was dropped and skipped. Bad arguments raise."""
    require(readings, "readings", asset_col, time_col, *[label_col] * (label_col is not None))
    whole = lambda v, least: isinstance(v, int) and not isinstance(v, bool) and v >= least
    if not stats or (bad := [s for s in stats if s not in STATS]):
        raise ValueError(f"stats may name {', '.join(STATS)}, one at least; got {stats!r}.")
    if not windows or not all(whole(w, 2) for w in windows):
        raise ValueError(f"Each window needs 2 readings or more; got {windows!r}.")
    if not whole(baseline_n, 1):
        raise ValueError(f"baseline_n counts readings, so {baseline_n!r} cannot be it.")
    if value_cols is None:
        value_cols = [c for c in readings.columns if c not in {asset_col, time_col, label_col, "time_to_event"} and is_numeric(readings, c)]
    if not value_cols:
        raise ValueError("There are no numeric value columns.")
    require(readings, "readings", *value_cols)
    if bad := [c for c in value_cols if not is_numeric(readings, c)]:
        raise ValueError(f"Column {bad[0]!r} must be numeric, got {readings.schema[bad[0]].dataType}.")
    for c in (asset_col, time_col):
        if readings.where(col(c).isNull()).take(1):
            raise ValueError(f"readings[{c!r}] contains null values.")
    out = window_features(readings, asset_col, time_col, value_cols, windows, stats, baseline_n)
    added = sorted(c for c in out.columns if c not in readings.columns)
    complete = F.lit(True)
    for c in added:
        complete = complete & col(c).isNotNull()
    counts = out.agg(F.count("*").alias("n"), F.coalesce(F.sum(complete.cast("long")), F.lit(0)).alias("full")).first()
    need = baseline_n + max(windows)
    sizes = readings.groupBy(col(asset_col).alias("a")).agg(F.count("*").alias("n"))
    short = sizes.where(F.col("n") < need)
    skipped = {r["a"]: f"{r['n']} readings, needs baseline_n={baseline_n} + window={max(windows)} = {need}" for r in short.orderBy(F.col("a").cast("string")).limit(50).collect()}
    if (more := short.count() - len(skipped)) > 0:
        skipped[f"... and {more} more"] = f"... and {more} more"
    kept = counts["full"] if drop_incomplete else counts["n"]
    dropped = counts["n"] - kept
    warning = f"{dropped} of {counts['n']} rows were dropped: the baseline ({baseline_n}) and the longest window ({max(windows)}) must fill first." if counts["n"] and dropped / counts["n"] > 0.3 else None
    report = {
        "rows_in": counts["n"], "rows_out": kept, "rows_dropped": dropped, "features_added": added, "n_features_added": len(added), "value_cols": list(value_cols), "windows": list(windows), "stats": list(stats), "baseline_n": baseline_n,
        "assets": sizes.count(), "assets_skipped": skipped, "incomplete_rows_kept": 0 if drop_incomplete else counts["n"] - counts["full"], "memory_mb_added": round(8 * len(added) * kept / (1 << 20), 3), "rows_dropped_warning": warning,
    }
    return (out.where(complete) if drop_incomplete else out), to_jsonable(report)


