"""Maintenance figures and reliability models."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millwright.functions import special
from millwright.functions.columns import col, divide, hours, is_numeric, is_text, is_time, number
from millwright.functions.constants import COST_BREAKDOWN, COST_CALLOUT, COST_PLANNED, CROW_MIN, FORECAST_INTERVAL, OEE_WORLD_CLASS, PARETO_CUTOFF, PM_SAVING, SEED, WEIBULL_BOOTSTRAP, WEIBULL_CONFIDENCE, WEIBULL_MIN
from millwright.functions.report import as_error, finite_number, positive_number, require, to_jsonable

# ------------------------------------------------------------------ rates and shares


def wilson_columns(successes: Column, trials: Column, confidence: float = 0.95) -> dict[str, Column]:
    """point, lower and upper of the Wilson interval as column expressions; null for impossible counts."""
    z = special.normal_quantile(1 - (1 - confidence) / 2)
    n = F.when((trials > 0) & (successes >= 0) & (successes <= trials), trials)
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return {"point": p, "lower": F.greatest(F.lit(0.0), centre - half), "upper": F.least(F.lit(1.0), centre + half)}


def wilson_confidence_interval(successes: int, trials: int, confidence: float = 0.95) -> dict:
    try:
        conf = float(confidence)
    except (TypeError, ValueError):
        return {"point": None, "lower": None, "upper": None, "n": 0, "confidence": 0.95}
    none = {"point": None, "lower": None, "upper": None, "n": 0, "confidence": conf}
    try:
        k, n = int(successes), int(trials)
    except (TypeError, ValueError, OverflowError):
        return none
    if not 0 <= k <= n or n == 0 or not 0 < conf < 1:
        return none
    z2 = special.normal_quantile(1 - (1 - conf) / 2) ** 2
    p = k / n
    centre, half = (p + z2 / (2 * n)) / (1 + z2 / n), math.sqrt(z2) / (1 + z2 / n) * math.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return {"point": p, "lower": max(0.0, centre - half), "upper": min(1.0, centre + half), "n": n, "confidence": conf}


def savings_columns(tp: Column, fp: Column, fn: Column, breakdown=COST_BREAKDOWN, planned=COST_PLANNED, inspection=COST_CALLOUT) -> dict[str, Column]:
    failures = tp + fn
    before = failures * breakdown
    after = fn * breakdown + tp * (inspection + planned) + fp * inspection
    return {
        "run_to_failure_cost": before.cast("double"),
        "predictive_cost": after.cast("double"),
        "cost_savings": (before - after).cast("double"),
        "savings_percentage": F.coalesce(divide((before - after) * 100.0, before), F.lit(0.0)),
        "breakdown_avoidance_rate": divide(tp.cast("double"), failures),
    }


@as_error
def calculate_maintenance_savings(true_positives, false_positives, false_negatives, cost_breakdown=COST_BREAKDOWN, cost_planned=COST_PLANNED, cost_inspection=COST_CALLOUT) -> dict:
    tp, fp, fn = int(true_positives), int(false_positives), int(false_negatives)
    if min(tp, fp, fn) < 0:
        raise ValueError("tp, fp and fn count things, so none can be below 0.")
    costs = {"cost_breakdown": cost_breakdown, "cost_planned": cost_planned, "cost_inspection": cost_inspection}
    costs = {k: finite_number(v, k) for k, v in costs.items()}
    if bad := [k for k, v in costs.items() if v < 0]:
        raise ValueError(f"{bad[0]} has to be 0 or a positive finite number.")
    breakdown, planned, inspection = costs.values()
    before = (tp + fn) * breakdown
    after = fn * breakdown + tp * (inspection + planned) + fp * inspection
    return {
        "run_to_failure_cost": float(before), "predictive_cost": float(after), "cost_savings": float(before - after), "savings_percentage": (before - after) / before * 100 if before > 0 else 0.0,
        "breakdowns_avoided": tp, "unplanned_breakdowns": fn, "breakdown_avoidance_rate": tp / (tp + fn) if tp + fn else None, "wasted_inspections": fp, "cost_assumptions": costs,
    }


# ------------------------------------------------------------------ work orders


def breakdowns(work_orders: DataFrame, wo_type_col="wo_type", breakdown_types: Sequence[str] = ("breakdown",)) -> DataFrame:
    require(work_orders, "work_orders", wo_type_col)
    return work_orders.where(col(wo_type_col).cast("string").isin(*(str(t) for t in breakdown_types)))


@as_error
def calculate_mtbf(work_orders: DataFrame, operating_hours: float, wo_type_col="wo_type", breakdown_types=("breakdown",)) -> dict:
    total = positive_number(operating_hours, "operating_hours")
    n = breakdowns(work_orders, wo_type_col, breakdown_types).count()
    return {
        "mtbf_hours": total / n if n else None, "breakdowns": n, "operating_hours": total, "failure_rate_per_hour": n / total if n else None, "failure_rate_assumes_constant_hazard": True,
        "constant_hazard_note": "1 / MTBF is the failure rate at every age only if the hazard does not change with age; a Weibull fit of the times between failures tests that.",
    }


def _moment(df: DataFrame, name: str) -> Column:
    return F.expr(f"try_to_timestamp(`{name}`)") if is_text(df, name) else col(name)


def repairs(work_orders: DataFrame, by: Sequence[str] = (), reported_col="reported_at", started_col="started_at", finished_col="finished_at", wo_type_col="wo_type", breakdown_types=("breakdown",)) -> DataFrame:
    """Mean hours to acknowledge, to repair and down of usable repairs, by group. One filter serves all means, so down = acknowledge + repair."""
    require(work_orders, "work_orders", reported_col, started_col, finished_col, wo_type_col, *by)
    rows = breakdowns(work_orders, wo_type_col, breakdown_types)
    reported, started, finished = (_moment(rows, c) for c in (reported_col, started_col, finished_col))
    rows = rows.select(*by, hours(started, reported).alias("wait"), hours(finished, started).alias("repair"), hours(finished, reported).alias("down"))
    good = F.coalesce((F.col("wait") >= 0) & (F.col("repair") >= 0) & F.col("down").isNotNull(), F.lit(False))
    use = lambda c: F.when(good, F.col(c))
    return rows.groupBy(*by).agg(
        F.avg(use("repair")).alias("mttr_hours"), F.avg(use("wait")).alias("mtta_hours"), F.avg(use("down")).alias("mdt_hours"),
        F.sum(good.cast("long")).alias("repairs"), F.sum((~good).cast("long")).alias("rows_excluded"), F.max(use("repair")).alias("longest_repair_hours"), F.max(use("wait")).alias("longest_wait_hours"),
    )


@as_error
def calculate_mttr(work_orders: DataFrame, reported_col="reported_at", started_col="started_at", finished_col="finished_at", wo_type_col="wo_type", breakdown_types=("breakdown",)) -> dict:
    row = repairs(work_orders, (), reported_col, started_col, finished_col, wo_type_col, breakdown_types).first()
    out = to_jsonable(row)
    return out | {"repairs": out["repairs"] or 0, "rows_excluded": out["rows_excluded"] or 0}


def availability_columns(mtbf: Column, mttr: Column, mdt: Column) -> dict[str, Column]:
    inherent, operational = divide(mtbf, mtbf + mttr), divide(mtbf, mtbf + mdt)
    return {"inherent_availability": inherent, "operational_availability": operational, "availability_lost_to_waiting": inherent - operational}


@as_error
def calculate_availability(mtbf_hours, mttr_hours, mdt_hours=None) -> dict:
    given = {"mtbf_hours": mtbf_hours, "mttr_hours": mttr_hours} | ({} if mdt_hours is None else {"mdt_hours": mdt_hours})
    given = {k: finite_number(v, k) for k, v in given.items()}
    if bad := [k for k, v in given.items() if v < 0]:
        raise ValueError(f"{bad[0]} has to be 0 or a positive finite number.")
    up, down = given["mtbf_hours"], given["mttr_hours"]
    if up + down <= 0:
        raise ValueError("With MTBF and MTTR both 0 there is no availability.")
    inherent = up / (up + down)
    mdt = given.get("mdt_hours")
    operational = up / (up + mdt) if mdt is not None and up + mdt > 0 else None
    return {
        "inherent_availability": inherent, "operational_availability": operational, "availability_lost_to_waiting": None if operational is None else inherent - operational,
        "inherent_availability_pct": inherent * 100, "operational_availability_pct": None if operational is None else operational * 100,
    }


def oee_columns(planned: Column, run: Column, cycle: Column, total: Column, good: Column) -> dict[str, Column]:
    """Availability, performance, quality and their product; nothing is clamped, null where undefined."""
    availability, performance, quality = divide(run, planned), divide(cycle * total, run), divide(good, total)
    oee = availability * performance * quality
    return {"availability": availability, "performance": performance, "quality": quality, "oee": oee, "meets_world_class": oee >= OEE_WORLD_CLASS}


@as_error
def calculate_oee(planned_time_min, run_time_min, ideal_cycle_time_min, total_count, good_count) -> dict:
    names = ("planned_time_min", "run_time_min", "ideal_cycle_time_min", "total_count", "good_count")
    planned, run, cycle, total, good = (finite_number(v, k) for k, v in zip(names, (planned_time_min, run_time_min, ideal_cycle_time_min, total_count, good_count)))
    for name, value in zip(names, (planned, run, cycle, total, good)):
        if value < 0:
            raise ValueError(f"{name} has to be 0 or a positive finite number, not {value!r}.")
        if value == 0 and name in ("planned_time_min", "run_time_min", "total_count"):
            raise ValueError(f"{name} cannot be 0.")
    if good > total:
        raise ValueError(f"There cannot be more good pieces ({good:g}) than pieces ({total:g}).")
    availability, performance, quality = run / planned, cycle * total / run, good / total
    warnings = []
    if run > planned:
        warnings.append(f"The run time ({run:g} min) is longer than the planned time ({planned:g} min).")
    if performance > 1:
        warnings.append(f"Performance is {performance:.3f}: the ideal cycle time ({cycle:g} min) is probably set too slow.")
    oee = availability * performance * quality
    shares = {"oee": oee, "availability": availability, "performance": performance, "quality": quality}
    return shares | {f"{k}_pct": v * 100 for k, v in shares.items()} | {"world_class_benchmark": OEE_WORLD_CLASS, "meets_world_class": oee >= OEE_WORLD_CLASS, "warnings": warnings}


def pareto(df: DataFrame, category_col: str, value_col: str | None = None, cutoff: float = PARETO_CUTOFF) -> DataFrame:
    """Categories by falling total with their share, cumulative share and whether they are among the vital few.

    Only the categories' totals meet in the final window. The vital few are
    those before which the cumulative sum lies below the cutoff.
    """
    category = F.coalesce(col(category_col).cast("string"), F.lit("(unknown)")).alias("category")
    value = F.count("*").cast("double") if value_col is None else F.sum(number(df, value_col))
    totals = df.groupBy(category).agg(value.alias("value")).where("value is not null")
    order = Window.orderBy(F.desc("value"), "category")
    total = F.sum("value").over(Window.partitionBy())
    upto = F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = totals.withColumns({"_upto": upto, "_total": total, "rank": F.row_number().over(order)}).where("_total > 0")
    vital = (F.col("_upto") - F.col("value")) / F.col("_total") < cutoff - 1e-9
    return rows.select("category", "value", "rank", (F.col("value") / F.col("_total") * 100).alias("percentage"), (F.col("_upto") / F.col("_total") * 100).alias("cumulative_percentage"), vital.alias("is_vital_few"))


@as_error
def calculate_pareto(df: DataFrame, category_col: str, value_col: str | None = None, cutoff=PARETO_CUTOFF, top_n: int | None = None) -> dict:
    require(df, "df", category_col, *[value_col] * (value_col is not None))
    limit = finite_number(cutoff, "cutoff")
    if not 0 < limit <= 1:
        raise ValueError(f"cutoff is a share above 0, up to 1; {cutoff!r} is not.")
    if value_col is not None and df.where(number(df, value_col) < 0).take(1):
        raise ValueError(f"{value_col} holds negative values, for which shares have no meaning.")
    rows = pareto(df, category_col, value_col, limit).orderBy("rank").drop("rank").collect()
    measured = "count" if value_col is None else value_col
    if not rows:
        raise ValueError(f"The total of {measured} is zero, so there are no shares.")
    total = sum(r["value"] for r in rows)
    rows = to_jsonable(rows[: int(top_n)] if top_n is not None and int(top_n) > 0 else rows)
    vital = [r for r in rows if r["is_vital_few"]]
    return {"categories": rows, "total": total, "vital_few": [r["category"] for r in vital], "vital_few_count": len(vital), "vital_few_share": vital[-1]["cumulative_percentage"] if vital else 0.0, "measured_by": measured, "cutoff": limit}


def failure_intervals(work_orders: DataFrame, time_col="reported_at", asset_col: str | None = None, wo_type_col="wo_type", breakdown_types=("breakdown",)) -> DataFrame:
    """asset, at and the interval since the asset's last failure: hours for timestamps, else units of the column. Never across assets."""
    require(work_orders, "work_orders", time_col, wo_type_col, *[asset_col] * (asset_col is not None))
    rows = breakdowns(work_orders, wo_type_col, breakdown_types)
    if is_text(rows, time_col):
        seen = rows.agg(F.count(col(time_col)).alias("n"), F.count(number(rows, time_col)).alias("numbers"), F.count(_moment(rows, time_col)).alias("times")).first()
        numeric = seen["numbers"] > 0 and seen["numbers"] == seen["n"]
        if not numeric and seen["n"] and not seen["times"]:
            raise ValueError(f"Column '{time_col}' holds neither numbers nor times.")
        at = number(rows, time_col) if numeric else _moment(rows, time_col)
    else:
        numeric, at = is_numeric(rows, time_col), number(rows, time_col) if is_numeric(rows, time_col) else col(time_col)
    rows = rows.select((col(asset_col) if asset_col else F.lit(None).cast("string")).alias("asset"), at.alias("at")).where("at is not null")
    before = F.lag("at").over(Window.partitionBy("asset").orderBy("at"))
    gap = F.col("at") - F.col("_b") if numeric else hours(F.col("at"), F.col("_b"))
    return rows.withColumn("_b", before).select("asset", "at", gap.cast("double").alias("interval"), F.lit("input_units" if numeric else "hours").alias("unit"))


@as_error
def calculate_time_between_failures(work_orders: DataFrame, time_col="reported_at", asset_col=None, wo_type_col="wo_type", breakdown_types=("breakdown",)) -> dict:
    rows = failure_intervals(work_orders, time_col, asset_col, wo_type_col, breakdown_types).orderBy("asset", "at").collect()
    known = [r for r in rows if r["interval"] is not None and math.isfinite(r["interval"]) and (asset_col is None or r["asset"] is not None)]
    per_asset = None
    if asset_col is not None:
        per_asset = {r["asset"]: 0 for r in rows if r["asset"] is not None}
        for r in known:
            per_asset[r["asset"]] += 1
    unit = "hours" if is_time(work_orders, time_col) else rows[0]["unit"] if rows else "input_units"
    return {"intervals": [r["interval"] for r in known], "n_intervals": len(known), "n_failures": len(rows), "assets": None if per_asset is None else len(per_asset), "per_asset": per_asset, "unit": unit}


# ------------------------------------------------------------------ Weibull


def weibull_mle(x: np.ndarray) -> tuple[float, float] | None:
    """Shape and scale of complete positive lifetimes: Newton on the profile likelihood's score, kept in a bracket; None without a root in [0.05, 50]."""
    logs = np.log(x)
    top = logs.max()
    scaled, mean = logs - top, logs.mean()

    def score(b: float) -> tuple[float, float]:
        w = np.exp(b * scaled)
        s0, s1, s2 = w.sum(), (w * logs).sum(), (w * logs * logs).sum()
        return s1 / s0 - 1 / b - mean, s2 / s0 - (s1 / s0) ** 2 + 1 / b**2

    low, high = 0.05, 50.0
    if not score(low)[0] < 0 < score(high)[0]:
        return None
    b = min(max(1.2 / max(logs.std(), 1e-9), low), high)
    for _ in range(100):
        f, slope = score(b)
        low, high = (b, high) if f < 0 else (low, b)
        new = b - f / slope
        new = new if low < new < high else (low + high) / 2
        if abs(new - b) <= 1e-12 * b:
            break
        b = new
    return float(b), float(np.exp(top + np.log(np.exp(b * scaled).mean()) / b))


def _weibull_shapes(logs: np.ndarray) -> np.ndarray:
    """The shapes that ``weibull_mle`` finds for many samples at once, a row of logarithms each; a row leaves when its own steps end, NaN without a root."""
    out = np.full(len(logs), np.nan)
    scaled, mean = logs - logs.max(1, keepdims=True), logs.mean(1)

    def score(b: np.ndarray, scaled: np.ndarray, logs: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.exp(b[:, None] * scaled)
        s0 = w.sum(1)
        w *= logs
        first = w.sum(1) / s0
        w *= logs
        return first - 1 / b - mean, w.sum(1) / s0 - first**2 + 1 / b**2

    low, high = np.full(len(logs), 0.05), np.full(len(logs), 50.0)
    b = np.clip(1.2 / np.maximum(logs.std(1), 1e-9), low, high)
    rows = np.arange(len(logs))
    keep = (score(low, scaled, logs, mean)[0] < 0) & (score(high, scaled, logs, mean)[0] > 0)
    for _ in range(100):
        if not keep.all():
            rows, scaled, logs, mean, low, high, b = (v[keep] for v in (rows, scaled, logs, mean, low, high, b))
        if not len(rows):
            break
        f, slope = score(b, scaled, logs, mean)
        low, high = np.where(f < 0, b, low), np.where(f < 0, high, b)
        new = b - f / slope
        new = np.where((low < new) & (new < high), new, (low + high) / 2)
        keep = np.abs(new - b) > 1e-12 * b
        out[rows] = np.where(keep, new, b)
        b = new
    return out


def _weibull_point(x: np.ndarray, least: int) -> tuple[dict[str, Any], np.ndarray]:
    """The fit without its interval, and the usable intervals."""
    out: dict[str, Any] = dict.fromkeys(("beta", "eta", "mttf", "b10_life"))
    usable = x[np.isfinite(x) & (x > 0)]
    out |= {"n_intervals": len(usable), "dropped_non_positive": len(x) - len(usable)}
    if len(x) and not len(usable):
        return out | {"reason": "No interval is positive and finite, and only such can follow a Weibull law.", "error": "No interval can be used."}, usable
    if len(usable) < least:
        return out | {"reason": f"A fit needs {least} usable intervals at least; there are {len(usable)}.", "error": f"{len(usable)} usable intervals are too few (min_intervals is {least})."}, usable
    fitted = weibull_mle(usable)
    if fitted is None:
        return out | {"reason": "The likelihood has no maximum with a shape from 0.05 to 50.", "error": "Weibull fit failed."}, usable
    beta, eta = fitted
    mttf, b10 = eta * math.gamma(1 + 1 / beta), eta * (-math.log(0.9)) ** (1 / beta)
    return out | {"beta": beta, "eta": eta, "mttf": mttf if math.isfinite(mttf) else None, "b10_life": b10, "reason": None, "error": None}, usable


def _weibull_interval(usable: np.ndarray, beta: float, confidence: float, n_bootstrap: int, seed: int) -> dict[str, Any]:
    """Percentile interval of the shape, shifted by the bootstrap's bias, and what it says of the hazard. Samples are drawn one after the other and fitted in blocks."""
    rng, logs = np.random.default_rng(seed), np.log(usable)
    block = max(1, 2**15 // len(logs))
    fits = np.concatenate([_weibull_shapes(rng.choice(logs, (min(block, n_bootstrap - i), len(logs)))) for i in range(0, n_bootstrap, block)])
    fits = fits[~np.isnan(fits)]
    low = high = None
    if len(fits):
        tail = (1 - confidence) / 2 * 100
        low, high = (float(v) - (float(np.mean(fits)) - beta) for v in np.percentile(fits, [tail, 100 - tail]))
    if low is None:
        pattern, valid, reason = None, None, "No bootstrap sample could be fitted, so the shape has no interval."
    elif low > 1:
        pattern, valid, reason = "wear_out", False, f"The interval of the shape [{low:.3f}, {high:.3f}] lies above 1: the hazard rises with age."
    elif high < 1:
        pattern, valid, reason = "infant_mortality", False, f"The interval of the shape [{low:.3f}, {high:.3f}] lies below 1: the hazard falls with age."
    else:
        pattern, valid, reason = "constant", True, f"The interval of the shape [{low:.3f}, {high:.3f}] holds 1: these data cannot tell the hazard from a constant one, which is no proof that it is constant."
    return {"beta_ci_lower": low, "beta_ci_upper": high, "constant_hazard_is_valid": valid, "hazard_pattern": pattern, "bootstrap_fits": len(fits), "reason": reason}


def _weibull(x: np.ndarray, confidence: float, n_bootstrap: int, seed: int, least: int) -> dict[str, Any]:
    """Fit, interval of the shape, and what follows for the hazard."""
    out: dict[str, Any] = dict.fromkeys(("beta", "eta", "beta_ci_lower", "beta_ci_upper", "constant_hazard_is_valid", "hazard_pattern", "mttf", "b10_life", "small_sample_warning"))
    point, usable = _weibull_point(x, least)
    out |= {"n_intervals": 0, "dropped_non_positive": 0, "bootstrap_fits": 0, "confidence": confidence} | point
    if out["error"]:
        return out
    out |= _weibull_interval(usable, out["beta"], confidence, n_bootstrap, seed)
    if len(usable) < 30:
        out["small_sample_warning"] = f"The verdict rests on {len(usable)} intervals. On so few, samples with a constant hazard are called something else more often than the confidence says, and the shape itself is biased upwards."
    return out


def calculate_weibull(intervals: Sequence[float], confidence=WEIBULL_CONFIDENCE, n_bootstrap=WEIBULL_BOOTSTRAP, random_state=SEED, min_intervals=WEIBULL_MIN) -> dict:
    try:
        x = np.asarray(intervals, float).ravel()
    except (TypeError, ValueError):
        return _weibull(np.zeros(0), WEIBULL_CONFIDENCE, 1, SEED, 1) | {"error": "The intervals are not numbers."}
    try:
        conf = float(confidence)
    except (TypeError, ValueError):
        conf = WEIBULL_CONFIDENCE
    if not 0 < conf < 1:
        sentence = f"A confidence lies between 0 and 1; {confidence!r} does not."
        return _weibull(np.zeros(0), 0.5, 1, SEED, 1) | {"confidence": None, "n_intervals": 0, "reason": sentence, "error": sentence}

    def whole(value, default):
        try:
            return int(value) if int(value) >= 1 else default
        except (TypeError, ValueError):
            return default

    return _weibull(x, conf, whole(n_bootstrap, WEIBULL_BOOTSTRAP), int(random_state) if str(random_state).lstrip("-").isdigit() else SEED, whole(min_intervals, WEIBULL_MIN))


def weibull_by_asset(intervals: DataFrame, asset_col="asset", interval_col="interval", confidence=WEIBULL_CONFIDENCE, n_bootstrap=WEIBULL_BOOTSTRAP, random_state=SEED, min_intervals=WEIBULL_MIN, order_by: str | None = None) -> DataFrame:
    """One fit for each asset, on the executors. One asset's failures are few by nature; they are what a group holds.

    Samples are drawn from the intervals in the order of ``order_by`` (of size
    without it), so the interval does not depend on partitions. The interval
    is a step of its own; who doesn't select its columns doesn't pay for it.
    Assets are dealt to four tasks a core: few bytes are much work here.
    """
    kind = dict(intervals.dtypes)[asset_col]
    point = "beta double, eta double, mttf double, b10_life double, n_intervals long, dropped_non_positive long, reason string, _x array<double>"

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        found, usable = _weibull_point(rows.column("_x").to_numpy(), min_intervals)
        found["_x"] = None if found.pop("error") else usable
        return pa.table({asset_col: rows.column(asset_col)[:1]} | {k: pa.array([v], t) for (k, v), t in zip(found.items(), kinds)})

    @F.arrow_udf("beta_ci_lower double, beta_ci_upper double, hazard_pattern string, bootstrap_fits long, reason string")
    def interval(x: pa.Array, beta: pa.Array) -> pa.Array:
        found = [None if b.as_py() is None else _weibull_interval(v.values.to_numpy(), b.as_py(), confidence, n_bootstrap, random_state) for v, b in zip(x, beta)]
        return pa.array(found, pa.struct([("beta_ci_lower", pa.float64()), ("beta_ci_upper", pa.float64()), ("hazard_pattern", pa.string()), ("bootstrap_fits", pa.int64()), ("reason", pa.string())]))

    kinds = [*[pa.float64()] * 4, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64())]
    tasks = 4 * intervals.sparkSession.sparkContext.defaultParallelism
    rows = intervals.where(col(interval_col).isNotNull()).select(col(asset_col), col(interval_col).cast("double").alias("_x"), (F.lit(0) if order_by is None else col(order_by)).alias("_o"))
    rows = rows.repartition(tasks, col(asset_col)).sortWithinPartitions(col(asset_col), "_o", "_x")
    fitted = rows.groupBy(col(asset_col)).applyInArrow(fit, f"`{asset_col}` {kind}, {point}").withColumn("_i", interval("_x", "beta"))
    i = F.col("_i")
    return fitted.select(
        col(asset_col), "beta", "eta", i["beta_ci_lower"].alias("beta_ci_lower"), i["beta_ci_upper"].alias("beta_ci_upper"), i["hazard_pattern"].alias("hazard_pattern"), "mttf", "b10_life",
        "n_intervals", "dropped_non_positive", F.coalesce(i["bootstrap_fits"], F.lit(0).cast("long")).alias("bootstrap_fits"), F.coalesce(i["reason"], "reason").alias("reason"),
    )


# ------------------------------------------------------------------ repairable systems and forecasts


def crow_amsaa(failures: DataFrame, time_col: str, observation_end: float, by: Sequence[str] = (), min_failures: int = CROW_MIN) -> DataFrame:
    """Power-law process of each group in one aggregate: n, the sum of log(T / t), shape, scale and current MTBF."""
    t = number(failures, time_col)
    kept = F.when((t > 0) & (t <= observation_end), t)
    rows = failures.groupBy(*by).agg(F.count(kept).alias("n_failures"), (F.count(t) - F.count(kept)).alias("dropped"), F.sum(F.log(F.lit(float(observation_end)) / kept)).alias("log_sum"))
    beta = F.when(F.col("n_failures") >= min_failures, divide(F.col("n_failures"), F.when(F.col("log_sum") > 0, F.col("log_sum"))))
    scale = F.col("n_failures") / F.pow(F.lit(float(observation_end)), F.col("beta"))
    return rows.withColumn("beta", beta).withColumns(
        {"beta_unbiased": (F.col("n_failures") - 1) / F.col("n_failures") * F.col("beta"), "lambda": scale, "current_mtbf": divide(1.0, scale * F.col("beta") * F.pow(F.lit(float(observation_end)), F.col("beta") - 1))}
    )


def _crow_bounds(n: int, log_sum: float, confidence: float) -> tuple[float, float]:
    tail = (1 - confidence) / 2
    return special.chi2_quantile(tail, 2 * n) / (2 * log_sum), special.chi2_quantile(1 - tail, 2 * n) / (2 * log_sum)


def calculate_crow_amsaa(failure_times: Sequence[float], observation_end: float, confidence=WEIBULL_CONFIDENCE, min_failures=CROW_MIN) -> dict:
    out: dict[str, Any] = dict.fromkeys(("beta", "beta_unbiased", "lambda_", "beta_ci_lower", "beta_ci_upper", "trend", "current_mtbf"))
    out |= {"n_failures": 0, "observation_end": None, "dropped": 0, "confidence": None}
    try:
        conf = positive_number(confidence, "confidence")
        if conf >= 1:
            raise ValueError(f"A confidence lies between 0 and 1; {confidence!r} does not.")
        out["confidence"] = conf
        end = out["observation_end"] = positive_number(observation_end, "observation_end")
        if isinstance(failure_times, bool):
            raise ValueError("failure_times holds no sequence of numbers.")
        t = np.asarray(failure_times, float).ravel()
        least = int(min_failures) if not isinstance(min_failures, bool) and int(min_failures) >= 1 else CROW_MIN
    except (TypeError, ValueError) as e:
        return out | {"reason": str(e), "error": str(e)}
    kept = t[np.isfinite(t) & (t > 0) & (t <= end)]
    n = len(kept)
    out |= {"n_failures": n, "dropped": len(t) - n}
    if n < least:
        sentence = f"A trend needs {least} failures at least; there are {n} (and {len(t) - n} unusable)."
        return out | {"reason": sentence, "error": sentence}
    log_sum = float(np.log(end / kept).sum())
    if log_sum <= 0:
        sentence = "All failures lie at the end of the observation, so no shape can be estimated."
        return out | {"reason": sentence, "error": sentence}
    beta = n / log_sum
    scale = n / end**beta
    low, high = _crow_bounds(n, log_sum, conf)
    trend = "worsening" if low > 1 else "improving" if high < 1 else "no_evidence"
    reason = {"worsening": "Failures come faster with time", "improving": "Failures come slower with time", "no_evidence": "The data do not show that the failure rate changes, which is no proof that it is constant"}[trend]
    rate = scale * beta * end ** (beta - 1)
    return out | {
        "beta": beta, "beta_unbiased": (n - 1) / n * beta, "lambda_": scale, "beta_ci_lower": low, "beta_ci_upper": high, "trend": trend, "current_mtbf": 1 / rate if rate > 0 else None,
        "reason": f"{reason} (shape {beta:.2f}, {conf:.0%} interval {low:.2f} to {high:.2f}).", "error": None,
    }


def poisson_quantile_column(p: float, mean: Column) -> Column:
    """The smallest count whose Poisson distribution function reaches p, as a fold over the counts up to far behind it."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    step = lambda s, k: F.struct(
        (s["upto"] + s["term"]).alias("upto"),
        (s["term"] * mean / (k + 1)).alias("term"),
        F.when(s["found"].isNull() & (s["upto"] + s["term"] >= p), k).otherwise(s["found"]).alias("found"),
    )
    start = F.struct(F.lit(0.0).alias("upto"), F.exp(-mean).alias("term"), F.lit(None).cast("int").alias("found"))
    return F.aggregate(F.sequence(F.lit(0), last), start, step)["found"]


def forecast_columns(n_failures: Column, lookback: Column, horizon: Column, interval: float = FORECAST_INTERVAL) -> dict[str, Column]:
    """rate, expected count, its Poisson interval and the chance of any failure ahead. Means up to 700 (a smaller e**-mean is 0)."""
    rate = divide(n_failures, lookback)
    mean = rate * horizon
    tail = (1 - interval) / 2
    return {"rate": rate, "expected": mean, "lower": poisson_quantile_column(tail, mean), "upper": poisson_quantile_column(1 - tail, mean), "prob_at_least_one": -F.expm1(-mean)}


def forecast_failure_count(n_failures: int, lookback: float, horizon: float, interval: float = FORECAST_INTERVAL) -> dict:
    out: dict[str, Any] = dict.fromkeys(("expected", "lower", "upper", "interval", "rate", "prob_at_least_one", "n_failures", "lookback", "horizon"))
    try:
        if isinstance(n_failures, bool) or float(n_failures) < 0 or float(n_failures) != int(n_failures):
            raise ValueError(f"n_failures counts failures; {n_failures!r} is no count.")
        out["n_failures"] = n = int(n_failures)
        out["lookback"] = back = positive_number(lookback, "lookback")
        out["horizon"] = ahead = positive_number(horizon, "horizon")
        out["interval"] = share = positive_number(interval, "interval")
        if share >= 1:
            raise ValueError(f"An interval covers a share between 0 and 1; {interval!r} is none.")
    except (TypeError, ValueError, OverflowError) as e:
        return out | {"distribution": [], "note": str(e), "error": str(e)}
    mean = n / back * ahead
    low, high = (special.poisson_quantile(p, mean) if mean else 0 for p in ((1 - share) / 2, 1 - (1 - share) / 2))
    note = "The interval covers the Poisson scatter alone, not the uncertainty of the rate." if n else "No failures in the lookback: a forecast of zero is not a risk of zero, the window may be too short."
    return out | {
        "expected": mean, "lower": low, "upper": high, "rate": n / back, "prob_at_least_one": -math.expm1(-mean),
        "distribution": [{"k": k, "probability": special.poisson_pmf(k, mean)} for k in range(max(high + 2, 4) + 1)], "note": note, "error": None,
    }


# ------------------------------------------------------------------ planned maintenance


def cost_rate(t: float, beta: float, eta: float, planned: float, breakdown: float) -> float:
    """Long-run cost per unit of time of age replacement at t: expected cost of a cycle over its expected length."""
    if t <= 0:
        return math.inf
    z = (t / eta) ** beta
    survive = math.exp(-z) if z < 700 else 0.0
    length = eta / beta * math.gamma(1 / beta) * (special.gamma_p(1 / beta, z) if z < 700 else 1.0)
    return (planned * survive + breakdown * (1 - survive)) / length if length > 0 else math.inf


def _plan_arguments(beta, eta, cost_planned, cost_breakdown) -> tuple[float, float, float, float]:
    return tuple(positive_number(v, k) for k, v in (("beta", beta), ("eta", eta), ("cost_planned", cost_planned), ("cost_breakdown", cost_breakdown)))


def calculate_optimal_pm_interval(beta, eta, cost_planned, cost_breakdown, min_saving_fraction=PM_SAVING) -> dict:
    out: dict[str, Any] = dict.fromkeys(("interval", "cost_rate", "cost_rate_run_to_failure", "saving_fraction", "prob_failure_before_pm", "beta", "eta", "cost_ratio")) | {"worthwhile": False}
    try:
        b, e, planned, breakdown = _plan_arguments(beta, eta, cost_planned, cost_breakdown)
    except (TypeError, ValueError) as err:
        return out | {"reason": str(err), "error": str(err)}
    try:
        least = float(min_saving_fraction)
        least = least if math.isfinite(least) and least >= 0 and not isinstance(min_saving_fraction, bool) else PM_SAVING
    except (TypeError, ValueError):
        least = PM_SAVING
    never = breakdown / (e * math.gamma(1 + 1 / b))
    out |= {"cost_rate_run_to_failure": never, "saving_fraction": 0.0, "beta": b, "eta": e, "cost_ratio": breakdown / planned, "error": None}
    if b <= 1:
        return out | {"reason": "The hazard does not rise (shape <= 1), so a fixed schedule cannot beat running to failure."}
    if breakdown <= planned:
        return out | {"reason": "A breakdown costs no more than a planned job, so planning cannot save money."}
    grid = np.geomspace(0.01 * e, 5 * e, 400)
    costs = [cost_rate(float(t), b, e, planned, breakdown) for t in grid]
    i = int(np.argmin(costs))
    best, rate = special.golden_minimum(lambda t: cost_rate(t, b, e, planned, breakdown), float(grid[max(i - 1, 0)]), float(grid[min(i + 1, 399)]))
    saving = 1 - rate / never
    good = saving >= least and i < 399
    risk = -math.expm1(-((best / e) ** b))
    reason = f"Service every {best:.1f} units: {saving:.1%} cheaper in the long run, with {risk:.1%} risk of failing first." if good else f"Planned service would save {saving:.1%}, below the {least:.1%} that makes it worthwhile."
    return out | {"interval": best, "cost_rate": rate, "saving_fraction": saving, "prob_failure_before_pm": risk, "worthwhile": good, "reason": reason}


def _points(points) -> int:
    if isinstance(points, bool) or float(points) != int(points) or not 10 <= int(points) <= 500:
        raise ValueError(f"points may be any whole number from 10 to 500, not {points!r}.")
    return int(points)


def weibull_curves(spark: SparkSession, beta: float, eta: float, points: int = 80, t_max: float | None = None) -> DataFrame:
    """t, density, reliability and hazard on an even grid, without the origin."""
    top = 2.5 * eta if t_max is None else t_max
    grid = spark.range(1, points + 1).select((F.col("id") * F.lit(top) / points).alias("t"))
    scaled = F.col("t") / eta
    rows = grid.withColumns({"reliability": F.exp(-F.pow(scaled, F.lit(float(beta)))), "hazard": beta / eta * F.pow(scaled, F.lit(beta - 1.0))})
    return rows.withColumn("pdf", F.col("hazard") * F.col("reliability"))


def calculate_weibull_curves(beta, eta, points=80, t_max=None) -> dict:
    out: dict[str, Any] = {"t": [], "pdf": [], "reliability": [], "hazard": [], "beta": None, "eta": None, "t_max": None, "hazard_shape": None}
    try:
        b, e, p = positive_number(beta, "beta"), positive_number(eta, "eta"), _points(points)
        top = 2.5 * e if t_max is None else positive_number(t_max, "t_max")
    except (TypeError, ValueError, OverflowError) as err:
        return out | {"reason": str(err), "error": str(err)}
    t = np.linspace(top / p, top, p)
    alive, hazard = np.exp(-((t / e) ** b)), b / e * (t / e) ** (b - 1)
    shape = "rising" if b > 1 else "falling" if b < 1 else "flat"
    return {"t": t.tolist(), "pdf": (hazard * alive).tolist(), "reliability": alive.tolist(), "hazard": hazard.tolist(), "beta": b, "eta": e, "t_max": top, "hazard_shape": shape, "reason": f"{p} points of a {shape} hazard.", "error": None}


def pm_cost_curve(spark: SparkSession, beta: float, eta: float, planned: float, breakdown: float, points: int = 80) -> DataFrame:
    """t and the cost rate of replacing at t, over [0.05, 3] scales."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["cost_rate"] = [cost_rate(t, beta, eta, planned, breakdown) for t in rows["t"]]
            yield rows

    step = (3 * eta - 0.05 * eta) / (points - 1)
    return spark.range(points).select((F.lit(0.05 * eta) + F.col("id") * step).alias("t")).mapInPandas(run, "t double, cost_rate double")


def calculate_pm_cost_curve(beta, eta, cost_planned, cost_breakdown, points=80) -> dict:
    out: dict[str, Any] = {"t": [], "cost_rate": [], "run_to_failure_rate": None, "beta": None, "eta": None, "cost_ratio": None}
    try:
        b, e, planned, breakdown = _plan_arguments(beta, eta, cost_planned, cost_breakdown)
        p = _points(points)
    except (TypeError, ValueError, OverflowError) as err:
        return out | {"reason": str(err), "error": str(err)}
    t = np.linspace(0.05 * e, 3 * e, p).tolist()
    return {"t": t, "cost_rate": [cost_rate(x, b, e, planned, breakdown) for x in t], "run_to_failure_rate": breakdown / (e * math.gamma(1 + 1 / b)), "beta": b, "eta": e, "cost_ratio": breakdown / planned, "reason": f"{p} points of the cost rate.", "error": None}
