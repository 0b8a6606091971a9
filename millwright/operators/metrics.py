"""Scores of predictions: calibration, confusion, ranking, regression, cost and thresholds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.columns import col, divide, finite, is_numeric, number
from millwright.functions.constants import CALIBRATION_BINS, COST_BREAKDOWN, COST_CALLOUT, COST_FALSE_ALARM, COST_INSPECTION, COST_PLANNED, COST_SCRAP, ECE_LIMIT
from millwright.functions.ordered import running
from millwright.functions.report import as_error, require, to_jsonable

THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 19))


def _edges(bins: int) -> list[float]:
    step = 1.0 / bins
    return [i * step for i in range(1, bins)]


def calibration_bins(df: DataFrame, outcome: Column, prob: Column, bins: int = CALIBRATION_BINS) -> DataFrame:
    """bin, count, mean_predicted and observed_rate of the bins that hold rows; a bin is the number of inner edges up to the probability."""
    rows = df.select(outcome.cast("double").alias("y"), finite(prob.cast("double")).alias("p")).where("y is not null and p is not null")
    at = F.size(F.filter(F.array(*map(F.lit, _edges(bins))), lambda e: e <= F.col("p")))
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("count"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("observed_rate"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("squares"), F.min("p").alias("least"), F.max("p").alias("most"))


def calibration_summary(bins: DataFrame) -> DataFrame:
    n = F.sum("count")
    base = F.sum(F.col("count") * F.col("observed_rate")) / n
    gap = F.abs(F.col("mean_predicted") - F.col("observed_rate"))
    rows = bins.agg(n.alias("n_rows"), base.alias("base_rate"), (F.sum("squares") / n).alias("brier_score"), (F.sum(F.col("count") * gap) / n).alias("expected_calibration_error"), F.max(gap).alias("max_calibration_error"))
    return rows.withColumn("brier_skill_score", 1 - divide(F.col("brier_score"), F.col("base_rate") * (1 - F.col("base_rate"))))


@as_error
def check_calibration(df: DataFrame, label_col: str, prob_col: str, n_bins: int = CALIBRATION_BINS) -> dict:
    require(df, "df", label_col, prob_col)
    bins = int(n_bins)
    if bins < 2:
        raise ValueError(f"Two bins are the least; got {n_bins!r}.")
    labels = [r[0] for r in df.where(col(label_col).isNotNull()).select(col(label_col)).distinct().limit(3).collect()]
    if len(labels) != 2:
        raise ValueError(f"Calibration needs two outcome classes, found {len(labels) if len(labels) < 3 else 'more'}.")
    numeric = is_numeric(df, label_col) and {float(v) for v in labels} == {0.0, 1.0}
    positive = 1 if numeric else sorted(labels, key=str)[-1]
    outcome = number(df, label_col) if numeric else (col(label_col) == F.lit(positive)).cast("double")
    found = calibration_bins(df, outcome, number(df, prob_col), bins).orderBy("bin").collect()
    if not found:
        raise ValueError("No rows have both an outcome and a finite probability.")
    low, high = min(r["least"] for r in found), max(r["most"] for r in found)
    if low < 0 or high > 1:
        raise ValueError(f"These are no probabilities: they reach from {low} to {high}.")
    n = sum(r["count"] for r in found)
    base = sum(r["count"] * r["observed_rate"] for r in found) / n
    brier, limit = sum(r["squares"] for r in found) / n, base * (1 - base)
    edges = [0.0, *_edges(bins), 1.0]
    rows = [{"bin_lower": edges[r["bin"]], "bin_upper": edges[r["bin"] + 1], "count": r["count"], "mean_predicted": r["mean_predicted"], "observed_rate": r["observed_rate"], "gap": r["mean_predicted"] - r["observed_rate"]} for r in found]
    ece = sum(r["count"] * abs(r["gap"]) for r in rows) / n
    good = ece <= ECE_LIMIT
    sign = "over-confident" if sum(r["gap"] * r["count"] for r in rows) > 0 else "under-confident"
    return to_jsonable(
        {
            "n_rows": n, "n_bins": bins, "n_bins_used": len(rows), "positive_label": str(positive), "base_rate": base, "brier_score": brier, "brier_skill_score": 1 - brier / limit if limit > 0 else None, "expected_calibration_error": ece,
            "max_calibration_error": max(abs(r["gap"]) for r in rows), "is_well_calibrated": good, "ece_limit": ECE_LIMIT, "bins": rows,
            "interpretation": f"The mean gap to the observed rates is {ece:.3f}" + ("; the scores may be read as probabilities." if good else f", above {ECE_LIMIT}; the model is {sign}. Rankings hold, but the scores are no probabilities."),
        }
    )


def confusion(df: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    """(label, predicted, n), as text."""
    return df.groupBy(col(label_col).cast("string").alias("label"), col(pred_col).cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def binary_counts(df: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn in one row, from boolean columns."""
    at = lambda a, b: F.count_if((label == a) & (predicted == b))
    return df.agg(at(True, True).alias("tp"), at(False, True).alias("fp"), at(True, False).alias("fn"), at(False, False).alias("tn"))


def binary_scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select("*", zero(divide(tp + tn, tp + fp + fn + tn)).alias("accuracy"), zero(divide(tp, tp + fp)).alias("precision"), zero(divide(tp, tp + fn)).alias("recall"), zero(divide(2 * tp, 2 * tp + fp + fn)).alias("f1"), zero(divide(tp * tn - fp * fn, root)).alias("mcc"))


def class_scores(pairs: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of each class, from the confusion table."""
    by = lambda c: pairs.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(c))
    hit = pairs.where("label = predicted").select(F.col("label").alias("class"), F.col("n").alias("hit"))
    rows = by("label").join(by("predicted"), "class", "full_outer").join(hit, "class", "left").fillna(0, ["label", "predicted", "hit"])
    precision, recall = F.coalesce(divide(F.col("hit"), F.col("predicted")), F.lit(0.0)), F.coalesce(divide(F.col("hit"), F.col("label")), F.lit(0.0))
    return rows.select("class", precision.alias("precision"), recall.alias("recall"), F.coalesce(divide(2 * F.col("hit"), F.col("label") + F.col("predicted")), F.lit(0.0)).alias("f1"), F.col("label").alias("support"))


def multiclass_mcc(pairs: Sequence) -> float:
    """R_k of a collected confusion table; 0 if either side has one class."""
    n = sum(r["n"] for r in pairs)
    truth, guess = {}, {}
    for r in pairs:
        truth[r["label"]] = truth.get(r["label"], 0) + r["n"]
        guess[r["predicted"]] = guess.get(r["predicted"], 0) + r["n"]
    hit = sum(r["n"] for r in pairs if r["label"] == r["predicted"])
    cross = sum(truth.get(k, 0) * v for k, v in guess.items())
    bottom = math.sqrt((n * n - sum(v * v for v in guess.values())) * (n * n - sum(v * v for v in truth.values())))
    return (hit * n - cross) / bottom if bottom else 0.0


def _score_groups(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """Positives and negatives of each distinct score, and those ranked above it, counted over distinct scores."""
    groups = df.groupBy(score.alias("s")).agg(F.count_if(label).alias("p"), F.count_if(~label).alias("q")).where("s is not null")
    return running(groups, "s", {"tp": "p", "fp": "q"}, descending=True)


def ranking(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """roc_auc, with ties counted half, and pr_auc as the step sum over distinct scores, in one row."""
    g = _score_groups(df, label, score)
    total = g.groupBy().agg(F.sum("p").alias("P"), F.sum("q").alias("N"), F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)).alias("won"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("steps"))
    return total.select(divide(F.col("won"), F.col("P") * F.col("N")).alias("roc_auc"), F.when(F.col("N") > 0, divide(F.col("steps"), F.col("P"))).alias("pr_auc"), divide(F.col("P"), F.col("P") + F.col("N")).alias("base_rate"))


def regression_scores(df: DataFrame, label: Column, predicted: Column) -> DataFrame:
    y, p = label.cast("double"), predicted.cast("double")
    rows = df.select(y.alias("y"), p.alias("p")).where("y is not null and p is not null")
    e = F.col("y") - F.col("p")
    one = rows.agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("y").alias("var"), F.avg(F.when(F.col("y") != 0, F.abs(e / F.col("y")))).alias("mape"))
    return one.select(F.col("n").alias("n_rows"), (1 - divide(F.col("mse"), F.col("var"))).alias("r2"), F.sqrt("mse").alias("rmse"), "mae", (F.col("mape") * 100).alias("mape"))


def threshold_sweep(df: DataFrame, label: Column, score: Column, cost_fn: float = COST_SCRAP, cost_fp: float = COST_FALSE_ALARM, cost_tp: float = COST_INSPECTION, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(threshold, tp, fp, fn, tn, cost). Rows are counted by the number of thresholds they reach, so each row is read once and none multiplies."""
    reached = F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= score))
    steps = df.where(score.isNotNull() & label.isNotNull()).groupBy(reached.alias("k")).agg(F.count_if(label).alias("p"), F.count_if(~label).alias("q"))
    grid = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(thresholds)], "i int, threshold double")
    joined = grid.join(steps, F.lit(True))  # one row for each threshold and step
    at = lambda c, hit: F.coalesce(F.sum(F.when((F.col("k") >= F.col("i")) == hit, F.col(c))), F.lit(0))
    rows = joined.groupBy("threshold").agg(at("p", True).alias("tp"), at("q", True).alias("fp"), at("p", False).alias("fn"), at("q", False).alias("tn"))
    return rows.withColumn("cost", F.col("fn") * cost_fn + F.col("fp") * cost_fp + F.col("tp") * cost_tp)


def quality_cost_columns(tp: Column, fp: Column, fn: Column, tn: Column, cost_scrap=COST_SCRAP, cost_fa=COST_FALSE_ALARM, cost_insp=COST_INSPECTION, base_det_rate=0.0, base_fp_rate=0.0) -> dict[str, Column]:
    """Cost without the model (at the rates that inspection has anyway), with it, and what it saves."""
    found, alarms = F.floor((tp + fn) * base_det_rate), F.floor((fp + tn) * base_fp_rate)
    before = (tp + fn - found) * cost_scrap + alarms * cost_fa + found * cost_insp
    after = fn * cost_scrap + fp * cost_fa + tp * cost_insp
    saved = before - after
    return {"baseline_cost": before.cast("double"), "model_cost": after.cast("double"), "cost_savings": saved.cast("double"), "savings_percentage": F.when(before > 0, saved / before * 100).otherwise(0.0)}


def best_threshold(sweep: DataFrame) -> float:
    """The cheapest threshold, the lowest of equal ones."""
    return sweep.agg(F.min_by("threshold", F.struct("cost", "threshold")).alias("t")).first()["t"]


def maintenance_sweep(df: DataFrame, label: Column, score: Column, breakdown=COST_BREAKDOWN, planned=COST_PLANNED, inspection=COST_CALLOUT) -> DataFrame:
    return threshold_sweep(df, label, score, breakdown, inspection, inspection + planned)


def fingerprint(df: DataFrame) -> str:
    """Rows, columns and an order-free hash of all rows."""
    h = F.xxhash64(*(col(c) for c in df.columns))
    r = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}x{len(df.columns)}:{(r['x'] or 0) & (1 << 64) - 1:016x}:{int(r['s'] or 0) % (1 << 64):016x}"
