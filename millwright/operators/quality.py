"""Process capability and gauge studies."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions import special
from millwright.functions.columns import col, divide, number
from millwright.functions.constants import BASELINE_INFLATION, CAPABILITY_OUTLIER_ALPHA, CAPABILITY_OUTLIERS, CAPABILITY_RATIO, TAIL_3_SIGMA, TREND_ALPHA, TREND_LAMBDA, TREND_RATE, TREND_SIGMAS, WESTERN_ELECTRIC
from millwright.functions.report import as_error, finite_number, require, to_jsonable
from millwright.operators import spc


def capability(df: DataFrame, value: str, order_by, by=None, usl: float | None = None, lsl: float | None = None, baseline_n: int | None = None) -> DataFrame:
    """One row for each series: indices from the spread within (moving range) and overall, corrected skewness and kurtosis, and the straight-line trend."""
    by = spc._by(by)
    points = spc.with_baseline(spc.series(df, value, order_by, by), by, baseline_n)
    x, n = F.col("x"), F.col("n_points")
    rows = points.groupBy(*by).agg(
        F.count("*").alias("n_points"), F.avg(x).alias("mean"), F.first("sigma").alias("sigma_within"), F.first("centre").alias("baseline_centre"), F.stddev_samp(x).alias("sigma_overall"),
        F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2"), F.regr_slope(x, F.col("idx")).alias("slope"), F.regr_r2(x, F.col("idx")).alias("r2"),
    )
    for suffix, sigma in (("p", "sigma_within"), ("pp", "sigma_overall")):
        s = F.when(F.col(sigma) > 0, F.col(sigma))
        upper = (F.lit(usl) - F.col("mean")) / (3 * s) if usl is not None else F.lit(None).cast("double")
        lower = (F.col("mean") - F.lit(lsl)) / (3 * s) if lsl is not None else F.lit(None).cast("double")
        names = ("cp", "cpu", "cpl", "cpk") if suffix == "p" else ("pp", "ppu", "ppl", "ppk")
        both = (F.lit(usl) - F.lit(lsl)) / (6 * s) if usl is not None and lsl is not None else F.lit(None).cast("double")
        rows = rows.withColumns(dict(zip(names, (both, upper, lower, F.least(upper, lower)))))
    skew = F.when(n >= 3, F.col("_g1") * F.sqrt(n * (n - 1.0)) / (n - 2)).otherwise(F.col("_g1"))
    kurt = F.when(n >= 4, divide(n - 1.0, (n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)).when(n < 3, F.col("_g2"))
    return rows.withColumns({"sigma_ratio": divide(F.col("sigma_overall"), F.when(F.col("sigma_within") > 0, F.col("sigma_within"))), "skewness": skew, "excess_kurtosis": kurt}).drop("_g1", "_g2")


def criteria_values(df: DataFrame, value: str, order_by, by=None, target: float | None = None, baseline_n: int | None = None) -> DataFrame:
    """One row for each series with what the stability criteria judge: the ratio of sigmas, the points beyond 3 sigma, the share of EWMA violations and the fitted trend in sigmas.

    The sigma within is widened for a short baseline. One exchange by series serves all of them.
    """
    by = spc._by(by)
    inflation = 1 + BASELINE_INFLATION / math.sqrt(max(2, int(baseline_n))) if baseline_n else 1.0
    points = spc.with_baseline(spc.series(df, value, order_by, by), by, baseline_n, target)
    points = points.withColumn("sigma", F.col("sigma") * inflation)
    points = spc._smooth(points, by, TREND_LAMBDA, F.col("centre"))
    half = 3.0 * F.col("sigma") * F.sqrt(F.lit(TREND_LAMBDA / (2 - TREND_LAMBDA)) * (1 - F.pow(F.lit(1.0 - TREND_LAMBDA), 2 * (F.col("idx") + 1))))
    apart, drifted = F.abs(F.col("x") - F.col("centre")) > 3 * F.col("sigma"), F.abs(F.col("stat") - F.col("centre")) > half
    known = F.first("sigma") > 0
    rows = points.groupBy(*by).agg(
        F.count("*").alias("n_points"), divide(F.stddev_samp("x"), F.first("sigma") / inflation).alias("sigma_ratio"), F.when(known, F.count_if(apart)).otherwise(0).alias("beyond"),
        F.when(known, F.avg(drifted.cast("double"))).alias("ewma_violation_rate"), F.regr_slope("x", F.col("idx")).alias("slope"), F.regr_r2("x", F.col("idx")).alias("r2"), F.first("sigma").alias("sigma"),
    )
    n = F.col("n_points")
    return rows.withColumns({"outlier_rate_beyond_3_sigma": F.col("beyond") / n, "fitted_trend_sigmas": F.when(n >= 3, F.abs(F.col("slope") * (n - 1)) / F.when(F.col("sigma") > 0, F.col("sigma"))), "inflation": F.lit(inflation)})


def _sigma_ratio(c: dict) -> dict:
    value, limit = c["sigma_ratio"], CAPABILITY_RATIO * c["inflation"]
    return {"name": "sigma_ratio", "value": value, "limit": limit, "fired": value is not None and value > limit, "why": lambda: f"the overall sigma is {value:.2f} times the sigma within (limit {limit:.2f})"}


def _outlier_rate(c: dict) -> dict:
    n, count = c["n"], c["beyond"]
    rate = count / n
    tail = special.binomial_tail(count - 1, n, TAIL_3_SIGMA) if rate > CAPABILITY_OUTLIERS else 1.0
    return {"name": "outlier_rate_beyond_3_sigma", "value": rate, "limit": CAPABILITY_OUTLIERS, "fired": tail < CAPABILITY_OUTLIER_ALPHA, "why": lambda: f"{count} of {n} points lie beyond 3 sigma, which chance alone does with probability {tail:.1%}"}


def _ewma_trend(c: dict) -> dict:
    rate = c["trend_rate"]
    return {"name": "ewma_violation_rate", "value": rate, "limit": TREND_RATE, "fired": rate is not None and rate > TREND_RATE, "why": lambda: f"the EWMA of {rate:.1%} of the points lies outside its limits, as in a lasting drift"}


def _fitted_trend(c: dict) -> dict:
    n, sigma, value, p = c["n"], c["sigma"], None, 1.0
    if n >= 3 and sigma > 0 and c["slope"] is not None:
        value = abs(c["slope"] * (n - 1)) / sigma
        r2 = min(max(c["r2"] if c["r2"] is not None else 0.0, 0.0), 1.0)
        p = special.t_two_sided(math.sqrt(r2 * (n - 2) / (1 - r2)), n - 2) if r2 < 1 else 0.0
    fired = value is not None and value > TREND_SIGMAS and p < TREND_ALPHA
    return {"name": "fitted_trend_sigmas", "value": value, "limit": TREND_SIGMAS, "fired": fired, "why": lambda: f"the series {'rises' if c['slope'] > 0 else 'falls'} by {value:.2f} sigma from end to end, a slope that chance explains with probability {p:.1%}"}


#: Criteria that a process must meet before its indices mean anything; more may be added.
CRITERIA: list[Callable[[dict], dict]] = [_sigma_ratio, _outlier_rate, _ewma_trend, _fitted_trend]


@as_error
def calculate_capability(df: DataFrame, value: str, order_by, usl=None, lsl=None, target=None, baseline_n=None) -> dict:
    if usl is None and lsl is None:
        raise ValueError("One specification limit at least must be given.")
    usl, lsl, target = (None if v is None else finite_number(v, k) for k, v in (("usl", usl), ("lsl", lsl), ("target", target)))
    if usl is not None and lsl is not None and usl <= lsl:
        raise ValueError(f"The upper limit ({usl}) has to lie above the lower one ({lsl}).")
    row = capability(df, value, order_by, None, usl, lsl, baseline_n).first()
    if row is None or row["n_points"] < 2:
        raise ValueError(f"At least 2 numeric values are needed, got {row['n_points'] if row else 0}.")
    n, within = row["n_points"], row["sigma_within"]
    inflation = 1 + BASELINE_INFLATION / math.sqrt(max(2, int(baseline_n))) if baseline_n else 1.0
    found = criteria_values(df, value, order_by, None, target, baseline_n).first()
    context = {"n": n, "sigma_ratio": row["sigma_ratio"], "inflation": inflation, "sigma": found["sigma"], "beyond": found["beyond"], "trend_rate": found["ewma_violation_rate"], "slope": row["slope"], "r2": row["r2"]}
    judged = [c(context) for c in CRITERIA]
    reasons = [c["why"]() for c in judged if c["fired"]]
    cpk = row["cpk"]
    rules = spc.calculate_control_rules(df, value, order_by, target=target, baseline_n=baseline_n, rules=WESTERN_ELECTRIC)
    skew, kurt = row["skewness"], row["excess_kurtosis"]
    odd = max(abs(skew or 0), abs(kurt or 0)) > 1
    if reasons:
        meaning = f"The process is not in control, so its indices describe no one distribution: {'; '.join(reasons)}."
    else:
        meaning = "The process is in control; its indices describe it." if cpk is not None else "The values do not vary within subgroups, so there are no indices."
    return to_jsonable(
        {
            "n_points": n, "mean": row["mean"], "usl": usl, "lsl": lsl, "target": target, "sigma_within": within, "sigma_overall": row["sigma_overall"], "sigma_ratio": row["sigma_ratio"],
            "sigma_ratio_note": "A ratio well above 1 means that variation comes between subgroups rather than within them.", **{k: row[k] for k in ("cp", "cpk", "cpu", "cpl", "pp", "ppk", "ppu", "ppl")},
            "stable": not reasons, "stability_violations": sorted(int(r) for r, hits in rules.get("violations", {}).items() if hits), "outlier_rate_beyond_3_sigma": judged[1]["value"],
            "stability_criteria": [{k: v for k, v in c.items() if k != "why"} | {"reason": c["why"]() if c["fired"] else None} for c in judged], "capability_is_meaningful": not reasons and cpk is not None, "interpretation": meaning,
            "skewness": skew, "excess_kurtosis": kurt, "normality_warning": f"Skewness {skew:.2f} and excess kurtosis {kurt or 0:.2f} are far from normal, so the indices misstate the share out of limits." if odd else None,
            "verdict": None if cpk is None else "capable" if cpk >= 1.33 else "marginal" if cpk >= 1 else "not capable", "control_rules": rules,
        }
    )


def gauge_sums(df: DataFrame, part: str, operator: str, measurement: str) -> DataFrame:
    """One row of sums of squares and counts of a crossed study: the means of all four grains come from one aggregate over grouping sets."""
    y = number(df, measurement)
    rows = df.select(col(part).alias("p"), col(operator).alias("o"), y.alias("y"))
    grains = rows.groupingSets([["p", "o"], ["p"], ["o"], []], "p", "o").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("y").alias("m"), (F.var_pop("y") * F.count("y")).alias("q"), F.sum(F.col("y").isNull().cast("long")).alias("bad"))
    whole = grains.where("g = 3").select(F.col("m").alias("mean"), F.col("n").alias("total"), F.col("q").alias("squares"), F.col("bad"))
    apart = (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean")) * F.col("n")
    joined = grains.drop("bad", "q").join(F.broadcast(whole), F.lit(True))  # one row
    at = lambda g, c: F.sum(F.when(F.col("g") == g, c))
    return joined.groupBy("mean", "total", "bad").agg(
        F.max("squares").alias("ss_total"), at(1, apart).alias("ss_parts"), at(2, apart).alias("ss_operators"), at(0, apart).alias("ss_cells"),
        at(1, F.lit(1)).alias("parts"), at(2, F.lit(1)).alias("operators"), at(0, F.lit(1)).alias("cells"), F.min(F.when(F.col("g") == 0, F.col("n"))).alias("least"), F.max(F.when(F.col("g") == 0, F.col("n"))).alias("most"),
    )


def cell_balance(df: DataFrame, part: str, operator: str) -> DataFrame:
    """(part, operator, n, usual, balanced) of each cell of a study; the usual number is the most frequent one, the least of equal ones."""
    cells = df.groupBy(col(part).cast("string").alias("part"), col(operator).cast("string").alias("operator")).agg(F.count("*").alias("n"))
    usual = cells.groupBy(F.col("n").alias("usual")).agg(F.count("*").alias("k")).agg(F.max_by("usual", F.struct("k", -F.col("usual"))).alias("usual"))
    return cells.join(F.broadcast(usual), F.lit(True)).withColumn("balanced", F.col("n") == F.col("usual"))  # one row


@as_error
def calculate_gauge_rr(df: DataFrame, part_col: str, operator_col: str, measurement_col: str) -> dict:
    require(df, "df", part_col, operator_col, measurement_col)
    s = gauge_sums(df, part_col, operator_col, measurement_col).first()
    if s is None or not s["total"]:
        raise ValueError("The study is empty.")
    if s["bad"]:
        raise ValueError(f"Column '{measurement_col}' holds missing or non-numeric values.")
    a, b = s["parts"], s["operators"]
    for name, k in (("parts", a), ("operators", b)):
        if k < 2:
            raise ValueError(f"At least 2 {name} are needed, found {k}.")
    if s["cells"] != a * b:
        raise ValueError(f"Unbalanced design: {a * b - s['cells']} of {a * b} combinations of part and operator are missing.")
    if s["least"] != s["most"]:
        strange = cell_balance(df, part_col, operator_col).where("not balanced").orderBy("part", "operator").limit(20).collect()
        odd = {f"({r['part']}, {r['operator']})": r["n"] for r in strange}
        raise ValueError(f"Unbalanced design: {strange[0]['usual']} replicates are usual, but not in {odd}.")
    n = s["least"]
    if n < 2:
        raise ValueError(f"At least 2 replicates are needed, found {n}.")
    inter = max(0.0, s["ss_cells"] - s["ss_parts"] - s["ss_operators"])
    error = max(0.0, s["ss_total"] - s["ss_cells"])
    d_inter, d_error = (a - 1) * (b - 1), a * b * (n - 1)
    ms_part, ms_op, ms_inter, ms_error = s["ss_parts"] / (a - 1), s["ss_operators"] / (b - 1), inter / d_inter, error / d_error
    p = special.f_tail(ms_inter / ms_error, d_inter, d_error) if ms_error > 0 else 1.0
    pooled = p > 0.25
    repeat = (inter + error) / (d_inter + d_error) if pooled else ms_error
    base = repeat if pooled else ms_inter
    raw = {"interaction": 0.0 if pooled else (ms_inter - ms_error) / n, "operator": (ms_op - base) / (a * n), "part": (ms_part - base) / (b * n)}
    notes = [f"The negative variance of the {k} was set to zero." for k, v in raw.items() if v < 0]
    var = {k: max(0.0, v) for k, v in raw.items()}
    parts = {"repeatability": repeat, "reproducibility": var["operator"] + var["interaction"], "operator": var["operator"], "interaction": var["interaction"], "gauge_rr": repeat + var["operator"] + var["interaction"], "part_variation": var["part"]}
    total = parts["gauge_rr"] + parts["part_variation"]
    sd = {k: math.sqrt(v) for k, v in parts.items()}
    study = {k: 100 * v / math.sqrt(total) if total else 0.0 for k, v in sd.items()}
    ndc = int(1.41 * sd["part_variation"] / sd["gauge_rr"]) if sd["gauge_rr"] > 0 else None
    return to_jsonable(
        {
            "n_parts": a, "n_operators": b, "n_replicates": n, "n_total": s["total"], "interaction_p_value": p, "interaction_pooled": pooled, "variance_components": parts | {"total_variation": total}, "standard_deviations": sd | {"total_variation": math.sqrt(total)},
            "percent_contribution": {k: 100 * v / total if total else 0.0 for k, v in parts.items()}, "percent_study_variation": study, "ndc": ndc,
            "verdict": "acceptable" if study["gauge_rr"] < 10 else "marginal" if study["gauge_rr"] <= 30 else "unacceptable", "ndc_verdict": "acceptable" if ndc is not None and ndc >= 5 else "unacceptable", "notes": notes,
        }
    )


def add_criterion(criterion: Callable[[dict], dict]) -> None:
    """Register one more condition on a stable process."""
    CRITERIA.append(criterion)


__all__: Sequence[str] = ("capability", "calculate_capability", "gauge_sums", "calculate_gauge_rr", "add_criterion")
