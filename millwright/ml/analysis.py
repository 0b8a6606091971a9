"""From a raw table to a priced model in one call, and over several seeds."""

from __future__ import annotations

import math
import statistics
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions.columns import col
from millwright.functions.constants import COST_FALSE_ALARM, COST_INSPECTION, COST_SCRAP, SEED, SWEEP_SEEDS
from millwright.functions.report import capped, to_jsonable
from millwright.ml.engine import Engine
from millwright.operators import profile, split
from millwright.sources.files import read_csv


def auto_analyze(data: str | DataFrame, target: str, cost_scrap=COST_SCRAP, cost_fa=COST_FALSE_ALARM, cost_insp=COST_INSPECTION, task="auto", time_budget=30, top_features: int | None = 10, save_to: str | None = None, val_size=0.2, test_size=0.2, random_state: int = SEED, group_col=None, time_col=None) -> dict:
    """Audit, split, fit, tune on validation rows, price and score on test rows, explain. Never raises; ``error`` says what went wrong."""
    report: dict[str, Any] = dict.fromkeys(("error", "task", "data_quality", "split", "model", "metrics", "cost", "threshold", "calibration", "top_features", "top_features_note", "saved_to"))
    report |= {"ok": False, "rows": 0, "features": 0, "random_state": random_state}
    try:
        if not isinstance(data, (str, DataFrame)):
            raise ValueError(f"data must be a path to a CSV file or a DataFrame, got {type(data).__name__}.")
        frame = read_csv(data) if isinstance(data, str) else data
        if target not in frame.columns:
            raise ValueError(f"Target column '{target}' is not in the data. Columns: {frame.columns[:20]}")
        facts = profile.inspect_data(frame, target)
        if "error" in facts:
            raise ValueError(facts["error"])
        if facts["recommended_task"] == "invalid":
            raise ValueError(facts["message"])
        audit = profile.audit_data_quality(frame, target)
        task = facts["recommended_task"] if task == "auto" else task
        parts = split.three_parts(frame, target, task, val_size, test_size, random_state, group_col, time_col).persist()
        drop = [c for c in ("part", group_col) if c]
        train, val, test = (parts.where(F.col("part") == p).drop(*drop) for p in ("train", "validation", "test"))
        sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
        engine = Engine(task=task, time_budget=time_budget, cost_sensitive_weighting=True, random_state=random_state).fit(train, target)
        if engine.task == "classification":
            report["threshold"] = {"optimal": engine.optimize_threshold(val, cost_scrap, cost_fa, cost_insp), "tuned_on": "validation", "n_validation_rows": sizes.get("validation", 0)}
            report["calibration"] = engine.check_calibration(val)
            report["cost"] = engine.calculate_cost_of_quality(test, cost_scrap, cost_fa, cost_insp)
        scores = engine.evaluate(test)
        explained = engine.explain_predictions(test, top_features)
        if save_to:
            engine.save(save_to)
        groups = None
        if group_col is not None:
            groups = capped([r[0] for r in parts.where("part = 'test'").select(col(group_col)).distinct().orderBy(group_col).collect()])
        one_class = engine.task == "classification" and test.select(col(target)).distinct().limit(2).count() < 2
        training = engine.get_training_report()
        report |= {
            "ok": True, "task": engine.task, "rows": facts["total_rows"], "features": len(engine.plan.raw), "data_quality": {k: audit.get(k) for k in ("dqs", "grade", "verdict", "issues")},
            "split": {"train": sizes.get("train", 0), "validation": sizes.get("validation", 0), "test": sizes.get("test", 0), "strategy": "group" if group_col else "time" if time_col else "random", "group_col": group_col, "time_col": time_col, "test_groups": groups, "test_class_balance_warning": "The test part holds one class only." if one_class else None},
            "model": {"name": engine.best_name, "metric_optimized": training["metric_optimized"], "validation_score": training["validation_score"], "anomaly_fallback": engine.is_anomaly_model},
            "metrics": scores, "top_features": explained["feature_attributions"], "top_features_note": explained["reason"], "saved_to": save_to,
        }
        parts.unpersist()
    except Exception as e:  # the report carries every failure
        report["error"] = f"{type(e).__name__}: {e}"
    return to_jsonable(report)


def run_seed_sweep(data: str | DataFrame, target: str, seeds: Sequence[int] = SWEEP_SEEDS, **options) -> dict:
    """The figures of several seeds: mean, deviation and spread of what every successful run has."""
    if "random_state" in options:
        return {"error": "The seeds come from `seeds`; random_state would fix every run."}
    try:
        seeds = [int(s) for s in seeds]
    except (TypeError, ValueError):
        return {"error": f"seeds must be a sequence of whole numbers, got {seeds!r}."}
    if not seeds or len(set(seeds)) != len(seeds):
        return {"error": "seeds must be distinct, and one at least."}
    runs, figures = [], []
    for seed in seeds:
        r = auto_analyze(data, target, random_state=seed, **options)
        runs.append({"seed": seed, "ok": r["ok"], "error": r["error"], "best_model": (r["model"] or {}).get("name")})
        if r["ok"]:
            flat = {f"{block}.{k}": float(v) for block in ("metrics", "cost") for k, v in (r[block] or {}).items() if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)}
            if isinstance(r["calibration"], dict) and "expected_calibration_error" in r["calibration"]:
                flat["calibration.expected_calibration_error"] = r["calibration"]["expected_calibration_error"]
            figures.append(flat)
    summary = {}
    for key in sorted(set.intersection(*map(set, figures))) if figures else ():
        v = [f[key] for f in figures]
        summary[key] = {"mean": statistics.fmean(v), "std": statistics.stdev(v) if len(v) > 1 else 0.0, "min": min(v), "max": max(v), "spread": max(v) - min(v), "n": len(v)}
    note = "Every seed failed." if not figures else "One seed succeeded, so there is no spread." if len(figures) == 1 else f"Report mean and deviation over {len(figures)} seeds; a gain below the spread is noise."
    return to_jsonable({"seeds": seeds, "n_seeds": len(seeds), "n_ok": len(figures), "runs": runs, "summary": summary, "stability_note": note})
