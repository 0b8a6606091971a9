import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.operators import drift, metrics, profile


def test_placeholders_and_duplicates(spark):
    rows = [("N/A",)] * 60 + [(" - ",)] * 20 + [("ok",)] * 20
    got = profile.detect_silent_nulls(spark.createDataFrame(rows, "s string"))
    assert got["s"]["count"] == 80 and got["s"]["tokens"] == {"n/a": 60, "-": 20} and got["s"]["kind"] == "placeholder_string"
    twice = spark.createDataFrame([(i, None) for i in range(50)] * 3, "a int, b string")
    assert profile.duplicate_rows(twice).first()["duplicates"] == 100
    assert profile.detect_silent_nulls(spark.createDataFrame([(-999,), (1,)], "x int"))["x"]["kind"] == "numeric_sentinel"


def test_outliers_without_median_deviation(spark):
    df = spark.createDataFrame([(5.0,)] * 190 + [(900.0,)] * 10, "v double")
    assert profile.detect_outliers(df)["v"]["count"] == 10
    assert profile.detect_outliers(df, "iqr") == {}
    x = np.random.default_rng(0).exponential(1, 500)
    got = profile.detect_outliers(spark.createDataFrame([(float(v),) for v in x], "v double"), "iqr")["v"]
    a, b = np.percentile(x, [25, 75])
    assert got["count"] == ((x < a - 1.5 * (b - a)) | (x > b + 1.5 * (b - a))).sum() and got["flagged_max"] == pytest.approx(b + 1.5 * (b - a))


def test_audit(spark):
    clean = spark.createDataFrame([(float(i % 7), "abc"[i % 3], datetime.datetime(2024, 1, 1)) for i in range(60)], "x double, c string, at timestamp")
    got = profile.audit_data_quality(clean.dropDuplicates())
    assert got["grade"] == "production_ready" and set(got["dimensions"]) == {"completeness", "consistency", "validity", "uniqueness", "timeliness"}
    late = profile.audit_data_quality(clean, as_of=datetime.datetime(2023, 1, 1))
    assert late["dimensions"]["timeliness"]["score"] == 0.0
    dirty = spark.createDataFrame([(None, "1"), (None, "x"), (1.0, "N/A"), (1.0, "N/A")], "y double, mixed string")
    got = profile.audit_data_quality(dirty, "y")
    assert got["duplicate_rows"] == 1 and {i["dimension"] for i in got["issues"]} >= {"completeness", "consistency", "uniqueness"} and got["issues"][0]["severity"] == "critical"
    assert "error" in profile.audit_data_quality(clean.limit(0)) and "error" in profile.audit_data_quality(None)
    again = clean.select("x", F.lit(1).alias("x"))
    assert any("Repeated" in i["detail"] for i in profile.audit_data_quality(again)["issues"])


def test_inspection(spark):
    base = spark.range(100).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"), F.col("id").cast("double").alias("z"), (F.col("id") % 4).cast("string").alias("k"), F.lit("a").alias("one"))
    assert profile.inspect_data(base, "y")["recommended_metric"] == "f1" and "imbalanced" in profile.inspect_data(base, "y")["message"]
    assert profile.inspect_data(base, "z")["recommended_task"] == "regression"
    assert profile.inspect_data(base, "k")["recommended_metric"] == "macro_f1"
    assert profile.inspect_data(base, "one")["recommended_task"] == "invalid" and "error" in profile.inspect_data(base, "none")


def test_correlations(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 6, 200).astype(float)
    b = a + rng.integers(0, 4, 200)
    df = spark.createDataFrame([(float(x), float(y), 1.0, "t") for x, y in zip(a, b)], "a double, b double, c double, s string")
    import pandas as pd

    p = pd.DataFrame({"a": a, "b": b})
    assert profile.calculate_correlations(df)["matrix"][0][1] == pytest.approx(p.corr().iloc[0, 1])
    assert profile.calculate_correlations(df, "spearman")["matrix"][0][1] == pytest.approx(p.rank().corr().iloc[0, 1])
    holes = df.select("b", (F.col("a") * F.col("b")).alias("d"), F.when(F.col("b") != 4, F.col("a")).alias("a"))
    q = p.assign(d=p["a"] * p["b"], a=p["a"].where(p["b"] != 4))
    got = {(r["a"], r["b"]): r["correlation"] for r in profile.spearman(holes, ["a", "b", "d"]).collect()}
    for x, y in (("a", "b"), ("a", "d"), ("b", "d")):
        assert got[(x, y)] == pytest.approx(q[[x, y]].dropna().rank().corr().iloc[0, 1])
    n = len(a)
    signs = sum(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i in range(n) for j in range(i))
    ties = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
    n0 = n * (n - 1) / 2
    assert profile.calculate_correlations(df, "kendall")["matrix"][0][1] == pytest.approx(signs / np.sqrt((n0 - ties(a)) * (n0 - ties(b))))
    got = profile.calculate_correlations(df)
    assert set(got["skipped_columns"]) == {"c", "s"} and "error" in profile.calculate_correlations(df, "other")


def fleet(spark, shift, seed):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(f"M{m}", float(70 + 5 * m + rng.normal() + (shift if m == 1 else 0)), "ab"[int(rng.integers(2))]) for m in range(3) for _ in range(200)], "machine string, temp double, shift string")


def test_drift_by_asset_finds_the_one(spark):
    train, batch = fleet(spark, 0, 1), fleet(spark, 3, 2)
    got = drift.check_asset_drift(train, batch, "machine")
    assert got["assets_drifted"] == ["M1"] and got["per_asset"]["M1"]["drifted_features"]["temp"]["trigger"] == "mean_shift"
    assert got["per_asset"]["M1"]["drifted_features"]["temp"]["drift_magnitude"] > 5 * drift.check_data_drift(train, batch)["drifted_features"].get("temp", {"drift_magnitude": 0.25})["drift_magnitude"]
    some = drift.check_asset_drift(train.where("machine <> 'M2'"), batch.where("machine <> 'M0'"), "machine")
    assert {a: e["status"] for a, e in some["per_asset"].items()} == {"M0": "missing_from_batch", "M1": "checked", "M2": "unknown_asset"}
    assert "error" in drift.check_asset_drift(train, batch, "nope")


def test_psi_against_numpy(spark):
    rng = np.random.default_rng(3)
    t, b = rng.normal(0, 1, 400), rng.normal(0.5, 1.2, 300)
    edges = np.unique(np.quantile(t, np.linspace(0, 1, 11)))
    ft, fb = (np.histogram(np.clip(v, edges[0], edges[-1]), edges)[0] / len(v) for v in (t, b))
    ft, fb = np.where(ft > 0, ft, 1e-4), np.where(fb > 0, fb, 1e-4)
    frame = lambda v: spark.createDataFrame([(float(x),) for x in v], "x double")
    assert drift.calculate_psi(frame(t), frame(b), "x") == pytest.approx(((fb - ft) * np.log(fb / ft)).sum())
    assert drift.calculate_psi(frame([1.0] * 50), frame(b), "x") is None
    assert drift.calculate_categorical_psi(frame(t), frame(b), "x") is None
    assert "error" in drift.check_data_drift(frame(t).limit(0), frame(b))


def test_scores(spark):
    y, p = [0, 0, 1, 1, 1, 0], [0.1, 0.4, 0.35, 0.8, 0.8, 0.8]
    df = spark.createDataFrame(list(zip(y, p)), "y int, p double")
    got = metrics.ranking(df, F.col("y") == 1, F.col("p")).first()
    pairs = [(a > b) + 0.5 * (a == b) for a, s in zip(p, y) if s for b, q in zip(p, y) if not q]
    assert got["roc_auc"] == pytest.approx(np.mean(pairs))
    assert got["pr_auc"] == pytest.approx(2 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    sweep = metrics.threshold_sweep(df, F.col("y") == 1, F.col("p")).where("threshold = 0.4").first()
    assert (sweep["tp"], sweep["fp"], sweep["fn"], sweep["tn"], sweep["cost"]) == (2, 2, 1, 1, 500 + 300 + 40)
    cal = metrics.check_calibration(df, "y", "p")
    assert cal["brier_score"] == pytest.approx(np.mean((np.array(p) - y) ** 2)) and cal["n_rows"] == 6
    assert "error" in metrics.check_calibration(df.where("y = 1"), "y", "p") and "error" in metrics.check_calibration(df, "y", "p", 1)
    edge = metrics.check_calibration(spark.createDataFrame([(0, 0.3), (1, 0.9)], "y int, p double"), "y", "p")
    assert edge["bins"][0]["bin_lower"] == pytest.approx(0.2)
    assert metrics.fingerprint(df) == metrics.fingerprint(df.orderBy("p"))
