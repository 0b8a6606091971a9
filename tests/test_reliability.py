import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.operators import reliability as r


def test_wilson():
    got = r.wilson_confidence_interval(3, 30)
    assert (got["point"], round(got["lower"], 5), round(got["upper"], 5)) == (0.1, 0.0346, 0.25621)
    assert r.wilson_confidence_interval(5, 0)["point"] is None
    assert r.wilson_confidence_interval("x", 3)["point"] is None


def test_savings():
    got = r.calculate_maintenance_savings(18, 25, 2)
    assert (got["cost_savings"], round(got["savings_percentage"], 2)) == (691_500.0, 69.15)
    assert r.calculate_maintenance_savings(20, 980, 0)["cost_savings"] == -660_000.0
    assert r.calculate_maintenance_savings(20, 540, 0)["cost_savings"] == 0.0
    assert "error" in r.calculate_maintenance_savings(-1, 0, 0)


def test_availability_and_oee():
    assert r.calculate_availability(100, 0)["inherent_availability"] == 1.0
    assert "error" in r.calculate_availability(0, 0)
    got = r.calculate_availability(95, 5, 25)
    assert got["operational_availability"] == pytest.approx(95 / 120)
    oee = r.calculate_oee(480, 400, 1.0, 380, 361)
    assert oee["oee"] == pytest.approx(400 / 480 * 380 / 400 * 361 / 380)
    assert r.calculate_oee(100, 120, 1, 130, 130)["warnings"] and len(r.calculate_oee(100, 120, 1, 130, 130)["warnings"]) == 2
    assert "error" in r.calculate_oee(100, 0, 1, 1, 1)


@pytest.fixture(scope="module")
def work_orders(spark):
    rows = [("M1", "breakdown", "2024-01-01 00:00", "2024-01-01 00:30", "2024-01-01 02:30"), ("M1", "breakdown", "2024-01-02 00:00", "2024-01-02 00:15", "2024-01-02 01:15"), ("M2", "breakdown", "2024-01-03 00:00", "2024-01-03 01:00", "2024-01-03 04:00"), ("M2", "breakdown", "2024-01-05 00:00", "2024-01-05 00:15", "2024-01-05 00:45"), ("M2", "pm", "2024-01-06 00:00", None, None)]
    return spark.createDataFrame(rows, "machine_id string, wo_type string, reported_at string, started_at string, finished_at string")


def test_mtbf_and_mttr(work_orders):
    got = r.calculate_mtbf(work_orders, 1000)
    assert (got["mtbf_hours"], got["breakdowns"], got["failure_rate_per_hour"]) == (250.0, 4, 0.004)
    got = r.calculate_mttr(work_orders)
    assert (got["mttr_hours"], got["mtta_hours"], got["mdt_hours"], got["longest_repair_hours"], got["longest_wait_hours"]) == (1.625, 0.5, 2.125, 3.0, 1.0)
    assert got["mttr_hours"] + got["mtta_hours"] == got["mdt_hours"]
    assert "error" in r.calculate_mtbf(work_orders, 0)
    assert r.calculate_mttr(work_orders, breakdown_types=("none",))["repairs"] == 0
    assert "error" in r.calculate_mttr(work_orders.drop("started_at"))


def test_intervals_never_cross_assets(work_orders):
    got = r.calculate_time_between_failures(work_orders, "reported_at", "machine_id")
    assert got["intervals"] == [24.0, 48.0] and got["per_asset"] == {"M1": 1, "M2": 1} and got["unit"] == "hours"
    assert r.calculate_time_between_failures(work_orders)["n_intervals"] == 3
    assert "error" in r.calculate_time_between_failures(work_orders.withColumnRenamed("reported_at", "x"), "machine_id")


def test_pareto(spark):
    rows = [("Bearing", 4.0)] * 10 + [("Sensor", 0.5)] * 25 + [("Belt", 6.0)] * 5 + [("Motor", 10.0)] * 2 + [("Other", 0.5)] * 8
    df = spark.createDataFrame(rows, "mode string, hours double")
    got = r.calculate_pareto(df, "mode")
    assert got["vital_few"] == ["Sensor", "Bearing", "Other"] and [round(c["cumulative_percentage"]) for c in got["categories"][:3]] == [50, 70, 86]
    got = r.calculate_pareto(df, "mode", "hours")
    assert got["vital_few"] == ["Bearing", "Belt", "Motor"] and round(got["categories"][0]["percentage"], 3) == 37.559 and round(got["vital_few_share"], 3) == 84.507
    assert "error" in r.calculate_pareto(spark.createDataFrame([("a", -1.0)], "mode string, hours double"), "mode", "hours")
    assert r.calculate_pareto(df, "mode", top_n=1)["vital_few_count"] == 1
    nulls = spark.createDataFrame([(None, 1.0), ("a", None)], "mode string, hours double")
    assert [c["category"] for c in r.calculate_pareto(nulls, "mode", "hours")["categories"]] == ["(unknown)"]


def test_weibull_recovers_the_shape():
    x = np.random.default_rng(1).weibull(2.4, 400) * 90
    got = r.calculate_weibull(x, n_bootstrap=100)
    assert abs(got["beta"] - 2.4) < 0.3 and abs(got["eta"] - 90) < 6 and got["hazard_pattern"] == "wear_out"
    b = got["beta"]
    assert (x**b * np.log(x)).sum() / (x**b).sum() - 1 / b - np.log(x).mean() == pytest.approx(0, abs=1e-9)
    assert r.calculate_weibull([1, 2, 3])["error"] and r.calculate_weibull([-1, 0])["error"] and r.calculate_weibull(["x"])["error"]
    assert r.calculate_weibull(x, confidence=2)["error"]
    assert r.calculate_weibull(np.random.default_rng(2).exponential(1, 300), n_bootstrap=100)["hazard_pattern"] == "constant"


def test_crow_amsaa():
    t, end = [10, 30, 60, 100, 150, 200], 250
    got = r.calculate_crow_amsaa(t, end)
    s = sum(math.log(end / x) for x in t)
    assert got["beta"] == pytest.approx(6 / s) and got["beta_unbiased"] == pytest.approx(5 / s) and got["trend"] == "no_evidence"
    assert got["beta_ci_lower"] < got["beta"] < got["beta_ci_upper"]
    assert r.calculate_crow_amsaa(t[:3], end)["error"] and r.calculate_crow_amsaa(t, -1)["error"]
    rng, alarms = np.random.default_rng(3), 0
    for _ in range(400):
        n = rng.poisson(30)
        alarms += r.calculate_crow_amsaa(rng.uniform(0, 1000, n), 1000)["trend"] != "no_evidence"
    assert 0.02 < alarms / 400 < 0.085


def test_forecast():
    got = r.forecast_failure_count(6, 12, 4)
    assert got["expected"] == 2.0 and got["lower"] <= 2 <= got["upper"] and got["prob_at_least_one"] == pytest.approx(1 - math.exp(-2))
    assert r.forecast_failure_count(0, 10, 10)["distribution"][0] == {"k": 0, "probability": 1.0}
    assert r.forecast_failure_count(1.5, 10, 10)["error"] and r.forecast_failure_count(1, 0, 10)["error"]


def test_pm_interval_beats_its_neighbours():
    got = r.calculate_optimal_pm_interval(2.5, 100, 1000, 8000)
    rate = lambda t: r.cost_rate(t, 2.5, 100, 1000, 8000)
    assert got["worthwhile"] and rate(got["interval"]) <= min(rate(got["interval"] * 0.99), rate(got["interval"] * 1.01))
    grid = np.linspace(0, got["interval"], 20001)
    length = np.trapezoid(np.exp(-((grid / 100) ** 2.5)), grid)
    f = 1 - math.exp(-((got["interval"] / 100) ** 2.5))
    assert got["cost_rate"] == pytest.approx((1000 * (1 - f) + 8000 * f) / length, rel=1e-6)
    assert not r.calculate_optimal_pm_interval(0.9, 100, 1000, 8000)["worthwhile"]
    assert not r.calculate_optimal_pm_interval(2.5, 100, 1000, 900)["worthwhile"]
    assert r.calculate_optimal_pm_interval(True, 1, 1, 1)["error"]


def test_curves(spark):
    got = r.calculate_weibull_curves(2.4, 90)
    rows = r.weibull_curves(spark, 2.4, 90).orderBy("t").collect()
    assert np.allclose([x["pdf"] for x in rows], got["pdf"]) and got["hazard_shape"] == "rising"
    curve = r.calculate_pm_cost_curve(2.4, 90, 8000, 50000, 20)
    assert np.allclose([x["cost_rate"] for x in r.pm_cost_curve(spark, 2.4, 90, 8000, 50000, 20).orderBy("t").collect()], curve["cost_rate"])
    assert r.calculate_weibull_curves(1, 1, points=5)["error"]


def test_weibull_bootstrap_fits_samples_together_as_one_by_one(monkeypatch):
    fit, calls = r.weibull_mle, []
    monkeypatch.setattr(r, "weibull_mle", lambda x: calls.append(len(x)) or fit(x))
    rng = np.random.default_rng(3)
    for x in (rng.weibull(0.7, 8), rng.weibull(2.4, 13) * 90, np.round(rng.exponential(3, 40)) + 1, np.array([5.0] * 7 + [9.0] * 2), rng.exponential(50, 40000)):
        draw, n = np.random.default_rng(42), 100 if len(x) < 1000 else 3
        fits = [f[0] for f in (fit(draw.choice(x, len(x))) for _ in range(n)) if f]
        low, high = np.percentile(fits, [2.5, 97.5]) - (np.mean(fits) - fit(x)[0])
        got = r.calculate_weibull(x, n_bootstrap=n)
        assert got["bootstrap_fits"] == len(fits) and (got["beta_ci_lower"], got["beta_ci_upper"]) == pytest.approx((low, high), rel=1e-10)
    assert len(calls) == 5  # one fit for each series; the samples go in blocks


def test_weibull_by_asset_does_not_depend_on_partitions_and_is_dealt_to_all_cores(spark):
    rng = np.random.default_rng(7)
    rows = [(f"A{a}", k, x) for a in range(40) for k, x in enumerate((rng.weibull(1.5, 6 + a) * 100).tolist())] + [("A0", 99, -1.0), ("none", 0, 0.0), (None, 0, 3.0), ("A1", 98, None)]
    want = {a: r.calculate_weibull([x for b, _, x in rows if b == a and x is not None], n_bootstrap=20) for a in {b for b, _, _ in rows}}
    for parts in (1, 5):
        mixed = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "machine string, k long, gap double").repartition(parts)
        got = r.weibull_by_asset(mixed, "machine", "gap", n_bootstrap=20, order_by="k")
        assert got.select(F.spark_partition_id()).distinct().count() > spark.sparkContext.defaultParallelism
        got = {row["machine"]: row.asDict() for row in got.collect()}
        assert got.keys() == want.keys()
        for a, row in got.items():
            assert all(row[c] == pytest.approx(want[a][c], rel=1e-10) if isinstance(row[c], float) else row[c] == want[a][c] for c in row if c != "machine"), a
    by_size = [sorted(map(str, r.weibull_by_asset(mixed.repartition(n), "machine", "gap", n_bootstrap=20).collect())) for n in (1, 7)]
    assert by_size[0] == by_size[1]


def test_points_of_a_fit_do_not_pay_for_its_interval(spark):
    rows = spark.createDataFrame([("A", k, float(k % 5 + 1)) for k in range(12)], "asset string, at long, interval double")
    fits = r.weibull_by_asset(rows, order_by="at")
    steps = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    assert steps(fits) == 1 and steps(fits.where("beta is not null").select("asset", "n_intervals", "beta", "eta", "mttf", "b10_life")) == 0
    assert fits.first()["bootstrap_fits"] == 500
