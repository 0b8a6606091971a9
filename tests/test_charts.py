import numpy as np
import pytest

from millwright.operators import quality, spc


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "t int, x double")


def test_ewma_values_and_limits(spark):
    got = spc.calculate_ewma_chart(frame(spark, [10.0] * 5 + [12.0]), "x", "t", target=10, sigma=1)
    assert got["ewma"][-1] == pytest.approx(10.4) and got["ucl"][0] == pytest.approx(10.6) and got["lcl"][0] == pytest.approx(9.4)


@pytest.mark.parametrize("weight", [0.01, 0.2, 0.9, 1.0])
def test_ewma_is_the_recursion_however_long(spark, weight):
    x = np.random.default_rng(0).normal(5, 1, 9000)
    z, want = 5.0, []
    for v in x:
        z = weight * v + (1 - weight) * z
        want.append(z)
    rows = spc.ewma(frame(spark, x.tolist()), "x", "t", weight=weight, target=5, sigma=1).orderBy("idx").collect()
    assert np.allclose([r["stat"] for r in rows], want, atol=1e-9)


def test_cusum(spark):
    got = spc.calculate_cusum_chart(frame(spark, [10.0, 10.0, 10.0, 13.0, 13.0, 13.0]), "x", "t", target=10, sigma=1)
    assert got["cusum_high"] == pytest.approx([0, 0, 0, 2.5, 5, 7.5]) and got["first_violation"] == 5 and got["direction"] == "increasing"
    x = np.random.default_rng(1).normal(0, 1, 500)
    high = low = 0.0
    want = []
    for v in x:
        high, low = max(0, high + v - 0.5), max(0, low - v - 0.5)
        want.append((high, low))
    rows = spc.cusum(frame(spark, x.tolist()), "x", "t", target=0, sigma=1).orderBy("idx").collect()
    assert np.allclose([(r["cusum_high"], r["cusum_low"]) for r in rows], want)


def rules(spark, x, k):
    return spc.calculate_control_rules(frame(spark, x), "x", "t", target=0, sigma=1, rules=(k,))["violations"][str(k)]


def test_each_rule_fires_where_it_should(spark):
    assert rules(spark, [0.0, 3.5, 0.0], 1) == [1]
    assert rules(spark, [0.5] * 10, 2) == [8, 9] and rules(spark, [0.5] * 8 + [0.0, 0.5], 2) == []
    assert rules(spark, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.5], 3) == [5]
    assert rules(spark, [(-1.0) ** i * 0.5 for i in range(15)], 4) == [13, 14]
    assert rules(spark, [2.5, 0.0, 2.5, -2.5], 5) == [2]
    assert rules(spark, [1.5, 1.5, 0.0, 1.5, 1.5], 6) == [4]
    assert rules(spark, [0.1] * 16, 7) == [14, 15]
    assert rules(spark, [1.5, -1.5] * 4, 8) == [7]


def test_rules_refuse_and_skip(spark):
    short = spc.calculate_control_rules(frame(spark, [0.0, 1.0, 0.0]), "x", "t", rules=(1, 2))
    assert set(short["rules_skipped"]) == {"2"}
    assert "error" in spc.calculate_control_rules(frame(spark, [1.0] * 9), "x", "t")
    assert "error" in spc.calculate_control_rules(frame(spark, [1.0, 2.0]), "x", "t", rules=(9,))
    assert "error" in spc.calculate_ewma_chart(frame(spark, []), "x", "t")
    assert "error" in spc.calculate_ewma_chart(frame(spark, [1.0]), "x", "t", lambda_weight=0)
    flat = spc.calculate_ewma_chart(frame(spark, [1.0] * 5), "x", "t")
    assert flat["violations"] == [] and flat["note"]


def test_order_of_rows_does_not_matter(spark):
    x = np.random.default_rng(2).normal(0, 1, 300).tolist()
    df = frame(spark, x)
    one = spc.calculate_control_rules(df, "x", "t")
    assert one == spc.calculate_control_rules(df.repartition(7).orderBy("x"), "x", "t")


def test_false_alarm_rate_of_the_first_rule(spark):
    rng = np.random.default_rng(4)
    rows = [(s, i, float(v)) for s in range(400) for i, v in enumerate(rng.normal(0, 1, 100))]
    df = spark.createDataFrame(rows, "s int, t int, x double")
    alarmed = spc.control_rules(df, "x", "t", "s", target=0, sigma=1, rules=(1,)).where("rule_1").select("s").distinct().count()
    assert 0.16 < alarmed / 400 < 0.32


def test_capability(spark):
    x = np.random.default_rng(5).normal(50, 1, 200)
    got = quality.calculate_capability(frame(spark, x.tolist()), "x", "t", usl=56, lsl=44)
    within = np.abs(np.diff(x)).mean() / 1.128
    assert got["cp"] == pytest.approx(12 / (6 * within)) and got["cpk"] == pytest.approx(min(56 - x.mean(), x.mean() - 44) / (3 * within)) and got["stable"] and got["verdict"] == "capable"
    drift = quality.calculate_capability(frame(spark, (x + np.arange(200) / 40).tolist()), "x", "t", usl=60, lsl=44)
    assert not drift["stable"] and not drift["capability_is_meaningful"] and any(c["fired"] for c in drift["stability_criteria"])
    assert "error" in quality.calculate_capability(frame(spark, [1.0, 2.0]), "x", "t") and "error" in quality.calculate_capability(frame(spark, [1.0]), "x", "t", usl=2)


def test_gauge_study(spark):
    rng = np.random.default_rng(6)
    part, rows = rng.normal(10, 2, 5), []
    for p in range(5):
        for o in range(3):
            for _ in range(3):
                rows.append((f"p{p}", f"o{o}", float(part[p] + 0.1 * o + rng.normal(0, 0.1))))
    df = spark.createDataFrame(rows, "part string, operator string, y double")
    got = quality.calculate_gauge_rr(df, "part", "operator", "y")
    assert got["verdict"] == "acceptable" and got["ndc"] >= 5 and got["n_total"] == 45
    assert sum(got["percent_contribution"][k] for k in ("gauge_rr", "part_variation")) == pytest.approx(100)
    y = np.array([r[2] for r in rows]).reshape(5, 3, 3)
    s = quality.gauge_sums(df, "part", "operator", "y").first()
    assert s["ss_total"] == pytest.approx(((y - y.mean()) ** 2).sum()) and s["ss_parts"] == pytest.approx(9 * ((y.mean((1, 2)) - y.mean()) ** 2).sum())
    assert "Unbalanced" in quality.calculate_gauge_rr(df.where("not (part = 'p0' and operator = 'o0')"), "part", "operator", "y")["error"]
    assert "error" in quality.calculate_gauge_rr(df.where("part = 'p0'"), "part", "operator", "y")
