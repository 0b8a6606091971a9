import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.functions import ordered
from millwright.operators import profile, sequence


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    values = np.round(rng.exponential(10, 4000), 1)
    return values, rng.integers(0, 3, 4000)


def test_quantiles_equal_numpy(spark, rows):
    values, group = rows
    df = spark.createDataFrame([(float(v), int(g)) for v, g in zip(values, group)] + [(None, 0), (None, 7)], "x double, g int").repartition(7)
    fractions = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    found = {r["g"]: r for r in ordered.quantiles(df, "x", fractions, ["g"]).collect()}
    assert sorted(found) == [0, 1, 2]
    for g, r in found.items():
        assert r["n"] == (group == g).sum() and np.allclose(r["q"], np.quantile(values[group == g], fractions))
    assert np.allclose(ordered.quantiles(df, "x", fractions).first()["q"], np.quantile(values, fractions))
    assert ordered.quantiles(df.limit(0), "x", fractions).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_include_ties(spark, rows, descending):
    values, _ = rows
    distinct, n = np.unique(values, return_counts=True)
    df = spark.createDataFrame([(float(v), int(k)) for v, k in zip(distinct, n)], "x double, n long")
    found = {r["x"]: r["upto"] for r in ordered.running(df, "x", {"upto": "n"}, descending=descending).collect()}
    upto = np.cumsum(n[::-1])[::-1] if descending else np.cumsum(n)
    assert [found[v] for v in distinct] == upto.tolist()


def test_positions_rise_with_texts_and_times(spark):
    texts = ["", "a", "aa", "b", "é", "z", "zz", "漢"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(ordered.position(df, "t"), "t").orderBy("t").collect()]
    assert found == sorted(found)
    at = spark.sql("select explode(sequence(timestamp'2024-01-01', timestamp'2024-03-01', interval 1 day)) t")
    found = [r[0] for r in at.select(ordered.position(at, "t")).orderBy("t").collect()]
    assert found == sorted(set(found))


def test_kendall_score_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (700, 4), (2500, 40), (3000, 100_000)):
        x, y, w = rng.integers(0, top, n).astype(float), rng.integers(0, top, n).astype(float), rng.integers(1, 4, n).astype(float)
        want = sum(float(w[i] * (w[i + 1 :] * np.sign(x[i] - x[i + 1 :]) * np.sign(y[i] - y[i + 1 :])).sum()) for i in range(n))
        assert profile.kendall_score(x, y, w) == want


def test_next_event_of_a_long_series_takes_one_pass(spark):
    readings = spark.range(60_000).select(F.lit("a").alias("asset"), F.col("id").alias("t"))
    events = spark.range(0, 60_000, 1000).select(F.lit("a").alias("asset"), F.col("id").alias("failed_at"))
    out = sequence.next_event(readings, events, "asset", "t", "failed_at")
    wrong = out.where(~F.col("next_event").eqNullSafe(F.when(F.col("t") < 59_000, (F.floor(F.col("t") / 1000) + 1) * 1000)))
    assert out.count() == 60_000 and wrong.count() == 0


def test_plant_tools_and_adapters(spark, tmp_path):
    import pandas as pd

    from millwright.sources import files, tools

    for name, shift in (("a", 0), ("b", 30)):
        (tmp_path / f"{name}.csv").write_text("m,x\n" + "".join(f"M{i % 2},{i % 10 + shift}\n" for i in range(100)))
    found = tools.create_plant_tools(str(tmp_path))
    assert found["check_asset_drift"]("a.csv", "b.csv", asset="m")["assets_drifted"] == ["M0", "M1"] and "error" in found["check_asset_drift"]("no.csv", "b.csv", asset="m")
    assert found["calculate_oee"](planned_time_min=10, run_time_min=5, ideal_cycle_time_min=1, total_count=4, good_count=2)["oee"] == pytest.approx(0.2) and "error" in found["calculate_oee"](planned_time_min=0)
    assert found["calculate_maintenance_savings"](true_positives=1, false_positives=0, false_negatives=0)["cost_savings"] == 40500
    assert files.from_records(spark, pd.Series({"a": 1.5, "b": "x"})).first().asDict() == {"a": 1.5, "b": "x"}
    assert [tuple(r) for r in files.from_records(spark, np.array([[1.0, 2.0]]), ["a", "b"]).collect()] == [(1.0, 2.0)]
