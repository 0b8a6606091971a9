import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millwright.ml import prepare
from millwright.ml.analysis import auto_analyze, run_seed_sweep
from millwright.ml.engine import Engine
from millwright.ml.forest import IsolationForest, Tree, tree_shap
from millwright.operators import spc
from millwright.sources import files, tools
from millwright.streaming import charts


@pytest.fixture(scope="module")
def plant(spark):
    rng = np.random.default_rng(0)
    n = 500
    d = pd.DataFrame({"temp": rng.normal(50, 4, n), "vib": rng.normal(1, 0.2, n), "line": rng.choice(list("ABC"), n), "unit_id": range(n)})
    d["copy"] = d["temp"] * 2 + rng.normal(0, 0.01, n)
    d["failure"] = ((d["temp"] - 50) / 4 + (d["line"] == "A") * 1.5 + rng.normal(0, 0.4, n) > 1.6).astype(int)
    d.loc[::17, "line"] = "N/A"
    return spark.createDataFrame(d).cache()


def test_preparation(spark, plant):
    plan = prepare.fit(plant, "failure", F.col("failure"))
    assert plan.dropped["unit_id"] == "identifier" and "collinear" in plan.dropped.values() and plan.levels["line"] == ["A", "B", "C"]
    out = prepare.transform(plant, prepare.Plan.from_json(plan.to_json()))
    stats = out.agg(F.avg("vib"), F.stddev_pop("vib")).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1)
    unseen = prepare.transform(spark.createDataFrame([("Z", 1e9)], "line string, temp double"), plan).first()
    assert unseen["line"] == -1.0 and unseen["vib"] == pytest.approx((plan.fill["vib"] - plan.shift["vib"][0]) / plan.shift["vib"][1])


def test_engine_end_to_end(spark, plant, tmp_path):
    path = str(tmp_path / "engine")
    got = auto_analyze(plant, "failure", time_budget=1, save_to=path)
    assert got["ok"], got["error"]
    assert got["metrics"]["roc_auc"] > 0.85 and got["split"]["test"] == 100 and got["top_features"]
    engine = Engine.load(path)
    again = engine.evaluate(plant)
    assert again["confusion_matrix"] and engine.optimal_threshold == got["threshold"]["optimal"]
    assert engine.detect_drift(plant.withColumn("temp", F.col("temp") + 8))["drift_detected"]
    assert "temp" in engine.check_batch(plant.withColumn("temp", F.col("temp") + 80))["out_of_bounds"] or "copy" in engine.plan.features
    engine.optimize_threshold(plant)
    assert engine.evaluate(plant)["threshold_leakage_warning"]
    assert engine.calculate_maintenance_cost(plant)["breakdowns_avoided"] > 0
    with pytest.raises(FileNotFoundError):
        Engine.load(str(tmp_path / "none"))
    data = next((tmp_path / "engine" / "model").rglob("part-*"))
    data.write_bytes(data.read_bytes() + b"x")
    with pytest.raises(RuntimeError):
        Engine.load(path)


def test_anomaly_fallback_and_refusals(spark, plant):
    rare = plant.withColumn("failure", (F.col("unit_id") < 3).cast("int")).withColumn("temp", F.when(F.col("unit_id") < 3, 500.0).otherwise(F.col("temp"))).drop("copy")
    engine = Engine(time_budget=1).fit(rare, "failure")
    assert engine.is_anomaly_model and engine.evaluate(rare)["roc_auc"] > 0.9 and engine.optimize_threshold(rare) == 0.5
    with pytest.raises(ValueError):
        Engine().fit(plant.limit(5), "failure")
    assert not auto_analyze(plant, "nope")["ok"] and "error" in run_seed_sweep(plant, "failure", seeds=(1, 1))


def test_tree_attributions_add_up():
    tree = Tree([0, 1, -1, -1, -1], [0.5, 0.5, 0, 0, 0], [1, 2, -1, -1, -1], [4, 3, -1, -1, -1], [0, 0, 1.0, 5.0, 2.0], [10, 6, 2, 4, 4])
    mean = (2 * 1 + 4 * 5 + 4 * 2) / 10
    for x, value in (([0, 0], 1.0), ([0, 1], 5.0), ([1, 0], 2.0)):
        assert tree_shap(tree, np.array(x, float)).sum() == pytest.approx(value - mean)
    x = np.random.default_rng(0).normal(0, 1, (500, 3))
    d = IsolationForest.fit(x, 1).decision(np.array([[0, 0, 0.0], [9, 9, 9]]))
    assert d[0] > 0 > d[1]


def test_files_and_tools(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,z\n1,NA,a\n2,3.5,null\n")
    df, error = files.resolve_csv("a.csv", str(tmp_path))
    assert error is None and dict(df.dtypes) == {"x": "bigint", "y": "double", "z": "string"} and df.where("z is null").count() == 1
    assert files.resolve_csv("../etc/passwd", str(tmp_path))[1] and files.resolve_csv(".", str(tmp_path))[1]
    found = tools.create_tools(str(tmp_path))
    assert len(found) == 7 and "error" in found["pareto"]("nope.csv", category="z") and found["pareto"]("a.csv", category="x")["total"] == 2.0
    log = str(tmp_path / "log" / "audit.log")
    assert files.enable_audit_log(log) == files.enable_audit_log(log) == log
    assert files.from_records(spark, {"a": 1, "b": {"c": 2}}).columns == ["a", "b.c"]


def test_live_charts_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"M{i % 2}", i, float(rng.normal(10, 1))) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], "m string, t long, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("m string, t long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = charts.live_ewma(stream, "m", "t", "x", 10.0, 1.0).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("live").orderBy("m", "idx").collect()
    want = []
    for m in ("M0", "M1"):
        z = 10.0
        for r in [r for r in rows if r[0] == m]:
            z = 0.2 * r[2] + 0.8 * z
            want.append(z)
    assert np.allclose([r["stat"] for r in got], want)
    cusum = charts.live_cusum(stream, "m", "t", "x", 10.0, 1.0)
    assert cusum.isStreaming and cusum.columns[2] == "cusum_high"


def test_live_cusum_judges_readings_at_the_limit_as_the_batch_chart_and_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from millwright.plans import catalogue, figures  # noqa: F401  figures registers more queries

    rng, rows = np.random.default_rng(5), []
    while len({r[1] for r in rows}) < 150:  # the upper sum of each series ends at 200.00, the limit, exactly
        cents, high = rng.integers(0, 16000, rng.integers(6, 15)), 0
        for c in cents:
            high = max(0, high + int(c) - 7000)
        if 11000 <= high <= 20000:
            user = len({r[1] for r in rows})
            rows += [(len(rows) + k, user, np.datetime64("2024-01-01T00:00:00") + k, float(c) / 100) for k, c in enumerate([*cents, 27000 - high])]
    events = spark.createDataFrame([(e, u, t.item(), v) for e, u, t, v in rows], "event_id long, user_id long, ts timestamp_ntz, value double")
    pd_rows = events.toPandas()
    pd_rows.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    key = lambda r: (r[0], r[1])
    got = sorted((tuple(r) for r in catalogue.queries()["live_cusum"](spark, str(tmp_path)).collect()), key=key)
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    assert got == sorted(con.execute(catalogue.oracle_sql()["live_cusum"]).fetchall(), key=key)
    batch = sorted((tuple(r) for r in spc.cusum(events, "value", "ts", "user_id", target=50.0, sigma=40.0).selectExpr("user_id", "ts", "cusum_high", "cusum_low", "violation_high or violation_low").collect()), key=key)
    for k in range(3):
        events.where(f"second(ts) % 15 div 5 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live = charts.live_cusum(stream, "user_id", "ts", "value", 50.0, 40.0)
    live.writeStream.format("memory").queryName("live_cusum").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((tuple(r) for r in spark.table("live_cusum").collect()), key=key) == batch
