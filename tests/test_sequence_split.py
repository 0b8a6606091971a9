import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.operators import sequence, split


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(42)
    return spark.createDataFrame([(f"M{m}", h, float(rng.normal(60, 2)), float(rng.normal(1, 0.1))) for m in range(3) for h in range(200)], "machine string, hour long, temp double, vib double").cache()


def test_labels_by_hand(spark):
    readings = spark.createDataFrame([("A", h, 1.0) for h in range(10)] + [("B", 0, 1.0)], "m string, hour long, x double")
    events = spark.createDataFrame([("A", 5), ("C", 1), (None, 2)], "m string, failed_at long")
    out, report = sequence.build_failure_labels(readings, events, "m", "hour", 3)
    assert sorted(r["hour"] for r in out.where("failure = 1").collect()) == [2, 3, 4]
    assert report["positives"] == 3 and report["assets_without_events"] == ["B"] and report["events_without_readings"] == ["C"] and report["censored_rows"] == 6
    late, _ = sequence.build_failure_labels(readings, events, "m", "hour", 3, lead_time=1)
    assert sorted(r["hour"] for r in late.where("failure = 1").collect()) == [2, 3]


def test_labels_over_timestamps_and_refusals(spark):
    readings = spark.sql("select 'A' m, timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,cast(id as int)) ts from range(10)")
    events = spark.sql("select 'A' m, timestamp_ntz'2024-01-01 05:00:00' failed_at")
    out, _ = sequence.build_failure_labels(readings, events, "m", "ts", "3h")
    assert out.where("failure = 1").count() == 3
    for bad in ({"horizon": 0}, {"horizon": "x"}, {"horizon": "3h", "lead_time": "4h"}):
        with pytest.raises(ValueError):
            sequence.build_failure_labels(readings, events, "m", "ts", **bad)
    with pytest.raises(ValueError):
        sequence.build_failure_labels(readings, spark.sql("select 'A' m, 5 failed_at"), "m", "ts", "3h")


def features(log, **k):
    return sequence.add_window_features(log, "machine", "hour", windows=(5, 10), baseline_n=20, **k)


def test_window_features(log):
    out, report = features(log)
    assert report["rows_out"] == 3 * 180 and report["n_features_added"] == 14 and not report["assets_skipped"]
    pdf = log.where("machine = 'M1'").orderBy("hour").toPandas()
    got = out.where("machine = 'M1'").orderBy("hour").toPandas()
    assert np.allclose(got["temp_w5_std"], pdf["temp"].rolling(5).std()[20:]) and np.allclose(got["temp_w10_slope"], pdf["temp"].diff().rolling(10).mean()[20:]) and np.allclose(got["temp_vs_baseline"], (pdf["temp"] - pdf["temp"][:20].mean())[20:])


def test_features_do_not_see_the_future_or_other_assets(log):
    later = log.withColumn("temp", F.when(F.col("hour") >= 150, 1e6).otherwise(F.col("temp"))).withColumn("vib", F.when(F.col("machine") == "M2", 1e6).otherwise(F.col("vib")))
    key = ["machine", "hour"]
    a = features(log)[0].where("machine = 'M0' and hour < 150").orderBy(*key).toPandas()
    b = features(later.repartition(5))[0].where("machine = 'M0' and hour < 150").orderBy(*key).toPandas()
    assert np.allclose(a.drop(columns=key), b.drop(columns=key))


def test_feature_refusals(log):
    for bad in ({"stats": ("median",)}, {"value_cols": []}, {"value_cols": ["machine"]}):
        with pytest.raises(ValueError):
            features(log, **bad)
    with pytest.raises(ValueError):
        sequence.add_window_features(log, "machine", "hour", windows=(1,))
    with pytest.raises(ValueError):
        sequence.window_features(log.withColumn("temp_w5_mean", F.lit(1.0)), "machine", "hour", ["temp"], (5,), ("mean",), 20)
    _, report = sequence.add_window_features(log.where("machine = 'M0' or hour < 10"), "machine", "hour", windows=(5,), baseline_n=20)
    assert set(report["assets_skipped"]) == {"M1", "M2"} and report["rows_dropped_warning"] is None


def test_random_split_is_exact_and_stable(log):
    df = log.withColumn("y", (F.col("hour") % 5 == 0).cast("int"))
    parts = split.with_parts(df, "y", test_size=0.25)
    counts = {(r["y"], r["part"]): r["count"] for r in parts.groupBy("y", "part").count().collect()}
    assert counts == {(0, "train"): 360, (0, "test"): 120, (1, "train"): 90, (1, "test"): 30}
    key = lambda p: sorted((r["machine"], r["hour"]) for r in p.where("part = 'test'").collect())
    assert key(parts) == key(split.with_parts(df.repartition(9), "y", test_size=0.25))
    assert key(parts) != key(split.with_parts(df, "y", test_size=0.25, random_state=1))
    assert split.with_parts(df, "y", test_size=7).where("part = 'test'").count() == 7


def test_groups_and_times(log):
    df = log.withColumn("y", F.col("hour") % 2)
    groups = split.with_parts(df, "y", test_size=0.3, group_col="machine").select("machine", "part").distinct().collect()
    assert len(groups) == 3 and {r["part"] for r in groups} == {"train", "test"}
    times = split.with_parts(df, "y", test_size=0.21, time_col="hour")
    edge = times.groupBy("part").agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).collect()
    edge = {r["part"]: r for r in edge}
    assert edge["train"]["hi"] < edge["test"]["lo"] and times.where("part = 'test'").count() >= 126
    with pytest.raises(ValueError):
        split.with_parts(df.withColumn("hour", F.lit(1)), "y", time_col="hour")
    with pytest.raises(ValueError):
        split.with_parts(df, "y", group_col="machine", time_col="hour")
    with pytest.raises(ValueError):
        split.with_parts(df.where("machine = 'M0'"), "y", group_col="machine")


def test_three_parts(log):
    df = log.withColumn("y", F.col("hour") % 2)
    x_train, x_val, x_test, *_ = split.split_data_three_way(df, "y")
    assert (x_train.count(), x_val.count(), x_test.count()) == (360, 120, 120) and "y" not in x_train.columns
    with pytest.raises(ValueError):
        split.three_parts(df, "y", val_size=0.6, test_size=0.5)
    tail = split.tail_split(df.where("machine = 'M0'"), "y", "hour", 0.1)
    assert tail.where("part = 'test'").agg(F.min("hour")).first()[0] == 180
