"""More named queries: preparation, audits, criteria, splits, forecasts and live charts, each with the SQL it equals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions.columns import col, finite
from millwright.functions.constants import PM_SAVING, SILENT_NULLS
from millwright.operators import metrics, profile, quality, reliability, sequence, split
from millwright.plans.catalogue import BASELINE, CUT, DIRTY, ORDER, SCORED, _dirty, _scored, query, r6, table

# ------------------------------------------------------------------ preparation


@query("non_finite_scrub", "SELECT event_id, CASE WHEN event_id % 13 <> 0 AND event_id % 17 <> 0 THEN value END AS value FROM events")
def non_finite_scrub(spark, sf_dir):
    i = F.col("event_id")
    value = F.when(i % 13 == 0, F.lit(float("inf"))).when(i % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", finite(value).alias("value"))


@query("silent_null_rewrite", f"SELECT doc_id, CASE WHEN lower(trim(tag)) NOT IN ({', '.join(repr(t) for t in SILENT_NULLS)}) THEN tag END AS tag FROM {DIRTY} d")
def silent_null_rewrite(spark, sf_dir):
    from millwright.ml import prepare

    dirty = _dirty(spark, sf_dir)
    return dirty.select("doc_id", prepare._text(dirty, "tag", True).alias("tag"))


def _wide(spark, sf_dir) -> DataFrame:
    """Events with columns that preparation has to leave out."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("e"), "event_id").alias("label"), F.array("value").alias("pair"), F.lit(None).cast("double").alias("nothing"), F.lit(1.5).alias("flat"),
        "event_type", "value", (v * 2 + F.col("event_id") % 3).alias("twice"), (F.col("user_id") % 7).cast("double").alias("other"),
    )


_FATES = """WITH s AS (SELECT count(*) AS n, count(DISTINCT event_id) AS ids, count(DISTINCT 'e' || event_id) AS labels, count(DISTINCT event_type) AS types, abs(corr(value, value * 2 + event_id % 3)) AS r, {extra} FROM events)
SELECT unnest(['event_id', 'label', 'pair', 'nothing', 'flat', 'event_type', 'value', 'twice', 'other']) AS name, unnest([CASE WHEN ids = n AND n > 30 THEN 'identifier' ELSE 'kept' END, CASE WHEN labels > 0.5 * n AND n > 30 OR labels > 1000 THEN 'high cardinality' ELSE 'kept' END, 'nested', 'all null', 'constant', 'kept', {value}, {twice}, 'kept']) AS fate FROM s"""


def _fates(spark: SparkSession, plan) -> DataFrame:
    return spark.createDataFrame([(c, plan.dropped.get(c, "kept")) for c in plan.raw], "name string, fate string")


@query("column_fates", _FATES.format(extra="0 AS a", value="'kept'", twice="CASE WHEN r > 0.9 THEN 'collinear' ELSE 'kept' END"))
def column_fates(spark, sf_dir):
    from millwright.ml import prepare

    return _fates(spark, prepare.fit(_wide(spark, sf_dir)))


@query("target_pruning", _FATES.format(extra="abs(corr(value, (value * 2 + event_id % 3) * 1.0 + event_id % 3)) AS v, abs(corr(value * 2 + event_id % 3, (value * 2 + event_id % 3) * 1.0 + event_id % 3)) AS w", value="CASE WHEN r > 0.9 AND v < w THEN 'collinear' ELSE 'kept' END", twice="CASE WHEN r > 0.9 AND v >= w THEN 'collinear' ELSE 'kept' END"))
def target_pruning(spark, sf_dir):
    """Of two collinear columns the one that says less about the target goes."""
    from millwright.ml import prepare

    rows = _wide(spark, sf_dir)
    return _fates(spark, prepare.fit(rows, labels=F.col("twice") + F.col("event_id") % 3))


@query("target_correlations", "SELECT unnest(['value', 'twice', 'other']) AS feature, unnest([round(corr(value, (value > 60)::int), 6), round(corr(value * 2 + event_id % 3, (value > 60)::int), 6), round(corr(user_id % 7, (value > 60)::int), 6)]) AS correlation FROM events")
def target_correlations(spark, sf_dir):
    rows = _wide(spark, sf_dir).withColumn("y", (F.col("value") > 60).cast("int"))
    found = profile.pearson(rows, ["value", "twice", "other", "y"]).where("b = 'y'")
    return r6(found.select(F.col("a").alias("feature"), "correlation"), "correlation")


@query("clip_to_bounds", f"WITH b AS (SELECT min(value) AS low, max(value) AS high FROM events WHERE ts < {CUT}) SELECT event_id, least(greatest(value * 1.5 - 20, low), high) AS value FROM events, b")
def clip_to_bounds(spark, sf_dir):
    from millwright.ml import prepare

    events = table(spark, sf_dir, "events")
    plan = prepare.fit(events.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).select("value"), scale="none")
    return prepare.transform(events.withColumn("value", F.col("value") * 1.5 - 20), plan, keep=["event_id"])


@query("datetime_parts", "SELECT event_id, year(ts)::double AS ts_year, month(ts)::double AS ts_month, day(ts)::double AS ts_day, hour(ts)::double AS ts_hour, (isodow(ts) - 1)::double AS ts_dayofweek FROM events")
def datetime_parts(spark, sf_dir):
    from millwright.ml import prepare

    events = table(spark, sf_dir, "events")
    plan = prepare.fit(events.select("ts", "value"), scale="none")
    return events.select("event_id", *(v.alias(k) for k, v in prepare._base(events, plan).items() if k.startswith("ts_")))


@query(
    "imputed_features",
    """WITH d AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v, CASE WHEN event_id % 11 <> 0 THEN event_type END AS t FROM events), m AS (SELECT quantile_cont(v, 0.5) AS v FROM d), k AS (SELECT t, count(*) AS n FROM d WHERE t IS NOT NULL GROUP BY 1), u AS (SELECT arg_max(t, n) AS t FROM k), l AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS code FROM k)
SELECT event_id, round(coalesce(d.v, m.v), 6) AS value, code::double AS event_type FROM d, m, u, l WHERE l.t = coalesce(d.t, u.t)""",
)
def imputed_features(spark, sf_dir):
    from millwright.ml import prepare

    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(i % 7 != 0, F.col("value")).alias("value"), F.when(i % 11 != 0, F.col("event_type")).alias("event_type"))
    return r6(prepare.transform(rows, prepare.fit(rows.drop("event_id"), scale="none"), keep=["event_id"]), "value")


@query("minmax_features", "WITH b AS (SELECT min(value) AS low, max(value) AS high FROM events) SELECT event_id, round((value - low) / (high - low), 6) AS value FROM events, b")
def minmax_features(spark, sf_dir):
    from millwright.ml import prepare

    events = table(spark, sf_dir, "events").select("event_id", "value")
    return r6(prepare.transform(events, prepare.fit(events.drop("event_id"), scale="minmax"), keep=["event_id"]), "value")


def _narrow(c: str) -> str:
    return f"CASE WHEN min({c}) >= -128 AND max({c}) < 128 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) < 32768 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) < 2147483648 THEN 'int' ELSE 'bigint' END"


@query("downcast_types", f"SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_extendedprice', 'l_returnflag']) AS name, unnest([{', '.join(map(_narrow, ('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber')))}, CASE WHEN max(abs(l_extendedprice)) < 3.4e38 THEN 'float' ELSE 'double' END, 'string']) AS type FROM lineitem")
def downcast_types(spark, sf_dir):
    from millwright.ml import prepare

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    return spark.createDataFrame(prepare.downcast(rows).dtypes, "name string, type string")


# ------------------------------------------------------------------ labels of models


@query("label_codes", "WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)) SELECT event_id, code::double AS code FROM events JOIN k USING (event_type)")
def label_codes(spark, sf_dir):
    from millwright.ml.engine import Engine

    events, engine = table(spark, sf_dir, "events"), Engine(task="classification")
    engine.learn_classes(events, "event_type")
    return events.select("event_id", engine._label(events).alias("code"))


@query("class_balance", "WITH k AS (SELECT quality::varchar AS class, count(*) AS n FROM labels GROUP BY 1) SELECT class, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight, row_number() OVER (ORDER BY n, class DESC) = 1 AS is_positive FROM k")
def class_balance(spark, sf_dir):
    from millwright.ml.engine import Engine

    engine = Engine(task="classification")
    counts = engine.learn_classes(table(spark, sf_dir, "labels"), "quality")
    weights = engine.balanced_weights(counts)
    return r6(spark.createDataFrame([(c, n, weights[c], engine.classes_[engine.positive] == c) for c, n in counts.items()], "class string, n long, weight double, is_positive boolean"), "weight")


@query("viable_classes", "SELECT user_id::varchar AS class, count(*) AS n, count(*) >= 5 AS viable FROM events WHERE event_type = 'error' GROUP BY 1")
def viable_classes(spark, sf_dir):
    from millwright.ml.engine import Engine

    errors, engine = table(spark, sf_dir, "events").where("event_type = 'error'"), Engine(task="classification")
    counts = engine.learn_classes(errors, "user_id")
    kept = set(engine.viable(counts))
    return spark.createDataFrame([(c, n, c in kept) for c, n in counts.items()], "class string, n long, viable boolean")


_COUNTS = f"WITH c AS (SELECT count(*) FILTER (y = 1 AND p >= 0.3) AS tp, count(*) FILTER (y = 0 AND p >= 0.3) AS fp, count(*) FILTER (y = 1 AND p < 0.3) AS fn, count(*) FILTER (y = 0 AND p < 0.3) AS tn FROM {SCORED} s)"


def _counts(spark, sf_dir) -> DataFrame:
    return metrics.binary_counts(_scored(spark, sf_dir), F.col("y") == 1, F.col("p") >= 0.3)


@query("cost_of_quality", _COUNTS + ", k AS (SELECT (tp + fn - floor((tp + fn) * 0.25)) * 500.0 + floor((fp + tn) * 0.1) * 150.0 + floor((tp + fn) * 0.25) * 20.0 AS b, fn * 500.0 + fp * 150.0 + tp * 20.0 AS m FROM c) SELECT b::double AS baseline_cost, m::double AS model_cost, (b - m)::double AS cost_savings, round(((b - m) / b * 100)::double, 6) AS savings_percentage FROM k")
def cost_of_quality(spark, sf_dir):
    out = metrics.quality_cost_columns(*map(F.col, ("tp", "fp", "fn", "tn")), base_det_rate=0.25, base_fp_rate=0.1)
    return r6(_counts(spark, sf_dir).select(*(v.alias(k) for k, v in out.items())), "savings_percentage")


@query("maintenance_cost", _COUNTS + ", k AS (SELECT (tp + fn) * 50000.0 AS b, fn * 50000.0 + tp * 9500.0 + fp * 1500.0 AS a, tp, fn FROM c) SELECT b::double AS run_to_failure_cost, a::double AS predictive_cost, (b - a)::double AS cost_savings, round(((b - a) * 100 / b)::double, 6) AS savings_percentage, round(tp::double / (tp + fn), 6) AS breakdown_avoidance_rate FROM k")
def maintenance_cost(spark, sf_dir):
    out = reliability.savings_columns(F.col("tp"), F.col("fp"), F.col("fn"))
    return r6(_counts(spark, sf_dir).select(*(v.alias(k) for k, v in out.items())), "savings_percentage", "breakdown_avoidance_rate")


# ------------------------------------------------------------------ audits

#: Events with placeholders, sentinels, impossible times and repeated rows.
_SICK = "(SELECT user_id, CASE WHEN event_id % 17 = 0 THEN 'N/A' WHEN event_id % 19 = 0 THEN '12' ELSE event_type END AS kind, CASE WHEN event_id % 23 = 0 THEN -999.0 WHEN event_id % 31 <> 0 THEN round(value) END AS value, CASE WHEN event_id % 29 = 0 THEN TIMESTAMP '1950-01-01' ELSE date_trunc('day', ts) END AS ts FROM events)"


def _sick(spark, sf_dir) -> DataFrame:
    i = F.col("event_id")
    kind = F.when(i % 17 == 0, "N/A").when(i % 19 == 0, "12").otherwise(F.col("event_type"))
    value = F.when(i % 23 == 0, -999.0).when(i % 31 != 0, F.round("value"))
    ts = F.when(i % 29 == 0, F.lit("1950-01-01").cast("timestamp_ntz")).otherwise(F.date_trunc("day", F.col("ts")).cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("user_id", kind.alias("kind"), value.alias("value"), ts.alias("ts"))


def _audit(spark, sf_dir) -> dict:
    import datetime

    return profile.audit_data_quality(_sick(spark, sf_dir), "kind", datetime.datetime(2024, 1, 20))


_OUTLIERS = "SELECT '{c}' AS c, count(*) FILTER (CASE WHEN mad > 0 THEN abs(0.6745 * (x - med) / mad) ELSE abs((x - med) / (1.253314 * mean_ad)) END > 3.5) AS n FROM (SELECT {c}::double AS x FROM d WHERE {c} IS NOT NULL) v, (SELECT med, quantile_cont(abs({c} - med), 0.5) AS mad, avg(abs({c} - med)) AS mean_ad FROM d, (SELECT quantile_cont({c}, 0.5) AS med FROM d) GROUP BY med) m"
_DIMENSIONS = f"""WITH d AS (SELECT * FROM {_SICK}), n AS (SELECT count(*) AS n, count(*) FILTER (value IS NULL) AS nulls, count(*) FILTER (kind = 'N/A') + count(*) FILTER (value = -999) AS silent, count(*) FILTER (kind = '12') AS numbers, count(value) + count(user_id) AS numeric, count(ts) AS timed, count(*) FILTER (ts > TIMESTAMP '2024-01-20' OR ts < TIMESTAMP '1970-01-01') AS late FROM d),
o AS (SELECT sum(n) AS outliers FROM ({_OUTLIERS.format(c='user_id')} UNION ALL {_OUTLIERS.format(c='value')})), u AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM d)),
s AS (SELECT unnest(['completeness', 'consistency', 'validity', 'uniqueness', 'timeliness']) AS dimension, unnest([0.30, 0.25, 0.20, 0.15, 0.10]) AS weight, unnest([100 * (1 - (nulls + silent) / (n * 4)), CASE WHEN numbers > 0 AND numbers < n THEN 75.0 ELSE 100.0 END, 100 * (1 - outliers / numeric), 100 * (1 - (n - k) / n), 100 * (1 - late / timed)]) AS score FROM n, o, u)
"""


@query("quality_dimensions", _DIMENSIONS + "SELECT dimension, round(score, 1)::double AS score, weight::double AS weight FROM s")
def quality_dimensions(spark, sf_dir):
    return r6(spark.createDataFrame([(k, float(v["score"]), float(v["weight"])) for k, v in _audit(spark, sf_dir)["dimensions"].items()], "dimension string, score double, weight double"), "weight")


@query("quality_score", _DIMENSIONS + ", t AS (SELECT round(sum(score * weight), 1)::double AS dqs FROM s) SELECT dqs, CASE WHEN dqs >= 85 THEN 'production_ready' WHEN dqs >= 65 THEN 'usable_with_caveats' ELSE 'remediation_required' END AS grade, (SELECT n FROM n)::bigint AS total_rows, (SELECT n.n - k FROM n, u)::bigint AS duplicate_rows FROM t")
def quality_score(spark, sf_dir):
    a = _audit(spark, sf_dir)
    return spark.createDataFrame([(float(a["dqs"]), a["grade"], a["total_rows"], a["duplicate_rows"])], "dqs double, grade string, total_rows long, duplicate_rows long")


@query("inspection", f"WITH d AS (SELECT * FROM {_SICK}), k AS (SELECT kind, count(*) AS n FROM d GROUP BY 1) SELECT (SELECT count(*) FROM d) AS total_rows, 4::bigint AS total_columns, (SELECT count(*) FILTER (value IS NULL) FROM d) AS missing_values, 'classification' AS task, CASE WHEN count(*) = 2 THEN 'f1' ELSE 'macro_f1' END AS metric FROM k")
def inspection(spark, sf_dir):
    r = profile.inspect_data(_sick(spark, sf_dir), "kind")
    return spark.createDataFrame([(r["total_rows"], r["total_columns"], r["missing_values"], r["recommended_task"], r["recommended_metric"])], "total_rows long, total_columns long, missing_values long, task string, metric string")


# ------------------------------------------------------------------ stability and studies


@query(
    "stability_criteria",
    BASELINE
    + """, l AS (SELECT *, list_reduce(list_prepend(centre, list(value) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING)), lambda a, b: 0.9 * a + 0.1 * b) AS s, 3 * sigma * sqrt(0.1 / 1.9 * (1 - pow(0.9, 2 * (idx + 1)))) AS w FROM z)
SELECT user_id, count(*) AS n_points, round(stddev_samp(value) / nullif(any_value(sigma), 0), 6) AS sigma_ratio, CASE WHEN any_value(sigma) > 0 THEN round(count(*) FILTER (abs(value - centre) > 3 * sigma) / count(*), 6) ELSE 0 END AS outlier_rate_beyond_3_sigma, CASE WHEN any_value(sigma) > 0 THEN round(count(*) FILTER (abs(s - centre) > w) / count(*), 6) END AS ewma_violation_rate,
CASE WHEN count(*) >= 3 THEN round(abs(regr_slope(value, idx) * (count(*) - 1)) / nullif(any_value(sigma), 0), 6) END AS fitted_trend_sigmas FROM l GROUP BY user_id""",
)
def stability_criteria(spark, sf_dir):
    names = ["sigma_ratio", "outlier_rate_beyond_3_sigma", "ewma_violation_rate", "fitted_trend_sigmas"]
    return r6(quality.criteria_values(table(spark, sf_dir, "events"), "value", ORDER, "user_id").select("user_id", "n_points", *names), *names)


@query("cell_balance", "WITH c AS (SELECT l_returnflag AS part, l_linestatus AS operator, count(*) AS n FROM lineitem GROUP BY 1, 2), u AS (SELECT n AS usual FROM c GROUP BY n ORDER BY count(*) DESC, n LIMIT 1) SELECT part, operator, n, usual, n = usual AS balanced FROM c, u")
def cell_balance(spark, sf_dir):
    return quality.cell_balance(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


# ------------------------------------------------------------------ sequences


def _two_logs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error' and user_id % 5 <> 0").select("user_id", col("ts").alias("failed_at"))
    return events.where("event_type <> 'error' and user_id % 3 <> 0"), errors


_LOGS = "r AS (SELECT * FROM events WHERE event_type <> 'error' AND user_id % 3 <> 0), f AS (SELECT user_id, ts FROM events WHERE event_type = 'error' AND user_id % 5 <> 0)"


@query("unmatched_assets", f"WITH {_LOGS} SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'without_events' ELSE 'without_readings' END AS side FROM (SELECT DISTINCT user_id FROM r) a FULL JOIN (SELECT DISTINCT user_id FROM f) b USING (user_id) WHERE a.user_id IS NULL OR b.user_id IS NULL")
def unmatched_assets(spark, sf_dir):
    readings, errors = _two_logs(spark, sf_dir)
    both = sequence.unmatched(readings.select(col("user_id").alias("asset")).distinct(), errors.select(col("user_id").alias("event_asset")).distinct())
    return both.where("asset is null or event_asset is null").select(F.coalesce("asset", "event_asset").alias("user_id"), F.when(F.col("event_asset").isNull(), "without_events").otherwise("without_readings").alias("side"))


@query("label_report", f"WITH {_LOGS}, j AS (SELECT r.*, (epoch_us(f.ts) - epoch_us(r.ts)) / 3.6e9 AS tte FROM r ASOF LEFT JOIN f ON r.user_id = f.user_id AND r.ts < f.ts) SELECT count(*) AS rows, count(*) FILTER (tte > 2 AND tte <= 48) AS positives, round(count(*) FILTER (tte > 2 AND tte <= 48) / count(*), 6) AS positive_rate, count(DISTINCT user_id) AS assets, (SELECT count(*) FROM f WHERE user_id IN (SELECT user_id FROM r)) AS events_used, count(*) FILTER (tte IS NULL) AS censored_rows, count(*) FILTER (tte > 0 AND tte <= 2) AS rows_inside_lead_time FROM j")
def label_report(spark, sf_dir):
    _, report = sequence.build_failure_labels(*_two_logs(spark, sf_dir), "user_id", "ts", "48h", lead_time="2h")
    names = ("rows", "positives", "positive_rate", "assets", "events_used", "censored_rows", "rows_inside_lead_time")
    return spark.createDataFrame([tuple(report[k] for k in names)], "rows long, positives long, positive_rate double, assets long, events_used long, censored_rows long, rows_inside_lead_time long")


@query("feature_drop_report", "WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT count(*) AS rows_in, count(*) FILTER (idx >= 20 AND n >= 20) AS rows_out, count(*) - count(*) FILTER (idx >= 20 AND n >= 20) AS rows_dropped, 4::bigint AS n_features_added, count(DISTINCT user_id) AS assets FROM p")
def feature_drop_report(spark, sf_dir):
    _, report = sequence.add_window_features(table(spark, sf_dir, "events"), "user_id", "ts", ["value"], (12,), baseline_n=20)
    names = ("rows_in", "rows_out", "rows_dropped", "n_features_added", "assets")
    return spark.createDataFrame([tuple(report[k] for k in names)], ", ".join(f"{n} long" for n in names))


# ------------------------------------------------------------------ splits


@query("split_tail", "WITH r AS (SELECT ts, row_number() OVER (ORDER BY ts DESC) AS k, count(*) OVER () AS n FROM events), c AS (SELECT min(ts) AS cut FROM r WHERE k <= ceil(0.2 * n - 1e-9)) SELECT event_id, CASE WHEN ts >= cut THEN 'test' ELSE 'train' END AS part FROM events, c")
def split_tail(spark, sf_dir):
    return split.tail_split(table(spark, sf_dir, "events"), "event_type", "ts", 0.2).select("event_id", "part")


@query("split_three_way", "WITH r AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k, count(*) OVER () AS n FROM events), c AS (SELECT min(ts) AS cut FROM r WHERE k = n - round_even(0.2 * n, 0)::bigint + 1), q AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k, count(*) OVER () AS n, (SELECT round_even(0.25 * count(*), 0)::bigint FROM events) AS v FROM events, c WHERE ts < cut), e AS (SELECT min(ts) AS edge FROM q WHERE k = n - v + 1) SELECT event_id, CASE WHEN ts >= cut THEN 'test' WHEN ts >= edge THEN 'validation' ELSE 'train' END AS part FROM events, c, e")
def split_three_way(spark, sf_dir):
    return split.three_parts(table(spark, sf_dir, "events"), "event_type", val_size=0.25, test_size=0.2, time_col="ts").select("event_id", "part")


@query("split_dispatch", "WITH r AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k, count(*) OVER () AS n FROM events), c AS (SELECT min(ts) AS cut FROM r WHERE k = n - round_even(0.2 * n, 0)::bigint + 1) SELECT CASE WHEN ts >= cut THEN 'test' ELSE 'train' END AS part, event_type, count(*) AS n, count(DISTINCT event_id) AS x_rows FROM events, c GROUP BY 1, 2")
def split_dispatch(spark, sf_dir):
    """Features and targets of both parts, counted by class; the targets meet their features by nothing but their part."""
    x_train, x_test, y_train, y_test = split.split_data(table(spark, sf_dir, "events").withColumn("event_class", F.col("event_type")), "event_type", time_col="ts")
    out = None
    for part, x, y in (("train", x_train, y_train), ("test", x_test, y_test)):
        rows = x.groupBy(F.col("event_class").alias("event_type")).agg(F.count_distinct("event_id").alias("x_rows")).join(y.groupBy("event_type").agg(F.count("*").alias("n")), "event_type")
        rows = rows.select(F.lit(part).alias("part"), "event_type", "n", "x_rows")
        out = rows if out is None else out.unionByName(rows)
    return out


# ------------------------------------------------------------------ reliability


@query(
    "failure_forecast",
    """WITH k AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY 1), m AS (SELECT *, n / 720.0::double * 168 AS mean FROM k),
g AS (SELECT user_id, mean, c, sum(CASE WHEN mean > 0 THEN exp(c * ln(mean) - mean - lgamma(c + 1)) ELSE (c = 0)::int END) OVER (PARTITION BY user_id ORDER BY c) AS upto FROM m, range(0, 80) r(c)),
q AS (SELECT user_id, min(c) FILTER (upto >= 0.1) AS lower, min(c) FILTER (upto >= 0.9) AS upper FROM g GROUP BY 1)
SELECT user_id, round(n / 720.0::double, 6) AS rate, round(mean, 6) AS expected, lower, upper, round(1 - exp(-mean), 6) AS prob_at_least_one FROM m JOIN q USING (user_id)""",
)
def failure_forecast(spark, sf_dir):
    k = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n"))
    out = reliability.forecast_columns(F.col("n"), F.lit(720.0), F.lit(168.0))
    rows = k.select("user_id", *(v.alias(name) for name, v in out.items()))
    return r6(rows, "rate", "expected", "prob_at_least_one").withColumns({c: F.col(c).cast("long") for c in ("lower", "upper")})


#: The cost rate of replacing at t, with the incomplete gamma function as its series.
_RATE = "(8000 * exp(-z) + 50000 * (1 - exp(-z))) / (90.0 / 2.4 * exp(lgamma(1 / 2.4)) * list_sum(list_transform(range(0, 400), lambda k: exp(-z + (1 / 2.4 + k) * ln(z) - lgamma(1 / 2.4 + k + 1)))))"


@query("pm_cost_rates", f"WITH g AS (SELECT 4.5::double + i * (265.5::double / 79) AS t FROM range(0, 80) r(i)), z AS (SELECT t, pow(t / 90.0, 2.4) AS z FROM g) SELECT round(t, 6) AS t, round({_RATE}, 4) AS cost_rate FROM z")
def pm_cost_rates(spark, sf_dir):
    from millwright.functions.session import importable

    rows = reliability.pm_cost_curve(importable(spark), 2.4, 90.0, 8000.0, 50000.0)
    return rows.select(F.round("t", 6).alias("t"), F.round("cost_rate", 4).alias("cost_rate"))


@query("pm_interval", f"WITH g AS (SELECT 20::double + i * 0.002 AS t FROM range(0, 20000) r(i)), z AS (SELECT t, pow(t / 90.0, 2.4) AS z FROM g), c AS (SELECT t, z, {_RATE} AS rate FROM z), b AS (SELECT arg_min(t, rate) AS t, arg_min(z, rate) AS z, min(rate) AS rate, 50000 / (90 * exp(lgamma(1 + 1 / 2.4))) AS never FROM c) SELECT round(t, 1) AS interval, round(rate, 4) AS cost_rate, round(never, 4) AS cost_rate_run_to_failure, round(1 - rate / never, 6) AS saving_fraction, round(1 - exp(-z), 3) AS prob_failure_before_pm, 1 - rate / never >= {PM_SAVING} AS worthwhile FROM b")
def pm_interval(spark, sf_dir):
    r = reliability.calculate_optimal_pm_interval(2.4, 90.0, 8000.0, 50000.0)
    row = (round(r["interval"], 1), round(r["cost_rate"], 4), round(r["cost_rate_run_to_failure"], 4), round(r["saving_fraction"], 6), round(r["prob_failure_before_pm"], 3), r["worthwhile"])
    return spark.createDataFrame([row], "interval double, cost_rate double, cost_rate_run_to_failure double, saving_fraction double, prob_failure_before_pm double, worthwhile boolean")


@query(
    "weibull_points",
    """WITH RECURSIVE g AS (SELECT user_id AS asset, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 3.6e9 AS x FROM events WHERE event_type = 'error'),
l AS (SELECT asset, list(ln(x) ORDER BY x) AS logs, avg(ln(x)) AS mean, max(ln(x)) AS top, count(*) AS n FROM g WHERE x > 0 GROUP BY 1),
b AS (SELECT asset, logs, mean, top, n, 0.05::double AS low, 50.0::double AS high, 0 AS i FROM l WHERE n >= 8
UNION ALL SELECT asset, logs, mean, top, n, CASE WHEN f < 0 THEN mid ELSE low END, CASE WHEN f < 0 THEN high ELSE mid END, i + 1 FROM (SELECT *, (low + high) / 2 AS mid, list_sum(list_transform(logs, lambda v: exp((low + high) / 2 * (v - top)) * v)) / list_sum(list_transform(logs, lambda v: exp((low + high) / 2 * (v - top)))) - 2 / (low + high) - mean AS f FROM b WHERE i < 60)),
e AS (SELECT asset, n, (low + high) / 2 AS beta, exp(top + ln(list_avg(list_transform(logs, lambda v: exp((low + high) / 2 * (v - top))))) / ((low + high) / 2)) AS eta FROM b WHERE i = 60)
SELECT asset, n AS n_intervals, round(beta, 5) AS beta, round(eta, 4) AS eta, round(eta * exp(lgamma(1 + 1 / beta)), 3) AS mttf, round(eta * pow(-ln(0.9), 1 / beta), 4) AS b10_life FROM e""",
)
def weibull_points(spark, sf_dir):
    """Shape, scale, mean life and B10 of each asset's fit; the bootstrap's interval is no SQL."""
    gaps = reliability.failure_intervals(table(spark, sf_dir, "events"), "ts", "user_id", "event_type", ("error",))
    rows = reliability.weibull_by_asset(gaps.withColumn("asset", F.col("asset").cast("long")), order_by="at").where("beta is not null")
    return rows.select("asset", "n_intervals", *(F.round(c, k).alias(c) for c, k in (("beta", 5), ("eta", 4), ("mttf", 3), ("b10_life", 4))))


# ------------------------------------------------------------------ live charts


def _live(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """A stream over the events table, run until it has read what there is; the rows it wrote to the shared folder."""
    from millwright.functions.session import importable

    schema = importable(spark).read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{home}/live-{uuid.uuid4().hex}"
    build(stream).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows")


@query("live_ewma", "SELECT user_id, ts, idx, round(s, 6) AS stat, round(50 + w, 6) AS ucl, round(50 - w, 6) AS lcl, abs(s - 50) > w AS violation FROM (SELECT user_id, ts, idx, list_reduce(list_prepend(50.0::double, list(value) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING)), lambda a, b: 0.8 * a + 0.2 * b) AS s, 3 * 40 * sqrt(0.2 / 1.8 * (1 - pow(0.8, 2 * (idx + 1)))) AS w FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS idx FROM events))")
def live_ewma(spark, sf_dir):
    from millwright.streaming import charts

    return r6(_live(spark, sf_dir, lambda s: charts.live_ewma(s, "user_id", "ts", "value", 50.0, 40.0)), "stat", "ucl", "lcl")


@query("live_cusum", "WITH p AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events), t AS (SELECT *, sum(value - 50 - 20) OVER o AS h, sum(50 - value - 20) OVER o AS l FROM p WINDOW o AS (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING)), u AS (SELECT user_id, ts, h - least(0, min(h) OVER o) AS sh, l - least(0, min(l) OVER o) AS sl FROM t WINDOW o AS (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING)) SELECT user_id, ts, round(sh, 5) AS cusum_high, round(sl, 5) AS cusum_low, greatest(sh, sl) > 200 AS violation FROM u")
def live_cusum(spark, sf_dir):
    from millwright.streaming import charts

    rows = _live(spark, sf_dir, lambda s: charts.live_cusum(s, "user_id", "ts", "value", 50.0, 40.0))
    return rows.withColumns({c: F.round(c, 5) for c in ("cusum_high", "cusum_low")})
