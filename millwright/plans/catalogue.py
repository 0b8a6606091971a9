"""The named queries over the test tables, each with the SQL it equals.

Users are assets, errors are failures, event values are readings. Floats are
rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions.columns import col, number
from millwright.functions.session import importable
from millwright.operators import drift, metrics, profile, quality, reliability, sequence, split, spc

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in names})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EWMA chart of every user's readings, with the label of a failure within a day."""
    events = table(spark, sf_dir, "events")
    labelled = sequence.label_failures(events.where("event_type <> 'error'"), events.where("event_type = 'error'").select("user_id", col("ts").alias("failed_at")), "user_id", "ts", 24.0)
    chart = spc.ewma(labelled.withColumn("k", F.struct("ts", "event_id")), "value", ["ts", "event_id"], "user_id")
    return r6(chart.join(labelled.select("event_id", "failure", "time_to_event"), "event_id").select("user_id", "event_id", "idx", "stat", "ucl", "lcl", "violation", "failure", "time_to_event"), "stat", "ucl", "lcl", "time_to_event")


EVENTS_ORDERED = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events"
BASELINE = f"""WITH p AS ({EVENTS_ORDERED}),
b AS (SELECT user_id, avg(value) AS centre, coalesce(avg(abs(value - prev)) / 1.128, 0) AS sigma, count(*) AS n FROM p GROUP BY user_id),
z AS (SELECT p.*, b.centre, b.sigma, b.n FROM p JOIN b USING (user_id))"""
ORDER = ["ts", "event_id"]


# ------------------------------------------------------------------ Pareto and maintenance figures

_PARETO = """WITH t AS (SELECT {cat} AS category, {val} AS value FROM lineitem GROUP BY 1),
c AS (SELECT *, sum(value) OVER (ORDER BY value DESC, category ROWS UNBOUNDED PRECEDING) AS upto, sum(value) OVER () AS total, row_number() OVER (ORDER BY value DESC, category) AS rank FROM t)
SELECT category, round(value, 2) AS value, rank, round(value / total * 100, 6) AS percentage, round(upto / total * 100, 6) AS cumulative_percentage, (upto - value) / total < 0.8 - 1e-9 AS is_vital_few FROM c"""


def _pareto(spark, sf_dir, value):
    rows = table(spark, sf_dir, "lineitem").withColumn("category", F.concat("l_returnflag", "l_linestatus"))
    return r6(reliability.pareto(rows, "category", value), "percentage", "cumulative_percentage").withColumns({"value": F.round("value", 2), "rank": F.col("rank").cast("long")})


@query("pareto_value", _PARETO.format(cat="l_returnflag || l_linestatus", val="sum(l_extendedprice)"))
def pareto_value(spark, sf_dir):
    return _pareto(spark, sf_dir, "l_extendedprice")


@query("pareto_count", _PARETO.format(cat="l_returnflag || l_linestatus", val="count(*)::double"))
def pareto_count(spark, sf_dir):
    return _pareto(spark, sf_dir, None)


@query("mtbf", "SELECT event_type, count(*) AS breakdowns, round(720.0 / count(*), 6) AS mtbf_hours FROM events WHERE event_type IN ('error', 'view') GROUP BY event_type")
def mtbf(spark, sf_dir):
    rows = reliability.breakdowns(table(spark, sf_dir, "events"), "event_type", ("error", "view"))
    return rows.groupBy("event_type").agg(F.count("*").alias("breakdowns"), F.round(F.lit(720.0) / F.count("*"), 6).alias("mtbf_hours"))


@query(
    "mttr",
    """WITH w AS (SELECT o_orderpriority, o_orderkey % 7 / 2.0 AS wait, (o_orderkey % 11 - 1) / 2.0 AS repair FROM orders WHERE o_orderstatus = 'F'), g AS (SELECT *, wait >= 0 AND repair >= 0 AS ok FROM w)
SELECT o_orderpriority, round(avg(repair) FILTER (ok), 6) AS mttr_hours, round(avg(wait) FILTER (ok), 6) AS mtta_hours, round(avg(wait + repair) FILTER (ok), 6) AS mdt_hours, count(*) FILTER (ok) AS repairs, count(*) FILTER (NOT ok) AS rows_excluded,
round(max(repair) FILTER (ok), 6) AS longest_repair_hours, round(max(wait) FILTER (ok), 6) AS longest_wait_hours FROM g GROUP BY 1""",
)
def mttr(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    later = lambda c, minutes: c + F.make_dt_interval(mins=minutes.cast("int"))
    started = later(F.col("o_orderdate"), F.col("o_orderkey") % 7 * 30)
    orders = orders.select("o_orderpriority", "o_orderstatus", F.col("o_orderdate").alias("reported_at"), started.alias("started_at"), later(started, (F.col("o_orderkey") % 11 - 1) * 30).alias("finished_at"))
    return r6(reliability.repairs(orders, ["o_orderpriority"], wo_type_col="o_orderstatus", breakdown_types=("F",)), "mttr_hours", "mtta_hours", "mdt_hours", "longest_repair_hours", "longest_wait_hours")


@query(
    "availability",
    """WITH s AS (SELECT o_orderpriority, count(*) * 3.0 AS up, sum(o_orderkey % 5) * 0.5 AS repair, sum(o_orderkey % 9) * 0.5 AS down FROM orders GROUP BY 1)
SELECT o_orderpriority, round(up / (up + repair), 6) AS inherent_availability, round(up / (up + down), 6) AS operational_availability, round(up / (up + repair) - up / (up + down), 6) AS availability_lost_to_waiting FROM s""",
)
def availability(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg((F.count("*") * 3.0).alias("up"), (F.sum(F.col("o_orderkey") % 5) * 0.5).alias("repair"), (F.sum(F.col("o_orderkey") % 9) * 0.5).alias("down"))
    out = reliability.availability_columns(F.col("up"), F.col("repair"), F.col("down"))
    return s.select("o_orderpriority", *(F.round(c, 6).alias(k) for k, c in out.items()))


@query(
    "oee",
    """WITH s AS (SELECT l_returnflag, l_linestatus, count(*) * 2.0 AS planned, sum(l_quantity) * 0.06 AS run, count(*)::double AS total, count(*) FILTER (l_discount < 0.08)::double AS good FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, round(run / planned, 6) AS availability, round(1.1 * total / run, 6) AS performance, round(good / total, 6) AS quality, round(run / planned * (1.1 * total / run) * (good / total), 6) AS oee, run / planned * (1.1 * total / run) * (good / total) >= 0.85 AS meets_world_class FROM s""",
)
def oee(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg((F.count("*") * 2.0).alias("planned"), (F.sum("l_quantity") * 0.06).alias("run"), F.count("*").cast("double").alias("total"), F.count_if(F.col("l_discount") < 0.08).cast("double").alias("good"))
    out = reliability.oee_columns(F.col("planned"), F.col("run"), F.lit(1.1), F.col("total"), F.col("good"))
    return r6(s.select("l_returnflag", "l_linestatus", *(c.alias(k) for k, c in out.items())), "availability", "performance", "quality", "oee")


@query("tbf_intervals", "SELECT user_id AS asset, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 3.6e9, 6) AS interval FROM events WHERE event_type = 'error'")
def tbf_intervals(spark, sf_dir):
    return r6(reliability.failure_intervals(table(spark, sf_dir, "events"), "ts", "user_id", "event_type", ("error",)).select("asset", "interval"), "interval")


@query(
    "crow_amsaa",
    """WITH f AS (SELECT user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS t FROM events WHERE event_type = 'error'), k AS (SELECT user_id, count(*) AS all_n, count(*) FILTER (t > 0 AND t <= 720) AS n_failures, sum(ln(720 / t)) FILTER (t > 0 AND t <= 720) AS log_sum FROM f GROUP BY 1),
b AS (SELECT *, CASE WHEN n_failures >= 5 AND log_sum > 0 THEN n_failures / log_sum END AS beta FROM k)
SELECT user_id, n_failures, all_n - n_failures AS dropped, round(beta, 6) AS beta, round((n_failures - 1.0) / n_failures * beta, 6) AS beta_unbiased, round(1 / (n_failures / pow(720, beta) * beta * pow(720, beta - 1)), 6) AS current_mtbf FROM b""",
)
def crow_amsaa(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type = 'error'")
    rows = events.withColumn("t", reliability.hours(F.col("ts"), F.lit("2024-01-01").cast("timestamp_ntz")))
    return r6(reliability.crow_amsaa(rows, "t", 720.0, ["user_id"]).select("user_id", "n_failures", "dropped", "beta", "beta_unbiased", "current_mtbf"), "beta", "beta_unbiased", "current_mtbf")


@query("weibull_fit")
def weibull_fit(spark, sf_dir):
    gaps = reliability.failure_intervals(table(spark, sf_dir, "events"), "ts", "user_id", "event_type", ("error",))
    return reliability.weibull_by_asset(gaps.withColumn("asset", F.col("asset").cast("long")), order_by="at")


@query("weibull_curves", "SELECT round(t, 6) AS t, round(exp(-pow(t / 90.0, 2.4)), 6) AS reliability, round(2.4 / 90.0 * pow(t / 90.0, 1.4), 6) AS hazard, round(2.4 / 90.0 * pow(t / 90.0, 1.4) * exp(-pow(t / 90.0, 2.4)), 6) AS pdf FROM (SELECT i * 225.0::double / 80 AS t FROM range(1, 81) r(i))")
def weibull_curves(spark, sf_dir):
    return r6(reliability.weibull_curves(spark, 2.4, 90.0), "t", "reliability", "hazard", "pdf")


@query("pm_cost_curve")
def pm_cost_curve(spark, sf_dir):
    importable(spark)
    return reliability.pm_cost_curve(spark, 2.4, 90.0, 8000.0, 50000.0)


@query(
    "wilson_ci",
    """WITH c AS (SELECT user_id, count(*)::double AS n, count(*) FILTER (event_type = 'error')::double AS k FROM events GROUP BY 1), z AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM c)
SELECT user_id, round(p, 6) AS point, round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4*n*n))), 6) AS lower, round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4*n*n))), 6) AS upper FROM z""",
)
def wilson_ci(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("event_type") == "error").cast("double").alias("k"))
    return r6(c.select("user_id", *(v.alias(k) for k, v in reliability.wilson_columns(F.col("k"), F.col("n")).items())), "point", "lower", "upper")


@query(
    "maintenance_savings",
    """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 40) AS tp, count(*) FILTER (event_type <> 'error' AND value > 150) AS fp, count(*) FILTER (event_type = 'error' AND value <= 40) AS fn FROM events GROUP BY 1),
s AS (SELECT *, (tp + fn) * 50000.0 AS b, fn * 50000.0 + tp * 9500.0 + fp * 1500.0 AS a FROM c)
SELECT user_id, b::double AS run_to_failure_cost, a::double AS predictive_cost, (b - a)::double AS cost_savings, round(CASE WHEN b <> 0 THEN (b - a)::double * 100 / b ELSE 0 END, 6) AS savings_percentage, round(CASE WHEN tp + fn <> 0 THEN tp::double / (tp + fn) END, 6) AS breakdown_avoidance_rate FROM s""",
)
def maintenance_savings(spark, sf_dir):
    error, value = F.col("event_type") == "error", F.col("value")
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(error & (value > 40)).alias("tp"), F.count_if(~error & (value > 150)).alias("fp"), F.count_if(error & (value <= 40)).alias("fn"))
    return r6(c.select("user_id", *(v.alias(k) for k, v in reliability.savings_columns(F.col("tp"), F.col("fp"), F.col("fn")).items())), "savings_percentage", "breakdown_avoidance_rate")


# ------------------------------------------------------------------ charts


@query("spc_limits", "SELECT user_id, round(avg(value), 6) AS mean, round(avg(value) + 3 * coalesce(stddev_samp(value), 0), 6) AS ucl, round(avg(value) - 3 * coalesce(stddev_samp(value), 0), 6) AS lcl FROM events GROUP BY 1")
def spc_limits(spark, sf_dir):
    return r6(spc.spc_limits(table(spark, sf_dir, "events"), "value", "user_id"), "mean", "ucl", "lcl")


@query(
    "baseline_sigma",
    f"""WITH p AS ({EVENTS_ORDERED}), s AS (SELECT user_id, avg(value) FILTER (idx < 30) AS centre, avg(abs(value - prev)) FILTER (idx < 30) / 1.128 AS sigma, count(*) FILTER (idx < 30) AS k, covar_pop(value, prev) FILTER (idx < 30 AND prev IS NOT NULL) AS c, stddev_pop(value) FILTER (idx < 30 AND prev IS NOT NULL) AS a, stddev_pop(prev) FILTER (idx < 30) AS b FROM p GROUP BY 1)
SELECT user_id, round(centre, 6) AS centre, round(sigma, 6) AS sigma, round(CASE WHEN k >= 3 THEN c / nullif(a * b, 0) END, 6) AS lag1 FROM s""",
)
def baseline_sigma(spark, sf_dir):
    points = spc.series(table(spark, sf_dir, "events"), "value", ORDER, "user_id")
    return r6(spc.with_baseline(points, ["user_id"], 30).select("user_id", "centre", "sigma", "lag1").distinct(), "centre", "sigma", "lag1").distinct()


@query(
    "ewma_by_user",
    BASELINE
    + """, l AS (SELECT *, list_reduce(list_prepend(centre, list(value) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING)), lambda a, b: 0.8 * a + 0.2 * b) AS s, 3 * sigma * sqrt(0.2 / 1.8 * (1 - pow(0.8, 2 * (idx + 1)))) AS w FROM z)
SELECT user_id, event_id, idx, round(s, 6) AS stat, round(centre + w, 6) AS ucl, round(centre - w, 6) AS lcl, sigma > 0 AND (s > centre + w OR s < centre - w) AS violation FROM l""",
)
def ewma_by_user(spark, sf_dir):
    chart = spc.ewma(table(spark, sf_dir, "events"), "value", ORDER, "user_id")
    return r6(chart.select("user_id", "event_id", F.col("idx").cast("long").alias("idx"), "stat", "ucl", "lcl", "violation"), "stat", "ucl", "lcl")


@query(
    "cusum_by_user",
    BASELINE
    + """, t AS (SELECT *, sum(value - centre - 0.5 * sigma) OVER o AS h, sum(centre - value - 0.5 * sigma) OVER o AS l FROM z WINDOW o AS (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
u AS (SELECT *, h - least(0, min(h) OVER o) AS sh, l - least(0, min(l) OVER o) AS sl FROM t WINDOW o AS (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, idx, round(sh, 6) AS cusum_high, round(sl, 6) AS cusum_low, sigma > 0 AND sh > 5 * sigma AS violation_high, sigma > 0 AND sl > 5 * sigma AS violation_low FROM u""",
)
def cusum_by_user(spark, sf_dir):
    chart = spc.cusum(table(spark, sf_dir, "events"), "value", ORDER, "user_id")
    return r6(chart.select("user_id", "event_id", F.col("idx").cast("long").alias("idx"), "cusum_high", "cusum_low", "violation_high", "violation_low"), "cusum_high", "cusum_low")


_RULES = (
    BASELINE
    + """, d AS (SELECT *, (value - centre) / nullif(sigma, 0) AS zz, sign(value - centre) AS side, sign(value - prev) AS dd FROM z),
f AS (SELECT *, (dd * lag(dd) OVER (PARTITION BY user_id ORDER BY idx) < 0)::int AS flip FROM d),
r AS (SELECT user_id, event_id, idx,
  abs(zz) > 3 AS rule_1,
  idx >= 8 AND abs(sum(side) OVER (PARTITION BY user_id ORDER BY idx ROWS 8 PRECEDING)) = 9 AS rule_2,
  idx >= 5 AND abs(sum(dd) OVER (PARTITION BY user_id ORDER BY idx ROWS 4 PRECEDING)) = 5 AS rule_3,
  idx >= 13 AND sum(flip) OVER (PARTITION BY user_id ORDER BY idx ROWS 11 PRECEDING) = 12 AS rule_4,
  idx >= 2 AND (count(*) FILTER (zz > 2) OVER (PARTITION BY user_id ORDER BY idx ROWS 2 PRECEDING) >= 2 OR count(*) FILTER (zz < -2) OVER (PARTITION BY user_id ORDER BY idx ROWS 2 PRECEDING) >= 2) AS rule_5,
  idx >= 4 AND (count(*) FILTER (zz > 1) OVER (PARTITION BY user_id ORDER BY idx ROWS 4 PRECEDING) >= 4 OR count(*) FILTER (zz < -1) OVER (PARTITION BY user_id ORDER BY idx ROWS 4 PRECEDING) >= 4) AS rule_6,
  idx >= 14 AND max(abs(zz)) OVER (PARTITION BY user_id ORDER BY idx ROWS 14 PRECEDING) <= 1 AS rule_7,
  idx >= 7 AND min(abs(zz)) OVER (PARTITION BY user_id ORDER BY idx ROWS 7 PRECEDING) > 1 AS rule_8 FROM f)
"""
)


def _rules(spark, sf_dir, rules):
    return spc.control_rules(table(spark, sf_dir, "events"), "value", ORDER, "user_id", rules=rules)


def _rule_query(k: int) -> None:
    @query(f"nelson_rule_{k}", _RULES + f"SELECT user_id, event_id, idx FROM r WHERE rule_{k}")
    def one(spark, sf_dir, k=k):
        return _rules(spark, sf_dir, (k,)).where(f"rule_{k}").select("user_id", "event_id", F.col("idx").cast("long").alias("idx"))


for _k in range(1, 9):
    _rule_query(_k)


@query("nelson_first", _RULES + ", h AS (SELECT user_id, idx, unnest([CASE WHEN rule_1 THEN 1 END, CASE WHEN rule_2 THEN 2 END, CASE WHEN rule_5 THEN 5 END, CASE WHEN rule_6 THEN 6 END]) AS k FROM r) SELECT user_id, min(idx * 10 + k) // 10 AS first_index, min(idx * 10 + k) % 10 AS first_rule, count(*) AS n_violations FROM h WHERE k IS NOT NULL GROUP BY 1")
def nelson_first(spark, sf_dir):
    found = spc.first_violations(_rules(spark, sf_dir, (1, 2, 5, 6)), (1, 2, 5, 6), "user_id")
    return found.withColumns({c: F.col(c).cast("long") for c in ("first_index", "first_rule")})


# ------------------------------------------------------------------ sequence features


@query(
    "asof_failure_labels",
    """WITH r AS (SELECT * FROM events WHERE event_type <> 'error'), f AS (SELECT user_id, ts FROM events WHERE event_type = 'error'),
j AS (SELECT r.*, (epoch_us(f.ts) - epoch_us(r.ts)) / 3.6e9 AS tte FROM r ASOF LEFT JOIN f ON r.user_id = f.user_id AND r.ts < f.ts)
SELECT event_id, user_id, round(tte, 6) AS time_to_event, coalesce(tte > 2 AND tte <= 48, false)::int AS failure FROM j""",
)
def asof_failure_labels(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    out = sequence.label_failures(events.where("event_type <> 'error'"), events.where("event_type = 'error'").select("user_id", col("ts").alias("failed_at")), "user_id", "ts", 48.0, lead_time=2.0)
    return r6(out.select("event_id", "user_id", "time_to_event", F.col("failure").cast("int").alias("failure")), "time_to_event")


def _features(spark, sf_dir, stats, drop):
    return sequence.window_features(table(spark, sf_dir, "events"), "user_id", "ts", ["value"], (12,), stats, 20, ["event_id"])


@query("rolling_mean_std", "SELECT event_id, round(CASE WHEN count(value) OVER o = 12 THEN avg(value) OVER o END, 6) AS value_w12_mean, round(CASE WHEN count(value) OVER o = 12 THEN stddev_samp(value) OVER o END, 6) AS value_w12_std FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 11 PRECEDING)")
def rolling_mean_std(spark, sf_dir):
    return r6(_features(spark, sf_dir, ("mean", "std"), False).select("event_id", "value_w12_mean", "value_w12_std"), "value_w12_mean", "value_w12_std")


@query("rolling_slope", f"WITH p AS ({EVENTS_ORDERED}) SELECT event_id, round(CASE WHEN count(value - prev) OVER o = 12 THEN avg(value - prev) OVER o END, 6) AS value_w12_slope FROM p WINDOW o AS (PARTITION BY user_id ORDER BY idx ROWS 11 PRECEDING)")
def rolling_slope(spark, sf_dir):
    return r6(_features(spark, sf_dir, ("slope",), False).select("event_id", "value_w12_slope"), "value_w12_slope")


@query("baseline_delta", f"WITH p AS ({EVENTS_ORDERED}), b AS (SELECT user_id, avg(value) AS m, count(*) AS n FROM p WHERE idx < 20 GROUP BY 1) SELECT event_id, round(CASE WHEN idx >= 20 AND n >= 20 THEN value - m END, 6) AS value_vs_baseline FROM p JOIN b USING (user_id)")
def baseline_delta(spark, sf_dir):
    return r6(_features(spark, sf_dir, ("delta_baseline",), False).select("event_id", "value_vs_baseline"), "value_vs_baseline")


# ------------------------------------------------------------------ quality of data

DIRTY = """(SELECT *, CASE WHEN doc_id % 17 = 0 THEN 'N/A ' WHEN doc_id % 19 = 0 THEN '-' ELSE source END AS tag, CASE WHEN doc_id % 23 = 0 THEN -999 ELSE n_chars END AS chars FROM documents)"""


def _dirty(spark, sf_dir):
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.when(i % 17 == 0, "N/A ").when(i % 19 == 0, "-").otherwise(F.col("source")).alias("tag"), F.when(i % 23 == 0, F.lit(-999)).otherwise(F.col("n_chars")).alias("chars"))


@query("silent_nulls", f"SELECT 'tag' AS \"column\", 'placeholder_string' AS kind, lower(trim(tag)) AS token, count(*) AS n FROM {DIRTY} d WHERE lower(trim(tag)) IN ('n/a', '-') GROUP BY 3 UNION ALL SELECT 'chars', 'numeric_sentinel', '-999.0', count(*) FROM {DIRTY} d WHERE chars = -999 HAVING count(*) > 0")
def silent_nulls(spark, sf_dir):
    return profile.placeholders(_dirty(spark, sf_dir).drop("doc_id"))


@query(
    "outliers_mzscore",
    """WITH c AS (SELECT 'value' AS "column", value AS x FROM events), m AS (SELECT "column", count(*) AS n, quantile_cont(x, 0.5) AS median FROM c GROUP BY 1), d AS (SELECT c.*, n, median, abs(x - median) AS a FROM c JOIN m USING ("column")), s AS (SELECT "column", quantile_cont(a, 0.5) AS mad FROM d GROUP BY 1), o AS (SELECT * FROM d JOIN s USING ("column") WHERE abs(0.6745 * (x - median) / mad) > 3.5)
SELECT "column", n, round(median, 6) AS median, round(mad, 6) AS mad, count(*) AS count, round(min(x), 6) AS flagged_min, round(max(x), 6) AS flagged_max FROM o GROUP BY 1, 2, 3, 4""",
)
def outliers_mzscore(spark, sf_dir):
    return r6(profile.outliers_modified_z(table(spark, sf_dir, "events"), ["value"]), "median", "mad", "flagged_min", "flagged_max")


@query(
    "outliers_iqr",
    """WITH q AS (SELECT count(*) AS n, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT 'value' AS "column", n, round(a - 1.5 * (b - a), 6) AS flagged_min, round(b + 1.5 * (b - a), 6) AS flagged_max, (SELECT count(*) FROM events WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS count FROM q""",
)
def outliers_iqr(spark, sf_dir):
    return r6(profile.outliers_iqr(table(spark, sf_dir, "events"), ["value"]), "flagged_min", "flagged_max")


@query("duplicate_rows", "SELECT count(*) AS total, count(DISTINCT (l_returnflag, l_linestatus, l_quantity, l_discount)) AS \"distinct\", count(*) - count(DISTINCT (l_returnflag, l_linestatus, l_quantity, l_discount)) AS duplicates FROM lineitem")
def duplicate_rows(spark, sf_dir):
    return profile.duplicate_rows(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


@query("dqs_components", f"SELECT count(*) AS rows, 0::bigint AS null_0, count(*) FILTER (tag IS NULL) AS null_1, count(*) FILTER (regexp_full_match(tag, '[0-9.]+')) AS number_1, 0::bigint AS null_2 FROM {DIRTY} d")
def dqs_components(spark, sf_dir):
    return profile.column_facts(_dirty(spark, sf_dir))


@query("target_facts", "SELECT sum(n)::bigint AS known, count(DISTINCT event_type) AS \"values\", NULL::bigint AS numbers, 0::bigint AS distinct_numbers, round(min(n) / sum(n), 6) AS rarest FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def target_facts(spark, sf_dir):
    return r6(profile.target_facts(table(spark, sf_dir, "events"), "event_type"), "rarest")


LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("corr_pearson", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a, b in profile._pairs(LINE_COLUMNS)))
def corr_pearson(spark, sf_dir):
    return r6(profile.pearson(table(spark, sf_dir, "lineitem"), LINE_COLUMNS), "correlation")


@query("corr_spearman", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(x, y), 6) AS correlation FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y FROM lineitem)" for a, b in profile._pairs(LINE_COLUMNS)))
def corr_spearman(spark, sf_dir):
    return r6(profile.spearman(table(spark, sf_dir, "lineitem"), LINE_COLUMNS), "correlation")


@query(
    "corr_kendall",
    """WITH p AS (SELECT p_size AS x, p_retailprice AS y, p_partkey AS i FROM part), s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s FROM p a JOIN p b ON a.i < b.i), n AS (SELECT count(*) * (count(*) - 1) / 2.0 AS n0 FROM p), tx AS (SELECT sum(k * (k - 1) / 2.0) AS t FROM (SELECT count(*) AS k FROM p GROUP BY x)), ty AS (SELECT sum(k * (k - 1) / 2.0) AS t FROM (SELECT count(*) AS k FROM p GROUP BY y))
SELECT 'p_size' AS a, 'p_retailprice' AS b, round(s / sqrt((n0 - tx.t) * (n0 - ty.t)), 6) AS correlation FROM s, n, tx, ty""",
)
def corr_kendall(spark, sf_dir):
    return r6(profile.kendall(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]), "correlation")


# ------------------------------------------------------------------ drift

CUT = "TIMESTAMP '2024-01-16'"


def _sides(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts")
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    return events.where(~late).drop("ts"), events.where(late).drop("ts")


_PSI_TERMS = "sum((CASE WHEN b > 0 THEN b / nb ELSE 1e-4 END - CASE WHEN t > 0 THEN t / nt ELSE 1e-4 END) * ln(CASE WHEN b > 0 THEN b / nb ELSE 1e-4 END / CASE WHEN t > 0 THEN t / nt ELSE 1e-4 END))"


@query(
    "psi_numeric",
    f"""WITH s AS (SELECT value AS x, ts >= {CUT} AS batch FROM events), e AS (SELECT list_sort(list_distinct(quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS ed FROM s WHERE NOT batch),
c AS (SELECT greatest(1, least(len(list_filter(ed, lambda v: v <= x)), len(ed) - 1)) AS bin, count(*) FILTER (NOT batch)::double AS t, count(*) FILTER (batch)::double AS b FROM s, e GROUP BY 1), n AS (SELECT *, sum(t) OVER () AS nt, sum(b) OVER () AS nb FROM c)
SELECT '' AS asset, 'value' AS feature, round({_PSI_TERMS}, 6) AS psi FROM n""",
)
def psi_numeric(spark, sf_dir):
    train, batch = _sides(spark, sf_dir)
    return r6(drift.numeric_psi(drift._long(train, batch, ["value"], None, False)), "psi")


@query(
    "psi_categorical",
    f"""WITH c AS (SELECT event_type, count(*) FILTER (ts < {CUT})::double AS t, count(*) FILTER (ts >= {CUT})::double AS b FROM events GROUP BY 1), n AS (SELECT *, sum(t) OVER () AS nt, sum(b) OVER () AS nb FROM c)
SELECT '' AS asset, 'event_type' AS feature, round({_PSI_TERMS}, 6) AS psi, count(*) FILTER (t > 0) AS n_categories FROM n""",
)
def psi_categorical(spark, sf_dir):
    train, batch = _sides(spark, sf_dir)
    return r6(drift.categorical_psi(drift._long(train, batch, ["event_type"], None, True)), "psi")


@query(
    "drift_pooled",
    f"""WITH s AS (SELECT value AS x, ts >= {CUT} AS batch FROM events) SELECT 'value' AS feature, round(avg(x) FILTER (NOT batch), 6) AS train_mean, round(avg(x) FILTER (batch), 6) AS batch_mean, round(abs(avg(x) FILTER (batch) - avg(x) FILTER (NOT batch)) / stddev_samp(x) FILTER (NOT batch), 6) AS drift_magnitude, round(stddev_samp(x) FILTER (batch) / stddev_samp(x) FILTER (NOT batch), 6) AS std_ratio FROM s""",
)
def drift_pooled(spark, sf_dir):
    train, batch = _sides(spark, sf_dir)
    return r6(drift.drift(train.select("value"), batch.select("value")).select("feature", "train_mean", "batch_mean", "drift_magnitude", "std_ratio"), "train_mean", "batch_mean", "drift_magnitude", "std_ratio")


@query(
    "drift_by_asset",
    f"""WITH s AS (SELECT user_id, value AS x, ts >= {CUT} AS batch FROM events), g AS (SELECT user_id, count(*) FILTER (NOT batch) AS nt, count(*) FILTER (batch) AS nb, avg(x) FILTER (NOT batch) AS mt, avg(x) FILTER (batch) AS mb, stddev_samp(x) FILTER (NOT batch) AS st FROM s GROUP BY 1)
SELECT user_id::varchar AS asset, round(greatest(0.2, 3 * sqrt(1.0 / nb + 1.0 / nt)), 6) AS threshold, least(10, greatest(2, nb // 10))::int AS bins, round(abs(mb - mt) / st, 6) AS drift_magnitude, abs(mb - mt) / st > greatest(0.2, 3 * sqrt(1.0 / nb + 1.0 / nt)) AS shifted FROM g WHERE nt >= 30 AND nb >= 30""",
)
def drift_by_asset(spark, sf_dir):
    train, batch = _sides(spark, sf_dir)
    train, batch = train.select("user_id", "value"), batch.select("user_id", "value")
    status = drift.assets(train, batch, "user_id").where("status = 'checked'")
    found = drift.asset_drift(train, batch, "user_id").join(status.select("asset", "threshold", "bins"), "asset")
    return r6(found.select("asset", "threshold", "bins", "drift_magnitude", (F.col("drift_magnitude") > F.col("threshold")).alias("shifted")), "threshold", "drift_magnitude")


@query("drift_asset_status", f"WITH g AS (SELECT user_id, count(*) FILTER (ts < {CUT}) AS nt, count(*) FILTER (ts >= {CUT}) AS nb FROM events GROUP BY 1) SELECT user_id::varchar AS asset, CASE WHEN nb = 0 THEN 'missing_from_batch' WHEN nt = 0 THEN 'unknown_asset' WHEN least(nt, nb) < 30 THEN 'insufficient_data' ELSE 'checked' END AS status FROM g")
def drift_asset_status(spark, sf_dir):
    return drift.assets(*_sides(spark, sf_dir), "user_id").select("asset", "status")


# ------------------------------------------------------------------ process quality


@query(
    "capability",
    BASELINE
    + """, s AS (SELECT user_id, count(*) AS n_points, avg(value) AS mean, any_value(sigma) AS w, stddev_samp(value) AS o, skewness(value) AS skewness, kurtosis(value) AS excess_kurtosis FROM z GROUP BY 1)
SELECT user_id, n_points, round(mean, 6) AS mean, round(w, 6) AS sigma_within, round(o, 6) AS sigma_overall, round(200 / (6 * w), 6) AS cp, round(least((200 - mean) / (3 * w), mean / (3 * w)), 6) AS cpk, round(200 / (6 * o), 6) AS pp, round(least((200 - mean) / (3 * o), mean / (3 * o)), 6) AS ppk, round(o / w, 6) AS sigma_ratio, round(skewness, 6) AS skewness, round(excess_kurtosis, 6) AS excess_kurtosis FROM s""",
)
def capability(spark, sf_dir):
    names = ["mean", "sigma_within", "sigma_overall", "cp", "cpk", "pp", "ppk", "sigma_ratio", "skewness", "excess_kurtosis"]
    return r6(quality.capability(table(spark, sf_dir, "events"), "value", ORDER, "user_id", 200.0, 0.0).select("user_id", "n_points", *names), *names)


def _study(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    # an order key and line number may repeat; with the quantity the order is total in all that the study takes, whatever the join's plan
    order = F.row_number().over(split.Window.partitionBy("p_brand", "l_returnflag").orderBy("l_orderkey", "l_linenumber", "l_quantity"))
    return lines.withColumn("k", order).where("k <= 3").select("p_brand", "l_returnflag", "l_quantity")


@query(
    "gauge_rr_components",
    """WITH q AS (SELECT p_brand AS p, l_returnflag AS o, l_quantity AS y FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, l_returnflag ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE k <= 3),
g AS (SELECT p, o, grouping(p, o) AS g, count(*) AS n, avg(y) AS m FROM q GROUP BY GROUPING SETS ((p, o), (p), (o), ())), w AS (SELECT avg(y) AS mean, count(*) AS total, var_pop(y) * count(*) AS ss FROM q)
SELECT total, round(ss, 4) AS ss_total, round(sum(n * (m - mean) * (m - mean)) FILTER (g = 1), 4) AS ss_parts, round(sum(n * (m - mean) * (m - mean)) FILTER (g = 2), 4) AS ss_operators, round(sum(n * (m - mean) * (m - mean)) FILTER (g = 0), 4) AS ss_cells, count(*) FILTER (g = 1) AS parts, count(*) FILTER (g = 2) AS operators, count(*) FILTER (g = 0) AS cells FROM g, w GROUP BY total, ss""",
)
def gauge_rr_components(spark, sf_dir):
    s = quality.gauge_sums(_study(spark, sf_dir), "p_brand", "l_returnflag", "l_quantity")
    return s.select("total", *(F.round(c, 4).alias(c) for c in ("ss_total", "ss_parts", "ss_operators", "ss_cells")), *(F.col(c).cast("long").alias(c) for c in ("parts", "operators", "cells")))


# ------------------------------------------------------------------ splits

_H = "('0x' || substr(md5('42|' || {k}), 1, 8))::bigint"


@query("split_time", "WITH r AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k, count(*) OVER () AS n FROM events), c AS (SELECT min(ts) AS cut FROM r WHERE k = n - round_even(0.2 * n, 0)::bigint + 1) SELECT event_id, CASE WHEN ts >= cut THEN 'test' ELSE 'train' END AS part FROM events, c")
def split_time(spark, sf_dir):
    return split.with_parts(table(spark, sf_dir, "events"), "event_type", test_size=0.2, time_col="ts").select("event_id", "part")


@query("split_group", f"WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), o AS (SELECT user_id, coalesce(sum(n) OVER (ORDER BY {_H.format(k='user_id::varchar')}, user_id::varchar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY {_H.format(k='user_id::varchar')}, user_id::varchar) AS k, count(*) OVER () AS all_g, sum(n) OVER () AS total FROM g) SELECT event_id, CASE WHEN before < 0.2 * total - 1e-9 AND k < all_g THEN 'test' ELSE 'train' END AS part FROM events JOIN o USING (user_id)")
def split_group(spark, sf_dir):
    return split.with_parts(table(spark, sf_dir, "events"), "event_type", test_size=0.2, group_col="user_id").select("event_id", "part")


@query("split_random", f"WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_H.format(k='event_id::varchar')}, event_id::varchar) AS k FROM events), q AS (SELECT event_type, count(*) AS n, ceil(0.2 * sum(count(*)) OVER () - 1e-9) AS t, sum(count(*)) OVER () AS total FROM events GROUP BY 1), f AS (SELECT *, floor(t * n / total) AS base, t * n / total - floor(t * n / total) AS rest FROM q), a AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, event_type) <= t - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM f) SELECT event_id, CASE WHEN k <= quota THEN 'test' ELSE 'train' END AS part FROM r JOIN a USING (event_type)")
def split_random(spark, sf_dir):
    return split.random_split(table(spark, sf_dir, "events"), "event_type", 0.2, key=F.col("event_id").cast("string")).select("event_id", "part")


# ------------------------------------------------------------------ scores

SCORED = "(SELECT l.doc_id, quality AS y, least(1.0, d.n_chars / 3000.0)::double AS p FROM labels l JOIN documents d USING (doc_id))"


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 3000.0).alias("p"))
    return table(spark, sf_dir, "labels").select("doc_id", col("quality").alias("y")).join(docs, "doc_id")


_CALIBRATION = f"WITH b AS (SELECT len(list_filter([{', '.join(str(e) for e in metrics._edges(10))}]::double[], lambda e: e <= p))::int AS bin, count(*) AS count, avg(p) AS mean_predicted, avg(y) AS observed_rate, sum((p - y) * (p - y)) AS squares FROM {SCORED} s GROUP BY 1) "


@query("calibration_bins", _CALIBRATION + "SELECT bin, count, round(mean_predicted, 6) AS mean_predicted, round(observed_rate, 6) AS observed_rate, round(squares, 6) AS squares FROM b")
def calibration_bins(spark, sf_dir):
    names = ["mean_predicted", "observed_rate", "squares"]
    return r6(metrics.calibration_bins(_scored(spark, sf_dir), F.col("y"), F.col("p")).select("bin", "count", *names), *names)


@query("ece_brier", _CALIBRATION + "SELECT sum(count)::bigint AS n_rows, round(sum(count * observed_rate) / sum(count), 6) AS base_rate, round(sum(squares) / sum(count), 6) AS brier_score, round(sum(count * abs(mean_predicted - observed_rate)) / sum(count), 6) AS expected_calibration_error, round(max(abs(mean_predicted - observed_rate)), 6) AS max_calibration_error, round(1 - sum(squares) / sum(count) / (sum(count * observed_rate) / sum(count) * (1 - sum(count * observed_rate) / sum(count))), 6) AS brier_skill_score FROM b")
def ece_brier(spark, sf_dir):
    out = metrics.calibration_summary(metrics.calibration_bins(_scored(spark, sf_dir), F.col("y"), F.col("p")))
    return r6(out, *(c for c in out.columns if c != "n_rows"))


@query("threshold_sweep", f"WITH t AS (SELECT unnest([{', '.join(map(str, metrics.THRESHOLDS))}]::double[]) AS threshold), c AS (SELECT threshold, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y = 0 AND p >= threshold) AS fp, count(*) FILTER (y = 1 AND p < threshold) AS fn, count(*) FILTER (y = 0 AND p < threshold) AS tn FROM {SCORED} s, t GROUP BY 1) SELECT *, fn * 500.0::double + fp * 150.0::double + tp * 20.0::double AS cost FROM c")
def threshold_sweep(spark, sf_dir):
    return metrics.threshold_sweep(_scored(spark, sf_dir), F.col("y") == 1, F.col("p"))


@query("maintenance_sweep", f"WITH t AS (SELECT unnest([{', '.join(map(str, metrics.THRESHOLDS))}]::double[]) AS threshold), c AS (SELECT threshold, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y = 0 AND p >= threshold) AS fp, count(*) FILTER (y = 1 AND p < threshold) AS fn FROM {SCORED} s, t GROUP BY 1) SELECT threshold, fn * 50000.0::double + fp * 1500.0::double + tp * 9500.0::double AS cost FROM c")
def maintenance_sweep(spark, sf_dir):
    return metrics.maintenance_sweep(_scored(spark, sf_dir), F.col("y") == 1, F.col("p")).select("threshold", "cost")


@query("confusion", f"SELECT y::varchar AS label, (p >= 0.3)::int::varchar AS predicted, count(*) AS n FROM {SCORED} s GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir).withColumn("hat", (F.col("p") >= 0.3).cast("int")), "y", "hat")


@query("classification_metrics", f"WITH c AS (SELECT count(*) FILTER (y = 1 AND p >= 0.3) AS tp, count(*) FILTER (y = 0 AND p >= 0.3) AS fp, count(*) FILTER (y = 1 AND p < 0.3) AS fn, count(*) FILTER (y = 0 AND p < 0.3) AS tn FROM {SCORED} s) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0::double * tp / (2 * tp + fp + fn), 6) AS f1, round((tp * tn - fp * fn)::double / sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c")
def classification_metrics(spark, sf_dir):
    return r6(metrics.binary_scores(metrics.binary_counts(_scored(spark, sf_dir), F.col("y") == 1, F.col("p") >= 0.3)), "accuracy", "precision", "recall", "f1", "mcc")


@query("class_report", f"WITH c AS (SELECT y::varchar AS l, (p >= 0.3)::int::varchar AS h FROM {SCORED} s), k AS (SELECT unnest(['0', '1']) AS class), t AS (SELECT class, (SELECT count(*) FROM c WHERE l = class) AS s, (SELECT count(*) FROM c WHERE h = class) AS g, (SELECT count(*) FROM c WHERE l = class AND h = class) AS hit FROM k) SELECT class, round(hit / g, 6) AS precision, round(hit / s, 6) AS recall, round(2.0::double * hit / (s + g), 6) AS f1, s AS support FROM t")
def class_report(spark, sf_dir):
    pairs = metrics.confusion(_scored(spark, sf_dir).withColumn("hat", (F.col("p") >= 0.3).cast("int")), "y", "hat")
    return r6(metrics.class_scores(pairs), "precision", "recall", "f1")


@query(
    "ranking_metrics",
    f"""WITH g AS (SELECT p AS s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {SCORED} q GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM g)
SELECT round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS pr_auc, round(sum(pos) / (sum(pos) + sum(neg)), 6) AS base_rate FROM c""",
)
def ranking_metrics(spark, sf_dir):
    return r6(metrics.ranking(_scored(spark, sf_dir), F.col("y") == 1, F.col("p")), "roc_auc", "pr_auc", "base_rate")


@query("regression_metrics", "WITH s AS (SELECT l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem) SELECT count(*) AS n_rows, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(avg(abs((y - p) / y)) FILTER (y <> 0) * 100, 6) AS mape FROM s")
def regression_metrics(spark, sf_dir):
    out = metrics.regression_scores(table(spark, sf_dir, "lineitem"), number(table(spark, sf_dir, "lineitem"), "l_extendedprice"), F.col("l_quantity") * 1000)
    return r6(out, "r2", "mape").withColumns({c: F.round(c, 4) for c in ("rmse", "mae")})


# ------------------------------------------------------------------ models and attribution


@query(
    "prepared_features",
    """WITH s AS (SELECT event_id, value, event_type, ts FROM events), m AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM s), k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM s))
SELECT event_id, round((value - m) / s, 6) AS value, code::double AS event_type FROM s JOIN k USING (event_type), m""",
)
def prepared_features(spark, sf_dir):
    from millwright.ml import prepare

    events = table(spark, sf_dir, "events").select("event_id", "value", "event_type")
    plan = prepare.fit(events.drop("event_id"))
    return r6(prepare.transform(events, plan, keep=["event_id"]), "value")


@query("model_predictions")
def model_predictions(spark, sf_dir):
    """A quality model over documents' figures, tuned to cost, with its prediction for every labelled document."""
    from millwright.ml.engine import Engine

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.length("text").alias("length"), (F.length("text") - F.length(F.translate("text", "!", ""))).alias("marks"))
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id")
    engine = Engine(task="classification").fit(rows, "quality")
    engine.optimize_threshold(rows)
    return engine.predict(rows).select("doc_id", "quality", "prediction")
