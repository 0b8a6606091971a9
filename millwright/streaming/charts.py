"""Live charts: the same recursions as the batch charts, on streams with state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millwright.functions.constants import CUSUM_DECISION, CUSUM_SLACK, EWMA_LAMBDA, EWMA_SIGMAS, OEE_WORLD_CLASS
from millwright.operators import drift


def live_ewma(stream: DataFrame, asset_col: str, time_col: str, value_col: str, centre: float, sigma: float, weight=EWMA_LAMBDA, n_sigmas=EWMA_SIGMAS) -> DataFrame:
    """One row for each new reading of each asset, with its smoothed value and limits. A batch's readings are ordered by time; state holds the count and the last value."""
    kinds = dict(stream.dtypes)

    def step(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, z = state.get if state.exists else (0, centre)
        rows = pd.concat(list(batches)).sort_values(time_col, kind="stable")
        out = []
        for t, x in zip(rows[time_col], rows[value_col]):
            if pd.isna(x):
                continue
            n, z = n + 1, weight * float(x) + (1 - weight) * z
            half = n_sigmas * sigma * (weight / (2 - weight) * (1 - (1 - weight) ** (2 * n))) ** 0.5
            out.append((key[0], t, n - 1, z, centre + half, centre - half, sigma > 0 and abs(z - centre) > half))
        state.update((n, z))
        yield pd.DataFrame(out, columns=[asset_col, time_col, "idx", "stat", "ucl", "lcl", "violation"])

    schema = f"`{asset_col}` {kinds[asset_col]}, `{time_col}` {kinds[time_col]}, idx long, stat double, ucl double, lcl double, violation boolean"
    return stream.groupBy(asset_col).applyInPandasWithState(step, schema, "n long, z double", "append", GroupStateTimeout.NoTimeout)


def live_cusum(stream: DataFrame, asset_col: str, time_col: str, value_col: str, centre: float, sigma: float, slack_k=CUSUM_SLACK, decision_h=CUSUM_DECISION) -> DataFrame:
    """One row for each new reading with both one-sided sums.

    As in the batch chart, a sum is the running total less the least total so
    far; state holds both for each side. A sum reset step by step is rounded
    otherwise, and a reading that lies at the limit exactly would be judged by
    that rounding, not as the batch chart judges it.
    """
    kinds = dict(stream.dtypes)

    def step(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0.0, 0.0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values(time_col, kind="stable")
        rows = rows[rows[value_col].notna()]
        x = rows[value_col].to_numpy(float)
        sums, kept = [], []
        for change, total, least in ((x - centre - slack_k * sigma, *held[:2]), (centre - x - slack_k * sigma, *held[2:])):
            totals = np.cumsum(np.append(total, change))
            lows = np.minimum.accumulate(np.append(least, totals[1:]))
            sums.append((totals - lows)[1:])
            kept += [float(totals[-1]), float(lows[-1])]
        state.update(tuple(kept))
        high, low = sums
        yield pd.DataFrame({asset_col: key[0], time_col: rows[time_col].to_numpy(), "cusum_high": high, "cusum_low": low, "violation": (sigma > 0) & (np.maximum(high, low) > decision_h * sigma)}, columns=[asset_col, time_col, "cusum_high", "cusum_low", "violation"])

    schema = f"`{asset_col}` {kinds[asset_col]}, `{time_col}` {kinds[time_col]}, cusum_high double, cusum_low double, violation boolean"
    return stream.groupBy(asset_col).applyInPandasWithState(step, schema, "high double, least_high double, low double, least_low double", "append", GroupStateTimeout.NoTimeout)


def live_pareto(stream: DataFrame, time_col: str, category_col: str, shift: str = "8 hours", late: str = "1 hour") -> DataFrame:
    """Counts of each category and shift; what comes later than ``late`` is left out."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, shift), F.col(category_col)).agg(F.count("*").alias("n"))


def live_oee(stream: DataFrame, time_col: str, planned: str, run: str, cycle: str, total: str, good: str, shift: str = "8 hours", late: str = "1 hour") -> DataFrame:
    """Availability, performance, quality and OEE of each shift."""
    rows = stream.withWatermark(time_col, late).groupBy(F.window(time_col, shift)).agg(*(F.sum(c).alias(c) for c in (planned, run, total, good)), F.avg(cycle).alias(cycle))
    ratio = lambda a, b: F.try_divide(a, b)
    a, p, q = ratio(F.col(run), F.col(planned)), ratio(F.col(cycle) * F.col(total), F.col(run)), ratio(F.col(good), F.col(total))
    return rows.withColumns({"availability": a, "performance": p, "quality": q}).withColumn("oee", F.col("availability") * F.col("performance") * F.col("quality")).withColumn("meets_world_class", F.col("oee") >= OEE_WORLD_CLASS)


def drift_sink(train: DataFrame, report, **options):
    """A function for foreachBatch that checks each micro-batch against the training data and hands the report on."""

    def check(batch: DataFrame, epoch: int) -> None:
        report(epoch, drift.check_data_drift(train, batch, **options))

    return check
