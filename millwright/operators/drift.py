"""Drift between training data and a batch: pooled and by asset, over numbers and categories.

Both sides become one long table (side, asset, feature, value), so one
aggregate serves the moments of all features, one the bin edges and one the
bin counts. Assets are grouped by Spark; nothing loops over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.columns import col, finite, is_numeric, number
from millwright.functions.constants import DRIFT_MIN_ROWS, DRIFT_SIGMAS, PSI_BINS, PSI_CATEGORIES, PSI_EPSILON, PSI_MAJOR
from millwright.functions.ordered import quantiles
from millwright.functions.report import as_error, finite_number, require, to_jsonable

KEYS = ["asset", "feature"]


def _long(train: DataFrame, batch: DataFrame, features: Sequence[str], asset_col: str | None, text: bool) -> DataFrame:
    def side(df: DataFrame, batch_side: bool) -> DataFrame:
        value = (lambda c: col(c).cast("string")) if text else (lambda c: finite(number(df, c)))
        cells = F.array(*(F.struct(F.lit(c).alias("feature"), value(c).alias("x")) for c in features))
        asset = col(asset_col).cast("string") if asset_col else F.lit("")
        return df.select(F.lit(batch_side).alias("batch"), asset.alias("asset"), F.inline(cells)).where("x is not null and asset is not null")

    return side(train, False).unionByName(side(batch, True))


def _psi(train_share: Column, batch_share: Column) -> Column:
    t, b = (F.when(s > 0, s).otherwise(PSI_EPSILON) for s in (train_share, batch_share))
    return (b - t) * F.log(b / t)


def numeric_psi(cells: DataFrame, bins: DataFrame | int = PSI_BINS) -> DataFrame:
    """(asset, feature, psi): edges are distinct quantiles of the training side, batch values are clipped into them.

    ``bins`` may be a table (asset, bins) of numbers up to PSI_BINS. A training
    side with fewer values than bins, or fewer than three distinct values or
    edges, has none.
    """
    train = cells.where("not batch")
    per_asset = isinstance(bins, DataFrame)
    if per_asset:
        train = train.join(bins, "asset")
    n = F.col("bins") if per_asset else F.lit(bins)
    # one set of quantiles serves every number of bins
    sizes = sorted({*range(2, PSI_BINS + 1)} if per_asset else {bins})
    fractions = sorted({i / k for k in sizes for i in range(k + 1)})
    mine = F.create_map(*(x for k in sizes for x in (F.lit(k), F.array(*(F.col("q")[fractions.index(i / k)] for i in range(k + 1))))))
    keys = [*KEYS, *["bins"] * per_asset]
    distinct = train.groupBy(*keys, "x").agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count("*").alias("distinct"))
    edges = quantiles(train, "x", fractions, keys).join(distinct, keys).withColumn("edges", F.array_sort(F.array_distinct(F.element_at(mine, n))))
    edges = edges.where((F.col("n") >= n) & (F.col("distinct") >= 3) & (F.size("edges") >= 3)).select(*KEYS, "edges")
    at = F.greatest(F.lit(1), F.least(F.size(F.filter("edges", lambda e: e <= F.col("x"))), F.size("edges") - 1))
    counts = cells.join(edges, KEYS).groupBy(*KEYS, at.alias("bin")).agg(F.sum(F.when(~F.col("batch"), 1).otherwise(0)).alias("t"), F.sum(F.when(F.col("batch"), 1).otherwise(0)).alias("b"))
    grid = edges.select(*KEYS, F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin"))
    return _summed(grid.join(counts, [*KEYS, "bin"], "left"))


def _summed(counts: DataFrame) -> DataFrame:
    """PSI of each feature from counts t and b by bin or category; none if either side is empty."""
    listed = counts.groupBy(*KEYS).agg(F.collect_list(F.struct(F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("b", F.lit(0)).alias("b"))).alias("c"))
    total = lambda k: F.aggregate("c", F.lit(0).cast("long"), lambda a, e: a + e[k])
    listed = listed.withColumns({"nt": total("t"), "nb": total("b")}).where("nt > 0 and nb > 0")
    terms = F.transform("c", lambda e: _psi(e["t"] / F.col("nt"), e["b"] / F.col("nb")))
    return listed.select(*KEYS, F.aggregate(F.array_sort(terms), F.lit(0.0), lambda a, x: a + x).alias("psi"))


def categorical_psi(cells: DataFrame, max_categories: int = PSI_CATEGORIES) -> DataFrame:
    """(asset, feature, psi, n_categories), none with fewer than two training categories or more than ``max_categories``."""
    counts = cells.groupBy(*KEYS, "x").agg(F.sum(F.when(~F.col("batch"), 1).otherwise(0)).alias("t"), F.sum(F.when(F.col("batch"), 1).otherwise(0)).alias("b"))
    fits = counts.groupBy(*KEYS).agg(F.sum((F.col("t") > 0).cast("int")).alias("n_categories"), F.count("*").alias("all")).where(f"n_categories >= 2 and all <= {max_categories}")
    return _summed(counts.join(fits, KEYS, "left_semi")).join(fits.select(*KEYS, "n_categories"), KEYS)


def _features(train: DataFrame, skip: set[str]) -> tuple[list[str], list[str]]:
    names = [c for c in train.columns if c not in skip]
    return [c for c in names if is_numeric(train, c)], [c for c in names if not is_numeric(train, c)]


def moments(cells: DataFrame) -> DataFrame:
    on = lambda f, batch: f(F.when(F.col("batch") == batch, F.col("x")))
    return cells.groupBy(*KEYS).agg(
        on(F.count, False).alias("n_train"), on(F.count, True).alias("n_batch"), on(F.avg, False).alias("train_mean"), on(F.avg, True).alias("batch_mean"),
        on(F.stddev_samp, False).alias("train_std"), on(F.stddev_samp, True).alias("batch_std"),
    )


def _judged(train, batch, numeric, text, asset_col, assets: DataFrame | None, threshold, gate, bins) -> DataFrame:
    """One row for each asset and feature that both sides have, with what makes it drift and why it is skipped."""
    thr = F.col("threshold") if assets is not None else F.lit(float(threshold))
    out = None
    if numeric:
        cells = _long(train, batch, numeric, asset_col, False)
        if assets is not None:
            cells = cells.join(assets.select("asset"), "asset", "left_semi")
        rows = moments(cells).join(numeric_psi(cells, assets.select("asset", "bins") if assets is not None else bins), KEYS, "left")
        if assets is not None:
            rows = rows.join(assets.select("asset", "threshold"), "asset")
        scale = F.when(F.col("train_std") > 1e-6, F.col("train_std")).when(F.abs("train_mean") > 1e-6, F.abs("train_mean")).otherwise(1.0)
        shift = F.abs(F.col("batch_mean") - F.col("train_mean")) / scale
        usable = (F.col("n_train") > 0) & (F.col("n_batch") > 0) & (F.col("n_train") >= gate) & (F.col("n_batch") >= gate)
        psi = F.when(usable, F.col("psi"))
        out = rows.select(
            *KEYS, F.lit("numeric").alias("kind"), "n_train", "n_batch", "train_mean", "batch_mean", F.when(usable, shift).alias("drift_magnitude"), psi.alias("psi"),
            F.when(F.col("train_std") > 1e-6, F.col("batch_std") / F.col("train_std")).alias("std_ratio"), F.lit(None).cast("int").alias("n_categories"),
            F.when(usable & (shift > thr), "mean_shift").when(psi > PSI_MAJOR, "psi_shift").alias("trigger"),
            F.when((F.col("n_train") == 0) | (F.col("n_batch") == 0), "no usable numeric readings").when(~usable, "too few readings").alias("skipped"),
        )
    if text:
        cells = _long(train, batch, text, asset_col, True)
        if assets is not None:
            cells = cells.join(assets.select("asset"), "asset", "left_semi")
        counts = cells.groupBy(*KEYS).agg(F.sum((~F.col("batch")).cast("long")).alias("n_train"), F.sum(F.col("batch").cast("long")).alias("n_batch"))
        rows = counts.join(categorical_psi(cells), KEYS, "left")
        usable = (F.col("n_train") >= gate) & (F.col("n_batch") >= gate)
        psi, no = F.when(usable, F.col("psi")), F.lit(None).cast("double")
        part = rows.select(
            *KEYS, F.lit("categorical").alias("kind"), "n_train", "n_batch", no.alias("train_mean"), no.alias("batch_mean"), no.alias("drift_magnitude"), psi.alias("psi"), no.alias("std_ratio"), F.col("n_categories").cast("int").alias("n_categories"),
            F.when(psi > PSI_MAJOR, "psi_shift").alias("trigger"), F.when(~usable, "too few readings").when(psi.isNull(), "not usable as a category").alias("skipped"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def drift(train: DataFrame, batch: DataFrame, threshold: float = 0.2, min_rows: int = 0, psi_bins: int = PSI_BINS, include_categorical: bool = False) -> DataFrame:
    """One row for each feature of the pooled data (asset is empty)."""
    numeric, text = _features(train, set(train.columns) - set(batch.columns))
    return _judged(train, batch, numeric, text if include_categorical else [], None, None, threshold, max(0, int(min_rows)), psi_bins)


def assets(train: DataFrame, batch: DataFrame, asset_col: str, threshold: float = 0.2, min_rows: int = DRIFT_MIN_ROWS, n_sigma_floor: float = DRIFT_SIGMAS) -> DataFrame:
    """Status of every asset of either side, with its rows, noise-floor threshold and number of bins."""
    count = lambda df, name: df.where(col(asset_col).isNotNull()).groupBy(col(asset_col).cast("string").alias("asset")).agg(F.count("*").alias(name))
    both = count(train, "rows_train").join(count(batch, "rows_batch"), "asset", "full_outer")
    gate = max(1, int(min_rows))
    status = F.when(F.col("rows_batch").isNull(), "missing_from_batch").when(F.col("rows_train").isNull(), "unknown_asset").when(F.least("rows_train", "rows_batch") < gate, "insufficient_data").otherwise("checked")
    floor = n_sigma_floor * F.sqrt(1 / F.col("rows_batch") + 1 / F.col("rows_train"))
    checked = lambda c: F.when(F.col("status") == "checked", c)
    return both.withColumn("status", status).withColumns({"threshold": checked(F.greatest(F.lit(float(threshold)), floor)), "bins": checked(F.least(F.lit(PSI_BINS), F.greatest(F.lit(2), F.floor(F.col("rows_batch") / 10).cast("int"))))})


def asset_drift(train: DataFrame, batch: DataFrame, asset_col: str, threshold=0.2, min_rows=DRIFT_MIN_ROWS, n_sigma_floor=DRIFT_SIGMAS, include_categorical=True) -> DataFrame:
    """One row for each checked asset and feature."""
    known = assets(train, batch, asset_col, threshold, min_rows, n_sigma_floor).where("status = 'checked'").select("asset", "threshold", "bins")
    numeric, text = _features(train, {asset_col, *(set(train.columns) - set(batch.columns))})
    return _judged(train, batch, numeric, text if include_categorical else [], asset_col, known, threshold, max(1, int(min_rows)), None)


def _entry(r: dict) -> dict:
    keep = ("kind", "train_mean", "batch_mean", "drift_magnitude", "psi", "std_ratio", "trigger") if r["kind"] == "numeric" else ("kind", "psi", "n_categories", "trigger")
    out = {k: r[k] for k in keep}
    return out | ({"drift_%": r["drift_magnitude"] * 100} if r["kind"] == "numeric" else {})


def _folded(rows: list[dict], names: Sequence[str], missing: Sequence[str], gate: int) -> dict:
    found = {r["feature"]: r for r in rows}
    why = lambda r: f"{r['n_batch']} batch / {r['n_train']} train readings, below min_rows={gate}" if r["skipped"] == "too few readings" else r["skipped"]
    skipped = {c: "missing from the batch" for c in missing} | {c: why(found[c]) if c in found else "no usable readings" for c in names if c not in found or found[c]["skipped"]}
    drifted = {c: _entry(found[c]) for c in names if c in found and found[c]["trigger"]}
    return {"drift_detected": bool(drifted), "drifted_features": drifted, "skipped_features": skipped, "max_psi": max((r["psi"] for r in rows if r["psi"] is not None), default=None)}


def calculate_psi(train: DataFrame, batch: DataFrame, column: str, n_bins: int = PSI_BINS) -> float | None:
    rows = numeric_psi(_long(train, batch, [column], None, False), n_bins).collect()
    return rows[0]["psi"] if rows else None


def calculate_categorical_psi(train: DataFrame, batch: DataFrame, column: str, max_categories: int = PSI_CATEGORIES) -> float | None:
    rows = categorical_psi(_long(train, batch, [column], None, True), max_categories).collect()
    return rows[0]["psi"] if rows else None


def check_data_drift(train: DataFrame, batch: DataFrame, threshold_pct=0.2, min_rows=0, psi_bins=PSI_BINS, include_categorical=False) -> dict:
    none = {"drift_detected": False, "drifted_features": {}, "skipped_features": {}}
    if not isinstance(train, DataFrame) or not isinstance(batch, DataFrame) or not train.take(1) or not batch.take(1):
        return none | {"error": "Empty or missing dataset."}
    numeric, text = _features(train, set())
    names = numeric + (text if include_categorical else [])
    missing = [c for c in names if c not in batch.columns]
    judged = drift(train, batch, threshold_pct, min_rows, psi_bins, include_categorical)
    rows = [r.asDict() for r in judged.collect()] if judged is not None else []
    return to_jsonable(_folded(rows, [c for c in names if c not in missing], missing, max(0, int(min_rows))))


def check_asset_drift(train: DataFrame, batch: DataFrame, asset_col: str, threshold_pct=0.2, min_rows=DRIFT_MIN_ROWS, n_sigma_floor=DRIFT_SIGMAS, include_categorical=True) -> dict:
    none = {"drift_detected": False, "per_asset": {}, "assets_drifted": [], "assets_skipped": {}}

    @as_error
    def run() -> dict:
        require(train, "train", asset_col)
        require(batch, "batch", asset_col)
        floor = finite_number(n_sigma_floor, "n_sigma_floor")
        if floor < 0:
            raise ValueError(f"n_sigma_floor must be a finite non-negative number, got {n_sigma_floor!r}.")
        gate = max(1, int(min_rows))
        status = assets(train, batch, asset_col, threshold_pct, gate, floor).orderBy("asset").collect()
        if not status:
            raise ValueError("Empty or missing dataset.")
        judged = asset_drift(train, batch, asset_col, threshold_pct, gate, floor, include_categorical)
        rows: dict[str, list[dict]] = {}
        for r in judged.collect() if judged is not None else []:
            rows.setdefault(r["asset"], []).append(r.asDict())
        numeric, text = _features(train, {asset_col})
        names = numeric + (text if include_categorical else [])
        missing = [c for c in names if c not in batch.columns]
        per_asset, skipped = {}, {}
        why = {"missing_from_batch": "in the training data but not in this batch", "unknown_asset": "not in the training data"}
        for s in status:
            entry = {"status": s["status"]} | {k: s[k] for k in ("rows_train", "rows_batch") if s[k] is not None}
            if s["status"] == "checked":
                entry |= {"effective_threshold": s["threshold"], "psi_bins": s["bins"]} | _folded(rows.get(s["asset"], []), [c for c in names if c not in missing], missing, gate)
            else:
                skipped[s["asset"]] = why.get(s["status"]) or f"{s['rows_batch']} batch / {s['rows_train']} train rows, below min_rows={gate}"
            per_asset[s["asset"]] = entry
        drifted = sorted(a for a, e in per_asset.items() if e.get("drift_detected"))
        return to_jsonable({"asset_col": asset_col, "assets_checked": sum(e["status"] == "checked" for e in per_asset.values()), "assets_drifted": drifted, "assets_skipped": skipped, "drift_detected": bool(drifted), "per_asset": per_asset})

    found = run()
    return none | found if "error" in found else found
