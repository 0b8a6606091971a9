"""Data quality, outliers, placeholders, correlations and the task a target suggests.

Every figure of every column comes from a few wide aggregates; only those
figures reach the driver.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.columns import col, correlation, divide, finite, is_numeric, is_text, is_time, number
from millwright.functions.constants import IMBALANCE, MODIFIED_Z, QUALITY_READY, QUALITY_USABLE, QUALITY_WEIGHTS, SENTINELS, SILENT_NULLS
from millwright.functions.ordered import cuts, part_of, quantiles, running
from millwright.functions.report import as_error, require, to_jsonable


def distinct_names(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The frame with the first column of each name, and the names that occur more than once."""
    seen: dict[str, int] = {}
    for c in df.columns:
        seen[c] = seen.get(c, 0) + 1
    again = [c for c, n in seen.items() if n > 1]
    if not again:
        return df, []
    numbered = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    first = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    return numbered.select(*(F.col(f"c{first[c]}").alias(c) for c in seen)), again


def _token(name: str) -> Column:
    return F.lower(F.regexp_replace(col(name), r"^\s+|\s+$", ""))


def placeholders(df: DataFrame) -> DataFrame:
    """(column, kind, token, n) of placeholder texts and numeric sentinels, in one pass over all columns."""
    kinds = []
    for c in df.columns:
        if is_text(df, c):
            kinds.append(F.struct(F.lit(c).alias("column"), F.lit("placeholder_string").alias("kind"), F.when(_token(c).isin(*SILENT_NULLS), _token(c)).alias("token")))
        elif is_numeric(df, c):
            x = col(c).cast("double")
            kinds.append(F.struct(F.lit(c).alias("column"), F.lit("numeric_sentinel").alias("kind"), F.when(x.isin(*SENTINELS), x.cast("string")).alias("token")))
    if not kinds:
        return df.sparkSession.createDataFrame([], "column string, kind string, token string, n long")
    return df.select(F.inline(F.array(*kinds))).where("token is not null").groupBy("column", "kind", "token").agg(F.count("*").alias("n"))


def detect_silent_nulls(df: DataFrame) -> dict:
    @as_error
    def run() -> dict:
        require(df, "df")
        frame, _ = distinct_names(df)
        rows = placeholders(frame).orderBy(F.desc("n"), "token").collect()
        total = frame.count() if rows else 0
        out: dict = {}
        for c in frame.columns:
            if mine := [r for r in rows if r["column"] == c]:
                n = sum(r["n"] for r in mine)
                out[c] = {"count": n, "ratio": n / total, "tokens": {r["token"]: r["n"] for r in mine}, "kind": mine[0]["kind"]}
        return out

    return run()


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), finite(number(df, c)).alias("x")) for c in columns)))).where("x is not null")


def outliers_modified_z(df: DataFrame, columns: Sequence[str], threshold: float = MODIFIED_Z) -> DataFrame:
    """One row for each column: outliers by the modified z-score. Without median deviation the mean deviation scales the score."""
    cells = _cells(df, columns)
    middle = quantiles(cells, "x", (0.5,), ("column",)).select("column", "n", F.col("q")[0].alias("median"))
    apart = cells.join(F.broadcast(middle), "column").withColumn("_d", F.abs(F.col("x") - F.col("median")))
    mad = quantiles(apart, "_d", (0.5,), ("column",)).select("column", F.col("q")[0].alias("mad"))
    spread = apart.groupBy("column", "n", "median").agg(F.avg("_d").alias("mean_ad")).join(mad, "column").where("n >= 3 and mean_ad > 0")
    score = F.when(F.col("mad") > 0, 0.6745 * (F.col("x") - F.col("median")) / F.col("mad")).otherwise((F.col("x") - F.col("median")) / (1.253314 * F.col("mean_ad")))
    scored = cells.join(F.broadcast(spread), "column").withColumn("_out", F.abs(score) > threshold)
    flagged = F.when(F.col("_out"), F.col("x"))
    # the number of columns bounds both broadcasts
    return scored.groupBy("column", "n", "median", "mad").agg(F.count(flagged).alias("count"), F.min(flagged).alias("flagged_min"), F.max(flagged).alias("flagged_max")).where("count > 0")


def outliers_iqr(df: DataFrame, columns: Sequence[str], threshold: float = 1.5) -> DataFrame:
    cells = _cells(df, columns)
    q = quantiles(cells, "x", (0.25, 0.75), ("column",))
    q = q.select("column", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")).where("n >= 3 and q3 > q1")
    fences = q.select("column", "n", (F.col("q1") - threshold * (F.col("q3") - F.col("q1"))).alias("flagged_min"), (F.col("q3") + threshold * (F.col("q3") - F.col("q1"))).alias("flagged_max"))
    out = (F.col("x") < F.col("flagged_min")) | (F.col("x") > F.col("flagged_max"))
    return cells.join(F.broadcast(fences), "column").groupBy("column", "n", "flagged_min", "flagged_max").agg(F.sum(out.cast("long")).alias("count")).where("count > 0")


def detect_outliers(df: DataFrame, method: str = "modified_zscore", threshold: float | None = None) -> dict:
    @as_error
    def run() -> dict:
        require(df, "df")
        frame, _ = distinct_names(df)
        columns = [c for c in frame.columns if is_numeric(frame, c)]
        if not columns:
            return {}
        limit = (1.5 if method == "iqr" else MODIFIED_Z) if threshold is None else float(threshold)
        found = {r["column"]: r for r in (outliers_iqr if method == "iqr" else outliers_modified_z)(frame, columns, limit).collect()}
        return to_jsonable({c: {"count": found[c]["count"], "ratio": found[c]["count"] / found[c]["n"], "method": method, "threshold": limit, "flagged_min": found[c]["flagged_min"], "flagged_max": found[c]["flagged_max"]} for c in columns if c in found})

    return run()


def duplicate_rows(df: DataFrame) -> DataFrame:
    """total, distinct and duplicates in one row; nulls are equal to each other."""
    one = df.groupBy(*(col(c) for c in df.columns)).agg(F.count("*").alias("_n"))
    return one.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).withColumn("duplicates", F.col("total") - F.col("distinct"))


def column_facts(df: DataFrame, as_of: datetime.datetime | None = None) -> DataFrame:
    """One wide row: rows, and for each column its nulls, numbers in a text, and times outside 1970 to ``as_of``."""
    now = F.lit(as_of) if as_of else F.current_timestamp()
    facts = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        null = col(c).isNull() | F.isnan(col(c).cast("double")) if is_numeric(df, c) else col(c).isNull()
        facts.append(F.sum(null.cast("long")).alias(f"null_{i}"))
        if is_text(df, c):
            facts.append(F.count(number(df, c)).alias(f"number_{i}"))
        if is_time(df, c) or (is_text(df, c) and ("date" in c.lower() or "time" in c.lower())):
            t = F.expr(f"try_cast(`{c}` as timestamp)") if is_text(df, c) else col(c).cast("timestamp")
            facts += [F.count(t).alias(f"time_{i}"), F.sum(((t > now) | (t < F.lit("1970-01-01").cast("timestamp"))).cast("long")).alias(f"late_{i}")]
    return df.agg(*facts)


#: Share of missing cells of a column below which a severity holds, and what to do about it.
_MISSING = ((0.01, "low", "Drop these rows or impute."), (0.1, "medium", "Impute and keep an indicator of what was missing."), (0.3, "high", "Impute with care and look for the cause upstream."), (math.inf, "critical", "Do not impute; review or drop the column."))
_RANK = ("critical", "high", "medium", "low")


def audit_data_quality(df: DataFrame, target_col: str | None = None, as_of: datetime.datetime | None = None) -> dict:
    """Five dimensions, their weighted score and grade, the issues by severity and what to do first. ``as_of`` stands for now."""

    @as_error
    def run() -> dict:
        require(df, "df")
        frame, repeated = distinct_names(df)
        facts = column_facts(frame, as_of).first()
        n, names = facts["rows"], frame.columns
        if not n or not names:
            raise ValueError("Dataset is empty.")
        silent, outliers, doubled = detect_silent_nulls(frame), detect_outliers(frame), duplicate_rows(frame).first()["duplicates"]
        issues: list[dict] = []
        issue = lambda dimension, severity, column, detail, action: issues.append({"dimension": dimension, "severity": severity, "column": column, "detail": detail, "action": action})
        nulls = {c: facts[f"null_{i}"] or 0 for i, c in enumerate(names)}
        for c in names:
            share = (nulls[c] + silent.get(c, {}).get("count", 0)) / n
            if share:
                _, severity, action = next(x for x in _MISSING if share < x[0])
                issue("completeness", severity, c, f"{share:.1%} missing", action)
        for c, found in silent.items():
            issue("completeness", "high", c, f"Placeholders: {', '.join(map(repr, found['tokens']))}", "Turn these placeholders into nulls.")
        mixed = 0
        for i, c in enumerate(names):
            known = n - nulls[c]
            if is_text(frame, c) and known and 0 < facts[f"number_{i}"] < known:
                mixed += 1
                issue("consistency", "medium", c, f"{facts[f'number_{i}'] / known:.1%} of the texts are numbers", "Bring the column to one type.")
        numeric = sum(n - nulls[c] for c in names if is_numeric(frame, c))
        for c, found in outliers.items():
            if found["ratio"] > 0.05:
                issue("validity", "medium", c, f"{found['ratio']:.1%} of the values are outliers", "Ask whether these are sensor faults or real extremes.")
        if doubled:
            issue("uniqueness", "high" if doubled / n > 0.05 else "medium", None, f"{doubled} duplicate rows ({doubled / n:.1%})", "Agree on a key and remove duplicates.")
        if repeated:
            issue("uniqueness", "high", None, f"Repeated column names: {', '.join(repeated)}", "Rename or drop them.")
        timed, late = 0, 0
        has_time = False
        for i, c in enumerate(names):
            if f"time_{i}" not in facts.asDict() or (is_text(frame, c) and not facts[f"time_{i}"] > 0.8 * (n - nulls[c])):
                continue
            has_time = True
            timed, late = timed + facts[f"time_{i}"], late + (facts[f"late_{i}"] or 0)
            if facts[f"late_{i}"]:
                issue("timeliness", "high", c, f"{facts[f'late_{i}']} times outside the plausible range", "Check clocks and time zones.")
        share = lambda part, of: 100 * (1 - min(1.0, part / of)) if of else 100.0
        scores = {
            "completeness": share(sum(nulls.values()) + sum(x["count"] for x in silent.values()), n * len(names)),
            "consistency": share(mixed, len(names)),
            "validity": share(sum(x["count"] for x in outliers.values()), numeric),
            "uniqueness": share(doubled, n),
        } | ({"timeliness": share(late, timed)} if has_time else {})
        whole = sum(QUALITY_WEIGHTS[k] for k in scores)
        weights = {k: QUALITY_WEIGHTS[k] / whole for k in scores}
        score = round(sum(scores[k] * weights[k] for k in scores), 1)
        grade = "production_ready" if score >= QUALITY_READY else "usable_with_caveats" if score >= QUALITY_USABLE else "remediation_required"
        if target_col in names and nulls[target_col]:
            issue("completeness", "critical", target_col, f"{nulls[target_col]} missing target values", "Drop these rows; nothing can be learned from them.")
        issues.sort(key=lambda x: _RANK.index(x["severity"]))
        todo = list(dict.fromkeys(f"[{x['severity'].upper()}] {x['column'] or 'dataset'}: {x['action']}" for x in issues))[:10]
        return to_jsonable(
            {
                "dqs": score, "grade": grade, "verdict": f"Score {score} of 100: {grade.replace('_', ' ')}.", "total_rows": n, "total_columns": len(df.columns),
                "dimensions": {k: {"score": round(scores[k], 1), "weight": weights[k]} for k in scores}, "silent_nulls": silent, "outliers": outliers, "duplicate_rows": doubled, "issues": issues, "remediation": todo,
            }
        )

    return run()


def target_facts(df: DataFrame, target: str) -> DataFrame:
    """One row: known values, distinct values, numbers, distinct numbers, and the share of the rarest value."""
    counts = df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("v"), number(df, target).alias("x")).agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("known"), F.count_distinct("v").alias("values"), F.sum(F.when(F.col("x").isNotNull(), F.col("n"))).alias("numbers"), F.count_distinct("x").alias("distinct_numbers"), (F.min("n") / F.sum("n")).alias("rarest"))


def inspect_data(df: DataFrame, target_col: str) -> dict:
    """Rows, missing cells and the task and metric that the target suggests, with the quality score."""

    @as_error
    def run() -> dict:
        require(df, "df")
        frame, _ = distinct_names(df)
        if target_col not in frame.columns:
            raise ValueError(f"Target column '{target_col}' not found in the dataset.")
        audit = audit_data_quality(frame, target_col)
        if "error" in audit:
            return audit
        facts = target_facts(frame, target_col).first()
        if not facts["known"]:
            raise ValueError(f"Target column '{target_col}' holds no values.")
        missing = sum(v or 0 for k, v in column_facts(frame).first().asDict().items() if k.startswith("null_"))
        numeric = is_numeric(frame, target_col) or facts["numbers"] == facts["known"]
        unique = facts["distinct_numbers"] if numeric else facts["values"]
        if facts["values"] <= 1:
            task, metric, message = "invalid", "none", "The target has one value; two classes at least are needed."
        elif unique == 2:
            task, metric, message = "classification", "f1", f"Binary classification, {'imbalanced' if facts['rarest'] < IMBALANCE else 'balanced'}."
        elif not numeric or unique <= 10:
            task, metric, message = "classification", "macro_f1", "Classification with several classes."
        else:
            task, metric, message = "regression", "r2", "Regression."
        return {
            "total_rows": audit["total_rows"], "total_columns": len(df.columns), "missing_values": missing, "recommended_task": task, "recommended_metric": metric, "message": message,
            "data_quality": {"dqs": audit["dqs"], "grade": audit["grade"], "top_issues": audit["remediation"][:3]},
        }

    return run()


# ------------------------------------------------------------------ correlations


def _pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def _pair_rows(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, x, y) of pairs of columns, rows with both values known."""
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), number(df, a).alias("x"), number(df, b).alias("y")) for a, b in pairs))
    return df.select(F.inline(cells)).where("x is not null and y is not null")


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, correlation) of all pairs, from one aggregate without any exchange of rows."""
    found = df.agg(*(correlation(number(df, a), number(df, b)).alias(f"r{i}") for i, (a, b) in enumerate(_pairs(columns))))
    return found.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("correlation")) for i, (a, b) in enumerate(_pairs(columns))))))


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson's correlation of average ranks within each pair's complete rows.

    Ranks come from running sums over the counts of distinct values, range by
    range of the values. Columns without nulls have one rank for all their
    pairs; only pairs with a null somewhere are ranked pair by pair.
    """
    known = df.agg(F.count("*").alias("n"), *(F.count(number(df, c)).alias(f"k{i}") for i, c in enumerate(columns))).first()
    full = [c for i, c in enumerate(columns) if known[f"k{i}"] == known["n"]]
    parts = [_spearman_pairs(df, [p for p in _pairs(columns) if not set(p) <= set(full)])] if len(full) < len(columns) else []
    if len(full) > 1:
        rows = df.select(*(number(df, c).alias(f"x{i}") for i, c in enumerate(full)))
        at = cuts(rows, {c: F.col(c) for c in rows.columns})
        for i in range(len(full)):
            counts = running(rows.groupBy(f"x{i}").agg(F.count("*").alias("_n")), f"x{i}", {"_upto": "_n"}, part=part_of(F.col(f"x{i}"), at[f"x{i}"]))
            rows = rows.join(counts.select(F.col(f"x{i}"), (F.col("_upto") - (F.col("_n") - 1) / 2).alias(f"r{i}")), f"x{i}")
        found = rows.agg(*(correlation(F.col(f"r{full.index(a)}"), F.col(f"r{full.index(b)}")).alias(f"p{k}") for k, (a, b) in enumerate(_pairs(full))))
        parts.append(found.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{k}").alias("correlation")) for k, (a, b) in enumerate(_pairs(full)))))))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _spearman_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    rows = _pair_rows(df, pairs)
    for v in ("x", "y"):
        counts = running(rows.groupBy("a", "b", v).agg(F.count("*").alias("_n")), v, {"_upto": "_n"}, ("a", "b"))
        ranks = counts.select("a", "b", F.col(v).alias(f"_{v}"), (F.col("_upto") - (F.col("_n") - 1) / 2).alias(f"r{v}"))
        rows = rows.join(ranks.withColumnsRenamed({"a": "_a", "b": "_b"}), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col(v) == F.col(f"_{v}"))).drop("_a", "_b", f"_{v}")
    return rows.groupBy("a", "b").agg(correlation(F.col("rx"), F.col("ry")).alias("correlation"))


#: Points whose pairs are met all at once, and ranges that more points are cut into.
_TOGETHER, _RANGES = 512, 16


def kendall_score(x, y, n) -> float:
    """The sum of n_i n_j sign(x_i - x_j) sign(y_i - y_j) over all pairs of points.

    Many points are cut into ranges of x and of y. Pairs in one range of x are
    scored among themselves; so are those in one range of y, by their ranges of
    x; for all others the counts of the grid's cells are enough. So the work
    grows a little faster than the points, not with their square.
    """
    import numpy as np

    if len(x) < 2 or x.min() == x.max() or y.min() == y.max():
        return 0.0
    if len(x) <= _TOGETHER:
        signs = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
        return float(n @ signs @ n) / 2
    total, places = 0.0, []
    for v in (x, y):
        distinct = np.unique(v)
        edges = distinct[np.linspace(0, len(distinct), min(_RANGES, len(distinct)), endpoint=False).astype(int)[1:]]
        places.append(np.searchsorted(edges, v, side="right"))
    for place, a, b in ((places[0], x, y), (places[1], places[0], y)):
        order = np.argsort(place, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            total += kendall_score(a[rows], b[rows], n[rows])
    cells = np.zeros((_RANGES, _RANGES))
    np.add.at(cells, tuple(places), n)
    return total + _grid_score(cells)


def _grid_score(cells) -> float:
    """Pairs of cells that differ in both directions, concordant less discordant."""
    import numpy as np

    below = np.cumsum(np.cumsum(cells, axis=0), axis=1)
    rows = np.cumsum(cells.sum(axis=1))
    less = np.zeros_like(cells)
    less[1:, 1:] = below[:-1, :-1]
    more = np.zeros_like(cells)
    more[1:, :] = rows[:-1, None] - below[:-1, :]
    return float((cells * (less - more)).sum())


def kendall(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Kendall's tau-b of all pairs of columns.

    Equal points are counted once and cut into ranges of x and of y at
    approximate quantiles. Tasks score the points of one range of x, others
    those of one range of y, and the counts of the grid's cells, a bounded
    table, do the rest (see ``kendall_score``): no pair of points ever exists.
    """
    import numpy as np
    import pandas as pd

    names = list(dict.fromkeys(columns))
    at = cuts(df, {f"c{i}": number(df, c) for i, c in enumerate(names)})
    place = lambda c: part_of(number(df, c), at[f"c{names.index(c)}"])
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), number(df, a).alias("x"), number(df, b).alias("y"), place(a).alias("i"), place(b).alias("j")) for a, b in _pairs(columns)))
    rows = df.select(F.inline(cells)).where("x is not null and y is not null")
    points = rows.groupBy("a", "b", "x", "y", "i", "j").agg(F.count("*").cast("double").alias("n"))

    def alone(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        x, y, n = (p[c].to_numpy(float) for c in ("x", "y", "n"))
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "s": [kendall_score(x, y, n)]})

    def grid(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((p["i"].max() + 1, p["j"].max() + 1))
        np.add.at(counts, (p["i"].to_numpy(), p["j"].to_numpy()), p["n"].to_numpy())
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "s": [_grid_score(counts)]})

    schema = "a string, b string, s double"
    inside = points.groupBy("a", "b", "i").applyInPandas(alone, schema)
    beside = points.withColumn("x", F.col("i").cast("double")).groupBy("a", "b", "x", "y", "j").agg(F.sum("n").alias("n")).groupBy("a", "b", "j").applyInPandas(alone, schema)
    apart = points.groupBy("a", "b", "i", "j").agg(F.sum("n").alias("n")).groupBy("a", "b").applyInPandas(grid, schema)
    signs = inside.unionByName(beside).unionByName(apart).groupBy("a", "b").agg(F.sum("s").alias("s"))
    tied = lambda c: F.sum(F.col("n") * (F.col("n") - 1) / 2.0).alias(c)
    out = signs.join(points.groupBy("a", "b").agg(F.sum("n").alias("n")).select("a", "b", (F.col("n") * (F.col("n") - 1) / 2.0).alias("all")), ["a", "b"])
    for v in ("x", "y"):
        out = out.join(points.groupBy("a", "b", v).agg(F.sum("n").alias("n")).groupBy("a", "b").agg(tied(f"t{v}")), ["a", "b"])
    return out.select("a", "b", divide(F.col("s"), F.sqrt((F.col("all") - F.col("tx")) * (F.col("all") - F.col("ty")))).alias("correlation"))


def calculate_correlations(df: DataFrame, method: str = "pearson", min_abs: float = 0.7, max_columns: int = 30) -> dict:
    """The matrix of the usable columns, the pairs at least ``min_abs`` strong, and why columns were left out."""

    @as_error
    def run() -> dict:
        require(df, "df")
        how = {"pearson": pearson, "spearman": spearman, "kendall": kendall}.get(method.lower() if isinstance(method, str) else "")
        if how is None:
            raise ValueError(f"Unknown method {method!r}; there are pearson, spearman and kendall.")
        usable = lambda v, ok, default: v if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and ok(v) else default
        least, most = usable(min_abs, lambda v: v >= 0, 0.7), int(usable(max_columns, lambda v: v >= 1, 30))
        frame, _ = distinct_names(df)
        numeric = [c for c in frame.columns if is_numeric(frame, c)]
        skipped = {c: "Not numeric." for c in frame.columns if c not in numeric}
        facts = frame.agg(F.count("*").alias("n"), *(f(number(frame, c)).alias(f"{k}{i}") for i, c in enumerate(numeric) for k, f in (("c", F.count), ("lo", F.min), ("hi", F.max)))).first()
        if not facts["n"]:
            raise ValueError("Dataset is empty.")
        known = {c: facts[f"c{i}"] for i, c in enumerate(numeric)}
        for i, c in enumerate(numeric):
            if known[c] < 2:
                skipped[c] = "Fewer than two values."
            elif facts[f"lo{i}"] == facts[f"hi{i}"]:
                skipped[c] = "Constant."
        kept = [c for c in numeric if c not in skipped]
        note = None
        if len(kept) > most:
            note = f"Cut from {len(kept)} to the {most} columns with the most values."
            best = set(sorted(kept, key=lambda c: -known[c])[:most])
            kept = [c for c in kept if c in best]
        pairs = {(r["a"], r["b"]): r["correlation"] for r in how(frame, kept).collect()} if len(kept) > 1 else {}
        value = lambda a, b: 1.0 if a == b else pairs.get((a, b), pairs.get((b, a)))
        strong = [{"a": a, "b": b, "correlation": r} for a, b in _pairs(kept) if (r := pairs.get((a, b))) is not None and abs(r) >= least]
        strong.sort(key=lambda p: -abs(p["correlation"]))
        return to_jsonable({"method": method.lower(), "columns": kept, "matrix": [[value(a, b) for b in kept] for a in kept], "strong_pairs": strong, "n_rows": facts["n"], "skipped_columns": skipped} | ({"note": note} if note else {}))

    return run()
