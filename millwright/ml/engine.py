"""A cost-tuned model of failures or quality: fit, threshold, score, explain, watch, store."""

from __future__ import annotations

import json
import math
import time
import uuid
from datetime import UTC, datetime
from importlib.metadata import PackageNotFoundError, version
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import classification, regression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions.columns import col, is_numeric, number, portable_hash
from millwright.functions.constants import COST_BREAKDOWN, COST_CALLOUT, COST_FALSE_ALARM, COST_INSPECTION, COST_PLANNED, COST_SCRAP, IMBALANCE, MIN_TRAIN_ROWS, MISSING_SCHEMA_RATIO, OUT_OF_BOUNDS_RATIO, PSI_BINS, PSI_EPSILON, PSI_MAJOR, PSI_MODERATE, SEED
from millwright.functions.ordered import quantiles
from millwright.functions.report import to_jsonable
from millwright.functions.session import importable
from millwright.ml import prepare
from millwright.ml.forest import IsolationForest, read_tree, tree_shap
from millwright.operators import metrics, profile, reliability

#: Rows of the majority class that the isolation forest draws its samples from, at most.
FOREST_ROWS = 20_000
EXPLAIN_ROWS = 1000
#: Rows that a class needs to be learned.
LEAST_CLASS = 5
ESTIMATORS = ("gbt", "rf", "linear")
#: Settings of each family, tried in turn while the budget lasts.
SETTINGS = {
    "gbt": ({"maxIter": 20, "maxDepth": 4}, {"maxIter": 40, "maxDepth": 4}, {"maxIter": 30, "maxDepth": 6}),
    "rf": ({"numTrees": 30, "maxDepth": 8}, {"numTrees": 60, "maxDepth": 12}),
    "linear": ({"regParam": 1e-3}, {"regParam": 1e-2}, {"regParam": 1e-1}),
}


def get_library_versions() -> dict[str, str | None]:
    out = {}
    for name in ("pyspark", "numpy", "pandas", "pyarrow"):
        try:
            out[name] = version(name)
        except PackageNotFoundError:
            out[name] = None
    return out


class Engine:
    """Prepares a table, searches for a model within a time budget, and answers what its errors cost.

    All methods take DataFrames that hold the features and, where a truth is
    needed, the target column. Predictions come back as DataFrames.
    """

    def __init__(self, task="auto", time_budget=30, scale_method="standard", cost_sensitive_weighting=False, collinear_threshold=0.9, estimators=None, handle_silent_nulls=True, audit_data=True, random_state=SEED, apply_smote=None):
        if apply_smote:
            raise ValueError("Synthetic minority rows are not made here: weigh the classes (cost_sensitive_weighting) or tune the threshold to cost.")
        self.task, self.time_budget, self.scale_method, self.cost_sensitive_weighting = task, max(1, time_budget), scale_method, cost_sensitive_weighting
        self.collinear_threshold, self.estimators, self.handle_silent_nulls, self.audit_data, self.random_state = collinear_threshold, estimators, handle_silent_nulls, audit_data, random_state
        self.is_fitted = self.is_anomaly_model = False
        self.optimal_threshold = 0.5
        self.model = self.plan = self.best_name = self.metric = self.validation_score = self.tuned_on = self.audit = self.anomaly_class = None
        self.classes_: list = []
        self.positive = 1
        self.profile: dict[str, dict] = {}
        self.candidates: list[dict] = []
        self.health = {"calls": 0, "rows": 0, "missing_feature_calls": 0, "out_of_bounds_calls": 0}

    # -------------------------------------------------------------- fitting

    def fit(self, df: DataFrame, target: str) -> Engine:
        if target not in df.columns:
            raise ValueError(f"Target column '{target}' not found.")
        rows = df.where(col(target).isNotNull())
        n = rows.count()
        if n < MIN_TRAIN_ROWS:
            raise ValueError(f"At least {MIN_TRAIN_ROWS} rows with a target are needed, found {n}.")
        self.__init__(self.task, self.time_budget, self.scale_method, self.cost_sensitive_weighting, self.collinear_threshold, self.estimators, self.handle_silent_nulls, self.audit_data, self.random_state)
        self.target = target
        if self.audit_data:
            self.audit = profile.audit_data_quality(rows, target)
        if self.task == "auto":
            facts = profile.target_facts(rows, target).first()
            numeric = is_numeric(rows, target) or facts["numbers"] == facts["known"]
            self.task = "regression" if numeric and facts["distinct_numbers"] > 10 else "classification"
        counts = self.learn_classes(rows, target) if self.task == "classification" else {}
        y = self._label(rows)
        regular = self.task != "forecasting"
        self.plan = prepare.fit(rows, target, y if len(counts) <= 2 else None, self.scale_method, self.collinear_threshold, self.handle_silent_nulls, regular)
        if not self.plan.features:
            raise ValueError("No usable features are left.")
        data = prepare.transform(rows.withColumn("_y", y), self.plan, keep=["_y"]).persist()
        try:
            self._freeze(data)
            if self.task == "classification" and self._guard(data, counts):
                return self
            self._search(data, counts)
        finally:
            data.unpersist()
        self.is_fitted = True
        return self

    def learn_classes(self, rows: DataFrame, target: str) -> dict[str, int]:
        """Rows of each class; of two classes the rarer one is positive."""
        self.target = target
        counts = {r[0]: r["count"] for r in rows.groupBy(col(target).cast("string")).count().collect()}
        if len(counts) < 2:
            raise ValueError("The target has fewer than two classes.")
        self.classes_ = sorted(counts)
        self.positive = self.classes_.index(min(self.classes_, key=lambda c: (counts[c], -self.classes_.index(c)))) if len(counts) == 2 else 1
        return counts

    @staticmethod
    def balanced_weights(counts: dict[str, int]) -> dict[str, float]:
        """A class's weight: what makes all classes count alike."""
        return {c: sum(counts.values()) / (len(counts) * k) for c, k in counts.items()}

    @staticmethod
    def viable(counts: dict[str, int]) -> list[str]:
        """Classes with enough rows to be learned."""
        return [c for c in sorted(counts) if counts[c] >= LEAST_CLASS]

    def _label(self, df: DataFrame) -> Column:
        if self.task != "classification":
            return number(df, self.target)
        return F.call_function("array_position", F.array(*map(F.lit, self.classes_)), col(self.target).cast("string")).cast("double") - 1.0

    def _freeze(self, data: DataFrame) -> None:
        """Edges and shares of every feature as trained, so that drift needs no training data."""
        cells = data.select(F.inline(F.array(*(F.struct(F.lit(k).alias("feature"), F.col(k).alias("x")) for k in self.plan.features))))
        edges = {r["feature"]: list(dict.fromkeys(r["q"])) for r in quantiles(cells, "x", [i / PSI_BINS for i in range(PSI_BINS + 1)], ["feature"]).collect()}
        facts = data.agg(F.count("*").alias("n"), *(F.avg(k).alias(f"m_{k}") for k in self.plan.features), *(F.stddev_samp(k).alias(f"s_{k}") for k in self.plan.features)).first()
        self.profile = {k: {"edges": edges[k], "mean": facts[f"m_{k}"], "std": facts[f"s_{k}"]} for k in self.plan.features if len(edges.get(k, ())) >= 3 and facts["n"] >= PSI_BINS}
        shares = self._shares(data)
        for k, s in shares.items():
            self.profile[k]["share"] = s

    def _shares(self, data: DataFrame) -> dict[str, list[float]]:
        if not self.profile:
            return {}
        cells = []
        for k, p in self.profile.items():
            edges = p["edges"]
            at = F.greatest(F.lit(1), F.least(F.size(F.filter(F.array(*map(F.lit, edges)), _upto(k))), F.lit(len(edges) - 1)))
            cells.append(F.struct(F.lit(k).alias("feature"), at.alias("bin")))
        counts = data.select(F.inline(F.array(*cells))).groupBy("feature", "bin").count().collect()
        out = {k: [0] * (len(p["edges"]) - 1) for k, p in self.profile.items()}
        for r in counts:
            out[r["feature"]][r["bin"] - 1] = r["count"]
        return {k: [c / max(sum(v), 1) for c in v] for k, v in out.items()}

    def _guard(self, data: DataFrame, counts: dict) -> bool:
        """Very rare classes: drop them, or learn what is normal instead."""
        if len(counts) == 2:
            if len(self.viable(counts)) == 2:
                return False
            self.anomaly_class = self.positive
        else:
            viable = self.viable(counts)
            if len(viable) >= 2:
                self.rare = [c for c in self.classes_ if c not in viable]
                return False
            self.anomaly_class = -1
        self.normal_class = self.classes_.index(max(self.classes_, key=lambda c: counts[c]))
        normal = data.where(F.col("_y") == self.normal_class).select(*self.plan.features)
        sample = normal.orderBy(portable_hash(F.lit(self.random_state), F.to_json(F.struct(*self.plan.features)))).limit(FOREST_ROWS).toPandas().to_numpy(float)
        self.model, self.is_anomaly_model, self.is_fitted, self.best_name = IsolationForest.fit(sample, self.random_state), True, True, "IsolationForest"
        return True

    def _search(self, data: DataFrame, counts: dict) -> None:
        """Families and their settings in turn until the budget is spent, one at least; the best on a held-out fifth is refitted on all rows."""
        binary = len(self.classes_) == 2
        classify = self.task == "classification"
        self.metric = ("roc_auc" if binary else "log_loss") if classify else "r2"
        rare = getattr(self, "rare", [])
        if rare:
            data = data.where(~F.col("_y").isin(*(float(self.classes_.index(c)) for c in rare)))
        vectors = VectorAssembler(inputCols=self.plan.features, outputCol="_x").transform(data).withColumn("_w", F.lit(1.0))
        if classify and self.cost_sensitive_weighting and min(counts.values()) / sum(counts.values()) < IMBALANCE:
            weight = {float(self.classes_.index(c)): w for c, w in self.balanced_weights(counts).items()}
            vectors = vectors.withColumn("_w", F.element_at(F.create_map(*(F.lit(v) for kv in weight.items() for v in kv)), F.col("_y")))
        h = portable_hash(F.lit(self.random_state), F.to_json(F.struct(*self.plan.features)))
        held = (h % 5 == 0).alias("_held")
        vectors = vectors.select("_x", "_y", "_w", held).persist()
        if vectors.where("_held").count() < 2 or (classify and vectors.where("_held").select("_y").distinct().count() < 2):
            vectors = vectors.withColumn("_held", F.lit(None).cast("boolean"))
        train = vectors.where("coalesce(not _held, true)")
        test = vectors.where("coalesce(_held, true)")
        wanted = self.estimators or list(ESTIMATORS)
        began, best = time.time(), None
        # every family's first settings, then every family's second ones, and so on
        turns = [(name, s) for i in range(max(map(len, SETTINGS.values()))) for name in wanted for s in SETTINGS.get(name, ())[i : i + 1]]
        for name, settings in turns:
            estimator = self._estimator(name, binary, settings)
            if estimator is None:
                continue
            if best is not None and time.time() - began >= self.time_budget:
                break
            fitted = estimator.fit(train)
            score = self._validated(fitted, test)
            self.candidates.append({"name": name, "settings": settings, "score": score, "seconds": round(time.time() - began, 2)})
            better = best is None or (score is not None and (best[1] is None or (score < best[1] if self.metric == "log_loss" else score > best[1])))
            if better:
                best = (name, score, estimator)
        if best is None:
            raise ValueError(f"No estimator of {wanted} suits this task.")
        self.best_name, self.validation_score, estimator = best
        self.model = estimator.fit(vectors)
        vectors.unpersist()

    def _estimator(self, name: str, binary: bool, settings: dict):
        common = {"featuresCol": "_x", "labelCol": "_y", "weightCol": "_w", "predictionCol": "_hat"}
        if self.task == "classification":
            made = {
                "gbt": lambda: classification.GBTClassifier(**common, **settings, seed=self.random_state) if binary else None,
                "rf": lambda: classification.RandomForestClassifier(**common, **settings, seed=self.random_state),
                "linear": lambda: classification.LogisticRegression(**common, **settings, maxIter=50),
            }
            found = made[name]() if name in made else None
            return found.setProbabilityCol("_prob").setRawPredictionCol("_raw") if found is not None else None
        made = {
            "gbt": lambda: regression.GBTRegressor(**common, **settings, seed=self.random_state),
            "rf": lambda: regression.RandomForestRegressor(**common, **settings, seed=self.random_state),
            "linear": lambda: regression.LinearRegression(**common, **settings, maxIter=50),
        }
        return made[name]() if name in made else None

    def _validated(self, fitted, test: DataFrame) -> float | None:
        out = fitted.transform(test)
        if self.metric == "r2":
            return metrics.regression_scores(out, F.col("_y"), F.col("_hat")).first()["r2"]
        prob = vector_to_array("_prob")
        if self.metric == "roc_auc":
            return metrics.ranking(out, F.col("_y") == self.positive, prob[self.positive]).first()["roc_auc"]
        own = F.element_at(prob, F.col("_y").cast("int") + 1)
        return out.agg(F.avg(-F.log(F.greatest(own, F.lit(1e-15)))).alias("x")).first()["x"]

    # -------------------------------------------------------------- predictions

    def _ready(self) -> None:
        if not self.is_fitted:
            raise ValueError("Engine is not fitted.")

    def _scored(self, df: DataFrame) -> DataFrame:
        """All columns of ``df`` with ``_prob`` (array by class) or ``_hat``."""
        self._ready()
        importable(df.sparkSession)
        self._observe(df)
        names = df.columns
        flat = prepare.transform(df.withColumn("_all", F.struct(*(col(c) for c in names))), self.plan, keep=["_all"])
        if self.is_anomaly_model:
            forest = self.model

            @F.pandas_udf("double")
            def decision(x: pd.Series) -> pd.Series:
                return pd.Series(forest.decision(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

            d = decision(F.array(*self.plan.features))
            return flat.select("_all", d.alias("_d")).withColumn("_p", 1 / (1 + F.exp(F.greatest(F.lit(-15.0), F.least(F.lit(15.0), 5.0 * F.col("_d")))))).select("_all.*", "_d", F.array(1 - F.col("_p"), F.col("_p")).alias("_prob"))
        out = self.model.transform(VectorAssembler(inputCols=self.plan.features, outputCol="_x").transform(flat))
        if self.task == "classification":
            return out.select("_all.*", "_hat", vector_to_array("_prob").alias("_prob"))
        return out.select("_all.*", "_hat")

    def _observe(self, df: DataFrame) -> None:
        """Missing columns are counted from the schema alone; rows out of bounds are counted by ``check_batch``."""
        self.health["calls"] += 1
        missing = [c for c in self.plan.raw if c not in df.columns]
        if self.plan.raw and len(missing) / len(self.plan.raw) > MISSING_SCHEMA_RATIO:
            self.health["missing_feature_calls"] += 1

    def check_batch(self, df: DataFrame) -> dict:
        """Share of a batch's values outside the bounds of training, by feature, where above a tenth."""
        self._ready()
        features = [k for k in self.plan.features if k in self.plan.bounds]
        raw = prepare.Plan(**{**self.plan.__dict__, "shift": {}})
        flat = prepare.transform(df, raw, clip=False)
        outside = [F.avg(((F.col(k) < self.plan.bounds[k][0]) | (F.col(k) > self.plan.bounds[k][1])).cast("double")).alias(k) for k in features]
        row = flat.agg(F.count("*").alias("_n"), *outside).first()
        self.health["rows"] += row["_n"]
        found = {k: row[k] for k in features if row[k] is not None and row[k] > OUT_OF_BOUNDS_RATIO}
        self.health["out_of_bounds_calls"] += bool(found)
        return {"rows": row["_n"], "out_of_bounds": found, "missing_columns": [c for c in self.plan.raw if c not in df.columns]}

    def get_inference_health(self) -> dict:
        return dict(self.health)

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        """``df`` with the predicted label: by the tuned threshold, where there is one."""
        out = self._scored(df)
        if self.task != "classification":
            return out.withColumn(to, F.col("_hat")).drop("_hat")
        names = F.array(*map(F.lit, self.classes_))
        if self.is_anomaly_model:
            normal = F.lit(self.classes_[self.normal_class])
            odd = F.lit("ANOMALY") if self.anomaly_class == -1 else F.lit(self.classes_[self.anomaly_class])
            return out.withColumn(to, F.when(F.col("_d") >= 0, normal).otherwise(odd)).drop("_d", "_prob")
        at = F.col("_hat").cast("int")
        if len(self.classes_) == 2 and self.optimal_threshold != 0.5:
            at = F.when(F.col("_prob")[self.positive] >= self.optimal_threshold, self.positive).otherwise(1 - self.positive)
        return out.withColumn(to, F.element_at(names, at + 1)).drop("_hat", "_prob")

    def predict_proba(self, df: DataFrame, to: str = "probability") -> DataFrame:
        """``df`` with an array of probabilities by class (normal, anomaly for the fallback)."""
        self._ready()
        if self.task != "classification":
            raise ValueError("Probabilities exist for classification only.")
        return self._scored(df).withColumnRenamed("_prob", to).drop("_hat", "_d")

    def _binary(self, df: DataFrame) -> tuple[DataFrame, Column, Column] | None:
        if self.task != "classification" or len(self.classes_) != 2:
            return None
        rows = self._scored(df.where(col(self.target).isNotNull()))
        at = 1 if self.is_anomaly_model else self.positive
        return rows, col(self.target).cast("string") == self.classes_[self.positive], F.col("_prob")[at]

    # -------------------------------------------------------------- thresholds, calibration, cost

    def _tune(self, df: DataFrame, sweep) -> float:
        found = None if self.is_anomaly_model else self._binary(df)
        if found is None:
            return 0.5
        self.optimal_threshold = metrics.best_threshold(sweep(*found))
        self.tuned_on = metrics.fingerprint(df)
        return self.optimal_threshold

    def optimize_threshold(self, df: DataFrame, cost_scrap=COST_SCRAP, cost_fa=COST_FALSE_ALARM, cost_insp=COST_INSPECTION) -> float:
        return self._tune(df, lambda rows, y, p: metrics.threshold_sweep(rows, y, p, cost_scrap, cost_fa, cost_insp))

    def optimize_maintenance_threshold(self, df: DataFrame, cost_breakdown=COST_BREAKDOWN, cost_planned=COST_PLANNED, cost_inspection=COST_CALLOUT) -> float:
        return self._tune(df, lambda rows, y, p: metrics.maintenance_sweep(rows, y, p, cost_breakdown, cost_planned, cost_inspection))

    def check_calibration(self, df: DataFrame, n_bins: int = 10) -> dict:
        if not self.is_fitted:
            return {"error": "Engine is not fitted."}
        found = self._binary(df)
        if found is None:
            return {"error": "Calibration is measured for binary classification."}
        rows, y, p = found
        out = metrics.check_calibration(rows.select(y.cast("int").alias("y"), p.alias("p")), "y", "p", n_bins)
        if "error" in out:
            return out
        out |= {"positive_class": self.classes_[self.positive], "probability_source": "isolation_forest_sigmoid" if self.is_anomaly_model else "model"}
        if self.is_anomaly_model:
            out |= {"is_well_calibrated": False, "interpretation": "These scores squash an isolation forest's decision; they rank, but they are no probabilities."}
        return out

    def _counts(self, df: DataFrame) -> dict | None:
        if self.is_anomaly_model or self.task != "classification" or len(self.classes_) != 2:
            return None
        rows = self.predict(df.where(col(self.target).isNotNull()), "_guess")
        positive = self.classes_[self.positive]
        return metrics.binary_scores(metrics.binary_counts(rows, col(self.target).cast("string") == positive, F.col("_guess") == positive)).first().asDict()

    def calculate_cost_of_quality(self, df: DataFrame, cost_scrap=COST_SCRAP, cost_fa=COST_FALSE_ALARM, cost_insp=COST_INSPECTION, base_det_rate=0.0, base_fp_rate=0.0) -> dict:
        c = self._counts(df)
        if c is None:
            return {"error": "Cost of quality needs a fitted binary classification model."}
        four = [F.lit(c[k]) for k in ("tp", "fp", "fn", "tn")]
        out = metrics.quality_cost_columns(*four, cost_scrap, cost_fa, cost_insp, base_det_rate, base_fp_rate)
        row = df.sparkSession.range(1).select(*(v.alias(k) for k, v in out.items())).first().asDict()
        return row | {"savings_percentage": f"{row['savings_percentage']:.2f}%"}

    def calculate_maintenance_cost(self, df: DataFrame, cost_breakdown=COST_BREAKDOWN, cost_planned=COST_PLANNED, cost_inspection=COST_CALLOUT) -> dict:
        c = self._counts(df)
        if c is None:
            return {"error": "Maintenance cost needs a fitted binary classification model."}
        return reliability.calculate_maintenance_savings(c["tp"], c["fp"], c["fn"], cost_breakdown, cost_planned, cost_inspection)

    def evaluate(self, df: DataFrame) -> dict:
        self._ready()
        rows = df.where(col(self.target).isNotNull())
        if self.task != "classification":
            out = self.predict(rows, "_guess")
            return to_jsonable(metrics.regression_scores(out, number(out, self.target), F.col("_guess")).first().asDict() | {"task_type": "regression_forecasting", "best_model_name": self.best_name})
        pairs = metrics.confusion(self.predict(rows, "_guess"), self.target, "_guess")
        table = pairs.collect()
        labels = list(dict.fromkeys([*self.classes_, *sorted(x for r in table for x in (r["label"], r["predicted"]))]))
        matrix = [[sum(r["n"] for r in table if (r["label"], r["predicted"]) == (a, b)) for b in labels] for a in labels]
        n = sum(map(sum, matrix))
        report = {r["class"]: {k: r[k] for k in ("precision", "recall", "f1", "support")} for r in metrics.class_scores(pairs).collect()}
        out: dict[str, Any] = {"accuracy": sum(matrix[i][i] for i in range(len(labels))) / n if n else 0.0, "confusion_matrix": matrix, "class_labels": labels, "best_model_name": self.best_name, "mcc": metrics.multiclass_mcc(table), "n_test_rows": n}
        if len(self.classes_) != 2:
            return to_jsonable(out | {"task_type": "multi_class_classification", "macro_f1": sum(r["f1"] for r in report.values()) / max(len(report), 1), "classification_report": report})
        positive = self.classes_[self.positive]
        i = labels.index(positive)
        tp, fn, fp = matrix[i][i], sum(matrix[i]) - matrix[i][i], sum(r[i] for r in matrix) - matrix[i][i]
        own = report.get(positive, {"precision": 0.0, "recall": 0.0, "f1": 0.0})
        scored, y, p = self._binary(rows)
        rank = metrics.ranking(scored, y, p).first()
        both = rank["base_rate"] is not None and 0 < rank["base_rate"] < 1
        return to_jsonable(
            out
            | {"task_type": "binary_classification", "threshold_leakage_warning": self.tuned_on is not None and metrics.fingerprint(df) == self.tuned_on, "threshold_used": self.optimal_threshold}
            | {k: own[k] for k in ("precision", "recall", "f1")}
            | {"roc_auc": rank["roc_auc"] if both else None, "pr_auc": rank["pr_auc"] if both else None, "defect_base_rate": rank["base_rate"] if both else None}
            | {"recall_ci_95": reliability.wilson_confidence_interval(tp, tp + fn), "precision_ci_95": reliability.wilson_confidence_interval(tp, tp + fp)}
        )

    # -------------------------------------------------------------- explanations and watch

    def get_feature_importance(self) -> list[dict] | None:
        if not self.is_fitted or self.is_anomaly_model:
            return None
        if hasattr(self.model, "featureImportances"):
            values = self.model.featureImportances.toArray()
        else:
            matrix = self.model.coefficientMatrix.toArray() if hasattr(self.model, "coefficientMatrix") else self.model.coefficients.toArray()[None, :]
            values = np.abs(matrix).mean(axis=0)
        rows = [{"feature": f, "importance": float(v)} for f, v in zip(self.plan.features, values)]
        return sorted(rows, key=lambda r: -r["importance"])

    def get_training_report(self) -> dict:
        return {"task": self.task, "best_model": self.best_name, "metric_optimized": self.metric, "validation_score": self.validation_score, "candidates": self.candidates, "features": self.plan.features if self.plan else [], "dropped": self.plan.dropped if self.plan else {}, "is_anomaly_model": self.is_anomaly_model, "data_quality": (self.audit or {}).get("dqs")}

    def get_shap_values(self, df: DataFrame, max_rows: int = EXPLAIN_ROWS) -> dict:
        """Shapley values of up to ``max_rows`` rows: of the margin for boosted trees, the positive class's share for forests, the score for linear models."""
        if not self.is_fitted or self.is_anomaly_model:
            return {"available": False, "reason": "Attributions need a fitted model that is no isolation forest.", "values": None}
        x = prepare.transform(df, self.plan).limit(max_rows).toPandas().to_numpy(float)
        if hasattr(self.model, "trees"):
            boosted = type(self.model).__name__.startswith("GBT")
            share = self.task == "classification" and not boosted

            def value(node):
                if not share:
                    return node.prediction()
                stats = list(node.impurityStats().stats())
                return stats[self.positive] / max(sum(stats), 1e-12)

            trees = [read_tree(t._call_java("rootNode"), value) for t in self.model.trees]
            weights = list(self.model.treeWeights) if boosted else [1 / len(trees)] * len(trees)
            values = np.array([sum(w * tree_shap(t, row) for w, t in zip(weights, trees)) for row in x]).reshape(len(x), -1)
        else:
            multi = hasattr(self.model, "coefficientMatrix")
            matrix = self.model.coefficientMatrix.toArray() if multi else self.model.coefficients.toArray()[None, :]
            # of several classes, each row is explained by the score of the class it is given
            weights = matrix[(x @ matrix.T + self.model.interceptVector.toArray()).argmax(axis=1)] if len(matrix) > 1 else matrix[-1] * (1 if self.positive == 1 or self.task != "classification" else -1)
            means = np.array([self.profile.get(f, {}).get("mean") or 0.0 for f in self.plan.features])
            values = (x - means) * weights
        return {"available": True, "reason": None, "values": values, "features": self.plan.features, "rows": len(x)}

    def explain_predictions(self, df: DataFrame, top_k: int | None = 10, max_rows: int = EXPLAIN_ROWS) -> dict:
        found = self.get_shap_values(df, max_rows)
        if not found["available"] or not found["rows"]:
            return {"available": False, "reason": found["reason"] or "There are no rows.", "feature_attributions": []}
        mean = np.abs(found["values"]).mean(axis=0)
        rows = sorted(({"feature": f, "mean_abs_shap": float(v)} for f, v in zip(found["features"], mean)), key=lambda r: -r["mean_abs_shap"])
        return {"available": True, "reason": None, "n_rows": found["rows"], "feature_attributions": rows[:top_k] if top_k else rows}

    def detect_drift(self, df: DataFrame) -> dict:
        """PSI of a batch against the profile frozen at training, on values that are not clipped."""
        self._ready()
        flat = prepare.transform(df, self.plan, clip=False)
        shares = self._shares(flat)
        means = flat.agg(F.count("*").alias("n"), *(F.avg(k).alias(k) for k in self.profile)).first()
        out, top = {}, None
        for k, s in shares.items():
            t = self.profile[k]["share"]
            terms = [((b or PSI_EPSILON) - (a or PSI_EPSILON)) * math.log((b or PSI_EPSILON) / (a or PSI_EPSILON)) for a, b in zip(t, s)]
            psi = sum(terms) if means["n"] else None
            if psi is None:
                continue
            centre, scale = self.plan.shift.get(k, (0.0, 1.0))
            out[k] = {"psi": psi, "band": "major" if psi > PSI_MAJOR else "moderate" if psi > PSI_MODERATE else "stable", "train_mean": self.profile[k]["mean"] * scale + centre, "batch_mean": means[k] * scale + centre if means[k] is not None else None}
            top = psi if top is None else max(top, psi)
        return to_jsonable({"rows": means["n"], "drift_detected": any(v["band"] == "major" for v in out.values()), "max_psi": top, "features": out})

    # -------------------------------------------------------------- storage

    def save(self, path: str) -> dict:
        """The model, the plan and a manifest with a hash over the stored files."""
        self._ready()
        spark = SparkSession.getActiveSession()
        if self.is_anomaly_model:
            trees = [(i, t.tobytes(), len(t)) for i, t in enumerate(self.model.trees)]
            spark.createDataFrame(trees, "i int, nodes binary, n int").write.mode("overwrite").parquet(f"{path}/model")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        keys = ("task", "time_budget", "scale_method", "cost_sensitive_weighting", "collinear_threshold", "estimators", "handle_silent_nulls", "audit_data", "random_state", "is_anomaly_model", "optimal_threshold", "best_name", "metric", "validation_score", "tuned_on", "anomaly_class", "classes_", "positive", "profile", "candidates", "health", "target")
        manifest = {k: getattr(self, k, None) for k in keys} | {"normal_class": getattr(self, "normal_class", None), "forest_size": self.model.size if self.is_anomaly_model else None}
        manifest |= {"kind": type(self.model).__name__, "plan": self.plan.to_json(), "saved_at": datetime.now(UTC).isoformat(), "versions": get_library_versions(), "id": uuid.uuid4().hex, "sha256": _hash(spark, f"{path}/model")}
        _write_text(spark, f"{path}/manifest.json", json.dumps(to_jsonable(manifest)))
        return manifest

    @classmethod
    def load(cls, path: str, enforce_security: bool = True) -> Engine:
        """Read an engine; a missing manifest, a missing hash or changed files raise unless ``enforce_security`` is off."""
        spark = SparkSession.getActiveSession()
        try:
            manifest = json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])
        except Exception as e:
            raise FileNotFoundError(f"There is no manifest at {path}.") from e
        if enforce_security:
            if not manifest.get("sha256"):
                raise ValueError("The manifest holds no hash.")
            try:
                found = _hash(spark, f"{path}/model")
            except Exception as e:  # a file system may find the change first
                raise RuntimeError("The stored model cannot be read.") from e
            if found != manifest["sha256"]:
                raise RuntimeError("The stored model does not match its hash.")
        out = cls(**{k: manifest[k] for k in ("task", "time_budget", "scale_method", "cost_sensitive_weighting", "collinear_threshold", "estimators", "handle_silent_nulls", "audit_data", "random_state")})
        for k in ("is_anomaly_model", "optimal_threshold", "best_name", "metric", "validation_score", "tuned_on", "anomaly_class", "classes_", "positive", "profile", "candidates", "health", "target", "normal_class"):
            setattr(out, k, manifest[k])
        out.plan = prepare.Plan.from_json(manifest["plan"])
        if out.is_anomaly_model:
            rows = spark.read.parquet(f"{path}/model").orderBy("i").collect()
            out.model = IsolationForest([np.frombuffer(bytes(r["nodes"])).reshape(r["n"], -1) for r in rows], manifest["forest_size"])
        else:
            kind = getattr(classification, manifest["kind"], None) or getattr(regression, manifest["kind"])
            out.model = kind.load(f"{path}/model")
        out.is_fitted = True
        return out


def _upto(name: str):
    return lambda e: e <= F.col(name)


def _hash(spark: SparkSession, path: str) -> str:
    """SHA-256 over the names and contents of the data files, hashed on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("h")).where("name not like '%.crc'").orderBy("name", "h")
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("name", "h"))), ","), 256)).first()[0]


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file on any file system that Spark reaches."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text, "utf-8"))
    out.close()

