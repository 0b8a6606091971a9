"""Fixed values of the methods."""

# Limits and defaults that results depend on.
MIN_TRAIN_ROWS = 10
MISSING_SCHEMA_RATIO, OUT_OF_BOUNDS_RATIO = 0.5, 0.10
PSI_MODERATE, PSI_MAJOR, PSI_BINS, PSI_CATEGORIES, PSI_EPSILON = 0.10, 0.25, 10, 50, 1e-4
DRIFT_MIN_ROWS, DRIFT_SIGMAS = 30, 3.0
EWMA_LAMBDA, EWMA_SIGMAS = 0.2, 3.0
CUSUM_SLACK, CUSUM_DECISION = 0.5, 5.0
D2 = 1.128
AUTOCORRELATION_WARN = 0.5
WESTERN_ELECTRIC, NELSON = (1, 2, 5, 6), (1, 2, 3, 4, 5, 6, 7, 8)
RULE_POINTS = {1: 1, 2: 9, 3: 6, 4: 14, 5: 3, 6: 5, 7: 15, 8: 8}
QUALITY_WEIGHTS = {"completeness": 0.30, "consistency": 0.25, "validity": 0.20, "uniqueness": 0.15, "timeliness": 0.10}
QUALITY_READY, QUALITY_USABLE = 85.0, 65.0
SILENT_NULLS = ("", "-", "--", "?", "n/a", "na", "n.a.", "null", "none", "nil", "nan", "missing", "unknown", "undefined", "#n/a", "#value!", "#div/0!")
SENTINELS = (-999.0, -9999.0, -99999.0, 999999.0, -1e30, 1e30)
MODIFIED_Z = 3.5
PARETO_CUTOFF, OEE_WORLD_CLASS = 0.80, 0.85
WEIBULL_MIN, WEIBULL_BOOTSTRAP, WEIBULL_CONFIDENCE = 8, 500, 0.95
CROW_MIN, FORECAST_INTERVAL, PM_SAVING = 5, 0.80, 0.05
SEED, SWEEP_SEEDS = 42, (0, 1, 2, 3, 4)
CALIBRATION_BINS, ECE_LIMIT = 10, 0.05
CAPABILITY_RATIO, CAPABILITY_OUTLIERS, TAIL_3_SIGMA, CAPABILITY_OUTLIER_ALPHA = 1.20, 0.01, 0.0027, 0.05
TREND_LAMBDA, TREND_RATE, BASELINE_INFLATION, TREND_SIGMAS, TREND_ALPHA = 0.10, 0.03, 2.0, 0.75, 0.01
IMBALANCE = 0.20
COST_SCRAP, COST_FALSE_ALARM, COST_INSPECTION = 500.0, 150.0, 20.0
COST_BREAKDOWN, COST_PLANNED, COST_CALLOUT = 50_000.0, 8_000.0, 1_500.0
