"""Readers of CSV with the usual tokens for missing values, and an audit log."""

from __future__ import annotations

import json
import logging
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.columns import col
from millwright.functions.report import to_jsonable

# Texts that mean "missing" in a CSV file.
NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

logger = logging.getLogger("millwright")


def read_csv(path: str, schema: T.StructType | str | None = None, spark: SparkSession | None = None, multi_line: bool = False) -> DataFrame:
    """A CSV file with a header. Missing-value texts become null before types are inferred, so they do not turn a number column into text.

    Give a schema for large files: inferring reads them twice. ``multi_line`` lets
    quoted fields hold line breaks, for which a whole file becomes one task.
    """
    spark = spark or SparkSession.builder.getOrCreate()
    reader = spark.read.option("header", "true").option("escape", '"').option("multiLine", str(multi_line).lower())
    if schema is not None:
        return reader.schema(schema).csv(path)
    raw = reader.csv(path)
    clean = raw.select(*(F.when(~col(c).isin(*NA), col(c)).alias(c) for c in raw.columns))
    casts = [(c, t) for c in raw.columns for t in ("bigint", "double", "boolean")]
    seen = clean.agg(*(F.count(col(c)).alias(f"n{i}") for i, c in enumerate(raw.columns)), *(F.count(F.expr(f"try_cast(`{c}` as {t})")).alias(f"{t}_{raw.columns.index(c)}") for c, t in casts)).first()
    kinds = {c: next((t for t in ("bigint", "double", "boolean") if seen[f"n{i}"] and seen[f"{t}_{i}"] == seen[f"n{i}"]), "string") for i, c in enumerate(raw.columns)}
    return clean.select(*(F.expr(f"try_cast(`{c}` as {t})").alias(c) if t != "string" else col(c) for c, t in kinds.items()))


def resolve_csv(path: str, root: str) -> tuple[DataFrame | None, dict | None]:
    """A CSV file inside ``root``, or an error; neither links nor ``..`` lead out of it, and the root itself is refused."""
    base, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if full == base or os.path.commonpath([base, full]) != base:
        return None, {"error": "The path lies outside the folder that may be read."}
    if not os.path.isfile(full):
        return None, {"error": f"There is no file {path!r}."}
    df = read_csv(f"file://{full}")
    return (df, None) if df.take(1) else (None, {"error": f"{path!r} holds no rows."})


def enable_audit_log(filepath: str = "millwright_audit.log", level: int = logging.INFO) -> str | None:
    """Append the library's log to a file, once per file; None if it cannot be opened."""
    full = os.path.abspath(filepath)
    if any(getattr(h, "baseFilename", None) == full for h in logger.handlers):
        return full
    try:
        os.makedirs(os.path.dirname(full), exist_ok=True)
        handler = logging.FileHandler(full, encoding="utf-8")
    except OSError:
        return None
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    handler.setLevel(level)
    logger.addHandler(handler)
    logger.setLevel(min(logger.level or level, level))
    return full


def write_report(report: dict, path: str) -> None:
    """A report as JSON, on any file system that Spark reaches."""
    from millwright.ml.engine import _write_text

    _write_text(SparkSession.builder.getOrCreate(), path, json.dumps(to_jsonable(report), ensure_ascii=False))


def from_records(spark: SparkSession, records, names: list[str] | None = None) -> DataFrame:
    """Rows to predict on as a DataFrame: a record or a list of them, nested ones flattened by dotted names; a pandas Series (one row) or DataFrame; a numpy array or a SciPy sparse matrix, whose columns ``names`` names."""
    if hasattr(records, "toarray"):
        records = records.toarray()
    if isinstance(records, pd.Series):
        records = records.to_frame().T.infer_objects()
    if isinstance(records, np.ndarray):
        records = pd.DataFrame(np.atleast_2d(records), columns=names)
        records.columns = [str(c) for c in records.columns]
    if isinstance(records, pd.DataFrame):
        return spark.createDataFrame(records)

    def flat(record: dict, prefix: str = "") -> dict:
        out = {}
        for k, v in record.items():
            out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
        return out

    rows = [flat(r) for r in ([records] if isinstance(records, dict) else records)]
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], names) if rows else spark.createDataFrame([], T.StructType([]))
