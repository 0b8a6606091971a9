"""Quality classifier: regularised quadratic discriminant over document statistics.

Every document becomes a short vector of transformed statistics of its whole
text. Each class gets a mean and a covariance shrunk towards the pooled
covariance and towards a multiple of the identity; scores are differences of
Gaussian log-densities, the Mahalanobis distances coming from Cholesky factors
that are computed once, when the model is fitted.

A null text counts as empty; empty texts have a defined vector and so a score.
Rows whose label is null, or whose id has no label, teach nothing; repeated
rows are scored alike, and a repeated label row counts once for each copy.
An empty table gives an empty result; with fewer than two classes to learn
every score is the share of label 1 among the labels (0.5 without labels).
Only the id, the text and the label are read, so other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm import common

#: Labelled rows the classifier is fitted on, at most; chosen by a hash of the id.
FIT_ROWS = 20_000
#: Shares of the pooled covariance and of the scaled identity in a class covariance.
POOLED, RIDGE = 0.25, 0.02
THRESHOLD = 0.3

NAMES = ["bytes", "words", "word_length", "upper", "digits", "symbols", "stops", "marks", "lines", "distinct", "packed"]


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_UPPER, _DIGIT = _class(common.UPPER), _class("0123456789")
_SYMBOL, _STOP, _MARK, _LINE = _class("#$%&*+/<=>@\\^_`{|}~"), _class(".,;:"), _class("!?"), _class("\n")


def features(column: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    data, offsets = common.text_bytes(column)
    words, order, per_text = common.words_of(data, offsets)
    n_bytes, n_words = np.diff(offsets), np.diff(per_text)
    letters = common.sum_by_text(~common.SPACE[data], offsets)
    # few words say little, so shares start from a usual rate that counts as some letters or words
    share = lambda table, of, rate, weight: np.sqrt((common.sum_by_text(table[data], offsets) + rate * weight) / (of + weight))
    owner = np.repeat(np.arange(len(n_words)), n_words)
    pairs = np.unique(owner * max(len(words), 1) + order)
    distinct = np.bincount(pairs // max(len(words), 1), minlength=len(n_words))
    packed = np.array([len(zlib.compress(data[a:b], 1)) for a, b in zip(offsets[:-1], offsets[1:])], float)
    return np.column_stack(
        [
            np.log1p(n_bytes),
            np.log1p(n_words),
            np.log((letters + 120.0) / (n_words + 20.0)),
            share(_UPPER, letters, 0.02, 100),
            share(_DIGIT, letters, 0.01, 100),
            share(_SYMBOL, letters, 0.002, 100),
            share(_STOP, n_words, 0.15, 20),
            share(_MARK, n_words, 0.0, 20),
            share(_LINE, n_words, 0.01, 20),
            np.log((distinct + 20.0) / (n_words + 20.0)),
            np.log((packed + 120.0) / (n_bytes + 240.0)),
        ]
    )


@dataclass
class Model:
    prior: float
    mean: np.ndarray | None = None
    #: inverse Cholesky factor of each class covariance
    whiten: np.ndarray | None = None
    half_log_det: np.ndarray | None = None
    scale: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.prior)
        x = (x - self.scale[0]) / self.scale[1]
        log_density = [-0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) - d for m, w, d in zip(self.mean, self.whiten, self.half_log_det)]
        return 1.0 / (1.0 + np.exp(-np.clip(log_density[1] - log_density[0] + np.log(self.prior / (1 - self.prior)), -500, 500)))


def fit_arrays(x: np.ndarray, y: np.ndarray, pooled: float = POOLED, ridge: float = RIDGE) -> Model:
    counts = np.bincount(y, minlength=2)
    prior = float((counts[1] + 0.5) / (len(y) + 1.0))
    if counts.min() < 2:
        return Model(prior)
    scale = np.stack([x.mean(axis=0), x.std(axis=0) + 1e-3])
    x = (x - scale[0]) / scale[1]
    mean = np.stack([x[y == k].mean(axis=0) for k in (0, 1)])
    own = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    both = sum(c * n for c, n in zip(own, counts)) / len(y)
    factors = [np.linalg.cholesky((1 - pooled - ridge) * c + pooled * both + ridge * np.trace(both) / len(both) * np.eye(len(both))) for c in own]
    return Model(prior, mean, np.stack([np.linalg.inv(f) for f in factors]), np.array([np.log(np.diag(f)).sum() for f in factors]), scale)


def _with_features(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + ", _x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            x = features(batch.column(batch.num_columns - 1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], flat], [*keep, "_x"])

    return df.select(*keep, F.col(text_col).cast("string").alias("_quality_text")).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, *, learn: Column | None = None, id_col="doc_id", text_col="text", label_col="quality", fit_rows=FIT_ROWS) -> Model:
    """``learn`` is a condition on the label rows. The chosen ids are at most ``fit_rows``, so they are broadcast."""
    labels = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if learn is not None:
        labels = labels.where(learn)
    labels = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    chosen = common.hashed_share(labels, F.xxhash64(F.col("_id").cast("string"), F.lit("quality")), fit_rows, labels.count())
    joined = docs.select(F.col(id_col).alias("_id"), text_col).join(F.broadcast(chosen), "_id").select("_y", text_col)
    rows = _with_features(joined, ["_y"], text_col).collect()
    return fit_arrays(np.array([r["_x"] for r in rows]).reshape(-1, len(NAMES)), np.array([r["_y"] for r in rows], int))


def predict(docs: DataFrame, model: Model, *, id_col="doc_id", text_col="text", threshold=THRESHOLD) -> DataFrame:
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(id_col).dtypes) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            score = model.score(features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("_quality_text")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.read(spark, sf_dir, "labels").select("doc_id", "quality"), learn=common.id_remainder(F.col("doc_id"), 5) != 0)
    return predict(docs, model).select("doc_id", (common.id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
