"""Approximate nearest neighbours: randomly rotated one-bit codes.

The index holds, for every distinct vector, the sign bits of its randomly
rotated residual against a cell's centroid, packed to bytes, and two correction
scalars: the residual's norm and its inner product with its own code. From bits
and scalars an unbiased estimate of a query's inner product follows, with an
error bound; a vector is reranked on its original components only if its lower
bound of the distance beats the k-th smallest upper bound seen so far.

Cells bound the work: a query visits the nearest cells only. Centroids are
k-means centres of a bounded sample (SAMPLE rows by hash); every row is
indexed. A cell with many vectors is dealt in blocks of BLOCK rows by a hash,
so no cell meets in one task; a query is sent to each block of its cells and
only its k best of each block return.

Copies of one vector are indexed once with their K + 1 smallest ids, which is
all that any query can return; equal queries are searched once.

Null vectors, zero vectors, vectors with null or non-finite components, and
those with null ids take no part, neither as queries nor as candidates; vectors
of another length than most are left out likewise. Repeated (id, vector) rows
count once. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm import common

K = 10
QUERY_EVERY = 100
#: Rows the centroids are fitted on, at most; vectors aimed at in a cell; bounds on the number of cells; cells a query visits.
SAMPLE, PER_CELL, MAX_CELLS = 20_000, 512, 4096
PROBE_SHARE, PROBE_LEAST = 0.75, 24
#: Rows of a cell that are searched together.
BLOCK = 8192
#: Standard deviations that the error bound allows.
EPSILON = 3.0
SEED = 7


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, cells: int, seed: int = SEED, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    if len(sample) <= cells:
        return sample.copy()
    centre = sample[np.sort(rng.choice(len(sample), cells, replace=False))].copy()
    for _ in range(rounds):
        near = nearest(sample, centre, 1)[:, 0]
        count = np.bincount(near, minlength=cells)
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        centre[count > 0] = total[count > 0] / count[count > 0, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first; rows are taken in blocks."""
    out = []
    square = (centre**2).sum(axis=1)
    for i in range(0, len(x), 1024):
        d = square - 2 * (x[i : i + 1024] @ centre.T)
        part = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
        out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, n), int)


def encode(residual: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, norms and inner products of unit residuals with their codes."""
    d = residual.shape[1]
    norm = np.linalg.norm(residual, axis=1)
    unit = residual / np.maximum(norm, 1e-30)[:, None] @ turn
    bits = unit >= 0
    own = np.abs(unit).sum(axis=1) / np.sqrt(d)
    return np.packbits(bits, axis=1), norm, np.where(norm > 0, own, 1.0)


def estimate(query: np.ndarray, bits: np.ndarray, norm: np.ndarray, own: np.ndarray, turn: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of squared distances between query residuals (rows) and coded residuals (columns)."""
    d = query.shape[1]
    length = np.linalg.norm(query, axis=1)
    unit = (query / np.maximum(length, 1e-30)[:, None] @ turn).astype(np.float32)
    signs = (np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))
    inner = (unit @ signs.T).astype(np.float64) / own
    error = epsilon * np.sqrt(np.maximum(1 - own**2, 0) / own**2) / np.sqrt(max(d - 1, 1)) + 1e-6
    base = length[:, None] ** 2 + norm**2
    both = 2 * length[:, None] * norm
    return base - both * np.minimum(inner + error, 1), base - both * np.maximum(inner - error, -1)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in column]) if len(column) else np.zeros((0, 0))


def valid(vec: Column) -> Column:
    """Neither null nor zero, all components finite."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(good, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def search(vectors: DataFrame, queries: Column, *, id_col="vec_id", vector_col="embedding", k=K, probe: int | None = None, seed=SEED) -> DataFrame:
    """query_id, rank, <id>, score for the rows where ``queries`` holds, against all rows but a query's own."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & valid(F.col("v")))
    # lengths are counted over all rows; the most frequent, the least of equal ones, is the dimension
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("d"), F.max("n").alias("n")).first()
    d, total = sizes["d"] or 1, sizes["n"] or 0
    rows = rows.where(F.size("v") == d)
    sample = common.hashed_share(rows.select("v", "id"), F.xxhash64("id", F.lit(seed)), SAMPLE, total).select("v").collect()
    sampled = np.unique(np.array([r["v"] for r in sample]).reshape(-1, d), axis=0)
    centre = centroids(sampled, int(np.clip(total // PER_CELL, 1, min(MAX_CELLS, max(len(sampled), 1)))), seed)
    turn = rotation(d, seed)
    n_probe = probe or int(min(len(centre), max(PROBE_LEAST, round(PROBE_SHARE * len(centre)))))
    shared = spark.sparkContext.broadcast((centre, turn))  # at most MAX_CELLS rows

    # one entry for each distinct vector: the ids that a query could return, and the ids that ask
    key = F.sha2(F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), ","), 256)
    keyed = rows.select("id", "v", "q", key.alias("key"))
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("n") <= k + 1)
    distinct = first.groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("v").alias("v"))
    asking = keyed.where("q").select("id", "key").distinct()
    asked = keyed.where("q").groupBy("key").agg(F.first("v").alias("v"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, turn = shared.value
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, d)
            cell = nearest(x, centre, 1)[:, 0] if len(x) else np.zeros(0, int)
            bits, norm, own = encode(x - centre[cell], turn)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(cell, pa.int32()), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(norm), pa.array(own)],
                ["key", "v", "ids", "cell", "bits", "norm", "own"],
            )

    index = distinct.select("key", "v", "ids").mapInArrow(coded, "key string, v array<double>, ids array<bigint>, cell int, bits binary, norm double, own double")
    index = common.checkpoint(index)
    blocks = index.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # at most MAX_CELLS rows
    count = np.zeros(max(len(centre), 1), int)
    for r in blocks.collect():
        count[r["cell"]] = r["blocks"]
    deal = spark.sparkContext.broadcast(count)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, _ = shared.value
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, d)
            cells = nearest(x, centre, n_probe) if len(x) else np.zeros((0, 1), int)
            times = deal.value[cells]
            row = np.repeat(np.arange(len(x)), times.sum(axis=1))
            cell = np.repeat(cells.ravel(), times.ravel())
            start = np.cumsum(times.ravel()) - times.ravel()
            block = np.arange(len(cell)) - np.repeat(start, times.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(cell, pa.int32()), pa.array(block, pa.int32())], ["key", "v", "cell", "block"])

    def best(group, stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qkey": pd.Series(dtype=str), "key": pd.Series(dtype=str), "ids": pd.Series(dtype=object), "d2": pd.Series(dtype=float)})
        if not len(stored) or not len(asked):
            return empty
        centre, turn = shared.value
        origin = centre[int(stored["cell"].iloc[0])]
        x = _matrix(stored["v"])
        bits = np.frombuffer(b"".join(stored["bits"]), np.uint8).reshape(len(x), -1)
        norm, own, copies = stored["norm"].to_numpy(), stored["own"].to_numpy(), np.array([len(i) for i in stored["ids"]])
        out = []
        for i in range(0, len(asked), 256):
            part = asked.iloc[i : i + 256]
            q = _matrix(part["v"])
            low, high = estimate(q - origin, bits, norm, own, turn)
            want = min(k + 1, len(x)) - 1
            bar = np.partition(high, want, axis=1)[:, want]
            for j, name in enumerate(part["key"]):
                rows = np.flatnonzero(low[j] <= bar[j])
                exact = ((x[rows] - q[j]) ** 2).sum(axis=1)
                keep = rows[exact <= np.partition(exact, min(k, len(rows) - 1))[min(k, len(rows) - 1)]]
                exact = ((x[keep] - q[j]) ** 2).sum(axis=1)
                out.append(pd.DataFrame({"qkey": name, "key": stored["key"].to_numpy()[keep], "ids": stored["ids"].to_numpy()[keep], "d2": exact}))
        return pd.concat(out) if out else empty

    dealt = index.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    sent = asked.select("key", "v").mapInArrow(visits, "key string, v array<double>, cell int, block int")
    found = (
        dealt.select("cell", "block", "key", "v", "ids", "bits", "norm", "own")
        .groupBy("cell", "block")
        .cogroup(sent.groupBy("cell", "block"))
        .applyInPandas(best, "qkey string, key string, ids array<bigint>, d2 double")
    )
    near = found.withColumn("n", F.row_number().over(Window.partitionBy("qkey").orderBy("d2", F.col("ids")[0]))).where(F.col("n") <= k + 1)
    lists = near.select("qkey", "d2", F.explode("ids").alias("found")).withColumn("n", F.row_number().over(Window.partitionBy("qkey").orderBy("d2", "found"))).where(F.col("n") <= k + 1)
    lists = lists.groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct("d2", "found"))).alias("list"))
    own = F.filter("list", lambda e: e["found"] != F.col("id"))
    answers = asking.join(lists, asking["key"] == lists["qkey"]).select(F.col("id").alias("query_id"), F.posexplode(F.slice(own, 1, k)).alias("pos", "hit"))
    return answers.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.found").alias(id_col), F.sqrt("hit.d2").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % QUERY_EVERY == 0)
