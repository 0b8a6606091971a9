"""Splits without leakage: random, stratified, by group, by time.

A split is a column: ``part`` is train, validation or test. Rows are ordered by
a portable hash of their key and a seed, so the same rows fall on the same side
on any cluster, and sizes are exact. Only counts per class, group or bucket of
the hash meet in one place, never the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.columns import col, portable_hash
from millwright.functions.constants import SEED
from millwright.functions.ordered import running
from millwright.functions.report import require

#: Buckets of the hash by which ranks are found in two steps.
BUCKETS = 1024


def row_key(df: DataFrame) -> Column:
    """All columns as text: the default key of a row. Equal rows are ordered arbitrarily, which does not matter."""
    return F.to_json(F.struct(*(col(c) for c in df.columns)))


def ranked(df: DataFrame, seed: int, by: list[str] | None = None, key: Column | None = None, to: str = "_rank") -> DataFrame:
    """Adds the 1-based rank of each row in hash order within ``by``.

    Rows are counted by bucket of the hash; a window over the counts gives each
    bucket's offset, and a window within the bucket the rest, so even one large
    class is ranked by many tasks.
    """
    by = list(by or [])
    rows = df.withColumn("_h", portable_hash(F.lit(seed), key if key is not None else row_key(df)))
    rows = rows.withColumn("_bucket", F.floor(F.col("_h") / (2**32 // BUCKETS)).cast("int"))
    counts = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*(col(c).alias(f"_o_{c}") for c in by), F.col("_bucket").alias("_o_bucket"), before.alias("_offset"))
    on = F.col("_bucket") == F.col("_o_bucket")
    for c in by:
        on = on & col(c).eqNullSafe(F.col(f"_o_{c}"))
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_h", key if key is not None else F.lit(0)))
    return rows.withColumn("_in", inside).join(offsets, on).withColumn(to, F.col("_offset") + F.col("_in")).drop("_h", "_bucket", "_in", "_offset", "_o_bucket", *(f"_o_{c}" for c in by))


def _size(value, n: int) -> int:
    """Rows of a share (rounded up) or a count."""
    return math.ceil(value * n - 1e-9) if isinstance(value, float) else int(value)


def random_split(df: DataFrame, target_col: str | None, test_size: float | int, seed: int = SEED, key: Column | None = None) -> DataFrame:
    """``part`` with exactly the size asked for; with a target, its classes share it by largest remainder."""
    if target_col is None:
        n = df.count()
        return ranked(df, seed, key=key).withColumn("part", F.when(F.col("_rank") <= _size(test_size, n), "test").otherwise("train")).drop("_rank")
    counts = df.groupBy(col(target_col).alias("_class")).agg(F.count("*").alias("n")).collect()
    n = sum(r["n"] for r in counts)
    total = _size(test_size, n)
    exact = {r["_class"]: total * r["n"] / n for r in counts}
    quota = {k: math.floor(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (quota[k] - exact[k], str(k)))[: total - sum(quota.values())]:
        quota[k] += 1
    spark, kind = df.sparkSession, df.schema[target_col].dataType.simpleString()
    table = spark.createDataFrame([(k, v) for k, v in quota.items()], f"_class {kind}, _quota long")  # one row for each class
    rows = ranked(df, seed, [target_col], key).join(table, col(target_col).eqNullSafe(F.col("_class")))
    return rows.withColumn("part", F.when(F.col("_rank") <= F.col("_quota"), "test").otherwise("train")).drop("_rank", "_class", "_quota")


def group_parts(df: DataFrame, group_col: str, rows_wanted: float, seed: int = SEED) -> DataFrame:
    """(group, n, part): groups in hash order go to test until enough rows are there; one group at least stays in train."""
    counts = df.groupBy(col(group_col).alias("_group")).agg(F.count("*").alias("n"))
    h = portable_hash(F.lit(seed), F.col("_group").cast("string"))
    counts = counts.withColumns({"_h": h, "_name": F.col("_group").cast("string"), "_one": F.lit(1)})
    rows = running(counts, "_h", {"_upto": "n", "_rank": "_one"}, part=F.floor(F.col("_h") / (2**32 // BUCKETS)).cast("int"), then=["_name"])
    rows = rows.join(F.broadcast(counts.agg(F.count("*").alias("_groups"))), F.lit(True))  # one row
    return rows.withColumn("part", F.when((F.col("_upto") - F.col("n") < rows_wanted - 1e-9) & (F.col("_rank") < F.col("_groups")), "test").otherwise("train")).drop("_h", "_name", "_one", "_upto", "_rank", "_groups")


def time_cut(df: DataFrame, time_col: str, n_test: int):
    """The first time of the test part: that of the row after the training rows, so no time falls on both sides. Null times are last."""
    nulls = df.where(col(time_col).isNull()).count()
    if nulls >= n_test:
        return df.where(col(time_col).isNull()).select(col(time_col).alias("t")).first()
    counts = df.where(col(time_col).isNotNull()).groupBy(col(time_col).alias("t")).agg(F.count("*").alias("n"))
    after = running(counts, "t", {"upto": "n"}, descending=True).where(F.col("upto") >= n_test - nulls)
    return after.agg(F.max("t").alias("t"), F.count("*").alias("n")).where("n > 0").select("t").first()


def _checked(df: DataFrame, target_col: str, test_size, random_state, group_col, time_col) -> tuple[DataFrame, float | int]:
    require(df, "df", target_col, *(c for c in (group_col, time_col) if c is not None))
    if isinstance(test_size, bool) or not isinstance(test_size, (int, float)) or (isinstance(test_size, int) and test_size < 1) or (isinstance(test_size, float) and not 0 < test_size < 1):
        raise ValueError(f"test_size must be a share between 0 and 1 or a positive number of rows, got {test_size!r}.")
    if isinstance(random_state, bool) or not isinstance(random_state, int):
        raise ValueError(f"random_state must be an integer, got {random_state!r}.")
    if group_col is not None and time_col is not None:
        raise ValueError("group_col asks about an unseen group and time_col about a later period; choose one.")
    rows = df.where(col(target_col).isNotNull())
    if not rows.take(1):
        raise ValueError("No rows have a target.")
    return rows, test_size


def with_parts(df: DataFrame, target_col: str, task="classification", test_size: float | int = 0.2, random_state: int = SEED, group_col=None, time_col=None, key: Column | None = None) -> DataFrame:
    """Rows with a target and their ``part``."""
    rows, size = _checked(df, target_col, test_size, random_state, group_col, time_col)
    if group_col is not None:
        if rows.select(col(group_col)).distinct().limit(2).count() < 2:
            raise ValueError(f"Group column '{group_col}' has fewer than 2 groups.")
        parts = group_parts(rows, group_col, size * rows.count() if isinstance(size, float) else size, random_state)
        return rows.join(parts.drop("n"), col(group_col).eqNullSafe(F.col("_group"))).drop("_group")
    if time_col is not None:
        n = rows.count()
        n_test = round(size * n) if isinstance(size, float) else int(size)
        cut = time_cut(rows, time_col, n_test) if 0 < n_test < n else None
        if cut is None:
            raise ValueError(f"There are too few rows or distinct times for test_size={test_size!r}.")
        test = col(time_col).isNull() if cut["t"] is None else F.coalesce(col(time_col) >= F.lit(cut["t"]).cast(rows.schema[time_col].dataType), F.lit(True))
        out = rows.withColumn("part", F.when(test, "test").otherwise("train"))
        if not out.where("part = 'train'").take(1):
            raise ValueError(f"There are too few distinct times for test_size={test_size!r}: no row would stay in train.")
        return out
    stratify = task == "classification"
    if stratify:
        least = rows.groupBy(col(target_col)).count().agg(F.min("count").alias("least"), F.count("*").alias("classes")).first()
        stratify = least["classes"] > 1 and least["least"] > 1
    return random_split(rows, target_col if stratify else None, size, random_state, key)


def tail_split(df: DataFrame, target_col: str, order_col: str, test_size: float | int = 0.2) -> DataFrame:
    """Forecasting: the last rows in order are the test part, without shuffling."""
    rows, size = _checked(df, target_col, test_size, SEED, None, None)
    n = rows.count()
    keyed = rows.withColumn("_k", col(order_col))
    counts = keyed.where("_k is not null").groupBy("_k").agg(F.count("*").alias("n"))
    cut = running(counts, "_k", {"upto": "n"}, descending=True).where(F.col("upto") >= _size(size, n)).agg(F.max("_k").alias("cut"))
    # the cut is one row; without one, too few rows have a place in the order, and all are tested
    test = F.coalesce(F.col("_k") >= F.col("cut"), F.col("cut").isNull())
    return keyed.join(F.broadcast(cut), F.lit(True)).withColumn("part", F.when(test, "test").otherwise("train")).drop("_k", "cut")


def _unpack(parts: DataFrame, target_col: str, names: tuple[str, ...], drop: str | None) -> tuple[DataFrame, ...]:
    x = [parts.where(F.col("part") == p).drop("part", target_col, *[drop] * (drop is not None)) for p in names]
    y = [parts.where(F.col("part") == p).select(target_col) for p in names]
    return (*x, *y)


def split_data(df: DataFrame, target_col: str, task="classification", test_size: float | int = 0.2, random_state: int = SEED, group_col=None, time_col=None, drop_group_col: bool = True) -> tuple[DataFrame, ...]:
    """X_train, X_test, y_train, y_test. Bad arguments raise."""
    return _unpack(with_parts(df, target_col, task, test_size, random_state, group_col, time_col), target_col, ("train", "test"), group_col if drop_group_col else None)


def three_parts(df: DataFrame, target_col: str, task="classification", val_size=0.2, test_size=0.2, random_state: int = SEED, group_col=None, time_col=None) -> DataFrame:
    """Rows with part train, validation or test: the test part first, then the validation part as a number of rows of the rest."""
    if isinstance(val_size, bool) or not isinstance(val_size, (int, float)) or not 0 < float(val_size) < 1:
        raise ValueError(f"val_size must be a share between 0 and 1, got {val_size!r}.")
    if float(val_size) + float(test_size) >= 1:
        raise ValueError(f"val_size + test_size must be below 1 (got {val_size!r} + {test_size!r}).")
    first = with_parts(df, target_col, task, test_size, random_state, group_col, time_col)
    counts = {r["part"]: r["count"] for r in first.groupBy("part").count().collect()}
    n_val = round(float(val_size) * sum(counts.values()))
    if n_val < 1:
        raise ValueError(f"val_size={val_size!r} leaves no validation rows.")
    if n_val >= counts.get("train", 0):
        raise ValueError(f"val_size={val_size!r} would take all {counts.get('train', 0)} training rows.")
    pool = with_parts(first.where("part = 'train'").drop("part"), target_col, task, n_val, random_state, group_col, time_col)
    return pool.withColumn("part", F.when(F.col("part") == "test", "validation").otherwise("train")).unionByName(first.where("part = 'test'"))


def split_data_three_way(df: DataFrame, target_col: str, task="classification", val_size=0.2, test_size=0.2, random_state: int = SEED, group_col=None, time_col=None, drop_group_col: bool = True) -> tuple[DataFrame, ...]:
    """X_train, X_val, X_test, y_train, y_val, y_test."""
    return _unpack(three_parts(df, target_col, task, val_size, test_size, random_state, group_col, time_col), target_col, ("train", "validation", "test"), group_col if drop_group_col else None)
