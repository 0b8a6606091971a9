"""Running sums, ranks and quantiles over ordered values, exact, without one task that sees all of them.

The values are cut into as many ranges as the session's shuffles have
partitions, at approximate quantiles. A window runs inside each range, and the
totals of the ranges, a bounded table, give the offsets between them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges at most: the cuts become one expression.
MOST_PARTS = 256


def position(df: DataFrame, name: str) -> Column:
    """A number that never falls as the column rises: it only places values in ranges, so ties of different values do no harm."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return c.cast("double")


def cuts(df: DataFrame, columns: dict[str, Column]) -> dict[str, list[float]]:
    """Ascending cuts of each column into ranges, by approximate quantiles of one pass."""
    parts = min(MOST_PARTS, max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    probs = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    found = df.agg(*(F.percentile_approx(F.when(~F.isnan(c), c), probs, 20 * parts).alias(k) for k, c in columns.items())).first()
    return {k: sorted(set(found[k] or ())) for k in columns}


def part_of(c: Column, at: Sequence[float]) -> Column:
    """How many cuts a value reaches, as a balanced tree of comparisons; null is before all, NaN behind."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(c < F.lit(at[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return F.when(c.isNull(), -1).otherwise(tree(0, len(at)))


def running(df: DataFrame, order: str, sums: dict[str, str], by: Sequence[str] = (), descending: bool = False, part: Column | None = None, then: Sequence[str] = ()) -> DataFrame:
    """``df`` with running sums in order of a column, rows of one value included together, within ``by``.

    ``sums`` maps new names to summed columns. ``part`` is a column that rises
    with the order, in place of quantile ranges; ``then`` breaks ties.
    """
    if part is None:
        at = position(df, order)
        part = part_of(at, cuts(df, {"at": at})["at"])
    keyed = df.withColumn("_part", part)
    totals = keyed.groupBy(*by, "_part").agg(*(F.sum(v).alias(f"_t_{k}") for k, v in sums.items()))
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    before = Window.partitionBy(*by).orderBy(turn("_part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(b).alias(f"_o_{b}") for b in by), F.col("_part").alias("_o_part"), *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums))
    inside = Window.partitionBy(*by, "_part").orderBy(turn(order), *then)
    on = F.col("_part") == F.col("_o_part")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_o_{b}"))
    rows = keyed.withColumns({f"_i_{k}": F.sum(v).over(inside) for k, v in sums.items()}).join(offsets, on)
    rows = rows.withColumns({k: F.col(f"_i_{k}") + F.col(f"_o_{k}") for k in sums})
    return rows.drop("_part", "_o_part", *(f"_o_{b}" for b in by), *(f"_{x}_{k}" for k in sums for x in ("i", "o")))


def quantiles(df: DataFrame, value: str, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by columns, n and ``q``: the exact quantiles of the known values, by linear interpolation, for each group that has any."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    upto = running(counts, value, {"_upto": "_n"}, by)
    total = counts.groupBy(*(F.col(b).alias(f"_t_{b}") for b in by)).agg(F.sum("_n").alias("n"))
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_t_{b}"))
    rows = upto.join(F.broadcast(total) if not by else total, on)  # without groups the total is one row
    place = lambda f: (F.col("n") - 1) * F.lit(float(f))
    first = lambda at: F.min(F.when(F.col("_upto") > at, F.col(value)))
    found = rows.groupBy(*by, "n").agg(*(first(g(place(f))).alias(f"_{k}{i}") for i, f in enumerate(fractions) for k, g in (("a", F.floor), ("b", F.ceil))))

    def between(i: int, f: float) -> Column:
        a, b, p = F.col(f"_a{i}"), F.col(f"_b{i}"), place(f)
        return F.when(a == b, a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b)

    return found.select(*by, "n", F.array(*(between(i, f) for i, f in enumerate(fractions))).alias("q"))
