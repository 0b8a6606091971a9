"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (columns a, b) reaches.

    Large-star and small-star alternate up to the fixed point: a logarithmic
    number of rounds, each linear in the edges, each written to reliable
    storage. Smallest neighbours are found by partial aggregates, and the joins
    with them can be split where a node has many neighbours. Edges that one task
    holds with ease are joined there.
    """
    e = common.checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, now = None, _state(e, common.counted(e))
    while now[0] and now != before:
        both = common.gathered(e, now[0]).select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        e = common.checkpoint(small.where("u <> v").distinct())
        del both, least, large, small
        common.release(edges.sparkSession)
        before, now = now, _state(e, now[0])
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))
    return common.gathered(e, now[0]).select(F.inline(ends)).distinct()


def _state(e: DataFrame, rows: int) -> tuple:
    return tuple(common.gathered(e, rows).agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
