"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Every source is dealt, by a hash of the id, into a fixed number of blocks in a
permuted order. A source's target in words becomes an exact number of blocks to
draw (whole passes over the source, then blocks of the next pass; the block at
the edge is cut at a finer hash). A binary tree over the output shards splits
these block quotas: at each node half of the draws, a uniformly random half,
go left, so the left quotas of the sources follow the multivariate
hypergeometric law. Each leaf's quota of a source is a run of the source's
permuted blocks, the runs of the shards follow each other, and a document is
taken where its block lies in some shard's run. No two shards share a draw; a
shard orders its rows by a hash.

All steps are DataFrame expressions. Only the per-source plan (one row per
source) is joined to the rows; Spark broadcasts it if its measured size allows
and sorts and splits skewed joins otherwise. A hot source is no single group
anywhere: block sums are pre-aggregated by (source, block). The tree ranks at
most MOST * BLOCKS draws of each source in its root; documents do not matter.

A null source is a source of its own, ordered last. Null texts and empty texts
have size 0 and are taken at no cost. A null id hashes like the empty string.
Repeated rows fall into the same block and are taken alike. A table without
words gives targets of 0; an empty table gives an empty result. Columns that
are not asked for are not read; internal names start with ``_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm import common

WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and a target's bound as a multiple of its source.
SHARE, MOST = 1.5, 2
BLOCKS, BINS = 256, 256
SHARDS = 16


def _hash(*parts: Column | str) -> Column:
    """32 bits of md5, which every SQL engine has."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _placed(id_col: str, source_col: str) -> dict[str, Column]:
    """A row's source, permuted block and bin."""
    h, source = _hash("mix", F.col(id_col)), F.col(source_col).cast("string")
    turn, shift = _hash("turn", source) % (BLOCKS // 2) * 2 + 1, _hash("shift", source) % BLOCKS
    return {"source": source, "block": ((h % BLOCKS * turn + shift) % BLOCKS).cast("int"), "bin": (F.floor(h / BLOCKS) % BINS).cast("int")}


def sized(docs: DataFrame, *, id_col="doc_id", source_col="source", text_col="text") -> DataFrame:
    """Id, source, size in words, permuted block and bin of every row."""
    placed = (x.alias(f"_mix_{c}") for c, x in _placed(id_col, source_col).items())
    return docs.select(F.col(id_col).alias("_mix_id"), common.word_count(F.col(text_col).cast("string")).alias("_mix_size"), *placed)


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """One row per source with its size and target: weights repeat in source order, and what a bounded target cannot hold is shared among the others by weight.

    With sources in order of bound / weight the level at which the others meet
    the total is known for each split; the first level within its own bound is
    the fixed point of resharing.
    """
    by_source = sizes.groupBy("_mix_source").agg(F.sum("_mix_size").alias("_mix_source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("_mix_source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("double")
    ranked = by_source.select("*", rank.alias("_mix_rank"), weight.alias("_mix_weight"), (F.col("_mix_source_size") * float(most)).alias("_mix_bound"))
    order = Window.orderBy(F.col("_mix_bound") / F.col("_mix_weight"), "_mix_rank")
    total = Window.partitionBy()
    full = F.coalesce(F.sum("_mix_bound").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_mix_weight").over(total) - F.coalesce(F.sum("_mix_weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("_mix_source_size").over(total) * share - full) / rest
    fits = F.when(F.col("_mix_level") <= F.col("_mix_bound") / F.col("_mix_weight"), F.col("_mix_level"))
    return (
        ranked.withColumn("_mix_level", level)
        .withColumn("_mix_level", F.coalesce(F.min_by("_mix_level", F.when(fits.isNotNull(), F.col("_mix_bound") / F.col("_mix_weight"))).over(total), F.max("_mix_level").over(total)))
        .select("_mix_source", "_mix_rank", "_mix_source_size", F.least(F.col("_mix_bound"), F.col("_mix_level") * F.col("_mix_weight")).alias("_mix_target"))
    )


def quotas(sizes: DataFrame, by_source: DataFrame) -> DataFrame:
    """Per source: whole passes, blocks drawn whole in the next pass, and bins drawn from the block after those."""
    size, target = F.col("_mix_source_size"), F.col("_mix_target")
    passes = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("int")
    plan = by_source.withColumn("_mix_passes", passes).withColumn("_mix_rest", F.when(size > 0, target - size * F.col("_mix_passes")).otherwise(0.0))
    blocks = sizes.groupBy("_mix_source", "_mix_block").agg(F.sum("_mix_size").alias("_mix_words"))
    ends = F.sum("_mix_words").over(Window.partitionBy("_mix_source").orderBy("_mix_block"))
    edge = (
        plan.join(blocks.withColumn("_mix_end", ends).withColumnRenamed("_mix_source", "_mix_of"), F.col("_mix_source").eqNullSafe(F.col("_mix_of")), "left")
        .groupBy("_mix_source", "_mix_rank", "_mix_source_size", "_mix_target", "_mix_passes", "_mix_rest")
        .agg(F.min(F.when(F.col("_mix_end") > F.col("_mix_rest"), F.col("_mix_block"))).alias("_mix_edge"), F.max(F.when(F.col("_mix_end") <= F.col("_mix_rest"), F.col("_mix_end"))).alias("_mix_before"))
        .withColumn("_mix_edge", F.coalesce("_mix_edge", F.lit(BLOCKS)))
        .withColumn("_mix_before", F.coalesce("_mix_before", F.lit(0)))
    )
    edge = common.checkpoint(edge)  # one row per source
    at = edge.select(F.col("_mix_source").alias("_mix_of"), F.col("_mix_edge"), F.col("_mix_rest"), F.col("_mix_before"))
    bins = (
        sizes.join(at, F.col("_mix_source").eqNullSafe(F.col("_mix_of")) & (F.col("_mix_block") == F.col("_mix_edge")))
        .groupBy("_mix_of", "_mix_bin", "_mix_rest", "_mix_before")
        .agg(F.sum("_mix_size").alias("_mix_words"))
    )
    middle = F.sum("_mix_words").over(Window.partitionBy("_mix_of").orderBy("_mix_bin")) - F.col("_mix_words") / 2
    limits = bins.withColumn("_mix_middle", middle).groupBy("_mix_of").agg(F.max(F.when(F.col("_mix_before") + F.col("_mix_middle") <= F.col("_mix_rest"), F.col("_mix_bin") + 1)).alias("_mix_bins"))
    drawn = F.col("_mix_passes") * BLOCKS + F.when(F.col("_mix_passes") < MOST, F.col("_mix_edge") + F.when(F.col("_mix_bins") > 0, 1).otherwise(0)).otherwise(0)
    return (
        edge.join(limits, F.col("_mix_source").eqNullSafe(F.col("_mix_of")), "left")
        .drop("_mix_of")
        .withColumn("_mix_bins", F.coalesce("_mix_bins", F.lit(0)))
        .withColumn("_mix_drawn", drawn.cast("long"))
    )


def halve(draws: DataFrame, seed: int = 1) -> DataFrame:
    """The draws (node, rank, number) one level further down: a random half of each node's draws, by order of a hash, goes left (2 * node), the others right."""
    turn = Window.partitionBy("node").orderBy(_hash(f"tree{seed}", F.col("node"), F.col("rank"), F.col("number")), "rank", "number")
    left = F.row_number().over(turn) <= F.floor(F.count("*").over(Window.partitionBy("node")) / 2)
    return draws.withColumn("node", F.col("node") * 2 + F.when(left, 0).otherwise(1))


def split(plan: DataFrame, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """(rank, cuts): per source, the draw numbers at which each shard's run of draws ends. ``shards`` is a power of two."""
    depth = shards.bit_length() - 1
    if 1 << depth != shards:
        raise ValueError("shards must be a power of two")
    numbers = F.when(F.col("_mix_drawn") > 0, F.sequence(F.lit(0).cast("long"), F.col("_mix_drawn") - 1))
    draws = plan.select(F.lit(1).cast("long").alias("node"), F.col("_mix_rank").alias("rank"), F.explode(numbers).alias("number"))
    for _ in range(depth):
        draws = halve(draws, seed)
    quotas = draws.groupBy("rank").agg(*(F.count(F.when(F.col("node") == shards + i, 1)).alias(f"q{i}") for i in range(shards)))
    cuts = F.array(*(sum((F.col(f"q{j}") for j in range(1, i + 1)), F.col("q0")) for i in range(shards)))
    ranks = plan.select(F.col("_mix_rank").alias("_mix_rank_of"))
    found = ranks.join(quotas, F.col("_mix_rank_of") == F.col("rank"), "left")
    return found.select("_mix_rank_of", F.coalesce(F.when(F.col("rank").isNotNull(), cuts), F.array(*[F.lit(0).cast("long")] * shards)).alias("_mix_cuts"))


def plan(docs: DataFrame, *, id_col="doc_id", source_col="source", text_col="text", weights=WEIGHTS, share=SHARE, shards=SHARDS, seed=1) -> tuple[DataFrame, DataFrame]:
    """The sized rows (written once, without texts) and one row per source with everything that decides its draws."""
    sizes = common.checkpoint(sized(docs, id_col=id_col, source_col=source_col, text_col=text_col))
    per_source = quotas(sizes, targets(sizes, weights, share))
    per_source = common.checkpoint(per_source)
    cuts = split(per_source, shards, seed)
    return sizes, common.checkpoint(per_source.join(cuts, F.col("_mix_rank") == F.col("_mix_rank_of"), "left").drop("_mix_rank_of"))


def draws(id_col: Column, block: Column, bin_: Column, seed: int = 1) -> Column:
    """The draws of a row as (copy, shard, order): those whose number lies in some shard's run of its source's blocks.

    Of the block at the edge only the first bins are drawn.
    """
    number = lambda p: p * BLOCKS + block
    cut = lambda p: (p == F.col("_mix_passes")) & (block == F.col("_mix_edge")) & (bin_ >= F.col("_mix_bins"))
    last = F.coalesce(F.element_at("_mix_cuts", -1), F.lit(0))
    taken = F.filter(F.array(*map(F.lit, range(MOST))), lambda p: (number(p) < last) & ~cut(p))
    return F.transform(taken, lambda p: F.struct(p.alias("copy"), F.size(F.filter("_mix_cuts", lambda c: c <= number(p))).alias("shard"), _hash(f"order{seed}", p, id_col).alias("order")))


def assign(sizes: DataFrame, per_source: DataFrame) -> DataFrame:
    """Each sized row with its source's figures and its draws."""
    of = per_source.withColumnRenamed("_mix_source", "_mix_of")
    return sizes.join(of, F.col("_mix_source").eqNullSafe(F.col("_mix_of"))).withColumn("_mix_draws", draws(F.col("_mix_id"), F.col("_mix_block"), F.col("_mix_bin")))


def mix(docs: DataFrame, *, id_col="doc_id", source_col="source", text_col="text", seed=1, shards=SHARDS, **options) -> DataFrame:
    """The mixed rows: all columns of ``docs``, once for each draw, with mix_copy, mix_shard and mix_order.

    Sorting a shard by mix_order shuffles it; shards are independent.
    """
    names = docs.columns
    _, per_source = plan(docs, id_col=id_col, source_col=source_col, text_col=text_col, seed=seed, shards=shards, **options)
    keyed = docs.select(*names, F.struct(*(x.alias(c) for c, x in _placed(id_col, source_col).items())).alias("_mix_at"))
    of = per_source.withColumnRenamed("_mix_source", "_mix_of")
    joined = keyed.join(of, F.col("_mix_at.source").eqNullSafe(F.col("_mix_of")))
    drawn = joined.select(*names, F.explode(draws(F.col(id_col), F.col("_mix_at.block"), F.col("_mix_at.bin"), seed)).alias("_mix_draw"))
    return drawn.select(*names, F.col("_mix_draw.copy").alias("mix_copy"), F.col("_mix_draw.shard").alias("mix_shard"), F.col("_mix_draw.order").alias("mix_order"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sizes, per_source = plan(docs)
    return assign(sizes, per_source).select(
        F.col("_mix_id").alias("doc_id"),
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * F.size("_mix_draws")).alias("taken"),
        # copy:shard:order of each draw
        F.array_join(F.transform("_mix_draws", lambda d: F.concat_ws(":", d["copy"], d["shard"], d["order"])), ",").alias("draws"),
    )


def _level(i: int) -> str:
    """SQL of one level of the tree."""
    order = "('0x' || substr(md5('tree1|' || node || '|' || rk || '|' || number), 1, 8))::bigint, rk, number"
    return f"t{i + 1} AS (SELECT rk, number, node * 2 + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY {order}) <= count(*) OVER (PARTITION BY node) // 2 THEN 0 ELSE 1 END AS node FROM t{i})"


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size,
    ('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, '')), 1, 8))::bigint AS h,
    ('0x' || substr(md5('turn|' || coalesce(source, '')), 1, 8))::bigint % {BLOCKS // 2} * 2 + 1 AS turn,
    ('0x' || substr(md5('shift|' || coalesce(source, '')), 1, 8))::bigint % {BLOCKS} AS shift
  FROM documents),
p AS (SELECT doc_id, source, size, (h % {BLOCKS} * turn + shift) % {BLOCKS} AS block, (h // {BLOCKS}) % {BINS} AS bin FROM d),
s AS (SELECT source, sum(size)::bigint AS source_size FROM p GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::double AS weight, (source_size * 2)::double AS bound FROM r),
l AS (SELECT *, ((SELECT sum(source_size) FROM w) * 1.5 - coalesce(sum(bound) OVER (ORDER BY bound / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY bound / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
f AS (SELECT arg_min(lev, bound / weight) AS lev FROM l WHERE lev <= bound / weight),
t AS (SELECT l.source, l.rk, source_size, least(bound, f.lev * weight) AS target FROM l, f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes,
    CASE WHEN source_size > 0 THEN target - source_size * floor(target / source_size) ELSE 0 END AS rest FROM t),
b AS (SELECT source, block, sum(sum(size)) OVER (PARTITION BY source ORDER BY block) AS ends FROM p GROUP BY source, block),
e AS (SELECT q.*, coalesce((SELECT min(block) FROM b WHERE b.source IS NOT DISTINCT FROM q.source AND ends > q.rest), {BLOCKS}) AS edge,
    coalesce((SELECT max(ends) FROM b WHERE b.source IS NOT DISTINCT FROM q.source AND ends <= q.rest), 0) AS before FROM q),
n AS (SELECT e.source, bin, rest, before, sum(sum(size)) OVER (PARTITION BY e.source ORDER BY bin) - sum(size) / 2 AS middle
  FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source AND p.block = e.edge GROUP BY e.source, bin, rest, before),
m AS (SELECT source, max(CASE WHEN before + middle <= rest THEN bin + 1 END) AS bins FROM n GROUP BY source),
x AS (SELECT e.*, coalesce(m.bins, 0) AS bins, passes * {BLOCKS} + CASE WHEN passes < {MOST} THEN edge + CASE WHEN coalesce(m.bins, 0) > 0 THEN 1 ELSE 0 END ELSE 0 END AS drawn
  FROM e LEFT JOIN m ON m.source IS NOT DISTINCT FROM e.source),
t0 AS (SELECT rk, unnest(range(drawn::bigint)) AS number, 1 AS node FROM x),
{", ".join(map(_level, range(SHARDS.bit_length() - 1)))},
k AS (SELECT rk, node - {SHARDS} AS shard, count(*) AS q FROM t{SHARDS.bit_length() - 1} GROUP BY ALL),
c AS (SELECT rk, shard, sum(q) OVER (PARTITION BY rk ORDER BY shard) - q AS first, sum(q) OVER (PARTITION BY rk ORDER BY shard) AS last FROM k),
y AS (SELECT p.doc_id, p.source, p.size, copy, x.rk, copy * {BLOCKS} + block AS number, ('0x' || substr(md5('order1|' || copy || '|' || coalesce(doc_id::varchar, '')), 1, 8))::bigint AS h
  FROM p JOIN x ON p.source IS NOT DISTINCT FROM x.source, unnest(range({MOST})) AS u(copy) WHERE NOT (copy = passes AND block = edge AND bin >= bins)),
z AS (SELECT doc_id, y.source, size, count(*) AS n, string_agg(copy || ':' || shard || ':' || h, ',' ORDER BY copy) AS draws
  FROM y JOIN c ON c.rk = y.rk AND number >= first AND number < last GROUP BY ALL)
SELECT p.doc_id, p.size, source_size, target, (p.size * coalesce(n, 0))::bigint AS taken, coalesce(draws, '') AS draws
FROM p JOIN x ON p.source IS NOT DISTINCT FROM x.source LEFT JOIN z ON z.doc_id = p.doc_id AND z.source IS NOT DISTINCT FROM p.source
"""
