"""MinHash near-duplicates with an LSH forest.

A document's set is its distinct shingles of ``words`` words (see ``shingles``). Documents
with equal sets are one node. Each of TREES trees sorts the nodes by its own
order of the signature; nodes whose order agrees in the first DEPTH minima lie
in one region, and neighbours in the sorted order, which share the longest
prefixes, are candidates. A pair that reaches the similarity agrees in DEPTH
minima with probability s ** DEPTH, so with s = 0.8 some tree brings it into one
region with probability 1 - (1 - 0.8 ** 3) ** 16 > 0.99998.

The depth adapts to the region. One with more than WIDE nodes in several
components is searched again with longer prefixes, in as many more trees as
keep that probability (LEVELS); what is still larger at the last level is
searched in blocks. So the regions whose pairs are all looked at have a bounded
size, and no link is lost to a cap.

Candidates are confirmed on the full sets, after a look at the signatures: a
pair at 0.8 agrees in fewer than AGREE of the HASHES minima with probability
below 1e-6. Nodes of crowded regions, where many pairs come near the similarity
without reaching it, get LONG minima of one byte for a second look, as sure as
the first and four times as sharp. The steps:

1. next neighbours in the sorted orders of some trees;
2. several neighbours in all orders, where they lie in different components so
   far and their signatures look alike; these join most of every region;
3. in regions of up to CROWD nodes, all pairs in different components;
4. the same in regions of up to WIDE nodes, with the long signatures, each pair
   in the first tree that brings it together;
5. the nodes of larger regions go on to the next level and its regions.

Each step finds components of the components so far, so the graphs shrink.
No group is expanded into all its pairs, and none is collected into one task:
sorted orders of crowded regions are dealt in runs of about RUN nodes.

Null and empty texts have an empty set and are linked with nothing. Rows with a
null id take no part: their component is null and they are kept. Rows that
share an id are one document that has several texts. Copies and ties need no
order: a component is named by its smallest id. An empty table gives an empty
result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm import common
from millwright.llm.graph import components

WORDS, PERCENT = 4, 80
TREES, DEPTH = 16, 3
#: Minima in a signature, of two bytes each; a tree's order starts at its own DEPTH of them and goes on for PATH more.
HASHES, PATH = 128, 12
#: Nodes of a small region; nodes of a run of a sorted order; nodes on a block's side.
CROWD, RUN, UNIT = 64, 1024, 1024
#: Nodes of a region that one task searches, a few megabytes.
WIDE = 2048
#: Longer prefixes for crowded regions, and the trees that bring a pair at 0.8 together with a probability of 1 - 1e-5.
LEVELS = ((6, 40), (9, 84), (12, 164))
#: Minima that a pair must have in common: z = -5.2 at a similarity of 0.8. And those of likely pairs.
AGREE, LIKELY = 79, 96
#: Minima of a long signature, and those to have in common: z = -5.2 at 0.8, at which two of them agree with probability 0.8008.
LONG, LONG_AGREE = 1024, 753
#: Trees of the first step, and neighbours that the second step looks at.
FIRST, NEAR = 4, 4
#: Bits of the map of documents with company.
MARKS = 1 << 23
_U = np.uint64


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64, endpoint=False) | _U(1)


_PLACE = _odd(16, 11)
_MIX = _odd(2, 12)
_FAMILY = _odd(HASHES, 13)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    return (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)


def shingles(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; a shorter text is one shingle, one without words has none."""
    data, offsets = common.text_bytes(column)
    lower = data.copy()
    upper = (data >= 65) & (data <= 90)
    lower[upper] += 32
    names, order, per_text = common.words_of(lower, offsets)
    coded = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names.to_pylist()), np.uint64, len(names))
    coded = _scramble(coded)[order] if len(order) else np.zeros(0, np.uint64)
    n = len(coded)
    run = np.zeros(max(n - words + 1, 0), np.uint64)
    for j in range(words):
        run += coded[j : j + len(run)] * _PLACE[j]
    run = _scramble(run)
    out = []
    for a, b in zip(per_text[:-1], per_text[1:]):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            short = (coded[a:b] * _PLACE[8 : 8 + b - a]).sum(dtype=np.uint64) + _U(b - a)
            out.append(_scramble(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(docs: DataFrame, *, id_col="doc_id", text_col="text", words: int = WORDS) -> DataFrame:
    """doc, n (set size), two fingerprints of the set, and its signature: HASHES minima of two bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            sets = shingles(batch.column(1), words)
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            every = np.concatenate(sets)
            full = np.flatnonzero(size)
            starts = (np.cumsum(size) - size)[full]
            minima = np.zeros((len(sets), HASHES), np.uint16)
            prints = np.zeros((2, len(sets)), np.uint64)
            if len(full):
                for k in range(HASHES):
                    # scrambled again, since the smallest values have few distinct first bits
                    minima[full, k] = (_scramble(np.minimum.reduceat(every * _FAMILY[k], starts)) >> _U(48)).astype(np.uint16)
                for k in range(2):
                    prints[k, full] = np.add.reduceat(_scramble(every * _MIX[k]), starts)
            packed = pa.array([m.tobytes() for m in minima], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), packed], ["doc", "n", "f1", "f2", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("_dedup_text")).mapInArrow(common.lean(run), "doc long, n long, f1 long, f2 long, sig binary")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose region (tree, region) holds two nodes at least, with its size as ``crowd``."""
    size = rows.groupBy("tree", "region").agg(F.count("*").alias("crowd")).where("crowd > 1")
    return rows.join(size, ["tree", "region"])


def forest(nodes: DataFrame) -> DataFrame:
    """(tree, region, path, node, crowd) of the regions that hold two nodes at least."""
    width = 2 * DEPTH
    rows = nodes.select("node", F.concat("sig", "sig").alias("twice"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    region, path = F.expr(f"substring(twice, tree * {width} + 1, {width})"), F.expr(f"substring(twice, tree * {width} + {width + 1}, {2 * PATH})")
    return _shared(rows.select("tree", F.xxhash64(region).alias("region"), path.alias("path"), "node"))


def deeper(nodes: DataFrame, level: int) -> DataFrame:
    """(tree, region, node, crowd) of the regions of a level, whose prefixes are its own choices of minima."""
    depth, trees = LEVELS[level]
    chosen = _prefixes(level + 1)
    odd = _odd(depth, 200 + level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                minima = _minima(part.column(1)).astype(np.uint64)
                region = np.stack([_scramble(((minima[:, c] + _U(1)) * odd).sum(axis=1, dtype=np.uint64)) for c in chosen], axis=1)
                node = np.repeat(np.asarray(part.column(0)), trees)
                tree = np.tile(np.arange(trees, dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(region.ravel().view(np.int64)), pa.array(node)], ["tree", "region", "node"])

    return _shared(nodes.select("node", "sig").mapInArrow(common.lean(run), "tree int, region long, node long"))


def _minima(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES)


def _marks(ids: DataFrame) -> np.ndarray:
    """A bitmap of MARKS bits with the ids' hashes. Its size is fixed; it only spares work, and lets strangers through."""
    bit = F.pmod(F.xxhash64("node"), F.lit(MARKS))
    rows = ids.select(F.floor(bit / 63).cast("int").alias("word"), (bit % 63).alias("at")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(at as int))")).alias("bits")).toPandas()
    out = np.zeros(MARKS // 63 + 1, np.int64)
    out[rows["word"]] = rows["bits"]
    return out


def _sets(docs: DataFrame, company: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc, set) of the documents that have company in some region: the only texts read again, and the sets shuffled once."""
    marks = docs.sparkSession.sparkContext.broadcast(_marks(company))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.asarray(batch.column(1))
            batch = batch.filter(pa.array(marks.value[bit // 63] >> bit % 63 & 1 > 0))
            for part in common.slices([batch]):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingles(part.column(2), words)], pa.binary())], ["doc", "set"])

    ids = F.col(id_col).cast("long")
    texts = docs.where(ids.isNotNull()).select(ids.alias("doc"), F.pmod(F.xxhash64(ids), F.lit(MARKS)).cast("long").alias("bit"), F.col(text_col).cast("string").alias("_dedup_text"))
    found = texts.mapInArrow(common.lean(build), "doc long, set binary")
    return common.checkpoint(found.join(company.withColumnRenamed("node", "doc"), "doc", "left_semi"))


def lengthened(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, long): LONG minima of one byte of the nodes' sets."""
    family = _odd(LONG, 14)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                mine = np.frombuffer(x.as_py(), np.uint64)
                least = np.full(LONG, ~_U(0))
                for i in range(0, len(mine), 256):
                    np.minimum(least, (mine[i : i + 256, None] * family).min(axis=0), out=least)
                out.append((_scramble(least) >> _U(56)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["node", "long"])

    chosen = sets.join(nodes.withColumnRenamed("node", "doc"), "doc", "left_semi")
    return chosen.mapInArrow(common.lean(run), "node long, long binary")


def _verify(pairs: DataFrame, sets: DataFrame, count: int) -> DataFrame:
    """The pairs (a, b), so many, whose full sets reach the similarity. Few pairs are broadcast, so that only the sets they name are exchanged."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                good.append(100 * both >= PERCENT * (len(x) + len(y) - both) and both > 0)
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    few = F.broadcast if count <= common.ROWS_A_TASK else lambda df: df
    ends = sets.join(few(pairs.select(F.col("b").alias("doc")).distinct()), "doc", "left_semi")
    joined = sets.select(F.col("doc").alias("a"), F.col("set").alias("set_a")).join(few(pairs), "a").join(ends.select(F.col("doc").alias("b"), F.col("set").alias("set_b")), "b")
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(common.lean(check), "a long, b long")


def _pairs_near(key: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows with one key, up to ``distance`` apart; rows of a key lie together."""
    left, right = [], []
    for d in range(1, min(distance, len(key) - 1) + 1):
        at = np.flatnonzero(key[:-d] == key[d:])
        left.append(at)
        right.append(at + d)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _look(rows: DataFrame, signed: DataFrame, key: Column, order: list[str], distance: int, least: int) -> DataFrame:
    """Candidates (a, b), once each: rows up to ``distance`` apart in one key's order, in different components, whose sizes and signatures allow the similarity.

    Rows are dealt by key and sorted; a task streams through its rows and keeps
    the last ``distance`` of them from batch to batch. Where ``signed`` has long
    signatures, these have the last word.
    """
    longer = "long" in signed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, n, component = (np.asarray(batch.column(i)) for i in range(4))
            columns, new = [key, node, n, component, _minima(batch.column(4))], 0
            if longer:
                columns.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, LONG))
            if kept is not None:
                new = len(kept[0])
                columns = [np.concatenate(x) for x in zip(kept, columns)]
            kept = [x[-distance:] for x in columns]
            key, node, n, component, minima = columns[:5]
            x, y = _pairs_near(key, distance)
            small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            fits = (y >= new) & (component[x] != component[y]) & (node[x] != node[y]) & (100 * small >= PERCENT * large)
            x, y = x[fits], y[fits]
            found = []
            for i in range(0, len(x), 1 << 14):
                a, b = x[i : i + (1 << 14)], y[i : i + (1 << 14)]
                good = np.flatnonzero((minima[a] == minima[b]).sum(axis=1) >= least)
                if longer:
                    good = good[np.concatenate([(columns[5][a[g]] == columns[5][b[g]]).sum(axis=1) >= LONG_AGREE for g in np.array_split(good, 1 + len(good) // 4096)])]
                found.append(np.stack([np.minimum(node[a], node[b])[good], np.maximum(node[a], node[b])[good]]))
            if found:
                a, b = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = rows.withColumn("key", key).join(signed, "node")
    dealt = rows.repartition("key").sortWithinPartitions("key", *order, "node").select("key", "node", "n", "component", "sig", *["long"] * longer)
    return dealt.mapInArrow(common.lean(run), "a long, b long").distinct()


def _look_wide(rows: DataFrame, signed: DataFrame, chosen: np.ndarray) -> DataFrame:
    """Candidates (a, b) of whole regions of more than CROWD nodes, in different components, whose sizes and both signatures allow the similarity.

    ``chosen`` holds the minima of every tree's prefix: a pair that an earlier
    tree has in one region too is that tree's. A task holds one region at a time.
    """

    def pairs(tree: int, node, n, component, minima, long) -> Iterator[np.ndarray]:
        for i in range(len(node)):
            j = np.arange(i + 1, len(node))
            j = j[(component[j] != component[i]) & (100 * np.minimum(n[j], n[i]) >= PERCENT * np.maximum(n[j], n[i]))]
            same = minima[j] == minima[i]
            j, same = j[at := same.sum(axis=1) >= AGREE], same[at]
            for earlier in chosen[:tree]:
                j, same = j[at := ~same[:, earlier].all(axis=1)], same[at]
            j = j[(long[j] == long[i]).sum(axis=1) >= LONG_AGREE]
            yield np.stack([np.minimum(node[j], node[i]), np.maximum(node[j], node[i])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def search() -> Iterator[pa.RecordBatch]:
            if held:
                _, tree, *columns = (np.concatenate(x) for x in zip(*held))
                a, b = np.concatenate(list(pairs(int(tree[0]), *columns)), axis=1)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(batch.column(i)) for i in range(5)] + [_minima(batch.column(5)), np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(-1, LONG)]
            cuts = [0, *(np.flatnonzero(np.diff(columns[0])) + 1), batch.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                if held and held[0][0][0] != columns[0][x]:
                    yield from search()
                    held = []
                held.append([c[x:y] for c in columns])
        yield from search()

    rows = rows.withColumn("key", F.xxhash64("tree", "region")).withColumn("tree", F.col("tree").cast("int")).join(signed, "node")
    dealt = rows.repartition("key").sortWithinPartitions("key").select("key", "tree", "node", "n", "component", "sig", "long")
    return dealt.mapInArrow(common.lean(run), "a long, b long")


def _prefixes(level: int) -> np.ndarray:
    """Places of the minima in every tree's prefix, at a level (0: the first forest)."""
    if not level:
        return np.arange(TREES * DEPTH).reshape(TREES, DEPTH) % HASHES
    depth, trees = LEVELS[level - 1]
    rng = np.random.default_rng(99 + level)
    return np.stack([rng.choice(HASHES, depth, replace=False) for _ in range(trees)])


def _mixed(rows: DataFrame, labels: DataFrame, count: int) -> DataFrame:
    """The rows, so many, with their components, where a region holds several."""
    rows = common.gathered(rows, count).join(labels, "node")
    several = rows.groupBy("tree", "region").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    return rows.join(several.select("tree", "region"), ["tree", "region"])


def _merge(labels: DataFrame, found: DataFrame) -> DataFrame:
    """The labels after the links ``found`` have joined components; no node has more links than a region has neighbours."""
    end = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    edges = found.join(end("a"), "a").join(end("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    roots = components(edges).select(F.col("node").alias("component"), F.col("component").alias("root"))
    return common.checkpoint(labels.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component")))


def links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(node, component) of the nodes that share a region with another."""
    spark = docs.sparkSession
    trees = common.checkpoint(forest(nodes))
    company = common.checkpoint(trees.select("node").distinct())
    count, of_trees = common.counted(company), common.counted(trees)
    signed = common.checkpoint(nodes.select("node", "n", "sig").join(company, "node", "left_semi"))
    sets = _sets(docs, company, id_col, text_col, words)
    labels = common.gathered(company.withColumn("component", F.col("node")), count)
    # a crowded region's sorted order is dealt in runs, each a random part of it
    run = F.xxhash64("tree", "region", F.when(F.col("crowd") > RUN, F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("crowd") / RUN))).otherwise(0))
    region = F.xxhash64("tree", "region")

    def take(candidates: DataFrame, labels: DataFrame) -> DataFrame:
        candidates = common.checkpoint(candidates)
        n = common.counted(candidates)
        if not n:
            return labels
        found = common.checkpoint(_verify(common.gathered(candidates, n), sets, n))
        out = common.gathered(_merge(labels, common.gathered(found, common.counted(found))), count)
        common.release(spark)
        return out

    def small(rows: DataFrame, signed: DataFrame) -> DataFrame:
        return _look(rows.where(F.col("crowd") <= CROWD), signed, region, [], CROWD, AGREE)

    labels = take(_look(trees.where(F.col("tree") < FIRST).join(labels, "node"), signed, run, ["path"], 1, AGREE), labels)
    labels = take(_look(_mixed(trees, labels, of_trees), signed, run, ["path"], NEAR, LIKELY), labels)
    labels = take(small(_mixed(trees, labels, of_trees), signed), labels)
    rows = trees
    for level in range(len(LEVELS) + 1):
        crowded = common.checkpoint(_mixed(rows.where(F.col("crowd") > CROWD), labels, of_trees).select("tree", "region", "node", "crowd", "component"))
        held = common.counted(crowded)
        if not held:
            return labels
        crowded = common.gathered(crowded, held)
        names = crowded.select("node").distinct()
        own = signed.join(names, "node", "left_semi")
        signed = common.checkpoint(own if "long" in signed.columns else own.join(lengthened(sets, names), "node"))
        labels = take(_look_wide(crowded.where(F.col("crowd") <= WIDE), signed, _prefixes(level)), labels)
        names = common.checkpoint(_mixed(rows.where(F.col("crowd") > WIDE), labels, of_trees).select("tree", "region", "node", "component").distinct())
        if not common.counted(names):
            return labels
        if level == len(LEVELS):
            return take(_blocks(names, signed), labels)
        rows = common.checkpoint(deeper(signed.join(names.select("node").distinct(), "node", "left_semi"), level))
        of_trees = common.counted(rows)
        labels = take(small(_mixed(rows, labels, of_trees), signed), labels)
    return labels


def _blocks(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """Candidates between the nodes outside a crowded region's largest component and all others of the region, block by block."""
    held = rows.groupBy("tree", "region", "component").agg(F.count("*").alias("held"))
    main = held.groupBy("tree", "region").agg(F.max_by("component", F.struct("held", "component")).alias("main"), F.ceil(F.sum("held") / UNIT).cast("int").alias("units"))
    rows = rows.join(main, ["tree", "region"]).withColumn("unit", F.pmod(F.xxhash64("node"), F.col("units")).cast("int")).join(signed, "node")
    every = F.explode(F.sequence(F.lit(0), F.col("units") - 1))
    outside = rows.where("component <> main").select("tree", "region", F.col("unit").alias("x"), every.alias("y"), "node", "n", "component", "sig", "long")
    # new names on one side keep the two sides of the cogroup apart
    inside = rows.select("tree", "region", every.alias("x"), F.col("unit").alias("y"), "node", "n", "component", "sig", "long").toDF(*(f"r_{c}" for c in outside.columns))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), np.int64)]
        if len(left) and len(right):
            node, n, component = (right[f"r_{c}"].to_numpy() for c in ("node", "n", "component"))
            minima = np.frombuffer(b"".join(right["r_sig"]), np.uint16).reshape(len(right), HASHES)
            long = np.frombuffer(b"".join(right["r_long"]), np.uint8).reshape(len(right), LONG)
            for a, size, of, sig, longer in zip(left["node"], left["n"], left["component"], left["sig"], left["long"]):
                at = np.flatnonzero((component != of) & (100 * np.minimum(n, size) >= PERCENT * np.maximum(n, size)))
                at = at[(minima[at] == np.frombuffer(sig, np.uint16)).sum(axis=1) >= AGREE]
                at = at[(long[at] == np.frombuffer(longer, np.uint8)).sum(axis=1) >= LONG_AGREE]
                out.append(np.stack([np.minimum(node[at], a), np.maximum(node[at], a)], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"], dtype="int64")

    keys = ["tree", "region", "x", "y"]
    return outside.groupBy(*keys).cogroup(inside.groupBy(*(f"r_{k}" for k in keys))).applyInPandas(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", words: int = WORDS) -> DataFrame:
    """doc, n, component: each row's set size and the smallest id it is linked with, itself included."""
    docs = docs.select(id_col, text_col)
    same = ["f1", "f2", "n"]
    with common.small_batches(docs.sparkSession):  # of rows with whole texts or sets; all of it is written before it returns
        rows = common.checkpoint(signatures(docs, id_col=id_col, text_col=text_col, words=words))
        nodes = common.checkpoint(rows.where("n > 0 and doc is not null").groupBy(*same).agg(F.min("doc").alias("node"), F.first("sig").alias("sig")))
        joined = links(docs, nodes, id_col, text_col, words)
    of = nodes.join(joined, "node", "left").select(*same, F.coalesce("component", "node").alias("component"))
    linked = rows.drop("sig").join(of, same, "left")
    return linked.select("doc", "n", F.coalesce("component", "doc").alias("component"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs, words=WORDS)
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh)::bigint AS n FROM s),
g AS MATERIALIZED (SELECT doc_id, hash(unnest(sh)) AS g FROM s),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept FROM n JOIN m ON m.d = n.doc_id
"""
