"""LM scoring: a log-bilinear model trained in numpy with noise-contrastive estimation.

Words are counted over all training texts; a word is known by a 64-bit hash of
its bytes. The CLASSES most frequent words, the end of a text and subclasses of
all other words are the model's vocabulary. A word's subclass follows from its
hash; their number is the square root of that of the other words, up to
SUBCLASSES, as the normalisers of all pairs are held in memory. The two classes before a token,
each through its own matrix, predict a vector; its product with a class's
vector plus a bias is the class's score. Texts are dealt by hash into shards of
about SHARD_TOKENS tokens and ordered by hash in them; each shard trains on all
its texts from the same start, and the parameters are averaged by the tokens
they saw. So the model does not depend on how the table is partitioned.
One batched matrix product per pair of classes gives the exact normaliser of
all contexts, so token probabilities are normalised. A word of a subclass is
given its share of that subclass by its smoothed count.

A word's count reaches the texts in two ways: the most frequent words, HEAVY at
most, are broadcast, the others are joined by hash, where no key is hot
because each is rarer than those.

A null text counts as empty: one token, the end. Rows with a null id belong to
the remainder of the empty string. Repeated rows count and are scored once for
each copy. Without training texts all counts are 0 and the base probability of
every token is the uniform one of an unseen word. An empty table gives an empty
result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm import common

CLASSES, SUBCLASSES, HEAVY = 1000, 3000, 1 << 17
WIDTH, BATCH, NOISE, RATIO, RATE = 16, 8192, 96, 16, 0.15
#: Tokens of a shard, and of what a shard shuffles and learns at once.
SHARD_TOKENS, SLICE_TOKENS = 1 << 21, 1 << 20
#: Smoothing of the base model.
ALPHA = 0.1


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a slice's distinct words, the number of each word in order, and word offsets by text."""
    data, offsets = common.text_bytes(column)
    upper = (data >= 65) & (data <= 90)
    data = data + (upper * np.uint8(32))
    words, order, per_text = common.words_of(data, offsets)
    names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
    return names.view(np.int64), order, per_text


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over the column ``_lm_text``; word is a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            names, order, _ = _tokens(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(order, minlength=len(names)))], ["word", "n"])

    return docs.select("_lm_text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    #: hashes of the heavy words in order, their counts, and their class
    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    #: tokens of training with and without ends, distinct words, tokens and distinct words of each subclass
    texts: int
    tokens: int
    distinct: int
    other_tokens: np.ndarray
    other_distinct: np.ndarray
    #: probability of each class: words, end, subclasses
    unigram: np.ndarray

    @property
    def subclasses(self) -> int:
        return np.size(self.other_tokens)

    @property
    def end(self) -> int:
        return self.other - 1

    @property
    def other(self) -> int:
        """The first subclass."""
        return len(self.unigram) - self.subclasses

    @property
    def begin(self) -> int:
        return len(self.unigram)

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words among the heavy ones, and whether they are there."""
        if not len(self.words):
            return np.zeros(len(names), int), np.zeros(len(names), bool)
        at = np.minimum(np.searchsorted(self.words, names), len(self.words) - 1)
        return at, self.words[at] == names

    def class_of(self, names: np.ndarray) -> np.ndarray:
        at, there = self.find(names)
        rest = self.other + names % self.subclasses
        return np.where(there, self.classes[at], rest) if len(self.words) else rest

    def base(self, n):
        """Base log10-probability of a token with count n; V counts the end if any text was learned."""
        v = self.distinct + (self.texts > 0)
        return np.log10((n + ALPHA) / (self.tokens + ALPHA * (v + 1)))

    def whole(self) -> np.ndarray:
        """Smoothed count of each subclass."""
        return np.atleast_1d(self.other_tokens + ALPHA * (self.other_distinct + 1))

    def share(self, n, subclass):
        """log10 of a word's part of its subclass."""
        return np.log10((n + ALPHA) / self.whole()[subclass])


def vocabulary(counts: DataFrame, texts: int, classes: int = CLASSES, heavy: int = HEAVY) -> Vocabulary:
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    # a histogram over the logarithms of the counts tells how far down the heavy words reach
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"])
    held = np.cumsum([r["words"] for r in steps]) <= heavy
    least = min((r["step"] for r, h in zip(steps, held) if h), default=1 << 30)
    rows = counts.where(step >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    names, n = rows["word"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    k = min(classes, len(names))
    order = np.argsort(names)
    rank = np.arange(len(names))[order]
    words = int(total["n"] or 0)
    subs = min(SUBCLASSES, max(1, int(np.ceil(np.sqrt(int(total["v"]) - k)))))
    # all words of each subclass, less the words with a class of their own
    found = counts.groupBy(F.pmod("word", F.lit(subs)).cast("int").alias("sub")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    tokens, distinct = np.zeros(subs, np.int64), np.zeros(subs, np.int64)
    tokens[found["sub"].to_numpy(np.int64)], distinct[found["sub"].to_numpy(np.int64)] = found["n"], found["v"]
    np.subtract.at(tokens, names[:k] % subs, n[:k])
    np.subtract.at(distinct, names[:k] % subs, 1)
    weight = np.concatenate([n[:k], [texts], tokens]) + 0.5
    kinds = np.where(rank < k, rank, k + 1 + names[order] % subs)
    return Vocabulary(names[order], n[order], kinds, texts, words + texts, int(total["v"]), tokens, distinct, weight / weight.sum())


def sequence(classes: np.ndarray, per_text: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens with each text's end, and the two classes before each."""
    texts = len(per_text) - 1
    at = np.arange(len(classes)) + np.repeat(np.arange(texts), np.diff(per_text))
    token = np.full(len(classes) + texts, v.end)
    token[at] = classes
    first = per_text[:-1] + np.arange(texts)
    before = np.concatenate([[v.begin], token[:-1]]) if len(token) else token
    before[first] = v.begin
    second = np.concatenate([[v.begin], before[:-1]]) if len(token) else token
    second[first] = v.begin
    return token, before, second


class Parameters:
    """All parameters as one float32 vector: context vectors, word vectors, biases and the two matrices."""

    def __init__(self, k: int, width: int = WIDTH, flat: np.ndarray | None = None, unigram: np.ndarray | None = None):
        sizes = [(k + 1, width), (k, width), (k,), (width, width), (width, width)]
        ends = np.cumsum([int(np.prod(s)) for s in sizes])
        if flat is None:
            flat = np.random.default_rng(5).normal(0, 0.1, ends[-1]).astype(np.float32)
        self.flat = flat
        self.context, self.word, self.bias, self.m1, self.m2 = (flat[e - int(np.prod(s)) : e].reshape(s) for s, e in zip(sizes, ends))
        if unigram is not None:
            self.bias[:] = np.log(unigram)
            self.m1[:] = np.eye(width)
            self.m2[:] = np.eye(width) * 0.5

    def hidden(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.context[one] @ self.m1 + self.context[two] @ self.m2


def _scatter(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, weights=rows[:, j], minlength=n) for j in range(rows.shape[1])], axis=1).astype(np.float32)


class Trainer:
    """Noise-contrastive estimation with AdaGrad; noise words are shared by a batch."""

    def __init__(self, v: Vocabulary, seed: int = 9):
        self.k, self.rng = len(v.unigram), np.random.default_rng(seed)
        self.p = Parameters(self.k, unigram=v.unigram)
        self.squares = np.full_like(self.p.flat, 1e-6)
        self.cdf = np.cumsum(v.unigram)
        self.offset = np.log(RATIO * v.unigram).astype(np.float32)

    def step(self, token: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p, g = self.p, Parameters(self.k, flat=np.zeros_like(self.p.flat))
        noise = np.minimum(np.searchsorted(self.cdf, self.rng.random(NOISE)), self.k - 1)
        a, b = p.context[one], p.context[two]
        h = a @ p.m1 + b @ p.m2
        target = p.word[token]
        up = 1 / (1 + np.exp(np.clip((h * target).sum(axis=1) + p.bias[token] - self.offset[token], -30, 30)))
        down = -np.float32(RATIO / NOISE) / (1 + np.exp(-np.clip(h @ p.word[noise].T + p.bias[noise] - self.offset[noise], -30, 30)))
        dh = up[:, None] * target + down @ p.word[noise]
        g.word[:] = _scatter(token, up[:, None] * h, self.k)
        np.add.at(g.word, noise, down.T @ h)
        g.bias[:] = np.bincount(token, weights=up, minlength=self.k)
        np.add.at(g.bias, noise, down.sum(axis=0))
        g.context[:] = _scatter(one, dh @ p.m1.T, self.k + 1) + _scatter(two, dh @ p.m2.T, self.k + 1)
        g.m1[:], g.m2[:] = a.T @ dh, b.T @ dh
        g.flat /= len(token)
        self.squares += g.flat**2
        p.flat += RATE * g.flat / np.sqrt(self.squares)

    def learn(self, token: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        order = self.rng.permutation(len(token))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            self.step(token[part], one[part], two[part])


def train(docs: DataFrame, v: Vocabulary) -> Parameters:
    """One pass of every shard over all its texts; averages are taken by block of parameters, in Spark."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(v)
    block = 512
    shards = max(1, round(v.tokens / SHARD_TOKENS))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in common.slices(batches):
            names, order, per_text = _tokens(batch.column(1))
            classes = v.class_of(names)[order].astype(np.int32) if len(names) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(per_text.astype(np.int32)), pa.array(classes))], ["h", "classes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, t, at, seen = shared.value, None, None, 0
        waiting: list[np.ndarray] = []

        def learn() -> None:
            nonlocal seen, waiting
            if waiting:
                per_text = np.concatenate([[0], np.cumsum([len(x) for x in waiting])])
                token, one, two = sequence(np.concatenate(waiting).astype(np.int64), per_text, v)
                t.learn(token, one, two)
                seen, waiting = seen + len(token), []

        def given() -> pa.RecordBatch:
            flat = t.p.flat.astype(float) * seen
            parts = [flat[i : i + block] for i in range(0, len(flat), block)]
            return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64())), pa.array([float(seen)] * len(parts))], ["block", "x", "seen"])

        size = 0
        for batch in batches:
            ends = np.asarray(batch.column(1).offsets)
            flat = batch.column(1).values.to_numpy(zero_copy_only=False)
            for i, shard in enumerate(batch.column(0).to_pylist()):
                if shard != at:
                    if t is not None:
                        learn()
                        yield given()
                    at, t, seen, size = shard, Trainer(v), 0, 0
                waiting.append(flat[ends[i] : ends[i + 1]])
                size += len(waiting[-1]) + 1
                if size >= SLICE_TOKENS:
                    learn()
                    size = 0
        if t is not None:
            learn()
            yield given()

    # a text's place follows from the text and its id alone
    rows = docs.select(F.xxhash64("_lm_text", F.col("_lm_id").cast("string")).alias("h"), "_lm_text").mapInArrow(coded, "h long, classes array<int>")
    dealt = rows.withColumn("shard", F.pmod(F.shiftright("h", 20), F.lit(shards)).cast("int")).repartition("shard").sortWithinPartitions("shard", "h")
    one = dealt.select("shard", "classes").mapInArrow(run, "block int, x array<double>, seen double")
    # the sums of a block are taken over sixteen groups first, so no task gathers a block from everywhere

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for b, x, seen in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                x = x.values.to_numpy(zero_copy_only=False)
                if b in total:
                    total[b][0] += x
                    total[b][1] += seen
                else:
                    total[b] = [x.copy(), seen]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x for x, _ in total.values()], pa.list_(pa.float64())), pa.array([s for _, s in total.values()])], ["block", "x", "seen"])

    added = one.repartition(16, "block").mapInArrow(add, "block int, x array<double>, seen double")
    start = Parameters(len(v.unigram), unigram=v.unigram)
    for r in added.collect():  # one row for each block of the model
        start.flat[r["block"] * block : (r["block"] + 1) * block] = np.array(r["x"]) / r["seen"]
    return start


def normalisers(spark, p: Parameters, k: int) -> np.ndarray:
    """log of the normaliser for every pair of classes, by batched matrix products; (k + 1) ** 2 numbers."""
    shared = spark.sparkContext.broadcast((k, p.flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, flat = shared.value
        p = Parameters(k, flat=flat)
        for batch in batches:
            ones = batch.column(0).to_pylist()
            rows = []
            for one in ones:
                s = p.hidden(np.full(k + 1, one), np.arange(k + 1)) @ p.word.T + p.bias
                top = s.max(axis=1, keepdims=True)
                rows.append((np.log(np.exp(s - top).sum(axis=1)) + top[:, 0]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["id", "z"])

    rows = spark.range(0, k + 1, 1, 12).mapInArrow(run, "id long, z binary").collect()
    out = np.zeros((k + 1, k + 1), np.float32)
    for r in rows:
        out[r["id"]] = np.frombuffer(r["z"], np.float32)
    return out


def score(docs: DataFrame, learn: Column, *, id_col="doc_id", text_col="text") -> DataFrame:
    """id, learned, n_tokens, n_known, train_tokens, base_score and score (both log10) of every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("_lm_id"), F.coalesce(learn, F.lit(False)).alias("_lm_learn"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_lm_text"))
    training = texts.where("_lm_learn")
    counts = common.checkpoint(count_words(training))
    v = vocabulary(counts, training.count())
    p = train(training, v)
    z = normalisers(spark, p, len(v.unigram))
    shared = spark.sparkContext.broadcast((v, p.flat, z))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat, z = shared.value
        p = Parameters(len(v.unigram), flat=flat)
        ten = np.log(10.0)
        for batch in common.slices(batches):
            names, order, per_text = _tokens(batch.column(2))
            at, there = v.find(names)
            n = np.where(there, v.counts[at], 0) if len(v.counts) else np.zeros(len(names), int)
            kind = v.class_of(names)
            token, one, two = sequence(kind[order], per_text, v)
            logs = np.empty(len(token))
            for i in range(0, len(token), 1 << 16):
                a, b, w = one[i : i + (1 << 16)], two[i : i + (1 << 16)], token[i : i + (1 << 16)]
                logs[i : i + (1 << 16)] = (np.einsum("ij,ij->i", p.hidden(a, b), p.word[w]) + p.bias[w] - z[a, b]) / ten
            ends = per_text + np.arange(len(per_text))
            model = common.sum_by_text(logs, ends)
            # what is known here of the counts; the rest is joined
            model += common.sum_by_text(np.where(there & (kind >= v.other), v.share(n, np.maximum(kind - v.other, 0)), 0.0)[order], per_text)
            base = common.sum_by_text(np.where(there, v.base(n), 0.0)[order], per_text) + v.base(v.texts)
            known = common.sum_by_text((there & (n > 0))[order], per_text) + (v.texts > 0)
            rare = np.flatnonzero(~there[order])
            owner = np.searchsorted(per_text, rare, side="right") - 1
            # distinct words of each text with their number
            key = np.unique(owner * max(len(names), 1) + order[rare], return_counts=True)
            cut = np.searchsorted(key[0] // max(len(names), 1), np.arange(len(per_text))).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(cut), pa.array(names[key[0] % max(len(names), 1)] if len(names) else names))
            times = pa.ListArray.from_arrays(pa.array(cut), pa.array(key[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(per_text) + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(model), words, times],
                ["_lm_id", "_lm_learn", "n_tokens", "known", "base", "model", "words", "times"],
            )

    kinds = dict(texts.dtypes)
    rows = texts.mapInArrow(run, f"_lm_id {kinds['_lm_id']}, _lm_learn boolean, n_tokens long, known long, base double, model double, words array<bigint>, times array<int>")
    rows = common.checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    vv = v.distinct + (v.texts > 0)
    base = F.log10((n + ALPHA) / (v.tokens + ALPHA * (vv + 1)))
    share = F.log10((n + ALPHA) / F.col("whole"))
    whole = spark.createDataFrame(list(enumerate(v.whole().tolist())), "sub int, whole double")
    rare = rare.join(F.broadcast(whole), F.pmod("word", F.lit(v.subclasses)).cast("int") == F.col("sub"))
    found = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * base).alias("base2"), F.sum(F.col("times") * share).alias("model2"))
    out = rows.drop("words", "times").join(found, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        F.col("_lm_id").alias(id_col),
        F.col("_lm_learn").alias("learned"),
        "n_tokens",
        (F.col("known") + zero("more")).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base2")).alias("base_score"),
        (F.col("model") + zero("model2")).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, common.id_remainder(F.col("doc_id"), 10) != 0)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
