"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations, found by the
forward algorithm; a text's is the product over its words. The pieces'
probabilities are re-estimated by expectation-maximisation, the expected
counts coming from the backward pass over the same lattices. Words are what
ASCII white space separates, in learning and in prediction, and each is summed
whole: the short ones of a length together, longer ones one by one in logs, in
time proportional to their length.

Nulls, empty texts and texts without a letter get ``und`` with score 0. Rows
with null language teach nothing. Repeated rows are scored alike. An empty
table gives an empty result; without any language to learn every text is
``und``. Only the id and the text are read, so other columns and their names
do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm import common
from millwright.llm.lattice import MAX_CHARS, SPACE_MARK, PieceTable, by_length, load_pieces

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Labelled texts of each language that the model is fitted on, at most.
TEXTS_PER_LANGUAGE = 300
#: The least probability of a piece, and that of a byte that no piece covers.
FLOOR = 1e-6
#: Keeps the forward sums of a long word within double precision.
SCALE = 64.0


@dataclass
class Model:
    languages: list[str]
    table: PieceTable
    #: (pieces + 1, languages); the last row is for a character that no piece covers
    probability: np.ndarray
    prior: np.ndarray


def _forward(model_p: np.ndarray, table: PieceTable, codes: np.ndarray, edges=None) -> np.ndarray:
    n, k = codes.shape[1], model_p.shape[1]
    alpha = np.zeros((n + 1, len(codes), k))
    alpha[0] = 1.0
    for start, length, rows, numbers in edges if edges is not None else table.edges(codes):
        alpha[start + length][rows] += alpha[start][rows] * (model_p[numbers] * SCALE**length)
    return alpha


class _Long:
    """The lattice of one long word, in logs: by place, the pieces that end there."""

    def __init__(self, word: str, table: PieceTable):
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sums, powers = table.sums(codes)
        n = self.n = len(codes)
        starts, lengths, numbers = [], [], []
        for length in range(1, min(table.longest, n) + 1):
            rows, found = table.find((sums[length:] - sums[:-length]) * powers[length:])
            if length == 1:
                lost = np.setdiff1d(np.arange(n), rows)
                rows, found = np.concatenate([rows, lost]), np.concatenate([found, np.full(len(lost), len(table.pieces), np.int32)])
            starts.append(rows)
            lengths.append(np.full(len(rows), length))
            numbers.append(found)
        start, length, self.number = np.concatenate(starts), np.concatenate(lengths), np.concatenate(numbers)
        order = np.argsort(start + length, kind="stable")
        self.start, self.end, self.number = start[order], (start + length)[order], self.number[order]

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Log-sums over all segmentations up to each place."""
        alpha = np.zeros((self.n + 1, logp.shape[1]))
        weight, cuts = logp[self.number], np.searchsorted(self.end, np.arange(self.n + 2))
        for end in range(1, self.n + 1):
            a, b = cuts[end], cuts[end + 1]
            alpha[end] = np.logaddexp.reduce(alpha[self.start[a:b]] + weight[a:b], axis=0)
        return alpha

    def expected(self, logp: np.ndarray) -> np.ndarray:
        """The probability, in each language, that an edge is part of the word's segmentation."""
        alpha, weight = self.forward(logp), logp[self.number]
        beta = np.zeros_like(alpha)
        order = np.argsort(self.start, kind="stable")
        cuts = np.searchsorted(self.start[order], np.arange(self.n + 1))
        for start in reversed(range(self.n)):
            own = order[cuts[start] : cuts[start + 1]]
            beta[start] = np.logaddexp.reduce(beta[self.end[own]] + weight[own], axis=0)
        return np.exp(alpha[self.start] + weight + beta[self.end] - alpha[-1])


def word_scores(words: list[str], table: PieceTable, probability: np.ndarray) -> np.ndarray:
    """Natural log-probability of each word in each language, over all segmentations."""
    out = np.zeros((len(words), probability.shape[1]))
    short = words
    if long := [i for i, w in enumerate(words) if len(w) >= MAX_CHARS]:
        short, logp = list(words), np.log(probability)
        for i in long:
            short[i] = ""
            out[i] = _Long(SPACE_MARK + words[i], table).forward(logp)[-1]
    for index, codes in by_length(short):
        codes = np.concatenate([np.full((len(codes), 1), ord(SPACE_MARK), np.uint64), codes], axis=1)
        out[index] = np.log(_forward(probability, table, codes)[-1]) - codes.shape[1] * np.log(SCALE)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each slice of (lang, text); every language has a row without a word."""
    for batch in common.slices(batches):
        data, offsets = common.text_bytes(pc.utf8_lower(batch.column(1)))
        words, order, per_text = common.words_of(data, offsets)
        coded = batch.column(0).dictionary_encode()
        lang = np.repeat(np.asarray(coded.indices), np.diff(per_text))
        pair, n = np.unique(lang.astype(np.int64) * max(len(words), 1) + order, return_counts=True)
        names = words.cast(pa.large_string()).cast(pa.string())
        langs = coded.dictionary
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([langs.take(pa.array(pair // max(len(words), 1))), langs]), pa.concat_arrays([names.take(pa.array(pair % max(len(words), 1))), pa.nulls(len(langs), pa.string())]), pa.array(np.append(n, np.zeros(len(langs), int)))], ["lang", "word", "n"]
        )


def fit(docs: DataFrame, learn, *, id_col="doc_id", text_col="text", lang_col="lang", model_file=MODEL_FILE, texts_per_language=TEXTS_PER_LANGUAGE, rounds=2) -> Model:
    """Learn from the rows where ``learn`` holds: up to ``texts_per_language`` whole texts of each language, chosen by a hash of the id."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")).alias("h"))
    # the ids are chosen first, so that no text is shuffled; their number is bounded
    first = lambda df: df.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= texts_per_language)
    wanted = first(rows.select("lang", "h")).select("lang", "h").distinct()
    # the words of the chosen texts are counted in Spark; their counts are what the driver learns from
    chosen = first(rows.join(F.broadcast(wanted), ["lang", "h"])).select("lang", F.col("text").cast("string")).mapInArrow(common.lean(_counts), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").collect()
    table = PieceTable.of(load_pieces(model_file))
    languages = sorted({r["lang"] for r in chosen})
    words: dict[str, int] = {}
    counts: list[dict[int, int]] = [{} for _ in languages]
    number = {x: i for i, x in enumerate(languages)}
    for r in chosen:
        if r["word"] is not None:
            i = words.setdefault(SPACE_MARK + r["word"], len(words))
            counts[number[r["lang"]]][i] = r["n"]
    k, size = len(languages), len(table.pieces) + 1
    weight = np.zeros((len(words), k))
    for j, own in enumerate(counts):
        weight[list(own), j] = list(own.values())
    start = 1.0 / (np.arange(size) + 50.0)
    probability = np.repeat((start / start.sum())[:, None], k, axis=1)
    del chosen, counts
    names = list(words)
    long = {i: _Long(w, table) for i, w in enumerate(names) if len(w) > MAX_CHARS}
    for i in long:
        names[i] = ""
    for _ in range(rounds):
        expected = np.zeros((size, k))
        for i, lattice in long.items():
            np.add.at(expected, lattice.number, lattice.expected(np.log(probability)) * weight[i])
        for index, codes in by_length(names):
            edges = list(table.edges(codes))  # found again in each round, so that few are held
            alpha = _forward(probability, table, codes, edges)
            beta = np.zeros_like(alpha)
            beta[-1] = 1.0
            share = weight[index] / alpha[-1]
            for begin, length, rows, numbers in reversed(edges):
                onward = probability[numbers] * SCALE**length * beta[begin + length][rows]
                np.add.at(expected, numbers, alpha[begin][rows] * onward * share[rows])
                beta[begin][rows] += onward
        shared = expected.sum(axis=1, keepdims=True)
        shared = (shared + 0.01) / (shared + 0.01).sum()
        total = expected.sum(axis=0, keepdims=True)
        pseudo = 500.0
        probability = np.maximum((expected + pseudo * shared) / np.maximum(total + pseudo, 1.0), FLOOR * np.minimum(1.0, start / start[1000])[:, None])
    probability[-1] = FLOOR
    prior = np.full(k, -np.log(max(k, 1)))
    return Model(languages, table, probability, prior)


def predict(docs: DataFrame, model: Model, *, id_col="doc_id", text_col="text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (the id by default) with lang_pred and score, the posterior of the predicted language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or [id_col]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", lang_pred string, score double"
    # a text that is kept is sent to Python once
    place = keep.index(text_col) if text_col in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.languages)
        for batch in common.slices(batches, place):
            text = batch.column(place)
            label, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if k:
                data, offsets = common.text_bytes(pc.utf8_lower(text))
                words, order, per_text = common.words_of(data, offsets)
                table = word_scores(words.cast(pa.large_string()).to_pylist(), m.table, m.probability)
                total = common.sum_by_text(table[order], per_text) + m.prior
                total -= total.max(axis=1, keepdims=True)
                total = np.exp(total)
                total /= total.sum(axis=1, keepdims=True)
                best = total.argmax(axis=1)
                has_letter = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\pL"), False))
                for i in np.flatnonzero(has_letter):
                    label[i] = m.languages[best[i]]
                    score[i] = total[i, best[i]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(label, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    columns = keep if text_col in keep else [*keep, F.col(text_col).cast("string").alias("_langid_text")]
    return docs.select(*columns).mapInArrow(common.lean(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = common.id_remainder(F.col("doc_id"), 4) == 2
    model = fit(docs, ~held_out)
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
