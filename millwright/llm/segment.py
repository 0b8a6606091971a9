"""SentencePiece-style encoding: distinct sampled segmentations by Gumbel top-k without replacement.

A text is cut into chunks (a space and the word after it, or a line break); the
lattice of a chunk holds all its segmentations into pieces of a fixed public
vocabulary, a piece's weight falling with its rank there, and characters that
no piece covers as their bytes. The product over the chunks is the distribution
of a text's segmentations.

The search is perturbed A-star. A node of the search tree is a set of
segmentations that share a prefix; its key is the largest Gumbel-perturbed
log-probability inside it, drawn top-down, so the segmentations come out in
descending perturbed order: an exact sample without replacement. A node is
opened along the whole path of its best segmentation at once: what leaves the
path at each chunk becomes one new node, whose key is a truncated Gumbel. All
texts of a slice take their n-th step together. With K segmentations emitted,
the next key is the threshold, and 1 - exp(-exp(log p - threshold)) a
segmentation's inclusion score.

All random numbers are hashes of the row key, the chunk's place and the step,
so a row's result depends on nothing else.

Null and empty texts have one segmentation without pieces. A text with fewer
than K segmentations yields those it has. Null keys hash like the empty string,
and equal rows give equal results. Chunks of more than MAX_CHARS code points
are cut in runs of that length; whole texts are encoded and decoded without
loss. An empty table gives an empty result. Only the columns asked for are read.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm import common
from millwright.llm.lattice import MAX_CHARS, SPACE_MARK, PieceTable, load_pieces, piece_ids, runs

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SEED, SMOOTHING = 4, 1, 0.3
#: Bytes of text in a slice; the lattices of its distinct chunks are held together.
SLICE_BYTES = 1 << 20
#: Chunks whose lattices are kept when there are more than MOST: those that most slices had so far.
HELD, MOST = 60_000, 100_000
#: Chunks of several samples that are spelled together.
GROUP = 1 << 21
#: New chunks, and long chunks of a draw, that are worked on together; the arrays stay within the processor's cache.
ADDED, BLOCK = 1 << 12, 1 << 15
#: Chunks up to this length have at most 2 ** (SHORT - 1) segmentations, which are listed.
SHORT = 7
_U = np.uint64
_A, _B, _C, _D = (_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
#: A code that no text has, for a space mark in the text itself, which must not become a space.
_LITERAL_MARK = 0x110000


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h *= _B
    h ^= h >> _U(27)
    h *= _C
    h ^= h >> _U(31)
    return h


def _uniform(state: np.ndarray, step: int) -> np.ndarray:
    """In (0, 1], by hash of a row's key with a chunk's place (see _state) and the step."""
    h = _mix(state + _U(step * int(_D) % (1 << 64)))
    h >>= _U(11)
    u = h.astype(np.float64)
    u += 1.0
    u *= 2.0**-53
    return u


def _state(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    return key + place.astype(np.uint64) * _A


def _draw(state: int, step: int) -> float:
    """_uniform for one number."""
    m = (1 << 64) - 1
    h = state + step * int(_D) & m
    h = (h ^ h >> 30) * int(_B) & m
    h = (h ^ h >> 27) * int(_C) & m
    h ^= h >> 31
    return ((h >> 11) + 1.0) * 2.0**-53


def weights(pieces: list[str], smoothing: float = SMOOTHING) -> np.ndarray:
    """Log-weight of each piece by rank, and of a byte; the exponent flattens the distribution as in subword regularisation."""
    w = -np.log(np.arange(len(pieces)) + 50.0)
    return smoothing * np.append(w - np.log(np.exp(w).sum()), -12.0)


class Lattices:
    """The distributions over segmentations of many chunks, in flat arrays.

    New chunks are added in order of length, so those of one length lie together.
    A chunk of up to SHORT characters has all its segmentations listed: entry m
    from ``base[c]`` is the one whose inner ends are the bits of m. A longer
    chunk has the conditional probabilities of its edges, and only of those that
    are pieces: those that start at position s begin at ``rows[row[c] + s]``, by
    ascending ``length``. ``cdf`` sums the probabilities
    of a list, or of the edges of one position.
    """

    def __init__(self, table: PieceTable, logw: np.ndarray):
        self.table, self.logw = table, logw
        self.held = pa.array([], pa.large_string())
        #: of each chunk: characters, entries, the place of the first one and of its row, slices that had it
        self.n = self.entries = self.base = self.row = self.uses = np.zeros(0, np.int64)
        #: n, in one byte
        self.size = np.zeros(0, np.uint8)
        self.p, self.cdf, self.length, self.used = np.zeros(1 << 20, np.float32), np.zeros(1 << 20, np.float32), np.zeros(1 << 20, np.uint8), 0
        self.rows, self.rows_used = np.zeros(1 << 18, np.int64), 0
        self.last: tuple = (-1, None)

    @property
    def chunks(self) -> list[str]:
        return self.held.to_pylist()

    def numbers(self, chunks: pa.Array | list[str]) -> np.ndarray:
        """Numbers of a slice's chunks. Before it, rare chunks of earlier slices make room."""
        if len(self.held) > MOST:
            self._drop()
        chunks = pa.array(chunks, pa.large_string()) if isinstance(chunks, list) else chunks
        out = np.asarray(pc.fill_null(pc.index_in(chunks, self.held), -1)).astype(np.int64)
        if len(lost := np.flatnonzero(out < 0)):
            lost = lost[np.argsort(np.asarray(pc.utf8_length(chunks.take(pa.array(lost)))), kind="stable")]
            new, first = chunks.take(pa.array(lost)), len(self.held)
            out[lost] = np.arange(first, first + len(new))
            self.held = pa.concat_arrays([self.held, new])
            self._add(new.to_pylist())
        self.uses[out] += 1
        return out

    def _drop(self) -> None:
        """Keep the HELD chunks in most use, the earlier ones of equal use, and move their lists together."""
        self.last = (-1, None)
        keep = np.sort(np.argsort(-self.uses, kind="stable")[:HELD])
        self.n, self.entries, self.uses, self.size = self.n[keep], self.entries[keep], self.uses[keep], self.size[keep]
        before, rows = self.base[keep], np.where(self.n <= SHORT, 0, self.n + 1)
        self.base, self.used = _moved((self.p, self.cdf, self.length), before, self.entries)
        self.row, self.rows_used = _moved((self.rows,), self.row[keep], rows)
        self.rows[: self.rows_used] -= np.repeat(before - self.base, rows)
        self.held = self.held.take(pa.array(keep))

    def _add(self, chunks: list[str]) -> None:
        """The distributions of new chunks, ordered by length."""
        new = zip(*(self._block(chunks[a : a + ADDED]) for a in range(0, len(chunks), ADDED)))
        self.n, self.entries, self.base, self.row = (np.concatenate([x, *more]) for x, more in zip((self.n, self.entries, self.base, self.row), new))
        self.uses, self.size = np.append(self.uses, np.zeros(len(chunks), np.int64)), self.n.astype(np.uint8)

    def _block(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Their distributions, all worked on at once from the chunks' ends; n, entries, base and row."""
        n = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        ends = np.cumsum(n)
        left = (np.repeat(ends, n) - np.arange(len(codes))).astype(np.uint8)
        count, length, p = self._edges(codes, left)
        first = np.concatenate([[0], np.cumsum(count)])
        short = int(np.searchsorted(n, SHORT, "right"))
        lists = [np.zeros(0, np.float32)] * 2
        for size in range(1, SHORT + 1):
            a, b = (int(x) for x in np.searchsorted(n[:short], [size, size + 1]))
            if a < b:
                at, to = ends[a] - size, ends[b - 1]
                own, times = slice(first[at], first[to]), count[at:to]
                # positions first: each edge then fills a column
                dense = np.zeros((size, size, b - a), np.float32)
                start, column = np.arange(size) * (size * (b - a)), np.arange(b - a)
                place = np.repeat((column[:, None] + start).ravel(), times) + (length[own].astype(np.int64) - 1) * (b - a)
                dense.ravel()[place] = p[own]
                some = np.ascontiguousarray(_listed(dense).T)
                total = np.cumsum(some, axis=1)
                total /= total[:, -1:]
                lists = [np.concatenate([x, y.ravel()]) for x, y in zip(lists, (some, total))]
        # the longer chunks lie behind; their edges are in order
        at = int(ends[short - 1]) if short else 0
        begin, count, own = first[at:-1] - first[at], count[at:], p[first[at] :]
        starts = ends[short:] - n[short:] - at
        entries = np.concatenate([np.int64(1) << np.maximum(n[:short] - 1, 0), np.diff(np.append(begin, len(own))[np.append(starts, len(begin))])])
        bases, rows = np.cumsum(entries) - entries + self.used, np.where(n <= SHORT, 0, n + 1)
        row = np.cumsum(rows) - rows + self.rows_used
        self._room(int(entries.sum()), int(rows.sum()))
        for x, parts in ((self.p, (lists[0], own)), (self.cdf, (lists[1], _cumulated(own, begin, count)))):
            x[self.used : self.used + len(lists[0])], x[self.used + len(lists[0]) : self.used + len(lists[0]) + len(own)] = parts
        self.length[self.used + len(lists[0]) : self.used + len(lists[0]) + len(own)] = length[first[at] :]
        if len(starts):
            times, front = n[short:], self.used + len(lists[0])
            self.rows[np.arange(len(begin)) + np.repeat(np.arange(len(times)), times) + self.rows_used] = begin + front
            self.rows[row[short:] + times] = bases[short:] + entries[short:]
        self.used, self.rows_used = self.used + int(entries.sum()), self.rows_used + int(rows.sum())
        return n, entries, bases, row

    def _room(self, entries: int, rows: int) -> None:
        if (more := self.used + entries - len(self.p)) > 0:
            self.p, self.cdf, self.length = (np.concatenate([x, np.zeros(more + (1 << 19), x.dtype)]) for x in (self.p, self.cdf, self.length))
        if (more := self.rows_used + rows - len(self.rows)) > 0:
            self.rows = np.concatenate([self.rows, np.zeros(more + (1 << 17), np.int64)])

    def _edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many edges start at each place, and the edges' lengths and conditional probabilities, by place and length.

        ``left`` counts the characters from each place to its chunk's end.
        """
        codes = np.where(codes == ord(SPACE_MARK), _U(_LITERAL_MARK), codes)
        codes = np.where(codes == 0x20, _U(ord(SPACE_MARK)), codes)
        found = list(self.table.parts(codes, left))
        covered = np.zeros(len(codes), bool)
        covered[found[0][1]] = True
        lost = np.flatnonzero(~covered)
        found.insert(0, (1, lost, np.full(len(lost), len(self.table.pieces), np.int32)))
        count = np.zeros(len(codes), np.int64)
        for _, at, _ in found:
            count[at] += 1
        fill = np.cumsum(count) - count
        edges = int(count.sum())
        length, x = np.empty(edges, np.uint8), np.empty(edges)
        w = np.exp(self.logw)
        for size, at, numbers in found:
            to = fill.take(at)
            length[to], x[to] = size, w.take(numbers)
            fill[at] += 1
        if len(lost):
            c = codes[lost]
            c = np.where(c == _LITERAL_MARK, _U(ord(SPACE_MARK)), c)
            x[fill[lost] - count[lost]] = np.exp(self.logw[-1] * (1.0 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)))
        place = np.repeat(np.arange(len(codes)), count)
        rest = left.take(place)
        # from the chunks' ends: all places with as many characters left at once
        by = np.argsort(rest, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(rest))])
        x = (x * (64.0 ** np.arange(self.table.longest + 1)).take(length)).take(by)
        place = place.take(by)
        to = np.where(rest == length, len(codes), np.repeat(np.arange(len(codes)), count) + length).take(by)
        begins = np.flatnonzero(np.diff(place, prepend=-1))
        each = np.searchsorted(begins, cuts)
        beta = np.ones(len(codes) + 1)
        for i in range(1, len(cuts) - 1):
            a, b = cuts[i], cuts[i + 1]
            if a < b:
                x[a:b] *= beta.take(to[a:b])
                first = begins[each[i] : each[i + 1]]
                beta[place[first]] = np.add.reduceat(x[a:b], first - a)
        p = np.empty(edges, np.float32)
        p[by] = x / beta.take(place)
        return count, length, p

    def sample(self, chunk: np.ndarray, state: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk the mask of piece ends (bit i: a piece ends after i + 1 characters) and the log-probability."""
        mask, p = np.zeros(len(chunk), np.uint64), np.ones(len(chunk))
        # chunks of one length have lists of one size, 2 ** (n - 1)
        size = self.size.take(chunk)
        for n in range(1, SHORT + 1):
            some = np.flatnonzero(size == n)
            if not len(some):
                continue
            at = base = self.base.take(chunk.take(some))
            if n > 1:
                u, at = _uniform(state.take(some), step * 64).astype(np.float32), base.copy()
                for jump in (1 << i for i in reversed(range(n - 1))):
                    at += jump * (self.cdf.take(at + (jump - 1)) < u)
            mask[some] = (at - base + (1 << (n - 1))).astype(np.uint64)
            p[some] = self.p.take(at)
        long = np.flatnonzero(size > SHORT)
        for a in range(0, len(long), BLOCK):
            live = long[a : a + BLOCK]
            own, here, turn = chunk.take(live), state.take(live), 0
            row = self.row.take(own)
            spot, end = row, row + self.n.take(own)
            ends, logs = np.zeros(len(live), np.uint64), np.ones(len(live))
            while len(live):
                to = self._pick(self.rows.take(spot), _uniform(here, step * 64 + turn).astype(np.float32))
                spot = spot + self.length.take(to)
                ends |= _U(1) << (spot - row - 1).view(np.uint64)
                logs *= self.p.take(to)
                over = spot == end
                if len(done := np.flatnonzero(over)):
                    out, go = live.take(done), np.flatnonzero(~over)
                    mask[out], p[out] = ends.take(done), logs.take(done)
                    live, spot, end, row, here, ends, logs = (x.take(go) for x in (live, spot, end, row, here, ends, logs))
                turn += 1
        return mask, np.log(p)

    def _pick(self, to: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The first place from ``to`` on whose cdf reaches u. A position's last one does, and most have few."""
        below = np.flatnonzero(self.cdf.take(to) < u)
        while len(below):
            now = to.take(below) + 1
            to[below] = now
            below = below.take(np.flatnonzero(self.cdf.take(now) < u.take(below)))
        return to

    def probability(self, chunk: int, mask: int) -> float:
        n = int(self.n[chunk])
        if n <= SHORT:
            return float(self.p[self.base[chunk] + (mask & (1 << (n - 1)) - 1)])
        return self._rest(chunk, 0, lengths_of(mask))

    def other(self, chunk: int, taken: list[int], state: int, step: int) -> tuple[int, float]:
        """Mask and log-probability of a segmentation of one chunk that is none of those taken (as masks)."""
        n, base = int(self.n[chunk]), int(self.base[chunk])
        if n <= SHORT:
            top = 1 << (n - 1)
            mass = self.p[base : base + top].tolist()
            for m in taken:
                mass[m & top - 1] = 0.0
            left, found = _draw(state, step) * sum(mass), -1
            for i, m in enumerate(mass):
                if m:
                    found = i
                    left -= m
                    if left <= 0:
                        break
            return (found | top, math.log(mass[found])) if found >= 0 else (-1, -np.inf)
        open_ = [lengths_of(m) for m in taken]
        rows, sizes, every = self._own(chunk)
        at, mask, logp = 0, 0, 0.0
        while at < n:
            first, last = rows[at], rows[at + 1]
            p = every[first:last]
            mass = list(p)
            for lengths in open_:
                i = sizes.index(lengths[0], first, last) - first
                mass[i] -= p[i] * self._rest(chunk, at + lengths[0], lengths[1:])
            mass = [m if m >= 1e-7 * q and m > 0 else 0.0 for m, q in zip(mass, p)]  # less is rounding
            total = sum(mass)
            if total <= 0:
                return -1, -np.inf
            left, found = _draw(state, step + at) * total, 0
            for i, m in enumerate(mass):
                if m:
                    found = i
                    left -= m
                    if left <= 0:
                        break
            length = sizes[first + found]
            open_ = [x[1:] for x in open_ if x[0] == length and len(x) > 1]
            logp += math.log(p[found])
            at += length
            mask |= 1 << (at - 1)
        return mask, logp

    def _rest(self, chunk: int, at: int, lengths: list[int]) -> float:
        rows, sizes, p = self._own(chunk)
        out = 1.0
        for length in lengths:
            out *= p[sizes.index(length, rows[at], rows[at + 1])]
            at += length
        return out

    def _own(self, chunk: int) -> tuple[list[int], bytes, list[float]]:
        """The rows, lengths and probabilities of a long chunk; those of the last one asked for are at hand."""
        if self.last[0] != chunk:
            base, row = int(self.base[chunk]), int(self.row[chunk])
            own = slice(base, base + int(self.entries[chunk]))
            self.last = chunk, ((self.rows[row : row + int(self.n[chunk]) + 1] - base).tolist(), self.length[own].tobytes(), self.p[own].tolist())
        return self.last[1]


def _moved(lists: tuple[np.ndarray, ...], base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, int]:
    """Move kept stretches together at the front, in place; where each then lies, and the end of all."""
    ends = np.cumsum(size)
    # forwards in runs, each to where it or an earlier one lay
    for a in range(0, len(base), 1 << 13):
        own = slice(a, a + (1 << 13))
        first, last = int(ends[a] - size[a]), int(ends[own][-1])
        spots = np.repeat(base[own] - (ends[own] - size[own]), size[own]) + np.arange(first, last)
        for x in lists:
            x[first:last] = x.take(spots)
    return ends - size, int(ends[-1]) if len(ends) else 0


def _cumulated(p: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Running sums of the edges of each position, over their total."""
    cdf, place, k = p.copy(), np.flatnonzero(count > 1), 1
    while len(place):
        to = first.take(place) + k
        cdf[to] = cdf.take(to - 1) + p.take(to)
        k += 1
        place = place[count.take(place) > k]
    return cdf / np.repeat(cdf.take(first + count - 1), count) if len(p) else cdf


def _listed(dense: np.ndarray) -> np.ndarray:
    """Probability of every segmentation of equally long strings, by the bits of its inner ends.

    Suffixes are built from the end: those from one position, by their inner
    ends, are each a first piece before a shorter suffix.
    """
    n, _, rows = dense.shape
    # suffix[s][m]: probability of the rest from s, whose inner ends are the bits of m relative to s
    suffix: dict[int, np.ndarray] = {n: np.ones((1, rows), np.float32)}
    for s in reversed(range(n)):
        out = np.empty((1 << (n - s - 1), rows), np.float32)
        out[0] = dense[s, n - s - 1]
        for length in range(1, n - s):
            # a piece ends after ``length`` characters and nowhere before
            out[1 << (length - 1) :: 1 << length] = dense[s, length - 1] * suffix[s + length]
        suffix[s] = out
    return suffix[0]


def lengths_of(mask: int) -> list[int]:
    """Lengths of the pieces of a mask of ends."""
    out, last, mask = [], 0, int(mask)
    while mask:
        end = (mask & -mask).bit_length()
        out.append(end - last)
        last = end
        mask &= mask - 1
    return out


def chunked(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """cut_in_chunks, with the chunks as a list."""
    chunks, order, per_text = cut_in_chunks(column)
    return chunks.to_pylist(), order, per_text


def cut_in_chunks(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct chunks of a slice, the number of each chunk in order, and chunk offsets by text.

    A text's first chunk gets a space in front, as the vocabulary expects at
    the start of a text; decoding takes it off.
    """
    column = pc.fill_null(column, "").cast(pa.large_string())
    column = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
    data, offsets = common.text_bytes(column)
    start = (data == 0x20) | (data == 0x0A)
    start[1:] |= data[:-1] == 0x0A
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    begins = np.flatnonzero(start)
    per_text = np.searchsorted(begins, offsets)
    where = np.append(begins, len(data)).astype(np.int64)
    values = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(data))])
    coded = values.dictionary_encode()
    distinct, order = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
    length = np.asarray(pc.utf8_length(distinct))
    if len(long := np.flatnonzero(length > MAX_CHARS)):
        chunks, short = distinct.to_pylist(), np.flatnonzero(length <= MAX_CHARS)
        number = dict(zip((chunks[i] for i in short.tolist()), range(len(short))))
        parts = [[number.setdefault(x, len(number)) for x in runs(chunks[i])] for i in long.tolist()]
        count = np.ones(len(chunks), np.int64)
        count[long] = list(map(len, parts))
        first = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.int64)
        flat[first[short]] = np.arange(len(short))
        for a, x in zip(first[long].tolist(), parts):
            flat[a : a + len(x)] = x
        times = count[order]
        ends = np.concatenate([[0], np.cumsum(times)])
        inside = np.arange(ends[-1]) - np.repeat(ends[:-1], times)
        order = flat[np.repeat(first[order], times) + inside]
        per_text = ends[per_text]
        distinct = pa.array(list(number), pa.large_string())
    return distinct, order, per_text


def _best(v: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of each text and its place; -inf without chunks."""
    texts = len(offsets) - 1
    top, at = np.full(texts, -np.inf), np.zeros(texts, np.int64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        top[full] = np.maximum.reduceat(v, offsets[full])
        owner = np.repeat(np.arange(texts), np.diff(offsets))
        hit = np.flatnonzero(v == top[owner])
        at[owner[hit[::-1]]] = hit[::-1]
    return top, at


def _keys(logp: np.ndarray, offsets: np.ndarray, bound: np.ndarray, u: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Perturbed keys of all that leaves a path at each chunk, and the log-probability of each path up to the chunk."""
    texts = np.diff(offsets)
    run = np.cumsum(logp) - logp
    first = np.repeat(run[np.minimum(offsets[:-1], max(len(run) - 1, 0))] if len(run) else np.zeros(len(texts)), texts)
    prefix = run - first + np.repeat(before, texts)
    left = -np.expm1(np.minimum(logp, 0.0))
    with np.errstate(divide="ignore"):
        phi = prefix + np.log(np.where(left < 1e-6, 0.0, left))
        key = phi - np.log(np.exp(np.minimum(phi - np.repeat(bound, texts), 700)) - np.log(u))
    key[~np.isfinite(phi)] = -np.inf
    return key, prefix


class Paths:
    """The samples of all texts of a slice, found step by step."""

    def __init__(self, column: pa.Array, keys: list[str], lattices: Lattices, samples: int, seed: int):
        chunks, order, self.offsets = cut_in_chunks(column)
        self.lattices = lattices
        numbers = lattices.numbers(chunks)
        self.order = numbers[order] if len(order) else order
        # the distinct chunks of this slice, for what is computed once for each
        self.own, self.own_order = chunks, order
        texts = len(keys)
        key = np.fromiter((xxhash.xxh3_64_intdigest(k, seed=seed) for k in keys), np.uint64, texts)
        size = np.diff(self.offsets)
        owner = np.repeat(np.arange(texts), size)
        place = np.arange(len(self.order)) - np.repeat(self.offsets[:-1], size)
        self.place = place
        self.state = _state(key[owner], place)
        perturbed = -np.log(-np.log(np.minimum(_uniform(key, 1), 1 - 2**-53)))
        mask, logp = self.lattices.sample(self.order, self.state, 2)
        total = common.sum_by_text(logp, self.offsets)
        #: for each sample: which texts have it, masks of those texts' chunks, their offsets, log-probability and perturbed value
        self.found = [(np.arange(texts), mask, self.offsets, total, perturbed)]
        value, prefix = _keys(logp, self.offsets, perturbed, _uniform(self.state, 3), np.zeros(texts))
        # a frontier holds, for the suffix of some texts, the keys of what leaves one sample's path
        frontier = [[np.arange(texts), self.offsets, np.zeros(texts, np.int64), mask, logp, value, prefix, {}]]
        self.threshold = np.full(texts, -np.inf)
        for j in range(1, samples + 1):
            top, which, at = np.full(texts, -np.inf), np.zeros(texts, np.int64), np.zeros(texts, np.int64)
            for f, (own, offsets, _, _, _, value, _, _) in enumerate(frontier):
                best, where = _best(value, offsets)
                better = best > top[own]
                top[own[better]], which[own[better]], at[own[better]] = best[better], f, where[better]
            if j == samples:
                self.threshold = top
                break
            go = np.flatnonzero(np.isfinite(top))
            if not len(go):
                break
            self._open(frontier, j, go, which, at, top)

    def _open(self, frontier: list, j: int, go: np.ndarray, which: np.ndarray, at: np.ndarray, top: np.ndarray) -> None:
        """Take the best node of each text in ``go``: a new segmentation, and the nodes that leave its path."""
        first = np.zeros(len(go), np.int64)  # place in the text of the chunk at which the node left its path
        start_mask, start_logp, before = np.zeros(len(go), np.uint64), np.zeros(len(go)), np.zeros(len(go))
        keep = np.ones(len(go), bool)
        source, spots = which[go], at[go]
        places, masks, prefixes = np.zeros(len(go), np.int64), np.zeros(len(go), np.uint64), np.zeros(len(go))
        for f in np.unique(source).tolist():
            mine = np.flatnonzero(source == f)
            own, offsets, begin, mask, _, _, prefix, _ = frontier[f]
            row, spot = np.searchsorted(own, go[mine]), spots[mine]
            places[mine], masks[mine], prefixes[mine] = begin[row] + spot - offsets[row], mask[spot], prefix[spot]
        here = self.offsets[go] + places
        every = zip(source.tolist(), spots.tolist(), places.tolist(), masks.tolist(), prefixes.tolist(), self.order[here].tolist(), self.state[here].tolist(), top[go].tolist())
        for i, (f, a, place, own_mask, path, chunk, state, bound) in enumerate(every):
            value, taken = frontier[f][5], frontier[f][7]
            used = taken.setdefault(a, [own_mask])
            new, lp = self.lattices.other(chunk, used, state, (j * 97 + 13) * 64)
            if new < 0:
                value[a] = -np.inf
                keep[i] = False
                continue
            first[i], start_mask[i], start_logp[i], before[i] = place, new, lp, path
            used.append(new)
            left = 1.0 - sum(self.lattices.probability(chunk, m) for m in used)
            if left < 1e-6:
                value[a] = -np.inf
            else:
                phi = path + math.log(left)
                u = _draw(state, j * 64 + 17)
                value[a] = phi - math.log(math.exp(min(phi - bound, 700)) - math.log(u))
        go, first, start_mask, start_logp, before = go[keep], first[keep], start_mask[keep], start_logp[keep], before[keep]
        size = np.diff(self.offsets)[go] - first
        offsets = np.concatenate([[0], np.cumsum(size)])
        inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)
        place = np.repeat(first, size) + inside
        spot = np.repeat(self.offsets[go], size) + place
        chunk, state = self.order.take(spot), self.state.take(spot)
        mask, logp = np.zeros(len(chunk), np.uint64), np.zeros(len(chunk))
        rest = np.flatnonzero(inside)
        mask[rest], logp[rest] = self.lattices.sample(chunk[rest], state[rest], j * 8 + 2)
        mask[offsets[:-1]], logp[offsets[:-1]] = start_mask, start_logp
        value, prefix = _keys(logp, offsets, top[go], _uniform(state, j * 8 + 3), before)
        value[offsets[:-1]] = -np.inf  # what else leaves at that chunk belongs to the node it came from
        frontier.append([go, offsets, first, mask, logp, value, prefix, {}])
        self.found.append((go, mask, offsets, common.sum_by_text(logp, offsets) + before, top[go], which[go], first))

    def masks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(sample, texts, masks of all their chunks, offsets, log-probability, perturbed value)."""
        whole: list[np.ndarray] = []
        for j, f in enumerate(self.found):
            if not j:
                mask = f[1]
            else:
                texts, suffix, offsets, _, _, which, first = f
                mask = whole[0].copy()
                for w in np.unique(which):
                    if w:
                        of = np.repeat(np.isin(np.arange(len(self.offsets) - 1), texts[which == w]), np.diff(self.offsets))
                        mask[of] = whole[w][of]
                size = np.diff(offsets)
                to = np.repeat(self.offsets[texts] + first, size) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)
                mask[to] = suffix
            whole.append(mask)
            yield j, f[0], mask, f[3], f[4]


def decode(pieces: list[str] | list[int], model_file: str = MODEL_FILE) -> str:
    """The text of a list of pieces or of their ids; space marks stand for spaces, literal marks arrive as bytes."""
    if pieces and not isinstance(pieces[0], str):
        names = _names_by_id(model_file)
        pieces = [names[i] for i in pieces]
    text = bytearray()
    for p in pieces:
        text += bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and p.endswith(">") else p.replace(SPACE_MARK, " ").encode("utf-8", "surrogatepass")
    return bytes(text[1:]).decode("utf-8", "surrogatepass")


@functools.cache
def _names_by_id(model_file: str) -> dict[int, str]:
    names = load_pieces(model_file)
    return dict(zip(piece_ids(model_file).tolist(), names + [f"<0x{b:02X}>" for b in range(256)]))


def spelled(chunk: str, mask: int, known: set[str]) -> list[str]:
    out, at = [], 0
    for length in lengths_of(mask):
        piece = chunk[at : at + length]
        at += length
        marked = piece.replace(" ", SPACE_MARK)
        if marked in known and SPACE_MARK not in piece:
            out.append(marked)
        else:
            out += [f"<0x{b:02X}>" for b in piece.encode("utf-8", "surrogatepass")]
    return out


class Speller:
    """The pieces of many chunks at once, as numbers: a vocabulary piece's rank, and behind those the 256 bytes."""

    def __init__(self, pieces: list[str], table: PieceTable | None = None):
        self.table = table or PieceTable.of(pieces)
        names = pieces + [f"<0x{b:02X}>" for b in range(256)]
        self.names = pa.array(names, pa.string())
        self.code = np.fromiter((xxhash.xxh3_64_intdigest(n) for n in names), np.uint64, len(names))
        self.chunks: pa.Array | list[str] | None = None

    def _read(self, chunks: pa.Array | list[str]) -> None:
        """Code points of all chunks in a row, and sums from which the hash of any part follows."""
        if chunks is not self.chunks:
            self.chunks = chunks
            chunks = pa.array(chunks, pa.large_string()) if isinstance(chunks, list) else chunks
            codes = np.frombuffer(common.text_bytes(chunks)[0].tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
            codes = np.where(codes == ord(SPACE_MARK), _U(_LITERAL_MARK), codes)
            self.codes = np.where(codes == 0x20, _U(ord(SPACE_MARK)), codes)
            self.first = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(chunks)).astype(np.int64))])
            self.sums, self.powers = self.table.sums(self.codes)

    def spell(self, chunks: pa.Array | list[str], order: np.ndarray, mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts one after the other, and piece offsets by text."""
        return self.digested(chunks, order, mask, offsets, np.arange(len(self.names), dtype=np.int32))[:2]

    def digested(self, chunks: pa.Array | list[str], order: np.ndarray, mask: np.ndarray, offsets: np.ndarray, ids: np.ndarray | None) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """``ids`` of the pieces of all texts one after the other, piece offsets by text, and a digest of each text's pieces.

        Each distinct pair of chunk and mask is cut once. A digest is the sum of
        each piece's code times its place, so it follows from a pair's own sums
        and the pieces before it.
        """
        digest = np.zeros(len(offsets) - 1, np.uint64)
        if not len(order):
            return None if ids is None else ids[:0], np.zeros(len(offsets), np.int64), digest
        self._read(chunks)
        if len(chunks) <= 1 << 64 - MAX_CHARS:
            pair, pairs = pd.factorize(order.astype(np.uint64) << _U(MAX_CHARS) | mask)
            of, masks = (pairs >> _U(MAX_CHARS)).astype(np.int64), pairs & _U((1 << MAX_CHARS) - 1)
        else:
            masks, masks_found = pd.factorize(mask)
            pair, pairs = pd.factorize(order << np.int64(32) | masks)
            of, masks = pairs >> np.int64(32), masks_found[pairs & np.int64(0xFFFFFFFF)]
        count = np.bitwise_count(masks).astype(np.int64)
        row, start = np.repeat(np.arange(len(masks)), count), np.cumsum(count) - count
        end = np.empty(len(row), np.int64)
        for some, width in ((masks < _U(1 << 16), 2), (masks >= _U(1 << 16), 8)):
            own = count[some]
            bits = np.unpackbits(masks[some].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width], axis=1, bitorder="little")
            end[np.repeat(start[some] - np.cumsum(own) + own, own) + np.arange(own.sum())] = (np.flatnonzero(bits) & (8 * width - 1)) + 1
        begin = np.concatenate([[0], end[:-1]])
        begin[start] = 0
        at = self.first.take(of.take(row))
        begin, end = at + begin, at + end
        known, rank = self.table.find((self.sums.take(end) - self.sums.take(begin)) * self.powers.take(end))
        cut = np.full(len(row), -1, np.int64)
        cut[known] = rank
        numbers, each = self._bytes(cut, begin)
        size = count if len(numbers) == len(cut) else np.add.reduceat(each, start)
        first = np.cumsum(size) - size
        times = size.take(pair)
        ends = np.concatenate([[0], np.cumsum(times)])
        code = self.code.take(numbers)
        sums, inside = np.add.reduceat(code, first), np.arange(1, len(code) + 1) - np.repeat(first, size)
        placed = np.add.reduceat(code * inside.astype(np.uint64), first)
        full = np.flatnonzero(np.diff(offsets))
        here = sums.take(pair)
        before = ends[offsets[full]].astype(np.uint64)
        digest[full] = np.add.reduceat(placed.take(pair) + here * ends[:-1].astype(np.uint64), offsets[full]) - np.add.reduceat(here, offsets[full]) * before
        if ids is None:
            return None, ends[offsets], digest
        at = np.repeat((first.take(pair) - ends[:-1]).astype(np.int32), times)
        at += np.arange(len(at), dtype=np.int32)
        return pc.take(pa.array(ids.take(numbers)), pa.array(at), boundscheck=False).to_numpy(), ends[offsets], digest

    def _bytes(self, cut: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers with each character that no piece covers (-1) as its bytes, and how many numbers each entry became."""
        each = np.ones(len(cut), np.int64)
        lost = np.flatnonzero(cut < 0)
        if not len(lost):
            return cut, each
        codes = self.codes[begin[lost]]
        codes = np.where(codes == ord(SPACE_MARK), _U(0x20), codes)
        codes = np.where(codes == _LITERAL_MARK, _U(ord(SPACE_MARK)), codes)
        spelled = [bytes(chr(c), "utf-8", "surrogatepass") for c in codes.tolist()]
        each[lost] = [len(b) for b in spelled]
        numbers = np.repeat(cut, each)
        to = np.repeat(np.cumsum(each)[lost] - each[lost], each[lost])
        inside = np.arange(len(to)) - np.repeat(np.cumsum(each[lost]) - each[lost], each[lost])
        numbers[to + inside] = len(self.table.pieces) + np.frombuffer(b"".join(spelled), np.uint8).astype(np.int64)
        return numbers, each


def sample(docs: DataFrame, *, id_col="doc_id", text_col="text", keep: list[str] | None = None, samples=SAMPLES, seed=SEED, model_file=MODEL_FILE, pieces: bool | str = False) -> DataFrame:
    """One row for each text and sampled segmentation, in descending perturbed order.

    sample (from 1), n_chunks, n_pieces, log_prob, perturbed, inclusion, a
    64-bit digest of the pieces in order, and ``pieces``: with "ids" the ids
    that the vocabulary file gives them, with True their spelling.
    """
    keep = keep or [id_col]
    names = load_pieces(model_file)
    ids = piece_ids(model_file).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((PieceTable.of(names), weights(names)))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", sample int, n_chunks long, n_pieces long, log_prob double, perturbed double, inclusion double, digest long"
    schema += {False: "", True: ", pieces array<string>", "ids": ", pieces array<int>"}[pieces]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(*shared.value)
        speller = Speller(lattices.table.pieces, lattices.table)
        ranks = {False: None, True: np.arange(len(ids), dtype=np.int32), "ids": ids}[pieces]
        for whole in batches:
            for batch in _cut(whole):
                paths = Paths(batch.column(batch.num_columns - 1), [k or "" for k in batch.column(batch.num_columns - 2).to_pylist()], lattices, samples, seed)
                size = np.diff(paths.offsets)
                for group in _together(paths):
                    orders, starts = [], [np.zeros(1, np.int64)]
                    for _, texts, _, _, _, of in group:
                        orders.append(paths.own_order if of is None else paths.own_order[of])
                        starts.append(size[texts])
                    found, every, digests = speller.digested(paths.own, np.concatenate(orders), np.concatenate([g[2] for g in group]), np.cumsum(np.concatenate(starts)), ranks)
                    last = 0
                    for j, texts, _, logp, perturbed, _ in group:
                        ends, digest = every[last : last + len(texts) + 1], digests[last : last + len(texts)]
                        last += len(texts)
                        with np.errstate(over="ignore"):
                            inclusion = -np.expm1(-np.exp(np.minimum(logp - paths.threshold[texts], 700)))
                        rows = pa.array(texts)
                        columns = [c.take(rows) for c in batch.columns[:-2]]
                        columns += [pa.array(np.full(len(texts), j + 1, np.int32)), pa.array(size[texts]), pa.array(np.diff(ends)), pa.array(logp), pa.array(perturbed), pa.array(inclusion), pa.array(digest.view(np.int64))]
                        if pieces:
                            own = pa.array(found[ends[0] : ends[-1]])
                            columns.append(pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), own if pieces == "ids" else speller.names.take(own)))
                        yield pa.RecordBatch.from_arrays(columns, [*keep, "sample", "n_chunks", "n_pieces", "log_prob", "perturbed", "inclusion", "digest", *["pieces"] * bool(pieces)])

    return docs.select(*keep, F.col(id_col).cast("string").alias("_seg_key"), F.col(text_col).cast("string").alias("_seg_text")).mapInArrow(common.lean(run), schema)


def _together(paths: Paths) -> Iterator[list[tuple]]:
    """The samples of a slice with the chunks of their texts (None: all), in groups of up to GROUP chunks, one sample at least."""
    size, group, held = np.diff(paths.offsets), [], 0
    for j, texts, mask, logp, perturbed in paths.masks():
        of = None
        if len(texts) < len(size):
            with_it = np.zeros(len(size), bool)
            with_it[texts] = True
            of = np.repeat(with_it, size)
            mask = mask[of]
        if group and held + len(mask) > GROUP:
            yield group
            group, held = [], 0
        group.append((j, texts, mask, logp, perturbed, of))
        held += len(mask)
    if group:
        yield group


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0)).astype(np.int64)
    parts = np.cumsum(size) // SLICE_BYTES
    starts = np.flatnonzero(np.diff(parts, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def query(spark, sf_dir: str) -> DataFrame:
    return sample(common.read(spark, sf_dir, "documents").select("doc_id", "text"), pieces="ids")
