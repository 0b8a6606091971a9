"""Segmentation lattices of short strings over a fixed public vocabulary.

The vocabulary file is read on the driver alone; executors get the pieces as
hash arrays. All work is done for many strings of one length at a time: a
rolling hash finds every piece in every string, and the lattice recursions
run over whole columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Strings up to this many code points are worked on together.
MAX_CHARS = 48
#: Rows handled together; the arrays stay within the processor's cache.
ROWS = 1 << 14
_STEP = np.uint64(0x9E3779B97F4A7C15)
SPACE_MARK = "▁"


@dataclass
class PieceTable:
    """Pieces by hash. ``pieces[i]`` has number i; ``len(pieces)`` stands for a character no piece covers."""

    pieces: list[str]
    longest: int
    hashes: np.ndarray
    #: by the first bits of a hash: the piece's place, -1 for none, -2 for several
    slots: np.ndarray
    numbers: np.ndarray
    #: by the first bits of a hash: 1 if a piece may have it, and 2 if a longer piece may begin with the string
    marks: np.ndarray

    @classmethod
    def of(cls, pieces: list[str]) -> PieceTable:
        keys = np.array([_hash(p) for p in pieces], np.uint64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        if len(keys) > 1 and (keys[1:] == keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        first = (keys >> np.uint64(44)).astype(np.int64)
        slots = np.full(1 << 20, -1, np.int32)
        slots[first] = np.arange(len(keys))
        slots[first[1:][first[1:] == first[:-1]]] = -2
        marks = (slots != -1).astype(np.uint8)
        marks[[key >> 44 for p in pieces for key in _hashes(p)[:-1]]] |= 2
        return cls(pieces, max(map(len, pieces), default=1), keys, slots, order.astype(np.int32), marks)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of keys that are pieces, and the pieces' numbers."""
        at = self.slots[(keys >> np.uint64(44)).astype(np.int64)]
        rows = np.flatnonzero(at != -1)
        if not len(rows):
            return rows, rows
        at, keys = at[rows], keys[rows]
        if (several := np.flatnonzero(at == -2)).size:
            at[several] = np.minimum(np.searchsorted(self.hashes, keys[several]), len(self.hashes) - 1)
        good = self.hashes[at] == keys
        return rows[good], self.numbers[at[good]]

    def edges(self, codes: np.ndarray):
        """(start, length, rows, numbers) of all pieces in equally long strings, by ascending start.

        A character that is no piece of its own gets the number len(pieces).
        """
        count, n = codes.shape
        codes = np.ascontiguousarray(codes.T) + np.uint64(1)
        # all starts of one length at once: a few calls on long arrays
        key = np.zeros((n, count), np.uint64)
        found: list[list] = [[] for _ in range(n)]
        for length in range(1, min(self.longest, n) + 1):
            key = (key[: n - length + 1] + codes[length - 1 :]) * _STEP
            spots, numbers = self.find(key.ravel())
            cuts = np.searchsorted(spots, np.arange(n - length + 2) * count)
            for start in range(n - length + 1):
                a, b = cuts[start], cuts[start + 1]
                rows, own = spots[a:b] - start * count, numbers[a:b]
                if length == 1 and len(rows) < count:
                    missing = np.ones(count, bool)
                    missing[rows] = False
                    missing = np.flatnonzero(missing)
                    rows = np.concatenate([rows, missing])
                    own = np.concatenate([own, np.full(len(missing), len(self.pieces), np.int32)])
                if len(rows):
                    found[start].append((start, length, rows, own))
        for own in found:
            yield from own

    def parts(self, codes: np.ndarray, left: np.ndarray):
        """(length, places, numbers) of all pieces in strings of any lengths that lie one after the other, by ascending length.

        ``left`` counts the characters from each place to its string's end. A
        place is given up at the length from which no piece goes on.
        """
        codes = codes + np.uint64(1)
        at, key = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for length in range(1, self.longest + 1):
            key = (key + codes.take(at + (length - 1))) * _STEP
            marks = self.marks.take((key >> np.uint64(44)).view(np.int64))
            maybe = np.flatnonzero(marks & np.uint8(1))
            rows, numbers = self.find(key.take(maybe))
            yield length, at.take(maybe.take(rows)), numbers
            go = np.flatnonzero((marks > 1) & (left.take(at) > length))
            if not len(go):
                return
            at, key = at.take(go), key.take(go)

    @staticmethod
    def sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums and powers of a long string: (sums[b] - sums[a]) * powers[b] is the hash of its part from a to b."""
        back = np.uint64(pow(int(_STEP), -1, 1 << 64))
        one = np.ones(1, np.uint64)
        powers = np.concatenate([one, np.cumprod(np.full(len(codes), _STEP))])
        backs = np.concatenate([one, np.cumprod(np.full(len(codes), back))])
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + one) * backs[:-1])]), powers


def _hash(piece: str) -> int:
    return _hashes(piece)[-1] if piece else 0


def _hashes(piece: str) -> list[int]:
    """Of what the piece begins with, by length, itself included."""
    out, key = [], 0
    for c in piece:
        key = (key + ord(c) + 1) * int(_STEP) % (1 << 64)
        out.append(key)
    return out


def by_length(strings: list[str]):
    """(indices, code points) of strings of one length, ROWS at a time. Empty strings are left out."""
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        n = int(length[order[a]])
        if not n:
            continue
        for i in range(a, b, ROWS):
            index = order[i : min(b, i + ROWS)]
            text = "".join([strings[k] for k in index])
            yield index, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(index), n).astype(np.uint64)


def runs(word: str) -> list[str]:
    return [word[i : i + MAX_CHARS] for i in range(0, len(word), MAX_CHARS)] if len(word) > MAX_CHARS else [word]


def _ordinary(model) -> list[int]:
    """Ids of the ordinary pieces in order of their rank; control, unknown and byte pieces are left out."""
    keep = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return sorted(keep, key=lambda i: (-model.get_score(i), i))


def load_pieces(model_file: str) -> list[str]:
    """Ordinary pieces of a SentencePiece file in order of their rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [model.id_to_piece(i) for i in _ordinary(model)]


def piece_ids(model_file: str) -> np.ndarray:
    """The file's ids of the pieces of ``load_pieces`` and, behind them, of the 256 bytes; bytes that the file lacks follow its last id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    own = {model.id_to_piece(i): i for i in range(size) if model.is_byte(i)}
    return np.array(_ordinary(model) + [own.get(f"<0x{b:02X}>", size + b) for b in range(256)])
