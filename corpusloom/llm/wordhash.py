"""64-bit hashes of the words of many texts at once, with numpy.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return, after lower-casing A-Z.  A word's hash is a polynomial of its bytes,
taken from prefix sums, and mixed; equal words have equal hashes in every worker.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from corpusloom.llm.common import LOWER

U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 21
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """Keeps the tables of powers; one per worker is enough."""

    def __init__(self):
        self._grow(_BLOCK)

    def _grow(self, n: int) -> None:
        self.powers = _powers(_R, n)
        self.inverse = _powers(pow(_R, -1, 1 << 64), n)

    def _block(self, data: np.ndarray, cuts: Sequence[int]) -> tuple[np.ndarray, ...]:
        """Starts, ends, hashes and piece hashes of the words of one block; words end inside it."""
        if len(data) > len(self.powers):
            self._grow(len(data))
        solid = np.empty(len(data) + 2, bool)
        solid[0] = solid[-1] = False
        np.logical_not(_SPACES[data], out=solid[1:-1])
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = edges[0::2], edges[1::2]
        sums = np.zeros(len(data) + 1, U)
        values = data.astype(U)
        values += U(1)
        values *= self.powers[: len(data)]
        np.cumsum(values, out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.inverse[starts]
        out = [starts, ends, mix(hashes + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))]
        for k in cuts:
            a = starts if k > 0 else np.maximum(starts, ends + k)
            z = np.minimum(ends, starts + k) if k > 0 else ends
            out.append(mix((sums[z] - sums[a]) * self.inverse[a] + U(k % 256)))
        return tuple(out)

    def words(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and where each text's words begin (one place more than texts)."""
        _, _, hashes, begins = self.pieces(texts)
        return hashes, begins

    def pieces(self, texts: Sequence[bytes], cuts: Sequence[int] = (), table: bytes = LOWER) -> tuple[np.ndarray, ...]:
        """Places (start, end) in the joined texts, hashes, a hash for each cut, and each text's first word.

        A cut of k takes a word's first k bytes, one of -k its last k; ``table`` maps the
        bytes before they are cut into words.  Texts are joined by one space.
        """
        blob = b" ".join(texts).translate(table)
        data = np.frombuffer(blob, np.uint8)
        found, at = [], 0
        while at < len(data):
            end = at + _BLOCK
            if end < len(data):
                space = np.flatnonzero(_SPACES[data[end - 4096 : end]])
                if len(space):
                    end = end - 4096 + int(space[-1]) + 1
                else:  # a very long word: go on to the next space
                    while end < len(data) and not _SPACES[data[end]]:
                        end += 1
            starts, ends, *hashes = self._block(data[at:end], cuts)
            found.append((starts + at, ends + at, *hashes))
            at = min(end, len(data))
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        begins = np.concatenate([[0], np.cumsum(lengths)])
        if not found:
            return (*[np.empty(0, np.int64)] * 2, *[np.empty(0, U)] * (1 + len(cuts)), np.zeros(len(texts) + 1, np.int64))
        columns = [np.concatenate(c) for c in zip(*found)]
        return (*columns, np.searchsorted(columns[0], begins))


_HASHER: list[WordHasher] = []


def hasher() -> WordHasher:
    if not _HASHER:
        _HASHER.append(WordHasher())
    return _HASHER[0]
