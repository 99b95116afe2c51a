"""Words of many texts as numpy arrays: ids, hashes, hashes of word n-grams."""

from itertools import islice

import numpy as np
import xxhash

#: Words that a task remembers before it starts a new numbering.
REMEMBERED = 250_000
BASE = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    def __missing__(self, word):
        self[word] = number = len(self)
        return number


class Vocabulary:
    """Numbers words as they come; ``hashes[id]`` is the 64-bit hash of a word."""

    def __init__(self, hashed: bool = True):
        self._hashed = hashed
        self._clear()

    def _clear(self):
        self.ids = _Ids()
        self.hashes = np.zeros(0, np.uint64)

    def encode(self, texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """All words, their ids, and the offsets of each text's words (one more than texts).

        Ids hold until the next call.
        """
        if len(self.ids) > REMEMBERED:
            self._clear()
        split = [t.split() if t else [] for t in texts]
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, split), np.int64, len(split)), out=offsets[1:])
        words = [w for s in split for w in s]
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        known = len(self.hashes)
        if self._hashed and len(self.ids) > known:
            new = islice(self.ids, known, None)
            fresh = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(self.ids) - known)
            self.hashes = np.concatenate([self.hashes, fresh])
        return words, ids, offsets


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes (mod 2**64) of ``k`` consecutive values, at each start."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, length, power = None, 0, BASE
        block, size = hashes, 1
        while True:
            if k & size:
                if out is None:
                    out, length = block, size
                else:  # block first, then what has been gathered
                    factor = np.uint64(pow(int(BASE), length, 1 << 64))
                    n = len(hashes) - length - size + 1
                    out, length = block[:n] * factor + out[size : size + n], length + size
            if size * 2 > k:
                return out[: len(hashes) - k + 1]
            n = len(block) - size
            block = block[:n] * power + block[size:]
            power, size = power * power, size * 2


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def runs(starts: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of the runs of consecutive ``starts`` with equal ``same``."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.diff(starts) != 1
    for values in same:
        cut |= values[1:] != values[:-1]
    first = np.concatenate([[0], np.flatnonzero(cut) + 1])
    return first, np.diff(np.concatenate([first, [len(starts)]]))
