"""Small helpers on word sequences that run inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


class WordTable(dict):
    """Word to row of a table of per-word values, filled word by distinct word.

    ``fill`` gets the list of new words and returns one row for each.  The table
    belongs to one worker and is emptied when it holds more than ``limit`` words,
    so its memory is bounded whatever the vocabulary.
    """

    def __init__(self, fill: Callable[[list], np.ndarray], limit: int = 400_000):
        super().__init__()
        self.fill, self.limit, self.fresh, self.values = fill, limit, [], None

    def __missing__(self, word):
        row = len(self)
        self[word] = row
        self.fresh.append(word)
        return row

    def rows(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def filled(self) -> np.ndarray:
        """The values of all words seen; call after :meth:`rows`."""
        if self.fresh:
            new = self.fill(self.fresh)
            old = len(self) - len(self.fresh)
            if self.values is None or len(self.values) < len(self):
                room = np.empty((max(2 * len(self), 1 << 14), *new.shape[1:]), new.dtype)
                if old:
                    room[:old] = self.values[:old]
                self.values = room
            self.values[old:len(self)] = new
            self.fresh = []
        return self.values

    def trim(self) -> None:
        """Forget all words if there are too many; call between batches."""
        if len(self) > self.limit:
            self.clear()
            self.fresh, self.values = [], None


def mixed(h: np.ndarray) -> np.ndarray:
    """A well spread permutation of 64-bit values (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def word_codes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), U64, len(words))


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; a shorter sequence counts as one run."""
    n = len(codes)
    if n == 0:
        return codes
    take = min(width, n)
    with np.errstate(over="ignore"):
        h = np.full(n - take + 1, U64(0x9E3779B97F4A7C15 * take & 0xFFFFFFFFFFFFFFFF), U64)
        for i in range(take):
            h = h * U64(0xD1342543DE82EF95) + mixed(codes[i:n - take + 1 + i] + U64(i))
    return mixed(h)


def text_parts(batch: pa.RecordBatch, most: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=0)) if len(sizes) else []
    edges = [0, *[int(c) for c in cuts if c > 0], len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
