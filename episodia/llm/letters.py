"""Letter n-grams of many words at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from episodia.llm.words import U64, mixed

#: a word is a run of letters, in lower case
LETTERS = re.compile(r"[^\W\d_]+")
EDGE_IN, EDGE_OUT = 2, 3


def letter_words(text: bytes | None) -> list[str]:
    return LETTERS.findall(text.decode("utf-8", "replace").lower()) if text else []


def by_width(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices, code points between edge marks padded with 0, lengths) of words of like length."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    steps = [0, 8, 16, 32, 64]
    while len(lens) and steps[-1] < lens.max():
        steps.append(steps[-1] * 2)
    for low, high in zip(steps, steps[1:]):
        at = np.flatnonzero((lens > low) & (lens <= high)) if low else np.flatnonzero(lens <= high)
        room = max(1, (1 << 22) // (high + 2))
        for i in range(0, len(at), room):
            part = at[i:i + room]
            codes = np.array([words[j] for j in part], dtype=f"<U{high}").view(np.uint32).reshape(len(part), high)
            framed = np.zeros((len(part), high + 2), U64)
            framed[:, 0] = EDGE_IN
            framed[:, 1:-1] = codes
            framed[np.arange(len(part)), lens[part] + 1] = EDGE_OUT
            yield part, framed, lens[part]


def grams(framed: np.ndarray, lens: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, valid) of the letter n-gram at each place, edge marks included."""
    n, width = framed.shape
    for i in range(width - order + 1):
        valid = i + order <= lens + 2
        if not valid.any():
            break
        with np.errstate(over="ignore"):
            h = np.full(n, U64(order * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF), U64)
            for j in range(order):
                h = h * U64(0xD1342543DE82EF95) + framed[:, i + j]
        yield mixed(h), valid


def affixes(framed: np.ndarray, lens: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """Hashes of beginnings and endings of 1 to ``longest`` letters (edge marks fill short words)."""
    n = len(framed)
    rows = np.arange(n)
    with np.errstate(over="ignore"):
        head, tail = np.full(n, U64(0x51AF), U64), np.full(n, U64(0x7A11), U64)
        for i in range(longest):
            head = head * U64(0xD1342543DE82EF95) + framed[:, min(i + 1, framed.shape[1] - 1)]
            tail = tail * U64(0xD1342543DE82EF95) + framed[rows, np.maximum(lens - i, 0)]
            yield mixed(head + U64(i))
            yield mixed(tail + U64(i))


def whole(framed: np.ndarray) -> np.ndarray:
    """Hash of the whole word."""
    with np.errstate(over="ignore"):
        h = np.full(len(framed), U64(0x1E51), U64)
        for i in range(framed.shape[1]):
            c = framed[:, i]
            h = np.where(c > 0, h * U64(0xD1342543DE82EF95) + c, h)
    return mixed(h)
