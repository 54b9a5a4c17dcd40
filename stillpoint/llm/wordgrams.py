"""Words of texts as rows of a table, and character n-grams of those words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import regex

WORDS = regex.compile(r"\w+")
#: Runs that begin with a letter; marks belong to the letter before them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[str], low: int, high: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n from ``low`` to ``high``: the hashed n-grams of every word with its
    border marks, in word order, and the number of them for each word."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    sizes = np.fromiter(map(len, words), "i8", len(words)) + 2
    ends = np.cumsum(sizes)
    rest = np.repeat(ends, sizes) - np.arange(len(codes))
    rolled = np.zeros(len(codes), "u8")
    for n in range(1, high + 1):
        rolled = (rolled[: len(codes) - n + 1] * np.uint64(1_000_003) + codes[n - 1 :]) if n <= len(codes) else rolled[:0]
        if n >= low:
            mixed = (rolled ^ (rolled >> np.uint64(29))) * MULTIPLIER + np.uint64(n)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * MULTIPLIER
            ids = (mixed >> np.uint64(64 - bits)).astype("i8")
            yield ids[rest[: len(rolled)] >= n], np.maximum(sizes - n + 1, 0)


def word_ids(words: list[str], bits: int) -> np.ndarray:
    """A hashed id for each whole word."""
    import zlib

    raw = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), "u8", len(words))
    return ((raw * MULTIPLIER) >> np.uint64(64 - bits)).astype("i8")


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of consecutive groups of rows."""
    total = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, axis=0, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class WordTable:
    """Rows of numbers by word. ``make(words)`` computes the rows of new words, a batch
    of texts at a time; beyond ``most`` words the table starts anew. Row 0 is zero."""

    def __init__(self, make: Callable[[list[str]], np.ndarray], most: int = 250_000):
        self.make, self.most = make, most
        self.places: dict[str, int] = {}
        self.rows = np.zeros((1, 1))

    def look_up(self, texts: list[list[str]]) -> np.ndarray:
        """Places of all words of all texts, one after another."""
        if len(self.places) > self.most:
            self.places.clear()
            self.rows = self.rows[:1]
        places = self.places
        new = list(dict.fromkeys(w for ws in texts for w in ws if w not in places))
        if new:
            made = self.make(new)
            if self.rows.shape[1] != made.shape[1]:
                self.rows = np.zeros((1, made.shape[1]), made.dtype)
            places.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, made])
        n = sum(map(len, texts))
        return np.fromiter((places[w] for ws in texts for w in ws), "i8", n)
