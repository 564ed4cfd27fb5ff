"""Texts of a batch laid out as one array of code points, and the runs of characters of a kind in it."""

from __future__ import annotations

import numpy as np

#: Code points from here on count as one.
TABLE = 0x20000


def laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each ended by a line break, and where each text begins (and the last one ends)."""
    codes = np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(codes, TABLE), np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))


class Runs:
    """Longest runs of characters of a kind (words, tokens) in texts laid out one after the other, none across two."""

    def __init__(self, inside: np.ndarray, bounds: np.ndarray) -> None:
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.start = np.flatnonzero(edge == 1)
        self.length = np.flatnonzero(edge == -1) - self.start
        self.count = np.diff(np.searchsorted(self.start, bounds))
        self.at = np.flatnonzero(inside)
        self.offset = np.cumsum(self.length) - self.length

    def any(self, flags: np.ndarray) -> np.ndarray:
        """The flags that any character of each run has."""
        return np.bitwise_or.reduceat(flags[self.at], self.offset) if len(self.start) else np.zeros(0, flags.dtype)

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """64-bit hashes of the runs' characters, the same on every machine."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        power = np.cumprod(np.full(int(self.length.max()), 0x9E3779B97F4A7C15, np.uint64))
        h = np.add.reduceat((codes[self.at].astype(np.uint64) + np.uint64(1)) * power[self.at - np.repeat(self.start, self.length)], self.offset)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
