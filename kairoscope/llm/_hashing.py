"""Vectorised hashing of words and character n-grams with numpy, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
MIX = np.uint64(0xD6E8FEB86659FD93)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
_IS_STOP = np.zeros(256, bool)
_IS_STOP[[10, 33, 46, 63]] = True


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for every position of a piece."""
    n = PIECE + 1
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def pieces(raw: np.ndarray, inside: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, bool]]:
    """``raw`` whole, in pieces of at most PIECE that end behind something outside of words; and whether a piece is all one word that goes on (the last isn't)."""
    at = 0
    while at < len(raw):
        window = raw[at : at + PIECE]
        outside = np.flatnonzero(~inside(window)) if at + PIECE < len(raw) else [len(window) - 1]
        end = int(outside[-1]) + 1 if len(outside) else PIECE
        yield window[:end], not len(outside)
        at += end


class Words:
    """Hashes of the words of one piece after the other.  A word's hash is that of the whole word, however many pieces it spans."""

    def __init__(self) -> None:
        self.sum, self.length = 0, 0  # of the word that goes on

    def of(self, raw: np.ndarray, mask: np.ndarray, goes_on: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Starts, ends and hashes of the words that end in a piece, its prefix sums, and how many of these words began before it."""
        starts, ends = runs(mask)
        sums = prefix_sums(raw)
        hashes = (sums[ends] - sums[starts]) * powers()[1][starts]
        if goes_on or (self.length and len(starts) and starts[0] == 0):
            self.sum = (self.sum + pow(BASE, self.length, 1 << 64) * int(hashes[0])) % (1 << 64)
            self.length += len(raw) if goes_on else 0
            if goes_on:
                return starts[:0], ends[:0], hashes[:0], sums, 0
            hashes[0], self.length = self.sum, 0
            self.sum = 0
            return starts, ends, hashes, sums, 1
        if self.length:  # it ended where the piece before it did
            starts, ends, hashes = (np.concatenate((np.array([x], a.dtype), a)) for x, a in ((0, starts), (0, ends), (self.sum, hashes)))
            self.sum, self.length = 0, 0
            return starts, ends, hashes, sums, 1
        return starts, ends, hashes, sums, 0


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: the hash of [s, e) is (sums[e] - sums[s]) * BASE^-s."""
    up, _ = powers()
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return sums


def salted(hashes: np.ndarray, salt: int) -> np.ndarray:
    return mixed(hashes + np.uint64(salt))


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    _, down = powers()
    return salted((sums[ends] - sums[starts]) * down[starts], salt)


def letters(raw: np.ndarray) -> np.ndarray:
    return _IS_WORD[raw]


def not_spaces(points: np.ndarray) -> np.ndarray:
    """Of code points."""
    return ~((points == 32) | ((points >= 9) & (points <= 13)))


def stops(raw: np.ndarray) -> np.ndarray:
    return _IS_STOP[raw]
