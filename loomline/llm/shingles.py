"""Sets of hashed word shingles, over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
_TABLE = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word: runs of bytes other than ASCII white space."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(~space, prepend=False, append=False))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each word, from a sum over its bytes weighted by their place in it."""
    if not len(first):
        return np.empty(0, np.uint64)
    length = end - first
    starts = np.cumsum(length) - length
    place = np.arange(starts[-1] + length[-1]) - np.repeat(starts, length)
    powers = np.cumprod(np.full(int(length.max()) + 1, _C1, np.uint64))
    return np.add.reduceat(_TABLE[data[np.repeat(first, length) + place]] * powers[place], starts)


def blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK or i + 1 == len(texts):
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each text, A to Z lower-cased; fewer words make one shingle, none no set."""
    for _, some in blocks(texts):
        data = np.frombuffer(b" ".join(some) + b" ", np.uint8)
        data = data + ((data >= 65) & (data <= 90)).view(np.uint8) * np.uint8(32)
        first, end = word_spans(data)
        h = mixed(word_hashes(data, first, end))  # else letters of neighbouring words could change places unseen
        ends = np.searchsorted(first, np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1))
        rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            rolled = rolled * _C1 + h[j : j + len(rolled)]
        rolled, at = mixed(rolled), 0
        for stop in ends.tolist():
            if stop - at >= k:
                own = np.sort(rolled[at : stop - k + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif stop > at:
                whole = np.array([stop - at], np.uint64)
                for x in h[at:stop]:
                    whole = whole * _C3 + x
                yield mixed(whole)
            else:
                yield np.empty(0, np.uint64)
            at = stop
