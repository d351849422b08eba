"""Hashes of all words of many texts at once, as array operations on their bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
_PER_RUN = 1 << 20  # bytes hashed at once; one longer text is hashed alone

# byte -> byte with A-Z lowered
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _kinds(**ranges: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for number, members in enumerate(ranges.values(), 1):
        out[list(members)] = number
    return out


_SPACE = {32, 9, 10, 11, 12, 13}
# runs of anything but ASCII white space
SPACED = _kinds(word=set(range(256)) - _SPACE)
# runs of letters and digits (with all bytes beyond ASCII), and runs of marks
_LETTERS = {*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)}
LETTERS_OR_MARKS = _kinds(letters=_LETTERS, marks=set(range(33, 127)) - _LETTERS)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, _PER_RUN + 64)
        with np.errstate(over="ignore"):
            up, down = np.full(size, STEP), np.full(size, _BACK)
            up[0] = down[0] = 1
            _powers, _inverses = np.cumprod(up, out=up), np.cumprod(down, out=down)
    return _powers, _inverses


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of several texts: byte offsets, hashes, and where each text begins."""

    def __init__(self, texts: list[bytes], kinds: np.ndarray):
        self.data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        kind = kinds[self.data]
        change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        edges = np.concatenate(([0], change, [len(kind)]))
        at = kind[edges[:-1]]
        word = at != 0
        self.start, self.end, self.kind = edges[:-1][word], edges[1:][word], at[word]
        powers, self._inverse = _tables(len(self.data) + 1)
        with np.errstate(over="ignore"):
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            own = self._sums[1:]  # in place: a run of a megabyte takes 8 MB here
            own[:] = LOWER[self.data]
            own += np.uint64(1)
            own *= powers[: len(own)]
            np.cumsum(own, out=own)
        self.hash = self.of(self.start, self.end)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        # words of text i are bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.start, begins)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges, A-Z lowered."""
        with np.errstate(over="ignore"):
            return mixed((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))


def runs(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, in runs of about a megabyte, each with the index of its first text."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode()
        if run and size + len(data) > _PER_RUN:
            yield first, run
            first, run, size = i, [], 0
        run.append(data)
        size += len(data) + 1
    if run:
        yield first, run


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i; empty ranges give 0."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]
