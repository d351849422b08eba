"""Static binary-fuse filters over 64-bit keys: three slots a key in neighbouring segments, one byte a slot.

A filter is built once from all its keys and never changes. It holds every key it was built from; any other key
is held by chance once in 256. Building peels the keys layer by layer: a slot that only one key is left to use is that
key's own, and fingerprints are set in the opposite order.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

from serieslake.llm.words import mixed

_STEP = np.uint64(0x9E3779B97F4A7C15)
_ATTEMPTS = 100  # seeds tried; one in a few fails for tiny sets, almost none for large ones


class Fuse(NamedTuple):
    """One filter: the seed, the length of a segment, the number of starting segments, and a byte per slot."""

    seed: int
    segment: int
    segments: int
    slots: np.ndarray


def _shape(n: int) -> tuple[int, int]:
    """(length of a segment, number of segments that a key can start in) for so many keys.

    Both follow the published sizing of three-wise filters: segments grow with n ** (1 / ln 3.33), slots with 1.125 a key.
    """
    if n < 2:
        return 4, 1
    segment = 1 << min(18, int(math.log(n) / math.log(3.33) + 2.25))
    wanted = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    return segment, max(1, math.ceil(wanted / segment) - 2)


def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key, one row per key, and its fingerprint."""
    with np.errstate(over="ignore"):
        h = mixed(keys + _STEP * np.uint64(seed))
    first = (((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)).astype(np.int64)
    inner = segment - 1
    second = (first + segment) ^ ((h >> np.uint64(18)) & np.uint64(inner)).astype(np.int64)
    third = (first + 2 * segment) ^ (h & np.uint64(inner)).astype(np.int64)
    return np.stack((first, second, third), axis=1), (mixed(h) & np.uint64(255)).astype(np.uint8)


def _peeled(places: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """(keys, their own slots) layer by layer; None if some keys cannot be taken apart."""
    n = len(places)
    users = np.bincount(places.ravel(), minlength=size)
    total = np.zeros(size, np.int64)  # the sum of the users' numbers; with one user left, its number
    np.add.at(total, places.ravel(), np.repeat(np.arange(n), 3))
    layers, left = [], n
    alone = np.flatnonzero(users == 1)
    while len(alone):
        keys, at = np.unique(total[alone], return_index=True)
        layers.append((keys, alone[at]))
        left -= len(keys)
        touched = places[keys].ravel()
        np.subtract.at(users, touched, 1)
        np.subtract.at(total, touched, np.repeat(keys, 3))
        alone = np.unique(touched[users[touched] == 1])
    return None if left else layers


def build(keys: np.ndarray) -> Fuse:
    """The filter of the given 64-bit keys; repeated keys count once."""
    keys = np.unique(keys.view(np.uint64))
    segment, segments = _shape(len(keys))
    size = (segments + 2) * segment
    for seed in range(_ATTEMPTS):
        places, prints = _places(keys, seed, segment, segments)
        layers = _peeled(places, size)
        if layers is not None:
            break
    else:
        raise RuntimeError(f"no seed takes {len(keys)} keys apart")
    slots = np.zeros(size, np.uint8)
    for own, slot in reversed(layers):
        a, b, c = places[own].T
        slots[slot] = prints[own] ^ slots[a] ^ slots[b] ^ slots[c]  # the own slot is still 0
    return Fuse(seed, segment, segments, slots)


def holds(fuse: Fuse, keys: np.ndarray) -> np.ndarray:
    """For each key whether the filter may hold it; always true for the keys it was built from."""
    places, prints = _places(keys.view(np.uint64), fuse.seed, fuse.segment, fuse.segments)
    a, b, c = places.T
    return fuse.slots[a] ^ fuse.slots[b] ^ fuse.slots[c] == prints
