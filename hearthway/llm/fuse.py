"""Static binary fuse filters over 64-bit keys, built and asked with whole arrays."""

from __future__ import annotations

import math
import struct

import numpy as np

from hearthway.llm.shared import mix64

_HEAD = "<QII"


def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, ...]:
    h = mix64(keys + np.uint64(seed))
    first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    print_of = (h ^ (h >> np.uint64(29))) & np.uint64(0xFF)
    return first.astype(np.int64), second.astype(np.int64), third.astype(np.int64), print_of.astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter over distinct keys: no key is ever missed, other keys pass once in 256 times."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if not n:
        return b""
    segment = 1 << min(18, max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * factor / segment) - 2)
    for attempt in range(200):
        seed = (0x9E3779B97F4A7C15 * (attempt + 1)) & 0xFFFFFFFFFFFFFFFF
        prints = _peel(keys, seed, segment, segments)
        if prints is not None:
            return struct.pack(_HEAD, seed, segment, segments) + prints.tobytes()
        if attempt % 10 == 9:
            segments += max(1, segments // 8)
    raise RuntimeError("no filter found")


def _peel(keys: np.ndarray, seed: int, segment: int, segments: int) -> np.ndarray | None:
    *spots, print_of = _places(keys, seed, segment, segments)
    spots = np.stack(spots)
    size = segment * (segments + 2)
    index = np.arange(len(keys))
    count = np.zeros(size, np.int64)
    sums = np.zeros(size, np.int64)
    for row in spots:
        np.add.at(count, row, 1)
        np.add.at(sums, row, index)
    order = []
    ready = np.flatnonzero(count == 1)
    left = len(keys)
    while len(ready):
        which, at = np.unique(sums[ready], return_index=True)
        order.append((which, ready[at]))
        left -= len(which)
        touched = spots[:, which].ravel()
        np.subtract.at(count, touched, 1)
        np.subtract.at(sums, touched, np.tile(which, 3))
        touched = np.unique(touched)
        ready = touched[count[touched] == 1]
    if left:
        return None
    prints = np.zeros(size, np.uint8)
    for which, at in reversed(order):
        a, b, c = spots[:, which]
        prints[at] = print_of[which] ^ prints[a] ^ prints[b] ^ prints[c]
    return prints


def contains(data: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key whether the filter may hold it."""
    if not data:
        return np.zeros(len(keys), bool)
    seed, segment, segments = struct.unpack_from(_HEAD, data)
    prints = np.frombuffer(data, np.uint8, offset=struct.calcsize(_HEAD))
    a, b, c, print_of = _places(keys.astype(np.uint64), seed, segment, segments)
    return (prints[a] ^ prints[b] ^ prints[c]) == print_of
