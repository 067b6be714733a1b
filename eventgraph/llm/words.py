"""Words of a text as 64-bit hashes, computed over its UTF-8 bytes with whole-array operations.

A word is a maximal stretch of bytes other than space and 0x09-0x0D. A span is read in lanes of eight
bytes; each lane is mixed with its place in the span by a step that is not linear, the mixed lanes are
summed and the sum is mixed with the span's length. So no structure of the bytes carries over to the hash,
and two different spans meet as random numbers do, with a probability of about 2 ** -64 a pair;
results treat equal hashes as equal words. Texts made to collide by someone who knows the constants
below are not guarded against.
"""

from __future__ import annotations

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Of the last lane, the bytes that belong to the span.
_INSIDE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def lanes(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Entry i is the eight bytes from i on as one number; beyond the end there are zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = LOWER[data] if lower else data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _at(lane: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """A lane mixed with its place."""
    key = mixed(np.asarray(place, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D))
    return mixed(lane ^ key)


def span_hashes(view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, wherever it stands; view is what lanes made of the text."""
    size = ends - starts
    out = _at(view[starts] & _INSIDE[np.minimum(size, 8)], np.zeros(1, np.uint64))
    long = np.flatnonzero(size > 8)
    if len(long):
        n = (size[long] - 1) >> 3  # lanes after the first
        first = np.cumsum(n) - n
        place = np.arange(1, int(n.sum()) + 1) - np.repeat(first, n)
        at = 8 * place
        left = np.minimum(np.repeat(size[long], n) - at, 8)
        out[long] += np.add.reduceat(_at(view[np.repeat(starts[long], n) + at] & _INSIDE[left], place), first)
    return mixed(out ^ (size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACES[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each stretch of width neighbouring hashes."""
    n = len(hashes) - width + 1
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mixed(out * np.uint64(0xA0761D6478BD642F) + hashes[k : k + n])
    return out
