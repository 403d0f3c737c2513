"""Hashes of the words of many texts at once, on whole byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PRIME = 0x100000001B3
INVERSE = pow(PRIME, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        size = max(n, 1 << 20)
        held = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
        if size <= 1 << 22:
            _powers[name] = held
    return held[:n]


def text_parts(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds of the rows in them) for runs of rows of about ``size`` bytes, one row at least; nulls are empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1))
        yield at, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def word_spans(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with ``inside[byte]``, which end at row bounds too, and the first word of each row."""
    word = inside[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = word[cut] & word[cut - 1]
    begin[cut[both]] = True
    end[cut[both] - 1] = True
    starts, ends = np.nonzero(begin)[0], np.nonzero(end)[0] + 1
    return starts, ends, np.searchsorted(starts, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; it depends on the span's bytes alone."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(PRIME, n, "up"), dtype=np.uint64, out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(INVERSE, n + 1, "down")[starts]
    return mix(h)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))
