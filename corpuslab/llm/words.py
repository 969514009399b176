"""Words of texts as 64-bit hashes, computed from arrays of code points: no step runs once for each word in Python.

Words are runs without U+0020 and U+0009 to U+000D. For comparison a word is its letters and digits in lower case, character
by character; one that has none is no word. The hash of a word is a polynomial in the values of its characters modulo 2 ** 64.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken apart at once; a longer text is cut where words end.
CHUNK = 1 << 18

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C13
_SPACES = b"\t\n\x0b\x0c\r "


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def plain_word(word: str) -> str:
    """A word for comparison; empty if it has no letters and digits."""
    return "".join(low for c in word for low in c.lower()[:1] if low.isalnum())


@cache
def _values() -> np.ndarray:
    """By code point: 1 for what separates words, 0 for what comparison leaves out, else a hash of the lower-case character."""
    low = np.fromiter((ord(x) if (x := chr(c).lower()[0]).isalnum() else 0 for c in range(0x110000)), np.uint64, 0x110000)
    out = np.where(low > 0, mixed(low + np.uint64(1 << 40)) | np.uint64(2), np.uint64(0))
    out[list(_SPACES)] = 1
    return out


_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(CHUNK, n)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)])) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def _cuts(data: np.ndarray, ends: np.ndarray) -> list[int]:
    """Where to cut the bytes of rows that end at ``ends``: after rows, or in a long row before a separator."""
    cuts, at = [0], 0
    while at < len(data):
        row = int(np.searchsorted(ends, at + CHUNK, side="right"))
        to = int(ends[row - 1]) if row else 0
        if to <= at:
            end, to = int(ends[row]), at + CHUNK
            while to < end and data[to] not in _SPACES:
                to += 1
        cuts.append(to)
        at = to
    return cuts


def word_hashes(column: pa.Array, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hashes of the comparison words of all rows, their offsets by row, and for each n of ``stems`` hashes of the words' first n letters (0 for words not longer)."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    rows = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, rows + 1, column.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(column.buffers()[2], np.uint8, last)[first:] if last > first else np.zeros(0, np.uint8)
    edges = offsets - first
    values = _values()
    found: list[list[np.ndarray]] = [[] for _ in range(1 + len(stems))]
    counts = np.zeros(rows + 1, np.int64)
    cuts = _cuts(data, edges[1:])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = data[a:b]
        points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        low, high = np.searchsorted(edges, a, side="left"), np.searchsorted(edges, b, side="left")
        starts = edges[low:high] - a  # of the rows that start in here
        if len(points) < len(part):
            starts = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[starts]
        value = values[points]
        gap = (value == 1).astype(np.int32)
        np.add.at(gap, starts, 1)
        kept = np.flatnonzero(value > 1)
        if not len(kept):
            continue
        group = np.cumsum(gap, dtype=np.int32)[kept]
        begin = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
        end = np.append(begin[1:], len(kept))
        power, inverse = _powers_to(len(kept))
        total = np.zeros(len(kept) + 1, np.uint64)
        np.cumsum(value[kept] * power, out=total[1:])
        base, scale = total[begin], inverse[begin]
        found[0].append(mixed((total[end] - base) * scale))
        for k, n in enumerate(stems):
            stem = mixed((total[np.minimum(begin + n, end)] - base) * scale + np.uint64(n))
            found[k + 1].append(np.where(end - begin > n, stem, np.uint64(0)))
        # Words before each row start; those before the first one belong to the row that the chunk goes on with.
        before = np.concatenate([[0], np.searchsorted(kept[begin], starts), [len(begin)]])
        np.add.at(counts, np.arange(low - 1, high), np.diff(before))
    hashes, *others = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found)
    return hashes, np.concatenate([[0], np.cumsum(counts[:rows])]), others


@cache
def _byte_values() -> np.ndarray:
    out = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1 << 41)) | np.uint64(1)
    out[list(_SPACES)] = 0
    return out


class ExactWords:
    """Words as they are written: their hashes, where they begin and end in ``data``, and their offsets by row."""

    def __init__(self, column: pa.Array):
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        first, last = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(column.buffers()[2], np.uint8, last)[first:] if last > first else np.zeros(0, np.uint8)
        edges, values = offsets - first, _byte_values()
        parts: list[tuple[np.ndarray, ...]] = []
        cuts = _cuts(data, edges[1:])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            value = values[data[a:b]]
            inside = value > 0
            begin, end = inside.copy(), inside.copy()
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            rows = edges[np.searchsorted(edges, a, side="right") : np.searchsorted(edges, b, side="left")] - a
            begin[rows] |= inside[rows]
            end[rows - 1] |= inside[rows - 1]
            begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
            power, inverse = _powers_to(len(value))
            total = np.zeros(len(value) + 1, np.uint64)
            np.cumsum(value * power, out=total[1:])
            parts.append((mixed((total[end] - total[begin]) * inverse[begin]), begin + a, end + a))
        self.hashes, self.begin, self.end = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))
        self.offsets, self.data = np.searchsorted(self.begin, edges), data.tobytes()

    def text(self, first: int, count: int) -> bytes:
        """``count`` words from ``first`` on, with what stands between them."""
        return self.data[self.begin[first] : self.end[first + count - 1]]


def hash_of(word: str) -> int:
    """The hash of one word."""
    found = word_hashes(pa.array([word], pa.large_string()))[0]
    return int(found[0]) if len(found) == 1 else 0
