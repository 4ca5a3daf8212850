"""Vectorised access to the UTF-8 bytes of Arrow text columns.

Every Python-side operator of this subpackage works on runs of bytes instead
of Python strings.  ``pieces`` cuts a column into bounded pieces; a text that
is longer than the bound is cut at ASCII spaces, so memory stays bounded while
whole texts are processed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled by one vectorised step.
PIECE_BYTES = 1 << 20


def utf8_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def relax() -> None:
    """Give freed memory back to the system: a worker serves many tasks, and others share its machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def splitmix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, element by element (wraps)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ROUNDS = 64
#: One random word for each (position modulo 64, byte).
_TABLE = splitmix(np.arange(1, _ROUNDS * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def class_table(keep: str, lower: bool) -> np.ndarray:
    """A byte map for ``pieces``: separators become 32, A-Z lower-cased if asked.

    ``keep`` is ``"word"`` (digits, letters, bytes from 0x80) or ``"black"``
    (whatever isn't ASCII white space 0x09-0x0D or 0x20).
    """
    table = np.arange(256, dtype=np.uint8)
    if keep == "word":
        inside = np.zeros(256, bool)
        inside[0x30:0x3A] = inside[0x41:0x5B] = inside[0x61:0x7B] = inside[0x80:] = True
    else:
        inside = np.ones(256, bool)
        inside[0x09:0x0E] = inside[0x20] = False
    table[~inside] = 32
    if lower:
        table[0x41:0x5B] += 32
    return table


def _cut(raw: np.ndarray, a: int, end: int, limit: int) -> int:
    """Where a piece that begins at ``a`` ends: behind white space, or at ``end``."""
    white = lambda x: (x == 32) | ((x >= 9) & (x <= 13))
    found = np.flatnonzero(white(raw[a + limit // 2 : a + limit]))
    if len(found):
        return a + limit // 2 + int(found[-1]) + 1
    at = a + limit
    while at < end:
        found = np.flatnonzero(white(raw[at : min(end, at + limit)]))
        if len(found):
            return at + int(found[0]) + 1
        at += limit
    return end


def pieces(raw: np.ndarray, at: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (rows, starts, buffer): texts of ``rows``, each after one byte 32.

    ``buffer`` begins and ends with 32 and has one 32 between texts; text k is
    ``buffer[starts[k] : starts[k + 1] - 1]``.  A text longer than ``limit``
    comes in several pieces of the same row, each cut after ASCII white space;
    no word is cut, so a single word may exceed the limit.
    """
    rows: list[int] = []
    spans: list[tuple[int, int]] = []
    held = 0

    def flush():
        starts = np.zeros(len(spans) + 1, np.int64)
        np.cumsum([b - a + 1 for a, b in spans], out=starts[1:])
        starts += 1
        buffer = np.full(starts[-1], 32, np.uint8)
        for k, (a, b) in enumerate(spans):
            buffer[starts[k] : starts[k] + b - a] = raw[a:b]
        return np.array(rows, np.int64), starts, buffer

    for row in range(len(at) - 1):
        a, end = int(at[row]), int(at[row + 1])
        while True:
            b = end
            if b - a > limit:
                b = _cut(raw, a, end, limit)
            if held and held + b - a > limit:
                yield flush()
                rows, spans, held = [], [], 0
            rows.append(row)
            spans.append((a, b))
            held += b - a + 1
            a = b
            if a >= end:
                break
    if rows:
        yield flush()


def words_of(mapped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte past the end, 64-bit hash) of the words of a mapped buffer."""
    black = mapped != 32
    edge = np.flatnonzero(black[1:] != black[:-1]) + 1
    if black[0]:
        edge = np.r_[0, edge]
    if black[-1]:
        edge = np.r_[edge, len(mapped)]
    first, last = edge[0::2], edge[1::2]
    if not len(first):
        return first, last, np.zeros(0, np.uint64)
    return first, last, hash_spans(mapped, first, last)


def hash_spans(mapped: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``mapped[first[k]:last[k]]`` (no span is empty; in ascending order, apart from each other)."""
    size = last - first
    a, b = int(first[0]), int(last[-1])
    if b - a <= 2 * int(size.sum()):  # hardly any gaps: all bytes in a row, those between spans count nothing
        begin = first - a
        data = mapped[a:b]
        place = np.arange(b - a) - np.repeat(begin, np.diff(first, append=b))
        gap = np.flatnonzero(first[1:] > last[:-1])
        wide = first[gap + 1] - last[gap]
        ends = np.cumsum(wide)
        between = np.repeat(last[gap] - a - (ends - wide), wide) + np.arange(ends[-1]) if len(gap) else gap
    else:
        ends = np.cumsum(size)
        begin = ends - size
        place = np.arange(ends[-1]) - np.repeat(begin, size)
        data = mapped[np.repeat(first, size) + place]
        between = begin[:0]
    mixed = _TABLE.take(((place & (_ROUNDS - 1)) << 8) | data)
    mixed[between] = 0
    if size.max() > _ROUNDS:
        mixed = mixed * (np.uint64(0xD6E8FEB86659FD93) ** (place >> 6).astype(np.uint64))
    return splitmix(np.add.reduceat(mixed, begin) + size.astype(np.uint64))
