"""Words of whole Arrow batches as 64-bit hashes, in numpy.

A word is ``[^\\x20\\x09-\\x0D]+``. Both its separators and the letters A-Z are single bytes in
UTF-8, so all of this works on the bytes of a batch at once and no word becomes a Python object.
Hashes are the same on every machine. A span is hashed in blocks of 8 bytes, each of which goes with
its number through a bijection that is not linear, so that no arrangement of letters makes two
different spans meet more often than by chance, which is about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20
#: Rows handled at once.
ROWS = 4096

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_GOLDEN = U(0x9E3779B97F4A7C15)
#: Masks that leave the first 0 to 8 bytes of a block.
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def blocks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The byte spans [start, end) in blocks of 8 bytes, zeros behind the last byte: all blocks in a
    row, the number of each within its span, and the place of each span's first one."""
    count = np.maximum(end - start + 7, 8) >> 3
    first = np.cumsum(count) - count
    nth = np.arange(int(count.sum())) - np.repeat(first, count)
    at = np.repeat(start, count) + 8 * nth
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # at every byte
    return eights[at] & _MASKS[np.minimum(np.repeat(end, count) - at, 8)], nth, first


def blocks_hash(values: np.ndarray, nth: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the spans of ``size`` bytes that ``blocks`` has taken apart."""
    if not len(first):
        return np.zeros(0, U)
    return mix(np.add.reduceat(mix(values + mix(nth.astype(U) * _GOLDEN + U(1))), first) + size.astype(U) * U(0xD6E8FEB86659FD93))


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end)."""
    return blocks_hash(*blocks(data, start, end), end - start)


def runs_hash(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A hash of each k consecutive ones of ``hashes``, put together by halves."""
    done, made = {1: hashes}, 1
    whole, size = None, 0  # of the powers of two in k so far
    while True:
        if k & made:
            part = done[made]
            n = len(hashes) - size - made + 1
            whole = part if whole is None else mix(whole[: max(0, n)] * U(0x9FB21C651E98DF25) + mix(part[size : size + max(0, n)] + U(size + seed)))
            size += made
        if size == k:
            return whole
        p = done[made]
        n = max(0, len(p) - made)
        done[2 * made] = mix(p[:n] * U(0xD1342543DE82EF95) + mix(p[made : made + n] + U(made + seed)))
        made *= 2


class Words:
    """The words of some texts. ``first[i]:first[i + 1]`` are those of text i in ``hashes``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, *, lower: bool = False, hashed: bool = True):
        self.data, self.offsets = LOWER[data] if lower else data, offsets
        self.inside = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)  # a text begins here
        edge[offsets] = True
        starts = self.inside.copy()
        starts[1:] &= ~self.inside[:-1] | edge[1:-1]
        ends = self.inside.copy()
        ends[:-1] &= ~self.inside[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        if hashed:
            self.hashes = spans_hash(self.data, self.starts, self.ends)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k consecutive words of one text, and the text of each; a window's
        place is that of its first word."""
        return self.windows_at(k)[:2]

    def windows_at(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.hashes) < k:
            return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = self.text_of_word()
        at = np.flatnonzero(text[: len(text) - k + 1] == text[k - 1 :])
        return runs_hash(self.hashes, k)[at], text[at], at

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the bytes flagged belong to each text."""
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return np.diff(c[self.offsets])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with about ``limit`` bytes of text at most, their bytes and offsets."""
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = min(at + ROWS, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def by_text(order: np.ndarray, text: np.ndarray) -> np.ndarray:
    """``order`` made an order by text, and by what it was within each; a chunk has few texts."""
    return order[np.argsort(text[order].astype(np.uint16 if ROWS <= 1 << 16 else np.int64), kind="stable")]


def groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the number of equal ones, and whether it is the first of them."""
    order = np.argsort(values)
    v = values[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(v)))
    count, first = np.empty(len(v), np.int64), np.zeros(len(v), bool)
    count[order] = np.repeat(size, size)
    if len(v):
        first[np.minimum.reduceat(order, start)] = True
    return count, first
