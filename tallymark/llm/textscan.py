"""Words of Arrow text columns as numpy arrays: byte positions and 64-bit hashes.

No Python string is made for a word.  Hashes are polynomials over the bytes (for words) or
over word hashes (for runs of words), modulo 2**64 with an odd base, taken from prefix sums
and mixed afterwards; so every run of words costs a subtraction and a product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text handled at once; a single longer text is handled alone.
CHUNK_BYTES = 4 << 20
#: Bytes hashed at once.
BLOCK = 1 << 20
#: Odd bases of the two independent hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``base`` and of its inverse modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 1)
        inverse = pow(base, -1, 1 << 64)

        def row(x: int) -> np.ndarray:
            out = np.full(size, x, dtype=np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        have = _POWERS[base] = (row(base), row(inverse))
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of ``h`` over the whole word, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most ``CHUNK_BYTES`` of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = buffer_of(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK_BYTES, side="right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(row, end - row)
            row = end


class Words:
    """Words of several texts: ``starts`` and ``ends`` in ``data``; text ``i`` has words ``first[i]:first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
        flag = member[data] if len(data) else np.empty(0, bool)
        cut = offsets[1:-1][offsets[1:-1] < len(data)]
        before = np.empty_like(flag)
        before[:1] = False
        before[1:] = flag[:-1]
        before[cut] = False
        self.starts = np.flatnonzero(flag & ~before)
        after = before
        after[-1:] = False
        after[:-1] = flag[1:]
        after[cut[cut > 0] - 1] = False
        self.ends = np.flatnonzero(flag & ~after) + 1
        self.data = data
        self.first = np.searchsorted(self.starts, offsets)
        self.first[-1] = len(self.starts)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, base: int = BASES[0]) -> np.ndarray:
        out = np.empty(len(self), dtype=np.uint64)
        a = 0
        while a < len(self):
            low = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.ends, low + BLOCK, side="right")))
            s, e = self.starts[a:b] - low, self.ends[a:b] - low
            n = int(e[-1])
            up, down = powers(base, n + 1)
            total = np.empty(n + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum((self.data[low : low + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
            out[a:b] = (total[e] - total[s]) * down[s]
            a = b
        return mix(out)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


class Runs:
    """Hashes of any runs of consecutive words."""

    def __init__(self, hashes: np.ndarray, base: int):
        up, self.down = powers(base, len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=self.total[1:])

    def every(self, n: int) -> np.ndarray:
        """Of the ``n`` words from each word on that has as many after it."""
        if len(self.total) <= n:
            return np.empty(0, dtype=np.uint64)
        return mix((self.total[n:] - self.total[:-n]) * self.down[: len(self.total) - n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])


def first_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its first smallest one."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    at, span = np.arange(len(values)), 1

    def better(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(values[right] < values[left], right, left)

    while span * 2 <= width:
        at = better(at[:-span], at[span:])
        span *= 2
    return better(at[:n], at[width - span : width - span + n])


def member_table(pattern: bytes) -> np.ndarray:
    """Which of the 256 bytes stand in ``pattern``."""
    table = np.zeros(256, dtype=bool)
    table[list(pattern)] = True
    return table


#: Everything but space, tab, line feed, vertical tab, form feed and carriage return.
NON_SPACE = ~member_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Digits, lower-case ASCII letters and every byte of a character beyond ASCII.
WORD_BYTES = member_table(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
#: A-Z to a-z, other bytes unchanged.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
