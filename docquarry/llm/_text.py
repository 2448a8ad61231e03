"""Vectorised byte-level tokenising and hashing of Arrow string columns.

All functions work on one *chunk*: some whole texts laid end to end in a byte buffer.
Only A-Z are lower-cased, and every byte of 0x80 or more belongs to a word, so working
on UTF-8 bytes gives the same words as working on code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 4096

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a word for operators that split at white space only.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word for operators that keep letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values of an array, sorted."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values of an array, sorted; a place of each; and the number of the value at every place."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    return x[new], order[new], back


_BYTE = mix(np.arange(1, 257, dtype=_U) * _MULT)
#: Bytes that are hashed at once.
STRIDE = 1 << 17
_UP, _DOWN = (np.cumprod(np.concatenate([np.ones(1, _U), np.full(STRIDE, base, _U)]), dtype=_U) for base in (int(_MULT), pow(int(_MULT), -1, 1 << 64)))


def _word_hashes(low: np.ndarray, inside: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hashes of words; those that reach over several strides are put together from their parts."""
    out = (stop - start).astype(_U)
    for lo in range(0, len(low), STRIDE):
        hi = min(lo + STRIDE, len(low))
        a, b = np.searchsorted(stop, lo, "right"), np.searchsorted(start, hi)
        if a == b:
            continue
        x = _BYTE[low[lo:hi]]
        x *= _UP[: hi - lo]
        x *= inside[lo:hi]
        at = np.maximum(start[a:b], lo) - lo
        part = np.add.reduceat(x, at) * _DOWN[at]
        if start[a] < lo:
            part[:1] *= _U(pow(int(_MULT), lo - int(start[a]), 1 << 64))
        out[a:b] += part
    return mix(out)


class Words:
    """The words of a chunk: byte range, index of the text within the chunk, 64-bit hash."""

    __slots__ = ("low", "start", "stop", "doc", "hash", "bounds")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        """`buf`: bytes; text i is buf[offsets[i]:offsets[i+1]]."""
        n = len(buf)
        self.low = LOWER[buf]
        inside = table[self.low]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edge = offsets[:-1]
        edge = edge[edge < n]
        first[edge] = inside[edge]
        self.start = np.flatnonzero(first)
        last = inside
        if n:
            nxt = np.zeros(n, bool)
            nxt[:-1] = inside[1:] & ~first[1:]
            last = inside & ~nxt
        self.stop = np.flatnonzero(last) + 1
        #: word range of text i: bounds[i]:bounds[i+1]
        self.bounds = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        self.hash = _word_hashes(self.low, inside, self.start, self.stop)

    def strings(self, index: np.ndarray) -> pa.Array:
        """The lower-cased words at these positions, as an Arrow string array."""
        start, size = self.start[index], (self.stop - self.start)[index]
        offsets = np.zeros(len(index) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        where = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
        return pa.Array.from_buffers(pa.large_string(), len(index), [None, pa.py_buffer(offsets), pa.py_buffer(self.low[where])]).cast(pa.string())


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    x = batch.column(name) if isinstance(batch, pa.RecordBatch) else batch.column(name).combine_chunks()
    if isinstance(x, pa.ChunkedArray):
        x = pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], x.type)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("") if len(texts) else pa.array([], pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[lo:hi] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - lo


def released() -> None:
    """Gives freed memory back to the system: a worker lives on after its task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def _slices(batch: pa.RecordBatch, text: str, size: int, rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    done = 0
    buf, offsets = buffers(column(batch, text))
    while done < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[done] + size, "right")) - 1
        end = min(max(end, done + 1), done + rows, batch.num_rows)
        yield batch.slice(done, end - done), buf[offsets[done] : offsets[end]], offsets[done : end + 1] - offsets[done]
        done = end


def chunks(batches, text: str, size: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of record batches with about `size` bytes of text at most, one text at least."""
    for batch in batches:
        yield from _slices(batch, text, size, rows)
    released()


def gathered(batches, text: str, size: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """As chunks(), but small batches are put together first."""
    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        for part, buf, _ in _slices(batch, text, size, rows):
            if kept and (held + len(buf) > size or sum(x.num_rows for x in kept) + part.num_rows > rows):
                table = pa.Table.from_batches(kept).combine_chunks()
                yield (table, *buffers(column(table, text)))
                kept, held = [], 0
            kept.append(part)
            held += len(buf)
    if kept:
        table = pa.Table.from_batches(kept).combine_chunks()
        kept = []
        yield (table, *buffers(column(table, text)))
    released()
