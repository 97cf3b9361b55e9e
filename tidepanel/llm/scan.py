"""Vectorised scanning of Arrow text columns.

All text operators that run in Arrow batches share these primitives: word and
line boundaries over the raw UTF-8 buffer, 64-bit hashes per token, and hashes
of k consecutive tokens.  Nothing here looks at a prefix of a text: buffers are
scanned whole, in slabs, so scratch memory does not follow the batch size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SLAB = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M64 = (1 << 64) - 1

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_LANES = _rng.integers(0, 1 << 64, (2, 64), dtype=np.uint64) | np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(buf: np.ndarray, offsets: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): maximal runs of bytes outside ``is_gap``.

    ``first[d]:first[d + 1]`` are the runs of document ``d``; no run crosses
    from one document into the next.
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~is_gap[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[1:-1] = solid[1:] != solid[:-1]
    edge[0], edge[-1] = solid[0], solid[-1]
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(buf))])
    both = inner[solid[inner] & solid[inner - 1]]  # two documents that touch
    marks = np.flatnonzero(edge)
    if len(both):
        marks = np.sort(np.concatenate([marks, both, both]))
    starts, ends = marks[0::2], marks[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_SLAB, 1 << int(n - 1).bit_length()) if n else _SLAB
    if size not in _POW:
        inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
        out = []
        for b in (_BASE, inv):
            p = np.full(size + 1, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size > 1 << 23:  # one giant token: not kept
            return out[0], out[1]
        _POW[size] = (out[0], out[1])
    return _POW[size]


def token_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ``buf[start:end]`` (equal bytes, equal hash)."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SLAB, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _powers(hi - lo)
        acc = np.empty(hi - lo + 1, np.uint64)
        acc[0] = 0
        np.cumsum(_BYTE[buf[lo:hi]] * up[: hi - lo], out=acc[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (acc[e] - acc[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def run_hash(tokens: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of every k consecutive tokens; entry i covers i .. i+k-1."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = tokens[:n] * _LANES[lane, 0]
    for j in range(1, k):
        acc += tokens[j : j + n] * _LANES[lane, j]
    return mix(acc)


def run_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, document) of the runs of k tokens that stay in one document."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) - before[doc] + first[:-1][doc], doc


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: freed memory stays with the process
    _LIBC = None


def release() -> None:
    """Give freed memory back to the system.  Python workers outlive their tasks, and what they hold counts in their executor."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def super_batches(batches: Iterator[pa.RecordBatch], column: str, target: int = 8 << 20, most_rows: int = 1 << 31) -> Iterator[pa.Table]:
    """Regroup incoming batches into tables of about ``target`` text bytes and at most ``most_rows`` rows.

    A batch is cut by rows where it holds more; one longer document stands
    alone, so that memory follows the longest document and not the batch.
    """
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            room = np.cumsum(lengths[at:])
            take = int(np.searchsorted(room, max(1, target - size), "left")) + 1
            take = min(take, batch.num_rows - at, most_rows - rows)
            held.append(batch.slice(at, take))
            size += int(room[take - 1])
            rows += take
            at += take
            if size >= target or rows >= most_rows:
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)
    held = []
    release()


def line_spans(buf: np.ndarray, offsets: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the lines split at \\n; blank lines count, an absent text has none."""
    breaks = np.flatnonzero(buf == 10)
    doc = np.searchsorted(offsets, breaks, "right") - 1
    here = np.flatnonzero(present)
    counts = np.bincount(doc, minlength=len(offsets) - 1) + present
    first = np.append(0, np.cumsum(counts))
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    is_first = np.zeros(first[-1], bool)
    is_first[first[:-1][here]] = True
    is_last = np.zeros(first[-1], bool)
    is_last[first[1:][here] - 1] = True
    starts[is_first], ends[is_last] = offsets[:-1][here], offsets[1:][here]
    starts[~is_first], ends[~is_last] = breaks + 1, breaks
    return starts, ends, first


def keep_tokens(buf: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray, glue: int) -> pa.Array:
    """Each document's kept tokens, one ``glue`` byte between two of them.

    Tokens are separated by at least one byte in ``buf``, so the byte after a
    kept token that isn't its document's last can carry the glue.
    """
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[keep]
    s, e = starts[keep], ends[keep]
    step = np.zeros(len(buf) + 1, np.int8)
    full = e > s  # an empty line has no bytes, and may share its place with the next document's first line
    step[s[full]] += 1
    step[e[full]] -= 1
    take = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    more = np.append(doc[1:] == doc[:-1], False) if len(doc) else np.zeros(0, bool)
    out = buf.copy()
    out[e[more]] = glue
    take[e[more]] = True
    bounds = np.append(0, np.cumsum(take))[offsets]
    data = out[take]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())
