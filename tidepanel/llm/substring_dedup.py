"""Substring dedup of word windows behind a count-min prefilter.

A window of ``k`` words is counted under its *minimiser*, the smallest hash
among its ``SUB``-word shingles: equal windows have equal minimisers, so the
count of the minimiser is never below that of the window, and neighbouring
windows mostly share one, which makes the sketch several times smaller.

Pass 1 sketches every batch (each row of the sketch is cut into slices and
sent as sparse offsets), the slices are merged in a tree with saturating
counts, and one bit per cell, "two or more", is what pass 2 is given.
Rows have a cell for each eight bytes of text, up to ``MOST_CELLS``, which bounds
what is broadcast: a fuller sketch lets more unique windows through to the
exact grouping but never holds back a repeated one.  Pass 2 groups the windows
let through exactly (windows.py).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import scan
from tidepanel.llm.store import slim_batches, text_volume
from tidepanel.llm.windows import Filter, remove_repeats, words

WINDOW = 13
SUB = 7
DEPTH = 2
#: cells of a row at most; two rows of 2**28 bits are 64 MB, the whole of what is broadcast
MOST_CELLS = 1 << 28
_SLICE = 1 << 16
#: slices that are merged as one group, bytes of offsets that a group takes, partial sketches that meet in one
_GROUPED, _GROUP_BYTES, _FAN_IN = 16, 32 << 20, 64


def cells_for(volume: int) -> int:
    """Cells of a row for so many bytes of text."""
    return min(MOST_CELLS, max(1 << 20, 1 << (volume // 8).bit_length()))


def _minimisers(hashes: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    s = scan.run_hash(hashes, SUB)
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    low = s[:n].copy()
    for j in range(1, k - SUB + 1):
        np.minimum(low, s[j : j + n], out=low)
    return scan.mix(low[at])


def _cells(m: np.ndarray, row: int, width: int) -> np.ndarray:
    return ((m if row == 0 else scan.mix(m ^ np.uint64(row))) % np.uint64(width)).astype(np.int64)


def _batches_merged(table: pa.Table) -> pa.Table:
    return _merged(table, False)


def _sketches_merged(table: pa.Table) -> pa.Table:
    return _merged(table, True)


def _merged(table: pa.Table, dense: bool) -> pa.Table:
    """Per slice, the bits "counted" and "counted twice or more" of what batches sent, or of partial sketches."""
    of = table["slice"].to_numpy()
    order = np.argsort(of, kind="stable")
    once, twice = table["once"].to_pylist(), table["twice"].to_pylist()
    out: dict[str, list] = {"slice": [], "once": [], "twice": []}
    cut = np.append(np.flatnonzero(np.append(True, np.diff(of[order]) != 0)), len(of))
    for a, b in zip(cut[:-1], cut[1:]):
        rows = order[a:b]
        if dense:
            one, two = np.zeros(_SLICE // 8, np.uint8), np.zeros(_SLICE // 8, np.uint8)
            for i in rows:
                more = np.frombuffer(once[i], np.uint8)
                two |= (one & more) | np.frombuffer(twice[i], np.uint8)
                one |= more
        else:
            n = np.bincount(np.frombuffer(b"".join(once[i] for i in rows), np.uint16), minlength=_SLICE)
            n += np.bincount(np.frombuffer(b"".join(twice[i] for i in rows), np.uint16), minlength=_SLICE)
            one, two = np.packbits(n > 0), np.packbits(n > 1)
        out["slice"].append(int(of[rows[0]]))
        out["once"].append(one.tobytes())
        out["twice"].append(two.tobytes())
    salt = pa.array(np.full(len(out["slice"]), table["salt"][0].as_py(), np.int32))
    return pa.table({"slice": pa.array(out["slice"], pa.int32()), "salt": salt, "once": pa.array(out["once"], pa.binary()), "twice": pa.array(out["twice"], pa.binary())})


_PARTIAL = "slice int, salt int, once binary, twice binary"


def sketch(docs: DataFrame, text: str, k: int, width: int, volume: int) -> list[np.ndarray]:
    """Per row of the sketch, the bits "counted twice or more"."""
    groups = max(1, DEPTH * width // _SLICE // _GROUPED)
    salts = max(1, -(-volume // (4 * groups * _GROUP_BYTES)))  # a row sends about a byte for eight of text

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in scan.super_batches(batches, "text"):
            t = words(table["text"])
            hashes = scan.token_hash(t.buf, t.starts, t.ends)
            at, doc = scan.run_starts(t.first, k)
            m = _minimisers(hashes, k, at)
            if not len(m):
                continue
            head = np.append(True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1]))
            m = m[head]
            salt = int(m.sum(dtype=np.uint64) % np.uint64(salts))
            for row in range(DEPTH):
                cell, n = np.unique(_cells(m, row, width), return_counts=True)
                piece = cell // _SLICE
                cut = np.append(np.flatnonzero(np.append(True, piece[1:] != piece[:-1])), len(piece))
                off = (cell % _SLICE).astype(np.uint16)
                yield from pa.table(
                    {
                        "slice": pa.array((row * (width // _SLICE) + piece[cut[:-1]]).astype(np.int32)),
                        "salt": pa.array(np.full(len(cut) - 1, salt, np.int32)),
                        "once": pa.array([off[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                        "twice": pa.array([off[a:b][n[a:b] > 1].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                    }
                ).to_batches(max_chunksize=4096)

    merged, meet = docs.select(F.col(text).alias("text")).mapInArrow(build, _PARTIAL), _batches_merged
    while True:
        part = F.floor(F.col("slice") / _GROUPED).alias("part")
        merged = merged.groupBy(part, F.col("salt").alias("by")).applyInArrow(meet, _PARTIAL)
        if salts == 1:
            break
        salts, meet = -(-salts // _FAN_IN), _sketches_merged
        merged = merged.withColumn("salt", (F.col("salt") % salts).cast("int"))
    per = width // _SLICE
    rows = [np.zeros(width // 8, np.uint8) for _ in range(DEPTH)]
    for r in merged.select("slice", "twice").toLocalIterator():
        at = r["slice"] % per * (_SLICE // 8)
        rows[r["slice"] // per][at : at + _SLICE // 8] = np.frombuffer(r["twice"], np.uint8)
    return rows


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WINDOW, width: int | None = None) -> DataFrame:
    """``docs`` without the words of passages that a smaller key holds.

    Words are maximal runs of bytes other than space and \\t..\\r, unchanged.
    A word goes when a window of ``k`` consecutive words that covers it also
    starts in a row with a smaller key; windows are judged on the input.  Kept
    words are joined by one space; n_tokens and n_removed (long) are added.

    A null text stays null (0 words); an empty or shorter text loses nothing.
    Keys are integers.  Rows that share a key don't cover each other; a row whose key is null
    covers nothing and loses nothing.  Other columns pass through.
    """
    if k < SUB:
        raise ValueError(f"k must be {SUB} at least")
    slim_batches(docs.sparkSession)
    volume = text_volume(docs, text)
    width = width or cells_for(volume)
    bits = sketch(docs.where(F.col(key).isNotNull()), text, k, width, volume)
    shared = docs.sparkSession.sparkContext.broadcast([b.tobytes() for b in bits])

    def choose() -> Filter:
        rows = [np.frombuffer(b, np.uint8) for b in shared.value]

        def wanted(hashes: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
            m = _minimisers(hashes, k, at)
            if not len(m):
                return np.zeros(0, bool)
            head = np.append(True, m[1:] != m[:-1])
            one = m[head]
            hit = np.ones(len(one), bool)
            for row, b in enumerate(rows):
                c = _cells(one, row, width)
                hit &= (b[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
            return hit[np.cumsum(head) - 1]

        return wanted

    return remove_repeats(docs, key, text, "word", k, False, choose, volume)
