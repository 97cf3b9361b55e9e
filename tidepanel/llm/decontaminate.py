"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared as UTF-8 bytes with A-Z in lower case and every white space
byte as a blank.  A document leaks a benchmark item where a stretch of ``L``
bytes of the item aligns with a stretch of the document at no more than ``k``
edits.  By the q-gram lemma such a pair shares at least ``L + 1 - q - k * q``
q-grams, all on diagonals at most ``k`` apart.  So:

1. q-grams of a document that occur in some item are marked; only where their
   density can meet the bound are they expanded to (item, diagonal) hits;
2. hits are counted in overlapping diagonal bands of width 2k, so that
   every run of k + 1 diagonals lies whole in one band;
3. bands in which some window of the item meets the bound are verified:
   an unbroken diagonal is an exact match, and every stretch of the item
   that meets the bound and doesn't lie whole in one is aligned in the band
   by dynamic programming.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import scan
from tidepanel.llm.store import slim_batches

Q = 8
#: bytes of an item that must be found, and edits allowed in them
LENGTH, EDITS = 80, 6
#: items are broadcast in blocks of at most so many bytes; each block is one pass over the documents
BLOCK_BYTES = 16 << 20
_TABLE = 22
#: items under so many bytes can't be told from chance within a text
SHORT = 16


def _normal(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, offsets = scan.text_bytes(column)
    buf = scan.LOWER[raw]
    buf[scan.SPACE[raw]] = 32
    return raw, buf, offsets


def _codes(buf: np.ndarray) -> np.ndarray:
    """The Q bytes from each position on, as one number."""
    n = len(buf) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    raw = buf.tobytes()
    for j in range(min(Q, n)):
        part = out[j::Q]
        part[:] = np.frombuffer(raw, "<u8", count=len(part), offset=j)
    return out


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE)


def _bound(size: int, length: int = LENGTH, edits: int = EDITS) -> tuple[int, int]:
    """(edits allowed, q-grams needed) for a stretch of ``size`` bytes."""
    k = min(size * edits // length, (size - Q) // Q)
    return k, size + 1 - Q - k * Q


@dataclass(frozen=True)
class Probe:
    """Items indexed by q-gram; ``size`` is the length of the stretch looked for in each, ``edits`` and ``need`` its bounds."""

    items: list
    texts: list[np.ndarray]
    size: np.ndarray
    edits: np.ndarray
    need: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    table: np.ndarray


@dataclass(frozen=True)
class Index:
    """A block of the benchmark: probes for items of SHORT bytes or more, whole lines for shorter ones."""

    probes: list[Probe]
    lines: dict[bytes, list]
    hashes: np.ndarray


def index(items: list, texts: pa.ChunkedArray | pa.Array, length: int = LENGTH, edits: int = EDITS) -> Index:
    """Items of ``length`` bytes or more are looked for by stretches of that many; those of SHORT or more
    by all they have; shorter ones, which chance would find anywhere, where a line of the document says just them."""
    _, buf, offsets = _normal(texts)
    parts = [buf[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    lines: dict[bytes, list] = {}
    for i, t in enumerate(parts):
        if len(t) < SHORT and (said := t.tobytes().strip()):
            lines.setdefault(said, []).append(items[i])
    joined = np.frombuffer(b"".join(lines), np.uint8)
    ends = np.cumsum([len(x) for x in lines], dtype=np.int64)
    hashes = np.sort(scan.token_hash(joined, np.append(0, ends)[:-1], ends)) if lines else np.zeros(0, np.uint64)
    out = []
    for own in ([i for i, t in enumerate(parts) if len(t) >= length], [i for i, t in enumerate(parts) if SHORT <= len(t) < length]):
        if not own:
            continue
        size = np.array([min(length, len(parts[i])) for i in own])
        bounds = np.array([_bound(int(n), length, edits) for n in size])
        code = [_codes(parts[i]) for i in own]
        item = np.repeat(np.arange(len(own)), [len(c) for c in code])
        pos = np.concatenate([np.arange(len(c)) for c in code])
        code = np.concatenate(code)
        order = np.argsort(code, kind="stable")
        grams, first = np.unique(code[order], return_index=True)
        table = np.zeros(1 << _TABLE, bool)
        table[_slot(grams)] = True
        out.append(Probe([items[i] for i in own], [parts[i] for i in own], size, bounds[:, 0], bounds[:, 1], grams, np.append(first, len(code)), item[order].astype(np.int32), pos[order].astype(np.int32), table))
    return Index(out, lines, hashes)


def whole_lines(ix: Index, buf: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, object, int, int, int]]:
    """(document, item, start, end, 0) where a line, blanks around it aside, is one of the short items."""
    if not ix.lines:
        return []
    starts, ends, first = scan.line_spans(raw, offsets, np.ones(len(offsets) - 1, bool))
    solid = np.flatnonzero(~scan.SPACE[raw])
    some = np.searchsorted(solid, ends) > np.searchsorted(solid, starts)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[some]
    s, e = solid[np.searchsorted(solid, starts[some])], solid[np.searchsorted(solid, ends[some]) - 1] + 1
    few = e - s < SHORT
    doc, s, e = doc[few], s[few], e[few]
    h = scan.token_hash(buf, s, e)
    at = np.minimum(np.searchsorted(ix.hashes, h), len(ix.hashes) - 1)
    out = []
    for i in np.flatnonzero(ix.hashes[at] == h).tolist():
        base = int(offsets[doc[i]])
        out += [(int(doc[i]), item, int(s[i]) - base, int(e[i]) - base, 0) for item in ix.lines.get(buf[s[i] : e[i]].tobytes(), ())]
    return out


def _hits(p: Probe, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document position, item, item position) of q-grams where they are dense enough."""
    none = np.zeros(0, np.int64)
    marks = []
    slab = 1 << 20
    for lo in range(0, len(buf) - Q + 1, slab):
        code = _codes(buf[lo : lo + slab + Q - 1])
        near = np.flatnonzero(p.table[_slot(code)])
        code = code[near]
        at = np.searchsorted(p.grams, code)
        good = p.grams[np.minimum(at, len(p.grams) - 1)] == code
        marks.append(np.stack([near[good] + lo, at[good]]))
    if not marks:
        return none, none, none
    where, gram = np.concatenate(marks, 1)
    doc = np.searchsorted(offsets, where, "right") - 1
    inside = where + Q <= offsets[doc + 1]
    where, gram, doc = where[inside], gram[inside], doc[inside]
    # a hit can count only where ``need`` hits lie within length + edits bytes of one document
    reach, n = int((p.size + p.edits).max()) - Q, int(p.need.min())
    if len(where) < n:
        return none, none, none
    dense = (where[n - 1 :] - where[: len(where) - n + 1] <= reach) & (doc[n - 1 :] == doc[: len(doc) - n + 1])
    cover = np.cumsum(np.bincount(np.flatnonzero(dense), minlength=len(where) + 1) - np.bincount(np.flatnonzero(dense) + n, minlength=len(where) + 1)[: len(where) + 1])[: len(where)] > 0
    where, gram = where[cover], gram[cover]
    n_post = p.first[gram + 1] - p.first[gram]
    entry = np.repeat(p.first[gram] - np.append(0, np.cumsum(n_post)[:-1]), n_post) + np.arange(n_post.sum()) if len(gram) else none
    return np.repeat(where, n_post), p.item[entry].astype(np.int64), p.pos[entry].astype(np.int64)


def banded_edits(item: np.ndarray, starts: np.ndarray, length: int, text: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits to align item[s : s + length] with a stretch of text, and where the stretch begins and ends.

    Diagonals (text position less item position) are kept in [low, high]; text
    before and behind the stretch is free.  All starts advance together, and
    gaps within a row are closed by a running minimum.  A cell holds the edits
    and, in its low bits, the column the stretch began in: of equal edits the
    latest beginning and the first end count.
    """
    width = high - low + 1
    ramp = np.arange(width)
    padded = np.concatenate([np.full(1, 300, np.int16), text.astype(np.int16), np.full(1, 300, np.int16)])
    at = starts[:, None] + low + ramp[None, :]
    bits = width.bit_length()
    one = 1 << bits
    far = 10**6 * one
    row = np.where((at >= 0) & (at <= len(text)), one - 1 - ramp, far)
    for r in range(length):
        spot = at + r
        same = padded[np.clip(spot + 1, 0, len(padded) - 1)] == item[starts + r][:, None]
        nxt = np.where((spot >= 0) & (spot < len(text)), row + ~same * one, far)  # diagonal step
        nxt[:, :-1] = np.minimum(nxt[:, :-1], row[:, 1:] + one)  # an item byte left out
        nxt = np.minimum.accumulate(nxt - ramp * one, axis=1) + ramp * one  # text bytes put in
        row = np.where((spot + 1 >= 0) & (spot + 1 <= len(text)), nxt, far)
    best = (row >> bits).argmin(axis=1)
    least = row[np.arange(len(starts)), best]
    return least >> bits, starts + low + one - 1 - (least & one - 1), starts + length + low + best


def find(p: Probe, buf: np.ndarray, offsets: np.ndarray, whole: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(document, item, start, end, edits) of the leaks of a batch, byte positions in the document.

    Without ``whole``, a band with an exact match isn't searched for more:
    the documents and items are the same, the stretches aren't all there.
    """
    where, item, pos = _hits(p, buf, offsets)
    size = p.size[item]
    out = []
    for n in np.unique(size).tolist():
        own = size == n
        out += _stretches(p, n, buf, offsets, where[own], item[own], pos[own], whole)
    return out


def _stretches(p: Probe, size: int, buf: np.ndarray, offsets: np.ndarray, where: np.ndarray, item: np.ndarray, pos: np.ndarray, whole: bool) -> list[tuple[int, int, int, int, int]]:
    """The leaks of the items that are looked for by stretches of ``size`` bytes."""
    one = int(item[0])
    most, n = int(p.edits[one]), int(p.need[one])
    doc = np.searchsorted(offsets, where, "right") - 1
    here = where - offsets[doc]
    diagonal = here - pos
    step = max(1, most)
    band = diagonal // step
    doc, item, pos, here, diagonal = (np.tile(x, 2) for x in (doc, item, pos, here, diagonal))
    band = np.concatenate([band, band - 1])
    order = np.lexsort((diagonal, pos, band, item, doc))
    doc, item, band, pos, here, diagonal = (x[order] for x in (doc, item, band, pos, here, diagonal))
    new = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1]))
    group = np.cumsum(new) - 1
    distinct = new | np.append(True, pos[1:] != pos[:-1])
    gp, gg = pos[distinct], group[distinct]
    if len(gp) < n:
        return []
    tail, lead = slice(n - 1, None), slice(0, len(gp) - n + 1)
    meets = (gg[tail] == gg[lead]) & (gp[tail] - gp[lead] <= size - Q)
    bounds = np.append(np.flatnonzero(new), len(doc))
    out: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    todo: dict[int, list[int]] = {}
    for i in np.flatnonzero(meets).tolist():
        todo.setdefault(int(gg[i]), []).append(i)
    for g, which in todo.items():
        a, b = bounds[g], bounds[g + 1]
        d, it = int(doc[a]), int(item[a])
        text = buf[offsets[d] : offsets[d + 1]]
        # an unbroken diagonal
        by = np.lexsort((pos[a:b], diagonal[a:b]))
        dd, jj = diagonal[a:b][by], pos[a:b][by]
        cut = np.append(np.flatnonzero(np.append(True, (dd[1:] != dd[:-1]) | (jj[1:] != jj[:-1] + 1))), len(dd))
        runs = np.diff(cut)
        exact = np.flatnonzero(runs >= size - Q + 1)
        found = [(int(dd[cut[x]] + jj[cut[x]]), int(dd[cut[x]] + jj[cut[x + 1] - 1]) + Q, 0) for x in exact]
        if whole or not found:
            own = p.texts[it]
            starts = np.unique(np.concatenate([np.arange(max(0, gp[i + n - 1] - (size - Q)), min(gp[i], len(own) - size) + 1) for i in which]))
            for x in exact:  # what lies whole in an exact match is found already
                starts = starts[(starts < jj[cut[x]]) | (starts + size > jj[cut[x + 1] - 1] + Q)]
            low = int(band[a]) * step
            for lo in range(0, len(starts), 256):
                s = starts[lo : lo + 256]
                edits, begins, ends = banded_edits(own, s, size, text, low - most, low + 2 * step + most)
                good = edits <= most
                found.extend(zip(begins[good].tolist(), ends[good].tolist(), edits[good].tolist()))
        if found:
            out.setdefault((d, it), []).extend(found)
    rows = []
    for (d, it), spans in out.items():
        spans.sort()
        at, end, edits = spans[0]
        for s, e, x in spans[1:]:
            if s <= end:
                end, edits = max(end, e), min(edits, x)
            else:
                rows.append((d, it, at, end, edits))
                at, end, edits = s, e, x
        rows.append((d, it, at, end, edits))
    return rows


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Index]:
    """The benchmark in blocks of a bounded size, each with its index; one at a time is on the driver."""
    slim_batches(benchmark.sparkSession)
    named = benchmark.where(F.col(text).isNotNull()).select(F.col(item).alias("i"), F.col(text).alias("t"))
    volume = named.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    count = max(1, -(-volume // BLOCK_BYTES))
    for b in range(count):
        rows = named.where(F.pmod(F.xxhash64("t"), F.lit(count)) == b).orderBy("i", "t").collect()
        if rows:
            yield index([r["i"] for r in rows], pa.array([r["t"] for r in rows], pa.string()))


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, start, end, edits): every stretch of a document that leaks a benchmark item.

    ``start`` and ``end`` count code points, end exclusive; ``edits`` is the
    least number found in one stretch of ``LENGTH`` bytes (0: exact); shorter
    items are looked for whole, with as many edits in proportion.  An item of under
    ``SHORT`` bytes is leaked by a line that says just it.  Stretches of one item
    that overlap are one row.

    Null and empty texts leak nothing; null items are skipped; equal items each
    report; a null key is reported as it is, repeated rows each on their own;
    an empty benchmark or table gives no rows.  Other columns aren't read.
    """
    spark = docs.sparkSession
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    names = f"key {kinds[0]}, item {kinds[1]}, start int, `end` int, edits int"
    found = []
    for block in _blocks(benchmark, item, item_text):
        shared = spark.sparkContext.broadcast(block)

        def go(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for table in scan.super_batches(batches, "text", 4 << 20):
                raw, buf, offsets = _normal(table["text"])
                ix = shared.value
                found = [(d, p.items[i], s, e, x) for p in ix.probes for d, i, s, e, x in find(p, buf, offsets)] + whole_lines(ix, buf, raw, offsets)
                rows = [(d, i, *_points(raw, offsets[d], s, e), x) for d, i, s, e, x in found]
                if rows:
                    d, i, s, e, x = zip(*rows)
                    keys = table["key"].take(pa.array(d)).combine_chunks()
                    yield from pa.table({"key": keys, "item": pa.array(i), "start": pa.array(s, pa.int32()), "end": pa.array(e, pa.int32()), "edits": pa.array(x, pa.int32())}).to_batches()

        found.append(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(go, names))
    out = found[0] if found else spark.createDataFrame([], names)
    for more in found[1:]:
        out = out.unionAll(more)
    return out.withColumnsRenamed({"key": key, "item": item})


def _points(raw: np.ndarray, base: int, start: int, end: int) -> tuple[int, int]:
    """Byte positions of a document as code points."""
    lead = (raw[base : base + end] & 0xC0) != 0x80
    before = int(np.count_nonzero(lead[:start]))
    return before, before + int(np.count_nonzero(lead[start:]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no benchmark item, unchanged; cases as in find_leaks."""
    spark = docs.sparkSession
    out = docs
    for block in _blocks(benchmark, item, item_text):
        shared = spark.sparkContext.broadcast(block)
        names = [f"c{i}" for i in range(len(out.columns))]
        at = out.columns.index(text)
        plain = out.toDF(*names)

        def go(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            for table in scan.super_batches(batches, f"c{at}", 4 << 20):
                raw, buf, offsets = _normal(table[f"c{at}"])
                ix = shared.value
                clean = np.ones(table.num_rows, bool)
                for p in ix.probes:
                    clean[[d for d, *_ in find(p, buf, offsets, whole=False)]] = False
                clean[[d for d, *_ in whole_lines(ix, buf, raw, offsets)]] = False
                yield from table.filter(pa.array(clean)).to_batches()

        out = plain.mapInArrow(go, plain.schema).toDF(*docs.columns)
    return out
