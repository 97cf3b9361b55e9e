"""SentencePiece encoding by forward filtering and backward sampling.

A text's segmentations into pieces form a lattice.  Each piece weighs
``rank ** -alpha`` of its rank in the vocabulary; forward sums over the lattice
give every position's total weight, and a segmentation is drawn backward from
the end, each piece with its share of that weight, so whole segmentations come
out in proportion to their weights.  Draws are seeded by row key and position,
not by batch or task: the same row gives the same pieces anywhere.

Pieces hold the blank mark only at their start, so the lattice falls apart
into segments (blanks and the word behind them) whose sums are worked out once
per distinct segment of a batch; all occurrences then step backward together.

Lossless: the text is not normalised, a blank mark that stands in the text
itself and characters outside the vocabulary go as bytes, and the one
blank put in front is taken off again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm import scan
from tidepanel.llm.store import slim_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 0.8
_MARK = 0x2581
_OWN_MARK = 0x110000  # a blank mark of the text itself; no code point
_TABLE = 20
#: bits of a draw
_SHARE = 30
_LEVEL = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by hash, their log weights, the bytes each stands for and the ids of the 256 byte pieces."""

    hashes: np.ndarray
    ids: np.ndarray
    longest: int
    log_weight: np.ndarray
    byte_ids: np.ndarray
    data: np.ndarray
    at: np.ndarray
    table: np.ndarray
    second: np.ndarray
    single: np.ndarray

    @property
    def kind(self) -> np.dtype:
        return np.dtype("<u2") if len(self.log_weight) <= 1 << 16 else np.dtype("<u4")


def _cumulated(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = scan._powers(len(points))
    acc = np.empty(len(points) + 1, np.uint64)
    acc[0] = 0
    np.cumsum(scan.mix(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=acc[1:])
    return acc, down


def _between(acc: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return scan.mix((acc[b] - acc[a]) * down[a] + (b - a).astype(np.uint64))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def load(model: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    """Read the pieces of a SentencePiece model that has byte fallback."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    n = m.get_piece_size()
    pieces = [m.id_to_piece(i) for i in range(n)]
    byte_ids = np.full(256, -1, np.int64)
    normal, said = [], []
    for i, p in enumerate(pieces):
        if m.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            said.append(bytes([int(p[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
            said.append(b"")
        else:
            normal.append(i)
            said.append(p.replace("▁", " ").encode())
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback")
    score = np.array([m.get_score(i) for i in range(n)])
    rank = np.empty(n)
    order = sorted(normal, key=lambda i: (-score[i], i))
    rank[order] = np.arange(len(order)) + 2.0
    log_weight = np.full(n, -alpha * np.log(len(order) + 2.0) - 10)
    log_weight[order] = -alpha * np.log(rank[order])
    hashes = np.empty(len(normal), np.uint64)
    for j, i in enumerate(normal):
        c = _points(pieces[i])
        acc, down = _cumulated(c)
        hashes[j] = _between(acc, down, np.array([0]), np.array([len(c)]))[0]
    by = np.argsort(hashes)
    hashes, ids = hashes[by], np.array(normal, np.int32)[by]
    table, second = np.full(1 << _TABLE, -1, np.int32), np.full(1 << _TABLE, -1, np.int32)
    table[hashes >> np.uint64(64 - _TABLE)] = np.arange(len(hashes))
    lost = np.flatnonzero(table[hashes >> np.uint64(64 - _TABLE)] != np.arange(len(hashes)))
    slot = (hashes[lost] >> np.uint64(64 - 2 * _TABLE)) & np.uint64((1 << _TABLE) - 1)
    second[slot] = lost
    if len(set(slot.tolist())) < len(lost):
        raise ValueError("two pieces share both of their slots")
    at = np.append(0, np.cumsum([len(s) for s in said]))
    single = np.zeros(_OWN_MARK + 1, bool)
    single[[ord(pieces[i]) for i in normal if len(pieces[i]) == 1]] = True
    return Vocabulary(hashes, ids, max(len(pieces[i]) for i in normal), log_weight, byte_ids, np.frombuffer(b"".join(said), np.uint8), at, table, second, single)


def _found(v: Vocabulary, h: np.ndarray) -> np.ndarray:
    """Index into ``ids`` of each hash, -1 where it is no piece's."""
    i = v.table[h >> np.uint64(64 - _TABLE)]
    wrong = np.flatnonzero(v.hashes[i] != h)
    if len(wrong):
        i[wrong] = v.second[(h[wrong] >> np.uint64(64 - 2 * _TABLE)) & np.uint64((1 << _TABLE) - 1)]
        i[wrong[v.hashes[i[wrong]] != h[wrong]]] = -1
    return i


def _edges(v: Vocabulary, points: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """(from, to, piece, log weight, level, unknown): the lattices of segments laid end to end, by end node.

    Segment i owns one node more than it has characters, numbered on from its
    first character's place plus i.  A level counts the characters up to an
    edge's end.  A piece id of n and more stands for ``unknown[piece - n]`` as
    bytes.
    """
    starts = np.cumsum(length) - length
    seg = np.repeat(np.arange(len(length), dtype=np.int32), length)
    place = np.arange(len(points), dtype=np.int32)
    room = np.repeat((starts + length).astype(np.int32), length) - place
    acc, down = _cumulated(points)
    n = len(v.log_weight)
    src, size, piece = [], [], []
    for k in range(1, min(v.longest, len(points)) + 1):
        if k < 8:  # most positions have room: whole arrays beat a selection
            h = scan.mix((acc[k:] - acc[:-k]) * down[: len(points) - k + 1] + np.uint64(k))
            s = np.flatnonzero((v.table[h >> np.uint64(64 - _TABLE)] >= 0) & (room[: len(h)] >= k))
            h = h[s]
        else:
            s = np.flatnonzero(room >= k)
            h = _between(acc, down, s, s + k)
            near = v.table[h >> np.uint64(64 - _TABLE)] >= 0
            s, h = s[near], h[near]
        i = _found(v, h)
        good = i >= 0
        src.append(s[good].astype(np.int32))
        size.append(np.full(len(src[-1]), k, np.int8))
        piece.append(v.ids[i[good]])
    lone = np.flatnonzero(~v.single[points])
    unknown, which = np.unique(points[lone], return_inverse=True)
    src.append(lone.astype(np.int32))
    size.append(np.ones(len(lone), np.int8))
    piece.append((n + which).astype(np.int32))
    src, size, piece = np.concatenate(src), np.concatenate(size), np.concatenate(piece)
    a = src + seg[src]
    order = np.argsort(a + size, kind="stable")  # each length's edges ascend already: a merge
    src, size, piece, a = src[order], size[order], piece[order], a[order]
    weight = np.append(v.log_weight, np.full(len(unknown), v.log_weight.min()))[piece]
    return a, a + size, piece, weight, src + size - starts[seg[src]], unknown


def _shares(a: np.ndarray, b: np.ndarray, weight: np.ndarray, level: np.ndarray, n_nodes: int) -> np.ndarray:
    """End node and, in the low bits, the running share of each edge's weight there, so that one search of whole numbers draws an edge."""
    total = np.zeros(n_nodes)  # log of the summed weight of all paths to each node
    deepest = int(level.max())
    order = np.argsort(level.astype(np.uint16 if deepest < 1 << 16 else np.int64), kind="stable")
    cut = np.append(0, np.cumsum(np.bincount(level)))[1:]
    for lo, hi in zip(cut[:-1], cut[1:]):
        e = order[lo:hi]
        to = b[e]
        head = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        total[to[head]] = np.logaddexp.reduceat(total[a[e]] + weight[e], head)
    share = np.exp(total[a] + weight - total[b])
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    size = np.diff(np.append(first, len(b)))
    last = first + size - 1
    # running sums node by node, in steps over all nodes: no figure hangs on what else is in the batch
    place = (np.arange(len(b), dtype=np.int32) - np.repeat(first.astype(np.int32), size)).astype(np.int16)
    cut = np.append(0, np.cumsum(np.bincount(place)))
    order = np.argsort(place, kind="stable")
    del place
    for lo, hi in zip(cut[1:-1], cut[2:]):
        at = order[lo:hi]
        share[at] += share[at - 1]
    del order
    share /= np.repeat(share[last], size)
    share *= 1 << _SHARE
    out = share.astype(np.int64)
    del share
    out += b.astype(np.int64) << _SHARE
    out[last] = (b[last].astype(np.int64) + 1) << _SHARE
    return out


def sample(v: Vocabulary, texts: list[str | None], seeds: np.ndarray) -> list[bytes | None]:
    """Piece ids of each text, drawn under its seed."""
    plain = [t or "" for t in texts]
    points = _points("".join("▁" + t if t else "" for t in plain)).copy()
    sizes = np.array([len(t) + 1 if t else 0 for t in plain], np.int64)
    doc_at = np.append(0, np.cumsum(sizes))
    front = doc_at[:-1][sizes > 0]
    own = points == _MARK
    own[front] = False
    points[own] = _OWN_MARK
    points[points == 0x20] = _MARK
    if not len(points):
        return [None if t is None else b"" for t in texts]
    mark = points == _MARK
    mark[1:] &= ~mark[:-1]
    mark[front] = True
    starts = np.flatnonzero(mark)
    ends = np.append(starts[1:], len(points))
    doc = np.searchsorted(doc_at, starts, "right") - 1
    acc, down = _cumulated(points)
    _, one, which = np.unique(_between(acc, down, starts, ends), return_index=True, return_inverse=True)
    del acc

    # the lattice of each distinct segment
    length = (ends - starts)[one]
    first = np.cumsum(length) - length
    own = points[np.repeat(starts[one] - first, length) + np.arange(length.sum())]
    a, b, piece, weight, level, unknown = _edges(v, own, length)
    share = _shares(a, b, weight, level, len(own) + len(length))

    # all occurrences step backward from their ends, those of one segment side by side
    occ = np.argsort(which, kind="stable")
    seed = scan.mix(seeds.view(np.uint64)[doc[occ]] + (starts - doc_at[doc])[occ].astype(np.uint64) * _LEVEL)
    home = (first + np.arange(len(first)))[which[occ]]
    node = home + length[which[occ]]
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    step = 0
    while len(occ):
        u = (scan.mix(seed + np.uint64(step * 0xD1B54A32D192ED03 & scan._M64)) >> np.uint64(64 - _SHARE)).astype(np.int64)
        pick = np.searchsorted(share, (node.astype(np.int64) << _SHARE) + u, "right")
        pick = np.minimum(pick, len(share) - 1)
        taken.append((occ, piece[pick]))
        node = a[pick]
        more = node != home
        occ, node, home, seed = occ[more], node[more], home[more], seed[more]
        step += 1
    count = np.zeros(len(starts), np.int64)
    for o, _ in taken:
        count[o] += 1
    end = np.cumsum(count)
    out = np.empty(end[-1], np.int64)
    for t, (o, p) in enumerate(taken):
        out[end[o] - 1 - t] = p
    bounds = np.append(0, end)[np.searchsorted(starts, doc_at)]
    n = len(v.log_weight)
    if len(unknown):
        out, bounds = _spell(v, out, bounds, unknown, n)
    raw = out.astype(v.kind).tobytes()
    w = v.kind.itemsize
    return [None if t is None else raw[x * w : y * w] for t, x, y in zip(texts, bounds[:-1], bounds[1:])]


def _spell(v: Vocabulary, out: np.ndarray, bounds: np.ndarray, unknown: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Replace characters outside the vocabulary by their byte pieces."""
    spelt = [chr(_MARK if c == _OWN_MARK else c).encode("utf-8", "surrogatepass") for c in unknown.tolist()]
    size = np.ones(len(out), np.int64)
    odd = np.flatnonzero(out >= n)
    lens = np.array([len(x) for x in spelt])
    size[odd] = lens[out[odd] - n]
    at = np.append(0, np.cumsum(size))
    wide = np.repeat(out, size)
    codes, first = np.frombuffer(b"".join(spelt), np.uint8), np.append(0, np.cumsum(lens)[:-1])
    reps = size[odd]
    inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    wide[np.repeat(at[odd], reps) + inner] = v.byte_ids[codes[np.repeat(first[out[odd] - n], reps) + inner]]
    return wide, at[bounds]


def restore(v: Vocabulary, ids: list[bytes | None]) -> list[bytes | None]:
    """The texts (UTF-8) that lists of piece ids stand for."""
    flat = np.frombuffer(b"".join(x or b"" for x in ids), v.kind).astype(np.int64)
    lens = v.at[flat + 1] - v.at[flat]
    to = np.append(0, np.cumsum(lens))
    data = v.data[np.repeat(v.at[flat] - to[:-1], lens) + np.arange(to[-1])].tobytes()
    bounds = to[np.append(0, np.cumsum(np.array([len(x or b"") // v.kind.itemsize for x in ids], np.int64)))]
    return [None if x is None else data[min(a + 1, b) : b] for x, a, b in zip(ids, bounds[:-1], bounds[1:])]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = 0, decode: bool = False) -> DataFrame:
    """(key, n_pieces, ids) of every row, and with ``decode`` the text read back from ids.

    ``ids`` is binary: little-endian unsigned numbers of 2 bytes (4 for
    vocabularies over 65,536).  The draw depends on key, ``seed`` and the text
    alone; rows that share key and text get the same pieces.

    A null text has null ids and 0 pieces, an empty text empty ids; any
    characters round-trip, the blank mark included; null keys are a key like
    another; other columns aren't read.  A text is one lattice
    whatever its length; memory follows the longest text.
    """
    spark = docs.sparkSession
    slim_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(load(model, alpha))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_pieces long, ids binary" + ", decoded string" * decode

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for table in scan.super_batches(batches, "text", 1 << 19):
            ids = sample(v, table["text"].to_pylist(), table["seed"].to_numpy())
            n = [len(x or b"") // v.kind.itemsize for x in ids]
            cols = {"key": table["key"], "n_pieces": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.binary())}
            if decode:
                cols["decoded"] = pa.array(restore(v, ids), pa.binary()).cast(pa.string())
            yield from pa.table(cols).to_batches()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.lit(seed), F.col(key)).alias("seed"))
    return rows.mapInArrow(go, schema).withColumnRenamed("key", key)


def decode(encoded: DataFrame, ids: str = "ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """``encoded`` with a column of the texts that ``ids`` stand for; null ids give null."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(load(model))
    names = [f"c{i}" for i in range(len(encoded.columns))]
    plain = encoded.toDF(*names)
    at = names[encoded.columns.index(ids)]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in scan.super_batches(batches, at, 1 << 19):
            yield from table.append_column("out", pa.array(restore(shared.value, table[at].to_pylist()), pa.binary()).cast(pa.string())).to_batches()

    done = plain.mapInArrow(go, T.StructType([*plain.schema, T.StructField("out", T.StringType())]))
    return done.toDF(*encoded.columns, text)
