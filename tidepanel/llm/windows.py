"""Removal of repeated windows of k consecutive tokens (words or lines).

Used by substring dedup and line dedup.  A window is named by a 96-bit hash of
its k tokens, which are themselves compared by 64-bit hashes; "equal" is as sure as
these are.  Occurrences are settled in two levels:

* within a batch of documents the first occurrence owns the window and those
  behind it are covered at once; only owners go on, so a window that
  every document holds costs the exchange one entry per batch;
* owners are exchanged by hash bucket, where the smallest one wins and the
  others are told that they are covered.

Covered positions return to their documents by a second exchange and are
merged there.  Entries travel packed, some 16 bytes a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema

from tidepanel.llm import scan
from tidepanel.llm.store import buckets_for, slim_batches, text_volume

_OWNERS = "bucket int, keys binary, tags binary, counts binary, h1 binary, h2 binary, pos binary"
_COVER = "bucket int, keys binary, tags binary, counts binary, pos binary"


@dataclass(frozen=True)
class Tokens:
    """A batch of texts cut into tokens."""

    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    blank: np.ndarray | None = None


def words(column: pa.ChunkedArray) -> Tokens:
    buf, offsets = scan.text_bytes(column)
    return Tokens(buf, offsets, *scan.spans(buf, offsets, scan.SPACE))


def lines(column: pa.ChunkedArray) -> Tokens:
    buf, offsets = scan.text_bytes(column)
    starts, ends, first = scan.line_spans(buf, offsets, np.asarray(column.is_valid()))
    solid = np.append(0, np.cumsum(~scan.SPACE[buf]))
    return Tokens(buf, offsets, starts, ends, first, solid[ends] == solid[starts])


#: (tokens, hash of each token, position and document of each window) -> windows to look at
Filter = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _runs(*cols: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows."""
    head = np.ones(len(cols[0]), bool)
    if len(head) > 1:
        head[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.flatnonzero(head)


def _cut(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    raw, size = values.tobytes(), values.dtype.itemsize
    return pa.array([raw[a * size : b * size] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())


def _packed(bucket: np.ndarray, doc: np.ndarray, keys: np.ndarray, tags: np.ndarray, cols: dict[str, np.ndarray]) -> pa.Table:
    order = np.lexsort((doc, bucket))
    bucket, doc = bucket[order], doc[order]
    at = _runs(bucket, doc)
    owner, owner_bucket = doc[at], bucket[at]
    where = _runs(owner_bucket) if len(at) else at
    bounds = np.append(where, len(owner))
    inner = np.append(at[where], len(doc)) if len(at) else np.zeros(1, int)
    out = {"bucket": pa.array(owner_bucket[where].astype(np.int32)), "keys": _cut(keys[owner], bounds), "tags": _cut(tags[owner], bounds)}
    out["counts"] = _cut(np.diff(np.append(at, len(doc))).astype(np.int32), bounds)
    return pa.table(out | {k: _cut(v[order], inner) for k, v in cols.items()})


def _joined(table: pa.Table, column: str, kind: object) -> np.ndarray:
    return np.frombuffer(b"".join(table[column].to_pylist()), kind)


def _home(keys: np.ndarray, tags: np.ndarray, n: int) -> np.ndarray:
    """The chunk of documents that a row belongs to; _keyed says the same in SQL."""
    return ((keys & 0xFFFFFFFF) ^ tags.astype(np.int64)) % n


def _keyed(docs: DataFrame, key: str, text: str, n: int, *more: Column) -> DataFrame:
    """key, tag (tells apart rows that share a key), home (chunk) and text."""
    own, tag = F.col(key).cast("long"), F.crc32(F.coalesce(F.col(text), F.lit("")))
    home = F.pmod(F.coalesce(own, F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(tag), F.lit(n)).cast("int")
    return docs.select(own.alias("key"), tag.alias("tag"), home.alias("bucket"), F.col(text).alias("text"), *more)


def _owners(docs: DataFrame, cut: Callable[[pa.ChunkedArray], Tokens], k: int, by_position: bool, n: int, choose: Callable[[], Filter] | None) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = choose() if choose else None
        for table in scan.super_batches(batches, "text"):
            table = table.filter(table["key"].is_valid())
            if not table.num_rows:
                continue
            t = cut(table["text"])
            keys, tags = table["key"].to_numpy(), table["tag"].to_numpy().astype(np.uint32)
            hashes = scan.token_hash(t.buf, t.starts, t.ends)
            at, doc = scan.run_starts(t.first, k)
            if t.blank is not None:
                solid = np.append(0, np.cumsum(~t.blank))
                some = solid[at + k] > solid[at]
                at, doc = at[some], doc[some]
            if wanted:
                some = wanted(hashes, at, doc)
                at, doc = at[some], doc[some]
            h1, h2 = scan.run_hash(hashes, k)[at], (scan.run_hash(hashes, k, 1)[at] >> np.uint64(32)).astype(np.uint32)
            pos = (at - t.first[doc]).astype(np.int32)
            order = np.lexsort((pos, keys[doc], h2, h1))
            h1, h2, doc, pos = h1[order], h2[order], doc[order], pos[order]
            own = keys[doc]
            head = _runs(h1, h2) if len(h1) else np.zeros(0, np.int64)
            size = np.diff(np.append(head, len(h1)))
            later = own > np.repeat(own[head], size)
            if by_position:
                later |= (own == np.repeat(own[head], size)) & (pos > np.repeat(pos[head], size))
            if later.any():
                local = doc[later]
                yield from _cover(_home(keys, tags, n)[local], local, keys, tags, pos[later]).to_batches(max_chunksize=2048)
            go_on = ~later
            bucket = ((h1[go_on] >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
            if len(bucket):
                yield from _packed(bucket, doc[go_on], keys, tags, {"h1": h1[go_on], "h2": h2[go_on], "pos": pos[go_on]}).to_batches(max_chunksize=2048)

    return docs.mapInArrow(go, _OWNERS)


def _cover(home: np.ndarray, doc: np.ndarray, keys: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> pa.Table:
    """Rows of positions that are settled: no hashes, and a bucket below zero that names the document's chunk."""
    table = _packed(-1 - home, doc, keys, tags, {"pos": pos})
    none = pa.array([b""] * table.num_rows, pa.binary())
    return pa.table({"bucket": table["bucket"], "keys": table["keys"], "tags": table["tags"], "counts": table["counts"], "h1": none, "h2": none, "pos": table["pos"]})


def _settle(owners: DataFrame, by_position: bool, n: int) -> DataFrame:
    """Per bucket of windows, who is covered; rows already settled pass through."""

    def go(table: pa.Table) -> pa.Table:
        keys, tags = _joined(table, "keys", np.int64), _joined(table, "tags", np.uint32)
        counts, pos = _joined(table, "counts", np.int32), _joined(table, "pos", np.int32)
        if table["bucket"][0].as_py() < 0:
            return table.select(["bucket", "keys", "tags", "counts", "pos"])
        h1, h2 = _joined(table, "h1", np.uint64), _joined(table, "h2", np.uint32)
        doc = np.repeat(np.arange(len(keys)), counts)
        order = np.lexsort((pos, keys[doc], h2, h1))
        h1, h2, doc, pos = h1[order], h2[order], doc[order], pos[order]
        own = keys[doc]
        head = _runs(h1, h2)
        size = np.diff(np.append(head, len(h1)))
        later = own > np.repeat(own[head], size)
        if by_position:
            later |= (own == np.repeat(own[head], size)) & (pos > np.repeat(pos[head], size))
        doc, pos = doc[later], pos[later]
        scan.release()
        return _packed(-1 - _home(keys, tags, n)[doc], doc, keys, tags, {"pos": pos})

    return owners.groupBy("bucket").applyInArrow(go, _COVER)


def remove_repeats(
    docs: DataFrame,
    key: str,
    text: str,
    unit: str,
    k: int,
    by_position: bool,
    choose: Callable[[], Filter] | None = None,
    volume: int | None = None,
) -> DataFrame:
    """``docs`` with ``text`` reduced, plus n_tokens and n_removed (long).

    Columns of ``docs`` named n_tokens or n_removed give way to these.

    ``unit`` is "word" (kept words are joined by one space) or "line" (by \\n).
    An occurrence is covered when the window occurs under a smaller key or,
    with ``by_position``, under the same key at a smaller position.
    Rows with a null key are neither looked at nor changed in what they keep.
    """
    spark = docs.sparkSession
    if docs.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be of an integer type: which copy stays is a matter of the keys' order")
    slim_batches(spark)
    cut, glue = (words, 0x20) if unit == "word" else (lines, 0x0A)
    n = buckets_for(spark, text_volume(docs, text) if volume is None else volume)
    keyed = _keyed(docs, key, text, n)
    cover = _settle(_owners(keyed, cut, k, by_position, n, choose), by_position, n)

    kept = [c for c in docs.columns if c not in (text, "n_tokens", "n_removed")]
    plain = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    schema = docs.select(*plain).schema
    rows = _keyed(docs, key, text, n, *plain)
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in schema)

    def reduce(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, tags = _joined(right, "keys", np.int64), _joined(right, "tags", np.uint32)
        bounds = np.append(0, np.cumsum(_joined(right, "counts", np.int32)))
        pos = _joined(right, "pos", np.int32).astype(np.int64)
        of: dict[tuple[int, int], list[int]] = {}
        for i, who in enumerate(zip(keys.tolist(), tags.tolist())):
            of.setdefault(who, []).append(i)
        parts = []
        for piece in scan.super_batches(iter(left.to_batches()), "text", 4 << 20):
            t = cut(piece["text"])
            hit = [pos[bounds[i] : bounds[i + 1]] + t.first[d] for d, who in enumerate(zip(piece["key"].to_pylist(), piece["tag"].to_pylist())) for i in of.get(who, ())]
            at = np.concatenate(hit) if hit else np.zeros(0, np.int64)
            size = len(t.starts) + 1
            keep = np.cumsum(np.bincount(at, minlength=size) - np.bincount(at + k, minlength=size))[:-1] == 0
            gone = np.append(0, np.cumsum(~keep))[t.first]
            new = scan.keep_tokens(t.buf, t.offsets, t.starts, t.ends, t.first, keep, glue)
            cols = {c: piece[c] for c in schema.names}
            cols |= {"text": new, "n_tokens": pa.array(np.diff(t.first), pa.int64()), "n_removed": pa.array(np.diff(gone), pa.int64()), "gap": piece["text"].is_null()}
            parts.append(pa.table(cols))
        return pa.concat_tables(parts)

    out = f"{fields}text string, n_tokens long, n_removed long, gap boolean"
    empty = spark.createDataFrame([], out).schema

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return reduce(left, right) if left.num_rows else to_arrow_schema(empty).empty_table()

    masks = cover.select((-1 - F.col("bucket")).alias("bucket"), "keys", "tags", "counts", "pos")
    done = rows.groupBy("bucket").cogroup(masks.groupBy("bucket")).applyInArrow(both, out)
    back = [F.when(~F.col("gap"), F.col("text")).alias(text) if c == text else F.col(f"c{kept.index(c)}").alias(c) for c in docs.columns if c == text or c in kept]
    return done.select(*back, "n_tokens", "n_removed")
