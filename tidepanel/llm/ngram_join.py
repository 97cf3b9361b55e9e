"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Two documents link when the Jaccard similarity of their sets of word shingles
reaches a threshold.  The join is exact and proceeds in five steps:

1. every text becomes a set of shingle hashes; texts with one and the same set
   are one *class*, named by a 128-bit signature of the set;
2. each batch of texts sends a shingle once, with the place of its class in the
   batch, to the shingle's bucket; one that a single class has ends there, for
   the others the bucket answers the batch with the document frequency.  A
   shingle that every text holds costs its bucket one entry a batch;
3. back in its batch each class puts its shared shingles in order of rising
   document frequency; a class whose shared shingles cannot reach the overlap
   that the threshold asks for has no partner, any other keeps the prefix of
   that order in which every partner must share one (prefix filter);
4. classes that share a prefix shingle form blocks (connected components);
5. a block is searched in memory: short inverted lists are merged,
   long ones probed by binary search (DivideSkip), classes below the required
   overlap skipped, and pairs already in one component are not probed again.

A block of more than ``block_tokens`` shingles is cut into chunks that are
searched alone; what they find contracts the block: a class stays only while
one of its prefix shingles is still held by two components, so a group of near
copies melts away in a pass or two.  Chunks cut another way are searched next,
and what is left after that is searched by pairs of chunks, each pair a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import scan
from tidepanel.llm.components import connected_components
from tidepanel.llm.store import buckets_for, dropped, free, slim_batches, text_volume, written

SHINGLE = 5
NUM, DEN = 75, 100
#: passes over the chunks of large blocks before pairs of chunks are searched
TURNS = 2


def _sets(table: pa.Table, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): sorted distinct shingle hashes of each text of a batch."""
    buf, offsets = scan.text_bytes(table["text"])
    buf = scan.LOWER[buf]
    starts, ends, first = scan.spans(buf, offsets, scan.SPACE)
    tokens = scan.token_hash(buf, starts, ends)
    at, doc = scan.run_starts(first, shingle)
    hashes = scan.run_hash(tokens, shingle)[at]
    words = np.diff(first)
    few = np.flatnonzero((words > 0) & (words < shingle))
    if len(few):
        short = np.empty(len(few), np.uint64)
        for i, d in enumerate(few):
            own = tokens[first[d] : first[d + 1]]
            short[i] = scan.mix(own * np.uint64(3) + np.arange(1, len(own) + 1, dtype=np.uint64)).sum(dtype=np.uint64) + np.uint64(len(own))
        hashes, doc = np.append(hashes, short), np.append(doc, few)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[keep], doc[keep]
    return hashes, np.searchsorted(doc, np.arange(table.num_rows + 1))


def _signature(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else b""


def class_members(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, n_shingles, sig) of every row; sig is empty where the set is."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in scan.super_batches(batches, "text", 6 << 20):
            hashes, first = _sets(table, shingle)
            sigs = [_signature(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]
            yield from pa.table({"key": table["key"], "n_shingles": pa.array(np.diff(first), pa.int64()), "sig": pa.array(sigs, pa.binary())}).to_batches()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(go, f"key {kind}, n_shingles long, sig binary")


# The exchange of shingles.  Within a bucket a shingle is the low 48 bits of its hash; bucket and
# those bits name it from there on.  Sorted, they travel as their low 32 bits and the steps of the rest.
_TOKENS, _SEVERAL, _CLASSES = 0, 1, 2
_WIRE = "bucket long, batch long, kind int, m int, low binary, high binary, idx binary, more binary"
#: stands for "more than one class of the batch"; a batch holds fewer rows
_MANY = 0xFFFF
_LOW48 = np.uint64((1 << 48) - 1)


def _cut(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    raw, size = values.tobytes(), values.dtype.itemsize
    return [raw[a * size : b * size] for a, b in zip(bounds[:-1], bounds[1:])]


def _heads(*cols: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows."""
    new = np.ones(len(cols[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.flatnonzero(new)


def _rows(bucket: np.ndarray, batch: np.ndarray, bounds: np.ndarray, tokens: np.ndarray, idx: np.ndarray, more: list[bytes]) -> pa.Table:
    """One row for each stretch of ``bounds``; tokens rise within a stretch."""
    high = (tokens >> np.uint64(32)).astype(np.uint16)
    step = np.diff(high, prepend=np.uint16(0))
    step[bounds[:-1]] = high[bounds[:-1]]
    return pa.table(
        {
            "bucket": pa.array(bucket, pa.int64()),
            "batch": pa.array(batch, pa.int64()),
            "kind": pa.array(np.full(len(bucket), _TOKENS, np.int32)),
            "m": pa.array(np.diff(bounds).astype(np.int32)),
            "low": pa.array(_cut(tokens.astype(np.uint32), bounds), pa.binary()),
            "high": pa.array(_cut(step, bounds), pa.binary()),
            "idx": pa.array(_cut(idx, bounds), pa.binary()),
            "more": pa.array(more, pa.binary()),
        }
    )


def _joined(table: pa.Table, column: str, kind: object) -> np.ndarray:
    return np.frombuffer(b"".join(table[column].to_pylist()), kind)


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, row of each) of rows made by _rows."""
    m = table["m"].to_numpy()
    row = np.repeat(np.arange(len(m)), m)
    run = np.cumsum(_joined(table, "high", np.uint16), dtype=np.uint64)
    start = np.cumsum(m) - m
    base = np.where(start > 0, run[np.maximum(start, 1) - 1], np.uint64(0)) if len(run) else np.zeros(len(m), np.uint64)
    high = run - base[row]
    return (high << np.uint64(32)) | _joined(table, "low", np.uint32).astype(np.uint64), row


def _exchange_tokens(docs: DataFrame, text: str, shingle: int, n_buckets: int) -> DataFrame:
    """Rows of _WIRE.  Those of a bucket below zero go on to their batch as they are: its classes, and who holds the shingles that several of them hold."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in scan.super_batches(batches, "text", 6 << 20, _MANY - 1):
            hashes, first = _sets(table, shingle)
            ns = np.diff(first)
            sigs = np.array([_signature(hashes[a:b]).ljust(16, b"\0") for a, b in zip(first[:-1], first[1:])], "S16").view("V16")
            some = np.flatnonzero(ns)
            if not len(some):
                continue
            one = some[np.unique(sigs[some], return_index=True)[1]]  # copies within the batch send their set once
            place = np.full(len(ns), -1, np.int64)
            place[one] = np.arange(len(one))
            cls = np.repeat(place, ns)
            hashes, cls = hashes[cls >= 0], cls[cls >= 0].astype(np.uint16)
            batch = int.from_bytes(hashlib.blake2b(sigs[one].tobytes(), digest_size=8).digest(), "little", signed=True)
            bucket = (scan.mix(hashes) % np.uint64(n_buckets)).astype(np.int64)
            tokens = hashes & _LOW48
            order = np.lexsort((tokens, bucket))
            bucket, tokens, cls = bucket[order], tokens[order], cls[order]
            at = _heads(bucket, tokens)
            n = np.diff(np.append(at, len(tokens)))
            idx = np.where(n > 1, np.uint16(_MANY), cls[at])
            where = _heads(bucket[at])
            bounds = np.append(where, len(at))
            many = np.append(0, np.cumsum(n > 1))[bounds]
            yield from _rows(bucket[at][where], np.full(len(where), batch), bounds, tokens[at], idx, _cut(n[n > 1].astype(np.uint32), many)).to_batches(max_chunksize=4096)
            home = -1 - batch % n_buckets
            several = np.repeat(n > 1, n)
            held = (bucket[several].astype(np.uint64) << np.uint64(48)) | tokens[several]
            rest = {"bucket": [home] * 2, "batch": [batch] * 2, "kind": [_SEVERAL, _CLASSES], "m": [len(held), len(one)]}
            rest |= {"low": [held.tobytes(), sigs[one].tobytes()], "high": [b"", ns[one].astype(np.int32).tobytes()], "idx": [cls[several].tobytes(), b""], "more": [b"", b""]}
            yield from pa.table(rest, schema=pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("kind", pa.int32()), ("m", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("idx", pa.binary()), ("more", pa.binary())])).to_batches()

    return docs.select(F.col(text).alias("text")).mapInArrow(go, _WIRE)


def _shared_tokens(sent: DataFrame) -> DataFrame:
    """Per bucket of shingles: those that two classes or more have, answered to their batches with a grade of the frequency in ``more``."""

    def go(table: pa.Table) -> pa.Table:
        source = table["bucket"][0].as_py()
        if source < 0:
            return table
        tokens, row = _tokens(table)
        batch = table["batch"].to_numpy()[row]
        idx = _joined(table, "idx", np.uint16)
        count = np.ones(len(tokens), np.int64)
        count[idx == _MANY] = _joined(table, "more", np.uint32)
        order = np.lexsort((batch, tokens))
        tokens, batch, idx, count = tokens[order], batch[order], idx[order], count[order]
        once = _heads(tokens, batch)  # a batch that came twice, all of it copies, counts once
        tokens, batch, idx, count = tokens[once], batch[once], idx[once], count[once]
        at = _heads(tokens)
        df = np.add.reduceat(count, at) if len(at) else count
        size = np.diff(np.append(at, len(tokens)))
        grade = np.repeat(np.minimum(255, np.round(8 * np.log2(np.maximum(df, 1)))).astype(np.uint8), size)
        two = np.repeat(df >= 2, size)
        tokens, batch, idx, grade = tokens[two], batch[two], idx[two], grade[two]
        order = np.lexsort((tokens, batch))
        tokens, batch, idx, grade = tokens[order], batch[order], idx[order], grade[order]
        where = _heads(batch) if len(batch) else np.zeros(0, np.int64)
        bounds = np.append(where, len(batch))
        out = _rows(np.full(len(where), source), batch[where], bounds, tokens, idx, _cut(grade, bounds))
        scan.release()
        return out

    return sent.groupBy("bucket").applyInArrow(go, _WIRE)


_CAND = "sig binary, n int, n_tokens int, prefix int, tokens binary"


def _candidates(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Classes that may have a partner, with their shared shingles, rarest first."""

    def go(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        told = table.filter(pa.array(kind == _CLASSES)).slice(0, 1)
        sigs, sizes = _joined(told, "low", "V16"), _joined(told, "high", np.int32).astype(np.int64)
        answers = table.filter(pa.array(kind == _TOKENS))
        tokens, row = _tokens(answers)
        tokens |= answers["bucket"].to_numpy()[row].astype(np.uint64) << np.uint64(48)
        idx, grade = _joined(answers, "idx", np.uint16), _joined(answers, "more", np.uint8)
        order = np.argsort(tokens, kind="stable")
        tokens, idx, grade = tokens[order], idx[order], grade[order]
        several = table.filter(pa.array(kind == _SEVERAL)).slice(0, 1)
        held, who = _joined(several, "low", np.uint64), _joined(several, "idx", np.uint16)
        own = idx != _MANY
        cls = np.concatenate([idx[own], who]).astype(np.int64)
        grade = np.concatenate([grade[own], grade[np.searchsorted(tokens, held)] if len(held) else np.zeros(0, np.uint8)])
        tokens = np.concatenate([tokens[own], held])
        total = np.bincount(cls, minlength=len(sigs))
        least = -(-num * sizes // den)  # an overlap must reach this
        good = total >= least
        take = good[cls]
        tokens, grade, cls = tokens[take], grade[take], cls[take]
        order = np.lexsort((tokens, grade, cls))
        tokens, cls = tokens[order], cls[order]
        who = np.flatnonzero(good)
        bounds = np.append(np.searchsorted(cls, who), len(cls))
        scan.release()
        return pa.table(
            {
                "sig": pa.array([x.tobytes() for x in sigs[who]], pa.binary()),
                "n": pa.array(sizes[who].astype(np.int32)),
                "n_tokens": pa.array(total[who].astype(np.int32)),
                "prefix": pa.array((total[who] - least[who] + 1).astype(np.int32)),
                "tokens": pa.array(_cut(tokens, bounds), pa.binary()),
            }
        )

    return shared.groupBy("batch").applyInArrow(go, _CAND)


class Links:
    """Components over 0..n-1 with an up-to-date label per element; the smaller side is relabelled.  Elements of one ``group`` start together."""

    def __init__(self, group: np.ndarray):
        self.label = np.unique(group, return_inverse=True)[1].reshape(-1)
        order = np.argsort(self.label, kind="stable")
        cut = np.append(_heads(self.label[order]), len(order)) if len(order) else np.zeros(1, int)
        self.held = [order[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])]
        self.parts = len(self.held)
        self.made: list[tuple[int, int]] = []

    def join(self, x: int, y: int) -> None:
        a, b = int(self.label[x]), int(self.label[y])
        if a == b:
            return
        if len(self.held[a]) < len(self.held[b]):
            a, b = b, a
        self.label[self.held[b]] = a
        self.held[a] += self.held[b]
        self.held[b] = []
        self.parts -= 1
        self.made.append((x, y))

    def roots(self) -> np.ndarray:
        """The smallest element of each one's component."""
        least = np.full(len(self.held), len(self.label))
        np.minimum.at(least, self.label, np.arange(len(self.label)))
        return least[self.label]


def _needed(n: np.ndarray | int, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest overlap i of sets of n and m with den * i >= num * (n + m - i)."""
    return -(-num * (n + m) // (num + den))


def merged(posting: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int, slab: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(owners, in how many of the lists each is) of ascending lists.

    A stable sort merges ascending runs; many entries are counted slab by slab
    instead, so that what is held at a time is bounded by the sets and not by the lists.
    """
    upto = np.cumsum(ends - starts)
    if upto[-1] <= max(slab, n):
        runs = np.sort(np.concatenate([posting[a:b] for a, b in zip(starts.tolist(), ends.tolist())]), kind="stable")
        cut = np.append(_heads(runs), len(runs))
        return runs[cut[:-1]], np.diff(cut)
    count, at = np.zeros(n, np.int64), 0
    while at < len(starts):
        nxt = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + slab, "right")))
        count += np.bincount(np.concatenate([posting[a:b] for a, b in zip(starts[at:nxt].tolist(), ends[at:nxt].tolist())]), minlength=n)
        at = nxt
    found = np.flatnonzero(count)
    return found, count[found]


def search_block(sets: list[np.ndarray], sizes: np.ndarray, num: int = NUM, den: int = DEN, half: int | None = None, group: np.ndarray | None = None) -> Links:
    """T-occurrence search among sets of shared shingles.

    ``sizes`` are the full set sizes.  A set is matched with those behind it;
    with ``half`` only sets below that index are queries, and only those from it on
    are matched (the two sides of a pair of chunks).  Sets of one ``group`` are connected from
    the start.  A pair whose sides are already connected isn't probed, and
    lists whose owners are all connected are dropped as links are made.
    """
    links = Links(np.arange(len(sets)) if group is None else group)
    if links.parts < 2:
        return links
    if len(sets) == 2:
        if len(np.intersect1d(sets[0], sets[1], assume_unique=True)) >= _needed(int(sizes[0]), int(sizes[1]), num, den):
            links.join(0, 1)
        return links
    tokens = np.concatenate(sets)
    posting = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, posting = tokens[order], posting[order]

    def index(behind: int) -> tuple[np.ndarray, ...]:
        """Lists of two or more components, of the sets from ``behind`` on: (shingles, starts, ends, where the matched side starts)."""
        nonlocal tokens, posting
        stay = posting >= behind
        tokens, posting = tokens[stay], posting[stay]
        if not len(tokens):
            return tokens, *(np.zeros(0, np.int64),) * 3
        at = _heads(tokens)
        seen = links.label[posting]
        alive = np.minimum.reduceat(seen, at) != np.maximum.reduceat(seen, at)
        stay = np.repeat(alive, np.diff(np.append(at, len(tokens))))
        tokens, posting = tokens[stay], posting[stay]
        at = _heads(tokens) if len(tokens) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(tokens))
        side = at.copy() if half is None else at + np.add.reduceat(posting < half, at) if len(at) else at
        return tokens[at], at.copy(), ends, side

    heads, begin, end, side = index(0)
    made = 0
    for x in range(len(sets) if half is None else half):
        if links.parts == 1 or not len(heads):
            break
        lists = np.minimum(np.searchsorted(heads, sets[x]), len(heads) - 1)
        lists = lists[heads[lists] == sets[x]]
        if half is None:
            begin[lists] += 1  # past x itself: owners stand in order
        lo = begin[lists] if half is None else side[lists]
        width = end[lists] - lo
        some = width > 0
        lists, lo, width = lists[some], lo[some], width[some]
        least = int(-(-num * int(sizes[x]) // den))
        if len(lists) < least:
            continue
        by = np.argsort(width, kind="stable")
        lists, lo = lists[by], lo[by]
        n_long = min(least - 1, int(least / (0.0085 * np.log2(int(width[by[-1]]) + 1) + 1)))
        n_short = len(lists) - n_long
        found, count = merged(posting, lo[:n_short], end[lists[:n_short]], len(sets))
        need = _needed(int(sizes[x]), sizes[found], num, den)
        live = (count + n_long >= need) & (links.label[found] != links.label[x])
        found, count, need = found[live], count[live], need[live]
        for k in range(n_long):  # binary probes, the longest list first
            if not len(found):
                break
            i = len(lists) - 1 - k
            row = posting[lo[i] : end[lists[i]]]
            spot = np.searchsorted(row, found)
            count = count + (row[np.minimum(spot, len(row) - 1)] == found)
            live = count + (n_long - 1 - k) >= need
            if not live.all():
                found, count, need = found[live], count[live], need[live]
        for y in found[count >= need].tolist():
            links.join(x, y)
        if len(links.made) - made > max(16, (len(sets) - x) // 4):
            made = len(links.made)
            heads, begin, end, side = index(x + 1 if half is None else 0)
    return links


def _prefix_edges(cand: DataFrame, n_buckets: int) -> DataFrame:
    """(a, b): classes that share a prefix shingle, linked in a row."""
    kind = "bucket int, tokens binary, names binary"

    def chain(tokens: np.ndarray, cls: np.ndarray, n: int) -> np.ndarray:
        """For each class the smallest one it is linked to by equal shingles (sorted)."""
        same = np.flatnonzero(tokens[1:] == tokens[:-1])
        links = Links(np.arange(n))
        for x, y in np.unique(np.stack([cls[same], cls[same + 1]], 1), axis=0).tolist():
            links.join(x, y)
        return links.roots()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.frombuffer(b"".join(batch["sig"].to_pylist()), "V16")
            parts = [np.frombuffer(t, np.uint64)[:p] for t, p in zip(batch["tokens"].to_pylist(), batch["prefix"].to_pylist())]
            tokens = np.concatenate(parts)
            cls = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            order = np.argsort(tokens, kind="stable")
            tokens, cls = tokens[order], cls[order]
            root = chain(tokens, cls, len(parts))
            own = np.flatnonzero(root != np.arange(len(root)))
            rows = {"bucket": [-1 - int.from_bytes(names[0].tobytes()[:4], "little") % n_buckets], "tokens": [names[own].tobytes()], "names": [names[root[own]].tobytes()]}
            at = _heads(tokens) if len(tokens) else np.zeros(0, np.int64)
            bucket = (scan.mix(tokens[at]) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            where = _heads(bucket[order]) if len(at) else at
            bounds = np.append(where, len(at))
            rows["bucket"] += bucket[order][where].tolist()
            rows["tokens"] += _cut(tokens[at][order], bounds)
            rows["names"] += _cut(names[root[cls[at]]][order], bounds)
            yield from pa.table(rows, pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("names", pa.binary())])).to_batches(max_chunksize=4096)

    def link(table: pa.Table) -> pa.Table:
        named = _joined(table, "names", "V16")
        if table["bucket"][0].as_py() < 0:
            a, b = _joined(table, "tokens", "V16"), named
        else:
            tokens = _joined(table, "tokens", np.uint64)
            names, cls = np.unique(named, return_inverse=True)
            cls = cls.reshape(-1)
            order = np.lexsort((cls, tokens))
            root = chain(tokens[order], cls[order], len(names))
            own = np.flatnonzero(root != np.arange(len(names)))
            a, b = names[own], names[root[own]]
        return pa.table({"a": pa.array([x.tobytes() for x in a], pa.binary()), "b": pa.array([x.tobytes() for x in b], pa.binary())})

    return cand.select("sig", "prefix", "tokens").mapInArrow(send, kind).groupBy("bucket").applyInArrow(link, "a binary, b binary")


def _block_links(placed: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the links found in each bin of blocks, chunks or pairs of chunks."""

    def go(table: pa.Table) -> pa.Table:
        part, side = table["part"].to_numpy(), table["side"].to_numpy()
        sigs, raw, comps = table["sig"].to_pylist(), table["tokens"].to_pylist(), table["comp"].to_pylist()
        sizes = table["n"].to_numpy().astype(np.int64)
        order = np.lexsort((side, part))
        bounds = np.append(_heads(part[order]), len(part))
        a, b = [], []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            rows = order[lo:hi]
            names = [sigs[i] for i in rows]
            first = dict(zip(reversed(names), range(len(rows) - 1, -1, -1)))  # a class that came from several batches counts once
            rows = rows[sorted(first.values())]
            half = int(np.count_nonzero(side[rows] == 0)) if side[rows[-1]] else None
            group = np.frombuffer(b"".join(comps[i] for i in rows), "V16")
            links = search_block([np.frombuffer(raw[i], np.uint64) for i in rows], sizes[rows], num, den, half, group)
            a += [sigs[rows[x]] for x, _ in links.made]
            b += [sigs[rows[y]] for _, y in links.made]
        scan.release()
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return placed.groupBy("bin").applyInArrow(go, "a binary, b binary")


def _place(todo: DataFrame, blocks: DataFrame, sized: DataFrame, n_bins: int, block_tokens: int, turn: int, pairs: bool) -> DataFrame:
    """Put each class where its block is searched: (bin, part, side, sig, comp, n, tokens).  Small blocks share bins, the others have bins of their own."""
    where = blocks.join(sized, "root")
    rows = todo.join(where, F.col("comp") == F.col("node"))
    c = F.ceil(F.greatest(F.col("total"), F.lit(1)) / F.lit(block_tokens)).cast("int")
    mine = F.pmod(F.xxhash64("sig", F.lit(turn)), c).cast("int")
    other = F.explode(F.sequence(F.lit(0), c - 1)) if pairs else mine
    rows = rows.select("root", "total", "sig", "comp", "n", "tokens", mine.alias("i"), other.alias("j"))
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    part = F.xxhash64("root", lo, hi)
    side = F.when(F.col("i") <= F.col("j"), 0).otherwise(1)
    bin_ = F.when(F.col("total") * 8 > F.lit(block_tokens), part).otherwise(F.pmod(part, F.lit(n_bins)))
    return rows.select(bin_.alias("bin"), part.alias("part"), side.alias("side"), "sig", "comp", "n", "tokens")


def _still_open(todo: DataFrame, blocks: DataFrame, sized: DataFrame, found: DataFrame, block_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(classes of large blocks that may still have a partner in another component, the blocks these components form)."""
    roots = connected_components(found).withColumnsRenamed({"node": "sig", "root": "now"})
    large = blocks.join(sized.where(F.col("total") > block_tokens), "root", "left_semi").select(F.col("node").alias("comp"))
    rest = todo.join(large, "comp", "left_semi").drop("comp").join(roots, "sig", "left").withColumn("comp", F.coalesce("now", "sig")).drop("now")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(t, np.int64)[:p] for t, p in zip(batch["tokens"].to_pylist(), batch["prefix"].to_pylist())]
            row = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
            if len(row):
                yield from pa.table({"token": pa.array(np.concatenate(parts)), "sig": batch["sig"].take(row), "comp": batch["comp"].take(row)}).to_batches(max_chunksize=65_536)

    rest = written(rest, "rest")
    held = rest.select("sig", "comp", "prefix", "tokens").mapInArrow(spread, "token long, sig binary, comp binary")
    ends = held.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token", "low")
    hit = written(held.join(ends, "token").select("sig", "comp", "low").distinct(), "open")
    blocks = connected_components(hit.select(F.col("comp").alias("a"), F.col("low").alias("b")))
    return written(rest.join(hit.select("sig").distinct(), "sig", "left_semi"), "open-classes"), blocks


def _links(cand: DataFrame, n_buckets: int, num: int, den: int, block_tokens: int) -> DataFrame:
    blocks = connected_components(_prefix_edges(cand, n_buckets))
    todo, found = cand.withColumn("comp", F.col("sig")), cand.sparkSession.createDataFrame([], "a binary, b binary")
    for turn in range(TURNS + 1):
        sized = todo.select("comp", "n_tokens").join(blocks, F.col("comp") == F.col("node")).groupBy("root").agg(F.sum("n_tokens").alias("total"))
        state = sized.agg(F.max("total").alias("most"), F.sum("total").alias("all")).first()
        if state["most"] is None:
            break
        pairs = turn == TURNS
        n_bins = max(n_buckets, -(-8 * state["all"] // block_tokens))
        found = found.unionAll(written(_block_links(_place(todo, blocks, sized, n_bins, block_tokens, turn, pairs), num, den), "links"))
        if pairs or state["most"] <= block_tokens:
            break
        todo, blocks = _still_open(todo, blocks, sized, found, block_tokens)
    return found


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, num: int = NUM, den: int = DEN, block_tokens: int = 4_000_000) -> DataFrame:
    """One row per input row: (key, n_shingles, component_id).

    Words are maximal runs of bytes other than space and \\t..\\r, with A-Z in
    lower case; a text's set holds its distinct ``shingle``-word shingles, or
    its whole word sequence as one shingle where it has fewer words.  Rows link
    when ``den * |A & B| >= num * |A | B|``; ``component_id`` is the smallest
    key reachable by links, the row's own included.  Sets are compared by hash:
    64 bits a shingle for what is one class, 48 bits and the bucket between classes.

    Null and blank texts have an empty set: 0 shingles, linked with nothing,
    component_id = key.  Equal texts are in one component.  Repeated keys give
    one row each.  A null key counts in no minimum.  An empty table gives an
    empty table; other columns of ``docs`` are not touched.
    """
    spark = docs.sparkSession
    slim_batches(spark)
    n_buckets = buckets_for(spark, text_volume(docs, text))
    members = written(class_members(docs, key, text, shingle), "members")
    cand = written(_candidates(_shared_tokens(_exchange_tokens(docs, text, shingle, n_buckets)), num, den), "candidates")
    free(spark)
    links = _links(cand, n_buckets, num, den, block_tokens)
    # classes by name and smallest key, null keys last: a component's root has its smallest key
    classes = members.where(F.length("sig") > 0).groupBy("sig").agg(F.min("key").alias("low"))
    name = classes.select("sig", F.struct(F.col("low").isNull().alias("none"), "low", "sig").alias("name"))
    edges = links.join(name.withColumnsRenamed({"sig": "a", "name": "u"}), "a").join(name.withColumnsRenamed({"sig": "b", "name": "v"}), "b")
    roots = connected_components(edges, "u", "v").select(F.col("node.sig").alias("sig"), F.col("root.low").alias("root"), F.lit(True).alias("linked"))
    dropped(cand)
    free(spark)
    named = classes.join(roots, "sig", "left").select("sig", F.when(F.col("linked"), F.col("root")).otherwise(F.col("low")).alias("component_id"))
    out = members.join(named, "sig", "left").select("key", "n_shingles", F.when(F.length("sig") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))
    return out.withColumnRenamed("key", key)
