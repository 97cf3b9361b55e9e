"""Alignment of two tokenizers' tokens over the same bytes.

A is a byte-level BPE read from its JSON file, B a SentencePiece BPE; both see
one blank in front of the text.  The tokens of B are a static interval index
(sorted starts and ends); every token of A stabs it by bisection and lists the
tokens it overlaps.  A gap between two tokens of B that no token of A spans is
a group boundary: there both end.

Neither tokenizer ever joins a blank to a visible character before it (the
first cuts words there before merging, the second has no such piece, which is
checked on loading), so texts fall apart into segments that are encoded and
aligned once per distinct segment of a batch.

How often a pair of ids is linked is a figure of the whole corpus.  Each batch
tells its distinct pairs once, Spark sums them, and the sums go back to the
batches that asked; no table of pairs has to fit anywhere.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import scan
from tidepanel.llm.store import slim_batches, written

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
#: bytes of text in a batch, which bound what a task holds; a longer text is a batch by itself
BATCH = 4 << 20
_NO_TOKENS = ""

# a segment starts at a blank behind one of these bytes: visible ASCII, or the end of a character that can't be white space
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0x80:0xC0] = True
_VISIBLE[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False  # last bytes of U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000


def _letter_bytes() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 is itself, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoders:
    """Both tokenizers, the bytes of their tokens and the texts of their ids."""

    def __init__(self, a: str, b: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letters = _letter_bytes()
        said_a = {i: bytes(letters[c] for c in t) for t, i in json.loads(a)["model"]["vocab"].items()}
        self.size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of the model has a blank behind a visible character")
        self.blank = self.b.piece_to_id("▁")
        self.bytes_a = pa.array([said_a.get(i, b"") for i in range(self.size_a)], pa.large_binary())
        self.bytes_b = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], pa.large_binary())
        say = lambda n, end: [b"%d%s" % (i, end) for i in range(n)]
        self.says = pa.array([*say(self.size_a, b","), *say(self.size_a, b"|"), *say(self.size_b, b","), *say(self.size_b, b";")], pa.large_binary())

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of texts that start with a blank."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] for s in segments], num_threads=1)  # B puts the blank in front itself
        return a, [x if len(s) > 1 else [self.blank] for s, x in zip(segments, b)]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes


def _taken(table: pa.Array, at: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """(bytes, offsets) of entries of a binary array laid end to end."""
    out = table.take(pa.array(at))
    _, off, data = out.buffers()
    offsets = np.frombuffer(off, np.int64)[: len(at) + 1] if len(at) else np.zeros(1, np.int64)
    return memoryview(data).cast("B") if data is not None else memoryview(b""), offsets


def boundaries(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Which tokens of B end a group, for tokens given by their ends, both over the same bytes from 0."""
    a_starts, b_starts = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
    low = np.searchsorted(b_ends, a_starts, "right")  # the first token that each stab meets, and the last
    high = np.searchsorted(b_starts, a_ends, "left") - 1
    spanned = np.bincount(low, minlength=len(b_ends) + 1) - np.bincount(high, minlength=len(b_ends) + 1)
    return np.cumsum(spanned)[: len(b_ends)] == 0


class Segments:
    """The distinct segments of a batch: encoded, aligned, with their links and what is said of their groups."""

    def __init__(self, enc: Encoders, raw: list[bytes]) -> None:
        texts = [r.decode("utf-8", "replace") for r in raw]
        ids_a, ids_b = enc.encode(texts)
        (a, self.n_a), (b, self.n_b) = _flat(ids_a), _flat(ids_b)
        del ids_a, ids_b
        data_a, at_a = _taken(enc.bytes_a, a)
        data_b, at_b = _taken(enc.bytes_b, b)
        cut_a, cut_b = at_a[np.append(0, np.cumsum(self.n_a))].tolist(), at_b[np.append(0, np.cumsum(self.n_b))].tolist()
        self.same = np.fromiter((data_a[cut_a[i] : cut_a[i + 1]] == r == data_b[cut_b[i] : cut_b[i + 1]] for i, r in enumerate(raw)), bool, len(raw))
        # what follows is about the segments whose bytes both give back
        a, b = a[np.repeat(self.same, self.n_a)], b[np.repeat(self.same, self.n_b)]
        a_ends, b_ends = np.cumsum(np.diff(at_a)[np.repeat(self.same, self.n_a)]), np.cumsum(np.diff(at_b)[np.repeat(self.same, self.n_b)])
        last_b = np.flatnonzero(boundaries(a_ends, b_ends))
        last_a = np.searchsorted(a_ends, b_ends[last_b])
        self.pair = a[last_a] * enc.size_b + b[last_b]
        ends = np.cumsum(np.where(self.same, [len(r) for r in raw], 0))
        self.n_groups = np.diff(np.append(0, np.searchsorted(b_ends[last_b], ends, "right")))
        # ids in the order in which they are told: a group's of A, then its of B
        group_a = np.searchsorted(last_a, np.arange(len(a)))
        group_b = np.searchsorted(last_b, np.arange(len(b)))
        order = np.empty(len(a) + len(b), np.int64)
        say_a, say_b = a.copy(), b + 2 * enc.size_a
        say_a[last_a] += enc.size_a
        say_b[last_b] += enc.size_b
        order[np.arange(len(a)) + np.append(0, last_b + 1)[group_a]] = say_a
        order[np.arange(len(b)) + (last_a + 1)[group_b]] = say_b
        told, at = _taken(enc.says, order)
        cuts = at[np.append(0, np.cumsum(np.where(self.same, self.n_a + self.n_b, 0)))]
        self.says = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(told)])


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for size[i] numbers, one range after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs of values that end at ``ends``."""
    return np.diff(np.append(0, np.append(0, np.cumsum(values))[ends]))


def align_batch(enc: Encoders, texts: pa.ChunkedArray, groups: bool) -> tuple[dict[str, pa.Array], np.ndarray, np.ndarray]:
    """(columns of a row for each text, distinct pairs of ids linked, how often each: not at all where the text has no tokens)."""
    raw, offsets = scan.text_bytes(texts)
    full = np.diff(offsets) > 0
    buf = np.insert(raw, offsets[:-1][full], 0x20)
    offsets = offsets + np.append(0, np.cumsum(full))
    n = len(full)
    start = np.zeros(len(buf) + 1, bool)
    start[1:-1] = (buf[1:] == 0x20) & _VISIBLE[buf[:-1]]
    start[offsets[:-1][full]] = True
    starts = np.flatnonzero(start[:-1])
    ends = np.append(starts[1:], len(buf))[: len(starts)]
    first = np.searchsorted(starts, offsets)  # segments of text d: first[d] : first[d + 1]
    _, one, which = np.unique(scan.token_hash(buf, starts, ends), return_index=True, return_inverse=True)
    view = memoryview(buf)
    seg = Segments(enc, [bytes(view[s:e]) for s, e in zip(starts[one].tolist(), ends[one].tolist())])
    bad = _sums(~seg.same[which], first[1:]) > 0
    good = full & ~bad
    used = np.repeat(good, np.diff(first))
    which, stop = which[used], np.cumsum(np.where(good, np.diff(first), 0))
    of = lambda x: _sums(x[which], stop)

    told, at = _taken(seg.says, which)
    at = at[np.append(0, stop)].tolist()
    told = [told[x : y - 1] if y > x else b"" for x, y in zip(at[:-1], at[1:])]
    sha = [hashlib.sha256(t).hexdigest() if g else _NO_TOKENS for g, t in zip(good.tolist(), told)]

    pairs, local = np.unique(seg.pair, return_inverse=True)
    times = np.bincount(local, weights=np.repeat(np.bincount(which, minlength=len(seg.same)), seg.n_groups), minlength=len(pairs)).astype(np.int64)
    links = local[_ranges((np.cumsum(seg.n_groups) - seg.n_groups)[which], seg.n_groups[which])]
    n_links = of(seg.n_groups)
    # each text's links in order, as steps: a byte each, with the few wide ones apart
    key = np.sort(np.repeat(np.arange(n), n_links) * max(len(pairs), 1) + links) % max(len(pairs), 1)
    at = np.append(0, np.cumsum(n_links))
    step = np.diff(key, prepend=0)
    head = at[:-1][n_links > 0]
    step[head] = key[head]
    wide = step >= 255
    low, high = np.minimum(step, 255).astype(np.uint8).tobytes(), step[wide].astype("<u4").tobytes()
    wide_at = np.append(0, np.cumsum(wide))[at] * 4
    columns = {
        "n_a": pa.array(of(seg.n_a)),
        "n_b": pa.array(of(seg.n_b)),
        "n_groups": pa.array(n_links),
        "groups_sha256": pa.array(sha, pa.string()),
        "low": pa.array([low[x:y] for x, y in zip(at[:-1], at[1:])], pa.binary()),
        "high": pa.array([high[x:y] for x, y in zip(wide_at[:-1], wide_at[1:])], pa.binary()),
    }
    if groups:
        columns["groups"] = pa.array([bytes(t) for t in told], pa.binary()).cast(pa.string())
    return columns, pairs, times


def _counted(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over the links of a batch's texts: ``right`` has a row (pos, n, best) for each distinct pair of the batch."""
    by = np.argsort(right["pos"].to_numpy())
    count, best = right["n"].to_numpy()[by], right["best"].to_numpy()[by].astype(np.int64)
    step = np.frombuffer(b"".join(left["low"].to_pylist()), np.uint8).astype(np.int64)
    step[step == 255] = np.frombuffer(b"".join(left["high"].to_pylist()), "<u4")
    n = left["n_groups"].to_numpy()
    stop = np.cumsum(n)
    run = np.cumsum(step)
    pair = run - np.repeat(np.append(0, run)[stop - n], n)
    n_best, count_sum = (_sums(x[pair], stop) if len(pair) else np.zeros(len(n), np.int64) for x in (best, count))
    out = left.drop_columns(["low", "high", "batch"])
    return out.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER_A, model: str = MODEL_B, groups: bool = False) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row, with ``groups`` the groups themselves too.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``: ids of A and B, a group at a time.  A link
    is a pair of tokens that end at the same byte, so every group ends with one.
    ``count_sum`` adds up how often the pairs of ids linked here are linked in the
    whole corpus; ``n_best`` counts the links whose pair is linked as often as any
    pair of the same B id.

    A text that is null, empty, or that either tokenizer doesn't give back byte by
    byte (one that holds the blank mark U+2581) has no tokens: zeros and empty texts.
    Repeated rows are rows of their own and count each; null keys are keys
    like others; an empty table gives an empty table; other columns play no part.
    Strings of special tokens in a text are plain text.  Segments are equal as surely
    as 64-bit hashes of at most some hundred thousand a batch are.
    """
    spark = docs.sparkSession
    slim_batches(spark)
    with open(tokenizer, encoding="utf-8") as f, open(model, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))  # two vocabulary files
    kind = docs.schema[key].dataType.simpleString()
    fields = f"key {kind}, n_a long, n_b long, n_groups long, groups_sha256 string" + ", groups string" * groups
    size_b = F.lit(Encoders(*files.value).size_b)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        place = TaskContext.get().partitionId() << 32
        for table in scan.super_batches(batches, "text", BATCH):
            enc = enc or Encoders(*files.value)
            columns, pairs, times = align_batch(enc, table["text"], groups)
            columns = {"batch": pa.array(np.full(table.num_rows, place)), "key": table["key"].combine_chunks()} | columns
            rows = pa.table(columns)
            none = pa.nulls(table.num_rows, pa.list_(pa.int64()))
            yield from rows.append_column("pairs", none).append_column("times", none).to_batches()
            own = {"batch": pa.array([place]), "pairs": pa.array([pairs], pa.list_(pa.int64())), "times": pa.array([times], pa.list_(pa.int64()))}
            yield from pa.table({f.name: own[f.name] if f.name in own else pa.nulls(1, f.type) for f in rows.schema} | own).to_batches()
            place += 1
        scan.release()

    told = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(go, f"batch long, {fields.replace(', groups string', '')}, low binary, high binary{', groups string' * groups}, pairs array<long>, times array<long>")
    told = written(told, "aligned")
    asked = told.where("pairs is not null").select("batch", F.posexplode(F.arrays_zip("pairs", "times")).alias("pos", "p")).select("batch", "pos", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = asked.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair") % size_b)
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of B
    counts = counts.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = asked.join(counts, "pair").select(F.col("batch").alias("asker"), "pos", "n", "best")
    texts = told.where("pairs is null").drop("pairs", "times")
    # a group is what one batch held
    done = texts.groupBy("batch").cogroup(answers.groupBy("asker")).applyInArrow(_counted, f"{fields}, n_best long, count_sum long")
    out = [F.col("key").alias(key), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else [])]
    return done.select(*out)
