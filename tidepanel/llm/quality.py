"""Quality rules: counts per text and a calibrated n-gram classifier.

The classifier is a logistic regression over hashed word and byte n-grams.
It is fitted on the driver from at most ``max_train`` labelled rows (those of
the smallest key hashes), its probability is calibrated on held-out rows,
and every text is scored in Arrow batches against a fixed threshold.
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

#: characters that n_symbols counts (fixed values)
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
#: a text fails when more than REPEAT_OUT of REPEAT_OF of its words lie in repeated three-word windows
REPEAT_OUT, REPEAT_OF = 50, 100
THRESHOLD = 0.5
MAX_TRAIN = 4000
_BITS = 14
_GRAM = 4
_SCALE = 30.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def base_counts(buf: np.ndarray, offsets: np.ndarray, present: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    starts, ends, first = scan.spans(buf, offsets, scan.SPACE)
    tokens = scan.token_hash(buf, starts, ends)
    per_doc = lambda flags: np.diff(np.append(0, np.cumsum(flags))[offsets])
    chars = per_doc(~scan.SPACE[buf] & ((buf & 0xC0) != 0x80))
    at, doc = scan.run_starts(first, 3)
    repeated = _repeated(scan.run_hash(tokens, 3)[at], doc)[0]
    cover = np.bincount(at[repeated], minlength=len(tokens) + 3)
    cover = cover[: len(tokens)] + np.append(0, cover)[: len(tokens)] + np.append([0, 0], cover)[: len(tokens)]
    ls, le, lf = scan.line_spans(buf, offsets, present)
    solid = np.append(0, np.cumsum(~scan.SPACE[buf]))
    some = solid[le] > solid[ls]
    line_doc = np.repeat(np.arange(len(offsets) - 1), np.diff(lf))[some]
    again = _repeated(scan.token_hash(buf, ls[some], le[some]), line_doc)[1]
    return {
        "n_words": np.diff(first),
        "word_chars": chars,
        "n_symbols": per_doc(_SYMBOL[buf]),
        "n_dup_lines": np.bincount(line_doc[again], minlength=len(offsets) - 1),
        "n_repeat_words": np.diff(np.append(0, np.cumsum(cover > 0))[first]),
    }


def _repeated(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: occurs twice or more in its document; occurs earlier in its document."""
    own = scan.mix(hashes + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(own, kind="stable")
    seen = own[order]
    same = seen[1:] == seen[:-1]
    twice, earlier = np.zeros(len(own), bool), np.zeros(len(own), bool)
    twice[order] = np.append(same, False) | np.append(False, same) if len(own) else False
    earlier[order] = np.append(False, same) if len(own) else False
    return twice, earlier


def _grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word features, their bounds, byte features, their bounds)."""
    starts, ends, first = scan.spans(buf, offsets, scan.SPACE)
    words = (scan.token_hash(buf, starts, ends) >> np.uint64(64 - _BITS)).astype(np.int32)
    n = len(buf) - _GRAM + 1
    if n <= 0:
        return words, first, np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    code = buf[:n].astype(np.uint32)
    for j in range(1, _GRAM):
        code |= buf[j : j + n].astype(np.uint32) << np.uint32(8 * j)
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    grams = (code >> np.uint32(32 - _BITS)).astype(np.int32) + (1 << _BITS)
    return words, first, grams, offsets


def _rows(first: np.ndarray, limit: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds [a, b) per document, less ``short`` at its end."""
    a = np.minimum(first[:-1], limit)
    return a, np.maximum(np.minimum(first[1:] - short, limit), a)


def _mean(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.append(0.0, np.cumsum(values, dtype=np.float64))
    return (total[b] - total[a]) / np.maximum(b - a, 1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words, first, grams, at = _grams(buf, offsets)
        w = self.weights.astype(np.float32)
        z = _mean(w[words], *_rows(first, len(words), 0)) + _mean(w[grams], *_rows(at, len(grams), _GRAM - 1))
        z = self.slope * (_SCALE * z + self.bias) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _minimise(loss, x: np.ndarray, rounds: int = 60) -> np.ndarray:
    """L-BFGS with halving line search."""
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y, rho in reversed(past):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(past, reversed(alphas)):
            q += s * (a - rho * (y @ q))
        step = 1.0 if past else 1 / max(1.0, float(np.linalg.norm(g)))
        slope = float(g @ q)
        while step > 1e-6:
            f2, g2 = loss(x - step * q)
            if f2 <= f - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, g2 - g
        x = x + s
        if s @ y > 1e-12:
            past = [*past[-9:], (s, y, 1 / float(s @ y))]
        done = f - f2 < 1e-6 * max(1.0, abs(f))
        f, g = f2, g2
        if done:
            break
    return x


def sparse(texts: pa.ChunkedArray) -> list[tuple[bytes, bytes]]:
    """(features, their frequencies) of each text, as bytes of int32 and float32."""
    buf, offsets = scan.text_bytes(texts)
    words, first, grams, at = _grams(buf, offsets)
    out = []
    bounds = zip(*_rows(first, len(words), 0), *_rows(at, len(grams), _GRAM - 1))
    for a, b, c, d in bounds:
        parts = [np.unique(feats[lo:hi], return_counts=True) for feats, lo, hi in ((words, a, b), (grams, c, d))]
        freq = [n * (_SCALE / max(1, n.sum())) for _, n in parts]
        out.append((np.concatenate([i for i, _ in parts]).astype(np.int32).tobytes(), np.concatenate(freq).astype(np.float32).tobytes()))
    return out


def fit(feats: list[tuple], y: np.ndarray, l2: float = 1e-4) -> Model | None:
    """Fit and calibrate from what ``sparse`` gives; None where a class is missing.  Every fifth row is held out for the calibration."""
    y = y.astype(float)
    held = np.arange(len(y)) % 5 == 4
    if len(y) < 20 or y[~held].min() == y[~held].max():
        return None
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in feats]
    n_cols = 2 << _BITS
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) * ~held  # classes weigh the same

    def score(x: np.ndarray) -> np.ndarray:
        return np.array([v @ x[i] for i, v in rows]) + x[-1]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = score(x)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        f = float((weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum() + l2 / 2 * (x[:-1] @ x[:-1]))
        d = weight * (p - y) / weight.sum()
        g = np.zeros(n_cols + 1)
        for (i, v), k in zip(rows, d):
            if k:
                g[i] += k * v  # a row's features are distinct
        g[:-1] += l2 * x[:-1]
        g[-1] = d.sum()
        return f, g

    x = _minimise(loss, np.zeros(n_cols + 1))
    z, t = score(x)[held], y[held]
    if t.min() == t.max():
        return Model(x[:-1], float(x[-1]), 1.0, 0.0)
    t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))

    def platt(ab: np.ndarray) -> tuple[float, np.ndarray]:
        s = ab[0] * z + ab[1]
        d = (1 / (1 + np.exp(-np.clip(s, -40, 40))) - t) / len(t)
        return float((np.logaddexp(0, s) - t * s).mean() + 1e-3 * (ab[0] - 1) ** 2), np.array([(d * z).sum() + 2e-3 * (ab[0] - 1), d.sum()])

    a, b = _minimise(platt, np.array([1.0, 0.0]))
    return Model(x[:-1], float(x[-1]), float(a), float(b))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN) -> Model | None:
    """Fit on at most ``max_train`` labelled rows, those whose key hashes lowest.

    Rows that share a key with a label each count under it, a key with several
    labels under each; labels without a row, and null keys or labels, are left out.
    Classes weigh the same in the fit; the calibration is by the rows as they
    are, so that probabilities are those of the labelled table.
    """
    named = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    pick = named.withColumn("r", F.xxhash64("k")).orderBy("r", "k", "y").limit(max_train)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(pick), "k").select("r", "y", "text")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in scan.super_batches(batches, "text", 4 << 20):
            f = sparse(t["text"])
            yield from pa.table({"r": t["r"], "y": t["y"], "i": pa.array([i for i, _ in f], pa.binary()), "v": pa.array([v for _, v in f], pa.binary())}).to_batches()

    table = rows.mapInArrow(go, "r long, y int, i binary, v binary").orderBy("r", "y", "i", "v").limit(max_train).toArrow()
    feats, y = [(a.as_buffer(), b.as_buffer()) for a, b in zip(table["i"], table["v"])], table["y"].to_numpy()
    model = fit(feats, y) if len(y) else None
    del feats, table
    scan.release()
    return model


def quality_rules(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, probability and kept.

    A row fails the base rules with fewer than 50 words or with more than half
    of its words in repeated three-word windows; it is kept when it passes them
    and the model's calibrated probability reaches ``threshold``.  Without a
    model (no labels, or of one class only) the base rules decide alone and the
    probability is null.

    A null or empty text has counts of 0 and fails; rows may repeat; an empty
    table gives an empty table.  Columns of ``docs`` that have one of
    the new names give way, all others pass through.  Texts are counted and
    scored whole.
    """
    slim_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in COUNTS and c not in ("base_failed", "probability", "kept")]
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)))
    at = f"c{own.index(text)}"
    out = T.StructType(list(plain.schema))
    for c in COUNTS:
        out = out.add(c, "long")
    out = out.add("base_failed", "boolean").add("probability", "double").add("kept", "boolean")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for table in scan.super_batches(batches, at, 4 << 20):
            buf, offsets = scan.text_bytes(table[at])
            c = base_counts(buf, offsets, np.asarray(table[at].is_valid()))
            failed = (c["n_words"] < MIN_WORDS) | (REPEAT_OF * c["n_repeat_words"] > REPEAT_OUT * c["n_words"])
            p = fitted.probability(buf, offsets) if fitted is not None else None
            kept = ~failed & (p >= threshold) if p is not None else ~failed
            for name in COUNTS:
                table = table.append_column(name, pa.array(c[name].astype(np.int64)))
            table = table.append_column("base_failed", pa.array(failed)).append_column("probability", pa.array(p) if p is not None else pa.nulls(len(kept), pa.float64()))
            yield from table.append_column("kept", pa.array(kept)).to_batches()

    return plain.mapInArrow(go, out).withColumnsRenamed({f"c{i}": c for i, c in enumerate(own)})
