"""Rolling order statistics: medians, quantiles, ranks and absolute deviations over the last rows.

Rows come sorted by instrument and date.  A block of them is put into a wavelet
matrix: the values' ranks, one bit a level, each level stably parted by its bit,
with running counts and sums of the rows whose bit is zero.  The k-th
smallest value of any run of rows, and how many are below a bound and their
sum, are then one step a level, for all rows of the block at once.  The cost
is rows times levels, whatever the window.

Blocks follow one another with the last rows of the block before in front, so
what a task holds is a block and a window, however long an instrument's history.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: rows worked on at once
BLOCK = 1 << 16


@dataclass(frozen=True)
class Ordered:
    """One statistic: ``op`` is Med, Quantile, Mad or Rank, over ``rows`` rows up to the current one."""

    op: str
    column: str
    rows: int
    q: float = 0.5


class Runs:
    """Answers about runs ``[low, high)`` of a sequence of numbers."""

    def __init__(self, values: np.ndarray) -> None:
        self.sorted, rank = np.unique(values, return_inverse=True)
        self.rank = rank.astype(np.int64)
        self.bits = max(1, int(len(self.sorted)).bit_length())
        self.zeros: list[np.ndarray] = []
        self.order: list[np.ndarray] = []
        place, seq = np.arange(len(values)), self.rank
        for k in range(self.bits - 1, -1, -1):
            zero = (seq >> k & 1) == 0
            self.zeros.append(np.append(0, np.cumsum(zero)))
            self.order.append(np.where(zero, place, -1))
            both = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
            seq, place = seq[both], place[both]

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest number of each run, k from 0."""
        found = np.zeros(len(low), np.int64)
        for level, zeros in enumerate(self.zeros):
            a, b = zeros[low], zeros[high]
            left = k < b - a
            low, high = np.where(left, a, zeros[-1] + low - a), np.where(left, b, zeros[-1] + high - b)
            k = np.where(left, k, k - (b - a))
            found += np.where(left, 0, 1 << (self.bits - 1 - level))
        return self.sorted[found]

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray, sums: list[list[np.ndarray]] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """(how many numbers of each run have a rank below the bound, their sums by the running ``sums``)."""
        count = np.zeros(len(low), np.int64)
        total = [np.zeros(len(low), s[0].dtype) for s in sums or []]
        for level, zeros in enumerate(self.zeros):
            one = bound >> (self.bits - 1 - level) & 1 == 1
            a, b = zeros[low], zeros[high]
            count += np.where(one, b - a, 0)
            for t, s in zip(total, sums or []):
                t += np.where(one, s[level][high] - s[level][low], 0).astype(t.dtype)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return count, total

    def running(self, values: np.ndarray) -> list[np.ndarray]:
        """Running sums, level by level, of the values whose bit is zero."""
        return [np.append(np.zeros(1, values.dtype), np.cumsum(np.where(o < 0, 0, values[o]).astype(values.dtype))) for o in self.order]


def _parts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(whole, rest, scale): values as whole numbers of 2^-scale, whose sums are exact, and what is left, which is tiny."""
    most = float(np.abs(values).max(initial=0.0)) * (len(values) + 1)
    scale = 61 - int(np.ceil(np.log2(most))) if most > 0 else 0
    whole = np.rint(np.ldexp(values, scale))
    return whole.astype(np.int64), values - np.ldexp(whole, -scale), scale


class _Column:
    """One column of a block: its present values, and the run of each row's window."""

    def __init__(self, column: np.ndarray, row: np.ndarray) -> None:
        self.there = ~np.isnan(column)
        self.upto = np.append(0, np.cumsum(self.there))
        self.row = row
        # deviations from the mean of an instrument's rows here: sums stay small
        group = np.cumsum(row == 1)[self.there]
        values = column[self.there]
        n = np.bincount(group, minlength=1)
        mean = np.bincount(group, weights=values, minlength=1) / np.maximum(n, 1)
        self.middle = mean[group]
        self.values = values
        self.runs = Runs(values)
        self.sums: tuple | None = None

    def windows(self, first: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(first, len(self.row))
        start = np.maximum(at - np.minimum(self.row[first:], rows) + 1, 0)
        return self.upto[start], self.upto[at + 1]

    def quantile(self, first: int, rows: int, q: float) -> np.ndarray:
        low, high = self.windows(first, rows)
        n = high - low
        at = q * np.maximum(n - 1, 0)
        k = np.floor(at).astype(np.int64)
        out = np.full(len(n), np.nan)
        some = n > 0
        low, high, k, at = low[some], high[some], k[some], at[some]
        a, b = self.runs.kth(low, high, k), self.runs.kth(low, high, np.minimum(k + 1, n[some] - 1))
        out[some] = np.where(a == b, a, (k + 1 - at) * a + (at - k) * b)
        return out

    def rank(self, first: int, rows: int) -> np.ndarray:
        low, high = self.windows(first, rows)
        out = np.full(len(low), np.nan)
        own = self.there[first:]
        low, high = low[own], high[own]
        rank = self.runs.rank[self.upto[first] :]
        less, _ = self.runs.below(low, high, rank)
        upto, _ = self.runs.below(low, high, rank + 1)
        out[own] = (less + (upto - less + 1) / 2.0) / (high - low)
        return out

    def deviation(self, first: int, rows: int) -> np.ndarray:
        if self.sums is None:
            whole, rest, scale = _parts(self.values - self.middle)
            run = lambda v: np.append(np.zeros(1, v.dtype), np.cumsum(v))
            self.sums = (run(whole), run(rest), [self.runs.running(whole), self.runs.running(rest)], scale)
        whole, rest, levels, scale = self.sums
        low, high = self.windows(first, rows)
        out = np.full(len(low), np.nan)
        some = high > low
        low, high = low[some], high[some]
        n = high - low
        value = lambda w, r: np.ldexp(w.astype(float), -scale) + r
        total = value(whole[high] - whole[low], rest[high] - rest[low])
        mean = total / n
        bound = np.searchsorted(self.runs.sorted, mean + self.middle[low], "left")
        count, (w, r) = self.runs.below(low, high, bound, levels)
        out[some] = np.maximum(total - 2 * value(w, r) + mean * (2 * count - n), 0.0) / n
        return out


def _block(columns: dict[str, np.ndarray], row: np.ndarray, first: int, specs: dict[str, Ordered]) -> dict[str, pa.Array]:
    known = {c: _Column(v, row) for c, v in columns.items()}
    out = {}
    for name, s in specs.items():
        c = known[s.column]
        v = c.rank(first, s.rows) if s.op == "Rank" else c.deviation(first, s.rows) if s.op == "Mad" else c.quantile(first, s.rows, s.q)
        out[name] = pa.array(v, pa.float64(), mask=np.isnan(v))
    return out


def rolling_order(df: DataFrame, specs: dict[str, Ordered], row: str) -> DataFrame:
    """``df`` with a column for each named statistic; ``row`` numbers the rows of an instrument from 1, by date.

    Rows of an instrument must lie in one partition, as they do behind a window
    that made ``row``.  Missing values are skipped, and NaN is one; a window
    without values gives NULL, and so does the rank of a missing value; ties
    take the mean of their ranks.
    """
    used = sorted({s.column for s in specs.values()})
    back = max(s.rows for s in specs.values()) - 1
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in specs)])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {c: np.zeros(0) for c in used}
        rows = np.zeros(0, np.int64)
        waiting: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            table = pa.Table.from_batches(waiting)
            waiting.clear()
            first = len(rows)
            rows = np.concatenate([rows, table[row].to_numpy()])
            if ((rows[1:] != 1) & (rows[1:] != rows[:-1] + 1)).any():
                raise ValueError("rows of an instrument aren't in order")
            held = {c: np.concatenate([held[c], table[c].cast(pa.float64()).to_numpy()]) for c in used}
            for name, column in _block(held, rows, first, specs).items():
                table = table.append_column(name, column)
            rows, held = rows[len(rows) - back :] if back < len(rows) else rows, {c: v[len(v) - back :] if back < len(v) else v for c, v in held.items()}
            yield from table.to_batches()

        n = 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                n += batch.num_rows
            if n >= BLOCK:
                yield from done()
                n = 0
        if waiting:
            yield from done()

    return df.sortWithinPartitions("instrument", "date").mapInArrow(go, schema)
