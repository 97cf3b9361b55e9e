"""Correlations of many columns at once, each pair over the rows that have both.

With X the columns (missing as 0) and M their masks, counts, sums, squares and
products of all pairs are M'M, X'M, (X^2)'M and X'X.  Tasks add them up batch by
batch for tiles of columns, and partial tiles are merged in two levels, so neither
the number of rows nor that of columns is held anywhere but in tiles.

Each task takes values relative to its own first means; merging moves one
partial's sums to the other's, so large offsets lose no digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: columns to a tile
TILE = 128
#: partial tiles are merged to so many for each tile, then to fewer, then to one
FANS = (1024, 32)
_PARTS = ("n", "sa", "sb", "qa", "qb", "p")
_SCHEMA = "ta int, tb int, part int, " + ", ".join(f"{c} binary" for c in ("ma", "mb", *_PARTS))


def _moved(t: dict[str, np.ndarray], ma: np.ndarray, mb: np.ndarray) -> dict[str, np.ndarray]:
    """A tile's sums as they are for values relative to other means; rows of a tile are columns a."""
    da, db, n = (t["ma"] - ma)[:, None], (t["mb"] - mb)[None, :], t["n"]
    return {
        "ma": ma, "mb": mb, "n": n, "sa": t["sa"] + da * n, "sb": t["sb"] + db * n, "qa": t["qa"] + 2 * da * t["sa"] + da * da * n,
        "qb": t["qb"] + 2 * db * t["sb"] + db * db * n, "p": t["p"] + da * t["sb"] + db * t["sa"] + da * db * n,
    }


def _row(ta: int, tb: int, part: int, t: dict[str, np.ndarray]) -> pa.RecordBatch:
    cols = {"ta": pa.array([ta], pa.int32()), "tb": pa.array([tb], pa.int32()), "part": pa.array([part], pa.int32())}
    return pa.RecordBatch.from_pydict(cols | {c: pa.array([np.ascontiguousarray(t[c]).tobytes()], pa.binary()) for c in ("ma", "mb", *_PARTS)})


def _tile(row: dict) -> dict[str, np.ndarray]:
    ma, mb = np.frombuffer(row["ma"]), np.frombuffer(row["mb"])
    return {"ma": ma, "mb": mb} | {c: np.frombuffer(row[c]).reshape(len(ma), len(mb)) for c in _PARTS}


def _merged(batches: Iterator[pa.RecordBatch]) -> tuple[int, int, int, dict[str, np.ndarray]]:
    """(tile of a, tile of b, part, sums) of all rows of a group, which share the first three."""
    total, ta, tb, part = None, 0, 0, 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ta, tb, part, t = row["ta"], row["tb"], row["part"], _tile(row)
            if total is None:
                total = {c: v.copy() for c, v in t.items()}
            else:
                moved = _moved(t, total["ma"], total["mb"])
                for c in _PARTS:
                    total[c] += moved[c]
    return ta, tb, part, total


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, corr) for each pair of places a > b in ``columns``: rows that have both, and their correlation.

    The correlation is NULL where fewer than two rows have both or one side is constant
    over them (product of deviations up to 1e-12).  NaN is missing; infinities are too.
    """
    k = len(columns)
    tiles = [range(i, min(i + TILE, k)) for i in range(0, k, TILE)]
    pairs = [(a, b) for a in range(len(tiles)) for b in range(a + 1)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], dict[str, np.ndarray]] = {}
        middle = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in range(k)], 1)
            mask = np.isfinite(x)
            if middle is None:
                x[~mask] = 0.0
                middle = x.sum(0) / np.maximum(mask.sum(0), 1)
            x = np.where(mask, x - middle, 0.0)
            m, x2 = mask.astype(float), x * x
            for a, b in pairs:
                i, j = slice(tiles[a].start, tiles[a].stop), slice(tiles[b].start, tiles[b].stop)
                got = {"n": m[:, i].T @ m[:, j], "sa": x[:, i].T @ m[:, j], "sb": m[:, i].T @ x[:, j], "qa": x2[:, i].T @ m[:, j], "qb": m[:, i].T @ x2[:, j], "p": x[:, i].T @ x[:, j]}
                if (a, b) in held:
                    for c in _PARTS:
                        held[a, b][c] += got[c]
                else:
                    held[a, b] = {"ma": middle[i], "mb": middle[j]} | got
        for (a, b), t in held.items():
            yield _row(a, b, TaskContext.get().partitionId(), t)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ta, tb, part, t = _merged(batches)
        yield _row(ta, tb, part, t)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ta, tb, _, t = _merged(batches)
        n = t["n"]
        with np.errstate(all="ignore"):
            va, vb = (t["qa"] - t["sa"] ** 2 / n) / (n - 1), (t["qb"] - t["sb"] ** 2 / n) / (n - 1)
            spread = np.sqrt(np.maximum(va, 0) * np.maximum(vb, 0))
            corr = np.where((n > 1) & (spread > 1e-12), (t["p"] - t["sa"] * t["sb"] / n) / (n - 1) / spread, np.nan)
        a, b = np.meshgrid(np.array(tiles[ta]), np.array(tiles[tb]), indexing="ij")
        low = a > b
        c = corr[low]
        yield pa.RecordBatch.from_pydict({"a": pa.array(a[low], pa.int32()), "b": pa.array(b[low], pa.int32()), "n": pa.array(n[low].astype(np.int64)), "corr": pa.array(c, mask=np.isnan(c))})

    part = df.select(*columns).mapInArrow(sums, _SCHEMA)
    for fan in FANS:
        part = part.withColumn("part", F.col("part") % fan).groupBy("ta", "tb", "part").applyInArrow(merge, _SCHEMA)
    return part.groupBy("ta", "tb").applyInArrow(finish, "a int, b int, n long, corr double")
