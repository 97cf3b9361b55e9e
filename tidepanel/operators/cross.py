"""Cross-sectional operators: bounds, scores, neutralisation, ranks and bins."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: rows of whole groups that are dealt to one task
TASK_ROWS = 250_000


def _group(by: list[str]) -> W:
    return W.partitionBy(*by) if by else W.partitionBy(F.lit(1))


def dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` dealt by range of ``by``: a task has whole groups of some ``TASK_ROWS`` rows in all, or one larger group.

    Windows and aggregates by ``by`` then move nothing more.  Hashed groups are put together into as few tasks
    as there are cores, which grow with the data.  ``df`` is read three times, so it should be written.
    """
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(max(session, df.count() // TASK_ROWS + 1), *by)


def winsorize(df: DataFrame, column: str, by: list[str], method: str = "std", k: float = 3.0, lower: float = 0.01, upper: float = 0.99, inclusive: bool = True) -> DataFrame:
    """``df`` with ``column`` bounded per group: mean and deviation, quantiles, or median and MAD (x 1.4826).

    Values outside are set to the bound, or to NULL where not ``inclusive``.
    Bounds are aggregates with partial combine, joined back on the group; those of "mad" are windows,
    as medians don't combine: each group's values are held once, one group at a time.  Groups
    without a key are not bounded.
    """
    x = F.col(column)
    if method == "mad":
        mid = df.withColumn("m__", F.median(x).over(_group(by)))
        mid = mid.withColumn("d__", 1.4826 * F.median(F.abs(x - F.col("m__"))).over(_group(by)))
        keyed = reduce(and_, (F.col(c).isNotNull() for c in by), F.lit(True))
        out = mid.withColumn("lo__", F.when(keyed, F.col("m__") - k * F.col("d__"))).withColumn("hi__", F.col("m__") + k * F.col("d__"))
        return out.withColumn(column, _bounded(x, inclusive)).select(*df.columns)
    if method == "std":
        stats = df.groupBy(*by).agg((F.avg(x) - k * F.stddev_samp(x)).alias("lo__"), (F.avg(x) + k * F.stddev_samp(x)).alias("hi__"))
    elif method == "quantile":
        q = df.groupBy(*by).agg(F.percentile(x, F.array(F.lit(lower), F.lit(upper))).alias("q__"))
        stats = q.select(*by, F.col("q__")[0].alias("lo__"), F.col("q__")[1].alias("hi__"))
    else:
        raise ValueError(method)
    return df.join(stats, by, "left").withColumn(column, _bounded(x, inclusive)).select(*df.columns)


def _bounded(x: Column, inclusive: bool) -> Column:
    """``x`` between lo__ and hi__, where these are known."""
    lo, hi = F.col("lo__"), F.col("hi__")
    return F.when(lo.isNull() | x.isNull(), x).otherwise(F.least(F.greatest(x, lo), hi)) if inclusive else F.when(lo.isNull() | x.between(lo, hi), x)


def fitted(df: DataFrame, columns: list[str], train: Column, method: str = "std", k: float = 3.0) -> DataFrame:
    """``df`` with ``columns`` treated by figures of the rows that ``train`` holds for.

    "std": bounded at mean and ``k`` deviations.  "zscore": less the mean, over the deviation.
    "robust": less the median, over 1.4826 times the median deviation, bounded at ``k``.
    The figures of all columns are one or two one-row aggregates.
    """
    base = df.where(train)
    if method == "robust":
        mid = base.agg(*(F.median(c).alias(f"m|{c}") for c in columns)).first()
        wide = base.agg(*((1.4826 * F.median(F.abs(F.col(c) - F.lit(mid[f"m|{c}"])))).alias(f"s|{c}") for c in columns)).first()
        got = {c: (mid[f"m|{c}"], wide[f"s|{c}"]) for c in columns}
    else:
        row = base.agg(*(f(c).alias(f"{n}|{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
        got = {c: (row[f"m|{c}"], row[f"s|{c}"]) for c in columns}

    def treat(c: str) -> Column:
        m, s = got[c]
        if m is None or s is None:
            return F.col(c)
        bound = lambda x, lo, hi: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
        if method == "std":
            return bound(F.col(c), m - k * s, m + k * s)
        z = F.try_divide(F.col(c) - F.lit(m), F.lit(s))
        return z if method == "zscore" else bound(z, -k, k)

    return df.select(*(treat(c).alias(c) if c in columns else F.col(c) for c in df.columns))


def finite_by_mean(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """``df`` with infinities of ``columns`` replaced by the mean of the group's finite values."""
    bad = lambda c: F.abs(F.col(c)) == float("inf")
    mean = lambda c: F.avg(F.when(~bad(c), F.col(c))).over(_group(by))
    return df.select(*(F.when(bad(c), mean(c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def zscore(column: str, by: list[str]) -> Column:
    """(x - mean) / sample deviation within the group; NULL where that is zero."""
    w = _group(by)
    return F.try_divide(F.col(column) - F.avg(column).over(w), F.stddev_samp(column).over(w))


def minmax(column: str, by: list[str]) -> Column:
    w = _group(by)
    return F.try_divide(F.col(column) - F.min(column).over(w), F.max(column).over(w) - F.min(column).over(w))


def _demeaned(y: str, x: str, group: str, by: list[str]) -> tuple[Column, Column]:
    """``y`` and ``x`` less their means per ``by`` and ``group`` over rows that have both.

    By Frisch-Waugh-Lovell both are taken less their group means, and one slope
    per ``by`` is left: windows only, no regression per date.
    """
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    cell = W.partitionBy(*by, group)
    ym = F.when(both, F.col(y)) - F.avg(F.when(both, F.col(y))).over(cell)
    xm = F.when(both, F.col(x)) - F.avg(F.when(both, F.col(x))).over(cell)
    return ym, xm


def neutralized(df: DataFrame, y: str, x: str, group: str, by: list[str], name: str) -> DataFrame:
    """``df`` with the residual of ``y`` on intercept, ``group`` dummies and ``x`` as ``name``; a missing group counts as the first in order."""
    base = W.partitionBy(*by)
    work = df.withColumn("g__", F.coalesce(F.col(group), F.min(group).over(base)))
    ym, xm = _demeaned(y, x, "g__", by)
    work = work.withColumn("ym__", ym).withColumn("xm__", xm)
    slope = F.coalesce(F.try_divide(F.sum(F.col("ym__") * F.col("xm__")).over(base), F.sum(F.col("xm__") * F.col("xm__")).over(base)), F.lit(0.0))
    return work.withColumn(name, F.col("ym__") - slope * F.col("xm__")).select(*df.columns, name)


def average_rank(column: str, by: list[str]) -> Column:
    """Rank from 1 within the group, ties sharing their mean."""
    w = W.partitionBy(*by).orderBy(column)
    return F.when(F.col(column).isNotNull(), F.rank().over(w) - F.count(F.when(F.col(column).isNull(), 1)).over(W.partitionBy(*by)) + (F.count(column).over(W.partitionBy(*by, column)) - 1) / 2)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of complete pairs as an aggregate; NULL where one side is constant."""
    u, v = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_samp(u) * F.stddev_samp(v)
    return F.when(spread > 1e-12, F.try_divide(F.covar_samp(u, v), spread))


def information_coefficients(df: DataFrame, factor: str, ret: str, by: list[str], spread: bool = False) -> DataFrame:
    """(by, n, ic, ric): Pearson and rank correlation of complete pairs.

    With ``spread`` groups are dealt over the session's shuffle partitions by range, so that a
    task has a few of them at most and small partitions aren't put together; ``df`` is read twice
    for it, so it should be written.
    """
    p = df.where(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    if spread:
        p = p.select(*by, factor, ret).repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    # no value is missing here, so no group is held to count those, and each column takes one sort
    rank = lambda c: F.rank().over(W.partitionBy(*by).orderBy(c)) + (F.count("*").over(W.partitionBy(*by, c)) - 1) / 2
    p = p.select(*by, F.col(factor).alias("f"), F.col(ret).alias("r")).withColumn("fr", rank("f")).withColumn("rr", rank("r"))
    return p.groupBy(*by).agg(F.count("*").alias("n"), safe_corr(F.col("f"), F.col("r")).alias("ic"), safe_corr(F.col("fr"), F.col("rr")).alias("ric"))


def quantile_bins(df: DataFrame, column: str, n: int, by: list[str], name: str = "bin") -> DataFrame:
    """``df`` with equal-frequency bins from 0, edges that repeat being dropped; NULL where only one edge is left."""
    steps = F.array(*(F.lit(i / n) for i in range(n + 1)))
    edges = df.groupBy(*by).agg(F.array_distinct(F.percentile(column, steps)).alias("edges__"))
    inner = F.slice("edges__", 2, F.greatest(F.size("edges__") - 2, F.lit(0)))
    bins = F.size(F.filter(inner, lambda e: e < F.col(column)))
    return df.join(edges, by).withColumn(name, F.when((F.size("edges__") > 1) & F.col(column).isNotNull(), bins)).drop("edges__")


def weighted_regression(y: np.ndarray, x: np.ndarray, w: np.ndarray, a: np.ndarray | None = None) -> np.ndarray:
    """Least squares with weights ``w`` of one small cross-section, under ``a @ beta = 0`` for any linear constraint; the industry constraint over many dates is exposure.factor_returns."""
    g = x.T @ (x * w[:, None])
    b = x.T @ (w * y)
    if a is None:
        return np.linalg.pinv(g) @ b
    m = np.atleast_2d(a)
    kkt = np.block([[2 * g, m.T], [m, np.zeros((len(m), len(m)))]])
    return (np.linalg.pinv(kkt) @ np.concatenate([2 * b, np.zeros(len(m))]))[: x.shape[1]]
