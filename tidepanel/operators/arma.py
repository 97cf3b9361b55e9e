"""Unit-root tests and ARMA models of many series at once, from lagged cross moments.

Each series is a key's values by date.  Lags are window columns; what a regression
needs are sums of products of its columns, which Spark adds up by key and (for
the starts that differ between orders) by the first rows' places.  The systems solved
are as small as the numbers of lags.

An ARMA model is fitted in two stages: innovations from a long autoregression,
then least squares on past values and past innovations; all orders come from the
same sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.functions.series import critical_values
from tidepanel.sources.files import written


def _dot(xs: list[Column], beta: Column) -> Column:
    return sum((x * beta[i] for i, x in enumerate(xs)), F.lit(0.0))


def _products(columns: list[str]) -> list[Column]:
    return [F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for i, a in enumerate(columns) for b in columns[: i + 1]]


def _filled(rows: int, columns: list[str], of: Callable[[str], np.ndarray]) -> np.ndarray:
    """The matrix of all products for each of ``rows`` keys; ``of`` tells a product's values by its name."""
    out = np.empty((rows, len(columns), len(columns)))
    for i, a in enumerate(columns):
        for j, b in enumerate(columns[: i + 1]):
            out[:, i, j] = out[:, j, i] = of(f"{a}*{b}")
    return out


def _least_squares(g: np.ndarray, y: int, xs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, sum of squares left, inverse) of column y on columns xs for each key, given all products."""
    inverse = np.linalg.pinv(g[:, xs][:, :, xs], hermitian=True)
    beta = (inverse @ g[:, xs, y][:, :, None])[:, :, 0]
    return beta, np.maximum(g[:, y, y] - (beta * g[:, xs, y]).sum(1), 0.0), inverse


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """(key, i, n, mean, y): places from 0, the series' length and mean, and values less the mean."""
    own = W.partitionBy(key)
    p = df.where("y is not null").select(key, "date", F.col("y").cast("double").alias("y"))
    p = p.select(key, (F.row_number().over(own.orderBy("date")) - 1).alias("i"), F.count("*").over(own).alias("n"), F.avg("y").over(own).alias("mean"), "y")
    return p.withColumn("y", F.col("y") - F.col("mean"))


def _lags(df: DataFrame, key: str, column: str, name: str, most: int) -> DataFrame:
    own = W.partitionBy(key).orderBy("i")
    return df.select("*", *(F.lag(column, k).over(own).alias(f"{name}{k}") for k in range(1, most + 1)))


def unit_roots(df: DataFrame, key: str, most_lags: int | None = None) -> DataFrame:
    """(key, n, t, lags, critical_5): augmented Dickey-Fuller t with a constant of each series (key, date, y), lags by BIC, and its 5 % critical value.

    Without ``most_lags`` a series of n values tries up to 12 (n / 100)^(1/4) lags, a third of
    its changes at most.  Missing values are left out; (key, date) is unique; a series
    of fewer than four values has no t.
    """
    p = _numbered(df, key)
    limit = F.floor(12 * F.pow(F.col("n") / 100, 0.25)).cast("int") if most_lags is None else F.lit(most_lags)
    p = p.withColumn("most", F.greatest(F.lit(0), F.least(limit, F.floor((F.col("n") - 1) / 3).cast("int"))))
    p = p.select("*", F.lag("y").over(W.partitionBy(key).orderBy("i")).alias("y1"), F.lit(1.0).alias("one"))
    p = p.withColumn("d", F.col("y") - F.col("y1")).withColumn("d0", F.col("d"))
    deepest = df.groupBy(key).agg(F.count("y").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    lags = max(0, min(int(12 * (deepest / 100) ** 0.25) if most_lags is None else most_lags, (deepest - 1) // 3))
    p = _lags(p, key, "d", "d", lags)
    columns = ["d0", "one", "y1", *(f"d{k}" for k in range(1, lags + 1))]
    # a change's place counts from 0, and lags that a series doesn't try are 0 to it
    used = [F.when(F.lit(int(c[1:] or 0) if c[0] == "d" else 0) <= F.col("most"), F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(c) for c in columns]
    rows = p.where(F.col("i") - 1 >= F.col("most")).select(key, "n", "most", *used)
    sums = rows.groupBy(key, "n", "most").agg(*_products(columns))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g, n, most = _filled(len(pdf), columns, lambda c: pdf[c].to_numpy(float)), pdf["n"].to_numpy(), pdf["most"].to_numpy()
            best, t, told = np.full(len(pdf), np.inf), np.zeros(len(pdf)), np.zeros(len(pdf), int)
            for k in range(most.max(initial=-1) + 1):  # all keys that try k lags at once
                own = np.flatnonzero(most >= k)
                xs, m = list(range(1, 3 + k)), g[own, 1, 1]
                beta, rss, inverse = _least_squares(g[own], 0, xs)
                bic = m * np.log(np.maximum(rss, 1e-300) / m) + len(xs) * np.log(m)
                spread = np.sqrt(inverse[:, 1, 1] * rss / np.maximum(m - len(xs), 1))
                ratio = np.divide(beta[:, 1], spread, out=np.zeros(len(own)), where=spread > 0)
                less = bic < best[own]
                best[own[less]], t[own[less]], told[own[less]] = bic[less], ratio[less], k
            enough = pdf["n"] > 3
            out = pd.DataFrame({key: pdf[key], "n": n, "t": t, "lags": told, "critical_5": critical_values(np.maximum(n - 1, 1))[0.05]}).astype({"lags": "Int32"})
            yield out.assign(**{c: out[c].where(enough) for c in ("t", "lags", "critical_5")})

    return sums.mapInPandas(solve, f"{key} {df.schema[key].dataType.simpleString()}, n long, t double, lags int, critical_5 double")


def arma_models(df: DataFrame, key: str, most_ar: int = 4, most_ma: int = 2) -> DataFrame:
    """(key, n, ar, ma, const, ar_coefs, ma_coefs, bic, forecast) of each series (key, date, y): the order of the lowest BIC, its coefficients, and the next value.

    The long autoregression has max(most_ar + most_ma + 2, sqrt(n)) lags, a third of n at most.
    Missing values are left out; (key, date) is unique; a series of fewer than
    3 (most_ar + most_ma + 2) values has no model: NULL but for n.
    """
    p = _numbered(df, key)
    deepest = df.groupBy(key).agg(F.count("y").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    least = most_ar + most_ma + 2
    far = min(max(least, int(deepest**0.5)), max(deepest // 3, least))
    own_far = F.least(F.greatest(F.lit(least), F.floor(F.sqrt("n"))), F.floor(F.col("n") / 3)).cast("int")
    p = _lags(p.withColumn("far", own_far).withColumn("y0", F.col("y")).withColumn("one", F.lit(1.0)), key, "y", "y", far)

    long = ["y0", "one", *(f"y{k}" for k in range(1, far + 1))]
    zero = [F.when(F.lit(k) <= F.col("far"), F.coalesce(f"y{k}", F.lit(0.0))).otherwise(0.0).alias(f"y{k}") for k in range(1, far + 1)]
    p = written(p.where(F.col("n") >= 3 * least).select(key, "i", "n", "mean", "far", "y0", "one", *zero), "lags")
    sums = p.where("i >= far").groupBy(key).agg(*_products(long))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            beta = _least_squares(_filled(len(pdf), long, lambda c: pdf[c].to_numpy(float)), 0, list(range(1, len(long))))[0]
            yield pd.DataFrame({key: pdf[key], "beta": list(beta)})

    kind = df.schema[key].dataType.simpleString()
    betas = sums.mapInPandas(first, f"{key} {kind}, beta array<double>")
    e = F.when(F.col("i") >= F.col("far"), F.col("y0") - _dot([F.col(c) for c in long[1:]], F.col("beta"))).otherwise(0.0)
    p = _lags(p.join(betas, key).select(key, "i", "n", "mean", "far", "y0", "one", *(f"y{k}" for k in range(1, most_ar + 1)), e.alias("e0")), key, "e0", "e", most_ma)
    columns = ["y0", "one", *(f"y{k}" for k in range(1, most_ar + 1)), *(f"e{k}" for k in range(1, most_ma + 1))]
    p = p.na.fill(0.0, [f"e{k}" for k in range(1, most_ma + 1)])
    # sums by the place up to which orders begin: suffixes give each order's rows; orders with innovations begin past far, which is more than most_ar
    place = F.when(F.col("i") > F.col("far"), F.least(F.col("i") - F.col("far"), F.lit(most_ma)) + most_ar).otherwise(F.least(F.col("i"), F.lit(most_ar))).cast("int")
    parts = p.groupBy(key, place.alias("place")).agg(*_products(columns))
    ends = p.where(F.col("i") >= F.col("n") - max(most_ma, 1)).groupBy(key).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("far").alias("far"), F.sort_array(F.collect_list(F.struct("i", F.array("y0", "e0", *columns[1:]).alias("x")))).alias("last"))  # the last one or two rows
    asked = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", F.array(*parts.columns[2:]).alias("sums")))).alias("parts")).join(ends, key)  # most_ar + most_ma + 1 parts at most
    names = parts.columns[2:]

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, rows = batch.column("parts"), batch.num_rows
            flat, begin = lists.flatten(), np.cumsum([0, *lists.value_lengths().to_pylist()])[:-1]
            places, sums = flat.field("place").to_numpy(), flat.field("sums").flatten().to_numpy().reshape(len(flat), len(names))
            last = batch.column("last").flatten().field("x").flatten().to_numpy().reshape(rows, -1, len(columns) + 1)  # y0, e0, then the regressors
            best, order, ahead, coefs = np.full(rows, np.inf), np.zeros((rows, 2), int), np.full(rows, np.nan), np.zeros((rows, 1 + most_ar + most_ma))
            for start in range(most_ar + most_ma + 1):
                total = np.add.reduceat(np.where((places >= start)[:, None], sums, 0.0), begin)
                g = _filled(rows, columns, lambda c: total[:, names.index(c)])
                m = g[:, 1, 1]
                for ar, ma in [(start, 0)] if start <= most_ar else [(k, start - most_ar) for k in range(most_ar + 1)]:
                    xs = [1, *range(2, 2 + ar), *range(2 + most_ar, 2 + most_ar + ma)]
                    beta, rss, _ = _least_squares(g, 0, xs)
                    bic = np.log(np.maximum(rss, 1e-300) / m) + len(xs) * np.log(m) / m
                    left = last[:, :, 0] - (last[:, :, 1:][:, :, xs] * beta[:, None, :]).sum(2)
                    known = np.column_stack([last[:, -1, 0], last[:, -1, 3 : 2 + ar]])[:, :ar] if ar else np.zeros((rows, 0))
                    value = beta[:, 0] + (beta[:, 1 : 1 + ar] * known).sum(1) + (beta[:, 1 + ar :] * left[:, ::-1][:, :ma]).sum(1)
                    less = (bic < best) | ((bic == best) & ((ar < order[:, 0]) | ((ar == order[:, 0]) & (ma < order[:, 1]))))
                    best[less], order[less], ahead[less] = bic[less], (ar, ma), value[less]
                    coefs[less, : len(xs)] = beta[less]
            mean = batch.column("mean").to_numpy()
            ars, mas = order[:, 0], order[:, 1]
            own = [c[1 : 1 + a] for c, a in zip(coefs, ars)]
            doubles = lambda x: pa.array(x, pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_pydict({
                key: batch.column(key), "n": batch.column("n"), "ar": pa.array(ars, pa.int32()), "ma": pa.array(mas, pa.int32()), "const": doubles(coefs[:, 0] + mean * (1 - np.array([c.sum() for c in own]))),
                "ar_coefs": pa.array(own, pa.list_(pa.float64())), "ma_coefs": pa.array([c[1 + a : 1 + a + b] for c, a, b in zip(coefs, ars, mas)], pa.list_(pa.float64())), "bic": doubles(best), "forecast": doubles(ahead + mean),
            })

    done = asked.mapInArrow(second, f"{key} {kind}, n long, ar int, ma int, const double, ar_coefs array<double>, ma_coefs array<double>, bic double, forecast double")
    every = df.groupBy(key).agg(F.count("y").alias("n"))
    return every.join(done.drop("n"), key, "left")


def next_levels(df: DataFrame, key: str, k: float = 3.0) -> DataFrame:
    """(key, level): each series' next value after bounding by its median deviation; its bounded mean where a unit root can't be ruled out or no model fits."""
    p = df.where("y is not null")
    mid = p.groupBy(key).agg(F.percentile("y", F.lit(0.5)).alias("mid"))
    p = p.join(mid, key)
    dev = p.groupBy(key).agg((1.4826 * F.percentile(F.abs(F.col("y") - F.col("mid")), F.lit(0.5))).alias("dev"))
    reach = k * F.col("dev")
    p = p.join(dev, key).select(key, "date", F.when(F.col("dev") > 0, F.greatest(F.least("y", F.col("mid") + reach), F.col("mid") - reach)).otherwise(F.col("y")).alias("y"))
    p = written(p, "bounded")
    told = p.groupBy(key).agg(F.avg("y").alias("mean")).join(unit_roots(p, key).select(key, "t", "critical_5"), key, "left").join(arma_models(p, key).select(key, "forecast"), key, "left")
    return told.select(key, F.when(F.col("t") <= F.col("critical_5"), F.coalesce("forecast", "mean")).otherwise(F.col("mean")).alias("level"))
