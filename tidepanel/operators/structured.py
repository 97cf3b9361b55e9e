"""Portfolios under a covariance of factor structure, V = X F X' + D.

No matrix of instruments by instruments is formed.  With F = L L' and Z = X L, V = Z Z' + D, and

* V^-1 b comes from Woodbury's identity: a K-by-K system whose entries are sums over instruments;
* the optimiser works on the dual: under given prices of the factors, of cash and
  of turnover each instrument's best holding has a closed form, so value, gradient and
  curvature of the dual are sums over instruments, and a Newton step is a
  system of K + 2 equations.

Sums are partial within Arrow batches and added up by Spark; what reaches the
driver are K-by-K figures for each portfolio.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.sources.files import written

#: Newton steps that are tried in one pass: the curvature's damping, in units of its mean, and lengths of the least damped one
DAMPING = (1e-12, 1e-9, 1e-6, 1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 1e2, 1e3, 1e4, 1e6)
LENGTHS = (0.5, 0.2, 0.05)
#: by how much specific variances fall from one stage to the next, and what a stage but the last is solved to
STAGE, ROUGHLY = 10.0, 1e-3


def rooted(cov: DataFrame) -> tuple[list, np.ndarray]:
    """(factors, L) of a factor covariance (i, j, v), F = L L'; an error where F has an eigenvalue below zero.  Factors are tens, so this is the driver's."""
    entries = cov.collect()
    names = sorted({r["i"] for r in entries})
    place = {n: k for k, n in enumerate(names)}
    f = np.zeros((len(names), len(names)))
    for r in entries:
        f[place[r["i"]], place[r["j"]]] = r["v"]
    vals, vecs = np.linalg.eigh((f + f.T) / 2)
    if len(vals) and vals[0] < -1e-12 * max(1.0, vals[-1]):
        raise ValueError(f"the smallest eigenvalue is {vals[0]:.2e}")
    return names, vecs * np.sqrt(np.maximum(vals, 0))


def with_exposures(book: DataFrame, exposure: DataFrame, names: list) -> DataFrame:
    """``book`` with ``xs``, an instrument's exposures (instrument, factor, x) in the order of ``names``; a missing one is 0, an instrument without any is left out."""
    x = exposure.where(F.col("factor").isin(names)).groupBy("instrument").agg(F.map_from_entries(F.collect_list(F.struct("factor", "x"))).alias("m"))
    xs = F.array(*(F.coalesce(F.col("m")[n], F.lit(0.0)) for n in names))
    return book.join(x.select("instrument", xs.alias("xs")), "instrument")


def _summed(rows: DataFrame, by: str, parts: Callable[[pd.DataFrame, np.ndarray], dict[tuple, np.ndarray]], root: np.ndarray) -> dict[tuple, np.ndarray]:
    """Sums over all rows of the arrays that ``parts`` gives for the rows of one portfolio in a batch, by portfolio and key."""
    kind = rows.schema[by].dataType.simpleString()

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, own in pdf.groupby(by, dropna=False):
                told = parts(own, np.stack(own["xs"].to_numpy()) @ root if len(root) else np.zeros((len(own), 0)))
                if told:
                    yield pd.DataFrame({by: [name] * len(told), "point": [k for k in told], "sums": [v.tolist() for v in told.values()]})

    told = rows.mapInPandas(go, f"{by} {kind}, point int, sums array<double>").select(by, "point", F.posexplode("sums").alias("pos", "v"))
    out: dict[tuple, dict[int, float]] = {}
    for r in told.groupBy(by, "point", "pos").agg(F.sum("v").alias("v")).collect():  # K-by-K figures of each portfolio
        out.setdefault((r[by], r["point"]), {})[r["pos"]] = r["v"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def solved(book: DataFrame, exposure: DataFrame, cov: DataFrame, by: str, rhs: str) -> DataFrame:
    """(by, instrument, rhs, x): V x = rhs for each portfolio of ``book`` (by, instrument, d, rhs); d must be above zero."""
    names, root = rooted(cov)
    k = len(names)
    rows = written(with_exposures(book.select(by, "instrument", "d", F.col(rhs).cast("double").alias("rhs")), exposure, names), "book")

    def parts(own: pd.DataFrame, z: np.ndarray) -> dict[int, np.ndarray]:
        w = z / own["d"].to_numpy()[:, None]
        return {0: np.concatenate([(w.T @ z).ravel(), w.T @ own["rhs"].to_numpy()])}

    theta = {}
    for (name, _), s in _summed(rows, by, parts, root).items():
        theta[name] = root @ np.linalg.solve(np.eye(k) + s[: k * k].reshape(k, k), s[k * k :])
    table = book.sparkSession.createDataFrame([(n, t.tolist()) for n, t in theta.items()], f"name {book.schema[by].dataType.simpleString()}, theta array<double>")
    through = F.aggregate(F.zip_with("xs", "theta", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    told = rows.join(F.broadcast(table), F.col(by).eqNullSafe(F.col("name")))  # a row for each portfolio
    return told.select(by, "instrument", "rhs", ((F.col("rhs") - through) / F.col("d")).alias("x"))


def _invested(x: DataFrame, by: str) -> DataFrame:
    total = x.groupBy(by).agg(F.sum("x").alias("total"))
    return x.join(total, by).select(by, "instrument", F.try_divide("x", "total").alias("h"))


def minimum_variance(book: DataFrame, exposure: DataFrame, cov: DataFrame, by: str) -> DataFrame:
    """(by, instrument, h): fully invested weights of least variance of ``book`` (by, instrument, d)."""
    return _invested(solved(book.withColumn("one", F.lit(1.0)), exposure, cov, by, "one"), by)


def tangency(book: DataFrame, exposure: DataFrame, cov: DataFrame, by: str, excess: str) -> DataFrame:
    """(by, instrument, h): fully invested weights of the highest ratio of ``excess`` return to risk; NULL where the excess returns' weights sum to zero."""
    return _invested(solved(book, exposure, cov, by, excess), by)


def _best(z: np.ndarray, price: np.ndarray, own: dict[str, np.ndarray], risk: float, costs: tuple[float, float], cap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(holdings, traded, which of them move with prices) under prices of factors, cash and turnover."""
    slope = own["alpha"] - z @ price[:-2] - price[-2]
    buy, sell = costs[0] + price[-1], costs[1] + price[-1]
    width = 2 * risk * own["d"]
    up, down = (slope - buy) / width, (slope + sell) / width
    h = np.where(up > own["current"], up, np.where(down < own["current"], down, own["current"]))
    held = (up <= own["current"]) & (down >= own["current"])
    inside = (h > -own["benchmark"]) & (h < cap)
    h = np.clip(h, -own["benchmark"], cap)
    return h, h - own["current"], inside & ~held


def _dual(book: DataFrame, exposure: DataFrame, cov: DataFrame, by: str, risk_aversion: float, costs: tuple[float, float], cap: float, turnover: float | None, cash: bool, rounds: int, tolerance: float) -> DataFrame:
    """(by, instrument, h, value): each portfolio's best holdings, and alpha - 2 risk_aversion V h there; with ``cash``, h sums to zero, with ``turnover``, b + s stays within it.

    A name moves with the prices only while they are within 2 risk_aversion d times its room of its alpha.
    Where alphas are wider apart than that, the first stages multiply d so that names move all
    over that range, and each later one, a tenth as wide, begins at the prices of the one before; the last has d itself.
    """
    buy, sell = costs
    names, root = rooted(cov)
    k = len(names)
    live = np.array([True] * k + [cash, turnover is not None])
    room = turnover or 0.0
    rows = written(with_exposures(book.select(by, "instrument", "alpha", "d", "current", "benchmark"), exposure, names), "book")
    columns = ("alpha", "d", "current", "benchmark")

    def extent(own: pd.DataFrame, z: np.ndarray) -> dict[int, np.ndarray]:
        return {0: (z.T @ z).ravel()}

    sizes = _summed(rows, by, extent, root)
    least = {n: max(1e-6, 1e-8 * float(np.linalg.eigvalsh(s.reshape(k, k))[-1])) if k else 1e-6 for (n, _), s in sizes.items()}
    ridge = lambda d, name: np.where(d < least[name], d + least[name], d)

    room_most = F.lit(float(cap)) + F.max("benchmark")
    reach = rows.groupBy(by).agg((F.max("alpha") - F.min("alpha")).alias("span"), F.avg("d").alias("d"), room_most.alias("room")).collect()  # a row for each portfolio
    soft = {r[by]: max(1.0, r["span"] / (2 * risk_aversion * max(r["d"], least[r[by]]) * r["room"])) if r["room"] > 0 else 1.0 for r in reach}

    def at(points: dict[object, list[np.ndarray]]) -> dict[tuple, np.ndarray]:
        """Value, gradient and curvature of the dual at each point."""

        def parts(own: pd.DataFrame, z: np.ndarray) -> dict[int, np.ndarray]:
            v = {c: own[c].to_numpy(float) for c in columns}
            name = own[by].iloc[0]
            if name not in points:
                return {}
            v["d"] = ridge(v["d"], name) * soft[name]
            out = {}
            for i, price in enumerate(points[name]):
                h, t, moves = _best(z, price, v, risk_aversion, costs, cap)
                cost = (buy + price[-1]) * np.maximum(t, 0) + (sell + price[-1]) * np.maximum(-t, 0)
                value = (risk_aversion * v["d"] * h * h - v["alpha"] * h + cost + h * (z @ price[:-2] + price[-2])).sum()
                u = np.column_stack([z, np.ones(len(h)), np.sign(t)])[moves]
                curve = u.T @ (u / (2 * risk_aversion * v["d"][moves])[:, None])
                out[i] = np.concatenate([[value], z.T @ h, [h.sum(), np.abs(t).sum()], curve.ravel()])
            return out

        told = {}
        for (name, i), s in _summed(rows, by, parts, root).items():
            price = points[name][i]
            s[0] -= price[:-2] @ price[:-2] / (4 * risk_aversion) + price[-1] * room
            s[1 : k + 1] -= price[:-2] / (2 * risk_aversion)
            s[k + 2] -= room
            curve = s[k + 3 :].reshape(k + 2, k + 2)
            curve[range(k), range(k)] += 1 / (2 * risk_aversion)
            told[name, i] = s
        return told

    def binding(price: np.ndarray, s: np.ndarray) -> np.ndarray:
        out = live.copy()
        out[-1] &= price[-1] > 0 or s[k + 2] > 0
        return out

    def off(price: np.ndarray, s: np.ndarray) -> float:
        """The largest condition not met: factors, cash, and turnover where it binds or is over."""
        return float(np.abs(s[1 : k + 3][binding(price, s)]).max(initial=0.0))

    start = {n: np.zeros(k + 2) for n, _ in sizes}
    now = {n: (p, s) for (n, _), s in at({n: [p] for n, p in start.items()}).items() for p in [start[n]]}
    open_, used = set(now), dict.fromkeys(now, 0)
    while open_:
        tries, next_ = {}, []
        for n in sorted(open_, key=str):
            price, s = now[n]
            if off(price, s) < (tolerance if soft[n] == 1.0 else ROUGHLY):
                next_.append(n)
                continue
            if used[n] == rounds:
                raise ValueError(f"not solved in {rounds} steps, as where limits can't be met: {n}")
            g, curve = s[1 : k + 3].copy(), s[k + 3 :].reshape(k + 2, k + 2)
            free = binding(price, s)
            part, size = curve[np.ix_(free, free)], np.trace(curve[np.ix_(free, free)]) / free.sum() or 1.0
            steps = np.zeros((len(DAMPING), k + 2))
            steps[:, free] = [np.linalg.solve(part + a * size * np.eye(free.sum()), g[free]) for a in DAMPING]
            tries[n] = [price + x for x in (*steps, *(a * steps[0] for a in LENGTHS))]
            for p in tries[n]:
                p[-1] = max(p[-1], 0.0)
        told = at(tries) if tries else {}
        for n, points in tries.items():
            used[n] += 1
            slack = 1e-14 * (1 + abs(now[n][1][0]))
            most = max(told[n, i][0] for i in range(len(points)))
            best = min((i for i in range(len(points)) if told[n, i][0] >= most - slack), key=lambda i: off(points[i], told[n, i]))
            if most > now[n][1][0] + slack or off(points[best], told[n, best]) < off(*now[n]):
                now[n] = points[best], told[n, best]
            elif soft[n] > 1.0 or off(*now[n]) < 1e-6:  # the optimum, as far as doubles tell
                next_.append(n)
            else:
                raise ValueError(f"the limits of portfolio {n} can't be met")
        done = {n for n in next_ if soft[n] == 1.0}
        open_ -= done
        again = [n for n in next_ if n not in done]
        for n in again:
            soft[n], used[n] = max(1.0, soft[n] / STAGE), 0
        if again:
            now |= {n: (now[n][0], s) for (n, _), s in at({n: [now[n][0]] for n in again}).items()}
    prices = {n: p for n, (p, _) in now.items()}

    def holdings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, own in pdf.groupby(by, dropna=False):
                v = {c: own[c].to_numpy(float) for c in columns}
                v["d"] = ridge(v["d"], name)
                z = np.stack(own["xs"].to_numpy()) @ root if k else np.zeros((len(own), 0))
                h = _best(z, prices[name], v, risk_aversion, costs, cap)[0]
                yield pd.DataFrame({by: own[by], "instrument": own["instrument"], "h": h, "value": v["alpha"] - z @ prices[name][:-2] - 2 * risk_aversion * v["d"] * h})

    kinds = {c: book.schema[c].dataType.simpleString() for c in (by, "instrument")}
    return rows.mapInPandas(holdings, f"{by} {kinds[by]}, instrument {kinds['instrument']}, h double, value double")


def optimised(book: DataFrame, exposure: DataFrame, cov: DataFrame, by: str, risk_aversion: float = 5.0, buy: float = 0.001, sell: float = 0.002, cap: float = 0.05, turnover: float = 0.5, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """(by, instrument, h): argmin risk_aversion h'Vh - alpha'h + buy b + sell s over active weights h = current + b - s of each portfolio.

    h sums to zero, lies between -benchmark and ``cap``, and b + s stays within
    ``turnover``.  ``book`` is (by, instrument, alpha, d, current, benchmark), without
    missing values.  Specific variances ``d`` under 1e-6, or under 1e-8 of the
    largest factor's part of V, get a ridge, as bounds of V's eigenvalues (its own would need
    V); an eigenvalue of the factors' covariance below zero is an error, and so
    is a portfolio whose limits can't be met or that isn't solved in ``rounds`` steps of a stage (see ``_dual``).
    """
    return _dual(book, exposure, cov, by, risk_aversion, (buy, sell), cap, turnover, True, rounds, tolerance).drop("value")


def dead_band(book: DataFrame, exposure: DataFrame, cov: DataFrame, by: str, risk_aversion: float = 5.0, buy: float = 0.001, sell: float = 0.002, cap: float = math.inf, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """(by, instrument, h, value, in_band): active weights where no name's marginal value pays for a trade.

    ``value`` is alpha - 2 risk_aversion V h.  A name whose value at its present weight lies in
    [-sell, buy] isn't traded; others move until their value reaches the band's edge, or
    to -benchmark or ``cap``, where value may stay outside (``in_band`` false).  That
    is where sweeps over single names end up in whatever order they go, as the
    problem is convex; here it is found for all names at once through the factors'
    prices.  ``book`` and the ridge are as in ``optimised``; there is no cash or turnover limit.
    """
    h = _dual(book, exposure, cov, by, risk_aversion, (buy, sell), cap, None, False, rounds, tolerance)
    return h.withColumn("in_band", F.col("value").between(-sell - 1e-7, buy + 1e-7))
