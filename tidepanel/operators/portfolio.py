"""Alpha blending, neutral alphas, optimisation and trade lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def scaled_alpha(panel: DataFrame, signal: str, omega: str, ic: float, case: int = 1) -> DataFrame:
    """``panel`` with alpha = omega * ic * z (case 1) or ic * z (case 2), z being the signal's score per date."""
    from tidepanel.operators.cross import zscore

    z = zscore(signal, ["date"])
    return panel.withColumn("alpha", (F.col(omega) * ic * z) if case == 1 else ic * z)


def benchmark_neutral(alpha: DataFrame) -> DataFrame:
    """(.., alpha_n): alpha - beta * sum(b * alpha) per date, from columns alpha, beta and b."""
    tilt = F.sum(F.col("b") * F.col("alpha")).over(W.partitionBy("date"))
    return alpha.withColumn("alpha_n", F.col("alpha") - F.col("beta") * tilt)


def factor_neutral(alpha: np.ndarray, x: np.ndarray, d: np.ndarray, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(residual alpha, factor alpha) of the generalised least squares projection on exposures."""
    g = x.T @ (x / d[:, None]) + ridge * np.eye(x.shape[1])
    f = np.linalg.solve(g, x.T @ (alpha / d))
    return alpha - x @ f, f


def orthogonal_blend(signals: DataFrame, names: list[str], residual: str) -> DataFrame:
    """(instrument, date, alpha): signals whitened by the Cholesky factor of their covariance, weighted by each one's correlation with the residual ahead.

    The covariance and the weights are aggregates over all rows; only the
    K-by-K factor is worked out on the driver, and the blend is one projection.
    """
    full = signals.na.drop("any", subset=names)
    aggs = [F.covar_samp(a, b).alias(f"{a}|{b}") for i, a in enumerate(names) for b in names[: i + 1]] + [F.avg(a).alias(a) for a in names]
    row = full.agg(*aggs).first()
    cov = np.array([[row[f"{a}|{b}"] if f"{a}|{b}" in row.__fields__ else row[f"{b}|{a}"] for b in names] for a in names], float)
    jitter = 1e-10
    while True:
        try:
            inv = np.linalg.inv(np.linalg.cholesky(cov + jitter * np.eye(len(names))))
            break
        except np.linalg.LinAlgError:
            jitter *= 100
    centred = [F.col(a) - F.lit(float(row[a])) for a in names]
    ys: list[Column] = [sum((F.lit(float(inv[k, j])) * centred[j] for j in range(k + 1)), F.lit(0.0)) for k in range(len(names))]
    white = full.select("instrument", "date", residual, *(y.alias(f"y{k}") for k, y in enumerate(ys)))
    from tidepanel.operators.cross import safe_corr

    gamma = white.agg(*(safe_corr(F.col(f"y{k}"), F.col(residual)).alias(f"g{k}") for k in range(len(names)))).first()
    return white.select("instrument", "date", sum((F.lit(float(gamma[f"g{k}"] or 0.0)) * F.col(f"y{k}") for k in range(len(names))), F.lit(0.0)).alias("alpha"))


def optimise(alpha: np.ndarray, v: np.ndarray, cap: np.ndarray, risk_aversion: float, rounds: int = 4000) -> np.ndarray:
    """argmax a'h - risk_aversion h'Vh with weights of sum one in [0, cap], by accelerated projected gradients."""
    n = len(alpha)
    step = 1 / max(2 * risk_aversion * float(np.linalg.eigvalsh(v)[-1]), 1e-12)

    def project(h: np.ndarray) -> np.ndarray:
        lo, hi = (h - cap).min() - 1, h.max() + 1
        for _ in range(100):
            mid = (lo + hi) / 2
            if np.clip(h - mid, 0, cap).sum() > 1:
                lo = mid
            else:
                hi = mid
        return np.clip(h - (lo + hi) / 2, 0, cap)

    h = g = project(np.full(n, 1 / n))
    t = 1.0
    for _ in range(rounds):
        nxt = project(g + step * (alpha - 2 * risk_aversion * v @ g))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        g = nxt + (t - 1) / t2 * (nxt - h)
        if np.abs(nxt - h).max() < 1e-12:
            break
        h, t = nxt, t2
    return h


def no_trade_zone(alpha: np.ndarray, v: np.ndarray, h: np.ndarray, risk_aversion: float, buy_cost: float, sell_cost: float, cap: np.ndarray, sweeps: int = 20, tolerance: float = 1e-8) -> np.ndarray:
    """Coordinate descent in which a holding moves only where its marginal value leaves the dead band of trading costs.

    Coordinates go in their own order, so the result is reproducible.
    """
    h, start = h.copy(), h.copy()
    for _ in range(sweeps):
        before = h.copy()
        for i in range(len(h)):
            slope = alpha[i] - 2 * risk_aversion * float(v[i] @ h)
            rest = slope + 2 * risk_aversion * v[i, i] * h[i]
            stay = rest - 2 * risk_aversion * v[i, i] * start[i]
            if stay > buy_cost:
                h[i] = min((rest - buy_cost) / (2 * risk_aversion * v[i, i]), cap[i])
            elif stay < -sell_cost:
                h[i] = max((rest + sell_cost) / (2 * risk_aversion * v[i, i]), 0.0)
            else:
                h[i] = start[i]
        if np.abs(h - before).max() < tolerance:
            break
    return h


def minimum_variance(v: np.ndarray) -> np.ndarray:
    """Fully invested weights of least variance."""
    x = np.linalg.solve(v, np.ones(len(v)))
    return x / x.sum()


def tangency(v: np.ndarray, excess: np.ndarray) -> np.ndarray:
    """Fully invested weights of the highest ratio of excess return to risk."""
    x = np.linalg.solve(v, excess)
    return x / x.sum()


def trades(positions: DataFrame, value: float, lot: int = 100, threshold: float = 1e-5) -> DataFrame:
    """(.., side, amount, shares) from target weight, current weight and price; whole lots, prices of 0 or less give none."""
    delta = F.col("target") - F.col("current")
    amount = F.abs(delta) * value
    side = F.when(delta > threshold, "buy").when(delta < -threshold, "sell").otherwise("hold")
    shares = F.when((F.col("price") > 0) & (F.abs(delta) > threshold), F.floor(F.try_divide(amount, F.col("price") * lot)) * lot).otherwise(0)
    return positions.withColumn("side", side).withColumn("amount", F.when(F.abs(delta) > threshold, amount).otherwise(0.0)).withColumn("shares", shares.cast("long"))
