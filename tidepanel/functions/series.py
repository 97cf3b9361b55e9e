"""Short date series on the driver: unit-root test, ARMA by regression, forecasts.

Inputs are one value per trading day, so they are small at any data size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Coefficients of the response surface for critical values of the
# augmented Dickey-Fuller t with a constant (MacKinnon 2010), per 1, 5 and 10 %.
_CRITICAL = {0.01: (-3.43035, -6.5393, -16.786), 0.05: (-2.86154, -2.8903, -4.234), 0.10: (-2.56677, -1.5384, -2.809)}


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    s2 = float(e @ e) / max(len(y) - x.shape[1], 1)
    return beta, np.sqrt(np.diag(np.linalg.pinv(x.T @ x)) * s2), float(e @ e)


def critical_values(n: int) -> dict[float, float]:
    """Critical values of the t statistic by level, for n changes."""
    return {p: a + b / n + c / n**2 for p, (a, b, c) in _CRITICAL.items()}


def adf(y: np.ndarray, most_lags: int | None = None) -> tuple[float, int, dict[float, float]]:
    """(t statistic, lags by BIC, critical values) with a constant."""
    y = np.asarray(y, float)
    d = np.diff(y)
    most = int(12 * (len(y) / 100) ** 0.25) if most_lags is None else most_lags
    most = max(0, min(most, len(d) // 3))
    best = None
    for lags in range(most + 1):
        rows = np.arange(most, len(d))
        x = np.column_stack([np.ones(len(rows)), y[rows], *(d[rows - k] for k in range(1, lags + 1))])
        beta, se, rss = _ols(d[rows], x)
        bic = len(rows) * np.log(max(rss, 1e-300) / len(rows)) + x.shape[1] * np.log(len(rows))
        if best is None or bic < best[0]:
            best = (bic, lags, float(beta[1] / se[1]) if se[1] > 0 else 0.0)
    return best[2], best[1], critical_values(len(d))


@dataclass(frozen=True)
class Arma:
    const: float
    ar: np.ndarray
    ma: np.ndarray
    bic: float
    y: np.ndarray
    e: np.ndarray

    def forecast(self, steps: int = 1) -> np.ndarray:
        y, e = list(self.y), list(self.e)
        for _ in range(steps):
            y.append(self.const + sum(a * y[-1 - i] for i, a in enumerate(self.ar)) + sum(m * e[-1 - i] for i, m in enumerate(self.ma)))
            e.append(0.0)
        return np.array(y[len(self.y) :])


def arma(y: np.ndarray, p: int, q: int) -> Arma:
    """Hannan-Rissanen: innovations from a long autoregression, then one regression on past values and innovations."""
    y = np.asarray(y, float)
    e = np.zeros(len(y))
    if q:
        long = min(max(p + q + 2, int(np.sqrt(len(y)))), len(y) // 3)
        rows = np.arange(long, len(y))
        x = np.column_stack([np.ones(len(rows)), *(y[rows - k] for k in range(1, long + 1))])
        beta, *_ = _ols(y[rows], x)
        e[rows] = y[rows] - x @ beta
        start = long + q
    else:
        start = p
    rows = np.arange(max(start, p), len(y))
    x = np.column_stack([np.ones(len(rows)), *(y[rows - k] for k in range(1, p + 1)), *(e[rows - k] for k in range(1, q + 1))])
    beta, _, rss = _ols(y[rows], x)
    out = np.zeros(len(y))
    out[rows] = y[rows] - x @ beta
    n = len(rows)
    bic = np.log(max(rss, 1e-300) / n) + (1 + p + q) * np.log(n) / n  # per row, as starts differ
    return Arma(float(beta[0]), beta[1 : p + 1], beta[p + 1 :], float(bic), y, out)


def select_arma(y: np.ndarray, most_ar: int = 4, most_ma: int = 2) -> Arma:
    """The order of the lowest BIC."""
    return min((arma(y, p, q) for p in range(most_ar + 1) for q in range(most_ma + 1)), key=lambda m: m.bic)


def next_level(y: np.ndarray, k: float = 3.0) -> float:
    """One-step forecast after bounding by the median deviation; the mean where a unit root can't be ruled out."""
    y = np.asarray(y, float)
    mid = np.median(y)
    dev = 1.4826 * np.median(np.abs(y - mid))
    if dev > 0:
        y = np.clip(y, mid - k * dev, mid + k * dev)
    t, _, critical = adf(y)
    return float(select_arma(y).forecast(1)[0]) if t <= critical[0.05] else float(y.mean())
