"""Multi-factor risk: covariances of factor returns, asset risk, attribution.

Matrices are long tables (i, j, v) over factors; products with exposures
are joins and sums.  Only factor-by-factor matrices (tens of rows) reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.functions.series import next_level
from tidepanel.operators.cross import winsorize


def sample_covariance(returns: DataFrame, per_year: int = 252) -> DataFrame:
    """(i, j, v) of annualised sample covariances of factor returns (date, factor, ret)."""
    a = returns.select("date", F.col("factor").alias("i"), F.col("ret").alias("x"))
    b = returns.select("date", F.col("factor").alias("j"), F.col("ret").alias("y"))
    return a.join(b, "date").groupBy("i", "j").agg((F.covar_samp("x", "y") * per_year).alias("v"))


def ewma_covariance(returns: DataFrame, half_life: float, per_year: int = 252) -> DataFrame:
    """(i, j, v) of half-life weighted second moments about zero; weights sum to one."""
    n = returns.select("date").distinct().withColumn("age", F.row_number().over(W.orderBy(F.desc("date"))) - 1)
    w = n.withColumn("w", F.pow(F.lit(0.5), F.col("age") / half_life)).select("date", "w")
    r = returns.join(w, "date")
    a = r.select("date", "w", F.col("factor").alias("i"), F.col("ret").alias("x"))
    b = r.select("date", F.col("factor").alias("j"), F.col("ret").alias("y"))
    return a.join(b, "date").groupBy("i", "j").agg((F.try_divide(F.sum(F.col("w") * F.col("x") * F.col("y")), F.sum("w")) * per_year).alias("v"))


def barra_covariance(returns: DataFrame, half_life_corr: float = 252, half_life_var: float = 42, init_periods: int = 20, per_year: int = 252) -> DataFrame:
    """(i, j, v) of annualised covariances with separate half-lives for correlations and variances.

    F starts as the sample covariance of the first ``init_periods`` dates and takes
    in each later date's second moments; its diagonal is smoothed once more by the
    second half-life.  Both recursions are weighted sums over dates in closed form,
    so only factor-by-factor sums reach the driver.  Dates on which some factor has
    no return are left out.
    """
    r = returns.where("ret is not null").select("date", "factor", "ret")
    factors = sorted(x[0] for x in r.select("factor").distinct().collect())
    full = r.groupBy("date").agg(F.count("*").alias("n")).where(F.col("n") == len(factors))
    full = full.select("date", F.row_number().over(W.orderBy("date")).alias("k"))
    days = full.count()
    if days <= init_periods:
        raise ValueError(f"returns of all factors on {days} dates; more than {init_periods} are needed")
    c, d, n = 0.5 ** (1 / half_life_corr), 0.5 ** (1 / half_life_var), days - init_periods
    age = F.lit(float(days)) - F.col("k")
    if c == d:
        twice, first = (age + 1) * F.pow(F.lit(c), age), (1 - c) * n * c**n
    else:
        twice = (F.pow(F.lit(c), age + 1) - F.pow(F.lit(d), age + 1)) / (c - d)
        first = (1 - d) * c * (c**n - d**n) / (c - d)
    r = r.join(F.broadcast(full), "date")  # one row a date
    a = r.select("k", F.col("factor").alias("i"), F.col("ret").alias("x"))
    b = r.select("k", F.col("factor").alias("j"), F.col("ret").alias("y"))
    early, xy = F.col("k") <= init_periods, F.col("x") * F.col("y")
    start = F.covar_samp(F.when(early, F.col("x")), F.when(early, F.col("y")))
    raw = c**n * start + (1 - c) * F.sum(F.when(early, 0.0).otherwise(F.pow(F.lit(c), age) * xy))
    smooth = (d**n + first) * start + (1 - c) * (1 - d) * F.sum(F.when(early, 0.0).otherwise(twice * xy))
    place = {f: k for k, f in enumerate(factors)}
    f, var = np.zeros((len(factors),) * 2), np.zeros(len(factors))
    for x in a.join(b, "k").groupBy("i", "j").agg(raw.alias("raw"), smooth.alias("smooth")).collect():
        f[place[x.i], place[x.j]] = x.raw
        if x.i == x.j:
            var[place[x.i]] = x.smooth
    corr = f / np.maximum(np.sqrt(np.outer(np.diag(f), np.diag(f))), 1e-20)
    dev = np.sqrt(np.maximum(var, 1e-20))
    v = corr * np.outer(dev, dev)
    if not (np.linalg.eigvalsh(v) > 0).all():
        v = positive_definite(v)
    rows = [(i, j, float(v[place[i], place[j]]) * per_year) for i in factors for j in factors]
    kind = returns.schema["factor"].dataType.simpleString()
    return returns.sparkSession.createDataFrame(rows, f"i {kind}, j {kind}, v double")


def correlation(cov: DataFrame) -> DataFrame:
    """(i, j, v) of correlations: the covariance over both deviations."""
    d = cov.where("i = j").select(F.col("i").alias("k"), F.sqrt("v").alias("s"))
    out = cov.join(d.select(F.col("k").alias("i"), F.col("s").alias("si")), "i").join(d.select(F.col("k").alias("j"), F.col("s").alias("sj")), "j")
    return out.select("i", "j", F.try_divide(F.col("v"), F.col("si") * F.col("sj")).alias("v"))


def positive_definite(v: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """Symmetric part with its eigenvalues raised to ``floor``."""
    vals, vecs = np.linalg.eigh((v + v.T) / 2)
    return (vecs * np.maximum(vals, floor)) @ vecs.T


def factor_exposure(exposure: DataFrame, weights: DataFrame) -> DataFrame:
    """(factor, x): exposure (instrument, factor, x) summed with weights (instrument, h)."""
    return exposure.join(weights, "instrument").groupBy("factor").agg(F.sum(F.col("x") * F.col("h")).alias("x"))


def variance_parts(exposure: DataFrame, cov: DataFrame, specific: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: factor variance x'Fx, specific variance sum h^2 d, their sum and shares; no asset-by-asset matrix is formed."""
    x = factor_exposure(exposure, weights)
    a = x.select(F.col("factor").alias("i"), F.col("x").alias("a"))
    b = x.select(F.col("factor").alias("j"), F.col("x").alias("b"))
    f = cov.join(a, "i").join(b, "j").agg(F.sum(F.col("a") * F.col("v") * F.col("b")).alias("factor_variance"))
    s = specific.join(weights, "instrument").agg(F.sum(F.col("h") * F.col("h") * F.col("d")).alias("specific_variance"))
    total = F.col("factor_variance") + F.col("specific_variance")
    return f.join(s).select("factor_variance", "specific_variance", total.alias("total"), F.try_divide("factor_variance", total).alias("factor_share"), F.sqrt(total).alias("risk"))


def factor_contributions(exposure: DataFrame, cov: DataFrame, specific: DataFrame, weights: DataFrame) -> DataFrame:
    """(factor, exposure, marginal, contribution) of active risk: F x / psi and x times it."""
    x = factor_exposure(exposure, weights)
    psi = variance_parts(exposure, cov, specific, weights).select("risk")
    fx = cov.join(x.select(F.col("factor").alias("j"), F.col("x").alias("b")), "j").groupBy(F.col("i").alias("factor")).agg(F.sum(F.col("v") * F.col("b")).alias("fx"))
    out = x.join(fx, "factor").join(F.broadcast(psi))  # psi is one row
    marginal = F.when(F.col("risk") < 1e-10, 0.0).otherwise(F.try_divide("fx", "risk"))
    return out.select("factor", F.col("x").alias("exposure"), marginal.alias("marginal"), (F.col("x") * marginal).alias("contribution"))


def asset_contributions(exposure: DataFrame, cov: DataFrame, specific: DataFrame, weights: DataFrame) -> DataFrame:
    """(instrument, marginal, contribution): V h / psi through the factors, X (F x) + d h; contributions sum to psi."""
    x = factor_exposure(exposure, weights)
    psi = variance_parts(exposure, cov, specific, weights).select("risk")
    fx = cov.join(x.select(F.col("factor").alias("j"), F.col("x").alias("b")), "j").groupBy(F.col("i").alias("factor")).agg(F.sum(F.col("v") * F.col("b")).alias("fx"))
    through = exposure.join(fx, "factor").groupBy("instrument").agg(F.sum(F.col("x") * F.col("fx")).alias("vh"))
    out = through.join(specific, "instrument").join(weights, "instrument", "left").join(F.broadcast(psi))
    h = F.coalesce("h", F.lit(0.0))
    marginal = F.try_divide(F.col("vh") + F.col("d") * h, F.nullif("risk", F.lit(0.0)))
    return out.select("instrument", F.coalesce(marginal, F.lit(0.0)).alias("marginal"), F.coalesce(h * marginal, F.lit(0.0)).alias("contribution"))


def specific_variance(residuals: DataFrame) -> DataFrame:
    """(instrument, date, s, v): mean squared residual of the date and each row's relative square less one."""
    s = F.avg(F.col("residual") * F.col("residual")).over(W.partitionBy("date"))
    return residuals.select("instrument", "date", s.alias("s"), (F.try_divide(F.col("residual") * F.col("residual"), s) - 1).alias("v"))


def forecast_specific_variance(residuals: DataFrame, exposure: DataFrame, styles: list[str], panel_window: int = 120, per_year: int = 252) -> DataFrame:
    """(instrument, specific_var) for the latest date, from residuals (instrument, date, residual) and exposures (instrument, date, styles).

    The mean squared residual S of all common dates is forecast by one step
    (its mean where a unit root can't be ruled out; the reference stops there).  The
    relative squares v of the last ``panel_window`` dates but the latest are bounded
    per date by the median deviation and regressed on the styles by sums over all
    rows; the latest exposures predict v, and S (1 + v), 1e-8 at least, is annualised.
    Rows without a residual, or without one of the styles, are left out.
    """
    x = exposure.select("instrument", "date", *(F.col(c).cast("double").alias(c) for c in styles)).dropna(subset=styles)
    both = residuals.where("residual is not null").select("instrument", "date", "residual").join(x, ["instrument", "date"])
    level = both.groupBy("date").agg(F.avg(F.col("residual") * F.col("residual")).alias("s")).orderBy("date").collect()  # one row a date
    if len(level) < 2:
        raise ValueError("two dates at least are needed")
    latest, first = level[-1]["date"], level[-min(panel_window, len(level))]["date"]
    s = next_level(np.array([r["s"] for r in level]))
    v = specific_variance(both.where((F.col("date") >= F.lit(first)) & (F.col("date") < F.lit(latest)))).select("instrument", "date", "v")
    train = winsorize(v.where("v is not null"), "v", ["date"], "mad").join(x, ["instrument", "date"])
    terms = [F.lit(1.0), *(F.col(f"`{c}`") for c in styles)]
    sums = [F.sum(a * b) for k, a in enumerate(terms) for b in [*terms[k:], F.col("v")]]
    got = train.agg(*(c.alias(f"c{k}") for k, c in enumerate(sums))).first()
    if got[0] is None or not np.isfinite(s):
        raise ValueError("no forecast from residuals that are constant or missing")
    got = iter(got)
    m, y = np.zeros((len(terms),) * 2), np.zeros(len(terms))
    for k in range(len(terms)):
        for j in range(k, len(terms)):
            m[k, j] = m[j, k] = next(got)
        y[k] = next(got)
    # columns of one length, so that the rank doesn't hang on the units
    size = np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))
    beta = np.linalg.pinv(m / np.outer(size, size), rcond=1e-13, hermitian=True) @ (y / size) / size
    guess = sum((F.lit(float(b)) * t for b, t in zip(beta, terms)), F.lit(0.0))
    return both.where(F.col("date") == F.lit(latest)).select("instrument", (F.greatest(F.lit(s) * (1 + guess), F.lit(1e-8)) * per_year).alias("specific_var"))


def vif(corr: np.ndarray) -> np.ndarray:
    """Variance inflation factors: the diagonal of the inverse correlation matrix."""
    return np.diag(np.linalg.pinv(corr))
