"""Factor evaluation: information coefficients, strata, decay and summary figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.operators.cross import information_coefficients, quantile_bins


def summary(ic: DataFrame, column: str = "ic") -> DataFrame:
    """One row: mean, deviation and their ratio (0 where the deviation is 0 or missing), and the latest value."""
    sd = F.stddev_samp(column)
    return ic.agg(F.avg(column).alias("mean"), sd.alias("std"), F.coalesce(F.when(sd > 0, F.try_divide(F.avg(column), sd)), F.lit(0.0)).alias("ir"), F.max_by(column, "date").alias("latest"))


def stratified(panel: DataFrame, factor: str, ret: str, n: int = 5) -> DataFrame:
    """(date, bin, ret): mean return of equal-frequency groups per date."""
    both = panel.where(F.col(factor).isNotNull() & F.col(ret).isNotNull()).select("date", factor, ret)
    return quantile_bins(both, factor, n, ["date"]).where("bin is not null").groupBy("date", "bin").agg(F.avg(ret).alias("ret"))


def long_short(strata: DataFrame) -> DataFrame:
    """(date, long_short, long_average) of each date's highest group."""
    return strata.groupBy("date").agg((F.max_by("ret", "bin") - F.min_by("ret", "bin")).alias("long_short"), (F.max_by("ret", "bin") - F.avg("ret")).alias("long_average"))


def ols_t(y: str, x: str) -> list[Column]:
    """alpha, beta and the t statistic of beta of a one-variable regression, as aggregates."""
    n = F.count(F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), 1))
    slope = F.regr_slope(y, x)
    rest = F.regr_syy(y, x) - slope * F.regr_sxy(y, x)
    se = F.sqrt(F.greatest(F.try_divide(rest, (n - 2) * F.regr_sxx(y, x)), F.lit(0.0)))
    return [F.regr_intercept(y, x).alias("alpha"), slope.alias("beta"), F.when(n > 2, F.try_divide(slope, F.nullif(se, F.lit(0.0)))).alias("t_beta")]


def decay_lags(most: int, gamma: float = 1.1) -> list[int]:
    """1, then each lag times ``gamma`` rounded up, up to ``most``."""
    out = [1]
    while (nxt := math.ceil(out[-1] * gamma)) <= most:
        out.append(nxt)
    return out


def decay(panel: DataFrame, factor: str, price: str, lags: list[int]) -> DataFrame:
    """(lag, ric): mean rank correlation with the one-day return ``lag`` days ahead; all lags share one pass of windows."""
    w = W.partitionBy("instrument").orderBy("date")
    ahead = sorted({k + d for k in lags for d in (0, 1)})
    p = panel.select("date", factor, *(F.lead(price, k).over(w).alias(f"p{k}") for k in ahead))
    rets = [F.struct(F.lit(k).alias("lag"), (F.try_divide(f"p{k + 1}", f"p{k}") - 1).alias("r")) for k in lags]
    long = p.select("date", factor, F.explode(F.array(*rets)).alias("x")).select("date", factor, "x.lag", "x.r")
    ic = information_coefficients(long, factor, "r", ["lag", "date"])
    return ic.groupBy("lag").agg(F.avg("ric").alias("ric"))


def half_life(decayed: DataFrame) -> DataFrame:
    """One row: -ln 2 over the slope of ln |ric| on lag; NULL where it does not fall or under three points."""
    p = decayed.where("ric <> 0").select("lag", F.ln(F.abs("ric")).alias("l"))
    slope = F.regr_slope("l", "lag")
    return p.agg(F.when((F.count("*") >= 3) & (slope < 0), F.lit(-math.log(2)) / slope).alias("half_life"))


def return_statistics(series: DataFrame, ret: str = "ret", order: str = "date", per_year: int = 252) -> DataFrame:
    """One row: mean, deviation, annualised return, information ratio and the largest drawdown of a date series."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)  # one row per date
    cum = F.sum(ret).over(w)
    p = series.where(F.col(ret).isNotNull()).withColumn("cum", cum).withColumn("dd", F.col("cum") - F.max("cum").over(w))
    m, s = F.avg(ret), F.stddev_samp(ret)
    return p.agg(m.alias("mean"), s.alias("std"), (m * per_year).alias("annualized"), (F.try_divide(m, F.nullif(s, F.lit(0.0))) * math.sqrt(per_year)).alias("information_ratio"), F.min("dd").alias("max_drawdown"))
