"""Evaluation of many factors in one pass: coefficients, strata, decay and portfolio figures per factor."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.operators.cross import information_coefficients, quantile_bins
from tidepanel.sources.files import written


def forward_returns(prices: DataFrame, lags: list[int], rate: DataFrame | None = None) -> DataFrame:
    """(instrument, date, lag, ret): close(t + lag + 1) / close(t + lag) - 1, less the rate (date, rate) of the date where given."""
    w = W.partitionBy("instrument").orderBy("date")
    ahead = sorted({k + d for k in lags for d in (0, 1)})
    p = prices.select("instrument", "date", *(F.lead("close", k).over(w).alias(f"p{k}") for k in ahead))
    rets = F.array(*(F.struct(F.lit(k).alias("lag"), (F.try_divide(f"p{k + 1}", f"p{k}") - 1).alias("ret")) for k in lags))
    long = p.select("instrument", "date", F.explode(rets).alias("r")).select("instrument", "date", "r.lag", "r.ret")
    return long if rate is None else long.join(rate, "date", "left").select("instrument", "date", "lag", (F.col("ret") - F.col("rate")).alias("ret"))


def by_period(ic: DataFrame, period: str) -> DataFrame:
    """(period, ic, ric): means of a coefficient series (date, ic, ric) by year, month or day of the month."""
    part = {"year": F.year, "month": F.month, "day": F.dayofmonth}[period]
    return ic.groupBy(part("date").alias(period)).agg(F.avg("ic").alias("ic"), F.avg("ric").alias("ric"))


def group_return(panel: DataFrame, factor: str, price: str, n: int = 10, k: int = 1, per_year: int = 252) -> DataFrame:
    """(bin, ret): annualised mean forward return of the date's equal-frequency groups, over all dates."""
    w = W.partitionBy("instrument").orderBy("date")
    p = panel.where(F.col(factor).isNotNull() & F.col(price).isNotNull())
    p = p.select("date", factor, (F.try_divide(F.lead(price, k + 1).over(w), F.lead(price, 1).over(w)) - 1).alias("ret__"))
    return quantile_bins(p, factor, n, ["date"]).where("bin is not null").groupBy("bin").agg((F.avg("ret__") * per_year).alias("ret"))


def ratio(x: Column, least: int = 2) -> Column:
    """Mean over deviation as an aggregate; 0 with ``least`` values or fewer, or where the deviation is 0."""
    sd = F.stddev_samp(x)
    return F.when((F.count(x) > least) & (sd > 0), F.try_divide(F.avg(x), sd)).otherwise(0.0)


def compounded(series: DataFrame, ret: str, by: list[str], window: int = 252) -> DataFrame:
    """(by, cum): return compounded over the last ``window`` dates that have one; 0 without any."""
    w = W.partitionBy(*by).orderBy(F.desc("date")) if by else W.orderBy(F.desc("date"))
    last = series.where(F.col(ret).isNotNull()).withColumn("k__", F.row_number().over(w)).where(F.col("k__") <= window)
    return last.groupBy(*by).agg((F.product(1 + F.col(ret)) - 1).alias("cum"))


def fitted(y: str, x: str, tag: str = "") -> list[Column]:
    """alpha, its t statistic, beta and its t statistic of a one-variable regression, as aggregates; zeros with fewer than ``10`` pairs are left to the caller."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    n = F.count(F.when(both, 1))
    beta, alpha, sxx = F.regr_slope(y, x), F.regr_intercept(y, x), F.regr_sxx(y, x)
    s2 = F.greatest(F.try_divide(F.regr_syy(y, x) - beta * F.regr_sxy(y, x), n - 2), F.lit(0.0))
    mean = F.regr_avgx(y, x)
    ta = F.try_divide(alpha, F.nullif(F.sqrt(s2 * (F.try_divide(F.lit(1.0), n) + F.try_divide(mean * mean, sxx))), F.lit(0.0)))
    tb = F.try_divide(beta, F.nullif(F.sqrt(F.try_divide(s2, sxx)), F.lit(0.0)))
    return [n.alias(f"{tag}n"), alpha.alias(f"{tag}alpha"), ta.alias(f"{tag}t_alpha"), beta.alias(f"{tag}beta"), tb.alias(f"{tag}t_beta")]


def long_short(panel: DataFrame, by: list[str], value: str, ret: str, n: int = 5) -> DataFrame:
    """(by, long_short, avg_return): half the spread between the best and the worst 1/n of the rows by value (ties by instrument), and the mean of all."""
    part = W.partitionBy(*by)
    up, down = part.orderBy(F.desc(value), "instrument"), part.orderBy(value, "instrument")
    p = panel.where(F.col(value).isNotNull() & F.col(ret).isNotNull())
    p = p.select(*by, F.col(ret).alias("r__"), F.row_number().over(up).alias("u"), F.row_number().over(down).alias("d"), F.floor(F.count("*").over(part) / n).alias("k"))
    best, worst = F.avg(F.when(F.col("u") <= F.col("k"), F.col("r__"))), F.avg(F.when(F.col("d") <= F.col("k"), F.col("r__")))
    return p.groupBy(*by).agg(((best - worst) / 2).alias("long_short"), F.avg("r__").alias("avg_return"))


def half_life(ric: DataFrame, by: list[str]) -> DataFrame:
    """(by, half_life) from mean rank correlations (by, lag, ric): -ln 2 over the slope of ln |ric| on lag; NULL where it doesn't fall, or with under three points."""
    p = ric.where("ric <> 0").select(*by, "lag", F.ln(F.abs("ric")).alias("l__"))
    slope = F.regr_slope("l__", "lag")
    return p.groupBy(*by).agg(F.when((F.count("*") >= 3) & (slope < 0), F.lit(-math.log(2)) / slope).alias("half_life"))


def report(factors: DataFrame, prices: DataFrame, bench: DataFrame, lags: list[int], groups: int = 5, decay: tuple[str, ...] = (), rate: DataFrame | None = None) -> DataFrame:
    """One row of figures per factor of ``factors`` (instrument, date, name, value).

    ``prices`` is (instrument, date, close), ``bench`` (date, close).  The first
    lag serves coefficients, strata and portfolios; all ``lags`` serve the
    half-life, of the factors named in ``decay``.  Columns: ic and ric (latest),
    icir, ricir, long_short, avg_return (means), half_life, monotonic_t (group
    returns on group number over all dates), ls_alpha, ls_t_alpha, ls_beta (on
    the benchmark's return; zeros under ten dates), ls_ir, ls_cum (252 dates).
    Factors are rows of one long table, written once with their returns: their number adds no pass.
    """
    first = lags[0]
    pairs = factors.where("value is not null").join(forward_returns(prices, lags, rate).where("ret is not null"), ["instrument", "date"])
    pairs = written(pairs, "pairs")
    near = pairs.where(F.col("lag") == first)
    ic = information_coefficients(near, "value", "ret", ["name", "date"], spread=True)
    coef = ic.groupBy("name").agg(
        F.max_by("ic", F.when(F.col("ic").isNotNull(), F.col("date"))).alias("ic"), ratio(F.col("ic"), 1).alias("icir"), F.max_by("ric", F.when(F.col("ric").isNotNull(), F.col("date"))).alias("ric"), ratio(F.col("ric"), 1).alias("ricir")
    )
    strata = quantile_bins(near, "value", groups, ["name", "date"]).where("bin is not null").groupBy("name", "date", "bin").agg(F.avg("ret").alias("ret"))
    mono = strata.groupBy("name").agg(*fitted("ret", "bin", "m_")).select("name", F.when(F.col("m_n") >= 3, F.col("m_t_beta")).otherwise(0.0).alias("monotonic_t"))
    ls = long_short(near, ["name", "date"], "value", "ret", groups)
    w = W.orderBy("date")  # one row per date
    market = bench.select("date", (F.try_divide(F.lead("close", first + 1).over(w), F.lead("close", first).over(w)) - 1).alias("bench"))
    with_market = ls.join(market, "date", "left")
    enough = F.col("n") >= 10
    jensen = with_market.groupBy("name").agg(*fitted("long_short", "bench"), F.avg("long_short").alias("long_short"), F.avg("avg_return").alias("avg_return"), ratio(F.col("long_short")).alias("ls_ir"))
    jensen = jensen.select("name", "long_short", "avg_return", "ls_ir", *(F.when(enough, F.col(c)).otherwise(0.0).alias(f"ls_{c}") for c in ("alpha", "t_alpha", "beta")))
    out = coef.join(mono, "name").join(jensen, "name").join(compounded(ls, "long_short", ["name"]).withColumnRenamed("cum", "ls_cum"), "name")
    if decay:
        far = information_coefficients(pairs.where(F.col("name").isin(*decay)), "value", "ret", ["name", "lag", "date"], spread=True)
        hl = half_life(far.groupBy("name", "lag").agg(F.avg("ric").alias("ric")), ["name"])
        return out.join(hl, "name", "left")
    return out.withColumn("half_life", F.lit(None).cast("double"))
