"""From signals to positions: the alpha engine, the aligned book, and what is stored of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.operators import cross, portfolio, volatility


def last_date(df: DataFrame, until: str | None, column: str = "date") -> DataFrame:
    """One row: the last date at or before ``until`` (of all without)."""
    rows = df if until is None else df.where(F.col(column) <= F.lit(until).cast("date"))
    return rows.agg(F.max(column).alias(column))


def classify(signal: DataFrame, omega: DataFrame, until: str | None = None, window: int = 200, least_names: int = 30, r2: float = 0.2) -> DataFrame:
    """One row (scenario, names, r2): whether an instrument's signal deviation follows its residual volatility.

    Regression of the deviation over the last ``window`` dates (instrument, date,
    g) on omega (instrument, omega).  Case 2 (it does) where R2 is above ``r2``,
    and by default with fewer dates or names; else case 1.  With 30 names or more an R2 above
    0.2 has a p-value under 0.02, so no test is left to make.
    """
    own = signal if until is None else signal.where(F.col("date") <= F.lit(until).cast("date"))
    days = own.select("date").distinct().withColumn("k__", F.row_number().over(W.orderBy(F.desc("date"))))  # one row per date
    recent = own.join(F.broadcast(days.where(F.col("k__") <= window).select("date")), "date", "left_semi")
    sd = recent.groupBy("instrument").agg(F.stddev_samp("g").alias("sd")).where("sd is not null")
    fit = sd.join(omega.where("omega is not null"), "instrument").agg(F.count("*").alias("names"), F.regr_r2("sd", "omega").alias("r2"))
    out = fit.join(F.broadcast(days.agg(F.count("*").alias("days"))))
    case = F.when((F.col("days") < window) | (F.col("names") < least_names), 2).when(F.col("r2") > r2, 2).otherwise(1)
    return out.select(case.alias("scenario"), "names", "r2")


def single_alpha(signal: DataFrame, omega: DataFrame, ic: DataFrame, case: DataFrame, until: str | None = None) -> DataFrame:
    """(instrument, date, alpha, omega, ic, scenario) on the last date that has a signal: omega * ic * z in case 1, ic * z in case 2."""
    z = signal.where("g is not null").withColumn("z", cross.zscore("g", ["date"]))
    z = z.join(F.broadcast(last_date(z, until)), "date", "left_semi").join(omega, "instrument", "left")
    rows = z.join(F.broadcast(ic.select("ic"))).join(F.broadcast(case.select("scenario")))
    alpha = F.when(F.col("scenario") == 1, F.col("omega") * F.col("ic") * F.col("z")).otherwise(F.col("ic") * F.col("z"))
    return rows.select("instrument", "date", alpha.alias("alpha"), "omega", "ic", "scenario").where("scenario = 2 or omega is not null")


def alpha_engine(signal: DataFrame, residuals: DataFrame, traits: DataFrame, until: str | None = None, window: int = 200, min_ic_dates: int = 250, min_old: int = 50) -> DataFrame:
    """Alpha and its diagnostics on the last date: residual volatility, case, pooled coefficient and score end to end.

    ``signal`` is (instrument, date, g), ``residuals`` (instrument, date,
    residual), ``traits`` (instrument, date, industry, circ_mv).
    """
    omega = volatility.residual_volatility(residuals, traits, until, window, window, min_old).select("instrument", "omega")
    case = classify(signal, omega, until, window)
    z = signal.where("g is not null").withColumn("z", cross.zscore("g", ["date"])).where("z is not null")
    ic = volatility.pooled_ic(z, residuals, min_ic_dates)
    return single_alpha(signal, omega, ic, case, until)


def aligned(alpha: DataFrame, exposure: DataFrame, specific: DataFrame, benchmark: DataFrame, position: DataFrame, prices: DataFrame, beta: DataFrame) -> DataFrame:
    """(instrument, alpha, d, benchmark, shares, price, beta): names that alpha, exposures, specific risk and benchmark all have.

    Benchmark weights are scaled to sum to one over them, missing positions are
    0; prices and betas may be missing.
    """
    names = alpha.select("instrument", "alpha").join(exposure.select("instrument").distinct(), "instrument", "left_semi").join(specific.select("instrument", "d"), "instrument").join(benchmark.select("instrument", "b"), "instrument")
    out = names.join(position.select("instrument", "shares"), "instrument", "left").join(prices.select("instrument", "price"), "instrument", "left").join(beta.select("instrument", "beta"), "instrument", "left")
    total = names.agg(F.sum("b").alias("total"))
    out = out.join(F.broadcast(total))
    return out.select("instrument", "alpha", "d", F.try_divide("b", "total").alias("benchmark"), F.coalesce("shares", F.lit(0)).alias("shares"), "price", "beta")


def marginal_value(alpha: DataFrame, exposure: DataFrame, cov: DataFrame, specific: DataFrame, weights: DataFrame, risk_aversion: float) -> DataFrame:
    """(instrument, value): alpha - 2 * risk_aversion * V h, through the factors."""
    x = exposure.join(weights, "instrument").groupBy("factor").agg(F.sum(F.col("x") * F.col("h")).alias("b"))
    fx = cov.join(x.withColumnRenamed("factor", "j"), "j").groupBy(F.col("i").alias("factor")).agg(F.sum(F.col("v") * F.col("b")).alias("fx"))
    vh = exposure.join(fx, "factor").groupBy("instrument").agg(F.sum(F.col("x") * F.col("fx")).alias("vh"))
    rows = alpha.join(vh, "instrument").join(specific, "instrument").join(weights, "instrument", "left")
    own = F.col("vh") + F.col("d") * F.coalesce("h", F.lit(0.0))
    return rows.select("instrument", (F.col("alpha") - 2 * risk_aversion * own).alias("value"))


def factor_neutral(alpha: DataFrame, exposure: DataFrame, specific: DataFrame, ridge: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """((instrument, alpha), (factor, alpha)): what factors don't explain of alpha, weighted by inverse specific variance, and the factors' part.

    The normal equations are sums over instruments; the factor-by-factor system is the driver's.
    """
    rows = exposure.join(alpha.select("instrument", "alpha"), "instrument").join(specific.select("instrument", "d"), "instrument")
    a = rows.select("instrument", F.col("factor").alias("i"), F.col("x").alias("xi"), "alpha", "d")
    g = a.join(rows.select("instrument", F.col("factor").alias("j"), F.col("x").alias("xj")), "instrument").groupBy("i", "j").agg(F.sum(F.col("xi") * F.col("xj") / F.col("d")).alias("g"))
    r = a.groupBy("i").agg(F.sum(F.col("xi") * F.col("alpha") / F.col("d")).alias("r"))
    names = sorted(x["i"] for x in r.collect())
    place = {n: k for k, n in enumerate(names)}
    m, y = ridge * np.eye(len(names)), np.zeros(len(names))
    for x in g.collect():
        m[place[x["i"]], place[x["j"]]] += x["g"]
    for x in r.collect():
        y[place[x["i"]]] = x["r"]
    theta = np.linalg.solve(m, y)
    factors = alpha.sparkSession.createDataFrame([(n, float(t)) for n, t in zip(names, theta)], "factor string, alpha double")
    through = exposure.join(F.broadcast(factors.withColumnRenamed("alpha", "f")), "factor").groupBy("instrument").agg(F.sum(F.col("x") * F.col("f")).alias("through"))
    left = alpha.join(through, "instrument").join(specific.select("instrument"), "instrument", "left_semi").select("instrument", (F.col("alpha") - F.col("through")).alias("alpha"))
    return left, factors


def booked(orders: DataFrame, position: DataFrame, total_value: Column | float) -> DataFrame:
    """``orders`` (portfolio, instrument, side, shares, price) as they are stored: sells capped at the holding and negative, the new holding, and the portfolio's cash."""
    held = F.coalesce("held", F.lit(0))
    rows = orders.join(position.select("portfolio", "instrument", F.col("shares").alias("held")), ["portfolio", "instrument"], "left")
    trade = F.when(F.col("side") == "sell", -F.least(F.col("shares"), held)).otherwise(F.col("shares"))
    rows = rows.withColumn("trade_shares", trade).withColumn("hold_shares", held + F.col("trade_shares"))
    value = F.sum(F.col("hold_shares") * F.col("price")).over(W.partitionBy("portfolio"))
    total = total_value if isinstance(total_value, Column) else F.lit(float(total_value))
    return rows.select("portfolio", "instrument", "side", "price", "trade_shares", "hold_shares", (total - value).alias("cash"))


def trades_from(book: DataFrame, value: float) -> DataFrame:
    """Orders of a book (instrument, h, current, price): see portfolio.trades."""
    return portfolio.trades(book.select("instrument", "price", F.col("h").alias("target"), "current"), value)
