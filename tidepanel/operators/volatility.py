"""Residual volatility of old and new names, and the pooled information coefficient."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.operators.cross import safe_corr


def pooled_ic(scores: DataFrame, residuals: DataFrame, min_dates: int = 250) -> DataFrame:
    """One row (dates, n, ic): correlation of the score (instrument, date, z) with the instrument's next residual (instrument, date, residual).

    Missing values are left out before the residuals are moved.  ``dates`` are
    those in both tables; with fewer than ``min_dates`` the coefficient is NULL.
    """
    z = scores.where("z is not null").select("instrument", "date", "z")
    ahead = F.lead("residual").over(W.partitionBy("instrument").orderBy("date"))
    r = residuals.where("residual is not null").select("instrument", "date", ahead.alias("next")).where("next is not null")
    both = z.select("date").distinct().join(r.select("date").distinct(), "date").agg(F.count("*").alias("dates"))
    pairs = z.join(r, ["instrument", "date"]).agg(F.count("*").alias("n"), safe_corr(F.col("z"), F.col("next")).alias("ic"))
    return both.join(F.broadcast(pairs)).select("dates", "n", F.when(F.col("dates") >= min_dates, F.col("ic")).alias("ic"))


def residual_volatility(residuals: DataFrame, traits: DataFrame, as_of: str | None = None, min_days: int = 200, window: int = 200, min_old: int = 50, floor: float = 0.001) -> DataFrame:
    """(instrument, n, method, omega) from residuals (instrument, date, residual) and traits (instrument, date, industry, circ_mv) up to ``as_of``.

    Names with ``min_days`` residuals are old: the deviation of their last
    ``window`` rows.  New ones get the regression of the old ones' deviations on
    industry and log cap of the last date with traits, ``floor`` at least; an
    industry without old names counts as the first in order.  With fewer than
    ``min_old`` old names to fit on, or without traits, it is the old ones' median.
    Every new name has its own industry's coefficient, whichever others are new.
    """
    r, t = residuals.select("instrument", "date", "residual"), traits.select("instrument", "date", "industry", "circ_mv")
    if as_of is not None:
        r = r.where(F.col("date") <= F.lit(as_of).cast("date"))
    until, days = r.agg(F.max("date"), F.countDistinct("date")).first()
    t = t.where(F.col("date") <= F.lit(until if as_of is None else as_of).cast("date"))
    if days < min_days:
        raise ValueError(f"residuals of {days} dates; {min_days} are needed")
    k = F.row_number().over(W.partitionBy("instrument").orderBy(F.desc("date")))
    h = r.withColumn("k", k).groupBy("instrument").agg(F.count("residual").alias("n"), F.stddev_samp(F.when(F.col("k") <= window, F.col("residual"))).alias("sd"))
    t = t.join(F.broadcast(t.agg(F.max("date").alias("date"))), "date", "left_semi")
    x = F.when(F.col("industry").isNotNull() & F.col("circ_mv").isNotNull(), F.ln(F.greatest(F.col("circ_mv").cast("double"), F.lit(1.0))))
    names = h.join(t.select("instrument", "industry", x.alias("x")), "instrument", "left").withColumn("old", F.col("n") >= min_days)
    # dummies and one more variable: the slope within industries, and each industry's means
    fit = names.where("old and sd is not null and x is not null")
    g = fit.groupBy("industry").agg(F.count("*").alias("size"), F.avg("sd").alias("my"), F.avg("x").alias("mx"), (F.covar_pop("x", "sd") * F.count("*")).alias("sxy"), (F.var_pop("x") * F.count("*")).alias("sxx"))
    s = g.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("fitted"), F.coalesce(F.try_divide(F.sum("sxy"), F.nullif(F.sum("sxx"), F.lit(0.0))), F.lit(0.0)).alias("slope"), F.min_by("my", "industry").alias("by"), F.min_by("mx", "industry").alias("bx"))
    middle = names.where("old").agg(F.median("sd").alias("middle"))
    p = names.join(g.select("industry", "my", "mx"), "industry", "left").join(F.broadcast(s)).join(F.broadcast(middle))
    guess = F.coalesce("my", "by") + F.col("slope") * (F.col("x") - F.coalesce("mx", "bx"))
    method = F.when(F.col("old"), "history").when((F.col("fitted") >= min_old) & F.col("x").isNotNull(), "regression").otherwise("median")
    omega = F.when(method == "history", F.col("sd")).when(method == "regression", F.greatest(guess, F.lit(floor))).otherwise(F.col("middle"))
    return p.select("instrument", "n", method.alias("method"), omega.alias("omega")).where("omega is not null")
