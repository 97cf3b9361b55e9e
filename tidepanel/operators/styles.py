"""Named style factors of prices, turnover and statements.

Every factor takes a panel (instrument, date, ..) and adds one column; windows,
half-lives, lags and signs are parameters whose defaults count trading days.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.functions.scalars import fiscal_year
from tidepanel.operators import rolling


@dataclass(frozen=True)
class Strength:
    """Half-life weighted mean, smoothed over ``smooth`` rows, lagged by ``lag`` and multiplied by ``sign``."""

    window: int
    half_life: float
    smooth: int = 1
    lag: int = 0
    sign: int = 1


# fixed values: windows and half-lives of the factors in trading days
STREV = Strength(63, 10, 3, 1, -1)
RSTR = Strength(252, 126, 11, 11)
LTRSTR = Strength(1040, 260, 11, 273, -1)
INDMOM = Strength(126, 20, 3, 3)
HALPHA = Strength(504, 252, 11, 11)
LTHALPHA = Strength(1040, 260, 11, 273, -1)
ATVR = Strength(252, 63)
DASTD = Strength(252, 42)


def _own():
    return W.partitionBy("instrument").orderBy("date")


def forward_return(k: int = 1) -> Column:
    """close(t + k + 1) / close(t + 1) - 1 along an instrument's rows."""
    return F.try_divide(F.lead("close", k + 1).over(_own()), F.lead("close", 1).over(_own())) - 1


def settled(panel: DataFrame, value: str, s: Strength, name: str) -> DataFrame:
    """``panel`` with ``name``: ``value`` smoothed (missing ones left out), lagged and signed."""
    smooth = F.avg(value).over(_own().rowsBetween(-(s.smooth - 1), 0))
    out = panel.withColumn("smooth__", smooth)
    late = F.lag("smooth__", s.lag).over(_own()) if s.lag else F.col("smooth__")
    return out.select(*panel.columns, (F.lit(s.sign) * late).alias(name))


def strength(panel: DataFrame, value: str, s: Strength, name: str) -> DataFrame:
    """``panel`` with a half-life weighted mean of ``value`` over full windows, settled: STREV, RSTR, LTRSTR, ATVR."""
    out = rolling.half_life_stats(panel, value, s.window, s.half_life)
    return settled(out, "weighted_mean", s, name).select(*panel.columns, name)


def deviation(panel: DataFrame, value: str, s: Strength, name: str, per_year: int = 252) -> DataFrame:
    """``panel`` with the annualised half-life weighted deviation over full windows: DASTD."""
    out = rolling.half_life_stats(panel, value, s.window, s.half_life)
    return out.select(*panel.columns, (F.lit(math.sqrt(per_year)) * F.col("weighted_std")).alias(name))


def regression_alpha(panel: DataFrame, y: str, x: str, s: Strength, name: str) -> DataFrame:
    """``panel`` with the intercept of a rolling weighted regression, settled: HALPHA, LTHALPHA."""
    out = rolling.rolling_regression(panel, y, x, s.window, s.half_life)
    return settled(out, "alpha", s, name).select(*panel.columns, name)


def season(panel: DataFrame, ret: str, name: str = "season", years: int = 5) -> DataFrame:
    """``panel`` with mean over deviation of the returns of next month's namesakes in the ``years`` years before; NULL under two returns.

    Months are cut down to three sums each before they meet, and a month meets
    at most ``years`` others of its instrument by equal keys.
    """
    at = panel.withColumn("y__", F.year("date")).withColumn("m__", F.month("date"))
    x = F.col(ret)
    months = at.groupBy("instrument", "y__", "m__").agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
    past = months.select("instrument", F.col("m__").alias("want"), "n", "s", "ss", F.explode(F.sequence(F.col("y__") + 1, F.col("y__") + years)).alias("y__"))
    months = months.select("instrument", "y__", "m__", (F.col("m__") % 12 + 1).alias("want"))
    pool = months.join(past, ["instrument", "want", "y__"]).groupBy("instrument", "y__", "m__").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    var = F.try_divide(F.col("ss") - F.try_divide(F.col("s") * F.col("s"), F.col("n")), F.col("n") - 1)
    value = F.when(F.col("n") >= 2, F.try_divide(F.try_divide("s", "n"), F.nullif(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0))))
    pool = pool.select("instrument", "y__", "m__", value.alias(name))
    return at.join(pool, ["instrument", "y__", "m__"], "left").select(*panel.columns, name)


def industry_momentum(panel: DataFrame, value: str, s: Strength, name: str = "indmom") -> DataFrame:
    """``panel`` (with industry and circ_mv) with the cap-root weighted strength of the industry less the row's own share in it, settled.

    Rows without an industry have none and play no part; a missing strength
    counts in the industry's weights but not in its sum.
    """
    rs = rolling.half_life_stats(panel, value, s.window, s.half_life).withColumnRenamed("weighted_mean", "rs__").withColumn("w__", F.sqrt("circ_mv")).where("industry is not null")
    cell = W.partitionBy("date", "industry")
    total = F.sum("w__").over(cell)
    mean = F.when(total > 0, F.try_divide(F.sum(F.col("rs__") * F.col("w__")).over(cell), total))
    raw = rs.withColumn("raw__", mean - F.try_divide(F.col("rs__") * F.col("w__"), total))
    return settled(raw, "raw__", s, name).select(*panel.columns, name)


def annual_styles(panel: DataFrame, fields: dict[str, tuple[Column, str, int]], window: int = 5, least: int = 3) -> DataFrame:
    """(instrument, date, one column per field) from annual figures: EGRO, SGRO, VSAL, VERN, VFLO, AGRO, IGRO, CXGRO.

    A field is (value, kind, sign); kind is "growth" (slope over mean), "cv"
    (deviation over mean) or "cv_abs" (over the mean's magnitude).  A fiscal year's value is
    the first present one in it; statistics run over the last ``window`` years that
    have one, ``least`` at least, and are NULL where the mean is under 1e-6.  All
    fields share one aggregation, one window and one join.
    """
    values = panel.select("instrument", "date", *(v.cast("double").alias(k) for k, (v, _, _) in fields.items()))
    long = values.unpivot(["instrument", "date"], list(fields), "field", "value").where("value is not null")
    annual = long.groupBy("instrument", "field", fiscal_year(F.col("date")).alias("fy")).agg(F.min_by("value", "date").alias("value"))
    own = W.partitionBy("instrument", "field").orderBy("fy")
    w = own.rowsBetween(-(window - 1), 0)
    annual = annual.withColumn("at", F.row_number().over(own).cast("double"))
    n, mean = F.count("value").over(w), F.avg("value").over(w)
    slope = F.try_divide(F.covar_samp("value", "at").over(w), F.var_samp("at").over(w))
    kind = F.create_map(*(F.lit(x) for k, (_, how, _) in fields.items() for x in (k, how)))[F.col("field")]
    sign = F.create_map(*(F.lit(x) for k, (_, _, s) in fields.items() for x in (k, s)))[F.col("field")]
    base = F.when(kind == "cv_abs", F.abs(mean)).otherwise(mean)
    stat = F.when((n >= least) & (F.abs(mean) >= 1e-6), F.try_divide(F.when(kind == "growth", slope).otherwise(F.stddev_samp("value").over(w)), base))
    annual = annual.select("instrument", "fy", "field", (sign * stat).alias("stat"))
    wide = annual.groupBy("instrument", "fy").pivot("field", list(fields)).agg(F.first("stat"))
    days = panel.select("instrument", "date", fiscal_year(F.col("date")).alias("fy"))
    return days.join(wide, ["instrument", "fy"], "left").select("instrument", "date", *fields)
