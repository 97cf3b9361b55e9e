"""Queries of the expression engine: TSW, TAI and EXP rows of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.functions import indicators
from tidepanel.functions.genes import COMPOSITES, FAMILIES, MORE_FAMILIES, PRICES, WINDOWS, handler
from tidepanel.plans.expression import compile_panel, panel_sql
from tidepanel.queries.base import panel_query, query, rounded, rounded_sql
from tidepanel.sources import panels

# TSW01-TSW14: elementwise operators
panel_query(
    "tsw01_14_elementwise",
    "daily",
    {
        "abs_": "Abs($close - $open)",
        "log_": "Log($close)",
        "sign_": "Sign($close - $open)",
        "add_": "$close + $open",
        "sub_": "$close - $open",
        "mul_": "$close * $open",
        "div_": "$close / ($volume - 1)",
        "pow_": "Power($close, 2)",
        "greater_": "Greater($close, Ref($close, 1))",
        "less_": "Less($close, Ref($close, 1))",
        "gt_": "$close > $open",
        "lt_": "$close < $open",
        "ge_": "$close >= $open",
        "le_": "$close <= $open",
        "eq_": "$close == $open",
        "ne_": "$close != $open",
        "and_": "And($close > $open, $high > $close)",
        "or_": "Or($close > $open, $high > $close)",
        "not_": "Not($close > $open)",
        "if_": "If($close > $open, $high, $low)",
    },
)
# TSW15-TSW19, TSW22, TSW24, TSW29, TSW30: shifts and simple moving aggregates
panel_query(
    "tsw15_30_moving",
    "daily",
    {
        "ref1": "Ref($close, 1)",
        "lead2": "Ref($close, -2)",
        "mean5": "Mean($close, 5)",
        "expanding": "Mean($close, 0)",
        "sum5": "Sum($close, 5)",
        "std5": "Std($close, 5)",
        "var5": "Var($close, 5)",
        "max5": "Max($close, 5)",
        "min5": "Min($close, 5)",
        "count5": "Count(Ref($close, 1), 5)",
        "delta3": "Delta($close, 3)",
        "nested": "Mean(Std($close, 3) / Mean($close, 5), 4)",
    },
)
panel_query("tsw20_21_moments", "monthly", {"skew12": "Skew($close, 12)", "kurt12": "Kurt($close, 12)"})
panel_query("tsw23_25_extreme_positions", "monthly", {"idxmax": "IdxMax($close, 12)", "idxmin": "IdxMin($close, 12)"})
panel_query("tsw26_36_quantiles", "daily", {"med5": "Med($close, 5)", "q80": "Quantile($close, 7, 0.8)"})
panel_query("tsw27_28_deviation_rank", "daily", {"mad5": "Mad($close, 5)", "rank5": "Rank($close, 5)"})
panel_query("tsw31_33_trend", "monthly", {"slope": "Slope($close, 10)", "rsq": "Rsquare($close, 10)", "resi": "Resi($close, 10)"})
panel_query("tsw34_35_weighted", "monthly", {"wma5": "WMA($close, 5)", "ema5": "EMA($close, 5)", "ema20": "EMA($close, 20)"})
panel_query("tsw37_38_pairs", "monthly", {"corr": "Corr($close, $volume, 12)", "cov": "Cov($close, $volume, 12)"}, 4)
panel_query("tsw42_48_constants", "daily", {"last": "LastValue($close)", "cmean": "CMean($close)", "cstd": "CStd($close)", "standard": "($close - CMean($close)) / CStd($close)", "winsor": "Less(Greater($close, CMean($close) - 3 * CStd($close)), CMean($close) + 3 * CStd($close))"})
panel_query("tsw49_53_returns", "daily", {"forward": "Ref($close, -2) / Ref($close, -1) - 1", "backward": "$close / Ref($close, 5) - 1"})
panel_query("tsw54_55_lagged_smoothing", "daily", {"gated": "If(Count($close, 5) >= 3, Std($close, 5), Std($close, 1))", "smooth": "Ref(Mean($close, 3), 2)"})

_MASK = {"own": "$close / Ref($close, 1) - 1"}


@query(
    "tsw39_mask",
    "with p as (" + panel_sql(panels.MONTHLY_BARS_SQL, _MASK) + ") select a.instrument, a.date, round(b.own, 6) + 0.0 as market from p a left join p b on b.date = a.date and b.instrument = 1",
)
def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TSW39: an expression of one instrument on every instrument's rows.  The one series is one row per date."""
    p = compile_panel(panels.monthly_bars(spark, sf_dir), _MASK)
    market = p.where("instrument = 1").select("date", F.col("own").alias("market"))
    return rounded(p.select("instrument", "date").join(market, "date", "left").select("instrument", "date", "market"))


@query(
    "tsw50_52_excess_return",
    "with p as (" + panel_sql(panels.DAILY_BARS_SQL, {"ret": "Ref($close, -2) / Ref($close, -1) - 1"}) + "), b as (select date, avg(ret) as bench from p group by date) "
    "select instrument, date, round(ret - bench, 6) + 0.0 as abnormal, round(ret - 0.02 / 252, 6) + 0.0 as excess from p join b using (date)",
)
def excess_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TSW50-TSW52, JOI07-JOI08: forward return less the benchmark's of the date, and less a daily rate."""
    p = compile_panel(panels.daily_bars(spark, sf_dir), {"ret": "Ref($close, -2) / Ref($close, -1) - 1"})
    bench = p.groupBy("date").agg(F.avg("ret").alias("bench"))
    out = p.join(bench, "date").select("instrument", "date", (F.col("ret") - F.col("bench")).alias("abnormal"), (F.col("ret") - 0.02 / 252).alias("excess"))
    return rounded(out)


# TSW56-TSW60: half-life weights; the weight of a row is 2 ** (row number / half-life), so that only ratios matter
_HALF = """
select instrument, date, round(case when rn >= 12 then m end, 6) + 0.0 as weighted_mean, round(case when rn >= 12 then sqrt(greatest(m2 - m * m, 0)) end, 6) + 0.0 as weighted_std from (
  select *, sum(x * pw) over w / nullif(sum(case when x is not null then pw end) over w, 0) as m, sum(x * x * pw) over w / nullif(sum(case when x is not null then pw end) over w, 0) as m2
  from (select *, power(2.0, rn / 4.0) as pw from (
    select instrument, date, close / lag(close) over (partition by instrument order by date) - 1 as x, row_number() over (partition by instrument order by date) as rn from (%s)))
  window w as (partition by instrument order by date rows between 11 preceding and current row))
"""


@query("tsw56_60_half_life", _HALF % panels.MONTHLY_BARS_SQL)
def half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TSW56-TSW60: rolling mean and standard deviation with half-life weights over full windows."""
    from tidepanel.operators.rolling import half_life_stats

    p = panels.monthly_bars(spark, sf_dir).withColumn("x", F.try_divide("close", F.lag("close").over(W.partitionBy("instrument").orderBy("date"))) - 1)
    return rounded(half_life_stats(p, "x", 12, 4.0).select("instrument", "date", "weighted_mean", "weighted_std"))


@query(
    "tsw61_62_range_liquidity",
    """
with r as (select instrument, date, volume, row_number() over o as rn, ln(close / nullif(lag(close) over o, 0)) as lr from (%s) window o as (partition by instrument order by date)),
s as (select *, sum(coalesce(lr, 0)) over (partition by instrument order by date) as p from r),
z as (select *, [lag(p, 9) over o, lag(p, 6) over o, lag(p, 3) over o, p] as ps, coalesce(lag(p, 12) over o, 0) as p0, sum(volume) over w as v, count(volume) over w as n
      from s window o as (partition by instrument order by date), w as (partition by instrument order by date rows between 11 preceding and current row))
select instrument, date, round(case when rn >= 12 then list_max(ps) - list_min(ps) end, 6) + 0.0 as cmra,
       round(case when n >= 9.6 and v > 0 then ln(v / (n / 3.0)) end, 6) + 0.0 as liquidity from z
"""
    % panels.MONTHLY_BARS_SQL,
)
def range_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TSW61-TSW62: range of cumulative log returns at the ends of periods, and log turnover per period."""
    from tidepanel.operators.rolling import cumulative_range, liquidity

    p = panels.monthly_bars(spark, sf_dir)
    own = W.partitionBy("instrument").orderBy("date")
    p = p.withColumn("lr", F.ln(F.try_divide("close", F.lag("close").over(own))))
    out = cumulative_range(p, "lr", periods=4, rows=3).withColumn("liquidity", liquidity("volume", 12, 3))
    return rounded(out.select("instrument", "date", "cmra", "liquidity"))


_CAPM = """
with b as (%s), r as (select instrument, date, close / lag(close) over (partition by instrument order by date) - 1 as y, row_number() over (partition by instrument order by date) as rn from b),
m as (select date, avg(y) as x from r group by date),
j as (select r.*, case when y is not null then m.x end as x, case when m.x is not null then r.y end as yy, power(2.0, rn / 6.0) as pw from r join m using (date)),
s as (select *, count(yy) over w as n, sum(case when yy is not null then pw end) over w as sw, sum(pw * x) over w as swx, sum(pw * yy) over w as swy, sum(pw * x * x) over w as swxx, sum(pw * x * yy) over w as swxy,
        sum(x) over w as sx, sum(yy) over w as sy, sum(x * x) over w as sxx, sum(x * yy) over w as sxy, sum(yy * yy) over w as syy
      from j window w as (partition by instrument order by date rows between 23 preceding and current row)),
f as (select *, (sw * swxy - swx * swy) / nullif(sw * swxx - swx * swx, 0) as beta from s),
g as (select *, (swy - beta * swx) / sw as alpha from f)
select instrument, date, round(case when ok then beta end, 5) + 0.0 as beta, round(case when ok then alpha end, 5) + 0.0 as alpha,
   round(case when ok then sqrt(greatest(((syy - 2 * beta * sxy + beta * beta * sxx) - (sy - beta * sx) * (sy - beta * sx) / n) / (n - 1), 0)) end, 5) + 0.0 as sigma
from (select *, rn >= 24 and n >= 19.2 as ok from g)
"""


@query("tsw63_65_rolling_capm", _CAPM % panels.MONTHLY_BARS_SQL)
def rolling_capm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TSW63-TSW65: rolling weighted regression on the market: beta, alpha and the residuals' deviation."""
    from tidepanel.operators.rolling import rolling_regression

    own = W.partitionBy("instrument").orderBy("date")
    r = panels.monthly_bars(spark, sf_dir).withColumn("y", F.try_divide("close", F.lag("close").over(own)) - 1).select("instrument", "date", "y")
    market = r.groupBy("date").agg(F.avg("y").alias("x"))
    return rounded(rolling_regression(r.join(market, "date"), "y", "x", 24, 6.0).select("instrument", "date", "beta", "alpha", "sigma"), 5)


for _name, _part in {
    "tai01_macd": indicators.macd(),
    "tai02_boll": indicators.boll(),
    "tai03_rsi": indicators.rsi(),
    "tai04_rsi_multi": indicators.rsi(6) | indicators.rsi(12) | indicators.rsi(24),
    "tai05_kdj": indicators.kdj(),
    "tai06_dmi": indicators.dmi(),
    "tai07_wr": indicators.wr(),
    "tai08_09_bias": indicators.bias(6) | indicators.bias(12) | indicators.bias(24),
    "tai10_cci": indicators.cci(),
    "tai11_roc": indicators.roc(),
}.items():
    panel_query(_name, "monthly", _part, 5)

panel_query("tai12_registry", "monthly", {k: v for k, v in indicators.registry().items() if k in ("label", "ma5", "boll_up", "rsi_14", "wr_10", "roc_12")})
panel_query("exp01_15_composites", "daily", {k.lower(): v for k, v in list(COMPOSITES.items())[:15]}, 5)
panel_query("exp16_24_candles", "daily", {k.lower(): v for k, v in list(COMPOSITES.items())[15:]})
_FAMILY = list(FAMILIES.items())
panel_query("exp25_34_price_family", "daily", {f"{k.lower()}{n}": e.format(n=n) for k, e in _FAMILY[:10] for n in WINDOWS}, 9)
panel_query("exp35_44_position_family", "daily", {f"{k.lower()}{n}": e.format(n=n) for k, e in _FAMILY[10:20] for n in WINDOWS}, 5)
_HANDLER = handler({"gap": "$open / Ref($close, 1) - 1"})
panel_query("mlb02_handler_rest", "daily", {k.lower(): e for k, e in _HANDLER.items() if k in PRICES or k in ("gap", "LABEL0") or k.rstrip("0123456789") in MORE_FAMILIES}, 5)
panel_query("exp45_48_volume_family", "daily", {f"{k.lower()}{n}": e.format(n=n) for k, e in _FAMILY[20:] for n in WINDOWS}, 5)
