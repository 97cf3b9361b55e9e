"""Queries of XSN, PIT, CNE, EVL, RSK, ALP, PFO, GPS, MLB and DQL rows of the inventory."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.functions.scalars import fiscal_year
from tidepanel.operators import cross, evaluate, pit, portfolio, risk, rolling, shaping
from tidepanel.plans.expression import compile_panel, panel_sql
from tidepanel.queries.base import panel_query, query, rounded, rounded_sql
from tidepanel.sources import panels
from tidepanel.sources.files import written
from tidepanel.sources.panels import table

D, M, K = panels.DAILY_BARS_SQL, panels.MONTHLY_BARS_SQL, panels.CLASSIFIED_SQL

for _method, _bounds in {
    "std": "avg(close) - 3 * stddev_samp(close) as lo, avg(close) + 3 * stddev_samp(close) as hi",
    "quantile": "quantile_cont(close, 0.01) as lo, quantile_cont(close, 0.99) as hi",
    "mad": "median(close) - 3 * 1.4826 * mad(close) as lo, median(close) + 3 * 1.4826 * mad(close) as hi",
}.items():

    def _winsor(spark: SparkSession, sf_dir: str, method: str = _method) -> DataFrame:
        """XSN01-XSN05, XSN14-XSN16: bounds per date."""
        return rounded(cross.winsorize(panels.daily_bars(spark, sf_dir).select("instrument", "date", "close"), "close", ["date"], method))

    query(f"xsn01_winsorize_{_method}", f"with p as ({D}), b as (select date, {_bounds} from p group by date) select instrument, date, round(case when lo is null then close else least(greatest(close, lo), hi) end, 6) + 0.0 as close from p join b using (date)")(_winsor)


@query("xsn06_07_standardize", rounded_sql(f"select instrument, date, (close - avg(close) over w) / nullif(stddev_samp(close) over w, 0) as z, (close - min(close) over w) / nullif(max(close) over w - min(close) over w, 0) as mm, least(greatest(close, 10), 90) as clip from ({D}) window w as (partition by date)", "z mm clip", "instrument, date"))
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XSN06-XSN07, XSN17-XSN18, MLB48: scores and min-max per date."""
    p = panels.daily_bars(spark, sf_dir)
    return rounded(p.select("instrument", "date", cross.zscore("close", ["date"]).alias("z"), cross.minmax("close", ["date"]).alias("mm"), F.least(F.greatest("close", F.lit(10.0)), F.lit(90.0)).alias("clip")))


_RESIDUAL = """
with k as (%s), c as (select instrument, date, industry, ln(close) as y, ln(circ_mv) as x from k where close > 0 and circ_mv > 0),
m as (select *, y - avg(y) over (partition by date, industry) as ym, x - avg(x) over (partition by date, industry) as xm from c),
s as (select *, coalesce(sum(ym * xm) over (partition by date) / nullif(sum(xm * xm) over (partition by date), 0), 0) as b from m)
select instrument, date, round(ym - b * xm, 5) + 0.0 as residual from s
"""


@query("xsn08_neutralize", _RESIDUAL % K)
def neutralize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XSN08-XSN11, XSN19, RSK03, RSK10, ALP09: residual on industry and log cap, by windows."""
    p = panels.classified_bars(spark, sf_dir).where("close > 0 and circ_mv > 0").select("instrument", "date", "industry", F.ln("close").alias("y"), F.ln("circ_mv").alias("x"))
    return rounded(cross.neutralized(p, "y", "x", "industry", ["date"], "residual").select("instrument", "date", "residual"), 5)


@query("xsn12_ols_t", f"select instrument, round(a, 5) as alpha, round(b, 5) as beta, round(case when n > 2 then b / nullif(sqrt(greatest((syy - b * sxy) / ((n - 2) * sxx), 0)), 0) end, 4) as t_beta from (select instrument, count(*) as n, regr_intercept(close, open) as a, regr_slope(close, open) as b, regr_syy(close, open) as syy, regr_sxy(close, open) as sxy, regr_sxx(close, open) as sxx from ({M}) group by 1)")
def ols_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XSN12, ALP05: regression with its t statistic as aggregates."""
    out = panels.monthly_bars(spark, sf_dir).groupBy("instrument").agg(*evaluate.ols_t("close", "open"))
    return out.select("instrument", F.round("alpha", 5).alias("alpha"), F.round("beta", 5).alias("beta"), F.round("t_beta", 4).alias("t_beta"))


_RANKED = "select *, rank() over (partition by date order by f) + (count(*) over (partition by date, f) - 1) / 2.0 as fr, rank() over (partition by date order by r) + (count(*) over (partition by date, r) - 1) / 2.0 as rr"
_FACTOR = {"f": "$close / Ref($close, 5) - 1", "r": "Ref($close, -2) / Ref($close, -1) - 1"}
_IC = f"with p as ({panel_sql(D, _FACTOR)}), q as ({_RANKED} from p where f is not null and r is not null), c as (select date, count(*) as n, case when stddev_samp(f) * stddev_samp(r) > 1e-12 then covar_samp(f, r) / (stddev_samp(f) * stddev_samp(r)) end as ic, case when stddev_samp(fr) * stddev_samp(rr) > 1e-12 then covar_samp(fr, rr) / (stddev_samp(fr) * stddev_samp(rr)) end as ric from q group by date)"


def _ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross.information_coefficients(compile_panel(panels.daily_bars(spark, sf_dir), _FACTOR), "f", "r", ["date"])


@query("evl01_information_coefficients", _IC + " select date, n, round(ic, 6) + 0.0 as ic, round(ric, 6) + 0.0 as ric from c")
def ic_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL01, EVL04, XSN20, TAI14-TAI15, GPS47, MLB47: Pearson and rank correlation per date."""
    return rounded(_ic(spark, sf_dir))


@query("evl02_05_summary", _IC + " select round(avg(ic), 6) as mean, round(stddev_samp(ic), 6) as std, round(coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0), 6) as ir, round(arg_max(ic, date), 6) as latest from c")
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL02, EVL05, EVL13-EVL14: mean, deviation, ratio, latest."""
    return rounded(evaluate.summary(_ic(spark, sf_dir)))


_BINS = f"""
with p as ({panel_sql(D, _FACTOR)}), v as (select * from p where f is not null and r is not null),
e as (select date, list_sort(list_distinct(quantile_cont(f, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) as edges from v group by date),
b as (select v.*, case when len(edges) > 1 then len(list_filter(edges[2:len(edges) - 1], lambda x: x < f)) end as bin from v join e using (date)),
s as (select date, bin, avg(r) as ret from b where bin is not null group by 1, 2)
"""


@query("evl03_06_stratified", _BINS + " select date, cast(bin as int) as bin, round(ret, 6) + 0.0 as ret from s")
def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL03, EVL06, AGG11: equal-frequency groups per date with repeated edges dropped."""
    return rounded(evaluate.stratified(compile_panel(panels.daily_bars(spark, sf_dir), _FACTOR), "f", "r", 5))


@query("evl06_long_short", _BINS + " select date, round(arg_max(ret, bin) - arg_min(ret, bin), 6) + 0.0 as long_short, round(arg_max(ret, bin) - avg(ret), 6) + 0.0 as long_average from s group by date")
def long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL06, EVL16: highest less lowest group."""
    return rounded(evaluate.long_short(evaluate.stratified(compile_panel(panels.daily_bars(spark, sf_dir), _FACTOR), "f", "r", 5)))


@query("evl07_10_decay", f"with b as ({D}), x as (" + " union all ".join(f"select {k} as lag, date, close / nullif(lag(close, 5) over w, 0) - 1 as f, lead(close, {k + 1}) over w / nullif(lead(close, {k}) over w, 0) - 1 as r from b window w as (partition by instrument order by date)" for k in (1, 2, 3, 4, 5)) + "), q as (select *, rank() over (partition by lag, date order by f) + (count(*) over (partition by lag, date, f) - 1) / 2.0 as fr, rank() over (partition by lag, date order by r) + (count(*) over (partition by lag, date, r) - 1) / 2.0 as rr from x where f is not null and r is not null), c as (select lag, date, case when stddev_samp(fr) * stddev_samp(rr) > 1e-12 then covar_samp(fr, rr) / (stddev_samp(fr) * stddev_samp(rr)) end as ric from q group by 1, 2) select lag, round(avg(ric), 6) + 0.0 as ric from c group by lag")
def decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL07-EVL10, EVL18-EVL19: rank correlation by lag, all lags in one pass."""
    p = compile_panel(panels.daily_bars(spark, sf_dir), {"f": "$close / Ref($close, 5) - 1", "price": "$close + 0"})
    return rounded(evaluate.decay(p, "f", "price", evaluate.decay_lags(5)))


@query("mlb79_return_statistics", f"with s as (select date, avg(close / open - 1) as ret from ({D}) where open > 0 group by date), c as (select *, sum(ret) over (order by date) as cum from s), d as (select *, cum - max(cum) over (order by date) as dd from c) select round(avg(ret), 5) as mean, round(stddev_samp(ret), 5) as std, round(avg(ret) * 252, 3) as annualized, round(avg(ret) / stddev_samp(ret) * sqrt(252), 5) as information_ratio, round(min(dd), 5) as max_drawdown from d")
def return_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLB79: return-series figures."""
    s = panels.daily_bars(spark, sf_dir).where("open > 0").groupBy("date").agg(F.avg(F.col("close") / F.col("open") - 1).alias("ret"))
    out = evaluate.return_statistics(s)
    return out.select(*(F.round(c, 3 if c == "annualized" else 5).alias(c) for c in out.columns))


def ttm_ctes(tag: str = "", where: str = "true") -> str:
    """CTEs that end in r<tag>: the trailing twelve months at each filing of a part of them."""
    return f"""
e{tag} as (select *, row_number() over (order by ann_date, seq) as t, period // 100 as y, period % 100 as q from ({panels.FILINGS_SQL}) where {where}),
a{tag} as (select e.*, p.value as annual from e{tag} e asof left join e{tag} p on e.instrument = p.instrument and p.period = (e.y - 1) * 100 + 4 and e.t >= p.t),
b{tag} as (select a.*, p.value as was from a{tag} a asof left join e{tag} p on a.instrument = p.instrument and p.period = a.period - 100 and a.t >= p.t),
r{tag} as (select instrument, ann_date, seq, period, case when q = 4 then value else value + annual - was end as ttm from b{tag})
"""


_TTM = "with " + ttm_ctes()


@query("pit02_ttm_events", _TTM + " select instrument, ann_date, seq, period, round(ttm, 4) + 0.0 as ttm from r where ttm is not null")
def ttm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIT01-PIT02, PIT05-PIT06, TSW46: trailing twelve months as known at each event."""
    return rounded(pit.ttm_events(panels.filings(spark, sf_dir)), 4)


@query("pit03_ttm_dense", _TTM + f", d as (select instrument, ann_date, arg_max(ttm, (period, seq)) as ttm from r where ttm is not null group by 1, 2), g as (select distinct l_suppkey // 4 as instrument, cast(date_trunc('month', l_shipdate) as date) as date from lineitem) select g.instrument, g.date, round(d.ttm, 4) + 0.0 as ttm from g asof left join d on g.instrument = d.instrument and g.date >= d.ann_date")
def ttm_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIT03-PIT04, PIT07-PIT08, TSW41: the same on a calendar."""
    grid = table(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate").select(F.floor(F.col("l_suppkey") / 4).alias("instrument"), F.to_date(F.trunc(F.to_date("l_shipdate"), "month")).alias("date")).distinct()
    return rounded(pit.ttm_on_dates(panels.filings(spark, sf_dir), grid), 4)


_FY = "year(date) - case when month(date) <= 4 then 2 else 1 end"
_ANNUAL = f"with a as (select instrument, {_FY} as fy, arg_min(close, date) as value from ({M}) group by 1, 2), r as (select *, row_number() over (partition by instrument order by fy) as rn from a), g as (select instrument, fy, value, case when count(value) over w >= 3 and abs(avg(value) over w) >= 1e-6 then (covar_samp(value, rn) over w / nullif(var_samp(rn) over w, 0)) / avg(value) over w end as growth, case when count(value) over w >= 3 and abs(avg(value) over w) >= 1e-6 then stddev_samp(value) over w / avg(value) over w end as cv from r window w as (partition by instrument order by fy rows between 4 preceding and current row))"


@query("pit12_14_annual_growth", _ANNUAL + " select instrument, fy, round(value, 6) as value, round(growth, 6) + 0.0 as growth, round(cv, 6) as cv from g")
def annual_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIT12-PIT14, PIT16-PIT18: first value of a fiscal year; slope and variation over five."""
    return rounded(pit.growth(pit.annual_values(panels.monthly_bars(spark, sf_dir), "close")))


@query("pit15_annual_to_daily", _ANNUAL + f" select b.instrument, b.date, round(g.growth, 6) + 0.0 as growth from ({M}) b left join g on g.instrument = b.instrument and g.fy = {_FY.replace('date', 'b.date')}")
def annual_to_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIT15, JOI16: annual values on days by fiscal year."""
    bars = panels.monthly_bars(spark, sf_dir)
    return rounded(pit.annual_to_daily(pit.growth(pit.annual_values(bars, "close")), bars.select("instrument", "date"), "growth"))


@query("pit19_22_adjust", f"with p as (select *, 1 + volume / 10.0 as f from ({D})) select a.instrument, a.date, round(a.close * a.f, 6) as close_hfq, round(a.close * a.f / e.f, 6) as close_qfq, round(a.volume / a.f, 6) as volume from p a join p e on e.instrument = a.instrument and e.date = date '2024-01-20'")
def adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIT19-PIT22: backward and forward adjusted prices."""
    p = panels.daily_bars(spark, sf_dir).withColumn("f", 1 + F.col("volume") / 10.0)
    return rounded(pit.adjust_prices(p, "f", "2024-01-20", ["close"], "volume").select("instrument", "date", "close_hfq", "close_qfq", "volume"))


@query("pit24_paused_runs", f"with p as (select *, volume <= 2 as paused from ({D})), g as (select *, sum(case when paused then 0 else 1 end) over (partition by instrument order by date) as island from p) select instrument, date, cast(sum(case when paused then 1 else 0 end) over (partition by instrument, island order by date) as bigint) as paused_days from g")
def paused_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIT23-PIT24: length of the run of quiet days up to each day."""
    p = panels.daily_bars(spark, sf_dir).withColumn("paused", F.col("volume") <= 2)
    number, place = shaping.run_length(F.col("paused"), ["instrument"], "date")
    return p.withColumn("island__", number).select("instrument", "date", place.alias("paused_days"))


# CNE01, CNE07, CNE17-CNE19: style factors that are plain expressions
panel_query("cne01_19_price_styles", "classified", {"lncap": "Log($circ_mv)", "volatility": "Std($close / Ref($close, 1) - 1, 20) * 15.874507866387544", "mom10": "($close / Ref($close, 10) - 1) * 100", "reversal5": "0 - ($close / Ref($close, 5) - 1) * 100", "mom_vol": "($close / Ref($close, 10) - 1) / Std($close / Ref($close, 1) - 1, 10)"}, 5)
# CNE20, CNE23-CNE25, CNE28-CNE30, CNE34, CNE38: ratios; the fixture's columns stand in for statement fields.
# etop and roa are ratios of one row's fields: CNE21 and CNE39, as CNE22 and CNE36, need TTM values and are open
panel_query("cne20_39_ratio_styles", "classified", {"btop": "($amount - $volume) / $circ_mv", "etop": "$open / $circ_mv", "em": "$amount / ($circ_mv + $high - $low)", "mlev": "(Ref($circ_mv, 1) + $volume + $high) / $circ_mv", "blev": "($amount + $volume + $high) / $amount", "dtoa": "$volume / $amount", "gpm": "($amount - $volume) / $amount", "roa": "$close / $amount", "accruals": "0 - (Delta($amount, 4) - $volume) / $amount"}, 5)
# CNE35 -(net income - operating cash flow + depreciation) / assets, CNE37 (sales - cost) / assets
panel_query("cne35_37_statement_ratios", "classified", {"acf": "0 - ($close - $open + $volume) / $amount", "gp": "($circ_mv - $volume) / $amount"}, 5)

_MIDCAP = """
with c as (select instrument, date, ln(circ_mv) as x from (%s) where circ_mv > 0), r as (select *, x * x * x as y from c),
s as (select *, regr_slope(y, x) over (partition by date) as b, avg(x) over (partition by date) as mx, avg(y) over (partition by date) as my from r),
e as (select instrument, date, y - my - b * (x - mx) as e from s), q as (select date, median(e) as m, mad(e) as d from e group by date),
w as (select instrument, date, case when d is null then e else least(greatest(e, m - 3 * 1.4826 * d), m + 3 * 1.4826 * d) end as e from e join q using (date))
select instrument, date, round((e - avg(e) over p) / nullif(stddev_samp(e) over p, 0), 4) + 0.0 as midcap from w window p as (partition by date)
"""


@query("cne02_midcap", _MIDCAP % K)
def midcap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNE02: cube of log cap less what log cap explains, bounded and scored per date."""
    p = panels.classified_bars(spark, sf_dir).where("circ_mv > 0").select("instrument", "date", F.ln("circ_mv").alias("x")).withColumn("y", F.col("x") * F.col("x") * F.col("x")).withColumn("g", F.lit("all"))
    e = cross.neutralized(p, "y", "x", "g", ["date"], "e").select("instrument", "date", "e")
    w = cross.winsorize(e, "e", ["date"], "mad")
    return rounded(w.select("instrument", "date", cross.zscore("e", ["date"]).alias("midcap")), 4)


@query("cne05_16_weighted_styles", f"with r as (select instrument, date, ln(close / nullif(lag(close) over o, 0)) as x, row_number() over o as rn from ({M}) window o as (partition by instrument order by date)), s as (select *, case when rn >= 18 then sum(x * power(2.0, rn / 6.0)) over w / nullif(sum(case when x is not null then power(2.0, rn / 6.0) end) over w, 0) end as m from r window w as (partition by instrument order by date rows between 17 preceding and current row)), t as (select *, avg(m) over (partition by instrument order by date rows between 2 preceding and current row) as sm from s) select instrument, date, round(lag(sm, 2) over (partition by instrument order by date), 6) + 0.0 as strength from t")
def weighted_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TSW55: half-life weighted relative strength, smoothed and lagged."""
    own = W.partitionBy("instrument").orderBy("date")
    p = panels.monthly_bars(spark, sf_dir).withColumn("x", F.ln(F.try_divide("close", F.lag("close").over(own)))).select("instrument", "date", "x")
    s = rolling.half_life_stats(p, "x", 18, 6.0).withColumn("sm", F.avg("weighted_mean").over(own.rowsBetween(-2, 0)))
    return rounded(s.select("instrument", "date", F.lag("sm", 2).over(own).alias("strength")))


@query("cne14_industry_momentum", rounded_sql(f"with p as (select instrument, date, industry, sqrt(circ_mv) as w, close / nullif(open, 0) - 1 as rs from ({K}) where circ_mv > 0), g as (select date, industry, sum(rs * w) / sum(w) as ind, sum(w) as sw from p where rs is not null group by 1, 2) select instrument, date, g.ind - p.rs * p.w / g.sw as indmom from p join g using (date, industry)", "indmom", "instrument, date"))
def industry_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNE43, AGG04: weighted industry mean less the own share."""
    p = panels.classified_bars(spark, sf_dir).where("circ_mv > 0").select("instrument", "date", "industry", F.sqrt("circ_mv").alias("w"), (F.try_divide("close", "open") - 1).alias("rs"))
    g = p.where("rs is not null").groupBy("date", "industry").agg(F.sum("w").alias("sw"), F.sum(F.col("rs") * F.col("w")).alias("s"))
    return rounded(p.join(g, ["date", "industry"]).select("instrument", "date", (F.try_divide("s", "sw") - F.try_divide(F.col("rs") * F.col("w"), F.col("sw"))).alias("indmom")))


def _factor_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = panels.classified_bars(spark, sf_dir)
    p = b.select("date", F.col("industry").alias("factor"), (F.try_divide("close", "open") - 1).alias("r"))
    return p.groupBy("date", "factor").agg(F.avg("r").alias("ret"))


_FR = f"select date, industry as factor, avg(close / nullif(open, 0) - 1) as ret from ({K}) group by 1, 2"
_COV = f"with fr as ({_FR}), cov as (select a.factor as i, b.factor as j, covar_samp(a.ret, b.ret) * 252 as v from fr a join fr b using (date) group by 1, 2)"


@query("rsk20_covariance", _COV + " select i, j, round(v, 4) + 0.0 as v from cov")
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSK20, RSK25, XSN22, ALP14: annualised sample covariance as a long table."""
    return rounded(risk.sample_covariance(_factor_returns(spark, sf_dir)), 4)


@query("rsk24_correlation", _COV + " select c.i, c.j, round(c.v / (sqrt(a.v) * sqrt(b.v)), 6) + 0.0 as v from cov c join cov a on a.i = c.i and a.j = c.i join cov b on b.i = c.j and b.j = c.j")
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSK04, RSK11, RSK23-RSK24."""
    return rounded(risk.correlation(risk.sample_covariance(_factor_returns(spark, sf_dir))))


@query("rsk21_ewma_covariance", f"with fr as ({_FR}), n as (select date, row_number() over (order by date desc) - 1 as age from (select distinct date from fr)), r as (select fr.*, power(0.5, age / 12.0) as w from fr join n using (date)) select a.factor as i, b.factor as j, round(sum(a.w * a.ret * b.ret) / sum(a.w) * 252, 4) + 0.0 as v from r a join r b using (date) group by 1, 2")
def ewma_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One half-life weighted second moment in closed form, a simplification; RSK21 itself is ``rsk21_barra_covariance``."""
    return rounded(risk.ewma_covariance(_factor_returns(spark, sf_dir), 12.0), 4)


@query("rsk21_barra_covariance")
def barra_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSK21-RSK22: correlations and variances by half-lives of 252 and 42 dates after 20 initial ones (checked against the recursion in tests)."""
    return rounded(risk.barra_covariance(_factor_returns(spark, sf_dir)), 4)


_DAY = "select max(date) from b"
_BOOK = f"with b as ({K}), t as (select * from b where date = (select max(date) from b)), e as (select instrument, industry as factor, 1.0 as x from t union all select instrument, 'size', ln(circ_mv) from t where circ_mv > 0), h as (select instrument, circ_mv / sum(circ_mv) over () - 1.0 / count(*) over () as h from t), d as (select instrument, 0.04 + circ_mv / 1e6 as d from t), f as (select i, j, case when i = j then 0.09 else 0.01 end as v from (select distinct factor as i from e) cross join (select distinct factor as j from e)), x as (select factor, sum(e.x * h) as x from e join h using (instrument) group by 1), fv as (select sum(a.x * v * c.x) as fv from f join x a on a.factor = i join x c on c.factor = j), sv as (select sum(h * h * d) as sv from d join h using (instrument))"


def _book(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Exposures, factor covariance, specific variance and active weights of the last date."""
    t = written(panels.last_bars(spark, sf_dir), "last")
    e = t.select("instrument", F.col("industry").alias("factor"), F.lit(1.0).alias("x")).unionByName(t.where("circ_mv > 0").select("instrument", F.lit("size").alias("factor"), F.ln("circ_mv").alias("x")))
    total = t.agg(F.sum("circ_mv").alias("s"), F.count("*").alias("n"))
    h = t.join(F.broadcast(total)).select("instrument", (F.col("circ_mv") / F.col("s") - 1.0 / F.col("n")).alias("h"))
    d = t.select("instrument", (0.04 + F.col("circ_mv") / 1e6).alias("d"))
    names = e.select("factor").distinct().agg(F.collect_set("factor").alias("all"))  # factors are tens of names
    f = names.select(F.explode("all").alias("i"), "all").select("i", F.explode("all").alias("j")).withColumn("v", F.when(F.col("i") == F.col("j"), 0.09).otherwise(0.01))
    return e, f, d, h


@query("rsk38_variance_parts", _BOOK + " select round(fv, 8) as factor_variance, round(sv, 8) as specific_variance, round(fv + sv, 8) as total, round(fv / (fv + sv), 6) as factor_share, round(sqrt(fv + sv), 6) as risk from fv, sv")
def variance_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSK34-RSK38, RSK43-RSK44, RSK50: factor and specific variance of active weights."""
    out = risk.variance_parts(*_book(spark, sf_dir))
    return out.select(*(F.round(c, 8 if "variance" in c or c == "total" else 6).alias(c) for c in out.columns))


@query("rsk41_42_factor_attribution", _BOOK + ", fx as (select i as factor, sum(v * x) as fx from f join x on factor = j group by 1) select x.factor, round(x, 6) + 0.0 as exposure, round(fx / sqrt(fv + sv), 6) + 0.0 as marginal, round(x * fx / sqrt(fv + sv), 6) + 0.0 as contribution from x join fx on x.factor = fx.factor, fv, sv")
def factor_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSK41-RSK42, RSK45: marginal and total contribution of factors."""
    return rounded(risk.factor_contributions(*_book(spark, sf_dir)))


@query("rsk39_40_asset_attribution", _BOOK + ", fx as (select i as factor, sum(v * x) as fx from f join x on factor = j group by 1), vh as (select instrument, sum(e.x * fx) as vh from e join fx using (factor) group by 1) select instrument, round((vh + d * h) / sqrt(fv + sv), 6) + 0.0 as marginal, round(h * (vh + d * h) / sqrt(fv + sv), 6) + 0.0 as contribution from vh join d using (instrument) join h using (instrument), fv, sv")
def asset_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSK39-RSK40: marginal contributions of assets, without an asset-by-asset matrix."""
    return rounded(risk.asset_contributions(*_book(spark, sf_dir)))


@query("rsk26_specific_variance", rounded_sql(f"with r as (select instrument, date, close / nullif(open, 0) - 1 as u from ({K})), s as (select *, avg(u * u) over (partition by date) as s from r) select instrument, date, s, u * u / nullif(s, 0) - 1 as v from s", "s v", "instrument, date"))
def specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSK26: date level and relative squares of residuals."""
    r = panels.classified_bars(spark, sf_dir).select("instrument", "date", (F.try_divide("close", "open") - 1).alias("residual"))
    return rounded(risk.specific_variance(r))


@query("rsk28_specific_risk")
def specific_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSK28: specific variance per instrument ahead, from residuals and two styles (checked against least squares in tests)."""
    k = panels.classified_bars(spark, sf_dir)
    x = k.where("circ_mv > 0 and volume > 0").select("instrument", "date", F.ln("circ_mv").alias("size"), F.ln("volume").alias("liquidity"))
    r = k.select("instrument", "date", (F.try_divide("close", "open") - 1).alias("residual"))
    return rounded(risk.forecast_specific_variance(r, x, ["size", "liquidity"]))


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.monthly_bars(spark, sf_dir).select("instrument", "date", F.try_divide("close", "open").alias("y"))


@query("rsk29_unit_roots", f"with p as (select instrument, date, close / nullif(open, 0) as y from ({M})), d as (select instrument, y - lag(y) over o as d, lag(y) over o as x from p where y is not null window o as (partition by instrument order by date)), s as (select instrument, count(*) as m, regr_slope(d, x) as b, regr_sxx(d, x) as sxx, regr_syy(d, x) - regr_slope(d, x) * regr_sxy(d, x) as rss from d where x is not null group by 1) select instrument, m + 1 as n, 0 as lags, round(b / sqrt(rss / (m - 2) / sxx), 5) + 0.0 as t, round(-2.86154 - 2.8903 / m - 4.234 / (m * m), 5) + 0.0 as critical_5 from s where m >= 3")
def unit_root_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSK29: Dickey-Fuller t of every instrument's series, from cross moments by key (lags by BIC: rsk27_32_series_models)."""
    from tidepanel.operators import arma

    return rounded(arma.unit_roots(_moves(spark, sf_dir), "instrument", 0).where("t is not null"), 5)


@query("rsk27_32_series_models")
def series_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSK27, RSK29-RSK32: lags, order, coefficients and next value of every instrument's series (checked against the form for one series in tests)."""
    from tidepanel.operators import arma
    from tidepanel.sources.files import written

    p = written(_moves(spark, sf_dir), "moves")
    models = arma.arma_models(p, "instrument").join(arma.unit_roots(p, "instrument").drop("n"), "instrument", "left")
    return rounded(models.drop("ar_coefs", "ma_coefs").join(arma.next_levels(p, "instrument"), "instrument", "left"))


_WLS = f"""
with x as (select instrument, date, industry, circ_mv, sqrt(circ_mv) as w, close / open - 1 as r, ln(circ_mv) as s from ({K}) where circ_mv > 0 and open > 0),
m as (select *, sum(w * r) over g / sum(w) over g as mr, sum(w * s) over g / sum(w) over g as ms from x window g as (partition by date, industry)),
a as (select *, case when abs(r - mr) <= 1e-12 * abs(r) then 0 else r - mr end as dr, case when abs(s - ms) <= 1e-12 * abs(s) then 0 else s - ms end as ds from m),
b as (select date, coalesce(sum(w * dr * ds) / nullif(sum(w * ds * ds), 0), 0) as slope from a group by date),
c as (select date, industry, sum(circ_mv) as cap, any_value(mr - slope * ms) as c from m join b using (date) group by 1, 2),
t as (select date, sum(cap * c) / sum(cap) as country from c group by date)
select date, industry as factor, round(c - country, 6) + 0.0 as ret from c join t using (date) union all select date, 'country', round(country, 6) + 0.0 from t union all select date, 'size', round(slope, 6) + 0.0 from b
"""


@query("rsk18_constrained_regression", _WLS)
def constrained_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSK17-RSK18, XSN13: factor returns per date under the industry constraint."""
    from tidepanel.operators.exposure import factor_returns

    p = panels.classified_bars(spark, sf_dir).where("circ_mv > 0 and open > 0").select("date", "industry", "circ_mv", (F.col("close") / F.col("open") - 1).alias("r"), F.ln("circ_mv").alias("size"))
    return rounded(factor_returns(p, "r", ["size"], "industry", "circ_mv"))


@query("alp01_03_alpha", rounded_sql(f"with k as (select instrument, date, close / nullif(open, 0) - 1 as g, 0.1 + volume / 1000 as o from ({K})) select instrument, date, o * 0.05 * (g - avg(g) over w) / nullif(stddev_samp(g) over w, 0) as alpha from k window w as (partition by date)", "alpha", "instrument, date"))
def alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALP01-ALP03: volatility times coefficient times score."""
    k = panels.classified_bars(spark, sf_dir).select("instrument", "date", (F.try_divide("close", "open") - 1).alias("g"), (0.1 + F.col("volume") / 1000).alias("o"))
    return rounded(portfolio.scaled_alpha(k, "g", "o", 0.05).select("instrument", "date", "alpha"))


@query("alp04_07_volatility", rounded_sql(f"with r as (select instrument, close / nullif(open, 0) - 1 as u, row_number() over (partition by instrument order by date desc) as k from ({K})) select instrument, count(u) as n, stddev_samp(u) as vol from r where k <= 36 group by 1", "vol", "instrument, n"))
def residual_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALP07 over 36 rows: deviation of the last rows per instrument."""
    w = W.partitionBy("instrument").orderBy(F.desc("date"))
    r = panels.classified_bars(spark, sf_dir).select("instrument", (F.try_divide("close", "open") - 1).alias("u"), F.row_number().over(w).alias("k")).where("k <= 36")
    return rounded(r.groupBy("instrument").agg(F.count("u").alias("n"), F.stddev_samp("u").alias("vol")))


@query("alp04_pooled_ic", f"with k as (select instrument, date, close / nullif(open, 0) - 1 as residual, (volume - avg(volume) over (partition by date)) / nullif(stddev_samp(volume) over (partition by date), 0) as z from ({K})), r as (select instrument, date, lead(residual) over (partition by instrument order by date) as nxt from k where residual is not null), p as (select k.date, z, nxt from k join r using (instrument, date) where z is not null and nxt is not null), d as (select count(*) as dates from (select distinct date from k where z is not null) join (select distinct date from r where nxt is not null) using (date)) select dates, (select count(*) from p) as n, round(case when dates >= 60 then (select corr(z, nxt) from p) end, 6) + 0.0 as ic from d")
def pooled_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALP04: correlation over all rows of the score with the residual ahead; the tables have some 80 dates, so 60 must do."""
    from tidepanel.operators import volatility

    k = panels.classified_bars(spark, sf_dir).select("instrument", "date", (F.try_divide("close", "open") - 1).alias("residual"), cross.zscore("volume", ["date"]).alias("z"))
    return rounded(volatility.pooled_ic(k, k, min_dates=60))


_VOL = f"""
with k as ({K}), r as (select instrument, date, close / nullif(open, 0) - 1 as u, row_number() over (partition by instrument order by date desc) as n from k),
h as (select instrument, count(u) as n, stddev_samp(case when n <= 200 then u end) as sd from r group by 1),
t as (select instrument, industry, case when circ_mv is not null then ln(greatest(circ_mv, 1)) end as x from k where date = (select max(date) from k)),
p as (select h.*, t.industry, t.x, h.n >= 60 as old from h left join t using (instrument)),
f as (select * from p where old and sd is not null and x is not null),
g as (select industry, count(*) as size, avg(sd) as my, avg(x) as mx, covar_pop(x, sd) * count(*) as sxy, var_pop(x) * count(*) as sxx from f group by 1),
s as (select coalesce(sum(size), 0) as fitted, coalesce(sum(sxy) / nullif(sum(sxx), 0), 0) as slope, arg_min(my, industry) as by_, arg_min(mx, industry) as bx from g),
m as (select median(sd) as middle from p where old)
select instrument, n, method, round(case when method = 'history' then sd when method = 'regression' then greatest(guess, 0.001) else middle end, 6) + 0.0 as omega from (
  select p.instrument, p.n, p.sd, middle, coalesce(g.my, by_) + slope * (p.x - coalesce(g.mx, bx)) as guess, case when p.old then 'history' when fitted >= 20 and p.x is not null then 'regression' else 'median' end as method
  from p left join g on g.industry = p.industry, s, m) where case when method = 'history' then sd when method = 'regression' then guess else middle end is not null
"""


@query("alp06_10_residual_volatility", _VOL)
def old_and_new_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALP06-ALP11: history of 200 rows for old names, regression or median for new ones; 60 dates make a name old here."""
    from tidepanel.operators import volatility

    k = panels.classified_bars(spark, sf_dir)
    r = k.select("instrument", "date", (F.try_divide("close", "open") - 1).alias("residual"))
    return rounded(volatility.residual_volatility(r, k, min_days=60, min_old=20))


_BLEND = {"a": "$close / Ref($close, 3) - 1", "b": "Std($close, 5) / Mean($close, 5)", "c": "Log($volume)", "nxt": "Ref($close, -2) / Ref($close, -1) - 1"}


@query(
    "alp12_19_orthogonal_blend",
    f"with p as (select * from ({panel_sql(D, _BLEND)}) where a is not null and b is not null and c is not null), s as (select avg(a) as ma, avg(b) as mb, avg(c) as mc, var_samp(a) + 1e-10 as aa, var_samp(b) + 1e-10 as bb, var_samp(c) + 1e-10 as cc, covar_samp(a, b) as ab, covar_samp(a, c) as ac, covar_samp(b, c) as bc from p), "
    "l1 as (select *, sqrt(aa) as l11, ab / sqrt(aa) as l21, ac / sqrt(aa) as l31 from s), l2 as (select *, sqrt(bb - l21 * l21) as l22 from l1), l3 as (select *, (bc - l31 * l21) / l22 as l32 from l2), l4 as (select *, sqrt(cc - l31 * l31 - l32 * l32) as l33 from l3), "
    "y1 as (select p.*, l4.* exclude (ma, aa, ab, ac), (a - ma) / l11 as u from p, l4), y2 as (select *, (b - mb - l21 * u) / l22 as v from y1), y3 as (select *, (c - mc - l31 * u - l32 * v) / l33 as w from y2), g as (select coalesce(corr(u, nxt), 0) as gu, coalesce(corr(v, nxt), 0) as gv, coalesce(corr(w, nxt), 0) as gw from y3 where nxt is not null) select instrument, date, round(gu * u + gv * v + gw * w, 5) + 0.0 as alpha from y3, g",
)
def blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALP12-ALP21: whitened signals weighted by their correlation with the return ahead."""
    return rounded(portfolio.orthogonal_blend(compile_panel(panels.daily_bars(spark, sf_dir), _BLEND), ["a", "b", "c"], "nxt"), 5)


_AS_OF = {"a": "$close / Ref($close, 3) - 1", "b": "Std($close, 5) / Mean($close, 5)"}
_AS_OF_RESIDUAL = {"residual": "$close / Ref($close, 1) - 1"}


@query(
    "alp12_19_blend_as_of",
    f"""
with p as (select * from ({panel_sql(K, _AS_OF)}) where a is not null and b is not null),
h as (select * from p where date < date '1998-06-01'),
e as (select instrument, date, lead(residual) over o as next, lead(date) over o as told from ({panel_sql(K, _AS_OF_RESIDUAL)}) where residual is not null window o as (partition by instrument order by date)),
d as (select date, row_number() over (order by date) as i from (select distinct date from h)),
w as (select x.date as as_of, x.i, y.date from d x join d y on y.i > x.i - 24 and y.i <= x.i),
s as (select as_of, avg(a) as ma, avg(b) as mb, sqrt(var_samp(a) + 1e-10) as l11, covar_samp(a, b) / sqrt(var_samp(a) + 1e-10) as l21, var_samp(b) + 1e-10 as bb from w join h using (date) group by as_of),
f as (select *, sqrt(bb - l21 * l21) as l22 from s),
y as (select as_of, h.date, next, (a - ma) / l11 as u, (b - mb - l21 * (a - ma) / l11) / l22 as v from w join h using (date) join e using (instrument, date) join f using (as_of) where next is not null and told <= as_of),
g as (select as_of, corr(u, next) as gu, corr(v, next) as gv, count(distinct date) as n from y group by as_of having count(distinct date) >= 12),
c as (select p.instrument, p.date, p.a, p.b, max(g.as_of) as as_of from p join g on g.as_of <= p.date group by all)
select instrument, date, as_of, round(gu * (a - ma) / l11 + gv * (b - mb - l21 * (a - ma) / l11) / l22, 5) + 0.0 as alpha from c join f using (as_of) join g using (as_of)
""",
)
def blend_of_each_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALP12-ALP19: factor and weights of each date from 24 dates up to it; the history ends before the current days do, which take its newest factor."""
    from tidepanel.operators.blend import blend_as_of, blend_factors

    k = panels.classified_bars(spark, sf_dir)
    signals = compile_panel(k, _AS_OF)
    factors = blend_factors(signals.where("date < date '1998-06-01'"), compile_panel(k, _AS_OF_RESIDUAL), ["a", "b"], window=24, min_dates=12)
    return rounded(blend_as_of(signals, factors, ["a", "b"]), 5)


@query("pfo03_benchmark_neutral", rounded_sql(f"with k as (select instrument, date, close / nullif(open, 0) - 1 as alpha, 1.0 + volume / 1000 as beta, circ_mv / sum(circ_mv) over (partition by date) as b from ({K})) select instrument, date, alpha - beta * sum(b * alpha) over (partition by date) as alpha_n from k", "alpha_n", "instrument, date"))
def benchmark_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PFO03: alpha without the benchmark's own."""
    k = panels.classified_bars(spark, sf_dir).select("instrument", "date", (F.try_divide("close", "open") - 1).alias("alpha"), (1.0 + F.col("volume") / 1000).alias("beta"), F.try_divide("circ_mv", F.sum("circ_mv").over(W.partitionBy("date"))).alias("b"))
    return rounded(portfolio.benchmark_neutral(k).select("instrument", "date", "alpha_n"))


@query("pfo10_11_trades", f"with k as (select *, lag(w) over (partition by instrument order by date) as c from (select instrument, date, close, amount / nullif(sum(amount) over (partition by date), 0) as w from ({D}))), d as (select instrument, date, close, w - coalesce(c, 0) as x from k) select instrument, date, case when x > 1e-5 then 'buy' when x < -1e-5 then 'sell' else 'hold' end as side, round(case when abs(x) > 1e-5 then abs(x) * 1e7 else 0 end, 4) as amount, cast(case when close > 0 and abs(x) > 1e-5 then floor(round(abs(x) * 1e7 / (close * 100), 7)) * 100 else 0 end as bigint) as shares from d")
def trade_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PFO10-PFO11: sides, amounts and whole lots from weight changes."""
    w = F.try_divide("amount", F.sum("amount").over(W.partitionBy("date")))
    k = panels.daily_bars(spark, sf_dir).select("instrument", "date", F.col("close").alias("price"), w.alias("target"))
    k = k.withColumn("current", F.coalesce(F.lag("target").over(W.partitionBy("instrument").orderBy("date")), F.lit(0.0)))
    return portfolio.trades(k, 1e7).select("instrument", "date", "side", F.round("amount", 4).alias("amount"), "shares")


@query("gps05_07_fitness", f"with p as ({panel_sql(D, {'a': '$close / Ref($close, 5) - 1', 'b': 'Std($close, 5)', 'r': 'Ref($close, -2) / Ref($close, -1) - 1'})}), l as (select 'a' as expr, date, a as f, r from p union all select 'b', date, b, r from p), q as (select *, rank() over (partition by expr, date order by f) + (count(*) over (partition by expr, date, f) - 1) / 2.0 as fr, rank() over (partition by expr, date order by r) + (count(*) over (partition by expr, date, r) - 1) / 2.0 as rr from l where f is not null and r is not null), c as (select expr, date, case when stddev_samp(fr) * stddev_samp(rr) > 1e-12 then covar_samp(fr, rr) / (stddev_samp(fr) * stddev_samp(rr)) end as ric from q group by 1, 2) select expr, round(abs(avg(ric)), 6) as fitness from c group by 1")
def fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPS05-GPS11: many expressions scored by one scan and one grouping."""
    exprs = {"a": "$close / Ref($close, 5) - 1", "b": "Std($close, 5)", "r": "Ref($close, -2) / Ref($close, -1) - 1"}
    p = compile_panel(panels.daily_bars(spark, sf_dir), exprs)
    long = p.unpivot(["date", "r"], ["a", "b"], "expr", "f")
    ic = cross.information_coefficients(long, "f", "r", ["expr", "date"])
    return rounded(ic.groupBy("expr").agg(F.abs(F.avg("ric")).alias("fitness")))


_PENALISED = {"a": "$close / Ref($close, 5) - 1", "b": "Std($close, 5)", "c": "Ref($close, 20) / Ref($close, 25)", "d": "$volume - $volume"}
_SCREENED = {"a": "$close / Ref($close, 5) - 1", "b": "$close / Ref($close, 6) - 1", "c": "Log($volume)"}
_AHEAD = {"r": "Ref($close, -2) / Ref($close, -1) - 1"}


def _scored(exprs: dict[str, str], where: str) -> str:
    """CTE c: rank correlation per expression and date."""
    return f"with p as (select * from ({panel_sql(D, exprs | _AHEAD)}) where {where}), l as ({' union all '.join(f"select '{k}' as expr, instrument, date, {k} as f, r from p" for k in exprs)}), q as (select *, rank() over (partition by expr, date order by f) + (count(*) over (partition by expr, date, f) - 1) / 2.0 as fr, rank() over (partition by expr, date order by r) + (count(*) over (partition by expr, date, r) - 1) / 2.0 as rr from l where f is not null and r is not null), c as (select expr, date, case when stddev_samp(fr) * stddev_samp(rr) > 1e-12 then covar_samp(fr, rr) / (stddev_samp(fr) * stddev_samp(rr)) end as ric from q group by 1, 2)"


@query("gps05_08_penalised_fitness", _scored(_PENALISED, "true") + ", s as (select expr, avg(case when f is null then 1.0 else 0 end) as gone, stddev_samp(f) as sd from l group by 1), i as (select expr, abs(avg(ric)) as fit from c group by 1), d as (select * from (values ('a', 3), ('b', 1), ('c', 2), ('d', 1)) v(expr, depth)) select expr, round(case when gone <= 0.5 and coalesce(sd, 0) > 1e-5 and coalesce(fit, 0) > 0 then fit - 0.005 * depth else 0 end, 6) + 0.0 as fitness from s left join i using (expr) join d using (expr)")
def penalised_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPS05-GPS08: a generation scored in one pass, less a penalty per level of the tree; mostly missing or constant values score nothing."""
    from tidepanel.plans.expression import parse
    from tidepanel.plans.search import depth, score_batch

    exprs = list(_PENALISED.values())
    got = score_batch(panels.daily_bars(spark, sf_dir), exprs, _AHEAD["r"])
    rows = [(k, round(got[e] - 0.005 * depth(parse(e)), 6) if got[e] else 0.0) for k, e in _PENALISED.items()]
    return spark.createDataFrame(rows, "expr string, fitness double")


@query("gps09_29_screening", _scored(_SCREENED, "date >= date '2024-01-15'") + ", i as (select expr, avg(ric) as ric, avg(ric) / nullif(stddev_samp(ric), 0) as ricir from c group by 1), k as (select abs(corr(a, b)) as ab, abs(corr(a, c)) as ac, abs(corr(b, c)) as bc from p), o as (select (select ac from k) < 0.7 as c_a, (select ab from k) < 0.7 as b_a, (select bc from k) < 0.7 as b_c) select expr, round(ric, 6) + 0.0 as ric, round(ricir, 6) + 0.0 as ricir, case when expr = 'a' then true when expr = 'b' then b_a else c_a and (b_c or not b_a) end as kept from i, o")
def screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPS09-GPS11, GPS28-GPS29: figures on the test dates, and going down the list what correlates too much with a kept one is left out."""
    from tidepanel.plans.search import uncorrelated

    bars = panels.daily_bars(spark, sf_dir)
    p = compile_panel(bars, _SCREENED | _AHEAD).where("date >= date '2024-01-15'")
    long = p.unpivot(["instrument", "date", "r"], list(_SCREENED), "expr", "f")
    ic = cross.information_coefficients(long, "f", "r", ["expr", "date"]).groupBy("expr").agg(F.avg("ric").alias("ric"), F.try_divide(F.avg("ric"), F.nullif(F.stddev_samp("ric"), F.lit(0.0))).alias("ricir"))
    kept = uncorrelated(bars, list(_SCREENED.values()), 0.7, F.col("date") >= "2024-01-15")
    return rounded(ic.withColumn("kept", F.col("expr").isin([k for k, e in _SCREENED.items() if e in kept])))


_MANY = {f"m{n}": f"$close / Mean($close, {n}) - 1" for n in (3, 5, 10)} | {f"v{n}": f"Std($volume, {n})" for n in (5, 10)} | {f"r{n}": f"If($close > $open, Ref($close, {n}), Ref($close, {n}) / ($volume - $volume))" for n in (1, 4)}


@query(
    "gps28_correlation_matrix",
    f"with p as ({panel_sql(D, _MANY)}), k as ({' union all '.join(f'''select {i} as a, {j} as b, count(*) filter (where {a} is not null and {b} is not null) as n, case when stddev_samp(case when {b} is not null then {a} end) * stddev_samp(case when {a} is not null then {b} end) > 1e-12 then corr({a}, {b}) end as corr from p''' for i, a in enumerate(_MANY) for j, b in enumerate(_MANY) if i > j)}) select a::int as a, b::int as b, n, round(corr, 6) + 0.0 as corr from k",
)
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPS28-GPS29: correlations of all pairs of expressions over the rows that have both, by blocked matrix products."""
    from tidepanel.operators.gram import correlation_pairs

    return rounded(correlation_pairs(compile_panel(panels.daily_bars(spark, sf_dir), _MANY), list(_MANY)))


@query("gps01_27_search")
def expression_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPS01-GPS04, GPS12-GPS21, GPS25-GPS27, GPS48: two islands bred for two generations, saved after the first and taken up again (same seed, same result; the parts are checked in tests)."""
    from tidepanel.plans.search import Search
    from tidepanel.sources.files import scratch, written

    bars = written(panels.daily_bars(spark, sf_dir), "bars")
    make = lambda: Search(bars, "Ref($close, -2) / Ref($close, -1) - 1", ["$close", "$open", "$volume", "$high / $low"], islands=2, size=8, height=4, seed=3)
    at, first, second = scratch(spark, "search"), make(), make()
    first.run(1)
    first.save(at)
    second.load(at)
    return rounded(spark.createDataFrame(second.run(2), "expr string, fitness double"))


@query("mlb01_09_sequences", f"with p as (select instrument, date, close, row_number() over (partition by instrument order by date) as rn, list(close) over (partition by instrument order by date rows between 4 preceding and current row) as seq, lead(close, 2) over (partition by instrument order by date) / nullif(lead(close, 1) over (partition by instrument order by date), 0) - 1 as label from ({D})) select instrument, date, case when date < date '2024-01-16' then 'train' when date < date '2024-01-23' then 'valid' else 'test' end as segment, round(list_sum(seq), 6) as total, round(label, 6) + 0.0 as label from p where rn >= 5")
def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLB01-MLB09, MLB20-MLB21: fixed-length sequences per row with a label and its segment by date."""
    own = W.partitionBy("instrument").orderBy("date")
    p = compile_panel(panels.daily_bars(spark, sf_dir), {"x": "$close + 0", "label": "Ref($close, -2) / Ref($close, -1) - 1"})
    seq = F.collect_list("x").over(own.rowsBetween(-4, 0))
    p = p.withColumn("seq", seq).where(F.size("seq") == 5)
    segment = F.when(F.col("date") < "2024-01-16", "train").when(F.col("date") < "2024-01-23", "valid").otherwise("test")
    return rounded(p.select("instrument", "date", segment.alias("segment"), F.aggregate("seq", F.lit(0.0), lambda a, x: a + x).alias("total"), "label"))


@query("mlb24_topk_dropout")
def topk_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLB24, MLB69-MLB76: daily top-k portfolio that swaps its worst names, without costs, price limits or a least holding time; sequential over the dates of one portfolio."""
    from tidepanel.operators.backtest import topk_dropout as run

    p = compile_panel(panels.daily_bars(spark, sf_dir), {"score": "Mean($close, 5)", "ret": "Ref($close, -2) / Ref($close, -1) - 1"})
    return rounded(run(p, topk=20, n_drop=3))


@query("mlb62_68_linear_model", f"select round(regr_slope(close, open), 6) as slope, round(regr_intercept(close, open), 5) as intercept from ({M})")
def linear_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slope of the OLS in MLB68: normal equations from sums over all rows, solved on the driver; RSK28 is ``rsk28_specific_risk``."""
    p = panels.monthly_bars(spark, sf_dir)
    s = p.agg(F.count("*").alias("n"), F.sum("open").alias("sx"), F.sum("close").alias("sy"), F.sum(F.col("open") * F.col("open")).alias("sxx"), F.sum(F.col("open") * F.col("close")).alias("sxy")).first()
    b, a = np.linalg.solve([[s["sxx"], s["sx"]], [s["sx"], s["n"]]], [s["sxy"], s["sy"]])
    return spark.range(1).select(F.round(F.lit(float(b)), 6).alias("slope"), F.round(F.lit(float(a)), 5).alias("intercept"))


@query("dql04_reconcile", f"with a as (select * from ({D}) where instrument % 7 <> 0), b as (select instrument, date, case when instrument % 5 = 0 then close * 1.01 else close end as close from ({D}) where instrument % 11 <> 0) select coalesce(a.instrument, b.instrument) as instrument, coalesce(a.date, b.date) as date, case when b.instrument is null then 'missing' when a.instrument is null then 'extra' when a.close is not distinct from b.close or abs(a.close - b.close) <= 1e-4 * greatest(abs(a.close), abs(b.close)) then 'equal' else 'different' end as status from a full join b on a.instrument = b.instrument and a.date = b.date")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL03-DQL14: cell by cell comparison of two stores."""
    bars = panels.daily_bars(spark, sf_dir).select("instrument", "date", "close")
    b = bars.where("instrument % 11 <> 0").withColumn("close", F.when(F.col("instrument") % 5 == 0, F.col("close") * 1.01).otherwise(F.col("close")))
    return shaping.reconcile(bars.where("instrument % 7 <> 0"), b, ["instrument", "date"], ["close"])


@query("dql22_23_membership", f"select instrument, min(date) as start, case when max(date) = (select max(date) from ({D})) then date '2999-12-31' else max(date) end as stop from ({D}) group by 1")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL22-DQL23: membership intervals, open ones extended."""
    bars = panels.daily_bars(spark, sf_dir).select("instrument", "date")
    last = bars.agg(F.max("date").alias("last"))  # one row
    m = bars.groupBy("instrument").agg(F.min("date").alias("start"), F.max("date").alias("stop")).join(F.broadcast(last))
    return m.select("instrument", "start", F.when(F.col("stop") == F.col("last"), F.lit("2999-12-31").cast("date")).otherwise(F.col("stop")).alias("stop"))


@query("ops18_spread_ratio", rounded_sql(f"select date, stddev_samp(g) / nullif(stddev_samp(g / nullif(o, 0)), 0) as cg from (select date, close / nullif(open, 0) - 1 as g, 0.1 + volume / 1000 as o from ({K})) group by date", "cg", "date"))
def spread_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OPS18: deviation of the signal over that of the signal per volatility."""
    k = panels.classified_bars(spark, sf_dir).select("date", (F.try_divide("close", "open") - 1).alias("g"), (0.1 + F.col("volume") / 1000).alias("o"))
    return rounded(k.groupBy("date").agg(F.try_divide(F.stddev_samp("g"), F.nullif(F.stddev_samp(F.try_divide("g", "o")), F.lit(0.0))).alias("cg")))


@query("mlb20_32_tree_scores")
def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLB10-MLB11, MLB20-MLB23, MLB25-MLB29, MLB31-MLB32, MLB37: boosted trees fitted once per rolling date window; no finetune."""
    from tidepanel.operators.models import rolling_scores

    exprs = {"a": "$close / Ref($close, 3) - 1", "b": "Std($close, 5)", "c": "Rank($close, 5)", "y": "Ref($close, -2) / Ref($close, -1) - 1"}
    p = compile_panel(panels.daily_bars(spark, sf_dir), exprs)
    windows = [(("2024-01-01", "2024-01-14"), ("2024-01-15", "2024-01-20")), (("2024-01-01", "2024-01-20"), ("2024-01-21", "2024-01-30"))]
    return rounded(rolling_scores(p, ["a", "b", "c"], "y", windows, trees=5, depth=3))


@query("mlb11_continued_boosting")
def continued_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLB11: boosting that goes on with later dates (its error there falls in tests)."""
    from tidepanel.operators.models import continued_scores

    exprs = {"a": "$close / Ref($close, 3) - 1", "b": "Std($close, 5)", "y": "Ref($close, -2) / Ref($close, -1) - 1"}
    p = compile_panel(panels.daily_bars(spark, sf_dir), exprs)
    return rounded(continued_scores(p, ["a", "b"], "y", ("2024-01-01", "2024-01-14"), ("2024-01-15", "2024-01-20"), ("2024-01-21", "2024-01-30"), 5, 3, 3))


_SHIFTED = f"with b as ({D}), c as (select date, row_number() over (order by date) - 1 as idx from (select distinct date from b)), h as (select 1 as horizon union all select 5) select instrument, t.date, horizon, close as score from b join c using (date) cross join h join c t on t.idx = c.idx + horizon"


@query("mlb38_merge_horizons", _SHIFTED)
def merge_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLB38: scores moved on the calendar by their horizon and put together."""
    from tidepanel.operators.models import merge_horizons as merge

    p = panels.daily_bars(spark, sf_dir).select("instrument", "date", F.col("close").alias("score"))
    days = p.select("date").distinct().withColumn("idx", F.row_number().over(W.orderBy("date")) - 1)  # one row per trading day
    return merge({1: p, 5: p}, days)
