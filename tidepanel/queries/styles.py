"""Queries of the named style factors (CNE).  The tables have some 80 months, so windows count months here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators import pit, rolling, styles
from tidepanel.operators.styles import Strength
from tidepanel.queries.analytics import ttm_ctes
from tidepanel.queries.base import query, rounded, rounded_sql
from tidepanel.sources import panels

K = panels.CLASSIFIED_SQL
RATE = 0.02 / 252


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward returns, log strength against the market of the date, excess returns and turnover."""
    r = panels.classified_bars(spark, sf_dir).withColumn("ret", styles.forward_return())
    market = r.groupBy("date").agg(F.avg("ret").alias("bench"))
    r = r.join(market, "date")
    return r.select("*", (F.ln(1 + F.col("ret")) - F.ln(1 + F.col("bench"))).alias("rs"), F.ln(1 + F.col("ret")).alias("lr"), (F.col("ret") - RATE).alias("ex"), (F.col("bench") - RATE).alias("mx"), F.try_divide("amount", "circ_mv").alias("turn"))


_X = f"""
with k as ({K}), r as (select *, lead(close, 2) over o / nullif(lead(close, 1) over o, 0) - 1 as ret, row_number() over o as rn from k window o as (partition by instrument order by date)),
b as (select date, avg(ret) as bench from r group by date),
x as (select r.*, ln(1 + ret) - ln(1 + bench) as rs, ln(1 + ret) as lr, ret - {RATE} as ex, bench - {RATE} as mx, amount / nullif(circ_mv, 0) as turn from r join b using (date))
"""


def _half(column: str, s: Strength) -> str:
    """CTE h: weighted mean and deviation of a column of x."""
    return f""", h as (select *, case when rn >= {s.window} then sum({column} * pw) over w / nullif(sum(case when {column} is not null then pw end) over w, 0) end as wm,
  case when rn >= {s.window} then sum({column} * {column} * pw) over w / nullif(sum(case when {column} is not null then pw end) over w, 0) end as wq
  from (select *, power(2.0, rn / {float(s.half_life)}) as pw from x) window w as (partition by instrument order by date rows between {s.window - 1} preceding and current row))"""


def _settle(column: str, source: str, s: Strength, name: str) -> str:
    smooth = f"select instrument, date, avg({column}) over (partition by instrument order by date rows between {s.smooth - 1} preceding and current row) as sm from {source}"
    return f"select instrument, date, round({s.sign} * lag(sm, {s.lag}) over (partition by instrument order by date), 6) + 0.0 as {name} from ({smooth})"


def _strength(name: str, label: str, column: str, s: Strength) -> None:
    @query(f"{name}_{label}", _X + _half(column, s) + " " + _settle("wm", "h", s, label))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(styles.strength(_panel(spark, sf_dir), column, s, label).select("instrument", "date", label))

    run.__doc__ = f"{name.upper()}: half-life weighted mean of {column}, {s}."


_strength("cne12", "strev", "rs", Strength(6, 2, 3, 1, -1))
_strength("cne15", "rstr", "rs", Strength(12, 6, 11, 11))
_strength("cne24", "ltrstr", "rs", Strength(24, 8, 11, 13, -1))
_strength("cne11", "atvr", "turn", Strength(12, 3))

_DAS = Strength(12, 4)


@query("cne05_dastd", _X + _half("ex", _DAS) + " select instrument, date, round(case when wm is not null then sqrt(252) * sqrt(greatest(wq - wm * wm, 0)) end, 5) + 0.0 as dastd from h")
def dastd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNE05: annualised half-life weighted deviation of excess returns."""
    return rounded(styles.deviation(_panel(spark, sf_dir), "ex", _DAS, "dastd").select("instrument", "date", "dastd"), 5)


_CMRA = (
    _X
    + """, p as (select *, sum(coalesce(ln(1 + ex), 0)) over u as p, count(ex) over (partition by instrument order by date rows between 11 preceding and current row) as n from x window u as (partition by instrument order by date)),
q as (select *, ["""
    + ", ".join(f"case when rn >= 12 then {f'lag(p, {12 - 3 * j}) over o' if j < 4 else 'p'} else coalesce(max(case when rn = {3 * j} then p end) over o, p) end" for j in (1, 2, 3, 4))
    + "] as ends from p window o as (partition by instrument order by date)) select instrument, date, round(case when n >= 9 then list_max(ends) - list_min(ends) end, 6) + 0.0 as cmra from q"
)


@query("cne06_cmra", _CMRA)
def cmra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNE06: range of cumulative log excess returns at the ends of periods, four fifths of the window being enough."""
    p = _panel(spark, sf_dir).withColumn("lx", F.ln(1 + F.col("ex")))
    return rounded(rolling.cumulative_range(p, "lx", 4, 3, min_valid=int(12 * 0.8)).select("instrument", "date", "cmra"))


_TURNS = {"stom": 3, "stoq": 6, "stoa": 12}


@query(
    "cne08_10_turnover",
    _X + " select instrument, date, " + ", ".join(f"round(case when rn >= {n} and count(turn) over w{n} >= {0.8 * n} and sum(turn) over w{n} > 0 then ln(sum(turn) over w{n} / (count(turn) over w{n} / 3.0)) end, 6) + 0.0 as {k}" for k, n in _TURNS.items())
    + " from x window " + ", ".join(f"w{n} as (partition by instrument order by date rows between {n - 1} preceding and current row)" for n in _TURNS.values()),
)
def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNE08-CNE10: log turnover per month over one month, one quarter and one year of full windows (three rows make a month here)."""
    p = _panel(spark, sf_dir).withColumn("rn", F.row_number().over(styles._own()))
    return rounded(p.select("instrument", "date", *(F.when(F.col("rn") >= n, rolling.liquidity("turn", n, 3)).alias(k) for k, n in _TURNS.items())))


@query(
    "cne13_season",
    _X + """, m as (select instrument, year(date) as y, month(date) as m, count(ret) as n, sum(ret) as s, sum(ret * ret) as ss from x group by 1, 2, 3),
p as (select a.instrument, a.y, a.m, sum(h.n) as n, sum(h.s) as s, sum(h.ss) as ss from m a join m h on h.instrument = a.instrument and h.m = a.m % 12 + 1 and h.y between a.y - 5 and a.y - 1 group by 1, 2, 3),
v as (select instrument, y, m, case when n >= 2 then (s / n) / nullif(sqrt(greatest((ss - s * s / n) / (n - 1), 0)), 0) end as season from p)
select x.instrument, x.date, round(v.season, 4) + 0.0 as season from x left join v on v.instrument = x.instrument and v.y = year(x.date) and v.m = month(x.date)""",
)
def season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNE13: mean over deviation of returns in next month's namesakes of the five years before."""
    return rounded(styles.season(_panel(spark, sf_dir), "ret").select("instrument", "date", "season"), 4)


_IND = Strength(9, 3, 3, 3)


@query(
    "cne14_indmom",
    _X + _half("lr", _IND) + ", g as (select *, sqrt(circ_mv) as w, sum(sqrt(circ_mv)) over c as sw, sum(wm * sqrt(circ_mv)) over c as s from h where industry is not null window c as (partition by date, industry)), i as (select instrument, date, case when sw > 0 then s / sw end - wm * w / nullif(sw, 0) as raw from g) " + _settle("raw", "i", _IND, "indmom"),
)
def indmom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNE14: industry strength less the own share, mean of three rows, lag of three."""
    return rounded(styles.industry_momentum(_panel(spark, sf_dir).where("circ_mv >= 0"), "lr", _IND).select("instrument", "date", "indmom"))


def _capm(s: Strength) -> str:
    w = f"(partition by instrument order by date rows between {s.window - 1} preceding and current row)"
    return f""", j as (select *, case when ex is not null then mx end as u, case when mx is not null then ex end as v, power(2.0, rn / {float(s.half_life)}) as pw from x),
s as (select *, count(v) over w as n, sum(case when v is not null then pw end) over w as sw, sum(pw * u) over w as swx, sum(pw * v) over w as swy, sum(pw * u * u) over w as swxx, sum(pw * u * v) over w as swxy from j window w as {w}),
a as (select instrument, date, case when rn >= {s.window} and n >= {0.8 * s.window} then (swy - (sw * swxy - swx * swy) / nullif(sw * swxx - swx * swx, 0) * swx) / nullif(sw, 0) end as alpha from s) """


for _name, _label, _spec in (("cne16", "halpha", Strength(24, 12, 11, 11)), ("cne25", "lthalpha", Strength(36, 12, 11, 13, -1))):

    def _alpha(spark: SparkSession, sf_dir: str, label: str = _label, spec: Strength = _spec) -> DataFrame:
        """CNE16, CNE25: intercept of the rolling weighted regression of excess returns on the market's, smoothed and lagged."""
        return rounded(styles.regression_alpha(_panel(spark, sf_dir), "ex", "mx", spec, label).select("instrument", "date", label))

    query(f"{_name}_{_label}", _X + _capm(_spec) + _settle("alpha", "a", _spec, _label))(_alpha)


_FIELDS = {
    # factor: (field of the fixture that stands in, the same in SQL, statistic, sign)
    "egro": ("close", "growth", 1),
    "sgro": ("amount / volume", "growth", 1),
    "vsal": ("amount", "cv", 1),
    "vern": ("close - open", "cv_abs", 1),
    "vflo": ("high - 2 * close", "cv_abs", 1),
    "agro": ("circ_mv", "growth", -1),
    "igro": ("volume", "growth", -1),
    "cxgro": ("high - low", "growth", -1),
}
_FY = "year(date) - case when month(date) <= 4 then 2 else 1 end"
_ANNUAL = f"""
with k as ({K}), a as ({" union all ".join(f"select instrument, '{k}' as field, {_FY} as fy, arg_min({e}, date) as value from k where ({e}) is not null group by 1, 2, 3" for k, (e, _, _) in _FIELDS.items())}),
n as (select *, row_number() over (partition by instrument, field order by fy) as place from a),
s as (select *, count(value) over w as n, avg(value) over w as mean, stddev_samp(value) over w as sd, covar_samp(value, place) over w / nullif(var_samp(place) over w, 0) as slope from n window w as (partition by instrument, field order by fy rows between 4 preceding and current row)),
t as (select instrument, field, fy, case when n >= 3 and abs(mean) >= 1e-6 then case {" ".join(f"when field = '{k}' then {sign} * {'slope / mean' if how == 'growth' else 'sd / mean' if how == 'cv' else 'sd / abs(mean)'}" for k, (_, how, sign) in _FIELDS.items())} end end as v from s),
p as (select instrument, fy, {", ".join(f"max(v) filter (where field = '{k}') as {k}" for k in _FIELDS)} from t group by 1, 2)
select k.instrument, k.date, {", ".join(f"round(p.{k}, 5) + 0.0 as {k}" for k in _FIELDS)} from k left join p on p.instrument = k.instrument and p.fy = {_FY.replace("date", "k.date")}
"""


@query("cne26_42_annual_styles", _ANNUAL)
def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNE26-CNE27, CNE31-CNE33, CNE40-CNE42: slope over mean and deviation over mean of five fiscal years, each with its field and sign, on days."""
    fields = {k: (F.expr(e), how, sign) for k, (e, how, sign) in _FIELDS.items()}
    return rounded(styles.annual_styles(panels.classified_bars(spark, sf_dir), fields), 5)


def _known(tag: str, where: str) -> str:
    return ttm_ctes(tag, where) + f", d{tag} as (select instrument, ann_date, arg_max(ttm, (period, seq)) as ttm from r{tag} where ttm is not null group by 1, 2)"


_RATIOS = f"""
with {_known("1", "true")}, {_known("2", "seq % 2 = 0")},
g as (select instrument // 4 as instrument, date, sum(circ_mv) as mv, sum(amount) as ta from ({K}) group by 1, 2),
t as (select g.*, d1.ttm as whole from g asof left join d1 on g.instrument = d1.instrument and g.date >= d1.ann_date),
u as (select t.*, d2.ttm as part from t asof left join d2 on t.instrument = d2.instrument and t.date >= d2.ann_date)
select instrument, date, round(0.1 * whole / nullif(mv, 0), 5) + 0.0 as etop, round(part / nullif(mv, 0), 5) + 0.0 as cetop, round(whole / nullif(ta, 0), 5) + 0.0 as ato, round(0.1 * whole / nullif(ta, 0), 5) + 0.0 as roa from u
"""


@query("cne21_39_ttm_ratios", _RATIOS)
def ttm_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNE21 and CNE22 (trailing profit and cash flow over market value), CNE36 and CNE39 (trailing sales and profit over assets), PIT08."""
    f = panels.filings(spark, sf_dir)
    kinds = F.array(F.struct(F.lit("income").alias("field"), (0.1 * F.col("value")).alias("value")), F.struct(F.lit("sales").alias("field"), F.col("value").alias("value")), F.struct(F.when(F.col("seq") % 2 == 0, "cash").alias("field"), F.col("value").alias("value")))
    events = f.withColumn("x", F.explode(kinds)).select("instrument", "ann_date", "period", "seq", "x.field", "x.value").where("field is not null")
    grid = panels.classified_bars(spark, sf_dir).groupBy(F.floor(F.col("instrument") / 4).alias("instrument"), "date").agg(F.sum("circ_mv").alias("mv"), F.sum("amount").alias("ta"))
    t = grid.join(pit.ttm_features(events, grid.select("instrument", "date"), ["income", "sales", "cash"]), ["instrument", "date"])
    over = lambda a, b: F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0.0)))
    return rounded(t.select("instrument", "date", over("income", "mv").alias("etop"), over("cash", "mv").alias("cetop"), over("sales", "ta").alias("ato"), over("income", "ta").alias("roa")), 5)
