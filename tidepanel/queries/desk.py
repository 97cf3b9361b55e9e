"""Queries of the alpha engine, the portfolio desk and the stores of their results (ALP, PFO, SRC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.operators import cross, desk, rolling, structured, volatility
from tidepanel.queries.analytics import _BOOK, _VOL, _book
from tidepanel.queries.base import query, rounded, rounded_sql
from tidepanel.sources import panels, results
from tidepanel.sources.files import scratch, written

K, M = panels.CLASSIFIED_SQL, panels.MONTHLY_BARS_SQL
#: dates of history that the tables can give
_DAYS = 60


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments with enough history: signal g, residual and traits, worked out once."""
    k = panels.classified_bars(spark, sf_dir).where("circ_mv > 0 and open > 0 and volume > 0")
    k = k.join(k.groupBy("instrument").agg(F.count("*").alias("n")).where(F.col("n") >= _DAYS).select("instrument"), "instrument", "left_semi")
    move = F.expr("close / open - 1")
    return written(k.select("instrument", "date", "industry", "circ_mv", F.ln("volume").alias("g"), (move - F.avg(move).over(W.partitionBy("date"))).alias("residual")), "panel")


_SIG = f"""
with k0 as (select *, count(*) over (partition by instrument) as days from ({K}) where circ_mv > 0 and open > 0 and volume > 0),
r as (select instrument, date, industry, circ_mv, ln(volume) as g, close / open - 1 - avg(close / open - 1) over (partition by date) as residual from k0 where days >= {_DAYS}),
o as (select instrument, stddev_samp(residual) as omega from (select *, row_number() over (partition by instrument order by date desc) as n from r) where n <= {_DAYS} group by 1),
d as (select date, row_number() over (order by date desc) as n from (select distinct date from r)),
sd as (select instrument, stddev_samp(g) as sd from r join d using (date) where n <= {_DAYS} group by 1),
f as (select count(*) as names, regr_r2(sd, omega) as r2 from sd join o using (instrument)),
c as (select case when (select count(*) from d) < {_DAYS} or names < 30 then 2 when r2 > 0.2 then 2 else 1 end as scenario, names, r2 from f),
z as (select instrument, date, (g - avg(g) over (partition by date)) / nullif(stddev_samp(g) over (partition by date), 0) as z, lead(residual) over (partition by instrument order by date) as nxt from r),
i as (select corr(z, nxt) as ic from z where z is not null and nxt is not null)
"""


@query("alp05_case", _SIG + ' select scenario, names, round(r2, 6) + 0.0 as r2 from c')
def case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALP05: does the signal's deviation follow residual volatility; with 30 names an R2 over 0.2 is significant by itself."""
    s = _signals(spark, sf_dir)
    k = W.partitionBy("instrument").orderBy(F.desc("date"))
    omega = s.withColumn("k", F.row_number().over(k)).where(F.col("k") <= _DAYS).groupBy("instrument").agg(F.stddev_samp("residual").alias("omega"))
    return rounded(desk.classify(s, omega, window=_DAYS))


@query("alp20_engine", _SIG + ', l as (select *, max(date) over () as last from z where z is not null) select instrument, date, round(case when c.scenario = 1 then omega * ic * z else ic * z end, 6) + 0.0 as alpha, round(omega, 6) + 0.0 as omega, round(ic, 6) + 0.0 as ic, c.scenario from l join o using (instrument), i, c where date = last')
def alpha_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALP02-ALP03, ALP20-ALP22: the single-signal engine end to end with its diagnostics; a date without signal falls back to the last one before."""
    s = _signals(spark, sf_dir)
    out = desk.alpha_engine(s.select("instrument", "date", "g"), s.select("instrument", "date", "residual"), s.select("instrument", "date", "industry", "circ_mv"), "2100-01-01", _DAYS, _DAYS, 5)
    return rounded(out)


# every fourth name is young, every eighth has no industry
_YOUNG = f"select * replace (case when instrument % 8 = 0 then null else industry end as industry) from ({K}) where (instrument % 4 <> 0 or date >= date '1999-01-01') and circ_mv > 0 and open > 0 and volume > 0"
_YOUNG_ENGINE = f"""
with k as ({_YOUNG}), r as (select instrument, date, ln(volume) as g, close / open - 1 as residual from k),
o as ({_VOL.replace(K, _YOUNG).replace("n <= 200", f"n <= {_DAYS}").replace("when circ_mv is not null", "when circ_mv is not null and industry is not null")}),
d as (select date, row_number() over (order by date desc) as n from (select distinct date from r)),
sd as (select instrument, stddev_samp(g) as sd from r join d using (date) where n <= {_DAYS} group by 1),
f as (select count(*) as names, regr_r2(sd, omega) as r2 from sd join o using (instrument) where sd is not null),
c as (select case when (select count(*) from d) < {_DAYS} or names < 30 then 2 when r2 > 0.2 then 2 else 1 end as scenario from f),
z as (select instrument, date, (g - avg(g) over (partition by date)) / nullif(stddev_samp(g) over (partition by date), 0) as z, lead(residual) over (partition by instrument order by date) as nxt from r),
i as (select corr(z, nxt) as ic from z where z is not null and nxt is not null),
l as (select *, max(date) over () as last from z where z is not null)
select instrument, date, method, round(case when c.scenario = 1 then omega * ic * z else ic * z end, 4) + 0.0 as alpha, round(omega, 4) + 0.0 as omega, c.scenario from l left join o using (instrument), i, c where date = last and (c.scenario = 2 or omega is not null)
"""


@query("alp20_engine_young_names", _YOUNG_ENGINE)
def alpha_engine_with_young_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALP06-ALP11, ALP20-ALP22: the engine over old and young names alike; a young one's volatility comes from its industry and cap, or is the median."""
    k = panels.classified_bars(spark, sf_dir).where("(instrument % 4 <> 0 or date >= date '1999-01-01') and circ_mv > 0 and open > 0 and volume > 0")
    k = written(k.withColumn("industry", F.when(F.col("instrument") % 8 != 0, F.col("industry"))).select("instrument", "date", "industry", "circ_mv", F.ln("volume").alias("g"), F.expr("close / open - 1").alias("residual")), "panel")
    r = k.select("instrument", "date", "residual")
    out = desk.alpha_engine(k.select("instrument", "date", "g"), r, k.select("instrument", "date", "industry", "circ_mv"), None, _DAYS, _DAYS, 20)
    how = volatility.residual_volatility(r, k, None, _DAYS, _DAYS, 20).select("instrument", "method")
    return rounded(out.join(how, "instrument", "left").select("instrument", "date", "method", "alpha", "omega", "scenario"), 4)


_AL = _BOOK.replace(", f as (select i, j,", ", al as (select instrument, close / nullif(open, 0) - 1 as alpha, close as price, 1.0 + volume / 1000 as beta, circ_mv as cap from t where instrument % 3 <> 0), f as (select i, j,")


def _today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(panels.last_bars(spark, sf_dir), "today")


@query(
    "pfo01_aligned",
    rounded_sql(_AL + " select al.instrument, alpha, d.d, cap / sum(cap) over () as benchmark, cast(case when al.instrument % 2 = 0 then 100 else 0 end as bigint) as shares, case when al.instrument % 5 <> 0 then price end as price, beta from al join d on d.instrument = al.instrument where al.instrument in (select instrument from e)", "alpha d benchmark price beta", "instrument, shares"),
)
def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PFO01: names common to alpha, exposures, specific risk and benchmark; missing positions are zero."""
    e, _, d, _ = _book(spark, sf_dir)
    t = _today(spark, sf_dir)
    alpha = t.where("instrument % 3 <> 0").select("instrument", (F.try_divide("close", "open") - 1).alias("alpha"))
    held = t.where("instrument % 2 = 0").select("instrument", F.lit(100).cast("long").alias("shares"))
    out = desk.aligned(alpha, e, d, t.select("instrument", F.col("circ_mv").alias("b")), held, t.where("instrument % 5 <> 0").select("instrument", F.col("close").alias("price")), t.select("instrument", (1.0 + F.col("volume") / 1000).alias("beta")))
    return rounded(out)


@query("pfo04_factor_neutral", rounded_sql(_AL + ", s as (select sum(x * alpha / d) / (sum(x * x / d) + 1e-6) as theta from e join al using (instrument) join d using (instrument) where factor = 'size') select al.instrument, alpha - x * theta as alpha from al join e on e.instrument = al.instrument and factor = 'size', s", "alpha", "instrument"))
def factor_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PFO04: alpha less what a factor explains of it, by inverse specific variance with a ridge."""
    e, _, d, _ = _book(spark, sf_dir)
    alpha = _today(spark, sf_dir).where("instrument % 3 <> 0").select("instrument", (F.try_divide("close", "open") - 1).alias("alpha"))
    return rounded(desk.factor_neutral(alpha, e.where("factor = 'size'"), d)[0])


@query("pfo08_marginal_value", rounded_sql(_AL + ", fx as (select i as factor, sum(v * x) as fx from f join x on factor = j group by 1), vh as (select instrument, sum(e.x * fx) as vh from e join fx using (factor) group by 1) select al.instrument, alpha - 2 * 5.0 * (vh + d * h) as value from al join vh using (instrument) join d using (instrument) join h using (instrument)", "value", "instrument"))
def marginal_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PFO08: marginal value of each holding."""
    e, f, d, h = _book(spark, sf_dir)
    alpha = _today(spark, sf_dir).where("instrument % 3 <> 0").select("instrument", (F.try_divide("close", "open") - 1).alias("alpha"))
    return rounded(desk.marginal_value(alpha, e, f, d, h, 5.0))


@query("pfo05_06_optimised_trades")
def optimised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PFO05-PFO07: two portfolios optimised side by side with costs, turnover, caps and cash neutrality, and their orders (checked by the optimum's conditions in tests)."""
    e, f, d, _ = _book(spark, sf_dir)
    t = _today(spark, sf_dir).withColumn("portfolio", F.when(F.col("instrument") % 2 == 0, "even").otherwise("odd"))
    share = F.try_divide("circ_mv", F.sum("circ_mv").over(W.partitionBy("portfolio")))
    book = t.join(d, "instrument").select("portfolio", "instrument", F.col("close").alias("price"), (F.try_divide("close", "open") - 1).alias("alpha"), "d", F.lit(0.0).alias("current"), share.alias("benchmark"))
    h = structured.optimised(book, e, f, "portfolio")
    out = desk.trades_from(book.join(h, ["portfolio", "instrument"]).select("portfolio", "instrument", "price", "h", "current"), 1e7)
    return out.select("instrument", F.round("target", 6).alias("h"), "side", "shares")


_TWO = f"""
with b as ({K}), t as (select industry as portfolio, instrument, ln(circ_mv) as x, 0.04 + circ_mv / 1e6 as d, 0.02 + volume / 1000 as excess from b where date = (select max(date) from b) and circ_mv > 0),
r as (select t.*, RHS as r from t),
s as (select portfolio, sum(1 / d) + 11.25 as m11, sum(x / d) - 1.25 as m12, sum(x * x / d) + 11.25 as m22, sum(r / d) as b1, sum(x * r / d) as b2 from r group by 1),
u as (select portfolio, (m22 * b1 - m12 * b2) / (m11 * m22 - m12 * m12) as c1, (m11 * b2 - m12 * b1) / (m11 * m22 - m12 * m12) as c2 from s),
v as (select portfolio, instrument, (r - c1 - x * c2) / d as v from r join u using (portfolio))
select portfolio, instrument, round(v / sum(v) over (partition by portfolio), 6) + 0.0 as h from v
"""


def _two_factors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books by industry on the last date, under a market and a size factor."""
    t = _today(spark, sf_dir).where("circ_mv > 0")
    book = t.select(F.col("industry").alias("portfolio"), "instrument", (0.04 + F.col("circ_mv") / 1e6).alias("d"), (0.02 + F.col("volume") / 1000).alias("excess"))
    e = t.select("instrument", F.lit("market").alias("factor"), F.lit(1.0).alias("x")).unionByName(t.select("instrument", F.lit("size").alias("factor"), F.ln("circ_mv").alias("x")))
    cov = spark.createDataFrame([(a, b, 0.09 if a == b else 0.01) for a in ("market", "size") for b in ("market", "size")], "i string, j string, v double")
    return book, e, cov


@query("ops19_minimum_variance", _TWO.replace("RHS", "1.0"))
def minimum_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OPS19: fully invested weights of least variance for each industry's names, by Woodbury's identity."""
    return rounded(structured.minimum_variance(*_two_factors(spark, sf_dir), "portfolio"))


@query("ops20_tangency", _TWO.replace("RHS", "excess"))
def tangency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OPS20: fully invested weights of the best ratio of excess return to risk for each industry's names."""
    return rounded(structured.tangency(*_two_factors(spark, sf_dir), "portfolio", "excess"))


_BAND = f"""
with recursive b as ({K}), t0 as (select industry as portfolio, instrument, 0.3 * ln(circ_mv) as z, 0.04 + circ_mv / 1e6 as d, close / nullif(open, 0) - 1 as alpha, circ_mv / sum(circ_mv) over (partition by industry) as benchmark from b where date = (select max(date) from b) and circ_mv > 0),
t as (select *, case when instrument % 3 = 0 then -benchmark / 2 when instrument % 3 = 1 then 0.01 else 0.0 end as held from t0 where alpha is not null),
p as (select distinct portfolio, -1e4::double as lo, 1e4::double as hi, 0 as n from t
  union all select portfolio, case when g > 0 then (lo + hi) / 2 else lo end, case when g > 0 then hi else (lo + hi) / 2 end, n + 1 from (
    select p.portfolio, lo, hi, n, sum(z * HOLD) - (lo + hi) / 20 as g from p join t on t.portfolio is not distinct from p.portfolio where n < 90 group by p.portfolio, lo, hi, n)),
h as (select p.portfolio, instrument, z, d, alpha, held, (lo + hi) / 2 as price, HOLD as h from p join t on t.portfolio is not distinct from p.portfolio where n = 90)
select portfolio, instrument, round(h, 6) + 0.0 as h, round(alpha - z * price - 10 * d * h, 6) + 0.0 as value, alpha - z * price - 10 * d * h between -0.0600001 and 0.0400001 as in_band, abs(h - held) < 1e-9 as untraded from h
""".replace("HOLD", "least(0.2, greatest(-benchmark, least((alpha - z * (lo + hi) / 2 + 0.06) / (10 * d), greatest((alpha - z * (lo + hi) / 2 - 0.04) / (10 * d), held))))")


@query("pfo09_dead_band", _BAND)
def dead_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PFO09: books by industry on the last date, moved to where no name's marginal value pays for a trade; the SQL bisects the size factor's price."""
    t = _today(spark, sf_dir).where("circ_mv > 0")
    b = F.try_divide("circ_mv", F.sum("circ_mv").over(W.partitionBy("industry")))
    t = t.select(F.col("industry").alias("portfolio"), "instrument", "circ_mv", (F.try_divide("close", "open") - 1).alias("alpha"), (0.04 + F.col("circ_mv") / 1e6).alias("d"), b.alias("benchmark"))
    m = F.col("instrument") % 3
    book = t.where("alpha is not null").withColumn("current", F.when(m == 0, -F.col("benchmark") / 2).when(m == 1, 0.01).otherwise(0.0))
    e = t.select("instrument", F.lit("size").alias("factor"), F.ln("circ_mv").alias("x"))
    cov = spark.createDataFrame([("size", "size", 0.09)], "i string, j string, v double")
    h = structured.dead_band(book, e, cov, "portfolio", buy=0.04, sell=0.06, cap=0.2).withColumnRenamed("portfolio", "of")
    out = book.join(h, ["instrument"]).where(F.col("portfolio").eqNullSafe(F.col("of")))
    return rounded(out.select("portfolio", "instrument", "h", "value", "in_band", (F.abs(F.col("h") - F.col("current")) < 1e-9).alias("untraded")))


@query(
    "src53_booked_orders",
    f"with k as (select instrument, date, close, row_number() over (partition by date order by instrument) as n from ({M})), o as (select cast(date as varchar) as portfolio, instrument, close as price, case when n % 2 = 0 then 'sell' else 'buy' end as side, cast(n * 10 as bigint) as shares, cast(case when n % 3 = 0 then 15 when n % 3 = 1 then 1000 end as bigint) as held from k), t as (select *, case when side = 'sell' then -least(shares, coalesce(held, 0)) else shares end as trade_shares from o) select portfolio, instrument, side, round(price, 8) as price, trade_shares, coalesce(held, 0) + trade_shares as hold_shares, round(1e8 - sum((coalesce(held, 0) + trade_shares) * price) over (partition by portfolio), 2) + 0.0 as cash from t",
)
def booked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC53: sells capped at the holding and signed, new holdings, residual cash."""
    n = F.row_number().over(W.partitionBy("date").orderBy("instrument"))
    k = panels.monthly_bars(spark, sf_dir).select(F.col("date").cast("string").alias("portfolio"), "instrument", F.col("close").alias("price"), n.alias("n"))
    orders = k.select("portfolio", "instrument", "price", F.when(F.col("n") % 2 == 0, "sell").otherwise("buy").alias("side"), (F.col("n") * 10).cast("long").alias("shares"))
    held = k.where("n % 3 <> 2").select("portfolio", "instrument", F.when(F.col("n") % 3 == 0, 15).otherwise(1000).cast("long").alias("shares"))
    out = desk.booked(orders, held, 1e8)
    return out.withColumn("price", F.round("price", 8)).withColumn("cash", F.round("cash", 2) + 0.0)


_RISK = _BOOK + ", fx as (select i as factor, sum(v * x) as fx from f join x on factor = j group by 1), vh as (select instrument, sum(e.x * fx) as vh from e join fx using (factor) group by 1)"


@query(
    "src43_48_risk_store",
    _RISK + " select 'stock' as kind, cast(instrument as varchar) as name, '' as type, round((vh + d * h) / sqrt(fv + sv), 6) + 0.0 as marginal, round(h * (vh + d * h) / sqrt(fv + sv), 6) + 0.0 as contribution from vh join d using (instrument) join h using (instrument), fv, sv union all select 'factor', x.factor, case when x.factor = 'size' then 'style' else 'industry' end, round(fx / sqrt(fv + sv), 6) + 0.0, round(x * fx / sqrt(fv + sv), 6) + 0.0 from x join fx on x.factor = fx.factor, fv, sv",
)
def risk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC43-SRC49: risk results of instruments (CSV) and factors (Parquet) saved by day and loaded again."""
    from tidepanel.operators import risk

    book = _book(spark, sf_dir)
    at = scratch(spark, "risk")
    stock = risk.asset_contributions(*book).select(F.col("instrument").cast("string").alias("name"), F.lit("").alias("type"), "marginal", "contribution")
    kind = F.when(F.col("factor") == "size", "style").otherwise("industry")
    factor = risk.factor_contributions(*book).select(F.col("factor").alias("name"), kind.alias("type"), "marginal", "contribution")
    results.save(stock, f"{at}/stock", "1998-12-01", "csv")
    results.save(factor, f"{at}/factor", "1998-12-01")
    a = results.load(spark, f"{at}/stock", "1998-12-01", "csv", stock.schema).withColumn("type", F.coalesce("type", F.lit("")))
    b = results.load(spark, f"{at}/factor", "1998-12-01")
    both = a.select(F.lit("stock").alias("kind"), "*").unionByName(b.select(F.lit("factor").alias("kind"), *stock.columns))
    return rounded(both)


_ALPHAS = f"select instrument, date, close / nullif(open, 0) - 1 as alpha from ({M})"


@query("src29_50_alpha_store", f"with a as ({_ALPHAS}), o as (select * from a where date = date '1997-03-01'), s as (select avg(alpha) as m, stddev_samp(alpha) as d from o) select instrument, round(least(greatest(alpha, m - 3 * d), m + 3 * d), 6) + 0.0 as alpha from o, s")
def alpha_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC29, SRC50-SRC51: alphas stored by day; one day read back from its own folder and bounded at three deviations."""
    a = panels.monthly_bars(spark, sf_dir).select("instrument", "date", (F.try_divide("close", "open") - 1).alias("alpha"))
    at = scratch(spark, "alpha")
    results.save_days(a, at)
    one = results.load_day(spark, at, "1997-03-01")
    return rounded(cross.winsorize(one, "alpha", ["date"], "std").select("instrument", "alpha"))


@query("src52_55_metric_table", f"with a as ({_ALPHAS}), m as (select cast(date_trunc('year', date) as date) as day, 'alpha' as name, 'raw' as type, avg(alpha) as v from a group by 1) select day, name, type, round(case when day >= date '1996-01-01' then 2 * v else v end, 6) + 0.0 as v from m where day < date '1998-01-01' or day >= date '1996-01-01'")
def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC52, SRC54-SRC55: metrics keyed by day, name and type; a second run replaces the days it has."""
    a = panels.monthly_bars(spark, sf_dir).select(F.to_date(F.trunc("date", "year")).alias("day"), (F.try_divide("close", "open") - 1).alias("alpha"))
    m = a.groupBy("day").agg(F.avg("alpha").alias("v")).select("day", F.lit("alpha").alias("name"), F.lit("raw").alias("type"), "v")
    at = scratch(spark, "metrics")
    results.put(m.where("day < date '1998-01-01'"), at, ["day", "name", "type"])
    now = results.put(m.where("day >= date '1996-01-01'").withColumn("v", 2 * F.col("v")), at, ["day", "name", "type"])
    return rounded(results.current(spark, now))


@query(
    "src30_34_book_inputs",
    f"with k as ({K}), r as (select instrument, date, close / nullif(lag(close) over (partition by instrument order by date), 0) - 1 as y, row_number() over (partition by instrument order by date) as rn from k), m as (select date, avg(y) as x from r group by date), j as (select r.*, case when y is not null then x end as u, case when x is not null then y end as v, power(2.0, rn / 6.0) as pw from r join m using (date)), s as (select *, count(v) over w as n, sum(case when v is not null then pw end) over w as sw, sum(pw * u) over w as swx, sum(pw * v) over w as swy, sum(pw * u * u) over w as swxx, sum(pw * u * v) over w as swxy from j window w as (partition by instrument order by date rows between 23 preceding and current row)) select k.instrument, k.industry, round(close / (1 + volume / 1000), 6) as price, round(case when rn >= 24 and n >= 19.2 then (sw * swxy - swx * swy) / nullif(sw * swxx - swx * swx, 0) end, 5) + 0.0 as beta from k join s using (instrument, date) where date = date '1998-06-01'",
)
def book_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC19, SRC26, SRC30, SRC33-SRC34: a date's slice of exposures, unadjusted prices and rolling betas."""
    k = panels.classified_bars(spark, sf_dir).withColumn("factor", 1 + F.col("volume") / 1000)
    r = k.select("instrument", "date", (F.try_divide("close", F.lag("close").over(W.partitionBy("instrument").orderBy("date"))) - 1).alias("y"))
    market = r.groupBy("date").agg(F.avg("y").alias("x"))
    beta = rolling.rolling_regression(r.join(market, "date"), "y", "x", 24, 6.0).where("date = date '1998-06-01'").select("instrument", F.round("beta", 5).alias("beta"))
    day = k.where("date = date '1998-06-01'").select("instrument", "industry", F.round(F.try_divide("close", "factor"), 6).alias("price"))
    return day.join(beta, "instrument").withColumn("beta", F.col("beta") + 0.0)


@query("agg23_dql24_split_by_code", f"select instrument, count(*) as n, round(sum(close), 4) as total from ({M}) where instrument in (1, 3) group by 1")
def split_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG23, DQL24: a folder per code, two of them read back; the others aren't touched."""
    from tidepanel.sources.files import read_folders, write_folders

    at = scratch(spark, "codes")
    bars = panels.monthly_bars(spark, sf_dir).select("instrument", "date", "close")
    write_folders(bars, at, "instrument")
    got = read_folders(spark, at, "instrument", [1, 3], bars.schema)
    return got.groupBy(F.col("instrument").cast("long").alias("instrument")).agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("total"))


