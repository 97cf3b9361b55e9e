"""Queries of modelling steps: segments, labels, processors, regressions, factor analysis, back tests (MLB, XSN)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.operators import cross, research
from tidepanel.plans.expression import compile_panel
from tidepanel.queries.base import query, rounded, rounded_sql
from tidepanel.sources import panels
from tidepanel.sources.panels import table

D, K, M = panels.DAILY_BARS_SQL, panels.CLASSIFIED_SQL, panels.MONTHLY_BARS_SQL


@query("mlb20_54_segments", f"with d as (select date, row_number() over (order by date desc) as k from (select distinct date from ({M})) where date < date '1998-07-15') select s as segment, a.date as start, b.date as stop from (values ('test', 14, 2), ('valid', 23, 15), ('train', 40, 24)) v(s, a, b) join d a on a.k = v.a join d b on b.k = v.b")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLB20, MLB54: train, valid and test by offsets on the trading calendar."""
    days = panels.monthly_bars(spark, sf_dir).select("date").distinct()
    return research.segments(days, "1998-07-15", 2, 12, 8, 16)


@query("mlb21_labels", rounded_sql(f"with l as (select instrument, date, lead(close, 3) over o / nullif(lead(close, 1) over o, 0) - 1 as label from ({M}) window o as (partition by instrument order by date)) select instrument, date, label, (label - avg(label) over d) / nullif(stddev_samp(label) over d, 0) as learn from l window d as (partition by date)", "label learn", "instrument, date", 5))
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLB21: return over two rows from the next, and its score per date for training."""
    return rounded(research.labels(panels.monthly_bars(spark, sf_dir), 2), 5)


_INFO = "select case when p_partkey % 3 = 0 then 'SH60' when p_partkey % 3 = 1 then 'sz00' else 'SZ30' end || lpad(cast(p_partkey as varchar), 6, '0') as code, case when p_size < 5 then 'ST ' || p_name when p_size > 45 then p_name || '退' else p_name end as name, date '2020-01-01' + cast(p_size * 40 as int) as list_date from part"


@query("mlb33_tradable", f"with i as ({_INFO}) select code from i where regexp_matches(code, '^[A-Za-z]{{2}}(60|00)') and not (contains(name, 'ST') or contains(name, '退') or list_date > date '2024-06-01')")
def tradable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLB33: main-board codes less special-treatment, delisted and newly listed ones; from a million parts on codes repeat, so each part is judged by its own key."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    board = F.when(F.col("p_partkey") % 3 == 0, "SH60").when(F.col("p_partkey") % 3 == 1, "sz00").otherwise("SZ30")
    name = F.when(F.col("p_size") < 5, F.concat(F.lit("ST "), "p_name")).when(F.col("p_size") > 45, F.concat("p_name", F.lit("退"))).otherwise(F.col("p_name"))
    info = p.select("p_partkey", F.concat(board, F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("code"), name.alias("name"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_size") * 40).cast("int")).alias("list_date"))
    return research.tradable(info.select("p_partkey", "code"), info, "2024-06-01", key="p_partkey").select("code")


@query("mlb06_merged_factors", rounded_sql(f"with b as ({M}), x as (select instrument, date, ln(close) as a from b where instrument % 2 = 0), y as (select instrument, date, close / nullif(open, 0) - 1 as b from b where instrument % 3 = 0), z as (select instrument, date, volume as c from b where instrument % 5 = 0) select instrument, date, a, b, c from x full join y using (instrument, date) full join z using (instrument, date)", "a b c", "instrument, date"))
def merged_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLB04, MLB06, MLB29, MLB56: factor frames of different coverage put together by full joins on the key."""
    b = panels.monthly_bars(spark, sf_dir)
    frames = [b.where("instrument % 2 = 0").select("instrument", "date", F.ln("close").alias("a")), b.where("instrument % 3 = 0").select("instrument", "date", (F.try_divide("close", "open") - 1).alias("b")), b.where("instrument % 5 = 0").select("instrument", "date", F.col("volume").alias("c"))]
    return rounded(reduce(lambda p, q: p.join(q, ["instrument", "date"], "full"), frames))


@query("mlb49_50_trim", rounded_sql(f"with r as (select instrument, date, close, row_number() over (partition by date order by close, instrument) as k, count(*) over (partition by date) as n from ({D}) where close is not null) select instrument, date, close from r where k > floor(n * 0.025) and k <= n - floor(n * 0.025)", "close", "instrument, date"))
def trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLB49-MLB50, XSN23: missing values and 2.5 % at either end of each date left out."""
    return rounded(research.trimmed(panels.daily_bars(spark, sf_dir).select("instrument", "date", "close"), "close", ["date"]))


@query("xsn14_16_fitted_bounds", rounded_sql(f"with b as ({M}), s as (select avg(close) as m, stddev_samp(close) as d, avg(volume) as vm, stddev_samp(volume) as vd from b where date < date '1996-01-01') select instrument, date, least(greatest(close, m - d), m + d) as close, least(greatest(volume, vm - vd), vm + vd) as volume from b, s", "close volume", "instrument, date", 8))
def fitted_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XSN14-XSN16: bounds fitted on the training range and put to all rows."""
    b = panels.monthly_bars(spark, sf_dir).select("instrument", "date", "close", "volume")
    return rounded(cross.fitted(b, ["close", "volume"], F.col("date") < "1996-01-01", "std", 1.0), 8)


@query(
    "xsn18_processors",
    rounded_sql(f"with b as (select instrument, date, close, case when volume > 300 then null else volume end as volume, lead(close) over (partition by instrument order by date) / nullif(close, 0) - 1 as label from ({M})), t as (select * from b where date < date '1996-01-01'), s as (select median(close) as m, 1.4826 * mad(close) as d from t), v as (select avg(volume) as vm, stddev_samp(volume) as vd from t) select instrument, date, least(greatest((close - m) / d, -3), 3) as close, coalesce((volume - vm) / vd, 0) as volume, label from b, s, v where label is not null", "close volume label", "instrument, date", 5),
)
def processors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XSN18: robust and plain scores fitted on the training range, missing values filled, rows without a label dropped."""
    own = W.partitionBy("instrument").orderBy("date")
    b = panels.monthly_bars(spark, sf_dir).select("instrument", "date", "close", F.when(F.col("volume") <= 300, F.col("volume")).alias("volume"), (F.try_divide(F.lead("close").over(own), "close") - 1).alias("label"))
    train = F.col("date") < "1996-01-01"
    out = cross.fitted(b, ["close"], train, "robust")
    out = cross.fitted(out, ["volume"], train, "zscore")
    return rounded(out.na.fill(0.0, ["volume"]).where("label is not null"), 5)


_SCORES = f"with b as ({M}), f as (select instrument, date, 'move' as name, close / nullif(open, 0) - 1 as value, close from b union all select instrument, date, 'volume', ln(volume), close from b), r as (select *, lead(close, 1) over (partition by name, instrument order by date) / nullif(close, 0) - 1 as ret from f), q as (select *, rank() over (partition by name, date order by value) + (count(*) over (partition by name, date, value) - 1) / 2.0 as fr, rank() over (partition by name, date order by ret) + (count(*) over (partition by name, date, ret) - 1) / 2.0 as rr from r where value is not null and ret is not null), c as (select name, date, case when stddev_samp(fr) * stddev_samp(rr) > 1e-12 then covar_samp(fr, rr) / (stddev_samp(fr) * stddev_samp(rr)) end as ric from q group by 1, 2), i as (select name, avg(ric) as ic from c group by 1)"


@query("mlb61_weighted_score", _SCORES + " select instrument, date, round(sum(ic * value), 6) + 0.0 as score from f join i using (name) where abs(ic) > 0.001 group by 1, 2")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLB55, MLB57, MLB61: factors weighted by their mean rank correlation, weak ones left out."""
    own = W.partitionBy("instrument").orderBy("date")
    b = panels.monthly_bars(spark, sf_dir).withColumn("ret", F.try_divide(F.lead("close").over(own), "close") - 1)
    kinds = F.array(F.struct(F.lit("move").alias("name"), (F.try_divide("close", "open") - 1).alias("value")), F.struct(F.lit("volume").alias("name"), F.ln("volume").alias("value")))
    f = b.select("instrument", "date", "ret", F.explode(kinds).alias("k")).select("instrument", "date", "ret", "k.name", "k.value")
    ic = cross.information_coefficients(f, "value", "ret", ["name", "date"]).groupBy("name").agg(F.avg("ric").alias("ic"))
    return rounded(research.weighted_score(f, ic, 0.001))


_OLS = f"""
with b as (select instrument, date, close / nullif(open, 0) - 1 as a0, case when volume < 400 then volume end as b0, lead(close) over (partition by instrument order by date) / nullif(close, 0) - 1 as y from ({M})),
t as (select * from b where date < date '1998-01-01'), s as (select avg(a0) as am, stddev_samp(a0) as ad, avg(b0) as bm, stddev_samp(b0) as bd from t),
c as (select instrument, date, y, least(greatest(a0, am - 3 * ad), am + 3 * ad) as a1, case when b0 is not null then least(greatest(b0, bm - 3 * bd), bm + 3 * bd) end as b1 from b, s),
u as (select avg(a1) as am, stddev_samp(a1) as ad, avg(b1) as bm, stddev_samp(b1) as bd from c where date < date '1998-01-01'),
z as (select instrument, date, y, coalesce((a1 - am) / ad, 0) as a, coalesce((b1 - bm) / bd, 0) as b from c, u),
m as (select var_samp(a) as aa, var_samp(b) as bb, covar_samp(a, b) as ab, covar_samp(a, y) as ay, covar_samp(b, y) as byy, avg(a) as ma, avg(b) as mb, avg(y) as my from z where y is not null and date < date '1998-01-01'),
k as (select (bb * ay - ab * byy) / (aa * bb - ab * ab) as ca, (aa * byy - ab * ay) / (aa * bb - ab * ab) as cb, ma, mb, my from m)
select instrument, date, round(my - ca * ma - cb * mb + ca * a + cb * b, 6) + 0.0 as predict from z, k where date >= date '1998-01-01'
"""


@query("mlb62_68_regression", _OLS)
def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLB62-MLB63, MLB66, MLB68: features bounded, scored and filled, returns regressed on them, later dates predicted."""
    own = W.partitionBy("instrument").orderBy("date")
    b = panels.monthly_bars(spark, sf_dir).select("instrument", "date", (F.try_divide("close", "open") - 1).alias("a"), F.when(F.col("volume") < 400, F.col("volume")).alias("b"), (F.try_divide(F.lead("close").over(own), "close") - 1).alias("y"))
    train = F.col("date") < "1998-01-01"
    z = research.preprocessed(b, ["a", "b"], 3.0, train)
    model = research.linear_model(z.where(train), "y", ["a", "b"])
    return rounded(research.predicted(z.where(~train), model).select("instrument", "date", "predict"))


@query("mlb58_65_factor_scores")
def factor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLB58-MLB59, MLB64-MLB65: two factors of five features, varimax rotation, Bartlett scores (recovered from made-up factors in tests)."""
    exprs = {"a": "Log($close)", "b": "Log($high)", "c": "Log($volume)", "d": "Log($amount)", "e": "Log($low)"}
    p = compile_panel(panels.monthly_bars(spark, sf_dir), exprs).dropna()
    means, deviations, r = research.correlations(p, list(exprs))
    load, unique = research.factor_analysis(r, 2)
    out = research.factor_scores(p, list(exprs), means, deviations, research.bartlett(load, unique))
    return rounded(out.select("instrument", "date", "f1", "f2"), 4)


@query("mlb25_31_horizon_metrics", f"with b as ({M}), x as (" + " union all ".join(f"select {h} as horizon, date, volume as f, lead(close, {h + 1}) over (partition by instrument order by date) / nullif(lead(close, 1) over (partition by instrument order by date), 0) - 1 as r from b" for h in (1, 5)) + "), c as (select horizon, date, case when stddev_samp(f) * stddev_samp(r) > 1e-12 then covar_samp(f, r) / (stddev_samp(f) * stddev_samp(r)) end as ic from x where f is not null and r is not null group by 1, 2) select horizon, count(ic) as dates, round(avg(ic), 6) as ic, round(avg(ic) / stddev_samp(ic), 6) as icir from c group by 1")
def horizon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLB25-MLB27, MLB31: coefficients of each horizon's scores, the windows' dates together."""
    own = W.partitionBy("instrument").orderBy("date")
    rets = F.array(*(F.struct(F.lit(h).alias("horizon"), (F.try_divide(F.lead("close", h + 1).over(own), F.lead("close", 1).over(own)) - 1).alias("r")) for h in (1, 5)))
    x = panels.monthly_bars(spark, sf_dir).select("date", F.col("volume").alias("f"), rets.alias("rets")).select("date", "f", F.explode("rets").alias("x")).select("date", "f", "x.horizon", "x.r")
    ic = cross.information_coefficients(x, "f", "r", ["horizon", "date"])
    return rounded(ic.groupBy("horizon").agg(F.count("ic").alias("dates"), F.avg("ic").alias("ic"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("icir")))


@query("mlb72_78_order_list", f"with k as (select instrument, date, volume, close, case when volume > lag(volume) over (partition by instrument order by date) then 'buy' else 'sell' end as side from ({M})) select date, side, instrument, cast(row_number() over (partition by date order by case when side = 'sell' then 0 else 1 end, volume desc, instrument) as int) as place from k where date = date '1997-05-01' and instrument % 2 = 0")
def order_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLB72, MLB74-MLB75, MLB77-MLB78: a day's and portfolio's orders, sells first, each by score."""
    own = W.partitionBy("instrument").orderBy("date")
    k = panels.monthly_bars(spark, sf_dir).withColumn("side", F.when(F.col("volume") > F.lag("volume").over(own), "buy").otherwise("sell")).where("date = date '1997-05-01' and instrument % 2 = 0")
    place = F.row_number().over(W.partitionBy("date").orderBy(F.when(F.col("side") == "sell", 0).otherwise(1), F.desc("volume"), "instrument"))
    return k.select("date", "side", "instrument", place.alias("place"))


@query("mlb70_73_daily_backtest")
def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MLB24, MLB30, MLB69-MLB71, MLB73: top-k portfolios with swaps, holding time, costs, least costs, price limits and a benchmark (against a plain version in tests)."""
    b = panels.classified_bars(spark, sf_dir)
    bench = b.groupBy("date").agg(F.avg(F.try_divide("close", "open") - 1).alias("bench"))
    p = b.join(bench, "date").select(F.when(F.col("instrument") % 2 == 0, "even").otherwise("odd").alias("portfolio"), "instrument", "date", F.col("volume").alias("score"), "close", "bench")
    out = research.daily_backtest(p, topk=3, n_drop=1, hold=2, limit=0.5)
    return out.select("portfolio", "date", F.round("value", 2).alias("value"), "n", "bought", "sold", F.round("cost", 2).alias("cost"), F.round("ret", 6).alias("ret"))
