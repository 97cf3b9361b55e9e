"""Queries of row rules of ingestion, point-in-time stores and reconciliation (SRC, PIT, DQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.operators import pit, shaping
from tidepanel.plans.expression import compile_panel, panel_sql
from tidepanel.queries.base import query, rounded, rounded_sql
from tidepanel.sources import panels, vendor
from tidepanel.sources.files import read_frame, scratch, write_frame
from tidepanel.sources.panels import table

D, M = panels.DAILY_BARS_SQL, panels.MONTHLY_BARS_SQL


@query("src61_newest_statements", "select k, period, status, prio, o_totalprice, o_orderkey from (select o_custkey % 100 as k, year(o_orderdate) * 100 + quarter(o_orderdate) as period, o_orderstatus as status, o_orderpriority as prio, o_totalprice, o_orderkey, row_number() over (partition by o_custkey % 100, year(o_orderdate) * 100 + quarter(o_orderdate), o_orderstatus, o_orderpriority order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1")
def newest_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC61: rows sorted and the last of each of four keys kept, as an aggregate."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderkey")
    rows = o.select((F.col("o_custkey") % 100).alias("k"), (F.year("o_orderdate") * 100 + F.quarter("o_orderdate")).alias("period"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("prio"), "o_totalprice", "o_orderdate", "o_orderkey")
    return vendor.newest(rows, ["k", "period", "status", "prio"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("src63_bars_with_factor", f"with b as ({D}), f as (select instrument, date, 1 + volume / 10 as factor from b where instrument % 3 <> 0 union all select -1, date '2024-01-01', 9.0) select b.instrument, b.date, round(b.close, 6) as close, round(f.factor, 6) as factor from b left join f using (instrument, date)")
def bars_with_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC63: bars with the adjustment factor put beside them by code and day."""
    b = panels.daily_bars(spark, sf_dir)
    f = b.where("instrument % 3 <> 0").select("instrument", "date", (1 + F.col("volume") / 10).alias("factor"))
    f = f.unionByName(spark.sql("select cast(-1 as bigint) as instrument, date '2024-01-01' as date, 9.0d as factor"))
    return rounded(vendor.with_factor(b.select("instrument", "date", "close"), f, ["instrument", "date"]))


@query("src64_numeric_bars", f"select instrument, date, round(try_cast(case when instrument % 4 = 1 then 'n/a' else cast(close as varchar) end as double), 2) + 0.0 as close, round(amount, 3) + 0.0 as amount from ({D}) where not (volume < 3)")
def numeric_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC64: rows of suspended days (empty amount) dropped, texts made numbers or missing, rounded."""
    b = panels.daily_bars(spark, sf_dir)
    raw = b.select("instrument", "date", F.when(F.col("instrument") % 4 == 1, "n/a").otherwise(F.col("close").cast("string")).alias("close"), F.when(F.col("volume") < 3, "").otherwise(F.col("amount").cast("string")).alias("amount"))
    out = vendor.numeric(vendor.traded(raw), ["close", "amount"], {"close": 2, "amount": 3})
    return out.withColumn("close", F.col("close") + 0.0).withColumn("amount", F.col("amount") + 0.0)


@query("src68_75_parse_rows", "select date '2024-01-31' as day, 'SZ' || lpad(cast(o_custkey as varchar), 6, '0') as code, 'SH' || lpad(cast(o_orderkey as varchar), 6, '0') as second, cast(o_orderdate as date) as ann_date, case when o_orderkey % 9 <> 0 then round(greatest(least((o_totalprice - 150000) / 10, 9999.99), -9999.99), 6) + 0.0 end as pct_chg, round(o_totalprice / 100, 6) as vol, round(o_totalprice / 1000, 6) as amount from orders")
def parse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC68-SRC69, SRC71-SRC75: rename, NaN to NULL, codes and dates, a bound of 9999.99, shares to lots and yuan to thousands."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    pad = lambda c: F.lpad(F.col(c).cast("string"), 6, "0")
    raw = o.select(
        F.concat(pad("o_custkey"), F.lit(".SZ")).alias("ts_code"), F.concat(F.lit("sh."), pad("o_orderkey")).alias("code"), F.date_format("o_orderdate", "yyyyMMdd").alias("ann"),
        F.when(F.col("o_orderkey") % 9 == 0, F.lit(float("nan"))).otherwise((F.col("o_totalprice") - 150000) / 10).alias("pctChg"), F.col("o_totalprice").alias("volume"), F.col("o_totalprice").alias("turnover"),
    )
    names = {"day": "", "code": "ts_code", "second": "code", "ann_date": "ann", "pct_chg": "pctChg", "vol": "volume", "amount": "turnover"}
    return rounded(vendor.parsed(raw, names, ("code", "second"), ("ann_date",), {"pct_chg": 9999.99}, {"vol": 0.01, "amount": 0.001}, "2024-01-31"))


@query("src70_codes", "select distinct p_brand as code from part where p_size = 10 and p_type like 'S%'")
def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC70: the codes of one day, those of a status."""
    p = table(spark, sf_dir, "part", "p_brand", "p_size", "p_type")
    return vendor.matching(p.where(F.startswith("p_type", F.lit("S"))), {"p_size": 10}).select(F.col("p_brand").alias("code")).distinct()


_WIDE = "select o_custkey // 50 as sym, cast(o_orderdate as date) as ann, cast(date_trunc('quarter', o_orderdate) + interval 3 month - interval 1 day as date) as ended, o_orderkey % 2 as flag, o_orderkey as seq, o_totalprice as revenue, o_totalprice * 0.1 as income, case when o_orderkey % 3 <> 0 then o_totalprice * 0.5 end as assets from orders"


@query(
    "pit11_statement_events",
    f"with w as ({_WIDE}), n as (select * from (select *, row_number() over (partition by sym, ann, ended order by flag desc, seq desc) as k from w where sym % 4 <> 3) where k = 1), l as (select sym, ann, ended, 'revenue_q' as field, revenue as value from n union all select sym, ann, ended, 'income_q', income from n union all select sym, ann, ended, 'assets_q', assets from n union all select sym, ann, ended, 'revenue_a', revenue from n where month(ended) = 12) select sym as symbol, ann as date, year(ended) * 100 + quarter(ended) as period, field, round(value, 4) as value from l where value is not null",
)
def statement_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIT11, JOI10, JOI12: newest revision of wide statements, some markets only, unpivoted to events; annual fields from year ends."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    end = F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2))
    w = o.select(F.floor(F.col("o_custkey") / 50).alias("symbol"), F.to_date("o_orderdate").alias("date"), end.alias("ended"), (F.col("o_orderkey") % 2).alias("flag"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("revenue_q"), (F.col("o_totalprice") * 0.1).alias("income_q"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") * 0.5).alias("assets_q"))
    n = vendor.newest(w.where("symbol % 4 <> 3"), ["symbol", "date", "ended"], ["flag", "seq"]).withColumn("revenue_a", F.when(F.month("ended") == 12, F.col("revenue_q")))
    long = n.unpivot(["symbol", "date", "ended"], ["revenue_q", "income_q", "assets_q", "revenue_a"], "field", "value").where("value is not null")
    return long.select("symbol", "date", (F.year("ended") * 100 + F.quarter("ended")).alias("period"), "field", F.round("value", 4).alias("value"))


@query(
    "pit20_21_adjusted_panel",
    f"with s as (select instrument, date, close, volume, amount, 1 + volume / 7.3 as factor from ({D}) union all select -1, date, max(close), sum(volume), sum(amount), 1.0 from ({D}) group by date), a as (select instrument, date, close * factor as close, volume / factor * 100 as volume, amount * 1000 as amount, factor from s) select instrument, date, round(close, 2) + 0.0 as close, round(volume, 2) + 0.0 as volume, round(amount, 3) + 0.0 as amount, round(factor, 4) as factor, round((close - lag(close) over o) / nullif(lag(close) over o, 0), 4) + 0.0 as change from a window o as (partition by instrument order by date)",
)
def adjusted_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIT20-PIT21: bars and an index of factor 1 together, adjusted, in units, with changes, rounded."""
    b = panels.daily_bars(spark, sf_dir).select("instrument", "date", "close", "volume", "amount")
    index = b.groupBy("date").agg(F.max("close").alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount")).select(F.lit(-1).cast("long").alias("instrument"), "date", "close", "volume", "amount", F.lit(1.0).alias("factor"))
    return pit.finished_panel(b.withColumn("factor", 1 + F.col("volume") / 7.3).unionByName(index)).select(*((F.col(c) + 0.0).alias(c) if c not in ("instrument", "date") else c for c in ("instrument", "date", "close", "volume", "amount", "factor", "change")))


@query(
    "pit23_minute_prices",
    f"with d as (select instrument, date, 1 + volume / 10.0 as factor, case when volume <= 2 then 1 else 0 end as paused from ({D})), h as (select user_id as instrument, date_trunc('hour', ts) as hour, arg_max(value, ts) as close, count(*) as n from events group by 1, 2), g as (select instrument, date, factor, paused, date + to_hours(cast(i as bigint)) as hour from d cross join generate_series(9, 15) s(i)) select g.instrument, cast(g.hour as timestamp) as hour, g.paused, round(h.close * g.factor, 6) as close, round(h.n / g.factor, 6) as volume from g left join h on h.instrument = g.instrument and h.hour = g.hour",
)
def minute_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIT23: bars within the day on a full grid, repriced by the day's factor, with the day's paused flag."""
    d = panels.daily_bars(spark, sf_dir).select("instrument", "date", (1 + F.col("volume") / 10.0).alias("factor"), F.when(F.col("volume") <= 2, 1).otherwise(0).alias("paused"))
    e = table(spark, sf_dir, "events", "user_id", "ts", "value")
    h = e.groupBy(F.col("user_id").alias("instrument"), F.date_trunc("hour", "ts").alias("hour")).agg(F.max_by("value", "ts").alias("close"), F.count("*").alias("n"))
    return rounded(pit.intraday_prices(h, d, range(9, 16)))


@query(
    "pit24_paused_panel",
    f"with p as (select *, volume <= 2 as paused from ({D})), s as (select *, min(case when not paused then date end) over (partition by instrument) as a, max(case when not paused then date end) over (partition by instrument) as b, sum(case when paused then 1 else 0 end) over (partition by instrument order by date) as island from p) select instrument, date, cast(paused as int) as paused, cast(case when paused then 0 else sum(case when paused then 0 else 1 end) over (partition by instrument, island order by date) end as bigint) as paused_num from s where date between a and b",
)
def paused_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIT24: paused days between an instrument's first and last day of trade, and the length of the run of traded days."""
    p = panels.daily_bars(spark, sf_dir).select("instrument", "date", (F.col("volume") <= 2).alias("paused"))
    return pit.paused_days(p)


@query("dql01_03_filtered_rows", f"select instrument, date, close from (select instrument, date, case when instrument % 5 <> 0 then close end as close, case when instrument % 10 <> 0 then volume end as volume from ({D})) where instrument in (1, 2, 5, 10, 11, 20, 25) and date between date '2024-01-02' and date '2024-01-20' and not (close is null and volume is null)")
def filtered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL01, DQL03: predicates built from a dict, rows whose every value is missing dropped."""
    b = panels.daily_bars(spark, sf_dir).select("instrument", "date", F.when(F.col("instrument") % 5 != 0, F.col("close")).alias("close"), F.when(F.col("instrument") % 10 != 0, F.col("volume")).alias("volume"))
    import datetime as dt

    got = vendor.matching(b, {"instrument": [1, 2, 5, 10, 11, 20, 25], "date": (dt.date(2024, 1, 2), dt.date(2024, 1, 20)), "close": None})
    return got.na.drop("all", subset=["close", "volume"]).select("instrument", "date", "close")


_FLAGGED = "select o_custkey % 500 as k, year(o_orderdate) as y, o_orderkey % 3 as flag, o_orderkey as seq, o_totalprice as v from orders"
_PICK = "select k, y, v from (select *, row_number() over (partition by k, y order by flag desc, seq desc) as n from f{}) where n = 1"


@query(
    "dql05_08_statement_check",
    f"with f as ({_FLAGGED}), a as ({_PICK.format('')}), b as (select k, y, case when k % 7 = 0 then v * (1 + 2e-4) when k % 7 = 1 then v * (1 + 5e-5) else v end as v from ({_PICK.format('')}) where k % 11 <> 0) select coalesce(a.k, b.k) as k, coalesce(a.y, b.y) as y, case when b.k is null then 'missing' when a.k is null then 'extra' when a.v is not distinct from b.v or abs(a.v - b.v) <= 1e-4 * greatest(abs(a.v), abs(b.v)) then 'equal' else 'different' end as status from a full join b on a.k = b.k and a.y = b.y",
)
def statement_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL05-DQL08: newest revision by update flag on both sides, then cell by cell."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    f = o.select((F.col("o_custkey") % 500).alias("k"), F.year("o_orderdate").alias("y"), (F.col("o_orderkey") % 3).alias("flag"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("v"))
    a = vendor.newest(f, ["k", "y"], ["flag", "seq"]).select("k", "y", "v")
    bent = F.when(F.col("k") % 7 == 0, F.col("v") * (1 + 2e-4)).when(F.col("k") % 7 == 1, F.col("v") * (1 + 5e-5)).otherwise(F.col("v"))
    return shaping.reconcile(a, a.where("k % 11 <> 0").withColumn("v", bent), ["k", "y"], ["v"])


@query(
    "dql09_13_store_check",
    f"with a as (select instrument, date, close, volume from ({D})), b as (select instrument, date, case when instrument % 5 = 0 then close * 1.002 when instrument % 5 = 1 then close * 1.0005 else close end as close, case when instrument % 8 <> 0 then volume end as volume from a where instrument % 9 <> 0), j as (select coalesce(a.instrument, b.instrument) as instrument, coalesce(a.date, b.date) as date, case when b.instrument is null then 'missing' when a.instrument is null then 'extra' when (a.close is not distinct from b.close or abs(a.close - b.close) <= 1e-3 * greatest(abs(a.close), abs(b.close))) and (a.volume is not distinct from b.volume or coalesce(abs(a.volume - b.volume) <= 1e-3 * greatest(abs(a.volume), abs(b.volume)), false)) then 'equal' else 'different' end as status from a full join b on a.instrument = b.instrument and a.date = b.date) select status, count(*) as n from j group by 1",
)
def store_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL09-DQL11, DQL13: two stores of several columns at a tolerance of 1e-3, counted by outcome."""
    a = panels.daily_bars(spark, sf_dir).select("instrument", "date", "close", "volume")
    i = F.col("instrument")
    b = a.where("instrument % 9 <> 0").select("instrument", "date", F.when(i % 5 == 0, F.col("close") * 1.002).when(i % 5 == 1, F.col("close") * 1.0005).otherwise(F.col("close")).alias("close"), F.when(i % 8 != 0, F.col("volume")).alias("volume"))
    return shaping.reconcile(a, b, ["instrument", "date"], ["close", "volume"], 1e-3).groupBy("status").agg(F.count("*").alias("n"))


_DRIFT = f"with a as (select instrument, date, 1 + volume / 10 as factor from ({D})), d as (select date from (select distinct date from a) order by date desc limit 10), v as (select instrument, date, case when instrument % 6 = 0 then factor * 1.5 else factor end as factor from a where instrument % 7 <> 0)"


@query("dql12_factor_repair", _DRIFT + " select a.instrument, a.date, round(case when d.date is not null and v.factor is not null and abs(a.factor - v.factor) > 1e-4 * greatest(abs(a.factor), abs(v.factor)) then v.factor else a.factor end, 6) as factor from a left join d using (date) left join v on v.instrument = a.instrument and v.date = a.date")
def factor_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL12: factors of the last ten days compared with the vendor's, those that differ replaced in the table."""
    a = panels.daily_bars(spark, sf_dir).select("instrument", "date", (1 + F.col("volume") / 10).alias("factor"))
    days = a.select("date").distinct().orderBy(F.desc("date")).limit(10)
    now = a.where("instrument % 7 <> 0").withColumn("factor", F.when(F.col("instrument") % 6 == 0, F.col("factor") * 1.5).otherwise(F.col("factor")))
    return rounded(shaping.repaired(a, now.join(F.broadcast(days), "date", "left_semi"), ["instrument", "date"], ["factor"]))


_FEATURES = {"mean": "Mean($close, 5)", "ahead": "Ref($close, -2) / Ref($close, -1) - 1"}
_FULL = panel_sql(D, _FEATURES)


@query("dql15_21_incremental_features", rounded_sql(_FULL, "mean ahead", "instrument, date"))
def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL15-DQL16, DQL21: features cached up to a day, then extended: the cached days whose windows reach into new ones are worked out again, the rest stays."""
    bars = panels.daily_bars(spark, sf_dir)
    at = scratch(spark, "features")
    cached = bars.where("date <= date '2024-01-15'")
    write_frame(compile_panel(cached, _FEATURES), at)
    return rounded(pit.extended(read_frame(spark, at), bars, lambda p: compile_panel(p, _FEATURES), back=5, ahead=2).select("instrument", "date", *_FEATURES))


@query("dql14_cache_check", "select 'equal' as status")
def cache_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL14: features read from their cache against features worked out anew, at 1e-6."""
    bars = panels.daily_bars(spark, sf_dir)
    at = scratch(spark, "cache")
    write_frame(compile_panel(bars, _FEATURES), at)
    return shaping.reconcile(read_frame(spark, at), compile_panel(bars, _FEATURES), ["instrument", "date"], list(_FEATURES), 1e-6).select("status").distinct()
