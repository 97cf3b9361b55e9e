"""Relational idioms: SRC, PRJ, JOI, AGG and SCL rows of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.operators import shaping
from tidepanel.queries.base import query, rounded, rounded_sql
from tidepanel.sources import panels
from tidepanel.sources.panels import table

D = panels.DAILY_BARS_SQL
M = panels.MONTHLY_BARS_SQL


@query("src01_scan_range", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderdate between timestamp '1995-01-01' and timestamp '1995-12-31' and o_custkey in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC01, SRC09, PRJ01: column list, date range and key list, all pushed to the scan."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return o.where(F.col("o_orderdate").between("1995-01-01", "1995-12-31") & F.col("o_custkey").isin(1, 2, 3, 5, 8, 13, 21, 34, 55, 89)).drop("o_orderdate")


@query("src03_parameterised_sql", "select c_mktsegment, count(*) as n from customer where c_acctbal > 1000.0 group by 1")
def parameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC03: SQL text with named parameters."""
    return spark.sql("select c_mktsegment, count(*) as n from {c} where c_acctbal > :least group by 1", args={"least": 1000.0}, c=table(spark, sf_dir, "customer"))


@query(
    "src07_08_upsert",
    "select o_orderkey as k, o_totalprice * 2 as v, 'new' as origin from orders where o_orderdate >= timestamp '1998-01-01' union all select o_orderkey, o_totalprice, 'old' from orders where o_orderdate < timestamp '1998-01-01' and o_orderkey % 2 = 0",
)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC07-SRC08, SRC53-SRC55: insert or replace by key."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderdate")
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.lit("old").alias("origin"))
    new = o.where("o_orderdate >= timestamp '1998-01-01'").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") * 2).alias("v"), F.lit("new").alias("origin"))
    return shaping.upsert(old, new, ["k"])


@query("src12_calendar", f"select date, cast(row_number() over (order by date) - 1 as bigint) as idx from (select distinct date from ({D}))")
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12, SRC24: distinct days in order; days of a calendar are few whatever the data."""
    days = panels.daily_bars(spark, sf_dir).select("date").distinct()
    return days.select("date", (F.row_number().over(W.orderBy("date")) - 1).cast("long").alias("idx"))


@query(
    "src11_13_universe",
    f"select instrument, date from ({D}) join (select user_id as u, min(cast(ts as date)) + 3 as a, max(cast(ts as date)) - 3 as b from events group by 1) on u = instrument and date between a and b",
)
def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC11, SRC13, SRC22, JOI14: membership with validity intervals: equi-join on the instrument, then the range."""
    e = table(spark, sf_dir, "events", "user_id", "ts")
    span = e.groupBy(F.col("user_id").alias("instrument")).agg(F.date_add(F.min(F.to_date("ts")), 3).alias("a"), F.date_sub(F.max(F.to_date("ts")), 3).alias("b"))
    return panels.daily_bars(spark, sf_dir).join(span, "instrument").where("date between a and b").select("instrument", "date")


@query("src14_15_loader_units", "select s_suppkey as instrument, regexp_replace(cast(s_nationkey as varchar) || '.0', '\\.0$', '') as industry, round(s_acctbal * 10000, 2) as circ_mv from supplier")
def loader_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC14-SRC15, SRC20-SRC21, PRJ19-PRJ20: codes without their decimal tail, caps in single units."""
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    return s.select(F.col("s_suppkey").alias("instrument"), F.regexp_replace(F.concat(F.col("s_nationkey").cast("string"), F.lit(".0")), r"\.0$", "").alias("industry"), F.round(F.col("s_acctbal") * 10000, 2).alias("circ_mv"))


@query(
    "src16_17_dedup_signal",
    "select user_id, event_type, arg_max(value, (ts, event_id)) as value from events group by 1, 2",
)
def dedup_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC16-SRC17, PRJ16-PRJ17: one row per key, the last in time, as an aggregate."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return shaping.keep_last(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "value")


@query("src18_benchmark_return", rounded_sql(f"select date, lead(c, 2) over (order by date) / nullif(lead(c, 1) over (order by date), 0) - 1 as ret from (select date, avg(close) as c from ({D}) group by date)", "ret", "date"))
def benchmark_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC18: forward return of one date series."""
    b = panels.daily_bars(spark, sf_dir).groupBy("date").agg(F.avg("close").alias("c"))
    w = W.orderBy("date")  # one row per trading day
    return rounded(b.select("date", (F.try_divide(F.lead("c", 2).over(w), F.lead("c", 1).over(w)) - 1).alias("ret")))


@query("src23_25_field_groups", f"select coalesce(a.instrument, b.instrument) as instrument, coalesce(a.date, b.date) as date, a.close, b.volume from (select * from ({D}) where instrument % 3 <> 0) a full join (select * from ({D}) where instrument % 2 = 0) b on a.instrument = b.instrument and a.date = b.date")
def field_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC23, SRC25, SRC28, JOI02: field groups of separate tables, outer-joined on the key."""
    bars = panels.daily_bars(spark, sf_dir)
    return bars.where("instrument % 3 <> 0").select("instrument", "date", "close").join(bars.where("instrument % 2 = 0").select("instrument", "date", "volume"), ["instrument", "date"], "full")


@query("src31_weights", rounded_sql(f"select instrument, date, amount / nullif(sum(amount) over (partition by date), 0) as weight from ({D})", "weight", "instrument, date"))
def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC31, RSK46: share of the date's total."""
    bars = panels.daily_bars(spark, sf_dir)
    return rounded(bars.select("instrument", "date", F.try_divide("amount", F.sum("amount").over(W.partitionBy("date"))).alias("weight")))


@query("src32_latest_position", f"select instrument, date, close from ({D}) where date = (select max(date) from ({D}) where date < date '2024-01-20')")
def latest_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC32, PRJ03-PRJ04: rows of the last date strictly before a day, by a scalar subquery."""
    bars = panels.daily_bars(spark, sf_dir).select("instrument", "date", "close")
    return spark.sql("select * from {b} where date = (select max(date) from {b} where date < date '2024-01-20')", b=bars)


@query("src35_37_text_round_trip", "select n_nationkey, n_name, n_regionkey from nation")
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC35-SRC38: a tab-separated file written and read back under its schema."""
    from tidepanel.sources.files import scratch, write_frame, read_frame

    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    path = scratch(spark, "nation.tsv")
    write_frame(n, path, "csv", sep="\t")
    return read_frame(spark, path, "csv", n.schema, sep="\t")


@query("src59_map_sink", f"select date, count(*) as n, round(max(close), 6) as best from ({D}) group by date")
def map_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC59, SCL21: per day a map of code to score, read back by its keys and values."""
    bars = panels.daily_bars(spark, sf_dir)
    maps = bars.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct(F.col("instrument").cast("string"), F.col("close")))).alias("scores"))
    return maps.select("date", F.size(F.map_keys("scores")).cast("long").alias("n"), F.round(F.array_max(F.map_values("scores")), 6).alias("best"))


@query("src61_74_parse_rows", "select o_orderkey, substr(code, 5) || substr(code, 1, 3) as swapped, strptime(day, '%Y%m%d')::date as day from (select o_orderkey, 'abc.' || cast(o_custkey as varchar) as code, strftime(o_orderdate, '%Y%m%d') as day from orders)")
def parse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC61-SRC75, SCL01-SCL03, SCL06: code suffix to prefix, compact dates parsed, as columns."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    raw = o.select("o_orderkey", F.concat(F.lit("abc."), F.col("o_custkey").cast("string")).alias("code"), F.date_format("o_orderdate", "yyyyMMdd").alias("day"))
    return raw.select("o_orderkey", F.concat(F.split_part("code", F.lit("."), F.lit(2)), F.split_part("code", F.lit("."), F.lit(1))).alias("swapped"), F.to_date("day", "yyyyMMdd").alias("day"))


@query("src65_sparse_factor", f"select instrument, date, coalesce(last_value(f ignore nulls) over (partition by instrument order by date rows between unbounded preceding and current row), 1.0) as factor from (select *, case when volume >= 5 then close end as f from ({D}))")
def sparse_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC65, PRJ15: sparse adjustment factors carried forward, 1 before the first."""
    bars = panels.daily_bars(spark, sf_dir).withColumn("f", F.when(F.col("volume") >= 5, F.col("close")))
    return bars.select("instrument", "date", F.coalesce(shaping.fill(bars, "f", "ffill", ["instrument"], "date"), F.lit(1.0)).alias("factor"))


@query("src76_union_states", "select p_partkey, p_brand, state from (select p_partkey, p_brand, 'small' as state from part where p_size < 10 union all select p_partkey, p_brand, 'large' from part where p_size > 40) where p_brand not in ('Brand#11', 'Brand#12')")
def union_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC76-SRC77, PRJ08, AGG15: union of listing states less excluded codes."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size")
    both = p.where("p_size < 10").withColumn("state", F.lit("small")).unionByName(p.where("p_size > 40").withColumn("state", F.lit("large")))
    return both.where(~F.col("p_brand").isin("Brand#11", "Brand#12")).select("p_partkey", "p_brand", "state")


@query("prj02_trading_days", f"select instrument, date, close from ({D}) where date in (select date from ({D}) group by date having count(*) > 100)")
def trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ02, SCL10, SCL16, JOI18: rows on days of a calendar, days with enough symbols."""
    bars = panels.daily_bars(spark, sf_dir).select("instrument", "date", "close")
    days = bars.groupBy("date").count().where("count > 100").select("date")
    return bars.join(days, "date", "left_semi").select("instrument", "date", "close")


@query("prj05_last_dates", f"select instrument, date, close from (select *, dense_rank() over (order by date desc) as k from ({D})) where k <= 5")
def last_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ05: the last five distinct dates; only these dates are ranked, not the rows."""
    bars = panels.daily_bars(spark, sf_dir).select("instrument", "date", "close")
    days = bars.select("date").distinct().orderBy(F.desc("date")).limit(5)
    return bars.join(days, "date", "left_semi").select("instrument", "date", "close")


@query("prj06_07_symbol_filters", "select p_partkey, p_name from part where regexp_matches(p_brand, '^Brand#[12]') and not contains(p_type, 'STEEL')")
def symbol_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ06-PRJ07: by pattern, and by a word in the name."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    return p.where(F.col("p_brand").rlike("^Brand#[12]") & ~F.contains("p_type", F.lit("STEEL"))).select("p_partkey", "p_name")


_GAPS = f"select instrument, date, case when volume > 1 then close end as x from ({D})"


@query(
    "prj13_14_fills",
    f"""select instrument, date, coalesce(x, 0) as zero, last_value(x ignore nulls) over f as ffill, first_value(x ignore nulls) over b as bfill,
    coalesce(last_value(x ignore nulls) over f, first_value(x ignore nulls) over b) as both_ways, round(coalesce(x, avg(x) over (partition by date)), 6) as mean_fill
    from ({_GAPS}) window f as (partition by instrument order by date rows between unbounded preceding and current row), b as (partition by instrument order by date rows between current row and unbounded following)""",
)
def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ10, PRJ13-PRJ14: the five fills."""
    p = panels.daily_bars(spark, sf_dir).select("instrument", "date", F.when(F.col("volume") > 1, F.col("close")).alias("x"))
    own = dict(by=["instrument"], order="date")
    return p.select(
        "instrument", "date", shaping.fill(p, "x", "zero", []).alias("zero"), shaping.fill(p, "x", "ffill", **own).alias("ffill"), shaping.fill(p, "x", "bfill", **own).alias("bfill"),
        shaping.fill(p, "x", "ffill_bfill", **own).alias("both_ways"), F.round(shaping.fill(p, "x", "mean", ["date"]), 6).alias("mean_fill"),
    )


@query("prj09_12_missing", f"select instrument, date, round(close / nullif(volume - 1, 0), 6) as ratio from ({D}) where close is not null and volume - 1 <> 0")
def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ09, PRJ11-PRJ12, PRJ24: zero denominators and non-finite numbers to NULL, then dropped."""
    p = panels.daily_bars(spark, sf_dir).select("instrument", "date", F.try_divide("close", F.nullif(F.col("volume") - 1, F.lit(0.0))).alias("ratio"))
    return rounded(shaping.not_finite_to_null(p).na.drop("any", subset=["ratio"]))


@query("prj18_22_columns", f"select instrument as code, date as day, round(close * 100, 2) as feature__close, round(volume / 1000, 6) as label__volume from ({D})")
def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ18, PRJ20-PRJ23: renames, scales, rounding per column, grouped column names."""
    p = panels.daily_bars(spark, sf_dir).withColumnsRenamed({"instrument": "code", "date": "day"})
    return p.select("code", "day", F.round(F.col("close") * 100, 2).alias("feature__close"), F.round(F.col("volume") / 1000, 6).alias("label__volume"))


@query("joi01_04_equi_joins", "select o_orderkey, c_name, coalesce(n, 0) as n_lines from orders join customer on o_custkey = c_custkey left join (select l_orderkey, count(*) as n from lineitem where l_discount > 0.05 group by 1) on l_orderkey = o_orderkey")
def equi_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI01, JOI03-JOI04: inner join, and a left join onto a key set with a fill; lines are counted before they are joined."""
    o, c = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), table(spark, sf_dir, "customer", "c_custkey", "c_name")
    n = table(spark, sf_dir, "lineitem", "l_orderkey", "l_discount").where("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, "o_orderkey", "left").select("o_orderkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query("joi05_06_key_sets", "select count(*) filter (where a is not null and b is not null) as common, count(*) as everything, round(sum(coalesce(a, 0) - coalesce(b, 0)), 4) as active from (select l_suppkey, sum(l_quantity) as a from lineitem where l_returnflag = 'R' group by 1) x full join (select l_suppkey, sum(l_quantity) as b from lineitem where l_returnflag = 'A' group by 1) y on x.l_suppkey = y.l_suppkey")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI05-JOI06, AGG17-AGG18, RSK49: keys in common, and a full join with zeros."""
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag", "l_quantity")
    a, b = (li.where(F.col("l_returnflag") == f).groupBy("l_suppkey").agg(F.sum("l_quantity").alias(n)) for f, n in (("R", "a"), ("A", "b")))
    j = a.join(b, "l_suppkey", "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return j.agg(F.count_if(both).alias("common"), F.count("*").alias("everything"), F.round(F.sum(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))), 4).alias("active"))


@query(
    "joi09_history_join",
    f"select a.instrument, a.date, count(b.date) as n, round(avg(b.close), 6) as past from ({M}) a left join ({M}) b on a.instrument = b.instrument and month(a.date) = month(b.date) and year(b.date) between year(a.date) - 5 and year(a.date) - 1 group by 1, 2",
)
def history_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI09, CNE13: the same month in the five years before: equi-join on instrument and month with a year range."""
    p = panels.monthly_bars(spark, sf_dir).select("instrument", "date", "close", F.year("date").alias("y"), F.month("date").alias("m"))
    b = p.select(F.col("instrument").alias("ib"), F.col("m").alias("mb"), F.col("y").alias("yb"), F.col("close").alias("cb"))
    j = p.join(b, (F.col("instrument") == F.col("ib")) & (F.col("m") == F.col("mb")) & F.col("yb").between(F.col("y") - 5, F.col("y") - 1), "left")
    return j.groupBy("instrument", "date").agg(F.count("cb").alias("n"), F.round(F.avg("cb"), 6).alias("past"))


@query("joi10_newest_flag", "select o_orderkey from orders a where not exists (select 1 from orders b where a.o_custkey = b.o_custkey and b.o_orderdate > a.o_orderdate)")
def newest_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI10: rows without a newer one of the same key; an aggregate per key in place of the anti join's pairs."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    newest = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"))
    return o.join(newest, ["o_custkey", "o_orderdate"]).select("o_orderkey")


@query("joi11_three_tables", "select o_orderkey, c_mktsegment, n_name from orders join customer on o_custkey = c_custkey left join nation on n_nationkey = c_nationkey where o_orderpriority = '1-URGENT'")
def three_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI11: a join and a left join with the filter on the scan."""
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return spark.sql("select o_orderkey, c_mktsegment, n_name from {o} join {c} on o_custkey = c_custkey left join {n} on n_nationkey = c_nationkey where o_orderpriority = '1-URGENT'", o=o, c=c, n=n)


@query("joi12_unpivot", f"select instrument, date, field, value from (unpivot (select instrument, date, open, high, low, close from ({D})) on open, high, low, close into name field value value)")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI12, AGG13, PIT11: wide columns to (field, value)."""
    return panels.daily_bars(spark, sf_dir).unpivot(["instrument", "date"], ["open", "high", "low", "close"], "field", "value")


@query(
    "joi13_as_of",
    f"select c.instrument, c.date, round(f.value, 6) as value from (select distinct c_nationkey as instrument, cast(l_shipdate as date) as date from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey) c asof left join (select instrument, ann_date, max(value) as value from ({panels.FILINGS_SQL}) group by 1, 2) f on c.instrument = f.instrument and c.date >= f.ann_date",
)
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI13, PIT03: last event at or before each date."""
    li, o, c = table(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate"), table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    grid = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("instrument"), F.to_date("l_shipdate").alias("date")).distinct()
    return rounded(shaping.as_of(grid, panels.filings(spark, sf_dir), "instrument", "date", "ann_date", ["value"]))


@query("joi15_listing_window", f"select instrument, date, first_value(date) over w >= date '2024-01-03' as listed from ({D}) window w as (partition by instrument order by date rows between 4 preceding and current row)")
def listing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI15: whether a listing date precedes the start of a row's window."""
    w = W.partitionBy("instrument").orderBy("date").rowsBetween(-4, 0)
    return panels.daily_bars(spark, sf_dir).select("instrument", "date", (F.first("date").over(w) >= F.lit("2024-01-03").cast("date")).alias("listed"))


@query("joi17_densify", f"select i.instrument, d.date, b.close from (select distinct instrument from ({D})) i cross join (select distinct date from ({D})) d left join ({D}) b on b.instrument = i.instrument and b.date = d.date")
def densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI17, DQL20: every instrument on every date."""
    return shaping.densify(panels.daily_bars(spark, sf_dir).select("instrument", "date", "close"))


@query("joi19_anti", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI19, AGG16: keys that another table lacks."""
    return table(spark, sf_dir, "customer", "c_custkey").join(table(spark, sf_dir, "orders", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


_PAIRS = [("open", "high"), ("open", "close"), ("high", "low"), ("close", "volume")]


@query("joi20_pair_correlations", "select " + ", ".join(f"round(corr({a}, {b}), 6) as {a}_{b}" for a, b in _PAIRS) + f" from ({D})")
def pair_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI20, XSN21-XSN22, GPS28: correlations of column pairs in one pass."""
    from tidepanel.operators.cross import safe_corr

    return rounded(panels.daily_bars(spark, sf_dir).agg(*(safe_corr(F.col(a), F.col(b)).alias(f"{a}_{b}") for a, b in _PAIRS)))


@query("agg01_09_aggregates", "select l_returnflag, count(*) as n, round(sum(l_quantity), 4) as s, round(sum(l_quantity * l_quantity), 4) as ss, round(avg(l_tax), 6) as m, round(stddev_samp(l_discount), 6) as sd, count(distinct l_suppkey) as u, round(avg(case when l_discount > 0.05 then 1.0 else 0.0 end), 6) as share, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) as first_order, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as wmean from lineitem group by 1")
def aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG01-AGG02, AGG04-AGG06, AGG08-AGG09: named aggregates in one pass."""
    li = table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_tax", "l_discount", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    q = F.col("l_quantity")
    return li.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.sum(q), 4).alias("s"), F.round(F.sum(q * q), 4).alias("ss"), F.round(F.avg("l_tax"), 6).alias("m"), F.round(F.stddev_samp("l_discount"), 6).alias("sd"),
        F.count_distinct("l_suppkey").alias("u"), F.round(F.avg((F.col("l_discount") > 0.05).cast("double")), 6).alias("share"),
        F.min_by("l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("first_order"), F.round(F.sum(F.col("l_extendedprice") * q) / F.sum(q), 4).alias("wmean"),
    )


@query("agg03_transform", rounded_sql(f"select instrument, date, close - avg(close) over (partition by instrument) as less_mean, count(*) over (partition by date) as n from ({D})", "less_mean", "instrument, date, n"))
def transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG03: group values on every row."""
    p = panels.daily_bars(spark, sf_dir)
    return rounded(p.select("instrument", "date", F.count("*").over(W.partitionBy("date")).alias("n"), (F.col("close") - F.avg("close").over(W.partitionBy("instrument"))).alias("less_mean")))


@query("agg05_compound", rounded_sql(f"select instrument, product(1 + x) - 1 as total from (select instrument, least(coalesce(close / nullif(lag(close) over (partition by instrument order by date), 0) - 1, 0), 0.5) as x from ({D})) group by 1", "total", "instrument"))
def compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG05, EVL15: compounded return."""
    w = W.partitionBy("instrument").orderBy("date")
    x = F.least(F.coalesce(F.try_divide("close", F.lag("close").over(w)) - 1, F.lit(0.0)), F.lit(0.5))
    return rounded(panels.daily_bars(spark, sf_dir).select("instrument", x.alias("x")).groupBy("instrument").agg((F.product(1 + F.col("x")) - 1).alias("total")))


@query("agg07_having", "select user_id, event_type, count(*) as n from events group by 1, 2 having count(*) > 15")
def having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG07: groups above a count."""
    return table(spark, sf_dir, "events", "user_id", "event_type").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n > 15")


@query("agg10_quantiles", f"select date, round(quantile_cont(close, 0.25), 6) as q25, round(median(close), 6) as med, round(mad(close), 6) as mad from ({D}) group by date")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG10: exact interpolated quantiles and the median deviation, in two aggregates."""
    p = panels.daily_bars(spark, sf_dir).select("date", "close")
    q = p.groupBy("date").agg(F.percentile("close", F.array(F.lit(0.25), F.lit(0.5))).alias("q"))
    dev = p.join(q, "date").groupBy("date", "q").agg(F.percentile(F.abs(F.col("close") - F.col("q")[1]), F.lit(0.5)).alias("mad"))
    return rounded(dev.select("date", F.col("q")[0].alias("q25"), F.col("q")[1].alias("med"), "mad"))


@query("agg12_pivot", "select cast(ts as date) as date, " + ", ".join(f"coalesce(sum(value) filter (where event_type = '{t}'), 0) as {t}" for t in ("click", "view", "purchase")) + " from events where event_type in ('click', 'view', 'purchase') group by 1")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12, AGG14: long to wide with the values named, so that no pass is spent on finding them."""
    e = table(spark, sf_dir, "events", "ts", "event_type", "value").where(F.col("event_type").isin("click", "view", "purchase"))
    wide = e.groupBy(F.to_date("ts").alias("date")).pivot("event_type", ["click", "view", "purchase"]).agg(F.sum("value"))
    return wide.na.fill(0.0)


@query("agg21_top_k", f"select instrument, date, k from (select instrument, date, row_number() over (partition by date order by close desc, instrument) as k from ({D})) where k <= 5")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG19-AGG22, PFO/MLB72: the five best of each date."""
    w = W.partitionBy("date").orderBy(F.desc("close"), "instrument")
    return panels.daily_bars(spark, sf_dir).select("instrument", "date", F.row_number().over(w).alias("k")).where("k <= 5")


@query("scl04_05_codes", "select n_nationkey, case when left(code, 2) = 'SH' then right(code, 6) || '.XSHG' else right(code, 6) || '.XSHE' end as jq, lower(left(code, 2)) as exchange from (select n_nationkey, case when n_nationkey % 2 = 0 then 'SH' else 'SZ' end || lpad(cast(600000 + n_nationkey as varchar), 6, '0') as code from nation)")
def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL04-SCL05: exchange prefixes and suffixes."""
    from tidepanel.functions.scalars import prefixed_to_exchange

    code = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "SH").otherwise("SZ"), F.lpad((F.col("n_nationkey") + 600000).cast("string"), 6, "0"))
    n = table(spark, sf_dir, "nation", "n_nationkey").withColumn("code", code)
    return n.select("n_nationkey", prefixed_to_exchange(F.col("code")).alias("jq"), F.lower(F.left("code", F.lit(2))).alias("exchange"))


@query("scl07_09_months", "select o_orderkey, (cast(o_orderdate as date) - interval 1 month)::date as back, date_trunc('month', o_orderdate)::date as first_day, last_day(o_orderdate) as last_day, (date_trunc('month', o_orderdate) - interval 1 month)::date as last_first from orders")
def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL07-SCL09, SCL17: month arithmetic with end-of-month clamp."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    d = F.to_date("o_orderdate")
    first = F.to_date(F.trunc(d, "month"))
    return o.select("o_orderkey", F.add_months(d, -1).alias("back"), first.alias("first_day"), F.last_day(d).alias("last_day"), F.add_months(first, -1).alias("last_first"))


@query("scl11_14_shifted_days", f"with c as (select date, row_number() over (order by date) as k from (select distinct date from ({D}))) select a.date, p.date as three_before, n.date as two_after from c a left join c p on p.k = a.k - 3 left join c n on n.k = a.k + 2")
def shifted_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL11-SCL14: n-th trading day before and after."""
    days = panels.daily_bars(spark, sf_dir).select("date").distinct()
    w = W.orderBy("date")  # one row per trading day
    return days.select("date", F.lag("date", 3).over(w).alias("three_before"), F.lead("date", 2).over(w).alias("two_after"))


@query("scl15_18_grids", "select unnest(generate_series(timestamp '2024-01-02 09:30:00', timestamp '2024-01-02 11:29:00', interval 1 minute)) as minute union all select unnest(generate_series(timestamp '2024-01-02 13:00:00', timestamp '2024-01-02 14:59:00', interval 1 minute))")
def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL15, SCL18: minutes of both sessions of a day."""
    from tidepanel.functions.scalars import minute_grid

    return spark.range(1).select(F.explode(minute_grid(F.lit("2024-01-02").cast("date"))).alias("minute"))


@query("scl19_20_math", f"select instrument, date, round(ln(close + 1), 6) as l, round(sqrt(abs(close - open)), 6) as r, round(exp(-volume), 6) as e, floor(close / 10) as f, cast(case when close > open then 1.0 when close < open then -1.0 else 0.0 end as double) as s, least(greatest(close, 1.0), 50.0) as clipped from ({D})")
def math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL19-SCL20: elementwise functions."""
    p = panels.daily_bars(spark, sf_dir)
    c = F.col("close")
    return p.select(
        "instrument", "date", F.round(F.ln(c + 1), 6).alias("l"), F.round(F.sqrt(F.abs(c - F.col("open"))), 6).alias("r"), F.round(F.exp(-F.col("volume")), 6).alias("e"),
        F.floor(c / 10).cast("double").alias("f"), F.signum(c - F.col("open")).alias("s"), F.least(F.greatest(c, F.lit(1.0)), F.lit(50.0)).alias("clipped"),
    )
