"""Panels derived from the base tables.

A panel is a DataFrame keyed by (instrument, date) with one double column per
field.  Missing values are NULL: NaN and infinities are turned into NULL here
and never produced further on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table, cut down to ``columns`` where some are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def finite(c: Column) -> Column:
    """NULL in place of NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars per user and day from ``events``: one shuffle with partial aggregation."""
    e = table(spark, sf_dir, "events", "user_id", "ts", "value").withColumn("value", finite(F.col("value")))
    return e.groupBy(F.col("user_id").alias("instrument"), F.to_date("ts").alias("date")).agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
        F.count("value").cast("double").alias("volume"),
        F.sum("value").alias("amount"),
    )


DAILY_BARS_SQL = """
select user_id as instrument, cast(ts as date) as date, arg_min(value, ts) as open, max(value) as high, min(value) as low,
       arg_max(value, ts) as close, cast(count(value) as double) as volume, sum(value) as amount
from events group by 1, 2
"""


def monthly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars per supplier and month from ``lineitem`` (price = extended price per unit)."""
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    price = F.try_divide("l_extendedprice", "l_quantity")
    return li.groupBy(F.col("l_suppkey").alias("instrument"), F.to_date(F.trunc(F.to_date("l_shipdate"), "month")).alias("date")).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("amount"),
    )


MONTHLY_BARS_SQL = """
select l_suppkey as instrument, cast(date_trunc('month', l_shipdate) as date) as date,
       arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) as open,
       max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
       arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) as close,
       sum(l_quantity) as volume, sum(l_extendedprice) as amount
from lineitem group by 1, 2
"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-in-time events: (instrument, ann_date, period yyyyqq, value, seq), one per order; fifty customers file as one, so their number grows with the data."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    d = F.to_date("o_orderdate")
    return o.select(
        F.floor(F.col("o_custkey") / 50).alias("instrument"), d.alias("ann_date"), (F.year(d) * 100 + F.quarter(d)).alias("period"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq")
    )


FILINGS_SQL = """
select o_custkey // 50 as instrument, cast(o_orderdate as date) as ann_date, year(o_orderdate) * 100 + quarter(o_orderdate) as period,
       o_totalprice as value, o_orderkey as seq
from orders
"""


def classified_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars with an industry (nation) and a market cap per supplier."""
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    cap = F.col("s_acctbal") + 2000.0
    info = s.select(F.col("s_suppkey").alias("instrument"), F.concat(F.lit("ind_"), F.pmod("s_nationkey", F.lit(7))).alias("industry"), cap.alias("cap0"))
    bars = monthly_bars(spark, sf_dir).join(info, "instrument")
    return bars.withColumn("circ_mv", F.col("cap0") * (F.lit(1.0) + F.col("volume") / 1000.0)).drop("cap0")


def last_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified bars of the last month that has any.  The month is looked up first, so that bars of no other one are made."""
    shipped = table(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_shipdate").alias("last"))
    known = shipped.join(table(spark, sf_dir, "supplier", "s_suppkey"), "s_suppkey", "left_semi")
    month = known.agg(F.to_date(F.trunc(F.to_date(F.max("last")), "month"))).first()[0]
    return classified_bars(spark, sf_dir).where(F.col("date") == F.lit(month))


CLASSIFIED_SQL = f"""
select b.*, 'ind_' || (s_nationkey % 7) as industry, (s_acctbal + 2000.0) * (1.0 + volume / 1000.0) as circ_mv
from ({MONTHLY_BARS_SQL}) b join supplier on s_suppkey = instrument
"""
