"""Streaming counterparts of batch work: panels and point-in-time values kept current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.plans.expression import panel_sql
from tidepanel.queries.analytics import ttm_ctes
from tidepanel.queries.base import query, rounded, rounded_sql
from tidepanel.sources import panels
from tidepanel.sources.files import scratch
from tidepanel.streaming import append, bars, filings


@query("str01_streaming_bars", f"select instrument, date, open, high, low, close, volume from ({panels.DAILY_BARS_SQL})")
def streaming_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by a windowed aggregate with a watermark, drained once."""
    return bars.drain(bars.daily_bars(bars.event_stream(spark, sf_dir)))


@query("str02_running_mean", "with e as (select user_id as instrument, value, row_number() over (partition by user_id order by ts desc, event_id desc) - 1 as age from events where value is not null) select instrument, round(sum(value * power(1 - 2.0 / 11, age)) / sum(power(1 - 2.0 / 11, age)), 6) + 0.0 as mean, count(*) as n from e group by 1")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential mean per user with state kept between batches."""
    return rounded(bars.drain(bars.running_mean(bars.event_stream(spark, sf_dir)), "update", ["instrument"]))


@query("str03_distinct_events", "select distinct event_id, user_id, ts, value from events where event_id % 3 = 0")
def distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive twice within the watermark, once."""
    e = bars.event_stream(spark, sf_dir).where("event_id % 3 = 0").select("event_id", "user_id", "ts", "value")
    twice = e.unionByName(bars.event_stream(spark, sf_dir).where("event_id % 6 = 0").select("event_id", "user_id", "ts", "value"))
    return bars.drain(bars.distinct_events(twice, ["event_id"]), "append")


_STATEMENTS = "select o_custkey // 50 as instrument, (year(o_orderdate) * 100 + quarter(o_orderdate))::int as period, cast(date_trunc('month', o_orderdate) as date) as ann_date, o_orderkey % 5 as flag, o_orderkey as seq, o_totalprice as value from orders"


@query("str04_restated_statements", f"select instrument, period, ann_date, max(flag) as flag, arg_max(seq, (flag, seq)) as seq, arg_max(value, (flag, seq)) as value from ({_STATEMENTS}) group by 1, 2, 3")
def restated_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements whose newest flag wins after another row was told: orders of a month are one statement, each told up to 45 days late, in three parts with a restart between them."""
    o = panels.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    d = F.to_date("o_orderdate")
    rows = o.select(
        F.floor(F.col("o_custkey") / 50).alias("instrument"), (F.year(d) * 100 + F.quarter(d)).cast("int").alias("period"), F.to_date(F.trunc(d, "month")).alias("ann_date"), (F.col("o_orderkey") % 5).alias("flag"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"), F.date_add(d, (F.col("o_orderkey") % 46).cast("int")).alias("told")
    )
    edge = rows.agg(F.min("told").alias("a"), F.max("told").alias("b")).first()
    cut = [edge["a"] + (edge["b"] - edge["a"]) * i / 3 for i in (1, 2)] if edge["a"] else [None, None]
    early, middle = F.col("told") <= F.lit(cut[0]), F.col("told") <= F.lit(cut[1])
    parts = [rows.where(early), rows.where(~early & middle), rows.where(~middle)]
    said = bars.drain_in_parts([p.drop("told") for p in parts], lambda s: filings.restated(s, "100 days", 130), ["instrument", "period", "ann_date"])
    return said.drop("restated")


@query("str05_trailing_values", "with " + ttm_ctes() + " select instrument, ann_date, seq, period, round(ttm, 4) + 0.0 as ttm from r where ttm is not null")
def trailing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing twelve months from filings that come in any order, in three parts with a restart between them; late ones correct what was told."""
    f = panels.filings(spark, sf_dir)
    part = F.pmod(F.xxhash64("seq"), F.lit(3))
    said = bars.drain_in_parts([f.where(part == i) for i in range(3)], filings.trailing, ["instrument", "ann_day", "seq", "period"])
    return rounded(said.where("ttm is not null").select("instrument", F.date_from_unix_date(F.col("ann_day").cast("int")).alias("ann_date"), "seq", "period", "ttm"), 4)


_KEPT = {"mean": "Mean($close, 5)", "change": "$close / Ref($close, 1) - 1", "label": "Ref($close, -2) / Ref($close, -1) - 1"}


@query("str06_appended_features", rounded_sql(panel_sql(panels.MONTHLY_BARS_SQL, _KEPT), " ".join(_KEPT), "instrument, date", 4))
def appended_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQL15-DQL16 as a stream: bars come in three batches, the rows before each that look ahead are written anew."""
    into, at = scratch(spark, "bars"), scratch(spark, "features")
    rows = panels.monthly_bars(spark, sf_dir)
    store = append.FeatureStore(spark, at, rows.schema, _KEPT)
    years = F.when(F.year("date") < 1997, 0).when(F.year("date") < 1999, 1).otherwise(2)
    for i in range(3):
        rows.where(years == i).write.parquet(f"{into}/part={i}")
        store.follow(spark.readStream.schema(rows.schema).parquet(f"{into}/part=*"), f"{at}-state")
    return rounded(store.features(), 4)
