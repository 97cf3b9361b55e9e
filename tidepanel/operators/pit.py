"""Point-in-time operators: trailing twelve months, fiscal years, price adjustment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.functions.scalars import fiscal_year
from tidepanel.operators.shaping import as_of, keep_last


def ttm_events(events: DataFrame) -> DataFrame:
    """(instrument, ann_date, seq, period, ttm) per event whose needed values were already announced.

    Fourth quarter: the value.  Else value + last year's annual - last year's
    same quarter, both as known at the event; NULL values count as not announced.
    """
    e = events.where("value is not null").withColumn("t", F.struct("ann_date", "seq"))
    known = e.select("instrument", F.col("period").alias("want"), F.col("t").alias("told"), F.col("value").alias("was"))
    year, quarter = F.floor(F.col("period") / 100), F.col("period") % 100
    # each lookup is an as-of join on (instrument, period looked for)
    out = e.withColumn("want", ((year - 1) * 100 + 4).cast("int"))
    out = as_of(out, known, ["instrument", "want"], "t", "told", ["was"]).withColumnRenamed("was", "annual").withColumn("want", F.col("period") - 100)
    out = as_of(out, known, ["instrument", "want"], "t", "told", ["was"])
    ttm = F.when(quarter == 4, F.col("value")).otherwise(F.col("value") + F.col("annual") - F.col("was"))
    return out.select("instrument", "ann_date", "seq", "period", ttm.alias("ttm")).where("ttm is not null")


def ttm_on_dates(events: DataFrame, grid: DataFrame) -> DataFrame:
    """``grid`` (instrument, date) with the trailing twelve months known on each date."""
    per_day = keep_last(ttm_events(events), ["instrument", "ann_date"], [F.col("period"), F.col("seq")]).select("instrument", "ann_date", "ttm")
    return as_of(grid, per_day, "instrument", "date", "ann_date", ["ttm"])


def ttm_features(events: DataFrame, grid: DataFrame, fields: list[str]) -> DataFrame:
    """``grid`` (instrument, date) with a trailing-twelve-month column per field of ``events`` (instrument, field, ann_date, seq, period, value).

    All fields go through the same as-of joins, keyed by instrument and field.
    """
    key = F.struct("instrument", "field")
    keyed = events.where(F.col("field").isin(*fields)).withColumn("instrument", key).drop("field")
    asked = grid.select("instrument", "date", F.explode(F.array(*(F.lit(f) for f in fields))).alias("field")).select(key.alias("instrument"), "date")
    long = ttm_on_dates(keyed, asked).select("instrument.instrument", "instrument.field", "date", "ttm")
    return long.groupBy("instrument", "date").pivot("field", fields).agg(F.first("ttm"))


def annual_values(panel: DataFrame, value: str) -> DataFrame:
    """(instrument, fy, value): the first value on a day of each fiscal year."""
    p = panel.where(F.col(value).isNotNull()).select("instrument", fiscal_year(F.col("date")).alias("fy"), "date", value)
    return p.groupBy("instrument", "fy").agg(F.min_by(value, "date").alias("value"))


def growth(annual: DataFrame, window: int = 5, least: int = 3, magnitude: bool = False) -> DataFrame:
    """``annual`` with growth (slope over mean) and cv (deviation over mean, or its ``magnitude``) of the last years; NULL where the mean is under 1e-6."""
    own = W.partitionBy("instrument").orderBy("fy")
    w = own.rowsBetween(-(window - 1), 0)
    p = annual.withColumn("rn", F.row_number().over(own)).withColumn("at", F.when(F.col("value").isNotNull(), F.col("rn").cast("double")))
    n, mean = F.count("value").over(w), F.avg("value").over(w)
    slope = F.try_divide(F.covar_samp("value", "at").over(w), F.var_samp("at").over(w))
    enough = (n >= least) & (F.abs(mean) >= 1e-6)
    return p.select(*annual.columns, F.when(enough, F.try_divide(slope, mean)).alias("growth"), F.when(enough, F.try_divide(F.stddev_samp("value").over(w), F.abs(mean) if magnitude else mean)).alias("cv"))


def annual_to_daily(annual: DataFrame, daily: DataFrame, column: str) -> DataFrame:
    """``daily`` (instrument, date) with an annual column by fiscal year."""
    return daily.withColumn("fy", fiscal_year(F.col("date"))).join(annual.select("instrument", "fy", column), ["instrument", "fy"], "left").drop("fy")


def adjust_prices(panel: DataFrame, factor: str, end_date: str, prices: list[str], volume: str) -> DataFrame:
    """Backward and forward adjusted prices: ``<p>_hfq`` = p * factor, ``<p>_qfq`` scaled by the factor on ``end_date``; volume / factor.

    Instruments without a row on ``end_date`` have no forward scale and drop out.
    """
    last = panel.where(F.col("date") == F.lit(end_date).cast("date")).select("instrument", F.col(factor).alias("f_end"))
    out = panel.join(last, "instrument")
    for p in prices:
        out = out.withColumn(f"{p}_hfq", F.col(p) * F.col(factor)).withColumn(f"{p}_qfq", F.try_divide(F.col(p) * F.col(factor), F.col("f_end")))
    return out.withColumn(volume, F.try_divide(volume, factor)).drop("f_end")


def finished_panel(panel: DataFrame) -> DataFrame:
    """Bars (close, volume, amount, factor) backward adjusted, lots and thousands in single units, with the change from row to row, rounded."""
    own = W.partitionBy("instrument").orderBy("date")
    p = panel.withColumn("close", F.col("close") * F.col("factor")).withColumn("volume", F.try_divide("volume", "factor") * 100).withColumn("amount", F.col("amount") * 1000)
    before = F.lag("close").over(own)
    p = p.withColumn("change", F.try_divide(F.col("close") - before, F.nullif(before, F.lit(0.0))))
    digits = {"close": 2, "volume": 2, "amount": 3, "change": 4, "factor": 4}
    return p.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in p.columns))


def intraday_prices(bars: DataFrame, days: DataFrame, hours: range) -> DataFrame:
    """(instrument, hour, paused, close, volume) on every hour of ``hours`` of each day, repriced by the day's factor.

    ``bars`` is (instrument, hour, close, n), ``days`` (instrument, date, factor,
    paused).  The grid is an array per day, exploded: no product with a calendar.
    """
    start = F.col("date").cast("timestamp")
    at = F.explode(F.transform(F.array(*map(F.lit, hours)), lambda h: F.timestamp_add("HOUR", h, start)))
    grid = days.select("instrument", "factor", "paused", at.alias("hour"))
    out = grid.join(bars, ["instrument", "hour"], "left")
    return out.select("instrument", "hour", "paused", (F.col("close") * F.col("factor")).alias("close"), F.try_divide("n", "factor").alias("volume"))


def paused_days(panel: DataFrame) -> DataFrame:
    """(instrument, date, paused, paused_num) between each instrument's first and last day that isn't paused; the number counts the run of traded days, 0 on paused ones."""
    every = W.partitionBy("instrument")
    w = every.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    live = F.when(~F.col("paused"), F.col("date"))
    p = panel.select("instrument", "date", "paused", F.min(live).over(every).alias("a"), F.max(live).over(every).alias("b"), F.sum(F.col("paused").cast("int")).over(w).alias("island"))
    run = F.sum((~F.col("paused")).cast("int")).over(W.partitionBy("instrument", "island").orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    return p.where("date between a and b").select("instrument", "date", F.col("paused").cast("int").alias("paused"), F.when(F.col("paused"), 0).otherwise(run).cast("long").alias("paused_num"))


def extended(cached: DataFrame, panel: DataFrame, compute: Callable[[DataFrame], DataFrame], back: int, ahead: int) -> DataFrame:
    """``cached`` features carried on to all rows of ``panel``.

    An instrument's last ``ahead`` cached rows looked at days that weren't there and
    are worked out again with the new ones, from a panel that reaches ``back`` rows
    further into the past; older rows stay as they are.  Both cuts are places
    from the end of each instrument's cached rows.
    """
    own = W.partitionBy("instrument").orderBy(F.desc("date"))
    place = cached.select("instrument", "date", F.row_number().over(own).alias("place"))
    known = panel.select("instrument", "date").join(place, ["instrument", "date"], "left")
    need = panel.join(known.where(F.coalesce("place", F.lit(0)) <= ahead + back).select("instrument", "date"), ["instrument", "date"], "left_semi")
    fresh = known.where(F.coalesce("place", F.lit(0)) <= ahead).select("instrument", "date")
    new = compute(need).join(fresh, ["instrument", "date"], "left_semi")
    return cached.join(place.where(F.col("place") > ahead).select("instrument", "date"), ["instrument", "date"], "left_semi").unionByName(new, allowMissingColumns=True)
