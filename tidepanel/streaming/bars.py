"""Panels kept up to date from a stream of events (Structured Streaming)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.operators.shaping import keep_last
from tidepanel.sources.files import scratch


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a file stream, under the schema of the table."""
    # a pattern, as a stream's source may be a single file only by one
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/event[s].parquet")


def daily_bars(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Bars per user and day; state of a day is dropped once the watermark has passed it."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    day = F.window("ts", "1 day")
    bars = e.groupBy(F.col("user_id").alias("instrument"), day).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("value").cast("double").alias("volume")
    )
    return bars.select("instrument", F.to_date("window.start").alias("date"), "open", "high", "low", "close", "volume")


def distinct_events(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """Events without repeats that arrive within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def running_mean(events: DataFrame, span: int = 10) -> DataFrame:
    """Exponential mean of each user's values in order of arrival, with state per user.

    A user's rows of one batch of the stream come to the step in pieces of any
    order, so they are put in order (ts, event_id) together.
    """
    keep = 1 - 2 / (span + 1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        num, den, n = state.get if state.exists else (0.0, 0.0, 0)
        own = pd.concat([pdf.loc[pdf["value"].notna(), ["ts", "event_id", "value"]] for pdf in batches])
        v = own.sort_values(["ts", "event_id"])["value"].to_numpy(float)
        fade = keep ** np.arange(len(v) - 1, -1, -1.0)
        num, den, n = num * keep ** len(v) + float(v @ fade), den * keep ** len(v) + float(fade.sum()), n + len(v)
        state.update((num, den, n))
        yield pd.DataFrame({"instrument": [key[0]], "mean": [num / den if den else None], "n": [n]})

    named = events.select(F.col("user_id").alias("instrument"), "ts", "event_id", "value")
    return named.groupBy("instrument").applyInPandasWithState(step, "instrument long, mean double, n long", "num double, den double, n long", "update", "NoTimeout")


def drain(stream: DataFrame, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there now and return what it said.

    ``complete`` keeps the last batch, ``append`` all of them; ``update`` keeps
    each key's last word.  A batch that is run again after a failure writes over
    its own folder.
    """
    spark = stream.sparkSession
    out, at = scratch(spark, "stream-out"), scratch(spark, "stream-state")
    schema = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    if mode == "complete":
        return spark.read.schema(schema).parquet(out)
    said = spark.read.schema(T.StructType([*schema, T.StructField("batch", T.LongType())])).parquet(out)
    return (keep_last(said, keys, [F.col("batch")]) if mode == "update" and keys else said).drop("batch")


def drain_in_parts(parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """The last word for each key of an updating stream whose input comes in ``parts``.

    The query ends after each part and goes on from its checkpoint with the next,
    as after a restart.  A batch that is run again writes over its own folder.
    """
    spark = parts[0].sparkSession
    into, out, at = scratch(spark, "stream-in"), scratch(spark, "stream-out"), scratch(spark, "stream-state")
    for i, part in enumerate(parts):
        part.write.parquet(f"{into}/part={i}")
        told = make(spark.readStream.schema(parts[0].schema).parquet(f"{into}/part=*"))
        schema = told.schema
        put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        told.writeStream.outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    said = spark.read.schema(T.StructType([*schema, T.StructField("batch", T.LongType())])).parquet(out)
    return keep_last(said, keys, [F.col("batch")]).drop("batch")
