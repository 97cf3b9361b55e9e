"""Stores of results: one folder a day, and keyed tables whose versions replace each other."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.operators.shaping import upsert
from tidepanel.sources.files import read_frame, write_frame


def save(df: DataFrame, path: str, day: str, kind: str = "parquet") -> None:
    """Store the result of one day, in place of an earlier one of that day."""
    write_frame(df, f"{path}/day={day}", kind)


def load(spark: SparkSession, path: str, day: str, kind: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """The result of one day."""
    return read_frame(spark, f"{path}/day={day}", kind, schema)


def save_days(df: DataFrame, path: str, date: str = "date") -> None:
    """Store many days at once, each in a folder of its own; days that the folder has already are replaced, others stay."""
    days = df.withColumn("day", F.col(date).cast("string")).repartition("day")
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def load_day(spark: SparkSession, path: str, day: str) -> DataFrame:
    """One day of what ``save_days`` stored: only its folder is read."""
    return spark.read.parquet(path).where(F.col("day") == day).drop("day")


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _versions(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(target) if s.getPath().getName().startswith("v")) if fs.exists(target) else []


def put(df: DataFrame, path: str, keys: list[str]) -> str:
    """Put rows into the keyed table at ``path`` and return it.

    A table is a folder of versions; a new one is written whole under another name
    and moved into place when it is complete, so readers see one or the
    other, and a failed write leaves the table as it was.  One writer at a time.
    """
    spark = df.sparkSession
    old = _versions(spark, path)
    new = upsert(spark.read.parquet(old[-1]), df, keys) if old else df
    draft = f"{path}/_{uuid.uuid4().hex}"
    write_frame(new, draft)
    fs, _ = _fs(spark, path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not fs.rename(jpath(draft), jpath(f"{path}/v{len(old):08d}")):
        raise OSError(f"{path}: version {len(old)} is there already")
    return path


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last complete version of a keyed table."""
    return spark.read.parquet(_versions(spark, path)[-1])
