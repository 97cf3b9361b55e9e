"""A store of features that grows by batches of bars and looks back where features look ahead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidepanel.plans.expression import ExpressionError, compile_panel, extent, parse


class FeatureStore:
    """Features of expressions over bars, kept in monthly folders under ``path``.

    A batch of bars adds its rows, and works out anew the rows before it that
    looked at days which weren't there (as many as the expressions look ahead).  Only
    the months of these rows are written.  What a batch needs of the past, each
    instrument's last rows, is kept beside the features, one version for
    each batch: a batch that is run again starts from the version before it
    and writes the same.

    Each instrument's bars must come in order of date, its batches one after the
    other; a bar that isn't newer than the instrument's last one is an error.
    Expressions that look back without end can't be kept so.  (instrument, date) is
    unique; missing values are as in expressions; an empty batch changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, bars: T.StructType, exprs: dict[str, str]) -> None:
        self.spark, self.path, self.bars, self.exprs = spark, path.rstrip("/"), bars, exprs
        reach = [extent(parse(e)) for e in exprs.values()]
        if any(b < 0 for b, _ in reach):
            raise ExpressionError("an expression looks back without end")
        self.back, self.ahead = max(b for b, _ in reach), max(a for _, a in reach)
        self.schema = T.StructType([bars["instrument"], bars["date"], *(T.StructField(e, T.DoubleType()) for e in exprs), T.StructField("month", T.StringType())])

    def _there(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _tail(self, number: int) -> DataFrame:
        """Each instrument's last rows before batch ``number``."""
        at = f"{self.path}/tail/batch={number - 1}"
        return self.spark.read.schema(self.bars).parquet(at) if self._there(at) else self.spark.createDataFrame([], self.bars)

    def features(self) -> DataFrame:
        at = f"{self.path}/features"
        df = self.spark.read.schema(self.schema).parquet(at) if self._there(at) else self.spark.createDataFrame([], self.schema)
        return df.drop("month")

    def put(self, batch: DataFrame, number: int) -> list[str]:
        """Take in batch ``number`` (0, 1, ..) and return the months written."""
        columns = self.bars.names
        work = f"{self.path}/work"
        tail = self._tail(number)
        batch.select(*columns).withColumn("new", F.lit(True)).unionByName(tail.withColumn("new", F.lit(False))).write.mode("overwrite").parquet(f"{work}/rows")
        rows = self.spark.read.parquet(f"{work}/rows")
        own = W.partitionBy("instrument").orderBy("date")
        late = rows.groupBy("instrument").agg(F.max(F.when(~F.col("new"), F.col("date"))).alias("last"), F.min(F.when(F.col("new"), F.col("date"))).alias("first"))
        if late.where(F.col("first") <= F.col("last")).limit(1).count():
            raise ValueError("bars must be newer than their instrument's last one")
        # the batch's rows, and those before it that look into it
        from_end = F.row_number().over(W.partitionBy("instrument", "new").orderBy(F.desc("date")))
        stirred = rows.select("instrument", "date", (F.col("new") | (from_end <= self.ahead)).alias("due"), F.max("new").over(W.partitionBy("instrument")).alias("any")).where("due and any").select("instrument", "date")
        fresh = compile_panel(rows, self.exprs).join(stirred, ["instrument", "date"], "left_semi").withColumn("month", F.date_format("date", "yyyy-MM"))
        fresh.write.mode("overwrite").parquet(f"{work}/fresh")
        fresh = self.spark.read.schema(self.schema).parquet(f"{work}/fresh")
        months = sorted(r["month"] for r in fresh.select("month").distinct().collect())  # the months of a batch
        at = f"{self.path}/features"
        if months:
            old = self.spark.read.schema(self.schema).parquet(at).where(F.col("month").isin(months)) if self._there(at) else fresh.limit(0)
            both = old.join(fresh.select("instrument", "date"), ["instrument", "date"], "left_anti").unionByName(fresh)
            both.select(*self.schema.names).write.mode("overwrite").parquet(f"{work}/both")
            merged = self.spark.read.schema(self.schema).parquet(f"{work}/both").repartition("month")
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(at)
        last = F.row_number().over(W.partitionBy("instrument").orderBy(F.desc("date")))
        keep = max(self.back + self.ahead, 1)
        rows.select(*columns, last.alias("place")).where(F.col("place") <= keep).drop("place").write.mode("overwrite").parquet(f"{self.path}/tail/batch={number}")
        return months

    def follow(self, bars: DataFrame, state: str) -> None:
        """Take in all that a stream of bars has now; ``state`` is the query's checkpoint."""
        put: Callable[[DataFrame, int], None] = lambda df, n: self.put(df, n) and None
        bars.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
