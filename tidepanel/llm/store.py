"""Places shared by the driver and all executors, and sizes of exchanges."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests) a
    temporary folder is made and set; on a cluster that is an error, as no
    executor would see what another one wrote.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidepanel-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def dropped(df: DataFrame) -> None:
    """Delete the files behind a table that ``written`` gave, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def free(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more; it looks for them when the driver's heap is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slim_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session has Spark's default of 10,000: texts are long rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def text_volume(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows."""
    return int(docs.agg(F.sum(F.octet_length(F.col(column))).alias("n")).first()["n"] or 0)


def buckets_for(spark: SparkSession, volume: int, each: int = 8 << 20) -> int:
    """Hash buckets for an exchange: about ``each`` bytes of text per bucket, however many there are."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // each), 1)
