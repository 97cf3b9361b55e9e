"""File sources and sinks: Parquet, delimited text, and tables keyed for upserts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.operators.shaping import upsert


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return (pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)) if uri.startswith("file:") else pafs.FileSystem.from_uri(uri)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir; a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='tidepanel-')).rstrip('/')}/{uuid.uuid4().hex}-{name}"


def write_frame(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None, **options: str) -> None:
    """Write Parquet or CSV.  With "overwrite" the target is emptied before the job ends; results.put keeps the old until the new is complete."""
    out = df.write.mode(mode)
    if partition_by:
        out = out.partitionBy(*partition_by)
    if kind == "csv":
        out.options(header="true", nullValue="\\N", **options).csv(path)
    elif kind == "parquet":
        out.parquet(path)
    else:
        raise ValueError(f"unknown format {kind}")


def read_frame(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Read Parquet or CSV; CSV needs its schema, as inferring would cost a pass."""
    if kind == "csv":
        if schema is None:
            raise ValueError("CSV needs a schema")
        return spark.read.schema(schema).options(header="true", nullValue="\\N", **options).csv(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_folders(df: DataFrame, path: str, column: str) -> int:
    """Write a folder ``path/<column>=<value>`` with one Parquet file for each value, and say how many; for very many values.

    A value's rows are in one task, which writes them as a stream; a try after a lost
    task writes the same files over.  Spark's own writer makes and moves each folder
    through the driver's commit, which takes longer than the rows.  ``path`` is new; a missing value's
    rows go to the folder that Spark reads as missing.
    """
    order = [c for c in df.columns if c != column]
    rows = df.select(F.coalesce(F.col(column).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("folder__"), *order).repartition("folder__").sortWithinPartitions("folder__")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(path)
        out, name, n = None, None, 0
        for batch in batches:
            names = batch.column("folder__").to_pylist()
            cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(names)]):
                if names[a] != name:
                    if out is not None:
                        out.close()
                    name, n = names[a], n + 1
                    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
                        raise ValueError(f"no plain name of a folder: {name!r}")
                    fs.create_dir(f"{base}/{column}={name}", recursive=True)
                    out = pq.ParquetWriter(f"{base}/{column}={name}/part-0.parquet", batch.select(order).schema, filesystem=fs)
                out.write_batch(batch.select(order).slice(a, b - a))
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return rows.mapInArrow(go, "n long").agg(F.sum("n")).first()[0] or 0


def read_folders(spark: SparkSession, path: str, column: str, values: list[int | str], schema: T.StructType | str) -> DataFrame:
    """Rows of Parquet folders ``path/<column>=<value>``: only these are listed and read; ``schema`` has ``column``, and values are plain words or numbers.  None of them there: no rows."""
    if not all(re.fullmatch(r"[A-Za-z0-9_.-]+", str(v)) for v in values):
        raise ValueError(f"no plain folders: {values}")
    found = []
    for v in dict.fromkeys(values):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={v}")
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            found.append(f"{path}/{column}={v}")
    none = spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*found).select(*none.columns) if found else none


def upsert_into(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> str:
    """Write ``path`` with ``new`` put in by key as a new version beside it, and return where."""
    version = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    write_frame(upsert(read_frame(spark, path), new, keys), version)
    return version


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` by way of Parquet in the shared scratch folder: worked out once, however often it is read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
