"""Point-in-time records in fixed binary form: one file an instrument and field, read by byte ranges.

A record has 20 bytes, little endian: announcement date as yyyymmdd (4), period (4),
value as a double (8), and the byte offset of the next record of the same
period (4; all ones where there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tidepanel.sources.files import opened

#: fixed values: the record's layout and its sign for "no next record"
RECORD = np.dtype([("ann_date", "<u4"), ("period", "<u4"), ("value", "<f8"), ("next", "<u4")])
NONE = 0xFFFFFFFF
SPLIT = 8 << 20
#: bytes of ranges that a task reads, at least one range
TASK = 1 << 20
_SCHEMA = "instrument string, field string, ann_date date, period int, value double, start long, next long"


def write_records(events: DataFrame, path: str, field: str = "value") -> DataFrame:
    """Write events (instrument, ann_date, period, value, seq) as ``path/<instrument>/<field>.data``; (file, records) of what was written.

    Records lie by (ann_date, seq).  Places and links are window columns, so a task
    only encodes rows as they come; an instrument's file is written by one task
    as a stream.  A file that a lost task left is written over by the next try.
    Rows without date or period are left out; a missing value is NaN.  A file
    holds 200 million records at most, as offsets have 4 bytes.
    """
    own = W.partitionBy("instrument")
    rows = events.where("ann_date is not null and period is not null").select(F.lower(F.col("instrument").cast("string")).alias("instrument"), "ann_date", "period", F.col("value").cast("double").alias("value"), "seq")
    rows = rows.withColumn("place", F.row_number().over(own.orderBy("ann_date", "seq", "period")) - 1)
    nxt = F.lead("place").over(W.partitionBy("instrument", "period").orderBy("place"))
    rows = rows.select("instrument", F.date_format("ann_date", "yyyyMMdd").cast("long").alias("ann_date"), F.col("period").cast("long").alias("period"), F.coalesce("value", F.lit(float("nan"))).alias("value"), "place", F.coalesce(nxt.cast("long") * RECORD.itemsize, F.lit(NONE)).alias("next"))
    rows = rows.repartition("instrument").sortWithinPartitions("instrument", "place")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(path)
        out, name, n = None, None, 0

        def done() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                yield pa.RecordBatch.from_pydict({"file": [f"{name}/{field}.data"], "records": pa.array([n], pa.int64())})

        for batch in batches:
            names = batch.column("instrument").to_pylist()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if names[a] != name:
                    yield from done()
                    name, n = names[a], 0
                    fs.create_dir(f"{base}/{name}", recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}/{field}.data", compression=None)
                raw = np.empty(b - a, RECORD)
                for c in RECORD.names:
                    raw[c] = batch.column(c).slice(a, b - a).to_numpy()
                out.write(raw.tobytes())
                n += b - a
        yield from done()

    told = rows.mapInArrow(go, "file string, records long")
    return events.sparkSession.createDataFrame(told.collect(), "file string, records long")  # a row for each file; writing is done when this returns


@dataclass
class Ranges(InputPartition):
    """Byte ranges (instrument, field, path, start, end) that a task reads."""

    parts: list


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.columns = schema.names
        self.instruments: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Instruments asked for by name are the only folders listed."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("instrument",):
                asked = {f.value}
            elif isinstance(f, In) and f.attribute == ("instrument",):
                asked = set(f.value)
            else:
                yield f
                continue
            self.instruments = asked if self.instruments is None else self.instruments & asked

    def partitions(self) -> list[Ranges]:
        """Files cut at whole records into ranges of about ``split`` bytes; a task reads ``TASK`` bytes of them, or one range, so that tasks grow with the bytes and not with the number of short ranges."""
        fs, base = opened(self.path)
        roots = [base] if self.instruments is None else [f"{base}/{i}" for i in sorted(self.instruments)]
        files = sorted((f.path, f.size) for r in roots for f in fs.get_file_info(pafs.FileSelector(r, recursive=True, allow_not_found=True)) if f.is_file and f.path.endswith(".data"))
        step = max(self.split // RECORD.itemsize, 1) * RECORD.itemsize
        out, held, size = [], [], 0
        for path, n in files:
            n -= n % RECORD.itemsize
            instrument, field = path.removesuffix(".data").rsplit("/", 2)[-2:]
            for start in range(0, n, step):
                end = min(start + step, n)
                if held and size + end - start > max(step, TASK):
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append((instrument, field, path, start, end))
                size += end - start
        return [*out, Ranges(held)]

    @staticmethod
    def _ranges(fs: pafs.FileSystem, parts: list) -> Iterator[tuple[tuple, np.ndarray]]:
        """Each range and its records; a file is opened once for ranges that follow each other."""
        for path, own in groupby(parts, key=lambda p: p[2]):
            with fs.open_input_file(path) as f:
                for part in own:
                    f.seek(part[3])
                    yield part, np.frombuffer(f.read(part[4] - part[3]), RECORD)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        for (instrument, field, path, start, end), raw in self._ranges(fs, partition.parts):
            at = np.arange(start, end, RECORD.itemsize)[raw["ann_date"] > 0]
            raw = raw[raw["ann_date"] > 0]
            day = raw["ann_date"].astype(np.int64)
            months = (day // 10_000 - 1970) * 12 + day // 100 % 100 - 1
            dates = months.astype("datetime64[M]").astype("datetime64[D]") + (day % 100 - 1)
            made = {
                "instrument": lambda: pa.array([instrument] * len(raw), pa.string()), "field": lambda: pa.array([field] * len(raw), pa.string()), "ann_date": lambda: pa.array(dates),
                "period": lambda: pa.array(raw["period"].astype(np.int32)), "value": lambda: pa.array(raw["value"], mask=np.isnan(raw["value"])), "start": lambda: pa.array(at),
                "next": lambda: pa.array(raw["next"].astype(np.int64), mask=raw["next"] == NONE),
            }
            yield pa.RecordBatch.from_arrays([made[c]() for c in self.columns], self.columns)


class PitRecords(DataSource):
    """``spark.read.format("pit_records").option("path", ..)``: records as rows, in planned byte ranges of ``split`` bytes."""

    @classmethod
    def name(cls) -> str:
        return "pit_records"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options, schema)


def read_records(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(instrument, field, ann_date, period, value, start, next) of all records under ``path``; ``start`` is a record's byte offset."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PitRecords)
    return spark.read.format("pit_records").option("path", path).option("split", str(split)).load()
