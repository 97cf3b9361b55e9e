"""Statements as streams with keyed state: restated ones, and trailing values that late ones correct."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_DAY = 86_400_000  # milliseconds
_KEYED = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Keyed state needs the store that keeps keys one by one; set it where the session has Spark's default."""
    if "HDFSBacked" in spark.conf.get(_PROVIDER, "HDFSBacked"):
        spark.conf.set(_PROVIDER, _KEYED)


def _put(known: list[tuple], new: tuple) -> None:
    if new not in known:
        known.append(new)


def restated(statements: DataFrame, late: str = "100 days", keep_days: int = 100) -> DataFrame:
    """(instrument, period, ann_date, flag, seq, value, restated) each time the row of (instrument, period, ann_date) changes.

    ``statements`` is a stream (instrument, period, ann_date, flag, seq, value); of rows
    of one statement the newest ``flag`` stands, among equal ones the highest ``seq``, in
    whatever order they arrive.  A change of a row told before is ``restated``.  Keys
    must not be missing; a missing value is a value like another; repeats tell nothing.

    State is kept by instrument, its periods and dates together, read and written once a batch: statements are many
    and small, and each look-up of a key of its own costs more than its rows.  Rows older than the watermark (``late`` behind the newest date seen) are dropped by
    Spark, and the state of a statement goes ``keep_days`` after its date, by the
    watermark: with ``keep_days`` no longer than ``late`` it could go before rows that
    still count, so the longer of both should be chosen for it.
    """
    kind = statements.schema
    ids = {c: kind[c].dataType.simpleString() for c in ("instrument", "period")}
    columns = ["instrument", "period", "ann_date", "flag", "seq", "value", "restated"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told = {(p, a): (f, s, v) for p, a, f, s, v in zip(*state.get)} if state.exists else {}
        best: dict[tuple, tuple] = {}
        for pdf in batches:
            values = pdf["value"].astype(object).where(pdf["value"].notna(), None)
            for p, ann, flag, seq, value in zip(pdf["period"].tolist(), pdf["ann_day"].tolist(), pdf["flag"].tolist(), pdf["seq"].tolist(), values.tolist()):
                old = best.get((p, ann))
                if old is None or (flag, seq) > old[:2]:
                    best[p, ann] = flag, seq, value
        out = [(*key, *k, *new, k in told) for k, new in best.items() if k not in told or new[:2] > told[k][:2]]
        told |= {x[1:3]: x[3:6] for x in out}
        now = state.getCurrentWatermarkMs()
        kept = {k: x for k, x in told.items() if (k[1] + keep_days) * _DAY > now}
        if kept:
            state.update(tuple(map(list, zip(*((*k, *x) for k, x in kept.items())))))
            state.setTimeoutTimestamp((min(a for _, a in kept) + keep_days) * _DAY)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=columns).astype({"value": float})

    rows = statements.withColumn("at", F.col("ann_date").cast("timestamp")).withWatermark("at", late).withColumn("ann_day", F.unix_date("ann_date")).select("instrument", "period", "ann_day", "flag", "seq", "value", "at")
    told = rows.groupBy("instrument").applyInPandasWithState(step, f"instrument {ids['instrument']}, period {ids['period']}, ann_date int, flag long, seq long, value double, restated boolean", f"period array<{ids['period']}>, ann array<int>, flag array<long>, seq array<long>, value array<double>", "update", GroupStateTimeout.EventTimeTimeout)
    return told.withColumn("ann_date", F.date_from_unix_date("ann_date"))


class _Trailing(StatefulProcessor):
    """Per instrument: a map from period to its announcements (date, seq, value), sorted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.periods = handle.getMapState("periods", "period int", "ann array<long>, seq array<long>, value array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known: dict[int, list[tuple]] = {}

        def of(period: int) -> list[tuple]:
            if period not in known:
                known[period] = list(zip(*self.periods.getValue((period,)))) if self.periods.containsKey((period,)) else []
            return known[period]

        fresh: dict[int, list[tuple]] = {}
        for pdf in rows:
            for period, ann, seq, value in zip(pdf["period"], pdf["ann_day"], pdf["seq"], pdf["value"]):
                if not pd.isna(value):
                    fresh.setdefault(int(period), []).append((int(ann), int(seq), float(value)))
        since: dict[int, tuple] = {}  # periods to answer for, from which announcement on
        for period, new in fresh.items():
            events = of(period)
            for e in new:
                _put(events, e)
            events.sort()
            self.periods.updateValue((period,), tuple(map(list, zip(*events))))
            first = min(new)[:2]
            year, quarter = divmod(period, 100)
            hit = [period, *([(year + 1) * 100 + q for q in (1, 2, 3)] if quarter == 4 else [period + 100])]
            for p in hit:
                since[p] = min(since.get(p, first), first)
        out = []
        for period, first in since.items():
            year, quarter = divmod(period, 100)
            annual, same = (of((year - 1) * 100 + 4), of(period - 100)) if quarter != 4 else ([], [])
            for ann, seq, value in of(period):
                if (ann, seq) < first:
                    continue
                ttm = value
                if quarter != 4:
                    was = [x[i - 1][2] if (i := bisect_right([e[:2] for e in x], (ann, seq))) else None for x in (annual, same)]
                    ttm = None if None in was else value + was[0] - was[1]
                out.append((*key, ann, seq, period, ttm))
        yield pd.DataFrame(out, columns=["instrument", "ann_day", "seq", "period", "ttm"]).astype({"ttm": float})

    def close(self) -> None:
        pass


def trailing(events: DataFrame) -> DataFrame:
    """(instrument, ann_day, seq, period, ttm): trailing twelve months of ``events`` (instrument, ann_date, period, value, seq), told anew when an event that came late changes them.

    The last word for (instrument, ann_day, seq, period) is what ``pit.ttm_events`` gives for
    all events at once, in whatever order and batches they came; ``ttm`` is NULL while a
    value that it needs isn't there.  ``ann_day`` counts days from 1970.  Missing values
    are no announcements; repeats change nothing.  State is a map of an instrument's periods, of
    which a batch reads and writes those that it touches, and holds all
    that was announced, as any of it may still be asked for.
    """
    keyed_state(events.sparkSession)
    kind = events.schema["instrument"].dataType.simpleString()
    rows = events.withColumn("ann_day", F.unix_date("ann_date")).select("instrument", "ann_day", "seq", "period", "value")
    return rows.groupBy("instrument").transformWithStateInPandas(_Trailing(), f"instrument {kind}, ann_day long, seq long, period int, ttm double", "Update", "None")
