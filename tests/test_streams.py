"""Keyed state and the growing feature store: restarts, repeats, late rows, bounded state."""

import datetime as dt
import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import pit
from tidepanel.plans.expression import ExpressionError, compile_panel
from tidepanel.sources.files import scratch
from tidepanel.streaming import append, bars, filings

DAY = dt.date(2020, 1, 1)


def test_the_newest_flag_stands_whatever_the_order(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 3), 202001 + r.randint(0, 3), DAY + dt.timedelta(days=r.randint(0, 20)), r.randint(0, 2), i, r.choice([None, float(i)])) for i in range(300)]
    rows += rows[:40]
    r.shuffle(rows)
    schema = "instrument long, period int, ann_date date, flag long, seq long, value double"
    parts = [spark.createDataFrame(rows[i::3], schema) for i in range(3)]
    got = bars.drain_in_parts(parts, filings.restated, ["instrument", "period", "ann_date"]).collect()
    want = {}
    for k in rows:
        if k[:3] not in want or k[3:5] > want[k[:3]][:2]:
            want[k[:3]] = k[3:]
    assert {tuple(x)[:3]: tuple(x)[3:6] for x in got} == want
    assert {x["restated"] for x in got} == {True, False}


def test_state_of_old_statements_goes(spark):
    """Each part is 200 days later: what is kept is the last part's."""
    into, at = scratch(spark, "in"), scratch(spark, "state")
    kept = []
    for i in range(4):
        rows = [(j, 202001, DAY + dt.timedelta(days=200 * i + j % 5), 0, 1000 * i + j, 1.0) for j in range(50)]
        spark.createDataFrame(rows, "instrument long, period int, ann_date date, flag long, seq long, value double").write.parquet(f"{into}/part={i}")
        told = filings.restated(spark.readStream.schema("instrument long, period int, ann_date date, flag long, seq long, value double").parquet(f"{into}/part=*"), "10 days", 30)
        q = told.writeStream.outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(lambda b, n: b.count() and None).start()
        q.awaitTermination()
        kept.append(json.loads(q.recentProgress[-1].json)["stateOperators"][0]["numRowsTotal"])
    assert kept[3] <= kept[1] * 1.5


def test_statements_of_an_instrument_share_one_state(spark):
    """Thirty periods of an instrument are one row of state, and an instrument's row goes once all it holds is too old."""
    into, at = scratch(spark, "in"), scratch(spark, "state")
    schema = "instrument long, period int, ann_date date, flag long, seq long, value double"
    kept, said = [], []
    for i in range(3):
        rows = [(10 * i + j, 200001 + p, DAY + dt.timedelta(days=200 * i + p % 5), 0, p, None if p == 7 else float(p)) for j in range(4) for p in range(30)]
        spark.createDataFrame(rows, schema).write.parquet(f"{into}/part={i}")
        told = filings.restated(spark.readStream.schema(schema).parquet(f"{into}/part=*"), "10 days", 30)
        q = told.writeStream.outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(lambda b, n: said.extend(map(tuple, b.collect()))).start()
        q.awaitTermination()
        kept.append(json.loads(q.recentProgress[-1].json)["stateOperators"][0]["numRowsTotal"])
    assert kept == [4, 4, 4]
    assert len(said) == 360 and not any(x[-1] for x in said) and {x[5] for x in said if x[4] == 7} == {None}


@pytest.mark.parametrize("parts", [1, 4])
def test_trailing_values_in_any_order(spark, parts):
    r = random.Random(parts)
    rows = [(r.randint(0, 2), DAY + dt.timedelta(days=i // 2), (2019 + i // 80) * 100 + r.randint(1, 4), r.choice([None, 1.0, 2.0, float(i)]), i) for i in range(240)]
    schema = "instrument long, ann_date date, period int, value double, seq long"
    want = sorted((x["instrument"], x["seq"], x["period"], x["ttm"]) for x in pit.ttm_events(spark.createDataFrame(rows, schema)).collect())
    mixed = rows + rows[:30]
    r.shuffle(mixed)
    got = bars.drain_in_parts([spark.createDataFrame(mixed[i::parts], schema) for i in range(parts)], filings.trailing, ["instrument", "ann_day", "seq", "period"])
    assert sorted((x["instrument"], x["seq"], x["period"], x["ttm"]) for x in got.where("ttm is not null").collect()) == want


EXPRS = {"mean": "Mean($x, 4)", "label": "Ref($x, -2) / Ref($x, -1) - 1", "rank": "Rank($x, 6)"}


@pytest.fixture(scope="module")
def history(spark):
    r = np.random.default_rng(1)
    rows = [(i, DAY + dt.timedelta(days=10 * d), float(r.normal()) if r.random() > 0.1 else None) for i in range(5) for d in range(30) if i != 4 or d < 8]
    return spark.createDataFrame(rows, "instrument long, date date, x double")


def files_of(at):
    return {str(p): p.stat().st_mtime_ns for p in Path(at.removeprefix("file://")).rglob("*.parquet")}


def test_three_batches_equal_one_run(spark, history):
    at = scratch(spark, "store")
    store = append.FeatureStore(spark, at, history.schema, EXPRS)
    cut = [DAY + dt.timedelta(days=x) for x in (0, 90, 200, 400)]
    part = lambda i: history.where((F.col("date") >= F.lit(cut[i])) & (F.col("date") < F.lit(cut[i + 1])))
    store.put(part(0), 0)
    first = files_of(f"{at}/features")
    months = store.put(part(1), 1)
    once = files_of(f"{at}/features")
    untouched = {f for f in first if not any(f"month={m}" in f for m in months)}
    assert untouched and all(once.get(f) == first[f] for f in untouched)
    said = sorted(map(tuple, store.features().collect()), key=str)
    assert store.put(part(1), 1) == months and sorted(map(tuple, store.features().collect()), key=str) == said
    store.put(part(2), 2)
    store.put(history.limit(0), 3)
    got = sorted(map(tuple, store.features().collect()), key=str)
    assert got == sorted(map(tuple, compile_panel(history, EXPRS).collect()), key=str)
    with pytest.raises(ValueError, match="newer"):
        store.put(part(2).limit(1), 4)
    with pytest.raises(ExpressionError):
        append.FeatureStore(spark, at, history.schema, {"e": "EMA($x, 5)"})


def test_a_batch_that_broke_off_is_taken_up_again(spark, history, monkeypatch):
    """The features of batch 1 are written but not its tail; the stream's second try ends as one run does."""
    at, into = scratch(spark, "store"), scratch(spark, "in")
    store = append.FeatureStore(spark, at, history.schema, EXPRS)
    cut = DAY + dt.timedelta(days=150)
    follow = lambda: store.follow(spark.readStream.schema(history.schema).parquet(f"{into}/part=*"), f"{at}-state")
    history.where(F.col("date") < F.lit(cut)).write.parquet(f"{into}/part=0")
    follow()
    history.where(F.col("date") >= F.lit(cut)).write.parquet(f"{into}/part=1")
    whole = append.FeatureStore.put

    def broken(self, batch, number):
        whole(self, batch, number)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/tail/batch={number}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        raise OSError("lost")

    monkeypatch.setattr(append.FeatureStore, "put", broken)
    with pytest.raises(Exception, match="lost"):
        follow()
    monkeypatch.setattr(append.FeatureStore, "put", whole)
    follow()
    assert sorted(map(tuple, store.features().collect()), key=str) == sorted(map(tuple, compile_panel(history, EXPRS).collect()), key=str)


def test_a_users_rows_that_come_in_pieces_are_put_in_order(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 2), 7, float(i % 13)) for i in range(200)]
    random.Random(5).shuffle(rows)
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "9")
    try:
        (got,) = bars.drain(bars.running_mean(bars.event_stream(spark, str(tmp_path))), "update", ["instrument"]).collect()
    finally:
        spark.conf.set(key, before)
    v = np.array([r[3] for r in sorted(rows)])
    w = (1 - 2 / 11) ** np.arange(len(v) - 1, -1, -1.0)
    assert got["n"] == 200 and abs(got["mean"] - v @ w / w.sum()) < 1e-9
