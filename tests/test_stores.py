"""Binary records, the database, loose JSON and users' operators: odd input, plans, repeats."""

import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from tidepanel.functions.loose_json import loose_json
from tidepanel.plans.expression import ExpressionError, Operator, check, compile_panel, extent, frame, operators, parse
from tidepanel.sources import database, records
from tidepanel.sources.files import scratch


def test_records_come_back_from_any_splits(spark):
    rows = [(i % 7, dt.date(2020, 1, 1) + dt.timedelta(days=i // 3), 202001 + i % 4, None if i % 11 == 0 else i / 3, i) for i in range(400)] + [(1, None, 202001, 1.0, 999)]
    df = spark.createDataFrame(rows, "instrument int, ann_date date, period int, value double, seq long").repartition(4)
    at = scratch(spark, "records")
    told = {r["file"]: r["records"] for r in records.write_records(df, at).collect()}
    assert sum(told.values()) == 400 and set(told) == {f"{i}/value.data" for i in range(7)}
    want = sorted(((str(a), d, p, v) for a, d, p, v, _ in rows if d), key=str)
    for split in (20, 333, 1 << 20):
        got = records.read_records(spark, at, split)
        assert sorted(((r["instrument"], r["ann_date"], r["period"], r["value"]) for r in got.collect()), key=str) == want
    got = {(r["instrument"], r["start"]): r for r in records.read_records(spark, at).collect()}
    for (i, _), r in got.items():  # links lead to the next record of the period
        later = sorted(s for (j, s), x in got.items() if j == i and x["period"] == r["period"] and s > r["start"])
        assert r["next"] == (later[0] if later else None)


def test_records_of_one_instrument_list_its_folder_only(spark):
    df = spark.createDataFrame([(i, dt.date(2020, 1, 1), 202001, 1.0, i) for i in range(5)], "instrument int, ann_date date, period int, value double, seq long")
    at = scratch(spark, "records")
    records.write_records(df, at)
    reader = records.PitRecords({"path": at}).reader(records.read_records(spark, at).schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(reader.pushFilters([EqualTo(("instrument",), "3"), GreaterThan(("period",), 1)])) == [GreaterThan(("period",), 1)]
    assert [p[0] for x in reader.partitions() for p in x.parts] == ["3"]
    assert records.read_records(spark, at).where("instrument = '3' and period > 5").count() == 1
    assert records.read_records(spark, scratch(spark, "nothing")).count() == 0


@pytest.fixture
def url(spark):
    at = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    database.execute(spark, at, "create table pairs (k bigint not null primary key, day date, v double)")
    return at


def test_upserts_can_be_repeated(spark, url):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.col("id").cast("double").alias("v"))
    database.append(rows.where("k < 600"), url, "pairs", 64)
    new = rows.where("k >= 400").withColumn("v", F.when(F.col("k") % 2 == 0, -F.col("v")))
    for _ in range(2):
        assert database.upsert(new.unionByName(new.where("k < 500")).repartition(3), url, "pairs", ["k"]) == 600
    got = {r["K"]: r["V"] for r in database.scan(spark, url, "pairs").collect()}
    assert got == {k: float(k) if k < 400 else -float(k) if k % 2 == 0 else None for k in range(1000)}
    left = database.scan(spark, url, "(select tablename from sys.systables where tablename like 'STAGE%') x")
    assert left.count() == 0


def test_scans_are_cut_and_filtered_by_the_database(spark, url):
    database.append(spark.range(100).select(F.col("id").alias("k"), F.lit(None).cast("date").alias("day"), F.rand().alias("v")), url, "pairs")
    rows = database.scan(spark, url, "pairs", "k", 0, 100, 4)
    some = rows.where("k >= 40 and k < 50").select("k")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert rows.rdd.getNumPartitions() == 4 and "PushedFilters" in plan and "*GreaterThanOrEqual(K,40)" in plan and "ReadSchema: struct<K:bigint>" in plan
    assert some.count() == 10 and rows.count() == 100


def test_statements_hold_together_or_not_at_all(spark, url):
    with pytest.raises(Exception, match="(?i)nowhere"):
        database.execute(spark, url, "insert into pairs values (1, null, 1.0)", "delete from nowhere")
    assert database.scan(spark, url, "pairs").count() == 0
    assert database.execute(spark, url, "insert into pairs values (1, null, 1.0), (2, null, null)", "delete from pairs where k = 1") == [2, 1]
    with pytest.raises(ValueError, match="plain name"):
        database.upsert(spark.createDataFrame([(1,)], "k long"), url, "pairs; drop table pairs", ["k"])


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": 1}', {"a": 1}), (' [1, 2]\n', [1, 2]), ('x ```json\n{"a": {"b": [1]}}\n``` y', {"a": {"b": [1]}}), ('```\n{"a": 2}```', {"a": 2}), ('```json\n{"a": 3}', {"a": 3}),
        ('```json\nso: {"a": 4} ok', {"a": 4}), ('I say {"a": "}{"} so', {"a": "}{"}), ('{"a": 1', None), ("{a}", None), ("", None), ("  ", None), (None, None), ("no braces", None), ("{" * 5000, None),
    ],
)
def test_loose_json(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(F.to_json(loose_json(F.col("t"))).alias("j")).first()["j"]
    assert (json.loads(got) if got is not None else None) == want


def test_own_operators_are_checked_and_known_only_within():
    mine = {"Top": Operator(1, 1, lambda x, n, duck: f"max({x[0]}) {frame(int(n[0]) - 1, 2)}", back=lambda n: int(n[0]) - 1, ahead=lambda n: 2), "Both": Operator(2, 0, lambda x, n, duck: f"{x[0]} AND {x[1]}", windowed=False, condition=True, conditions=True)}
    with operators(**mine):
        assert extent(parse("Mean(Top(Ref($a, 1), 5), 3)")) == (7, 2)
        check(parse("If(Both($a > 1, $b > 1), $a, $b)"))
        for bad in ("Top($a)", "Top($a, $b)", "Both($a, $b > 1)", "And(Top($a, 3), $b > 1)"):
            with pytest.raises(ExpressionError):
                check(parse(bad))
        with pytest.raises(ExpressionError, match="known"), operators(Top=mine["Top"]):
            pass
    with pytest.raises(ExpressionError, match="known"), operators(Mean=mine["Top"]):
        pass
    with pytest.raises(ExpressionError, match="unknown"):
        check(parse("Top($a, 3)"))


def test_own_operators_work_out(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([3, 1, 2, 5, 4])], "instrument int, date int, x double")
    own = {"Top": Operator(1, 1, lambda x, n, duck: f"max({x[0]}) {frame(int(n[0]) - 1, 1)}"), "Half": Operator(1, 0, lambda x, n, duck: f"{x[0]} / 2", windowed=False), "Up": Operator(1, 0, lambda x, n, duck: f"{x[0]} > 2", windowed=False, condition=True)}
    with operators(**own):
        got = compile_panel(df, {"a": "Top($x, 2)", "b": "Half(Sum(Up($x), 3))", "c": "If(Up($x), Top(Half($x), 1), 0)"}).orderBy("date").collect()
    assert [tuple(r)[2:] for r in got] == [(3.0, 0.5, 1.5), (3.0, 0.5, 0.0), (5.0, 0.5, 0.0), (5.0, 0.5, 2.5), (5.0, 1.0, 2.0)]


def test_short_ranges_share_a_task(spark):
    at = scratch(spark, "records")
    rows = [(i % 40, dt.date(2020, 1, 1), 202001, float(i), i) for i in range(8000)]
    records.write_records(spark.createDataFrame(rows, "instrument long, ann_date date, period int, value double, seq long"), at)
    reader = records.PitRecords({"path": at, "split": "100"}).reader(records.read_records(spark, at).schema)
    parts = reader.partitions()
    assert len(parts) < 5 and max(p[4] - p[3] for x in parts for p in x.parts) <= 100
    assert sorted(r["value"] for r in records.read_records(spark, at, 100).collect()) == [float(i) for i in range(8000)]


def test_a_folder_for_each_value_and_only_the_asked_ones_read(spark):
    from pathlib import Path

    from tidepanel.sources.files import opened, read_folders, write_folders

    at = scratch(spark, "codes")
    rows = [(i % 50 or None, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "code long, date date, x double")
    assert write_folders(df, at, "code") == 50
    local = Path(opened(at)[1])
    assert len(list(local.glob("code=*/*.parquet"))) == 50
    assert sorted(map(tuple, spark.read.schema(df.schema).parquet(at).select("code", "date", "x").collect()), key=lambda r: r[2]) == rows
    next(local.glob("code=7/*.parquet")).write_text("broken")
    assert sorted(map(tuple, read_folders(spark, at, "code", [1, 3, 99], df.schema).collect()), key=str) == sorted((r for r in rows if r[0] in (1, 3)), key=str)
    assert read_folders(spark, at, "code", [99], df.schema).count() == 0
    with pytest.raises(ValueError):
        read_folders(spark, at, "code", ["a/b"], df.schema)
