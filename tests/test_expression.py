"""Parser, analyser and lowering against pandas."""

import numpy as np
import pandas as pd
import pytest

from tidepanel.functions.genes import FAMILIES, WINDOWS, genes
from tidepanel.functions.indicators import registry
from tidepanel.plans.expression import ExpressionError, check, compile_panel, extent, fields, parse


def test_parse_and_precedence():
    assert str(parse("Div(Mean($close, 5), Ref($close, -1)) - 1 > 2*$open")) == "Gt(Sub(Div(Mean($close, 5.0), Ref($close, -1.0)), 1.0), Mul(2.0, $open))"
    assert str(parse("-$a + 3 * -2")) == "Add(Sub(0.0, $a), Mul(3.0, -2.0))"
    assert fields(parse("$a / Corr($b, $c, 3)")) == {"a", "b", "c"}
    assert extent(parse("Mean(Ref($a, 2), 5)")) == (6, 0) and extent(parse("Ref($a, -3)")) == (0, 3) and extent(parse("EMA($a, 5)"))[0] == -1


@pytest.mark.parametrize("bad", ["Mean($a)", "Foo($a, 2)", "Mean($a, 1.5)", "Quantile($a, 5, 2)", "If($a, $b, $c)", "$a +", "Mean($a, $b)", "(a", "And($a, $b)"])
def test_rejected(bad):
    with pytest.raises(ExpressionError):
        check(parse(bad))


@pytest.mark.parametrize("bad", ["Ref($a, -1)", "Power($a, 4)", "Log($a)", "Mean($a, 0)"])
def test_rejected_in_search(bad):
    check(parse(bad))
    with pytest.raises(ExpressionError):
        check(parse(bad), search=True)


def panel(seed=0, days=60):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(3):
        x, y = r.normal(size=days) * 10, r.normal(size=days)
        x[r.random(days) < 0.1] = np.nan
        rows.append(pd.DataFrame({"instrument": i, "date": pd.date_range("2024-01-01", periods=days).date, "x": x, "y": y}))
    rows.append(pd.DataFrame({"instrument": 9, "date": [pd.Timestamp("2024-01-01").date()], "x": [1.0], "y": [2.0]}))  # one row
    rows.append(pd.DataFrame({"instrument": 8, "date": pd.date_range("2024-01-01", periods=20).date, "x": 5.0, "y": 1.0}))  # constant
    return pd.concat(rows, ignore_index=True)


def test_windows_match_pandas(spark):
    pdf = panel()
    df = spark.createDataFrame(pdf.astype({"instrument": int})).replace(float("nan"), None)
    exprs = {
        "mean": "Mean($x, 7)", "std": "Std($x, 7)", "skew": "Skew($x, 9)", "kurt": "Kurt($x, 9)", "med": "Med($x, 6)", "q": "Quantile($x, 8, 0.3)", "ema": "EMA($x, 6)",
        "corr": "Corr($x, $y, 8)", "cov": "Cov($x, $y, 8)", "ref": "Ref($x, 2)", "mx": "Max($x, 5)", "count": "Count($x, 5)", "mad": "Mad($x, 6)", "rank": "Rank($x, 6)", "slope": "Slope($x, 8)",
    }
    got = compile_panel(df, exprs).toPandas().sort_values(["instrument", "date"]).reset_index(drop=True).astype(float, errors="ignore")
    g = pdf.sort_values(["instrument", "date"]).groupby("instrument", group_keys=False)
    roll = lambda f, n: g["x"].apply(lambda s: f(s.rolling(n, min_periods=1)))

    def slope(v):
        ok = ~np.isnan(v)
        return np.polyfit(np.arange(len(v))[ok], v[ok], 1)[0] if ok.sum() > 1 else np.nan

    want = {
        "mean": roll(lambda r: r.mean(), 7), "std": roll(lambda r: r.std(), 7), "skew": roll(lambda r: r.skew(), 9), "kurt": roll(lambda r: r.kurt(), 9), "med": roll(lambda r: r.median(), 6),
        "q": roll(lambda r: r.quantile(0.3), 8), "mx": roll(lambda r: r.max(), 5), "count": roll(lambda r: r.count(), 5), "ref": g["x"].shift(2),
        "ema": g["x"].apply(lambda s: s.ewm(span=6, adjust=True).mean()), "mad": roll(lambda r: r.apply(lambda v: np.nanmean(np.abs(v - np.nanmean(v))), raw=True), 6),
        "rank": roll(lambda r: r.rank(pct=True), 6), "slope": roll(lambda r: r.apply(slope, raw=True), 8),
    }
    for name, w in want.items():
        a, b = pd.to_numeric(got[name]).to_numpy(float), w.reset_index(drop=True).to_numpy(float)
        if name in ("skew", "kurt"):  # undefined for constants here, by a convention there
            keep = (got["instrument"] != 8).to_numpy()
            a, b = a[keep], b[keep]
        np.testing.assert_allclose(a, b, atol=1e-7, err_msg=name)


def test_long_series_keep_their_range(spark):
    n = 5000
    pdf = pd.DataFrame({"instrument": 1, "date": pd.date_range("2000-01-01", periods=n).date, "x": np.random.default_rng(1).normal(size=n)})
    got = compile_panel(spark.createDataFrame(pdf), {"e": "EMA($x, 5)"}).toPandas().sort_values("date")["e"].to_numpy()
    np.testing.assert_allclose(got, pdf["x"].ewm(span=5).mean().to_numpy(), atol=1e-9)


def test_one_exchange_however_many_expressions(spark):
    df = spark.createDataFrame(panel()).select("*")
    plan = compile_panel(df, {"a": "Mean($x, 3) / Std($y, 4)", "b": "Rank(Delta($x, 1), 5)", "c": "EMA(Corr($x, $y, 5), 4)"})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_libraries_parse():
    for text in [*genes().values(), *registry().values()]:
        check(parse(text))
    assert len(genes()) == 24 + 24 * 5


def test_family_queries_cover_every_window():
    from tidepanel import queries as named

    sql = named.oracle_sql()
    text = " ".join(sql[q] for q in ("exp25_34_price_family", "exp35_44_position_family", "exp45_48_volume_family"))
    assert [f"{k}{n}" for k in FAMILIES for n in WINDOWS if f"as {k.lower()}{n}," not in text and f"as {k.lower()}{n} " not in text] == []


def _plain_order(x, n, q):
    """(quantile, mean absolute deviation, rank) of the last n values, row by row."""
    out = []
    for i in range(len(x)):
        v = x[max(0, i - n + 1) : i + 1]
        v = v[~np.isnan(v)]
        lt, eq = (v < x[i]).sum(), (v == x[i]).sum()
        out.append((np.quantile(v, q), np.abs(v - v.mean()).mean(), (lt + (eq + 1) / 2) / len(v) if eq else np.nan) if len(v) else (np.nan,) * 3)
    return np.array(out, float).reshape(-1, 3)


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_order_statistics_by_brute_force(spark, monkeypatch, block):
    """Ties, missing values, windows longer than blocks and histories, large offsets, a hundred instruments in a task."""
    from tidepanel.operators import ordered

    monkeypatch.setattr(ordered, "BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5" if block == 7 else "10000")
    r = np.random.default_rng(3)
    parts = []
    for i in range(12):
        n = int(r.integers(1, 60))
        x = np.round(r.normal(size=n) * 3) + (1e7 if i == 5 else 0) + (r.normal(size=n) if i % 2 else 0)
        x[r.random(n) < 0.2] = np.nan
        if i == 7:
            x[:] = np.nan
        parts.append(pd.DataFrame({"instrument": i, "date": pd.date_range("2024-01-01", periods=n).date, "x": x}))
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(3)
    windows = (1, 2, 5, 20, 500)
    exprs = {f"{k}{n}": e.format(n=n) for n in windows for k, e in {"q": "Quantile($x, {n}, 0.3)", "mad": "Mad($x, {n})", "rank": "Rank($x, {n})"}.items()}
    exprs["nested"] = "Mean(Rank($x - Ref($x, 1), 5), 3) + Med($x, 5)"
    got = compile_panel(df, exprs).toPandas().sort_values(["instrument", "date"]).reset_index(drop=True)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for n in windows:
        want = np.concatenate([_plain_order(p["x"].to_numpy(), n, 0.3) for p in parts])
        np.testing.assert_allclose(got[[f"q{n}", f"mad{n}", f"rank{n}"]].to_numpy(float), want, rtol=1e-9, atol=1e-9)
    nested = []
    for p in parts:
        x = p["x"].to_numpy()
        rank = _plain_order(np.append(np.nan, x[1:] - x[:-1]), 5, 0.5)[:, 2]
        nested.append(pd.Series(rank).rolling(3, min_periods=1).mean().to_numpy() + _plain_order(x, 5, 0.5)[:, 0])
    np.testing.assert_allclose(got["nested"].to_numpy(float), np.concatenate(nested), rtol=1e-9)


def test_order_statistics_share_the_exchange(spark):
    df = spark.createDataFrame([(1, 1, 1.0)], "instrument int, date int, x double")
    exprs = {"a": "Med($x, 5)", "b": "Quantile($x, 20, 0.8)", "c": "Rank($x, 60)", "d": "Mad($x, 9)", "e": "Mean(Ref($x, 1), 5)", "f": "Slope($x, 9)"}
    plan = compile_panel(df, exprs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 1 and plan.count("Sort [") == 1
