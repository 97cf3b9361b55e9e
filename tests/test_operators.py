"""Joins, fills, point-in-time, risk and portfolio operators."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import series
from tidepanel.operators import cross, evaluate, pit, portfolio, risk, shaping
from tidepanel.plans.search import Search, uncorrelated
from tidepanel.sources import files


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_as_of_is_backward_and_keeps_rows(spark):
    left = spark.createDataFrame([("a", day(1), 1), ("a", day(5), 2), ("b", day(3), 3), ("c", day(3), 4)], "k string, t date, x int")
    right = spark.createDataFrame([("a", day(1), 10.0), ("a", day(1), 11.0), ("a", day(4), 12.0), ("b", day(4), 13.0)], "k string, u date, v double")
    got = {(r.k, r.x): r.v for r in shaping.as_of(left, right, "k", "t", "u", ["v"]).collect()}
    assert got == {("a", 1): 11.0, ("a", 2): 12.0, ("b", 3): None, ("c", 4): None}


def test_upsert_reconcile_densify(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    new = spark.createDataFrame([(2, 2.00001), (4, 4.0)], "k int, v double")
    assert sorted((r.k, r.v) for r in shaping.upsert(old, new, ["k"]).where("v is not null").collect()) == [(1, 1.0), (2, 2.00001), (4, 4.0)]
    got = {r.k: r.status for r in shaping.reconcile(old, new, ["k"], ["v"]).collect()}
    assert got == {1: "missing", 2: "equal", 3: "missing", 4: "extra"}
    p = spark.createDataFrame([("a", day(0), 1.0), ("b", day(1), 2.0)], "instrument string, date date, x double")
    assert shaping.densify(p).count() == 4


def test_files_round_trip(spark):
    df = spark.createDataFrame([(1, "a\tb", None), (2, "", 1.5)], "k int, s string, v double")
    for kind in ("csv", "parquet"):
        path = files.scratch(spark, kind)
        files.write_frame(df, path, kind)
        back = files.read_frame(spark, path, kind, df.schema)
        assert sorted((r.k, r.v) for r in back.collect()) == [(1, None), (2, 1.5)]
    at = files.upsert_into(spark, path, spark.createDataFrame([(2, "new", 2.0)], df.schema), ["k"])
    assert {r.k: r.s for r in files.read_frame(spark, at).collect()} == {1: "a\tb", 2: "new"}
    with pytest.raises(ValueError):
        files.write_frame(df, path, "xml")


def test_ttm_uses_only_what_was_announced(spark):
    rows = [(1, day(0), 202204, 100.0, 1), (1, day(0), 202201, 20.0, 2), (1, day(10), 202301, 30.0, 3), (1, day(20), 202204, 110.0, 4), (1, day(30), 202301, 31.0, 5), (2, day(0), 202301, 5.0, 6), (1, day(40), 202302, None, 7)]
    df = spark.createDataFrame(rows, "instrument int, ann_date date, period int, value double, seq int")
    got = {r.seq: r.ttm for r in pit.ttm_events(df).collect()}
    assert got == {1: 100.0, 3: 110.0, 4: 110.0, 5: 121.0}
    assert {r.fy for r in pit.annual_values(spark.createDataFrame([(1, dt.date(2024, 4, 30), 1.0), (1, dt.date(2024, 5, 1), 2.0)], "instrument int, date date, x double"), "x").collect()} == {2022, 2023}


def test_neutralised_residual_is_orthogonal(spark):
    r = np.random.default_rng(2)
    n = 120
    pdf = pd.DataFrame({"date": day(0), "i": range(n), "g": r.choice(["a", "b", "c"], n), "x": r.normal(size=n)})
    pdf["y"] = pdf["x"] * 2 + (pdf["g"] == "a") * 3 + r.normal(size=n)
    out = cross.neutralized(spark.createDataFrame(pdf), "y", "x", "g", ["date"], "e").toPandas()
    design = np.column_stack([pd.get_dummies(out["g"]).to_numpy(float), out["x"]])
    beta, *_ = np.linalg.lstsq(design, out["y"].to_numpy(), rcond=None)
    np.testing.assert_allclose(out["e"], out["y"] - design @ beta, atol=1e-9)


def test_median_bounds_move_rows_once(spark):
    """Bounds by median deviation are windows: one exchange, no join; rows without a key are left as they are."""
    r = np.random.default_rng(4)
    rows = [(day(k), float(x)) for k in range(3) for x in r.standard_t(2, 41 + k)] + [(day(0), None), (None, 1e6), (None, 1.0), (None, 2.0), (day(9), None)]
    df = spark.createDataFrame(rows, "date date, x double")
    out = cross.winsorize(df, "x", ["date"], "mad")
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    got = {}
    for row in out.collect():
        got.setdefault(row.date, []).append(row.x)
    assert sorted(got[None]) == [1.0, 2.0, 1e6] and got[day(9)] == [None] and None in got[day(0)]
    for k in range(3):
        x = np.array([v for d, v in rows if d == day(k) and v is not None])
        m = np.median(x)
        room = 3 * 1.4826 * np.median(np.abs(x - m))
        np.testing.assert_allclose(sorted(v for v in got[day(k)] if v is not None), np.sort(np.clip(x, m - room, m + room)), rtol=1e-12)


def test_bins_with_ties(spark):
    pdf = pd.DataFrame({"date": [day(0)] * 9 + [day(1)] * 3, "x": [1, 1, 1, 1, 2, 3, 4, 5, 6, 7, 7, 7]}).astype({"x": float})
    got = cross.quantile_bins(spark.createDataFrame(pdf), "x", 4, ["date"]).toPandas()
    want = pd.qcut(pdf["x"][:9], 4, labels=False, duplicates="drop")
    one = got[got["date"] == day(0)].sort_values("x")["bin"].to_numpy(float)
    np.testing.assert_array_equal(one, np.sort(want))
    assert got[got["date"] == day(1)]["bin"].isna().all()


def test_constrained_regression_meets_its_conditions():
    r = np.random.default_rng(3)
    x, y, w = r.normal(size=(60, 4)), r.normal(size=60), r.random(60) + 0.1
    a = np.array([0.0, 1.0, 2.0, 0.0])
    beta = cross.weighted_regression(y, x, w, a)
    g = x.T @ (w * (y - x @ beta))
    assert abs(a @ beta) < 1e-12 and np.linalg.matrix_rank(np.stack([g, a]), tol=1e-8) == 1


def test_attribution_sums_to_risk(spark):
    r = np.random.default_rng(4)
    names, fs = list(range(30)), ["f1", "f2", "f3"]
    x, h, d = r.normal(size=(30, 3)), r.normal(size=30) * 0.1, r.random(30) * 0.1
    m = r.normal(size=(3, 3))
    f = m @ m.T
    e = spark.createDataFrame([(i, fs[k], float(x[i, k])) for i in names for k in range(3)], "instrument int, factor string, x double")
    cov = spark.createDataFrame([(fs[i], fs[j], float(f[i, j])) for i in range(3) for j in range(3)], "i string, j string, v double")
    spec = spark.createDataFrame([(i, float(d[i])) for i in names], "instrument int, d double")
    w = spark.createDataFrame([(i, float(h[i])) for i in names], "instrument int, h double")
    v = x @ f @ x.T + np.diag(d)
    psi = np.sqrt(h @ v @ h)
    got = risk.asset_contributions(e, cov, spec, w).toPandas().sort_values("instrument")
    np.testing.assert_allclose(got["marginal"], v @ h / psi, atol=1e-12)
    assert abs(got["contribution"].sum() - psi) < 1e-12
    np.testing.assert_allclose(risk.positive_definite(np.diag([1.0, -1.0])), np.diag([1.0, 1e-10]), atol=1e-15)


def test_optimiser_and_dead_band():
    r = np.random.default_rng(5)
    m = r.normal(size=(12, 12))
    v, a, cap = m @ m.T / 12 + 0.1 * np.eye(12), r.normal(size=12) * 0.1, np.full(12, 0.3)
    h = portfolio.optimise(a, v, cap, 1.0)
    assert abs(h.sum() - 1) < 1e-8 and h.min() > -1e-10 and h.max() <= 0.3 + 1e-10
    g = a - 2 * v @ h
    inner = (h > 1e-6) & (h < 0.3 - 1e-6)
    assert np.ptp(g[inner]) < 1e-5 and (g[h <= 1e-6] <= g[inner].max() + 1e-5).all() and (g[h >= 0.3 - 1e-6] >= g[inner].min() - 1e-5).all()
    still = portfolio.no_trade_zone(a, v, h, 1.0, 10.0, 10.0, cap)
    np.testing.assert_array_equal(still, h)
    free = portfolio.no_trade_zone(a, v, h, 1.0, 0.0, 0.0, np.full(12, 9.0), sweeps=500)
    assert (np.abs((a - 2 * v @ free)[free > 1e-9]) < 1e-5).all()
    assert abs(portfolio.minimum_variance(v).sum() - 1) < 1e-12
    residual, f = portfolio.factor_neutral(a, m[:, :2], np.ones(12))
    np.testing.assert_allclose(m[:, :2].T @ residual, 0, atol=1e-4)


def test_trades_round_to_lots(spark):
    rows = [("buy", 0.5, 0.0, 7.0), ("sell", 0.0, 0.3, 3.0), ("hold", 0.1, 0.100001, 5.0), ("free", 0.2, 0.0, 0.0)]
    got = {r.name: (r.side, r.shares) for r in portfolio.trades(spark.createDataFrame(rows, "name string, target double, current double, price double"), 10_000).collect()}
    assert got == {"buy": ("buy", 700), "sell": ("sell", 1000), "hold": ("hold", 0), "free": ("buy", 0)}


def test_series_models():
    r = np.random.default_rng(6)
    e = r.normal(size=3000)
    y = np.zeros(3000)
    for t in range(1, 3000):
        y[t] = 0.5 + 0.6 * y[t - 1] + e[t] + 0.3 * e[t - 1]
    m = series.arma(y, 1, 1)
    assert abs(m.ar[0] - 0.6) < 0.08 and abs(m.ma[0] - 0.3) < 0.1
    t, _, c = series.adf(y)
    walk, *_ = series.adf(np.cumsum(e))
    assert t < c[0.01] < c[0.05] < walk
    assert abs(series.next_level(y) - (0.5 + 0.6 * y[-1] + 0.3 * e[-1])) < 0.5


def test_return_figures(spark):
    r = np.random.default_rng(7).normal(size=50) * 0.01
    got = evaluate.return_statistics(spark.createDataFrame([(day(i), float(x)) for i, x in enumerate(r)], "date date, ret double")).first()
    cum = np.cumsum(r)
    assert abs(got["max_drawdown"] - (cum - np.maximum.accumulate(cum)).min()) < 1e-12 and abs(got["annualized"] - r.mean() * 252) < 1e-12
    assert evaluate.decay_lags(12) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11] or evaluate.decay_lags(12)[0] == 1


def test_search_finds_the_planted_factor(spark):
    r = np.random.default_rng(8)
    rows = [pd.DataFrame({"instrument": i, "date": [day(k) for k in range(40)], "a": r.normal(size=40), "b": r.normal(size=40)}) for i in range(25)]
    pdf = pd.concat(rows)
    pdf["y"] = pdf["a"] - pdf["b"] + r.normal(size=len(pdf)) * 0.2
    s = Search(spark.createDataFrame(pdf), "$y", ["$a", "$b"], islands=2, size=8, seed=1)
    best = s.run(generations=2)
    assert best[0][1] > 0.5 and all(f <= best[0][1] for _, f in best)
    kept = uncorrelated(spark.createDataFrame(pdf), ["$a", "$a * 2", "$b"])
    assert kept == ["$a", "$b"]


def test_volatility_of_old_and_new_names(spark):
    from tidepanel.operators import volatility

    r = np.random.default_rng(3)
    days = pd.date_range("2020-01-01", periods=230).date
    rows, traits = [], []
    for i in range(70):
        n = 230 if i < 60 else 5 + i - 60
        rows += [(i, d, float(r.normal() * (1 + i % 5))) for d in days[-n:]]
        if i != 69:
            traits.append((i, days[-1], f"ind{i % 4}" if i != 68 else "unseen", float(np.exp(3 + i % 7))))
    res, tr = spark.createDataFrame(rows, "instrument int, date date, residual double"), spark.createDataFrame(traits, "instrument int, date date, industry string, circ_mv double")
    got = {x.instrument: x for x in volatility.residual_volatility(res, tr).collect()}
    pdf = pd.DataFrame(rows, columns=["i", "d", "u"])
    sd = pdf.groupby("i")["u"].apply(lambda s: s.iloc[-200:].std())
    design = lambda ids: np.array([[1.0, *(float(traits[i][2] == f"ind{k}") for k in (1, 2, 3)), np.log(traits[i][3])] for i in ids])
    beta = np.linalg.lstsq(design(range(60)), sd[:60].to_numpy(), rcond=None)[0]
    assert len(got) == 70 and [got[i].method for i in (0, 60, 68, 69)] == ["history", "regression", "regression", "median"]
    np.testing.assert_allclose([got[i].omega for i in range(60)], sd[:60])
    np.testing.assert_allclose([got[i].omega for i in range(60, 69)], np.maximum(design(range(60, 69)) @ beta, 0.001))
    assert got[69].omega == pytest.approx(sd[:60].median())
    assert {x.method for x in volatility.residual_volatility(res, tr, min_old=61).collect()} == {"history", "median"}
    with pytest.raises(ValueError):
        volatility.residual_volatility(res, tr, as_of=str(days[100]))
    z = pdf.assign(z=np.sin(np.arange(len(pdf)))).rename(columns={"i": "instrument", "d": "date"})
    ahead = z.groupby("instrument")["u"].shift(-1)
    one = volatility.pooled_ic(spark.createDataFrame(z[["instrument", "date", "z"]]), res, 229).first()
    assert (one.dates, one.n) == (229, ahead.notna().sum()) and one.ic == pytest.approx(z["z"].corr(ahead))
    assert volatility.pooled_ic(spark.createDataFrame(z[["instrument", "date", "z"]]), res).first().ic is None


@pytest.mark.parametrize(("half_corr", "half_var", "days"), [(252, 42, 90), (12, 5, 60), (30, 30, 60), (252, 42, 22)])
def test_barra_covariance_is_the_recursion(spark, half_corr, half_var, days):
    r = np.random.default_rng(4)
    x = r.normal(size=(days, 3)) @ r.normal(size=(3, 3)) * np.where(np.arange(days) < 40, 0.01, 0.05)[:, None]
    x = np.column_stack([x, x[:, 0] + x[:, 1]])
    lc, ld = 0.5 ** (1 / half_corr), 0.5 ** (1 / half_var)
    f = np.cov(x[:20].T, ddof=1)
    var = np.diag(f).copy()
    for t in range(20, days):
        f = lc * f + (1 - lc) * np.outer(x[t], x[t])
        var = ld * var + (1 - ld) * np.diag(f)
    dev = np.sqrt(var)
    want = f / np.sqrt(np.outer(np.diag(f), np.diag(f))) * np.outer(dev, dev)
    rows = [(day(t), "abcd"[k], float(x[t, k])) for t in range(days) for k in range(4)]
    rows += [(day(days), "a", 9.0), (day(days), "b", None)]  # a date without every factor
    pdf = risk.barra_covariance(spark.createDataFrame(rows, "date date, factor string, ret double"), half_corr, half_var).toPandas()
    got = pdf.pivot(index="i", columns="j", values="v").to_numpy() / 252
    np.testing.assert_allclose(got, want, atol=2e-10)
    assert np.linalg.eigvalsh(got)[0] > -1e-15
    with pytest.raises(ValueError):
        risk.barra_covariance(spark.createDataFrame([x for x in rows if x[0] < day(20)], "date date, factor string, ret double"))


def test_specific_variance_is_forecast_from_the_styles(spark):
    r = np.random.default_rng(5)
    rows = [(i, day(t), float(r.normal() * (0.01 + 0.01 * i / 40)), float(i) * 1e6 + r.normal(), float(r.normal())) for t in range(140) for i in range(40)]
    pdf = pd.DataFrame(rows, columns=["instrument", "date", "residual", "size", "beta"])
    pdf.loc[[7, 5599], "residual"] = np.nan  # the last: no residual on the latest date
    pdf.loc[[5597, 5598], "beta"] = [1e5, -1e5]  # one of them meets the floor
    spark_df = spark.createDataFrame([tuple(None if x != x else x for x in row) for row in pdf.itertuples(index=False)], "instrument int, date date, residual double, size double, beta double")
    got = risk.forecast_specific_variance(spark_df.select("instrument", "date", "residual"), spark_df.drop("residual"), ["size", "beta"])
    p = pdf.dropna().assign(u=lambda d: d["residual"] ** 2)
    s = series.next_level(p.groupby("date")["u"].mean().to_numpy())
    t = p[(p["date"] >= day(20)) & (p["date"] < day(139))]
    v = t["u"] / t.groupby("date")["u"].transform("mean") - 1
    mid = v.groupby(t["date"]).transform("median")
    dev = 1.4826 * (v - mid).abs().groupby(t["date"]).transform("median")
    v = v.clip(mid - 3 * dev, mid + 3 * dev)
    beta = np.linalg.lstsq(np.column_stack([np.ones(len(t)), t["size"] / 1e6, t["beta"]]), v, rcond=None)[0]
    last = p[p["date"] == day(139)]
    want = np.maximum(s * (1 + np.column_stack([np.ones(len(last)), last["size"] / 1e6, last["beta"]]) @ beta), 1e-8) * 252
    out = got.toPandas().sort_values("instrument")
    assert out["instrument"].tolist() == last["instrument"].tolist() == list(range(39))
    np.testing.assert_allclose(out["specific_var"], want, rtol=1e-7)
    assert out["specific_var"].min() == 1e-8 * 252
    low = spark_df.select("instrument", "date", F.lit(0.0).alias("residual")).where(F.col("date") < F.lit(day(9)))
    with pytest.raises(ValueError):
        risk.forecast_specific_variance(low, spark_df, ["size"])


def test_statement_ratios_are_the_formulas(spark):
    from tidepanel import queries as named
    from tidepanel.sources import panels

    sf = "/root/testdata/sf0.001"
    got = named.queries()["cne35_37_statement_ratios"](spark, sf).toPandas()
    p = panels.classified_bars(spark, sf).toPandas().merge(got, on=["instrument", "date"])
    p = p[p["amount"] != 0]
    assert len(p)
    np.testing.assert_allclose(p["acf"].astype(float), -(p["close"] - p["open"] + p["volume"]) / p["amount"], atol=1e-5)
    np.testing.assert_allclose(p["gp"].astype(float), (p["circ_mv"] - p["volume"]) / p["amount"], atol=1e-5)


def test_running_sums_hold_over_stretches(spark):
    """Windows that begin in the stretch of weights before, and missing values, against a plain weighted mean."""
    from tidepanel.operators import rolling

    r = np.random.default_rng(8)
    v = [None if r.random() < 0.1 else float(r.normal(100, 5)) for _ in range(400)]
    df = spark.createDataFrame([(1, f"{2000 + i // 300}-{1 + i // 25 % 12:02d}-{1 + i % 25:02d}", x) for i, x in enumerate(v)], "instrument int, date string, x double")
    reach, rolling._REACH = rolling._REACH, 20
    try:
        got = rolling.half_life_stats(df, "x", 50, 2.0).orderBy("date").toPandas()
    finally:
        rolling._REACH = reach
    for i in (48, 49, 60, 99, 100, 120, 149, 250, 399):
        own = [(x, 2.0 ** (k / 2)) for k, x in enumerate(v[max(0, i - 49) : i + 1]) if x is not None]
        if i < 49:
            assert np.isnan(got["weighted_mean"][i])
            continue
        x, w = np.array(own).T
        mean = (x * w).sum() / w.sum()
        assert abs(got["weighted_mean"][i] - mean) < 1e-8 and abs(got["weighted_std"][i] - np.sqrt((w * (x - mean) ** 2).sum() / w.sum())) < 1e-5


def test_blend_as_of_each_date_by_brute_force(spark):
    """Three signals, missing values, an instrument with gaps, residuals told after the window has passed, and a young history."""
    from tidepanel.operators.blend import blend_as_of, blend_factors

    r = np.random.default_rng(8)
    dates = pd.bdate_range("2024-01-01", periods=40).date
    rows = [(i, d, *r.normal(size=3)) for i in range(12) for d in dates if not (i == 3 and 5 < dates.tolist().index(d) < 32)]
    sig = pd.DataFrame(rows, columns=["instrument", "date", "a", "b", "c"])
    sig["b"] += 0.5 * sig["a"]
    sig.loc[r.random(len(sig)) < 0.05, "c"] = np.nan
    res = pd.DataFrame([(i, d, r.normal()) for i in range(12) for d in dates if r.random() > 0.1 and not (i == 3 and 5 < dates.tolist().index(d) < 32)], columns=["instrument", "date", "residual"])
    res.loc[5, "residual"] = np.nan
    window, least, names = 10, 6, ["a", "b", "c"]
    history, current = sig[sig["date"] < dates[35]], sig[sig["date"] >= dates[20]]
    plain = lambda df: spark.createDataFrame(df).replace(float("nan"), None)
    factors = blend_factors(plain(history), plain(res), names, window, least)
    got = {(x["instrument"], x["date"]): (x["as_of"], x["alpha"]) for x in blend_as_of(plain(current), factors, names).collect()}

    full = history.dropna()
    nxt = res.dropna().sort_values(["instrument", "date"])
    nxt = nxt.assign(next=nxt.groupby("instrument")["residual"].shift(-1), told=nxt.groupby("instrument")["date"].shift(-1)).dropna()
    days = sorted(full["date"].unique())
    want = {}
    for d in sorted(current["date"].unique()):
        for as_of in [x for x in reversed(days) if x <= d]:
            last = [x for x in days if x <= as_of][-window:]
            m = full[full["date"].isin(last)]
            p = m.merge(nxt, on=["instrument", "date"])
            p = p[p["told"] <= as_of]
            if p["date"].nunique() < least:
                continue
            mean, lower = m[names].mean().to_numpy(), np.linalg.cholesky(np.cov(m[names].to_numpy(), rowvar=False) + 1e-10 * np.eye(3))
            y = np.linalg.solve(lower, (p[names].to_numpy() - mean).T)
            ic = np.array([np.corrcoef(v, p["next"])[0, 1] for v in y])
            today = current[current["date"] == d].dropna()
            alpha = np.linalg.solve(lower, (today[names].to_numpy() - mean).T).T @ ic
            want |= {(i, d): (as_of, a) for i, a in zip(today["instrument"], alpha)}
            break
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


@pytest.mark.parametrize("tile", [3, 128])
def test_correlations_of_all_pairs_by_brute_force(spark, monkeypatch, tile):
    """Missing values, constants, a pair without common rows, large offsets; tiles smaller than the columns."""
    from tidepanel.operators import gram

    monkeypatch.setattr(gram, "TILE", tile)
    monkeypatch.setattr(gram, "FANS", (3, 2))
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 8))
    x[:, 1] += x[:, 0]
    x[:, 2] = 1e7 + 0.1 * x[:, 2] - 0.1 * x[:, 0]
    x[:, 3] = 5.0
    x[r.random(x.shape) < 0.2] = np.nan
    x[::2, 4] = np.nan
    x[1::2, 5] = np.nan
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcdefgh"))).replace(float("nan"), None).repartition(7)
    got = {(p["a"], p["b"]): (p["n"], p["corr"]) for p in gram.correlation_pairs(df, list("abcdefgh")).collect()}
    assert len(got) == 28
    for (i, j), (n, corr) in got.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert n == both.sum()
        if n < 2 or 3 in (i, j):
            assert corr is None
        else:
            assert abs(corr - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9
    assert gram.correlation_pairs(df.limit(0), ["a", "b"]).count() == 0


def test_many_series_against_one_by_one(spark):
    """Unit roots, orders, coefficients and next values of series of several lengths and levels, as the NumPy form gives them one by one."""
    from tidepanel.operators import arma

    r = np.random.default_rng(12)
    made = {}
    for k, n in enumerate((80, 100, 150, 260, 90, 70)):
        e, y = r.normal(size=n), np.zeros(n)
        for t in range(1, n):
            y[t] = [0.6, 0.0, 0.9, 1.0, -0.4, 0.3][k] * y[t - 1] + e[t] + [0.0, 0.5, 0.3, 0.0, 0.2, -0.5][k] * e[t - 1]
        made[f"s{k}"] = y + 100.0 * k
    rows = [(k, i, float(v)) for k, y in made.items() for i, v in enumerate(y)] + [("s0", -1, None), ("short", 0, 1.0), ("short", 1, 3.0), ("none", 0, None)]
    df = spark.createDataFrame(rows, "key string, date int, y double").repartition(4)
    roots = {x["key"]: x for x in arma.unit_roots(df, "key").collect()}
    models = {x["key"]: x for x in arma.arma_models(df, "key").collect()}
    levels = {x["key"]: x["level"] for x in arma.next_levels(df, "key").collect()}
    for k, y in made.items():
        t, lags, critical = series.adf(y)
        assert roots[k]["lags"] == lags and abs(roots[k]["t"] - t) < 1e-6 and abs(roots[k]["critical_5"] - critical[0.05]) < 1e-12
        m = series.select_arma(y)
        assert (models[k]["ar"], models[k]["ma"]) == (len(m.ar), len(m.ma)) and abs(models[k]["bic"] - m.bic) < 1e-8
        np.testing.assert_allclose([models[k]["const"], *models[k]["ar_coefs"], *models[k]["ma_coefs"]], [m.const, *m.ar, *m.ma], rtol=1e-6, atol=1e-6)
        assert abs(models[k]["forecast"] - m.forecast(1)[0]) < 1e-6 and abs(levels[k] - series.next_level(y)) < 1e-6
    assert models["short"]["ar"] is None and levels["short"] == 2.0 and models["none"]["n"] == 0 and "none" not in levels


def test_keys_of_a_batch_are_solved_together():
    """Each key's coefficients are those of its own least squares, singular ones among them."""
    from tidepanel.operators import arma

    r = np.random.default_rng(5)
    x = r.normal(size=(6, 40, 4))
    x[2, :, 3] = 0.0
    beta, rss, _ = arma._least_squares(np.einsum("kni,knj->kij", x, x), 0, [1, 2, 3])
    for k in range(6):
        want = np.linalg.lstsq(x[k][:, 1:], x[k][:, 0])[0]
        np.testing.assert_allclose(beta[k], want, atol=1e-9)
        assert abs(rss[k] - ((x[k][:, 0] - x[k][:, 1:] @ want) ** 2).sum()) < 1e-9


def test_series_models_work_out_their_panel_once(spark):
    from tidepanel.queries import queries

    assert "lineitem" not in queries()["rsk27_32_series_models"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_a_generation_reads_its_panel_once(spark):
    from tidepanel.plans.search import score_batch

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def told(x):
        seen.add(1)
        return float(x % 7)

    rows = spark.range(60).select((F.col("id") % 6).alias("instrument"), F.floor(F.col("id") / 6).alias("date"), told(F.col("id") * 5).alias("close"))
    fit = score_batch(rows, ["$close", "Abs($close)"], "Ref($close, -2) / Ref($close, -1) - 1")
    assert fit["$close"] == fit["Abs($close)"] and seen.value == 60


def test_rank_correlations_hold_no_group_to_count_what_is_missing(spark):
    from tidepanel.operators.cross import information_coefficients

    df = spark.createDataFrame([(0, float(x), float(y)) for x, y in [(1, 2), (1, 1), (2, 2), (3, 5), (3, 5)]] + [(0, None, 1.0), (0, 1.0, None), (1, None, None)], "date int, f double, r double")
    ic = information_coefficients(df, "f", "r", ["date"])
    assert ic._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 4
    (row,) = ic.collect()
    assert row["n"] == 5 and abs(row["ric"] - np.corrcoef([1.5, 1.5, 3, 4.5, 4.5], [2.5, 1, 2.5, 4.5, 4.5])[0, 1]) < 1e-12


def test_spread_groups_of_rank_correlations(spark):
    """Small groups stay dealt over the session's partitions, a few to a task, with the same figures."""
    rows = spark.range(4000).select((F.col("id") % 40).alias("date"), (F.col("id") * 7919 % 101).cast("double").alias("f"), (F.col("id") * 104729 % 97).cast("double").alias("r"))
    plain, spread = (cross.information_coefficients(rows, "f", "r", ["date"], spread=s) for s in (False, True))
    figures = lambda ic: np.array(sorted(map(tuple, ic.collect())))
    np.testing.assert_allclose(figures(plain), figures(spread), atol=1e-12)
    held = [r["count"] for r in spread.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(held) == 40 and max(held) <= 10
