"""Models, books and stores against plain NumPy and Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import cross, desk, exposure, portfolio, report, research, shaping, structured, styles
from tidepanel.sources import results, vendor
from tidepanel.sources.files import scratch


def panel(spark, n=24, days=6, seed=5):
    r = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        for i in range(n):
            rows.append((i, f"2024-01-{d + 1:02d}", f"g{i % 4}", float(r.uniform(10, 500)), float(r.normal()), float(r.normal()), float(r.normal())))
    rows[3] = (*rows[3][:4], None, *rows[3][5:])
    rows[9] = (*rows[9][:2], None, *rows[9][3:])
    df = spark.createDataFrame(rows, "instrument int, date string, industry string, circ_mv double, r double, a double, b double").withColumn("date", F.to_date("date"))
    return df, rows


def test_constrained_regression_solves_its_normal_equations(spark):
    df, rows = panel(spark)
    got = {(str(x.date), x.factor): x.ret for x in exposure.factor_returns(df, "r", ["a", "b"], "industry", "circ_mv").collect()}
    left = {(str(x.date), x.instrument): x.residual for x in exposure.residuals(df, "r", ["a", "b"], "industry", "circ_mv").collect()}
    for day in {x[1] for x in rows}:
        own = [x for x in rows if x[1] == day and x[4] is not None and x[2] is not None]
        cap, y = np.array([x[3] for x in own]), np.array([x[4] for x in own])
        g = np.array([[x[2] == f"g{k}" for k in range(4)] for x in own], float)
        m = np.column_stack([np.ones(len(own)), g, [x[5] for x in own], [x[6] for x in own]])
        a = np.concatenate([[0], g.T @ cap, [0, 0]])
        w = np.sqrt(cap)
        kkt = np.block([[m.T @ (m * w[:, None]), a[:, None]], [a[None, :], np.zeros((1, 1))]])
        beta = np.linalg.lstsq(kkt, np.append(m.T @ (w * y), 0), rcond=None)[0][:-1]
        assert np.allclose([got[day, f] for f in ("country", "g0", "g1", "g2", "g3", "a", "b")], beta, atol=1e-9)
        assert np.allclose([left[day, x[0]] for x in own], y - m @ beta, atol=1e-9)
    assert exposure.factor_returns(df.limit(0), "r", ["a"], "industry", "circ_mv").count() == 0


def test_residual_on_many_columns(spark):
    df, rows = panel(spark)
    got = {(str(x.date), x.instrument): x.e for x in exposure.residual_on(df, "r", ["a", "b"], ["date"], "e").collect()}
    assert len(got) == len(rows) and got[rows[3][1], rows[3][0]] is None
    day = rows[0][1]
    own = [x for x in rows if x[1] == day and x[4] is not None]
    m, y = np.array([[x[5], x[6]] for x in own]), np.array([x[4] for x in own])
    assert np.allclose([got[day, x[0]] for x in own], y - m @ np.linalg.lstsq(m, y, rcond=None)[0])


def test_exposures_are_scored_and_free(spark):
    df, _ = panel(spark)
    m = exposure.exposure_matrix(df, {"a": F.col("a"), "b": F.col("b")}, ("b",), least_valid=0.5).toPandas()
    assert set(m.columns) == {"instrument", "date", "a", "b", "ind_g0", "ind_g1", "ind_g2", "ind_g3"}
    by = m.groupby("date")["a"]
    assert np.allclose(by.mean(), 0, atol=1e-9) and np.allclose(by.std(), 1)
    with pytest.raises(ValueError, match="too few"):
        exposure.exposure_matrix(df, {"a": F.when(F.col("a") > 5, F.col("a"))}, least_valid=0.5)


def test_exposures_are_dealt_by_rows(spark, monkeypatch):
    """Cross-sections go to as many tasks as their rows ask for, by one exchange, and no join or aggregate holds their values."""
    monkeypatch.setattr(cross, "TASK_ROWS", 300, raising=False)
    i = F.col("id")
    df = spark.range(6000).select((i % 100).alias("instrument"), F.expr("date_add(date '2024-01-01', int(id div 100))").alias("date"), F.concat(F.lit("g"), i % 3).alias("industry"), (i * 7919 % 101 + 1).cast("double").alias("circ_mv"), (i * 104729 % 997).cast("double").alias("a"))
    m = exposure.exposure_matrix(df, {"a": F.col("a"), "b": F.col("a") * F.col("circ_mv")})
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [date" in plan and ", 41" in plan.split("RepartitionByExpression", 1)[1].split("\n")[0]
    assert "Join" not in plan and plan.count("Repartition") == 1 and "percentile" not in "".join(x for x in plan.split("\n") if "Aggregate [" in x)
    assert m.count() == 6000 and m.select("instrument", "date").distinct().count() == 6000


def test_too_many_industries_are_an_error(spark, monkeypatch):
    df, _ = panel(spark)
    monkeypatch.setattr(exposure, "MOST_INDUSTRIES", 1)
    with pytest.raises(ValueError, match="industry"):
        exposure.industry_dummies(df)


def test_risk_models_agree_in_shape(spark):
    df, _ = panel(spark, 30, 28)
    for kinds in (("sample", "history"), ("barra", "panel")):
        e, cov, d = exposure.risk_model(df.withColumn("industry", F.coalesce("industry", F.lit("g0"))), "r", ["a", "b"], *kinds)
        c = {(x.i, x.j): x.v for x in cov.collect()}
        names = sorted({i for i, _ in c})
        v = np.array([[c[i, j] for j in names] for i in names])
        assert len(names) == 7 and np.allclose(v, v.T, atol=1e-8)
        assert all(x.d > 0 for x in d.where("d is not null").collect()) and e.groupBy("instrument").count().where("count <> 4").count() == 0


def factor_book(spark, sizes, k=4, seed=2):
    """Books of several portfolios with NumPy's view of each: (frames, {portfolio: (alpha, V, current, benchmark, instruments)})."""
    r = np.random.default_rng(seed)
    root = r.normal(size=(k, k))
    f = 0.02 * root @ root.T
    rows, xs, plain = [], [], {}
    for p, n in sizes.items():
        x, alpha, d, held = r.normal(size=(n, k)), r.normal(0, 0.05, n), r.uniform(0.02, 0.1, n), r.uniform(0, 0.02, n)
        held -= held.mean()
        ids = [f"{p}{i}" for i in range(n)]
        rows += [(p, i, float(a), float(v), float(c), 1 / n) for i, a, v, c in zip(ids, alpha, d, held)]
        xs += [(i, f"f{j}", float(x[m, j])) for m, i in enumerate(ids) for j in range(k)]
        plain[p] = alpha, x @ f @ x.T + np.diag(d), held, np.full(n, 1 / n), ids
    book = spark.createDataFrame(rows, "portfolio string, instrument string, alpha double, d double, current double, benchmark double").repartition(3)
    cov = spark.createDataFrame([(f"f{i}", f"f{j}", float(f[i, j])) for i in range(k) for j in range(k)], "i string, j string, v double")
    return (book, spark.createDataFrame(xs, "instrument string, factor string, x double"), cov), plain


def by_portfolio(df, plain):
    got = {(x["portfolio"], x["instrument"]): x["h"] for x in df.collect()}
    assert len(got) == sum(len(v[-1]) for v in plain.values())
    return {p: np.array([got[p, i] for i in v[-1]]) for p, v in plain.items()}


@pytest.mark.parametrize("buy, sell, cap, turn", [(0.0, 0.0, 1.0, 10.0), (0.002, 0.003, 0.06, 10.0), (0.002, 0.003, 0.06, 0.2), (0.5, 0.5, 0.06, 10.0)])
def test_optimum_meets_its_conditions(spark, buy, sell, cap, turn):
    """Two portfolios: limits kept, and no feasible move between two names is better; with high costs nothing moves."""
    r = np.random.default_rng(2)
    frames, plain = factor_book(spark, {"a": 25, "b": 60})
    for p, h in by_portfolio(structured.optimised(*frames, "portfolio", 5.0, buy, sell, cap, turn), plain).items():
        alpha, v, held, b, _ = plain[p]
        assert abs(h.sum()) < 1e-7 and (h >= -b - 1e-12).all() and (h <= cap + 1e-12).all() and np.abs(h - held).sum() <= turn + 1e-7
        assert np.allclose(h, held, atol=1e-12) == (buy == 0.5)
        cost = lambda z: 5 * z @ v @ z - alpha @ z + buy * np.maximum(z - held, 0).sum() + sell * np.maximum(held - z, 0).sum()  # noqa: B023, E731
        best = cost(h)
        for _ in range(3000):
            i, j = r.integers(0, len(h), 2)
            z = h.copy()
            step = r.uniform(0, 0.01)
            z[i] += step
            z[j] -= step
            if (z >= -b).all() and (z <= cap).all() and np.abs(z - held).sum() <= turn:
                assert cost(z) >= best - 1e-9


def test_optimum_by_equations(spark):
    """Without costs and limits that bind, the optimum solves the linear system of its multiplier."""
    frames, plain = factor_book(spark, {"a": 40})
    h = by_portfolio(structured.optimised(frames[0].withColumn("benchmark", F.lit(99.0)), *frames[1:], "portfolio", 5.0, 0.0, 0.0, 99.0, 1e6), plain)["a"]
    alpha, v, *_ = plain["a"]
    x, one = np.linalg.solve(10 * v, alpha), np.linalg.solve(10 * v, np.ones(40))
    assert np.allclose(h, x - one * x.sum() / one.sum(), atol=1e-9)


def test_factor_structure_is_checked(spark):
    (book, x, cov), _ = factor_book(spark, {"a": 5}, k=2)
    with pytest.raises(ValueError, match="eigenvalue"):
        structured.optimised(book, x, cov.withColumn("v", -F.col("v")), "portfolio")
    with pytest.raises(ValueError, match="met"):
        structured.optimised(book.withColumn("current", F.lit(0.5)), x, cov, "portfolio", turnover=0.01, cap=1.0)


@pytest.mark.parametrize("buy, sell, cap", [(0.002, 0.003, 0.06), (0.0, 0.0, 9.0), (0.5, 0.5, 0.06)])
def test_dead_band_is_where_single_sweeps_end(spark, buy, sell, cap):
    """Two portfolios against sweeps over one name after another with the whole covariance; with high costs nothing moves."""
    frames, plain = factor_book(spark, {"a": 25, "b": 60})
    out = structured.dead_band(*frames, "portfolio", 5.0, buy, sell, cap)
    flags = {(x["portfolio"], x["instrument"]): (x["value"], x["in_band"]) for x in out.collect()}
    for p, h in by_portfolio(out, plain).items():
        alpha, v, held, b, ids = plain[p]
        swept = portfolio.no_trade_zone(alpha + 10 * v @ b, v, held + b, 5.0, buy, sell, b + cap, sweeps=3000, tolerance=1e-13) - b
        assert np.allclose(h, swept, atol=1e-7) and np.allclose(h, held, atol=1e-12) == (buy == 0.5)
        value = alpha - 10 * v @ h
        assert np.allclose([flags[p, i][0] for i in ids], value, atol=1e-7)
        edge = (np.abs(h + b) < 1e-9) | (np.abs(h - cap) < 1e-9)
        assert all(flags[p, i][1] or e for i, e in zip(ids, edge)) and all(flags[p, i][1] == (-sell - 1e-7 <= x <= buy + 1e-7) for i, x in zip(ids, value))


def test_inverse_by_identity(spark):
    frames, plain = factor_book(spark, {"a": 12, "b": 30})
    least = by_portfolio(structured.minimum_variance(*frames, "portfolio"), plain)
    best = by_portfolio(structured.tangency(*frames, "portfolio", "alpha"), plain)
    for p, (alpha, v, *_) in plain.items():
        for got, rhs in ((least[p], np.ones(len(alpha))), (best[p], alpha)):
            x = np.linalg.solve(v, rhs)
            assert np.allclose(got, x / x.sum(), rtol=1e-7)


def test_factor_neutral_alpha_matches_the_plain_form(spark):
    from tidepanel.operators import portfolio

    r = np.random.default_rng(4)
    x, a, d = r.normal(size=(12, 3)), r.normal(size=12), r.uniform(0.1, 1, 12)
    e = spark.createDataFrame([(i, f"f{k}", float(x[i, k])) for i in range(12) for k in range(3)], "instrument int, factor string, x double")
    left, factors = desk.factor_neutral(spark.createDataFrame([(i, float(v)) for i, v in enumerate(a)], "instrument int, alpha double"), e, spark.createDataFrame([(i, float(v)) for i, v in enumerate(d)], "instrument int, d double"))
    want, theta = portfolio.factor_neutral(a, x, d)
    assert np.allclose([v.alpha for v in left.orderBy("instrument").collect()], want) and np.allclose([v.alpha for v in factors.orderBy("factor").collect()], theta)


def test_factors_are_recovered(spark):
    r = np.random.default_rng(6)
    f = r.normal(size=(4000, 2))
    load = np.array([[0.9, 0], [0.8, 0], [0.7, 0], [0, 0.9], [0, 0.8], [0, 0.6]])
    z = f @ load.T + r.normal(size=(4000, 6)) * np.sqrt(1 - (load**2).sum(1))
    names = list("abcdef")
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(3 + 2 * z)], "i int, " + ", ".join(f"{c} double" for c in names))
    means, dev, corr = research.correlations(df, names)
    got, unique = research.factor_analysis(corr, 2)
    got = got[:, np.argsort(-np.abs(got[0]))]
    assert np.abs(np.abs(got) - load).max() < 0.06
    scores = research.factor_scores(df, names, means, dev, research.bartlett(got, unique)).orderBy("i").toPandas()
    assert np.corrcoef(scores["f1"], f[:, 0])[0, 1] > 0.9 and np.corrcoef(scores["f2"], f[:, 1])[0, 1] > 0.9


def plain_backtest(rows, topk, n_drop, hold, limit, account=1e8):
    """Day by day with the plain rules: the worst go, the best come, costs are paid."""
    days = sorted({r[1] for r in rows})
    cash, held, since, last, out, before = account, {}, {}, {}, [], account
    for n, day in enumerate(days, 1):
        own = {r[0]: r for r in rows if r[1] == day}
        move = {i: r[3] / last[i] - 1 if i in last else None for i, r in own.items()}
        last.update({i: r[3] for i, r in own.items()})
        rank = sorted(own, key=lambda i: (-own[i][2], i))
        place = {i: k for k, i in enumerate(rank)}
        order = lambda i: (place.get(i, len(rank)), i)  # noqa: B023, E731
        mine = sorted(held, key=order)
        today = [i for i in rank if i not in held][: n_drop + topk - len(held)]
        worst = sorted(mine + today, key=order)[-n_drop:]
        sell = [i for i in mine if i in worst]
        buy = today[: len(sell) + topk - len(mine)]
        free = lambda i: i in own and (move[i] is None or abs(move[i]) < limit)  # noqa: B023, E731
        cost = 0
        for i in sell:
            if free(i) and n - since[i] >= hold:
                fee = max(5, held[i] * last[i] * 0.0015)
                cash += held.pop(i) * last[i] - fee
                cost += fee
                del since[i]
        buy = [i for i in buy if free(i)]
        each = cash * 0.95 / len(buy) if buy else 0
        for i in buy:
            fee = max(5, each * 0.0005)
            held[i], since[i] = (each - fee) / last[i], n
            cash -= each
            cost += fee
        value = cash + sum(s * last[i] for i, s in held.items())
        out.append((day, round(value, 4), len(held), round(cost, 6), round(value / before - 1, 10)))
        before = value
    return out


def test_backtest_with_costs(spark):
    r = random.Random(3)
    rows, price = [], {i: r.uniform(10, 50) for i in range(14)}
    for d in range(1, 25):
        for i in price:
            price[i] *= 1 + r.choice([0.0, 0.02, -0.03, 0.12, -0.01])
            if r.random() < 0.9:
                rows.append((i, f"2024-02-{d:02d}", r.random(), price[i]))
    df = spark.createDataFrame([("p", *x, 0.0) for x in rows] + [("q", *x, 0.0) for x in rows if x[0] % 2], "portfolio string, instrument int, date string, score double, close double, bench double").withColumn("date", F.to_date("date"))
    got = research.daily_backtest(df, 4, 2, 3, limit=0.1)
    for name, own in (("p", rows), ("q", [x for x in rows if x[0] % 2])):
        mine = [(str(x.date), round(x.value, 4), x.n, round(x.cost, 6), round(x.ret, 10)) for x in got.where(F.col("portfolio") == name).orderBy("date").collect()]
        # only names that were ever near the top are walked, and their own rows decide; the plain form sees all
        assert mine == plain_backtest(own, 4, 2, 3, 0.1)


def test_stores_keep_versions_and_days(spark):
    at = scratch(spark, "store")
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k int, name string, v double")
    results.put(a, at, ["k"])
    results.put(spark.createDataFrame([(2, "z", 3.0), (3, "w", 4.0)], a.schema), at, ["k"])
    assert sorted(map(tuple, results.current(spark, at).collect())) == [(1, "x", 1.0), (2, "z", 3.0), (3, "w", 4.0)]
    bad = spark.createDataFrame([(4, "q", 1.0)], a.schema).withColumn("v", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception, match="no"):
        results.put(bad, at, ["k"])
    assert results.current(spark, at).count() == 3
    days = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 2.0)], "date string, v double")
    results.save_days(days, at + "-d")
    results.save_days(spark.createDataFrame([("2024-01-02", 5.0)], days.schema), at + "-d")
    assert [r.v for r in results.load_day(spark, at + "-d", "2024-01-01").collect()] == [1.0] and [r.v for r in results.load_day(spark, at + "-d", "2024-01-02").collect()] == [5.0]


def test_vendor_rows(spark):
    raw = spark.createDataFrame([("000001.SZ", "20240102", float("nan"), 12345.0, None), ("sh.600000", None, 5.0, -99999.0, 1.0)], "ts string, d string, x double, pct double, v double")
    got = vendor.parsed(raw, {"day": "", "code": "ts", "date": "d", "x": "x", "pct": "pct", "v": "v"}, ("code",), ("date",), {"pct": 9999.99}, {"v": 0.01}, "2024-01-31").collect()
    assert [(str(r.day), r.code, str(r.date), r.x, r.pct, r.v) for r in got] == [("2024-01-31", "SZ000001", "2024-01-02", None, 9999.99, None), ("2024-01-31", "SH600000", "None", 5.0, -9999.99, 0.01)]


def test_small_cases_of_figures(spark):
    ls = spark.createDataFrame([("f", f"2024-01-{d:02d}", 0.01) for d in range(1, 6)] + [("g", "2024-01-01", 0.5), ("g", "2024-01-02", None)], "name string, date string, x double")
    cum = {r.name: r.cum for r in report.compounded(ls, "x", ["name"]).collect()}
    assert abs(cum["f"] - (1.01**5 - 1)) < 1e-12 and cum["g"] == 0.5
    ir = {r.name: r.ir for r in ls.groupBy("name").agg(report.ratio(F.col("x")).alias("ir")).collect()}
    assert ir == {"f": 0.0, "g": 0.0}
    ric = spark.createDataFrame([("a", k, 0.1 * 0.5 ** (k / 4)) for k in range(1, 9)] + [("b", k, 0.1 * k) for k in range(1, 9)] + [("c", 1, 0.1), ("c", 2, 0.05)], "name string, lag int, ric double")
    hl = {r.name: r.half_life for r in report.half_life(ric, ["name"]).collect()}
    assert abs(hl["a"] - 4) < 1e-9 and hl["b"] is None and hl["c"] is None


def test_repair_and_extension(spark):
    t = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, f double")
    v = spark.createDataFrame([(1, 1.00001), (2, 3.0), (3, 4.0), (9, 9.0)], "k int, f double")
    assert sorted(map(tuple, shaping.repaired(t, v, ["k"], ["f"]).collect())) == [(1, 1.0), (2, 3.0), (3, 4.0)]
    e = cross.finite_by_mean(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("inf"))], "g string, x double"), ["x"], ["g"])
    assert sorted(r.x for r in e.collect()) == [1.0, 2.0, 3.0]
    s = spark.createDataFrame([(1, "2024-01-01", 2.0), (1, "2024-01-02", None), (1, "2024-01-03", 4.0)], "instrument int, date string, x double")
    out = [r.y for r in styles.settled(s, "x", styles.Strength(1, 1, 2, 1, -1), "y").orderBy("date").collect()]
    assert out == [None, -2.0, -2.0]


def test_boosting_goes_on(spark):
    from tidepanel.operators.models import continued_scores

    r = np.random.default_rng(1)
    rows = []
    for d in range(1, 25):
        for i in range(40):
            a = float(r.normal())
            rows.append((i, f"2024-01-{d:02d}", a, a + (2.0 if d > 8 else 0.0) + float(r.normal(0, 0.1))))
    df = spark.createDataFrame(rows, "instrument int, date string, a double, y double")
    got = continued_scores(df, ["a"], "y", ("2024-01-01", "2024-01-08"), ("2024-01-09", "2024-01-16"), ("2024-01-17", "2024-01-24"), 5, 5, 3).join(df, ["instrument", "date"]).toPandas()
    assert len(got) == 320 and ((got["score"] - got["y"]) ** 2).mean() < 0.2 * ((got["base"] - got["y"]) ** 2).mean()


def test_a_search_goes_on_from_its_saved_state(spark):
    from tidepanel.plans.expression import parse
    from tidepanel.plans.search import Search, complexity

    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, f"2024-01-{d:02d}", float(r.uniform(1, 2)), float(r.uniform(1, 9))) for i in range(12) for d in range(1, 13)], "instrument int, date string, close double, volume double").withColumn("date", F.to_date("date"))
    new = lambda: Search(df, "Ref($close, -1) / $close - 1", ["$close", "$volume"], islands=2, size=4, height=3)
    whole = new().run(2)
    half = new()
    half.run(1)
    at = scratch(spark, "search")
    half.save(at)
    rest = new()
    rest.load(at)
    assert rest.generation == 1 and rest.run(2) == whole
    assert [complexity(parse(e)) for e in ("Mean($close, 5)", "Abs(Mean($close, 5))", "Mean(Std($close, 5), 5)", "Div($close, $open)", "Corr($close, $volume, 5)")] == ["simple", "simple", "compound", "compound", "compound"]


def test_parts_whose_codes_repeat_are_judged_one_by_one(spark, tmp_path):
    import duckdb

    from tidepanel import queries as named

    # from a million on a code has room for six of seven digits
    rows = [(k, "bolt", size) for k, size in [(100002, 1), (1000020, 20), (1000023, 20), (1000026, 50), (3, 20), (4, 45), (5, 20)]]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = sorted(r["code"] for r in named.queries()["mlb33_tradable"](spark, str(tmp_path)).collect())
    assert got == sorted(r[0] for r in con.sql(named.oracle_sql()["mlb33_tradable"]).fetchall()) and len(got) == 3


def test_an_optimum_of_far_apart_alphas_is_found(spark):
    """Alphas from -1 to some hundreds, in copies: prices move names only over a small part of that range."""
    r = np.random.default_rng(8)
    (book, x, cov), plain = factor_book(spark, {"a": 240})
    far = np.tile(np.clip(np.exp(r.normal(0, 2.2, 40)) - 1, -1, 270), 6)
    held, ids = np.zeros(240), plain["a"][4]
    alphas = spark.createDataFrame([(i, float(a)) for i, a in zip(ids, far)], "instrument string, alpha double")
    frames = (book.drop("alpha").withColumn("current", F.lit(0.0)).join(alphas, "instrument"), x, cov)
    h = by_portfolio(structured.optimised(*frames, "portfolio", 5.0, 0.001, 0.002, 0.05, 0.5), plain)["a"]
    _, v, _, b, _ = plain["a"]
    assert abs(h.sum()) < 1e-7 and (h >= -b - 1e-12).all() and (h <= 0.05 + 1e-12).all() and np.abs(h).sum() <= 0.5 + 1e-7
    cost = lambda z: 5 * z @ v @ z - far @ z + 0.001 * np.maximum(z - held, 0).sum() + 0.002 * np.maximum(held - z, 0).sum()
    best, moves = cost(h), 0
    for _ in range(40_000):
        i, j = r.integers(0, 240, 2)
        z, step = h.copy(), r.choice([1e-4, 1e-3, 1e-2])
        z[i] += step
        z[j] -= step
        if (z >= -b).all() and (z <= 0.05).all() and np.abs(z).sum() <= 0.5:
            moves += 1
            assert cost(z) >= best - 1e-8
    assert moves > 100


def test_asset_covariance_shuffles_no_pairs(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(30, 3))
    x[5, 1] = 0.0
    f = np.array([[0.09, 0.01, 0.0], [0.01, 0.04, 0.02], [0.0, 0.02, 0.05]])
    e = spark.createDataFrame([(i, f"f{j}", float(x[i, j])) for i in range(30) for j in range(3) if x[i, j]], "instrument long, factor string, x double")
    cov = spark.createDataFrame([(f"f{i}", f"f{j}", float(f[i, j])) for i in range(3) for j in range(3)], "i string, j string, v double")
    d = spark.createDataFrame([(i, 0.1 + i) for i in range(30)], "instrument long, d double")
    out = exposure.asset_covariance(e, cov, d, 0.5)
    got = np.zeros((30, 30))
    for p in out.collect():
        got[p["a"], p["b"]] = p["v"]
    assert np.allclose(got, x @ f @ x.T + np.diag(0.6 + np.arange(30)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # what is left above the blocks is a product and columns


def test_asset_covariance_keeps_pairs_short_in_a_file(spark, tmp_path, monkeypatch):
    """Several blocks on both sides; names that share exposures, in any order, take no bytes a pair for their products."""
    monkeypatch.setattr(exposure, "LEFT_ROWS", 400)
    monkeypatch.setattr(exposure, "RIGHT_ROWS", 700)
    n, r = 1500, np.random.default_rng(7)
    x = np.exp(r.normal(size=(12, 2)))[r.integers(0, 12, n)]
    f = np.array([[0.09, 0.01], [0.01, 0.04]])
    e = spark.createDataFrame([(i, f"f{j}", float(x[i, j])) for i in range(n) for j in range(2)], "instrument long, factor string, x double")
    cov = spark.createDataFrame([(f"f{i}", f"f{j}", float(f[i, j])) for i in range(2) for j in range(2)], "i string, j string, v double")
    d = spark.createDataFrame([(i, 0.1 + i) for i in range(n)], "instrument long, d double")
    exposure.asset_covariance(e, cov, d, 0.5).write.parquet(f"{tmp_path}/pairs")
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * n * n
    got = spark.read.parquet(f"{tmp_path}/pairs").toPandas().sort_values(["a", "b"])
    assert (got["a"].to_numpy() == np.repeat(np.arange(n), n)).all() and (got["b"].to_numpy() == np.tile(np.arange(n), n)).all()
    assert np.allclose(got["v"].to_numpy().reshape(n, n), x @ f @ x.T + np.diag(0.6 + np.arange(n)))


def test_the_book_of_the_last_date_makes_no_other_bars(spark, tmp_path):
    """A later month of no known supplier is none; what comes of the book reads its few rows, not lineitem."""
    import datetime

    from tidepanel.queries import analytics
    from tidepanel.sources import panels

    at = lambda *d: datetime.datetime(*d)
    lines = [(1, 1, 7, at(2001, 4, 30), 10.0, 2.0), (2, 1, 7, at(2001, 5, 2), 12.0, 2.0), (3, 1, 8, at(2001, 5, 31), 9.0, 3.0), (4, 1, 8, None, 9.0, 3.0), (5, 1, 99, at(2001, 6, 1), 5.0, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, 3, 100.0), (8, 9, 200.0), (9, 1, 300.0)], "s_suppkey long, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    b = panels.classified_bars(spark, str(tmp_path))
    want = b.join(b.agg(F.max("date").alias("date")), "date", "left_semi").select(*b.columns).collect()
    assert sorted(panels.last_bars(spark, str(tmp_path)).collect()) == sorted(want) and len(want) == 2
    assert not [p for df in analytics._book(spark, str(tmp_path)) for p in df.inputFiles() if "lineitem" in p]
    empty = b.limit(0)
    spark.read.parquet(f"{tmp_path}/lineitem.parquet").where("l_shipdate is null").write.parquet(f"{tmp_path}/none/lineitem.parquet")
    spark.read.parquet(f"{tmp_path}/supplier.parquet").write.parquet(f"{tmp_path}/none/supplier.parquet")
    assert panels.last_bars(spark, f"{tmp_path}/none").collect() == empty.collect() == []
