"""Modelling steps around a panel: segments, labels, preprocessing, factor analysis, regressions, back tests with costs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def segments(calendar: DataFrame, now: str, gap: int, test: int, valid: int, train: int) -> DataFrame:
    """(segment, start, stop) by offsets on the trading days (date): test ends ``gap`` days before ``now``, the others end where the next one starts, less a day."""
    days = calendar.where(F.col("date") < F.lit(now).cast("date")).withColumn("k", F.row_number().over(W.orderBy(F.desc("date"))))  # one row per trading day
    ends, at = [], gap
    for name, size in (("test", test), ("valid", valid), ("train", train)):
        ends.append((name, at + size, at))
        at = at + size + 1
    want = F.explode(F.array(*(F.struct(F.lit(n).alias("segment"), F.array(F.lit(a), F.lit(b)).alias("ks")) for n, a, b in ends)))
    asked = calendar.sparkSession.range(1).select(want.alias("w")).select("w.segment", F.col("w.ks")[0].alias("first"), F.col("w.ks")[1].alias("last"))
    a = days.select(F.col("date").alias("start"), F.col("k").alias("first"))
    b = days.select(F.col("date").alias("stop"), F.col("k").alias("last"))
    return asked.join(a, "first").join(b, "last").select("segment", "start", "stop")


def labels(panel: DataFrame, horizon: int) -> DataFrame:
    """(instrument, date, label, learn): close(t + horizon + 1) / close(t + 1) - 1, and its score per date."""
    w = W.partitionBy("instrument").orderBy("date")
    p = panel.select("instrument", "date", (F.try_divide(F.lead("close", horizon + 1).over(w), F.lead("close", 1).over(w)) - 1).alias("label"))
    d = W.partitionBy("date")
    return p.select("instrument", "date", "label", F.try_divide(F.col("label") - F.avg("label").over(d), F.stddev_samp("label").over(d)).alias("learn"))


def trimmed(df: DataFrame, column: str, by: list[str], share: float = 0.025) -> DataFrame:
    """Rows with a value, less the ``share`` at either end of each group (that many rounded down; ties by instrument)."""
    group = W.partitionBy(*by)
    some = df.where(F.col(column).isNotNull()).withColumn("k__", F.row_number().over(group.orderBy(column, "instrument"))).withColumn("n__", F.count("*").over(group))
    cut = F.floor(F.col("n__") * share)
    return some.where((F.col("k__") > cut) & (F.col("k__") <= F.col("n__") - cut)).drop("k__", "n__")


def tradable(universe: DataFrame, info: DataFrame, before: str, rule: str = "^[A-Za-z]{2}(60|00)", key: str = "code") -> DataFrame:
    """Rows of ``universe`` (code) that fit ``rule`` and aren't special-treatment, delisted or listed after ``before`` by ``info`` (code, name, list_date).

    Both meet on ``key``, which is another column than ``code`` where one code stands for several names.
    """
    out = info.where(F.contains("name", F.lit("ST")) | F.contains("name", F.lit("退")) | (F.col("list_date") > F.lit(before).cast("date")))
    return universe.where(F.col("code").rlike(rule)).join(out.select(key), key, "left_anti")


def preprocessed(df: DataFrame, columns: list[str], k: float = 3.0, fit: Column | None = None) -> DataFrame:
    """``columns`` bounded at ``k`` deviations, scored and with 0 for what is missing, over all rows.

    With ``fit`` the bounds and scores are those of the rows it holds for.  All columns' figures are two small aggregates.
    """
    base = df if fit is None else df.where(fit)
    first = base.agg(*(f(c).alias(f"{n}|{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()

    def cut(c: str) -> Column:
        m, s = first[f"m|{c}"], first[f"s|{c}"]
        if m is None or s is None:
            return F.col(c).cast("double")
        return F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(m - k * s)), F.lit(m + k * s)))

    bounded = df.select(*(cut(c).alias(c) if c in columns else F.col(c) for c in df.columns))
    seen = bounded if fit is None else bounded.where(fit)
    second = seen.agg(*(f(c).alias(f"{n}|{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    score = lambda c: F.coalesce(F.try_divide(F.col(c) - F.lit(second[f"m|{c}"]), F.lit(second[f"s|{c}"])), F.lit(0.0))
    return bounded.select(*(score(c).alias(c) if c in columns else F.col(c) for c in df.columns))


def linear_model(df: DataFrame, y: str, xs: list[str]) -> dict[str, float]:
    """Ordinary least squares with an intercept ("const"): sums over all rows, one small system on the driver."""
    full = df.dropna(subset=[y, *xs])
    terms = [F.lit(1.0), *(F.col(x) for x in xs)]
    sums = full.agg(*(F.sum(a * b) for i, a in enumerate(terms) for b in [*terms[i:], F.col(y)])).first()
    m, r, it = np.zeros((len(terms),) * 2), np.zeros(len(terms)), iter(sums)
    for i in range(len(terms)):
        for j in range(i, len(terms)):
            m[i, j] = m[j, i] = next(it)
        r[i] = next(it)
    return dict(zip(["const", *xs], np.linalg.lstsq(m, r, rcond=None)[0].tolist()))


def predicted(df: DataFrame, model: dict[str, float], name: str = "predict") -> DataFrame:
    return df.withColumn(name, sum((F.lit(v) * F.col(x) for x, v in model.items() if x != "const"), F.lit(model["const"])))


def correlations(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, deviations, correlation matrix) of complete rows, by one aggregate."""
    full = df.dropna(subset=columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = full.agg(*(F.avg(c) for c in columns), *(F.stddev_pop(c) for c in columns), *(F.corr(a, b) for a, b in pairs)).first()
    n = len(columns)
    r = np.eye(n)
    for (a, b), v in zip(pairs, row[2 * n :]):
        i, j = columns.index(a), columns.index(b)
        r[i, j] = r[j, i] = v
    return np.array(row[:n], float), np.array(row[n : 2 * n], float), r


def factor_analysis(r: np.ndarray, n_factors: int, rounds: int = 200, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """(loadings, uniqueness) of a correlation matrix by iterated principal axes, rotated by varimax."""
    common = 1 - 1 / np.diag(np.linalg.pinv(r))
    for _ in range(rounds):
        reduced = r.copy()
        np.fill_diagonal(reduced, common)
        vals, vecs = np.linalg.eigh(reduced)
        top = np.argsort(vals)[::-1][:n_factors]
        load = vecs[:, top] * np.sqrt(np.maximum(vals[top], 0))
        new = np.clip((load**2).sum(1), 0, 1)
        done = np.abs(new - common).max() < tolerance
        common = new
        if done:
            break
    turn = np.eye(n_factors)
    for _ in range(rounds):
        turned = load @ turn
        u, s, v = np.linalg.svd(load.T @ (turned**3 - turned * (turned**2).mean(0)))
        before, turn = turn, u @ v
        if np.abs(turn - before).max() < tolerance:
            break
    load = load @ turn
    load *= np.where(load.sum(0) < 0, -1, 1)  # signs are free: each factor leans to the positive side
    return load, np.maximum(1 - (load**2).sum(1), 1e-6)


def bartlett(load: np.ndarray, unique: np.ndarray) -> np.ndarray:
    """Score coefficients (variables by factors) of Bartlett's method for standardised variables."""
    w = load / unique[:, None]
    return w @ np.linalg.inv(load.T @ w)


def factor_scores(df: DataFrame, columns: list[str], means: np.ndarray, deviations: np.ndarray, weights: np.ndarray, prefix: str = "f") -> DataFrame:
    """``df`` with one column of scores per factor: a projection."""
    z = [(F.col(c) - F.lit(float(m))) / F.lit(float(s) or 1.0) for c, m, s in zip(columns, means, deviations)]
    return df.select("*", *(sum((F.lit(float(weights[i, k])) * z[i] for i in range(len(columns))), F.lit(0.0)).alias(f"{prefix}{k + 1}") for k in range(weights.shape[1])))


def weighted_score(factors: DataFrame, ic: DataFrame, least: float = 0.03) -> DataFrame:
    """(instrument, date, score): factor values (instrument, date, name, value) weighted by their coefficients (name, ic), those within +- ``least`` left out."""
    strong = ic.where(F.abs("ic") > least)
    return factors.join(F.broadcast(strong), "name").groupBy("instrument", "date").agg(F.sum(F.col("ic") * F.col("value")).alias("score"))  # one row per factor


def daily_backtest(panel: DataFrame, topk: int = 50, n_drop: int = 5, hold: int = 1, open_cost: float = 0.0005, close_cost: float = 0.0015, least_cost: float = 5.0, limit: float = 0.095, account: float = 1e8, risk_degree: float = 0.95, by: str = "portfolio") -> DataFrame:
    """(by, date, value, cash, n, bought, sold, cost, ret, bench) of top-k portfolios with swaps, costs and price limits.

    ``panel`` is (by, instrument, date, score, close, bench): scores decide with the
    day's close.  A name held for fewer than ``hold`` days isn't sold, one whose close moved
    ``limit`` or more is neither bought nor sold; each trade costs its rate or
    ``least_cost``.  Each portfolio is a task that walks its own dates; rows that
    reach it are those of names ever near its top.
    """
    w = W.partitionBy(by, "date").orderBy(F.desc("score"), "instrument")
    own = W.partitionBy(by, "instrument").orderBy("date")
    p = panel.withColumn("move", F.try_divide("close", F.lag("close").over(own)) - 1).withColumn("place", F.when(F.col("score").isNotNull(), F.row_number().over(w)))
    names = p.where(F.col("place") <= topk + n_drop).select(by, "instrument").distinct()
    p = p.join(names, [by, "instrument"], "left_semi").select(by, "instrument", "date", "score", "close", "move", "bench", "place")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        cash, held, since, last, rows, before, day = account, {}, {}, {}, [], account, 0
        for date, d in pdf.sort_values(["date", "place", "instrument"]).groupby("date", sort=True):
            day += 1
            price = dict(zip(d["instrument"], d["close"]))
            last |= {k: v for k, v in price.items() if v == v and v is not None}
            free = {i for i, m, c in zip(d["instrument"], d["move"], d["close"]) if c == c and not (m == m and abs(m) >= limit)}
            ranked = [i for i, s in zip(d["instrument"], d["score"]) if s == s]
            at = {i: k for k, i in enumerate(ranked)}
            mine = sorted(held, key=lambda i: (at.get(i, len(at)), i))
            today = [i for i in ranked if i not in held][: n_drop + topk - len(held)]
            both = sorted([*mine, *today], key=lambda i: (at.get(i, len(at)), i))
            worst = set(both[len(both) - n_drop :]) if n_drop else set()
            sell = [i for i in mine if i in worst]
            buy = today[: len(sell) + topk - len(mine)]
            cost = 0.0
            sold = 0
            for i in sell:
                if i in free and day - since[i] >= hold:
                    value = held.pop(i) * last[i]
                    fee = max(value * close_cost, least_cost)
                    cash, cost, sold = cash + value - fee, cost + fee, sold + 1
                    del since[i]
            buy = [i for i in buy if i in free]
            each, bought = (cash * risk_degree / len(buy) if buy else 0.0), 0
            for i in buy:
                fee = max(each * open_cost, least_cost)
                if each > fee and last.get(i, 0) > 0:
                    held[i] = held.get(i, 0.0) + (each - fee) / last[i]
                    since[i] = day
                    cash, cost, bought = cash - each, cost + fee, bought + 1
            value = cash + sum(n * last[i] for i, n in held.items())
            bench = d["bench"].dropna()
            rows.append((date, value, cash, len(held), bought, sold, cost, value / before - 1, float(bench.iloc[0]) if len(bench) else None))
            before = value
        out = pd.DataFrame(rows, columns=["date", "value", "cash", "n", "bought", "sold", "cost", "ret", "bench"])
        out.insert(0, by, pdf[by].iloc[0])
        return out

    kind = panel.schema[by].dataType.simpleString()
    return p.groupBy(by).applyInPandas(walk, f"{by} {kind}, date date, value double, cash double, n int, bought int, sold int, cost double, ret double, bench double")
