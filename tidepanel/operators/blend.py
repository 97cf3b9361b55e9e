"""Several signals blended as of each date, from what was known by then.

A signal matrix's covariance and its correlations with the residual ahead are
functions of sums and cross products.  These are aggregated once per date and
turned into sums over the last dates as differences of running sums, so the
cost does not follow the window; what follows is a K-by-K factor per date.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.sources.files import written

#: added to the diagonal, the larger one where the smaller leaves no factor; fixed values
JITTERS = (1e-10, 1e-6)


def _moments(names: list[str], residual: str | None = None) -> dict[str, object]:
    """Aggregates by name: rows, sums and cross products, with a residual also its own."""
    out = {"n": F.count("*").cast("double")} | {f"s{i}": F.sum(a) for i, a in enumerate(names)}
    out |= {f"q{i}_{j}": F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for j, b in enumerate(names[: i + 1])}
    if residual:
        out |= {"r": F.sum(residual), "rr": F.sum(F.col(residual) ** 2)} | {f"x{i}": F.sum(F.col(a) * F.col(residual)) for i, a in enumerate(names)}
    return out


def _square(pdf: pd.DataFrame, k: int, prefix: str) -> np.ndarray:
    out = np.empty((len(pdf), k, k))
    for i in range(k):
        for j in range(i + 1):
            out[:, i, j] = out[:, j, i] = pdf[f"{prefix}q{i}_{j}"]
    return out


def blend_factors(history: DataFrame, residuals: DataFrame, names: list[str], window: int = 500, min_dates: int = 250) -> DataFrame:
    """(date, dates, mean, weights, ic) for each date of ``history`` (instrument, date, names).

    As of a date, the signals of the last ``window`` dates up to it give means
    and a covariance, whose Cholesky factor L whitens them; each whitened
    signal is weighted by its pooled correlation (``ic``) with the instrument's next
    residual (``residuals``: instrument, date, residual), as far as that
    residual's date has come.  ``weights`` are those of the signals themselves, so that
    the blend is their sum over signal minus mean.

    Rows that lack a signal are left out; missing residuals are left out before the
    next one is looked for.  With fewer than ``min_dates`` dates that have a
    residual, fewer than two rows or no factor even with 1e-6 on the
    diagonal, weights and ic are NULL.  A constant whitened signal or residual
    has a correlation of 0.
    """
    k = len(names)
    full = history.na.drop("any", subset=names).select("instrument", "date", *names)
    moves = W.partitionBy("instrument").orderBy("date")
    ahead = residuals.where("residual is not null").select("instrument", "date", F.lead("residual").over(moves).alias("next"), F.lead("date").over(moves).alias("told"))
    pairs = full.join(ahead.where("next is not null"), ["instrument", "date"])
    by_date = full.groupBy("date").agg(*(c.alias(n) for n, c in _moments(names).items()))
    by_pair = pairs.groupBy("date", "told").agg(*(c.alias(n) for n, c in _moments(names, "next").items()))  # a row for each date and the few dates on which its residuals were told

    by_date, by_pair = written(by_date, "moments"), written(by_pair, "moments")  # rows by date, read several times

    # days are numbered by the history's dates; a residual counts from the first such date on or after its own
    order = W.orderBy("date")
    days = by_date.select("date", F.row_number().over(order).alias("i"))
    told = by_pair.select(F.col("told").alias("date")).distinct().join(days, "date", "full")
    told = told.select("date", F.coalesce("i", F.coalesce(F.max("i").over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)) + 1).alias("i"))
    by_pair = by_pair.join(days, "date").join(told.select(F.col("date").alias("told"), F.col("i").alias("told_i")), "told").where(F.col("told_i") - F.col("i") < window)
    first = by_pair.groupBy("i").agg(F.min("told_i").alias("told_i")).withColumn("c", F.lit(1.0))

    own, joint = list(_moments(names)), list(_moments(names, "next"))
    # what enters the sums on a day: the signals, the pairs told then, and the pairs whose signals are of that day (to be taken off later)
    enters = [(by_date.join(days, "date"), "i", own, "h_"), (by_pair, "told_i", joint, "in_"), (by_pair, "i", joint, "out_"), (first, "told_i", ["c"], "in_"), (first, "i", ["c"], "out_")]
    parts = [rows.select(F.col(at).alias("i"), *(F.col(c).alias(f"{into}{c}") for c in columns)) for rows, at, columns, into in enters]
    daily = parts[0]
    for part in parts[1:]:
        daily = daily.unionByName(part, allowMissingColumns=True)
    daily = daily.groupBy("i").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in daily.columns if c != "i"))  # a row a date
    by_day = W.orderBy("i")
    upto = by_day.rowsBetween(W.unboundedPreceding, 0)
    sums = days.join(daily, "i").select("i", "date", *(F.sum(c).over(upto).alias(c) for c in daily.columns if c != "i"))
    past = lambda c: F.coalesce(F.lag(c, window).over(by_day), F.lit(0.0))
    sums = sums.select("date", *((F.col(f"h_{c}") - past(f"h_{c}")).alias(f"h_{c}") for c in own), *((F.col(f"in_{c}") - past(f"out_{c}")).alias(f"p_{c}") for c in [*joint, "c"]))

    def factor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, m = pdf["h_n"].to_numpy(), pdf["p_n"].to_numpy()
            s, p = pdf[[f"h_s{i}" for i in range(k)]].to_numpy(), pdf[[f"p_s{i}" for i in range(k)]].to_numpy()
            with np.errstate(all="ignore"):
                mean = s / n[:, None]
                cov = (_square(pdf, k, "h_") - n[:, None, None] * mean[:, :, None] * mean[:, None, :]) / (n - 1)[:, None, None]
                joint = (_square(pdf, k, "p_") - p[:, :, None] * p[:, None, :] / m[:, None, None]) / m[:, None, None]
                with_r = (pdf[[f"p_x{i}" for i in range(k)]].to_numpy() - p * (pdf["p_r"].to_numpy() / m)[:, None]) / m[:, None]
                var_r = pdf["p_rr"].to_numpy() / m - (pdf["p_r"].to_numpy() / m) ** 2
            weights, ics = [], []
            for i in range(len(pdf)):
                lower = None
                for jitter in JITTERS:
                    if lower is None and n[i] >= 2 and m[i] >= 1 and pdf["p_c"].iloc[i] >= min_dates:
                        try:
                            lower = np.linalg.cholesky(cov[i] + jitter * np.eye(k))
                        except np.linalg.LinAlgError:
                            continue
                if lower is None:
                    weights.append(None)
                    ics.append(None)
                    continue
                white = np.linalg.inv(lower)
                spread = np.sqrt(np.maximum(np.diag(white @ joint[i] @ white.T), 0) * max(var_r[i], 0))
                ic = np.divide(white @ with_r[i], spread, out=np.zeros(k), where=spread > 1e-12)
                weights.append(white.T @ ic)
                ics.append(ic)
            yield pd.DataFrame({"date": pdf["date"], "dates": np.rint(pdf["p_c"]).astype(int), "mean": list(mean), "weights": weights, "ic": ics})

    return sums.mapInPandas(factor, f"date {history.schema['date'].dataType.simpleString()}, dates int, mean array<double>, weights array<double>, ic array<double>")


def blend_as_of(current: DataFrame, factors: DataFrame, names: list[str]) -> DataFrame:
    """(instrument, date, as_of, alpha): ``current`` signals blended by the newest of ``factors`` up to their date; rows that lack a signal or have no factor are left out."""
    full = current.na.drop("any", subset=names)
    told = factors.where("weights is not null").withColumnRenamed("date", "as_of")
    # which factor each date takes: a row a date
    both = full.select("date").distinct().select("date", F.lit(None).cast(told.schema["as_of"].dataType).alias("as_of")).unionByName(told.select(F.col("as_of").alias("date"), "as_of"))
    newest = F.max("as_of").over(W.orderBy("date").rangeBetween(W.unboundedPreceding, 0))
    which = both.select("date", newest.alias("as_of")).distinct()
    known = which.join(told, "as_of")
    alpha = sum((F.col("weights")[i] * (F.col(a) - F.col("mean")[i]) for i, a in enumerate(names)), F.lit(0.0))
    return full.join(known, "date").select("instrument", "date", "as_of", alpha.alias("alpha"))
