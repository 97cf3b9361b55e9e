"""Boosted-tree scores over panel features, by date segments and rolling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vectors(panel: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    full = panel.na.fill(0.0, subset=features)
    return VectorAssembler(inputCols=features, outputCol="x__").transform(full)


def fit_scores(panel: DataFrame, features: list[str], label: str, train: tuple[str, str], test: tuple[str, str], trees: int = 10, depth: int = 4, seed: int = 0) -> DataFrame:
    """(instrument, date, score) for the test dates of a model fitted on the train dates; both ends inclusive.

    Missing features count as 0, rows without a label aren't trained on.
    """
    from pyspark.ml.regression import GBTRegressor

    v = _vectors(panel, features)
    learn = v.where(F.col("date").between(*train) & F.col(label).isNotNull())
    model = GBTRegressor(featuresCol="x__", labelCol=label, predictionCol="score", maxIter=trees, maxDepth=depth, seed=seed).fit(learn)
    return model.transform(v.where(F.col("date").between(*test))).select("instrument", "date", "score")


def rolling_scores(panel: DataFrame, features: list[str], label: str, windows: list[tuple[tuple[str, str], tuple[str, str]]], **options: int) -> DataFrame:
    """The union of fit_scores over (train, test) windows whose test dates don't overlap."""
    parts = [fit_scores(panel, features, label, train, test, **options) for train, test in windows]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def continued_scores(panel: DataFrame, features: list[str], label: str, train: tuple[str, str], more: tuple[str, str], test: tuple[str, str], trees: int = 10, more_trees: int = 5, depth: int = 4, seed: int = 0) -> DataFrame:
    """(instrument, date, score, base) of a model of the train dates boosted further on the later dates ``more``.

    Boosting goes on by fitting further trees to what the first ones leave of the
    label there; scores are the sum of both parts, ``base`` the first alone.
    """
    from pyspark.ml.regression import GBTRegressor

    v = _vectors(panel, features)
    fit = lambda df, y, n: GBTRegressor(featuresCol="x__", labelCol=y, predictionCol=f"p_{y}", maxIter=n, maxDepth=depth, seed=seed).fit(df)
    first = fit(v.where(F.col("date").between(*train) & F.col(label).isNotNull()), label, trees)
    later = first.transform(v.where(F.col("date").between(*more) & F.col(label).isNotNull())).withColumn("rest__", F.col(label) - F.col(f"p_{label}"))
    second = fit(later.drop(f"p_{label}"), "rest__", more_trees)
    out = second.transform(first.transform(v.where(F.col("date").between(*test))))
    return out.select("instrument", "date", (F.col(f"p_{label}") + F.col("p_rest__")).alias("score"), F.col(f"p_{label}").alias("base"))


def merge_horizons(scores: dict[int, DataFrame], calendar: DataFrame) -> DataFrame:
    """(instrument, date, horizon, score): each horizon's scores moved to the trading day they speak of.

    ``calendar`` has (date, idx), one row per trading day.
    """
    to = calendar.select(F.col("idx").alias("to_idx"), F.col("date").alias("to_date"))
    parts = []
    for h, df in scores.items():
        moved = df.join(calendar, "date").withColumn("to_idx", F.col("idx") + h).join(to, "to_idx")
        parts.append(moved.select("instrument", F.col("to_date").alias("date"), F.lit(h).alias("horizon"), "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
