"""Projections, missing data, dedup, as-of joins, reshaping and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

def not_finite_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of every double column become NULL."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(*(F.when(~bad(F.col(c)), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def fill(df: DataFrame, column: str, method: str, by: list[str], order: str | None = None) -> Column:
    """A column with missing values filled within groups ``by``.

    ``zero``; ``ffill`` and ``bfill`` along ``order``; ``ffill_bfill``; ``mean``.
    """
    c = F.col(column)
    if method == "zero":
        return F.coalesce(c, F.lit(0.0))
    if method == "mean":
        return F.coalesce(c, F.avg(c).over(W.partitionBy(*by)))
    if order is None:
        raise ValueError(f"{method} needs an order")
    w = W.partitionBy(*by).orderBy(order)
    forward = F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    backward = F.first(c, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return {"ffill": forward, "bfill": backward, "ffill_bfill": F.coalesce(forward, backward)}[method]


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last in ``order``, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*order)
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("row__"))
    return picked.select(*keys, *(F.col(f"row__.{c}").alias(c) for c in rest)).select(*df.columns)


def as_of(left: DataFrame, right: DataFrame, by: str | list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the last ``right`` row at or before its time (backward as-of join).

    Both sides are put in one sorted run per key, so the cost is one shuffle
    and one sort; no pairs are formed.  Of right rows at one time the one with the
    greatest values counts.
    """
    by = [by] if isinstance(by, str) else by
    none = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (*by, left_time)]
    r = right.groupBy(*by, F.col(right_time).alias(left_time)).agg(F.max(F.struct(*values)).alias("v__"))
    r = r.select(*by, left_time, *none, F.lit(0).alias("side__"), "v__")
    rows = left.select("*", F.lit(1).alias("side__"), F.lit(None).cast(r.schema["v__"].dataType).alias("v__"))
    w = W.partitionBy(*by).orderBy(left_time, "side__").rowsBetween(W.unboundedPreceding, 0)
    both = rows.unionByName(r).withColumn("v__", F.last("v__", ignorenulls=True).over(w)).where("side__ = 1")
    return both.select(*left.columns, *(F.col(f"v__.{v}").alias(v) for v in values))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``new`` and those of ``old`` whose key is not in it."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def densify(panel: DataFrame, instrument: str = "instrument", date: str = "date") -> DataFrame:
    """Every instrument on every date that occurs, values missing where there was no row.

    Dates are packed in one array per instrument row and exploded: no cross join.
    """
    dates = panel.agg(F.array_sort(F.collect_set(date)).alias("all__"))
    names = panel.select(instrument).distinct()
    grid = names.join(F.broadcast(dates)).select(instrument, F.explode("all__").alias(date))
    return grid.join(panel, [instrument, date], "left")


def reconcile(target: DataFrame, test: DataFrame, keys: list[str], values: list[str], epsilon: float = 1e-4) -> DataFrame:
    """Full outer comparison cell by cell: status is missing, extra, different or equal.

    Cells are equal when both are missing or their relative difference is below ``epsilon``.
    """
    a = target.select(*keys, *(F.col(v).alias(f"{v}__a") for v in values), F.lit(True).alias("in_a__"))
    b = test.select(*keys, *(F.col(v).alias(f"{v}__b") for v in values), F.lit(True).alias("in_b__"))
    j = a.join(b, keys, "full")

    def same(v: str) -> Column:
        x, y = F.col(f"{v}__a"), F.col(f"{v}__b")
        close = F.abs(x - y) <= epsilon * F.greatest(F.abs(x), F.abs(y))
        return x.eqNullSafe(y) | F.coalesce(close, F.lit(False))

    every = reduce(lambda p, q: p & q, map(same, values))
    status = F.when(F.col("in_b__").isNull(), "missing").when(F.col("in_a__").isNull(), "extra").when(every, "equal").otherwise("different")
    return j.select(*keys, status.alias("status"))


def repaired(table: DataFrame, vendor: DataFrame, keys: list[str], values: list[str], epsilon: float = 1e-4) -> DataFrame:
    """``table`` with its values replaced by ``vendor``'s where both have the key and differ by more than ``epsilon``, and nothing else touched."""
    theirs = vendor.select(*keys, *(F.col(v).alias(f"{v}__v") for v in values), F.lit(True).alias("told__"))
    out = table.join(theirs, keys, "left")

    def value(v: str) -> Column:
        x, y = F.col(v), F.col(f"{v}__v")
        same = x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= epsilon * F.greatest(F.abs(x), F.abs(y)), F.lit(False))
        return F.when(F.col("told__") & ~same, y).otherwise(x).alias(v)

    return out.select(*(value(c) if c in values else F.col(c) for c in table.columns))


def run_length(flag: Column, by: list[str], order: str, island: str = "island__") -> tuple[Column, Column]:
    """Two steps of gaps and islands: the island's number, then the row's place in it (0 where ``flag`` fails)."""
    w = W.partitionBy(*by).orderBy(order)
    number = F.sum(F.when(flag, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    place = F.sum(F.when(flag, 1).otherwise(0)).over(W.partitionBy(*by, island).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return number, place
