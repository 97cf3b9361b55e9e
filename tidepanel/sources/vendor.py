"""Rows as vendors send them, made into typed tables: names, codes, dates, units, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.shaping import keep_last


def to_prefix(code: Column) -> Column:
    """000001.SZ and sz.000001 become SZ000001."""
    a, b = F.split_part(code, F.lit("."), F.lit(1)), F.split_part(code, F.lit("."), F.lit(2))
    return F.when(a.rlike("^[0-9]"), F.concat(F.upper(b), a)).otherwise(F.concat(F.upper(a), b))


def parsed(rows: DataFrame, names: dict[str, str], codes: tuple[str, ...] = (), dates: tuple[str, ...] = (), bounds: dict[str, float] | None = None, scale: dict[str, float] | None = None, day: str | None = None) -> DataFrame:
    """Columns by ``names`` (own name: vendor's name), as one projection.

    NaN becomes NULL; ``codes`` get their market in front; ``dates`` are
    yyyymmdd texts; ``bounds`` cuts to +- a bound; ``scale`` multiplies; a vendor name that is
    empty stands for ``day``.
    """
    out = []
    kinds = dict(rows.dtypes)
    for own, theirs in names.items():
        if not theirs:
            out.append(F.lit(day).cast("date").alias(own))
            continue
        c = F.col(theirs)
        if kinds[theirs] in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        if own in codes:
            c = to_prefix(c)
        if own in dates:
            c = F.to_date(c, "yyyyMMdd")
        if bounds and own in bounds:
            c = F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(bounds[own])), F.lit(-bounds[own])))
        if scale and own in scale:
            c = c * F.lit(scale[own])
        out.append(c.alias(own))
    return rows.select(*out)


def numeric(rows: DataFrame, columns: list[str], digits: dict[str, int] | None = None) -> DataFrame:
    """``columns`` as numbers, what isn't one as NULL, rounded where ``digits`` says so."""
    cast = lambda c: F.expr(f"try_cast(`{c}` as double)")
    return rows.select(*((F.round(cast(c), digits[c]) if digits and c in digits else cast(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def traded(rows: DataFrame, column: str = "amount") -> DataFrame:
    """Rows of days with trade: a suspended day's row has an empty text there."""
    return rows.where(F.col(column) != "")


def with_factor(bars: DataFrame, factors: DataFrame, keys: list[str]) -> DataFrame:
    """``bars`` with their adjustment factor; bars without one keep NULL, factors without a bar go."""
    return bars.join(factors, keys, "left")


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in ``order``."""
    return keep_last(rows, keys, [F.col(c) for c in order])


def matching(rows: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """Rows by a dict of column: value (equal), list (among), or (low, high) tuple (between); NULL values don't filter."""
    for c, v in conditions.items():
        if isinstance(v, tuple):
            rows = rows.where(F.col(c).between(*v))
        elif isinstance(v, list):
            rows = rows.where(F.col(c).isin(v))
        elif v is not None:
            rows = rows.where(F.col(c) == F.lit(v))
    return rows
