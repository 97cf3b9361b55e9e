"""Registry of named queries and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.plans.expression import compile_panel, panel_sql
from tidepanel.sources import panels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PANELS = {
    "daily": (panels.daily_bars, panels.DAILY_BARS_SQL),
    "monthly": (panels.monthly_bars, panels.MONTHLY_BARS_SQL),
    "classified": (panels.classified_bars, panels.CLASSIFIED_SQL),
}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, so that sums in another order compare equal."""
    # + 0.0 turns a negative zero into zero
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def rounded_sql(sql: str, columns: str, keys: str, digits: int = 6) -> str:
    """``sql`` with the named columns rounded."""
    return f"select {keys}{', ' if keys else ''}{', '.join(f'round({c}, {digits}) + 0.0 as {c}' for c in columns.split())} from ({sql})"


def panel_query(name: str, panel: str, exprs: dict[str, str], digits: int = 6) -> None:
    """A query that works out expressions over one of the panels."""
    source, sql = PANELS[panel]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(compile_panel(source(spark, sf_dir), exprs), digits)

    run.__doc__ = "; ".join(f"{k} = {v}" for k, v in exprs.items())
    query(name, rounded_sql(panel_sql(sql, exprs), " ".join(exprs), "instrument, date", digits))(run)
