"""Scalar columns: codes, dates, fiscal years, session minutes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def suffix_to_prefix(code: Column) -> Column:
    """000001.SZ -> SZ000001."""
    return F.concat(F.upper(F.split_part(code, F.lit("."), F.lit(2))), F.split_part(code, F.lit("."), F.lit(1)))


def prefix_to_suffix(code: Column) -> Column:
    """SZ000001 -> 000001.SZ."""
    return F.concat(F.substr(code, F.lit(3)), F.lit("."), F.left(code, F.lit(2)))


def prefixed_to_exchange(code: Column) -> Column:
    """SH600000 -> 600000.XSHG, any other prefix -> .XSHE."""
    return F.concat(F.right(code, F.lit(6)), F.when(F.left(code, F.lit(2)) == "SH", ".XSHG").otherwise(".XSHE"))


def fiscal_year(date: Column) -> Column:
    """The last year with full statements: they are due by the end of April."""
    return F.year(date) - F.when(F.month(date) <= 4, 2).otherwise(1)


def minute_grid(day: Column) -> Column:
    """The minutes of the morning and the afternoon session."""
    at = lambda h, m: F.make_timestamp_ntz(F.year(day), F.month(day), F.day(day), F.lit(h), F.lit(m), F.lit(0))
    step = F.expr("INTERVAL 1 MINUTE")
    return F.concat(F.sequence(at(9, 30), at(11, 29), step), F.sequence(at(13, 0), at(14, 59), step))


def rounded_or_null(c: Column, digits: int = 6) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.round(c, digits))
