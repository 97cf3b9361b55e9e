"""JSON out of free text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# what may hold an object, tried in this order: the text, a fenced block, an opened fence, the outermost braces of either
_FENCED, _OPENED, _BRACES = r"```(?:json)?\s*([\s\S]*?)\s*```", r"^\s*```(?:json)?\s*([\s\S]*)$", r"(\{[\s\S]*\})"


def _inside(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def loose_json(text: Column) -> Column:
    """The JSON value (VARIANT) that a text holds: whole, in a fenced block, behind a fence that isn't closed, or between its first and last brace; NULL where none of them parses, as for a missing or blank text."""
    opened = _inside(text, _OPENED)
    tries = [F.nullif(F.trim(text), F.lit("")), _inside(text, _FENCED), opened, _inside(opened, _BRACES), _inside(text, _BRACES)]
    return F.coalesce(*(F.try_parse_json(t) for t in tries))
