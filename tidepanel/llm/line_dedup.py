"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidepanel.llm.windows import remove_repeats

WINDOW = 3


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WINDOW) -> DataFrame:
    """``docs`` without the later occurrences of ``k`` consecutive lines.

    Lines are split at \\n and compared as they are, blank ones included.
    Windows overlap; each occurrence of a window but the first (by key, then by
    position in the text) covers its lines, and covered positions are merged
    before they are removed, so a run of repeated lines goes as a whole.  A
    window of blank lines alone doesn't count.  n_tokens (lines) and n_removed
    are added.

    A null text stays null (0 lines), an empty one is one blank line.  Texts of
    fewer than ``k`` lines lose nothing.  Keys are integers.  Rows that share key and position tie:
    none of them is later.  A row whose key is null covers nothing and loses
    nothing.  Other columns pass through.
    """
    return remove_repeats(docs, key, text, "line", k, True)
