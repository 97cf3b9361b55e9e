"""Top-k portfolio with a fixed number of swaps per day."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def topk_dropout(panel: DataFrame, topk: int = 50, n_drop: int = 5, score: str = "score", ret: str = "ret") -> DataFrame:
    """(date, n, bought, sold, ret) of an equally weighted portfolio.

    Each day the best ``n_drop`` names not held stand beside the held ones;
    held names among the ``n_drop`` worst of both go, and the best others fill up.
    The state runs from day to day, so one task walks the dates; what
    reaches it is cut down first to the names that can matter, a name being
    dropped once it is neither among the best ``topk + n_drop`` of its date nor
    ever was.
    """
    w = W.partitionBy("date").orderBy(F.desc(score), "instrument")
    p = panel.where(F.col(score).isNotNull()).select("instrument", "date", F.col(score).alias("score"), F.col(ret).alias("ret"))
    p = p.withColumn("place", F.row_number().over(w))
    names = p.where(F.col("place") <= topk + n_drop).select("instrument").distinct()
    p = p.join(names, "instrument", "left_semi")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        held: set = set()
        rows = []
        for day, d in pdf.sort_values(["date", "place"]).groupby("date", sort=True):
            order = d["instrument"].tolist()
            best = [i for i in order if i not in held]
            today = best[: n_drop + topk - len(held)]
            mine = [i for i in order if i in held]
            both = sorted([*mine, *today], key={i: k for k, i in enumerate(order)}.get)
            worst = set(both[len(both) - n_drop :]) if n_drop else set()
            sold = [i for i in mine if i in worst]
            buy = today[: len(sold) + topk - len(held)]
            held = (held - set(sold)) | set(buy)
            got = d[d["instrument"].isin(held)]["ret"]
            rows.append((day, len(held), len(buy), len(sold), float(got.mean()) if got.notna().any() else None))
        return pd.DataFrame(rows, columns=["date", "n", "bought", "sold", "ret"])

    return p.groupBy().applyInPandas(walk, "date date, n int, bought int, sold int, ret double")
