"""Rolling statistics with half-life weights, as differences of running sums.

A row's weight is 2 ** (row number / half-life): only ratios enter the
results, so no weight has to be counted back from the current row.  Row numbers
are taken within stretches short enough for doubles.  A window's sum is the running
sum at its end less the one before its start, so the cost is that of the rows,
whatever the window's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: largest exponent of 2 that a stretch of rows may reach
_REACH = 480


def _own():
    """Rows of one instrument by date."""
    return W.partitionBy("instrument").orderBy("date")


def _numbered(panel: DataFrame, half_life: float, window: int) -> tuple[DataFrame, Column]:
    """Panel with the row number rn, the stretch st and the weight pw in it, and the factor between a stretch and the one before.

    Weights restart every ``stretch`` rows, and a frame of ``window`` rows
    spans two stretches at most.
    """
    stretch = max(window, int(_REACH * half_life))
    p = panel.withColumn("rn", F.row_number().over(_own())).withColumn("st", F.floor((F.col("rn") - 1) / stretch))
    return p.withColumn("pw", F.pow(F.lit(2.0), F.pmod(F.col("rn") - 1, F.lit(stretch)) / half_life)), F.pow(F.lit(2.0), F.lit(-stretch / half_life))


def _sums(p: DataFrame, weighted: dict[str, Column], plain: dict[str, Column], window: int, older: Column) -> DataFrame:
    """``p`` with the sums of terms over the last ``window`` rows, those of ``weighted`` in the current stretch's scale; missing terms count as 0, a sum of none is NULL.

    Within a stretch a sum is a difference of running sums; where the window
    began in the stretch before, that one's rest from there on is put to it.
    """
    run = W.partitionBy("instrument", "st").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("instrument", "st")
    terms = {**{k: v * F.col("pw") for k, v in weighted.items()}, **plain}
    zero = F.lit(0.0)
    flows = {**{k: F.coalesce(v.cast("double"), zero) for k, v in terms.items()}, **{f"{k}_n": v.isNotNull().cast("double") for k, v in terms.items()}}
    p = p.select("*", *(v.alias(f"v_{k}") for k, v in flows.items()))
    p = p.select("*", *(F.sum(f"v_{k}").over(run).alias(f"r_{k}") for k in flows), *(F.sum(f"v_{k}").over(whole).alias(f"t_{k}") for k in flows))
    before = lambda c: F.lag(c, window).over(_own())
    p = p.select("*", before("st").alias("st_b"), *(before(f"r_{k}").alias(f"b_{k}") for k in flows), *(before(f"t_{k}").alias(f"e_{k}") for k in flows))

    def total(k: str) -> Column:
        rest = F.col(f"e_{k}") - F.col(f"b_{k}")
        apart = F.col(f"r_{k}") + (rest * older if k in weighted else rest)
        return F.when(F.col("st_b").isNull(), F.col(f"r_{k}")).when(F.col("st_b") == F.col("st"), F.col(f"r_{k}") - F.col(f"b_{k}")).otherwise(apart)

    kept = [c for c in p.columns if c[:2] not in ("v_", "r_", "t_", "b_", "e_") and c != "st_b"]
    return p.select(*kept, *(F.when(total(f"{k}_n") > 0.5, total(k)).alias(k) for k in terms))


def half_life_stats(panel: DataFrame, value: str, window: int, half_life: float) -> DataFrame:
    """``panel`` with weighted_mean and weighted_std (population) over full windows; weights are shared among present values."""
    p, older = _numbered(panel, half_life, window)
    x = F.col(value)
    p = _sums(p, {"sw": F.when(x.isNotNull(), F.lit(1.0)), "sx": x, "sxx": x * x}, {}, window, older)
    mean = F.try_divide("sx", "sw")
    full = F.col("rn") >= window
    std = F.sqrt(F.greatest(F.try_divide("sxx", "sw") - mean * mean, F.lit(0.0)))
    return p.select(*panel.columns, F.when(full, mean).alias("weighted_mean"), F.when(full & F.col("sw").isNotNull(), std).alias("weighted_std"))


def rolling_regression(panel: DataFrame, y: str, x: str, window: int, half_life: float, min_valid: float = 0.8) -> DataFrame:
    """``panel`` with beta, alpha (half-life weighted) and sigma (plain deviation of the residuals, ddof 1).

    NULL before the window is full or where fewer than ``min_valid`` of it has both values.
    """
    p, older = _numbered(panel, half_life, window)
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    p = p.withColumn("xx", F.when(both, F.col(x))).withColumn("yy", F.when(both, F.col(y)))
    u, v = F.col("xx"), F.col("yy")
    weighted = {"sw": F.when(both, F.lit(1.0)), "swx": u, "swy": v, "swxx": u * u, "swxy": u * v}
    plain = {"n": F.when(both, F.lit(1.0)), "sx": u, "sy": v, "sxx": u * u, "sxy": u * v, "syy": v * v}
    p = _sums(p, weighted, plain, window, older)
    c = F.col
    p = p.withColumn("b", F.try_divide(c("sw") * c("swxy") - c("swx") * c("swy"), c("sw") * c("swxx") - c("swx") * c("swx")))
    p = p.withColumn("a", F.try_divide(c("swy") - c("b") * c("swx"), c("sw")))
    left = c("sy") - c("b") * c("sx")
    rest = c("syy") - 2 * c("b") * c("sxy") + c("b") * c("b") * c("sxx") - F.try_divide(left * left, c("n"))
    ok = (c("rn") >= window) & (c("n") >= min_valid * window)
    sigma = F.sqrt(F.greatest(F.try_divide(rest, c("n") - 1), F.lit(0.0)))
    return p.select(*panel.columns, F.when(ok, c("b")).alias("beta"), F.when(ok, c("a")).alias("alpha"), F.when(ok & c("b").isNotNull(), sigma).alias("sigma"))


def cumulative_range(panel: DataFrame, log_return: str, periods: int = 12, rows: int = 21, min_valid: int | None = None) -> DataFrame:
    """``panel`` with cmra: range of the cumulative log return at the ends of ``periods`` periods of ``rows`` rows.

    The window has ``periods * rows`` rows.  With ``min_valid`` so many returns
    in it are enough, and a shorter window starts at the instrument's first row;
    without, it must be full.
    """
    p = panel.withColumn("p", F.sum(F.coalesce(F.col(log_return), F.lit(0.0))).over(_own().rowsBetween(W.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(_own()))
    n = periods * rows
    upto = _own().rowsBetween(W.unboundedPreceding, 0)
    ends = []
    for j in range(1, periods + 1):
        full = F.lag("p", n - rows * j).over(_own()) if j < periods else F.col("p")
        short = F.coalesce(F.max(F.when(F.col("rn") == rows * j, F.col("p"))).over(upto), F.col("p"))
        ends.append(full if min_valid is None else F.when(F.col("rn") >= n, full).otherwise(short))
    enough = F.col("rn") >= n if min_valid is None else F.count(log_return).over(_own().rowsBetween(-(n - 1), 0)) >= min_valid
    p = p.withColumn("ends", F.array(*ends)).withColumn("enough", enough)
    return p.select(*panel.columns, F.when(F.col("enough"), F.array_max("ends") - F.array_min("ends")).alias("cmra"))


def liquidity(value: str, window: int, per: int, min_valid: float = 0.8) -> Column:
    """Log of the sum per period of ``per`` rows over the last ``window`` rows; NULL below ``min_valid`` of them."""
    w = _own().rowsBetween(-(window - 1), 0)
    total, n = F.sum(value).over(w), F.count(value).over(w)
    return F.when((n >= min_valid * window) & (total > 0), F.ln(F.try_divide(total, n / per)))
