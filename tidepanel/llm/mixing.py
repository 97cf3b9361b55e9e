"""Mixing of sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, up to three times
over.  A document's virtual finish time is the words its source has sent up to
its end, divided by the source's target.  All queues together are sorted by
finish time across the cluster and cut where the running number of words
reaches the budget, so every prefix of the mix is near its weights too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.llm.store import written

#: a source is repeated so often at most
MOST_TIMES = 3
#: rows to a range of the running sums
RANGE_ROWS = 1 << 16
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], budget: float, most: int = MOST_TIMES) -> list[float]:
    """Words for each source in proportion to its weight; none has more than ``most`` times its size, what is over goes to the others by weight."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(budget)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        for i in full or open_:
            out[i] = float(most * sizes[i]) if full else left * weights[i] / weight
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def _running(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Write the rows in the order of columns that no two share, with ``total``: the running sum of ``value`` up to each.

    The sort is one range partitioning over the cluster; each range is summed by
    itself and starts at the sum of those before it.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    rows = written(rows.repartitionByRange(n, *order).withColumn("range_", F.spark_partition_id()), name)
    before = W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("range_").agg(F.sum(value).alias("sum_"))  # a row for each range
    sums = sums.select("range_", F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("before_"))
    inner = W.partitionBy("range_").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.join(sums, "range_").withColumn("total", F.col("before_") + F.sum(value).over(inner)).drop("range_", "before_")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = MOST_TIMES, seed: int = 11) -> DataFrame:
    """(key, source, size, source_size, target, times, taken, first_place) of every row.

    ``size`` is the row's number of words.  Sources in code point order, null as
    one source at the end, weigh ``weights``, repeating, and share ``share``
    of all words; ``taken`` is how many words of the row the mix takes, its repeats
    counted, whole documents only, ``times`` how often, and ``first_place`` the
    words of the mix before it first (null if never).  The number of
    sources is taken to be such that a row for each fits the driver.

    A null text or one without words has size 0 and is taken for nothing; a null
    key is a key like another; repeated rows are rows of their own; order hangs on
    (seed, key, text) alone, so reruns agree; rows that share key and text
    are alike.  An empty table gives an empty table; other columns play no part.
    A source's words are off its target by one document or two at most.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")
    sizes = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words.alias("size"), F.xxhash64(key, text, F.lit(seed)).alias("h"), F.monotonically_increasing_id().alias("row"))
    sizes = written(sizes, "sizes")

    found = sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()  # a row for each source
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    n = [r["n"] for r in found]
    budget = round(share * sum(n))
    aim = targets(n, [weights[i % len(weights)] for i in range(len(n))], share * sum(n), most)
    told = [(r["source"], i, s, sum(n[:i]), t) for i, (r, s, t) in enumerate(zip(found, n, aim))]
    table = F.broadcast(spark.createDataFrame(told, "name string, queue int, source_size long, ahead long, target double"))
    rows = sizes.join(table, F.col("source").eqNullSafe(F.col("name"))).drop("name")

    # each queue's documents in shuffled order, time after time
    queue = rows.where("size > 0 and target > 0").select("row", "queue", "size", "source_size", "ahead", "target", "h")
    queue = _running(queue, ["queue", "h", "row"], "size", "queues")
    turns = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("turn")
    queue = queue.select("row", "queue", "size", "h", turns, "source_size", "target", (F.col("total") - F.col("ahead")).alias("upto"))
    finish = ((F.col("turn") * F.col("source_size") + F.col("upto")) / F.col("target")).alias("finish")
    sent = _running(queue.select("row", "queue", "size", "turn", finish), ["finish", "queue", "turn", "row"], "size", "mix")
    sent = sent.where(F.col("total") <= F.lit(budget)).groupBy("row").agg(F.count("*").alias("times"), F.min(F.col("total") - F.col("size")).alias("first_place"))
    times = F.coalesce("times", F.lit(0))
    return rows.join(sent, "row", "left").select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", times.alias("times"), (times * F.col("size")).cast("long").alias("taken"), "first_place")
