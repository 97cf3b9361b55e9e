"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.store import dropped, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component.

    Edges are undirected, nodes of any orderable type.  Each round links every
    node's neighbours to the smallest of them (large star, then small star), so
    the depth falls by about half per round.  Rounds are written to the shared
    folder, the last one stays there; only one row count per round reaches the driver.  Minima are
    combined before the shuffle and a hub's edges may be split by adaptive
    execution, so a component of any size is no single task's work.
    """
    cur = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct().persist()  # read twice within the round; worked out again where an executor is lost
        low = large.groupBy("u").agg(F.min("v").alias("m"))  # here v < u throughout
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("y")), F.struct(F.col("v").alias("x"), F.col("m").alias("y")))).alias("e"))
        nxt = written(small.select(F.col("e.x").alias("u"), F.col("e.y").alias("v")).where("u <> v").distinct(), "edges")
        large.unpersist()
        state = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        dropped(cur)
        cur = nxt
        if (state["n"], state["h"]) == before:
            break
        before = (state["n"], state["h"])
    else:
        raise RuntimeError("components did not settle")
    roots = cur.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionAll(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
