"""Sharding by sampled, size-weighted splitters (DataFrame functions only).

Rows are laid out in the order of (hash of the text, key), so equal texts are
neighbours.  A size-weighted sample of keys gives quantile boundaries, rows are
range-partitioned by them, exact sizes per range are taken, and ranges that
come out overfull are subdivided by a sample of their own.  Shards are then cut
from the exact running size along the ranges.

Groups of equal texts stay in one shard.  The large ones, of which there can be
only so many, are packed first, the largest into the emptiest shard, and the
rest of the layout fills what they leave; a large group that no shard has room
for is cut by key.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.llm.store import written

#: bytes that a row costs besides its text
ROW_BYTES = 16
#: rows drawn for each shard; with the number of shards, the bound of what the driver sorts
SAMPLES_PER_SHARD = 256
RANGES_PER_SHARD = 8
#: a group of equal texts over this part of a shard is packed by itself; the others may lie across a cut and go where their middle is
LARGE_GROUP = 0.02
_LOW = -(1 << 63)
_BITS = 12


def _draw(rows: DataFrame, wanted: int, total: int, seed: int) -> list[tuple[int, int, int]]:
    """(h, k, weight) of a systematic sample with chances in proportion to size; about ``wanted`` draws."""
    u = F.pmod(F.xxhash64("h", "k", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    weight = F.floor(F.col("size") * F.lit(wanted / total) + u).cast("long")
    drawn = rows.select("h", "k", weight.alias("w")).where("w > 0").groupBy("h", "k").agg(F.sum("w").alias("w"))
    return sorted((r["h"], r["k"], r["w"]) for r in drawn.collect())


def _quantiles(sample: list[tuple[int, int, int]], parts: int) -> list[tuple[int, int]]:
    """Boundaries that cut a sorted weighted sample into equal parts.

    A boundary moves to the start of its group of equal texts, unless the
    next or last boundary lies in that group too: then the group itself is cut.
    """
    weight, step, at, out = 0, sum(w for *_, w in sample) / parts, 1, []
    for h, k, w in sample:
        weight += w
        if weight >= at * step:
            at = int(weight // step) + 1
            out.append((h, k))
    hs = [h for h, _ in out]
    return sorted({(h, k) if hs.count(h) > 1 else (h, _LOW) for h, k in out})


def _ranges(bounds: list[tuple[int, int]]) -> list[dict]:
    edges = [(_LOW, _LOW), *(b for b in bounds if b != (_LOW, _LOW))]
    return [{"r": i, "lh": a[0], "lk": a[1], "hh": b[0], "hk": b[1], "last": b is None} if b else {"r": i, "lh": a[0], "lk": a[1], "hh": (1 << 63) - 1, "hk": (1 << 63) - 1, "last": True} for i, (a, b) in enumerate(zip(edges, [*edges[1:], None]))]


def _in_ranges(rows: DataFrame, ranges: list[dict]) -> DataFrame:
    """Add the range id r.  The ranges are a literal table of a bounded number of rows, joined by the top bits of h."""
    spark = rows.sparkSession
    kind = "array<struct<r int, lh long, lk long, hh long, hk long, last boolean, rows long, bytes long>>"
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(ranges)), kind)))
    top = lambda c: F.shiftright(F.col(c), 64 - _BITS)
    table = table.withColumn("b", F.explode(F.sequence(top("lh"), top("hh"))))
    h, k = F.col("h"), F.col("k")
    above = (h > F.col("lh")) | ((h == F.col("lh")) & (k >= F.col("lk")))
    below = F.col("last") | (h < F.col("hh")) | ((h == F.col("hh")) & (k < F.col("hk")))
    return rows.withColumn("b", top("h")).join(F.broadcast(table), "b").where(above & below).drop("b", "lh", "lk", "hh", "hk", "last")


def _laid_out(rows: DataFrame, n_shards: int, seed: int) -> tuple[DataFrame, int]:
    """(rows with rank, mid, group and group_mid, their bytes): place in the layout, running size at the row's and its group's middle."""
    all_bytes = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
    if not all_bytes:
        none = F.lit(None).cast("double")
        return rows.limit(0).select("*", F.lit(0).cast("long").alias("rank"), none.alias("mid"), none.alias("group_mid"), F.lit(0).cast("long").alias("group")), 0
    parts = n_shards * RANGES_PER_SHARD
    ranges = _ranges(_quantiles(_draw(rows, n_shards * SAMPLES_PER_SHARD, all_bytes, seed), parts))
    for again in range(1, 4):
        placed = _in_ranges(rows, ranges)
        held = {r["r"]: (r["rows"], r["bytes"]) for r in placed.groupBy("r").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()}
        over = [r["r"] for r in ranges if held.get(r["r"], (0, 0))[1] > 2 * all_bytes / parts]
        if not over or again == 3:
            break
        surplus = sum(held[r][1] for r in over)
        sample = _draw(placed.where(F.col("r").isin(over)), n_shards * SAMPLES_PER_SHARD, surplus, seed + again)
        more = _quantiles(sample, max(2, round(2 * parts * surplus / all_bytes)))
        old = [(r["lh"], r["lk"]) for r in ranges]
        if set(more) <= set(old):
            break
        ranges = _ranges(sorted({*old, *more}))
    before_rows = before_bytes = 0
    for r in ranges:
        n, b = held.get(r["r"], (0, 0))
        r |= {"rows": before_rows, "bytes": before_bytes}
        before_rows, before_bytes = before_rows + n, before_bytes + b

    order = W.partitionBy("r").orderBy("h", "k", "crc", "size")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    group_end = F.sum("size").over(W.partitionBy("r").orderBy("h"))
    group = F.sum("size").over(W.partitionBy("r", "h"))
    placed = _in_ranges(rows, ranges).select(
        *rows.columns,
        (F.col("rows") + F.row_number().over(order) - 1).cast("long").alias("rank"),
        (F.col("bytes") + F.sum("size").over(upto) - F.col("size") / 2).alias("mid"),
        (F.col("bytes") + group_end - group / 2).alias("group_mid"),
        group.alias("group"),
    )
    return placed, all_bytes


def pack(groups: list[tuple[int, int, int]], n_shards: int, room: float) -> tuple[dict[int, int], list[int]]:
    """(shard of each group that fits, bytes packed per shard) of (hash, bytes, rows): the largest first, each into the emptiest shard."""
    load, home = [(0, s) for s in range(n_shards)], {}
    for h, size, _ in sorted(groups, key=lambda g: (-g[1], g[0])):
        least, s = load[0]
        if least + size <= room:
            home[h] = s
            heapq.heapreplace(load, (least + size, s))
    return home, [b for b, _ in sorted(load, key=lambda x: x[1])]


def shard_by_size(docs: DataFrame, n_shards: int = 40, key: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row.

    ``size`` is the UTF-8 length of the text plus 16, and shards come out with
    nearly equal sums of it (law ``bytes``): a cut is off by at most
    half of the row or of the group of equal texts, up to 2 % of a shard, that
    lies on it.  Larger groups of equal texts, fewer than 50 a shard, are packed
    whole, the largest first into the emptiest shard; one that finds no room,
    as any larger than a shard, is cut by key.  Slots count from 0 without gaps.

    A null text has size 16, crc 0 and forms one group with the empty text's
    neighbours only by hash; a null key sorts first within its group; keys that
    aren't integers are ordered by their hash; repeated rows each get a slot, but
    no boundary can part rows that share both text and key; an empty table gives an empty table; fewer rows than shards leave shards
    empty.  Other columns of ``docs`` play no part.
    """
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long")
    whole_number = docs.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    rows = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(key).cast("long") if whole_number else F.when(F.col(key).isNotNull(), F.xxhash64(key)), F.lit(_LOW)).alias("k"),
        F.xxhash64(text).alias("h"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        crc.alias("crc"),
    )
    rows = written(rows, "sizes")
    out = [F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    all_bytes = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
    room = all_bytes / n_shards
    # fewer than n_shards / LARGE_GROUP groups can be so large
    large = rows.groupBy("h").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where(F.col("b") > F.lit(LARGE_GROUP * room)).where("n > 1").collect()
    home, packed = pack([(r["h"], r["b"], r["n"]) for r in large], n_shards, room)
    first, told = [0] * n_shards, []
    for r in sorted(large, key=lambda r: r["h"]):
        if r["h"] in home:
            s = home[r["h"]]
            told.append({"h": r["h"], "shard": s, "base": first[s]})
            first[s] += r["n"]
    table = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(told)), "array<struct<h long, shard int, base long>>")))
    done = []
    if told:
        own, _ = _laid_out(rows.join(F.broadcast(table.select("h")), "h", "left_semi"), n_shards, seed)
        own = written(own.select("key", "size", "crc", "h", "rank"), "packed")
        start = own.groupBy("h").agg(F.min("rank").alias("start")).join(F.broadcast(table), "h")  # a row for each packed group
        done.append(own.join(F.broadcast(start), "h").select("key", "size", "crc", "shard", (F.col("base") + F.col("rank") - F.col("start")).alias("slot")))
        rows = rows.join(F.broadcast(table.select("h")), "h", "left_anti")
    placed, _ = _laid_out(rows, n_shards, seed)
    mid = F.when(F.col("group") <= F.lit(LARGE_GROUP * room), F.col("group_mid")).otherwise(F.col("mid"))
    ends, total = [], 0.0
    for b in packed:
        total += room - b
        ends.append(total)
    bounds = F.array(*(F.lit(float(e)) for e in ends[:-1])) if n_shards > 1 else F.array().cast("array<double>")
    shard = F.size(F.filter(bounds, lambda e: e <= F.col("mid_"))).cast("int")
    placed = written(placed.withColumn("mid_", mid).select("key", "size", "crc", "rank", shard.alias("shard")), "shards")
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # a row for each shard
    base = F.array(*map(F.lit, first))[F.col("shard")]
    done.append(placed.join(F.broadcast(firsts), "shard").select("key", "size", "crc", "shard", (base + F.col("rank") - F.col("first")).alias("slot")))
    both = done[0] if len(done) == 1 else done[0].unionByName(done[1])
    return both.select(*out)
