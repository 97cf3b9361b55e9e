"""Ranked lexical search over term-bucketed postings.

The index is a DataFrame of postings (term, document, occurrences, length),
written in buckets of terms and sorted by term, so that a search reads only the
buckets of its terms.  A search joins the items' terms to them, scores each
match in whole numbers, sums by item and document, and ranks by a window.

Documents are dealt to slices by row before scoring: all matches of a
document meet in one task, so matches themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidepanel.llm import scan
from tidepanel.llm.store import slim_batches, written

#: buckets of terms, by the top bits of a term's hash
BUCKET_BITS = 4
#: terms of items that are joined at a time; each block of items is a broadcast of at most so many rows of 24 bytes
BLOCK_TERMS = 1 << 20
#: postings that meet in a slice
SLICE_ROWS = 1 << 18
#: weights of the score, fixed values
_SATURATION, _LENGTH_SHARE = 8, 75

_GAP = np.zeros(256, bool)
_GAP[:128] = True
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

_POSTINGS = "term long, tf int, n int"


def _term_counts(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, occurrences) sorted by term and row, and each row's number of terms."""
    buf, offsets = scan.text_bytes(texts)
    starts, ends, first = scan.spans(buf, offsets, _GAP)
    term = scan.token_hash(scan.LOWER[buf], starts, ends).view(np.int64)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    order = np.argsort(term, kind="stable")
    term, row = term[order], row[order]
    head = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (row[1:] != row[:-1]))) if len(term) else np.zeros(0, np.int64)
    return term[head], row[head], np.diff(np.append(head, len(term))), n


def _postings(rows: DataFrame, keys: list[str], lengths: bool) -> DataFrame:
    """(keys, term, tf, n) of each term of each row; with ``lengths`` a row without term for each row as well."""
    schema = T.StructType([rows.schema[k] for k in keys] + T._parse_datatype_string(_POSTINGS).fields)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in scan.super_batches(batches, "text", 4 << 20):
            term, row, tf, n = _term_counts(table["text"])
            own = [table[k].combine_chunks() for k in keys]
            cols = [*(c.take(pa.array(row)) for c in own), pa.array(term), pa.array(tf, pa.int32()), pa.array(n[row], pa.int32())]
            names = [*keys, "term", "tf", "n"]
            if lengths:
                yield from pa.table([*own, pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int32()), pa.array(n, pa.int32())], names).to_batches()
            yield from pa.table(cols, names).to_batches(1 << 16)

    return rows.select(*keys, "text").mapInArrow(go, schema)


def _bucket(term: str) -> Column:
    return F.shiftright(term, 64 - BUCKET_BITS).cast("int") + F.lit(1 << (BUCKET_BITS - 1))


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the postings of all documents under ``path`` and give the index read from there: one folder for each bucket of terms; -1 holds the documents' lengths.

    Written in one pass and without a shuffle: each task sorts its own postings
    by bucket and term.  A term that every document holds is spread over all
    tasks' files.
    """
    slim_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    told = _postings(rows, ["row", "key"], True).withColumn("bucket", F.coalesce(_bucket("term"), F.lit(-1)))
    told.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(told.schema).parquet(path)


def _ranked(index: DataFrame, asked: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The best documents of one block of items; ``asked`` has their terms."""
    spark = index.sparkSession
    # one item with more terms than a block has is joined as Spark sees fit
    small = F.broadcast if asked.count() <= 2 * BLOCK_TERMS else lambda t: t
    buckets = [r["bucket"] for r in asked.select(_bucket("term").alias("bucket")).distinct().collect()]  # 2 ** BUCKET_BITS at most
    hits = index.where(F.col("bucket").isin(buckets))
    df = hits.join(small(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    df = written(df, "df")
    weight = F.floor(F.lit(1000) * F.ln(F.lit(2.0 * n_docs + 2) / (F.lit(2.0) * F.col("df") + F.lit(1.0)))).cast("long")
    weighed = asked.join(df, "term").select("item", "term", (F.col("k") * weight).alias("w"), "df").where("w > 0")  # a term of weight 0 adds nothing
    weighed = written(weighed, "weights")
    n_hits = weighed.dropDuplicates(["term"]).agg(F.sum("df").alias("n")).first()["n"] or 0
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_hits // SLICE_ROWS))
    hits = hits.join(small(weighed.select("term").distinct()), "term", "left_semi").select("row", "key", "term", "tf", "n").repartition(slices, "row")
    m = F.expr(f"{100 - _LENGTH_SHARE} + (({_LENGTH_SHARE}L * n * {n_docs}L) div {max(n_terms, 1)}L)")
    part = F.expr(f"(1000000000L * tf) div (1000L * tf + {_SATURATION}L * m)")
    scored = hits.withColumn("m", m).withColumn("part", part).join(small(weighed.select("item", "term", "w")), "term")
    scored = scored.groupBy("row", "key", "item").agg(F.sum(F.col("w") * F.col("part")).alias("score")).where("score > 0")
    best = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc(), F.col("row").asc())
    return scored.select("item", "key", "score", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text", doc_key: str = "doc_id") -> DataFrame:
    """(item key, rank, document key, score): the ``k`` best documents of each item with a score above 0, best first, ties by ascending document key.

    A term's weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))`` over the N documents that hold any term; a match
    scores ``weight * ((10^9 tf) div (1000 tf + 8 m))``, where m grows with the document's
    number of terms over the mean; the item's terms count with their repeats.

    A null or empty text has no terms: as a document it isn't counted, as an item it
    finds nothing and has no row.  Rows that share an item key are one item of
    all their terms; repeated documents are documents of their own, each with its rank; a null
    document key comes first among ties.  An empty index or no items give an
    empty table; other columns play no part.  Terms are equal as surely as 64-bit hashes are.
    """
    stats = index.where("bucket = -1").agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    asked = _postings(items.select(F.col(key).alias("item"), F.col(text).alias("text")), ["item"], False)
    asked = written(asked.groupBy("item", "term").agg(F.sum("tf").alias("k")), "asked")
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    found = [_ranked(index, asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), stats["docs"], stats["terms"], k) for b in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("item").alias(key), "rank", F.col("key").alias(doc_key), "score")
