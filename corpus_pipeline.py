"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each one's result as Parquet to the shared folder and rereads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.decontaminate import decontaminate
from tidepanel.llm.line_dedup import line_dedup
from tidepanel.llm.ngram_join import jaccard_components
from tidepanel.llm.pieces import encode
from tidepanel.llm.quality import quality_rules, train
from tidepanel.llm.store import written


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator uses, and which name each column has."""
    names = {c: f"own{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, all columns as they are.  The model is fitted on labelled rows of ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain, names = _plain(docs)
    model = train(docs.select("doc_id", "text"), labels)
    return quality_rules(plain, model, names["text"]).where("kept").select(*names.values()).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three consecutive lines removed, n_chars counted anew, other columns as they are; a document left with no word goes."""
    plain, names = _plain(docs)
    text = names["text"]
    done = line_dedup(plain, names["doc_id"], text)
    done = done.where((F.col("n_removed") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in names:
        done = done.withColumn(names["n_chars"], F.length(text).cast(docs.schema["n_chars"].dataType))
    return done.select(*names.values()).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest doc_id, missing ones last.

    Rows are told apart by doc_id and the text's hash: of rows that share both one
    stays, of a group's rows that share the smallest doc_id the one whose text's
    hash is smallest.  Texts meet the rows that go, which are the fewer.
    """
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    found = jaccard_components(docs.select(own.alias("row"), "text"), "row")
    stays = F.col("row") == F.col("component_id")
    rows = found.groupBy("row").agg(F.count("*").alias("n"), F.first(stays).alias("stays"))
    rows = written(rows.where("not stays or n > 1"), "rows")
    gone = rows.where("not stays").select("row.id", "row.h")
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["id"]) & (F.xxhash64(docs["text"]) == gone["h"]), "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]) if rows.where("stays").limit(1).count() else kept


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and ids of every document, and the text read back from them; the last stage, so other columns end here."""
    return encode(docs, decode=True).withColumnRenamed("decoded", "text")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", leaks),
    ("SentencePiece encoding and decoding", pieces),
]

#: near duplicates, approximate matches and sampled pieces have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
