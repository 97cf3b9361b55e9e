"""Sharding and quality rules."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import quality
from tidepanel.llm.sharding import pack, shard_by_size

DATA = "/root/testdata"


def shards(df, n=40):
    return [r.asDict() for r in shard_by_size(df, n).collect()]


def test_shards_are_even_and_slots_gapless(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = shards(docs)
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        t = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 16, zlib.crc32(t), "bytes", None)
        by.setdefault(r["shard"], []).append(r)
    assert set(by) == set(range(40))
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by.values())
    mean, largest = sum(r["size"] for r in rows) / 40, max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in own) - mean) <= largest + 0.02 * mean for own in by.values())


def test_a_group_that_holds_most_rows_is_cut(spark):
    rows = [(i, "hot text") for i in range(3000)] + [(3000 + i, f"other {i}") for i in range(3000)] + [(None, None), (None, ""), (7, "hot text")]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, shard int, h int")
    got = shards(df, 10)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 10
    assert len(got) == len(rows) and len(sizes) == 10 and max(sizes.values()) < 1.03 * mean and min(sizes.values()) > 0.97 * mean
    assert shards(df.limit(0)) == []
    assert len(shards(df.limit(1))) == 1
    named = df.select(F.concat(F.lit("k"), "doc_id").alias("doc_id"), "text")
    assert len(shards(named, 10)) == len(rows)


def test_groups_of_equal_texts_stay_whole(spark):
    """Groups on both sides of the packing bound and up to a shard are in one shard, against a plain packing."""
    r = random.Random(3)
    rows, n = [], 0
    for size, copies in ((400, 60), (300, 40), (500, 20), (90, 3), (80, 2), (700, 1), (100, 30), (2000, 11)):
        text = f"{size} {copies} " + "x" * size
        rows += [(n + i, text) for i in range(copies)]
        n += copies
    rows += [(n + i, f"{i} " + "y" * r.randint(1, 200)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shards(df, 8)
    by, sizes, slots = {}, Counter(), {}
    for x in got:
        by.setdefault(rows[x["doc_id"]][1], set()).add(x["shard"])
        sizes[x["shard"]] += x["size"]
        slots.setdefault(x["shard"], []).append(x["slot"])
    mean = sum(len(t.encode()) + 16 for _, t in rows) / 8
    assert sum(sizes.values()) == 8 * mean and len(got) == len(rows)
    assert all(len(s) == 1 for s in by.values())
    assert all(abs(v - mean) <= 0.02 * mean + 220 for v in sizes.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    home, load = pack([(1, 60, 2), (2, 50, 2), (3, 45, 3), (4, 40, 2), (5, 300, 9)], 2, 100)
    assert home == {1: 0, 2: 1, 3: 1, 4: 0} and load == [100, 95]


def test_counts_match_plain_python():
    import pyarrow as pa

    from tidepanel.llm import scan

    r = random.Random(4)
    texts = ["".join(r.choice(["a", "b", "é", " ", " ", "\n", "#", "|", "\t"]) for _ in range(r.randint(0, 200))) for _ in range(300)] + [None, "", "\n\n", "x " * 5000]
    buf, offsets = scan.text_bytes(pa.array(texts))
    c = quality.base_counts(buf, offsets, np.array([t is not None for t in texts]))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        three = Counter(zip(w, w[1:], w[2:]))
        cover = {j + k for j in range(len(w) - 2) if three[tuple(w[j : j + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        got = {k: int(v[i]) for k, v in c.items()}
        assert got == {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(x in "#*$%&|<>" for x in t or ""), "n_dup_lines": dup, "n_repeat_words": len(cover)}


def test_the_model_holds_on_unseen_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet"), spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    model = quality.train(docs, labels, max_train=1500)
    seen = labels.where("quality is not null").withColumn("r", F.xxhash64("doc_id")).orderBy("r", "doc_id", "quality").limit(1500).select("doc_id")
    unseen = labels.join(seen, "doc_id", "left_anti")
    got = quality.quality_rules(docs.select("doc_id", "text"), model).join(unseen, "doc_id").select("quality", "probability", "base_failed", "kept").collect()
    assert 2000 < len(got) <= 3980 - 1500
    # rows that the base rules leave to the model
    left = [r for r in got if not r.base_failed]
    good = [r for r in left if r.quality == 1]
    assert sum((r.probability >= 0.5) == (r.quality == 1) for r in left) / len(left) > 0.98 and sum(r.kept for r in good) / len(good) > 0.98
    bad = [r for r in got if r.quality == 0]
    assert len(bad) > 300 and sum(not r.kept for r in bad) / len(bad) > 0.98
    # probabilities are calibrated: they sum to what was found
    assert abs(sum(r.probability for r in left) - len(good)) / len(left) < 0.02


def test_labels_that_disagree_or_repeat(spark):
    df = spark.createDataFrame([(i, ("good words %d " if i % 2 else "junk #### %d ") % i * 30) for i in range(60)], "doc_id long, text string")
    told = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(i, 1 - i % 2) for i in range(4)] + [(5, 1)] * 3 + [(None, 1), (7, None), (999, 1)], "doc_id long, quality int")
    model = quality.train(df, told)
    got = {r.doc_id: r.probability for r in quality.quality_rules(df, model).collect()}
    assert len(got) == 60 and min(got[i] for i in range(5, 60, 2)) > max(got[i] for i in range(4, 60, 2))


def test_without_labels_the_rules_decide(spark):
    rows = [(1, "a b " * 3), (2, None), (3, ""), (None, " ".join("w%d" % i for i in range(80))), (5, "same words here " * 40)]
    df = spark.createDataFrame([(k, t, True) for k, t in rows], "doc_id long, text string, kept boolean")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(df, none)
    assert model is None and quality.train(df, spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")) is None
    got = {r.doc_id: (r.base_failed, r.kept, r.probability) for r in quality.quality_rules(df, model).collect()}
    assert got == {1: (True, False, None), 2: (True, False, None), 3: (True, False, None), None: (False, True, None), 5: (True, False, None)}
    assert quality.quality_rules(df.limit(0), None).count() == 0


@pytest.mark.parametrize("y", [np.zeros(40), np.ones(40)])
def test_one_class_gives_no_model(y):
    assert quality.fit([(np.array([1], np.int32).tobytes(), np.array([1.0], np.float32).tobytes())] * 40, y) is None
