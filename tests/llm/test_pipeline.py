"""The corpus pipeline against a plain version, the effect of its stages, and its odd inputs."""

import random
import re

import corpus_pipeline as cp
from tests.llm.test_dedup import WORD, brute_components, brute_windows

DATA = "/root/testdata"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    at, kept = docs, {}
    for name, stage in cp.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, f"{DATA}/sf0.01").collect(), docs.schema)
        assert at.columns == docs.columns
        kept[name] = {r.doc_id: r for r in at.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").collect()}
    first = kept["quality rules"]
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in first for d in good) / len(good) > 0.9 and not any(labels.get(d) == 0 for d in first)
    assert all(r.n_chars == len(r.text) for r in kept["line dedup"].values())
    last = cp.STAGES[-1][1](spark, at, "")
    assert {r.doc_id: r.text for r in last.collect()} == {d: r.text for d, r in kept["benchmark decontamination"].items()}
    run = cp.run(spark, f"{DATA}/sf0.01")
    assert {r.doc_id for r in run.collect()} == set(kept["benchmark decontamination"])


def test_odd_rows(spark):
    schema = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").schema
    words = lambda n: " ".join("w%d" % (i * n) for i in range(1, 90))
    rows = [(1, words(3), None, None, None), (1, words(3), None, None, None), (2, words(3), "en", "s", 3), (3, None, "en", "s", 1), (4, "", "en", "s", 0), (None, words(7), "en", "s", 5)]
    docs = spark.createDataFrame(rows, schema)
    at = docs
    for _, stage in cp.STAGES[1:4]:
        at = spark.createDataFrame(stage(spark, at, f"{DATA}/sf0.001").collect(), schema)
    assert sorted((r.doc_id for r in at.collect()), key=str) == [1, 3, 4, None]
    for _, stage in cp.STAGES[:4]:
        assert stage(spark, docs.limit(0), f"{DATA}/sf0.001").count() == 0


def test_one_id_with_two_texts(spark):
    """A near copy goes though its id has another text too, and of one id's near copies one stays."""
    text = lambda k: " ".join("w%d" % (i * k) for i in range(1, 90))
    rows = [(1, text(3) + " x"), (5, text(3)), (5, text(7)), (9, text(11)), (9, text(11) + " y"), (None, text(13)), (None, text(13) + " z"), (2, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = cp.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 2, 2, 5, 9, None]
    assert {r.text for r in got if r.doc_id in (1, 5)} == {text(3) + " x", text(7)}


def plain_run(docs, items):
    """(doc_id, text) that the five stages leave, without labels: rules, three-line windows, near copies, leaks, round trip."""
    kept = []
    for k, t in docs:
        w = re.findall(WORD, t)
        three = list(zip(w, w[1:], w[2:]))
        cover = {i + j for i, g in enumerate(three) if three.count(g) > 1 for j in range(3)}
        if len(w) >= 50 and 100 * len(cover) <= 50 * len(w):
            kept.append((k, t))
    done = {k: (x, n) for k, _, n, x in brute_windows(kept, lambda t: t.split("\n"), 3, True)}
    kept = [(k, "\n".join(done[k][0])) for k, _ in kept if not done[k][1] or re.search(WORD, "\n".join(done[k][0]))]
    group = {k: root for k, _, root in brute_components(kept)}
    kept = [(k, t) for k, t in kept if group[k] == k]
    plain = lambda s: re.sub(r"[ \t-\r]", " ", s.lower())
    return sorted((k, t) for k, t in kept if not any(plain(i) in plain(t) for i in items))


def test_run_matches_a_plain_version(spark, tmp_path):
    r = random.Random(17)
    words = ["w%d" % i for i in range(900)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [prose(30) for _ in range(3)]
    passage = "\n".join(prose(9) for _ in range(4))
    docs = []
    for i in range(90):
        kind = r.random()
        if docs and kind < 0.25:  # a near copy
            w = r.choice(docs)[1].split(" ")
            w[r.randrange(len(w))] = r.choice(words)
            docs.append((i, " ".join(w)))
        elif kind < 0.4:
            docs.append((i, prose(40) + "\n" + passage + "\n" + prose(40)))
        elif kind < 0.5:
            docs.append((i, prose(30) + " " + r.choice(items) + " " + prose(30)))
        elif kind < 0.6:
            docs.append((i, r.choice([prose(20), "same words again " * 60, passage])))
        else:
            docs.append((i, "\n".join(prose(r.randint(5, 12)) for _ in range(r.randint(6, 14)))))
    at = str(tmp_path)
    schema = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").schema
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in docs], schema).repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    want = plain_run(docs, items)
    assert 30 < len(want) < 80 and sorted((x.doc_id, x.text) for x in cp.run(spark, at).collect()) == want


def test_columns_of_the_operators_names_stay(spark):
    text = lambda k: " ".join("w%d" % (i * k) for i in range(1, 80))
    rows = [(k, text(k), "mine", 0.25, 7, 8, "i", False, "c") for k in (3, 5, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, probability double, n_words int, n_tokens int, id string, base_failed boolean, own0 string")
    at = docs
    for _, stage in cp.STAGES[:4]:
        at = stage(spark, at, f"{DATA}/sf0.001")
        assert at.columns == docs.columns and at.schema == docs.schema
        at = spark.createDataFrame(at.collect(), docs.schema)
    assert sorted(map(tuple, at.collect())) == rows
