"""Tokenizer alignment, ranked search and mixing against plain Python, with the odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidepanel.llm import alignment, lexical, mixing, registry
from tidepanel.llm.store import fresh_path

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
DOCS = "doc_id long, text string, source string, batch string, n long, term string"


@pytest.fixture(scope="module")
def plain_tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.TOKENIZER_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.MODEL_B)
    with open(alignment.TOKENIZER_A, encoding="utf-8") as f, open(alignment.MODEL_B, "rb") as g:
        enc = alignment.Encoders(f.read(), g.read())
    said_a, said_b = enc.bytes_a.to_pylist(), enc.bytes_b.to_pylist()

    def go(text):
        """(A's ids, B's ids, groups) by walking along both lists; None without tokens."""
        if not text:
            return None
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if not b"".join(said_a[i] for i in x) == (" " + text).encode() == b"".join(said_b[i] for i in y):
            return None
        groups, at_a, at_b, i, j = [], 0, 0, 0, 0
        while i < len(x):
            own_a, own_b = [x[i]], [y[j]]
            at_a, at_b, i, j = at_a + len(said_a[x[i]]), at_b + len(said_b[y[j]]), i + 1, j + 1
            while at_a != at_b:
                if at_a < at_b:
                    own_a.append(x[i])
                    at_a, i = at_a + len(said_a[x[i]]), i + 1
                else:
                    own_b.append(y[j])
                    at_b, j = at_b + len(said_b[y[j]]), j + 1
            groups.append((own_a, own_b))
        return x, y, groups

    return enc, go


def plain_alignment(go, texts):
    done = [go(t) for t in texts]
    count = Counter((a[-1], b[-1]) for d in done if d for a, b in d[2])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for d in done:
        links = [(a[-1], b[-1]) for a, b in d[2]] if d else []
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in d[2]) if d else ""
        sizes = (len(d[0]), len(d[1]), len(links), len(links)) if d else (0, 0, 0, 0)
        out.append((*sizes, sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(told.encode()).hexdigest() if d else ""))
    return out


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_query(spark, plain_tokens):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r[c] for c in ALIGNED) for r in registry.queries()["op11_tokenizer_alignment"](spark, SF).collect()}
    assert got == dict(zip([d.doc_id for d in docs], plain_alignment(plain_tokens[1], [d.text for d in docs])))


def test_segments_of_odd_texts(plain_tokens):
    """Cutting texts at blanks never changes a token: any mixture of blanks, marks, line ends and scripts."""
    enc, go = plain_tokens
    r = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "　", " ", "▁", "<s>", "<|endoftext|>", "<0x41>", "'s", " 're", "12", "...", "\x00", "\x1c", "\x85", " ", "日本", "🙂", "é", " ́", "\r\n", "Straße", "​", "﻿", "don't", "<unk>", " ("]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)] + ["", None, " ", "  ", "a ", "▁"]
    columns, _, _ = alignment.align_batch(enc, pa.chunked_array([pa.array(texts)]), True)
    for i, t in enumerate(texts):
        want = go(t)
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want[2]) if want else ""
        assert columns["groups"][i].as_py() == told, repr(t)


def test_boundaries_by_brute_force():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 30)
        a, b = (np.array(sorted({*r.sample(range(1, n + 1), r.randint(0, n)), n})) for _ in range(2))
        assert b[alignment.boundaries(a, b)].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_alignment_of_odd_rows(spark, plain_tokens, monkeypatch):
    """Small batches, nulls, repeats, one long text, clashing columns."""
    monkeypatch.setattr(alignment, "BATCH", 300)
    r = random.Random(4)
    words = ["the", "onth", "sher", "Straße", "x1", "▁"]
    rows = [(i, " ".join(r.choice(words[:5]) for _ in range(r.randint(1, 30)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "a ▁"), (None, "the the"), (3, rows[3][1]), (3, rows[3][1]), (43, " ".join(r.choice(words[:5]) for _ in range(20_000))), (44, "x" * 3000)]
    df = spark.createDataFrame([(k, t, "s", "b", 1, "t") for k, t in rows], DOCS).repartition(5)
    got = sorted(((x["doc_id"], *(x[c] for c in ALIGNED)) for x in alignment.align(df, groups=True).drop("groups").collect()), key=str)
    assert got == sorted(((k, *w) for (k, _), w in zip(rows, plain_alignment(plain_tokens[1], [t for _, t in rows]))), key=str)
    assert alignment.align(df.limit(0)).count() == 0


def plain_search(docs, items, k=10):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    found = [(key, Counter(re.findall(TERM, lower(t)))) for key, t in docs]
    found = [(key, c, sum(c.values())) for key, c in found if c]
    n_docs, total = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    asked = defaultdict(Counter)
    for key, t in items:
        asked[key].update(re.findall(TERM, lower(t)))
    out = []
    for item, terms in asked.items():
        scores = []
        for key, c, n in found:
            m = 25 + 75 * n * n_docs // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in terms.items() if t in c)
            if s > 0:
                scores.append((-s, key is not None, key))
        out += [(item, i + 1, key, -s) for i, (s, _, key) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def test_search(spark, monkeypatch):
    """Ties, repeats, nulls, weights of nothing, more items than a block, clashing columns."""
    r = random.Random(7)
    words = ["Alpha", "beta", "gamma9", "Straße", "日本", "the", "a_b", "x-y", "ÉTÉ", "delta"]
    docs = [(i, " ".join(r.choice(words) + r.choice(["", "", ","]) for _ in range(r.randint(1, 40))) + " the") for i in range(60)]
    docs += [(60, None), (61, ""), (62, " ., "), (7, docs[7][1]), (63, docs[9][1]), (None, docs[9][1]), (64, " ".join(r.choice(words) for _ in range(30_000)))]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 6)))) for i in range(12)] + [(12, None), (13, ""), (14, "nowhere"), (15, "the the"), (3, "delta ALPHA")]
    df = spark.createDataFrame([(k, t, "s", "b", 1, "t") for k, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(k, t, "d", 5) for k, t in items], "item_id long, text string, key string, row long")
    index = lexical.write_index(df, fresh_path(spark, "postings"))
    got = lambda: sorted(map(tuple, lexical.search(index, asked).collect()), key=str)
    want = plain_search(docs, items)
    assert got() == want
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 10)
    monkeypatch.setattr(lexical, "SLICE_ROWS", 50)
    assert got() == want
    assert lexical.search(index, asked.limit(0)).count() == 0
    none = lexical.write_index(df.limit(0), fresh_path(spark, "postings"))
    assert lexical.search(none, asked).count() == 0


def test_search_reads_only_the_buckets_of_its_terms(spark):
    df = spark.createDataFrame([(i, f"w{i} common") for i in range(500)], "doc_id long, text string")
    index = lexical.write_index(df, fresh_path(spark, "postings"))
    assert sorted(r["bucket"] for r in index.select("bucket").distinct().collect()) == list(range(-1, 1 << lexical.BUCKET_BITS))
    plan = lexical.search(index, spark.createDataFrame([(1, "w7")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan)


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3], 300) == [50, 100, 150]
    assert mixing.targets([10, 100, 100], [1, 1, 1], 210) == [30, 90, 90]
    assert mixing.targets([1, 2, 300], [3, 2, 1], 303) == [3, 6, 294]
    assert mixing.targets([0, 5], [1, 1], 5) == [0, 5] and mixing.targets([], [], 0) == []


def check_mix(rows, got, share=1.0):
    """Sizes, targets and the contract's bounds, worked out anew."""
    sizes = defaultdict(int)
    for k, t, s in rows:
        sizes[s] += len(re.findall(WORD, t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    aim = dict(zip(names, mixing.targets([sizes[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))], share * sum(sizes.values()))))
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in got), key=str) == sorted(((k, s, len(re.findall(WORD, t or ""))) for k, t, s in rows), key=str)
    for s in names:
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - aim[s]) < 1e-6 for r in own)
        assert all(r["taken"] == r["times"] * r["size"] and 0 <= r["times"] <= 3 for r in own)
        assert abs(sum(r["taken"] for r in own) - aim[s]) <= max(r["size"] for r in own) + 0.02 * aim[s] + 1
    assert sum(r["taken"] for r in got) <= round(share * sum(sizes.values()))


def test_mix_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = registry.queries()["op13_fair_queueing_mix"](spark, SF).collect()
    check_mix([(d.doc_id, d.text, d.source) for d in docs], got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, registry.queries()["op13_fair_queueing_mix"](spark, SF).collect()), key=str)


def test_mix_of_odd_rows(spark, monkeypatch):
    """A source with most rows, null and empty sources and texts, repeats, clashing columns; in small ranges."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    r = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(r.randint(1, 20))), "hot" if i % 3 else r.choice(["a", "é", "", None])) for i in range(600)]
    rows += [(600, None, "a"), (601, "", "empty"), (602, " \n", None), (None, "x y", "hot"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(k, t, s, "b", 1, "t") for k, t, s in rows], DOCS).withColumnRenamed("term", "row").withColumnRenamed("batch", "queue")
    first = mixing.mix(df.repartition(4)).collect()
    check_mix(rows, first)
    key = lambda got: sorted(((x["doc_id"], x["source"], x["size"], x["taken"]) for x in got), key=str)
    assert key(first) == key(mixing.mix(df.repartition(7)).collect())
    check_mix(rows, mixing.mix(df, share=0.3).collect(), 0.3)
    assert mixing.mix(df.limit(0)).count() == 0


def test_a_prefix_of_the_mix_is_near_its_weights(spark):
    rows = [(i, "w " * 10, f"s{i % 3}") for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("first_place < 2000").groupBy("source").count().collect()
    got = {r["source"]: r["count"] for r in got}
    assert all(abs(got[f"s{i}"] - 200 * (i + 1) / 6) <= 2 for i in range(3))
