"""WARC, chat and pieces: round trips."""

import base64
import gzip
import hashlib
import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidepanel.llm import pieces, warc
from tidepanel.llm.chat import format_conversations, read_loss_text, read_turns
from tidepanel.llm.store import fresh_path


def test_warc_round_trip(spark):
    rows = [(1, "u1", "abc"), (2, "u 2\n", "abc"), (3, None, None), (4, "u", ""), (None, "n", "abc"), (None, "z", "zz"), (7, "u7", "é" * 70000), (1, "u1", "abc")]
    df = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    index = warc.write_archives(df, fresh_path(spark, "warc"))
    got = sorted((r.page_key, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to or "", r.payload and bytes(r.payload)) for r in warc.read_records(index).collect())
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = []
    for k, _, t in rows:
        refers = {"abc": "1", None: "3", "": "3"}.get(t) if k not in (1, 3) else None
        refers = None if (k, t) == (None, "zz") else refers
        body = (t or "").encode()
        want.append((str(k) if k is not None else "", "revisit" if refers else "response", len(body), sha(t), refers or "", b"" if not refers and not body else (body if not refers else None)))
    assert got == sorted(want)
    # any selection reads the same records
    some = warc.read_records(index.where("record_type = 'revisit'"), payload=False)
    assert some.count() == sum(w[1] == "revisit" for w in want)
    files = {r.file for r in index.select("file").distinct().collect()}
    raw = b"".join(gzip.decompress(Path(f.removeprefix("file:")).read_bytes()) for f in files)
    assert raw.count(b"WARC/1.1\r\n") == len(rows) + len(files)
    # short payloads are no revisits under a higher bound
    index = warc.write_archives(df, fresh_path(spark, "warc"), min_bytes=4)
    assert index.where("record_type = 'revisit'").count() == 0
    empty = warc.write_archives(df.limit(0), fresh_path(spark, "warc"))
    assert warc.read_records(empty).count() == 0


def test_ranges_are_coalesced():
    got = list(warc.coalesced([("a", 0, 10), ("a", 10, 5), ("a", 10_000_000, 5), ("b", 3, 1), ("b", 4, 20_000_000)]))
    assert [(f, s, e, t) for f, s, e, t in got] == [("a", 0, 15, [0, 1]), ("a", 10_000_000, 10_000_005, [2]), ("b", 3, 4, [3]), ("b", 4, 20_000_004, [4])]


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "<|end|>\n", "\\l \\s <|next|>", "", None, "a<|role:user|>\nb", "\\\\<<\\", "é\U0001f600"]
    rows = [(1, i, "user" if i % 3 else "assistant", t) for i, t in enumerate(odd)] + [(2, 0, None, "x"), (2, None, "assistant", "first"), (None, 0, "assistant", "n"), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a"), (4, 0, "a<|end|>\n", "t")]
    rows += [(5, i, "assistant", "w" * 1000) for i in range(300)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    f = format_conversations(df)
    out = f.select("conv_id", "formatted", "loss_mask", read_turns(f.formatted).alias("turns"), read_loss_text(f.formatted, f.loss_mask).alias("loss")).collect()
    assert len(out) == 6
    for r in out:
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert sum(m.chars for m in r.loss_mask) == len(r.formatted)
    assert format_conversations(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" ▁\nabthe")), max_size=60)), max_size=8))
def test_pieces_round_trip(vocabulary, texts):
    ids = pieces.sample(vocabulary, texts, np.arange(len(texts), dtype=np.int64))
    assert pieces.restore(vocabulary, ids) == [None if t is None else t.encode() for t in texts]


def test_sampling_follows_the_weights(vocabulary):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    known = {m.id_to_piece(i): i for i in range(3, m.get_piece_size()) if not m.is_byte(i)}

    def ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in known:
                yield from ((known[s[:k]], *rest) for rest in ways(s[k:]))

    every = list(ways("▁there"))
    weight = [math.exp(sum(vocabulary.log_weight[i] for i in w)) for w in every]
    n = 30_000
    got = Counter(tuple(np.frombuffer(x, "<u2").tolist()) for x in pieces.sample(vocabulary, ["there"] * n, np.random.default_rng(3).integers(0, 1 << 62, n)))
    assert set(got) <= set(every)
    for w, x in zip(every, weight):
        p = x / sum(weight)
        assert abs(got[w] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_pieces_do_not_hang_on_the_batch(vocabulary, spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    seeds = np.arange(len(texts), dtype=np.int64) * 7919
    together = pieces.sample(vocabulary, texts, seeds)
    assert together == [pieces.sample(vocabulary, [t], seeds[i : i + 1])[0] for i, t in enumerate(texts)]
    assert together[::-1] == pieces.sample(vocabulary, texts[::-1], seeds[::-1].copy())


def test_encoding_depends_on_key_and_text_alone(spark):
    rows = [(i, "the quick brown fox %d" % (i % 7)) for i in range(200)] + [(500, None), (501, ""), (None, "x y"), (502, "long " * 40_000), (3, "the quick brown fox 3")]
    df = spark.createDataFrame([(k, t, b"i") for k, t in rows], "doc_id long, text string, ids binary")
    a = sorted(((r.doc_id, r.n_pieces, r.ids, r.decoded) for r in pieces.encode(df, decode=True).collect()), key=str)
    b = sorted(((r.doc_id, r.n_pieces, r.ids, r.decoded) for r in pieces.encode(df.repartition(7), decode=True).collect()), key=str)
    assert a == b and sorted(((k, d) for k, _, _, d in a), key=str) == sorted(rows, key=str)
    c = pieces.encode(df, seed=1)
    assert c.count() == len(rows) and {r.ids for r in c.collect()} != {x[2] for x in a}
    back = pieces.decode(c).select("doc_id", "text").collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(rows, key=str)
    assert pieces.encode(df.limit(0)).count() == 0
