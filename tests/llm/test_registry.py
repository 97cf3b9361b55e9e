"""Every query of the group over whole tables, against SQL where it says the same, else against plain Python."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import pytest

from tests.llm.test_contamination_pii import plain_spans
from tidepanel.llm import registry

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "pages", "benchmark")}


def rows(spark, name):
    return registry.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, want))


def test_sharding(spark, tables):
    got = rows(spark, "op1_size_balanced_sharding")
    texts = {r.doc_id: (r.text or "").encode() for r in tables["documents"]}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "bytes", None) and 0 <= r.shard < 40 for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_leaks(spark, tables):
    plain = lambda s: re.sub(r"[ \t-\r]", " ", (s or "").lower())
    items = {r.item_id: plain(r.text) for r in tables["benchmark"]}
    whole = {(r.doc_id, i) for r in tables["documents"] for i, t in items.items() if t and t in plain(r.text)}
    got = rows(spark, "op3_benchmark_decontamination")
    assert whole <= {(r.doc_id, r.item_id) for r in got}


def test_warc(spark, tables):
    first, want = {}, {}
    for r in tables["pages"]:
        body = (r.html or "").encode()
        first[body] = min(first.get(body, r.page_id), r.page_id)
    for r in tables["pages"]:
        body = (r.html or "").encode()
        own = first[body] == r.page_id
        want[r.page_id] = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if own else "revisit", None if own else first[body])
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows(spark, "op5_warc_range_reads")}
    assert got == want


def test_pieces(spark, tables):
    got = {r.doc_id: r.decoded_sha256 for r in rows(spark, "op7_piece_sampling")}
    assert got == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() if r.text is not None else None for r in tables["documents"]}


def test_quality(spark, tables):
    got = {r.doc_id: r for r in rows(spark, "op9_quality_rules")}
    assert len(got) == len(tables["documents"])
    for d in tables["documents"]:
        t = d.text or ""
        w = re.findall(WORD, t)
        three = Counter(zip(w, w[1:], w[2:]))
        cover = {j + k for j in range(len(w) - 2) if three[tuple(w[j : j + 3])] > 1 for k in range(3)}
        solid = [x for x in t.split("\n") if re.search(WORD, x)]
        r = got[d.doc_id]
        base = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(solid) - len(set(solid)), len(cover), base)
        assert not (base and r.kept)


def test_personal_data(spark, tables):
    got = {r.doc_id: r for r in rows(spark, "op10_personal_data")}
    for d in tables["documents"]:
        spans = plain_spans(d.text or "")
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r = got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and set(filter(None, told.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in spans) for x in ("email", "ip", "card", "phone")]
