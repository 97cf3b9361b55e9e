"""Word and line boundaries and hashes, against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidepanel.llm import scan

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b\x0c\ré\U0001f600", max_size=30)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_lines(texts):
    col = pa.array(texts, pa.string())
    buf, offsets = scan.text_bytes(col)
    starts, ends, first = scan.spans(buf, offsets, scan.SPACE)
    ls, le, lf = scan.line_spans(buf, offsets, np.array([t is not None for t in texts], bool))
    for d, t in enumerate(texts):
        got = [bytes(buf[a:b]).decode() for a, b in zip(starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]])]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [bytes(buf[a:b]).decode() for a, b in zip(ls[lf[d] : lf[d + 1]], le[lf[d] : lf[d + 1]])]
        assert lines == ([] if t is None else t.split("\n"))
    words = scan.keep_tokens(buf, offsets, starts, ends, first, np.ones(len(starts), bool), 0x20).to_pylist()
    assert words == [" ".join(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert scan.keep_tokens(buf, offsets, ls, le, lf, np.ones(len(ls), bool), 0x0A).to_pylist() == [t or "" for t in texts]


def test_hashes_follow_the_bytes():
    random.seed(2)
    words = ["".join(random.choice("abc") for _ in range(random.randint(1, 6))) for _ in range(4000)] + ["x" * (1 << 20)]
    buf, offsets = scan.text_bytes(pa.array([" ".join(words)]))
    starts, ends, _ = scan.spans(buf, offsets, scan.SPACE)
    h = scan.token_hash(buf, starts, ends)
    seen = {}
    for w, x in zip(words, h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
