"""N-gram join, line dedup and substring dedup against brute force, with the odd inputs."""

import random
import re
import time

import numpy as np
import pytest

from tidepanel.llm.components import connected_components
from tidepanel.llm.line_dedup import line_dedup
from tidepanel.llm.ngram_join import jaccard_components, merged, search_block
from tidepanel.llm.substring_dedup import sketch, substring_dedup

WORD = r"[^\x20\x09-\x0D]+"


def corpus(n=60, seed=3):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.45:
            base = r.choice(rows)[1]
            ws = (base or "").split()
            for _ in range(r.randint(0, 4)):
                if ws:
                    ws[r.randrange(len(ws))] = r.choice(words)
            rows.append((i, " ".join(ws)))
        else:
            rows.append((i, " ".join(r.choice(words) + r.choice(["", "", "\n"]) for _ in range(r.randint(1, 60)))))
    long = " ".join(r.choice(words) for _ in range(30_000))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "ONE two"), (n + 4, "one TWO"), (n + 5, long), (n + 6, long + " x"), (n + 7, rows[0][1]), (None, rows[0][1])]


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return sorted(((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows)), key=str)


def test_join_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, 1, b"x") for k, t in rows], "doc_id long, text string, n_shingles int, sig binary")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()), key=str)
    assert got == brute_components(rows)
    # blocks cut into chunks find the same links
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, block_tokens=50).collect()), key=str)
    assert got == brute_components(rows)
    assert jaccard_components(df.limit(0)).count() == 0


def test_block_search_finds_every_link():
    r = random.Random(5)
    for _ in range(40):
        base = [r.sample(range(1000), r.randint(5, 40)) for _ in range(3)]
        sets = []
        for _ in range(25):
            s = set(r.choice(base))
            for _ in range(r.randint(0, 5)):
                s.add(r.randrange(1000))
                s.discard(r.choice(sorted(s)))
            sets.append(np.array(sorted(s), np.uint64))
        forest = search_block(sets, np.array([len(s) for s in sets]))
        want = {}
        up = list(range(len(sets)))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
        want = [find(i) for i in range(len(sets))]
        assert forest.roots().tolist() == want


def test_block_search_grows_with_its_sets():
    """Pairs of sets that share one shingle with all others: time in proportion to sets; near copies melt away."""
    r = np.random.default_rng(4)

    def pairs(n):
        own = r.integers(1, 1 << 60, (n // 2, 10), dtype=np.uint64)
        return [np.append(own[i // 2], np.uint64(0)) for i in range(n)]

    took = []
    for n in (4000, 16_000):
        sets = pairs(n)
        start = time.perf_counter()
        links = search_block(sets, np.full(n, 11))
        took.append(time.perf_counter() - start)
        assert links.parts == n // 2 and links.roots().tolist() == [i // 2 * 2 for i in range(n)]
    assert took[1] < 8 * took[0] + 1
    base = r.integers(1, 1 << 60, 60, dtype=np.uint64)
    near = [np.unique(np.append(np.delete(base, i % 60), np.uint64(i + 1))) for i in range(5000)]
    start = time.perf_counter()
    assert search_block(near, np.full(5000, 60)).parts == 1 and time.perf_counter() - start < 10


def test_lists_merge_alike_in_slabs():
    r = np.random.default_rng(7)
    lists = [np.unique(r.integers(0, 300, r.integers(1, 200))) for _ in range(40)]
    ends = np.cumsum([len(x) for x in lists])
    starts = np.append(0, ends[:-1])
    posting = np.concatenate(lists)
    want = merged(posting, starts, ends, 300)
    for slab in (1, 350, 800):
        got = merged(posting, starts, ends, 300, slab)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_windows(rows, tokens, k, by_position):
    seen = {}
    for key, t in rows:
        if key is not None:
            u = tokens(t)
            for i in range(len(u) - k + 1):
                at = (key, i) if by_position else (key,)
                w = tuple(u[i : i + k])
                seen[w] = min(seen.get(w, at), at)
    out = []
    for key, t in rows:
        u = tokens(t)
        gone = set()
        if key is not None:
            for i in range(len(u) - k + 1):
                w = tuple(u[i : i + k])
                if seen[w] < ((key, i) if by_position else (key,)) and any(re.search(r"[^\x20\x09-\x0D]", x) for x in w):
                    gone |= set(range(i, i + k))
        out.append((key, len(u), len(gone), [x for i, x in enumerate(u) if i not in gone]))
    return sorted(((k, n, g, None if rows_t is None else x) for (k, n, g, x), (_, rows_t) in zip(out, rows)), key=str)


@pytest.mark.parametrize("width", [1 << 16, 1 << 20])
def test_substring_dedup_matches_brute_force(spark, width):
    rows = corpus(seed=8)
    df = spark.createDataFrame([(k, t, "c", 5) for k, t in rows], "doc_id long, text string, c0 string, n_tokens int")
    got = substring_dedup(df, width=width)
    assert got.columns == ["doc_id", "text", "c0", "n_tokens", "n_removed"] and {r.c0 for r in got.collect()} == {"c"}
    mine = sorted(((r.doc_id, r.n_tokens, r.n_removed, None if r.text is None else r.text.split(" ") if r.text else []) for r in got.collect()), key=str)
    assert mine == brute_windows(rows, lambda t: re.findall(WORD, t or ""), 13, False)
    assert substring_dedup(df.limit(0), width=width).count() == 0


def test_line_dedup_matches_brute_force(spark):
    r = random.Random(1)
    lines = ["l%d" % i for i in range(12)] + [""]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 12)))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "\n\n\n\n"), (83, "\n".join(["same"] * 50)), (None, "\n".join(["same"] * 50))]
    df = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id long, text string, bucket string")
    got = sorted(((x.doc_id, x.n_tokens, x.n_removed, x.text) for x in line_dedup(df).collect()), key=str)
    want = sorted(((k, n, g, None if x is None else "\n".join(x)) for k, n, g, x in brute_windows(rows, lambda t: [] if t is None else t.split("\n"), 3, True)), key=str)
    assert got == want
    assert line_dedup(df.limit(0)).count() == 0


def test_keys_are_integers(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for f in (line_dedup, substring_dedup):
        with pytest.raises(TypeError, match="integer"):
            f(df)
    # the join takes any key
    assert [tuple(r) for r in jaccard_components(df).collect()] == [("a", 1, "a")]


def test_a_sketch_in_many_parts_is_the_same(spark):
    df = spark.createDataFrame([(i, " ".join("w%d" % (j * j % (40 + i % 3)) for j in range(60 + i))) for i in range(40)], "doc_id long, text string").repartition(8)
    one = sketch(df, "text", 13, 1 << 20, 0)
    parts = sketch(df, "text", 13, 1 << 20, 4 * 100 * 2 * (1 << 20) // (1 << 16) // 16 * (32 << 20))
    assert all((a == b).all() for a, b in zip(one, parts)) and any(a.any() for a in one)


def test_repeated_rows_stay(spark):
    t = " ".join("a%d" % i for i in range(20))
    df = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup(df, width=1 << 16).collect()) == [(1, 0), (1, 0), (2, 20)]
    assert {r.component_id for r in jaccard_components(df).collect()} == {1}
