"""Exact dedup and the Jaccard join against brute force."""
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from attrition.llm import ngram_join
from attrition.llm.exact_dedup import exact_dedup


@pytest.mark.parametrize("digest", ["all", "survivors"])
def test_exact_dedup(nasty_docs, nasty_rows, digest):
    got = [(r.row.doc_id, r.keep_id, r.group_size, r.kept, r.full_hash) for r in exact_dedup(nasty_docs, digest=digest).collect()]
    groups = defaultdict(list)
    for i, t, *_ in nasty_rows:
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        keep = max([i for i in ids if i is not None], default=None)
        for i in ids:
            want.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    order = lambda x: sorted(x, key=repr)
    assert order(g[:4] for g in got) == order(w[:4] for w in want)
    hashes = {(w[0], w[4]) for w in want}
    assert all((g[0], g[4]) in hashes or (digest == "survivors" and g[4] is None and g[2] == 1) for g in got)


def test_exact_dedup_empty(no_docs):
    assert exact_dedup(no_docs).collect() == []


def test_exact_dedup_carries_columns(nasty_docs):
    row = exact_dedup(nasty_docs).where("kept").select("row.*")
    assert row.columns == nasty_docs.columns


def brute_classes(rows, words, num, den):
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split() if t else []
        sets.setdefault(i, set()).add(frozenset(tuple(w[j:j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and any(a and b and den * len(a & b) >= num * len(a | b) for a in sets[x] for b in sets[y]):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return {i: ({len(s) for s in sets[i]}, root(i)) for i in ids}


@pytest.mark.parametrize("words,num,block,heavy", [(4, 85, 256, 10_000), (5, 80, 4, 3), (2, 60, 3, 1)])
def test_jaccard_classes(nasty_docs, nasty_rows, words, num, block, heavy):
    got = ngram_join.jaccard_classes(nasty_docs, words=words, num=num, block=block, heavy=heavy).collect()
    want = brute_classes([(i, t) for i, t, *_ in nasty_rows if i is not None], words, num, 100)
    assert len(got) == len(nasty_rows)
    assert len({r.component_id for r in got}) < len(got) - 20
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == len("a text without an id".split()) - words + 1
        else:
            sizes, component = want[r.doc_id]
            assert r.n_shingles in sizes and r.component_id == component, r


def test_jaccard_copies_in_several_tasks(spark):
    """A chain of near copies, each document in two tasks; its group is compared list by list."""
    n = 80
    ids = [i if i % 2 == 0 else 100 + i for i in range(n)]  # the smaller id of a list is that of an even document, which has two lists
    texts = [" ".join(f"w{j}x{k}" for j in (i, i + 1) for k in range(4)) for i in range(n)]
    rows = list(zip(ids, texts, strict=True))
    again = [(1000 + i, t) for i, t in rows]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows + again, 2), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_classes(docs, words=1, num=25, block=16).collect()}
    want = brute_classes([(i, t) for i, t in rows + again], 1, 25, 100)
    assert set(got.values()) == {0}
    assert got == {i: component for i, (_, component) in want.items()}


def test_jaccard_empty(no_docs):
    assert ngram_join.jaccard_classes(no_docs).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 25), min_size=1, max_size=24), min_size=2, max_size=12), st.sampled_from([50, 80, 85, 100]), st.sampled_from([0, 6, 9, 100]))
def test_partners_meet(groups, num, light):
    """Every linked pair of different sets shares a signature, whatever the boundary and the counters."""
    sets = [np.unique(ngram_join.mixed(np.array(g, dtype=np.uint64))) for g in groups]
    order = np.arange(16, dtype=np.uint16)[::-1].copy()
    keys = [set(ngram_join.signatures(s, order, light, num, 100)[0].tolist()) for s in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(np.intersect1d(a, b))
            if 100 * common >= num * (len(a) + len(b) - common) and a.tolist() != b.tolist():
                assert keys[i] & keys[j]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=9), min_size=2, max_size=9), st.booleans())
def test_forest_connects_what_is_linked(groups, split):
    sets = [np.array(sorted(g), dtype="<u8") for g in groups]
    side = [k % 2 if split else 0 for k in range(len(sets))]
    found = list(ngram_join.forest(list(range(len(sets))), sets, side, 0, int(split), 85, 100, wide=4))
    comp = list(range(len(sets)))
    ref = list(range(len(sets)))

    def join(c, x, y):
        a, b = c[x], c[y]
        c[:] = [min(a, b) if v in (a, b) else v for v in c]

    for x, y in found:
        join(comp, x, y)
    for x in range(len(sets)):
        for y in range(x):
            if (not split or side[x] != side[y]) and 100 * len(groups[x] & groups[y]) >= 85 * len(groups[x] | groups[y]):
                join(ref, x, y)
    assert comp == ref and len(found) <= len(sets) - 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=90), min_size=2, max_size=6), st.sampled_from([25, 80, 85, 100]), st.booleans(), st.randoms())
def test_partners_by_marks_miss_no_link(groups, num, split, rng):
    for g in list(groups):  # near copies of other sizes, so that marks differ in width
        near = set(g)
        for _ in range(rng.randint(0, 9)):
            near.discard(rng.choice(sorted(g)))
            near.add(rng.getrandbits(64))
        groups.append(near)
    sets = [np.array(sorted(g), dtype=np.uint64) for g in groups]
    side = [rng.randint(0, int(split)) for _ in sets]
    found = ngram_join.partners(list(range(len(sets))), [len(s) for s in sets], [ngram_join.mark(s) for s in sets], side, 0, int(split), num, 100, wide=4)
    for x in range(len(sets)):
        for y in range(x):
            if (not split or side[x] != side[y]) and 100 * len(groups[x] & groups[y]) >= num * len(groups[x] | groups[y]):
                assert found[x] and found[y]


def test_chance_meetings_ship_no_text():
    """Sets of one cell that share some shingles, fewer than partners do, are told from partners by their marks."""
    rng = np.random.default_rng(3)
    some = rng.integers(0, 2**63, 40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([some, rng.integers(0, 2**63, n, dtype=np.uint64)])) for n in range(300, 500, 10)]
    sets.append(np.unique(np.concatenate([sets[4][5:], some[:2]])))
    found = ngram_join.partners(list(range(len(sets))), [len(s) for s in sets], [ngram_join.mark(s) for s in sets], [0] * len(sets), 0, 0, 85, 100)
    assert np.flatnonzero(found).tolist() == [4, len(sets) - 1]
    twice = ngram_join.partners([7, 7], [len(sets[0])] * 2, [ngram_join.mark(sets[0])] * 2, [0, 0], 0, 0, 85, 100)
    assert not twice.any()  # rows of one id are one document


def test_chance_meetings_are_not_shipped(spark, monkeypatch):
    """Few counters tell rare shingles badly, so that two texts meet in a passage; only near copies stay in the cells that texts are shipped to."""
    rng = random.Random(4)
    base, other, copy = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(3))
    passage = " ".join(f"p{k}" for k in range(60))
    more = [(10 + k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))) for k in range(20)]
    docs = spark.createDataFrame([(1, f"{base} {passage}"), (2, f"{other} {passage}"), (3, copy), (4, copy + " end"), *more], "doc_id long, text string")
    seen = {}

    def kept(df, name):
        out = written(df, name)
        seen[name] = out
        return out

    written = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", kept)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_classes(docs, bits=10).collect()}
    assert got == {i: 3 if i == 4 else i for i, *_ in docs.collect()}
    assert {r.rep for r in seen["units"].collect()} == {1, 2, 3, 4}
    assert {r.rep for r in seen["cells"].collect()} == {3, 4}


def test_shingles_follow_the_word_rule():
    cache = ngram_join.Powers()
    s = lambda t, n=4: ngram_join.shingles(t, n, cache).tolist()
    assert s(None) == s("") == s(" \t\n\x0b\x0c\r") == []
    assert s("A b C d") == s("a\nB  c\td") and len(s("a b c d e")) == 2
    assert s("É a") != s("é a")  # only A-Z are lower-cased
    assert len(s("a b c d e")) == 1 and len(s("a\x1cb c d e")) == 1  # these are no blanks
    assert len(s("a b")) == 1 and s("a b") != s("b a") and s("a b") != s("a b a b")
    assert s("a b c d") != s("a b c d", 3)


@settings(max_examples=150, deadline=None)
@given(st.text(" \t\naAbBzZ@[`{é\x00", max_size=40), st.integers(3, 9))
def test_word_hashes(text, cut):
    raw = np.frombuffer(text.encode(), np.uint8)
    powers, was = ngram_join.Powers(), ngram_join.SLICE
    whole = ngram_join.word_hashes(raw, powers).tolist()
    ngram_join.SLICE = cut
    try:
        assert ngram_join.word_hashes(raw, powers).tolist() == whole
    finally:
        ngram_join.SLICE = was
    words = text.encode().lower().split()
    assert len(whole) == len(words)
    assert [[a == b for b in whole] for a in whole] == [[a == b for b in words] for a in words]
