"""Token counts against the tokenizer; packing against the tokenizer, as an exact round trip."""
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer, models, normalizers

from attrition.llm import packing, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def unigram(vocabulary, byte_fallback):
    tok = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback))
    tok.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return tok


@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("more", [[], [("a▁t", -3.0), ("he▁", -1.0)]])
def test_counts_equal_the_tokenizers(byte_fallback, more):
    vocabulary = token_counts.read_vocabulary(PIECES) + more
    tok, own = unigram(vocabulary, byte_fallback), token_counts.Counter(vocabulary, byte_fallback=byte_fallback)
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice("ab  é漢\n▁\tthe😀<0x41><s>") for _ in range(rng.randint(0, 60)))
        assert own.text(text)[0] == len(tok.encode(text).ids), text


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("ab▁", min_size=1, max_size=4), st.integers(-6, -1), min_size=1, max_size=12), st.text("abc ", max_size=25))
def test_ties_equal_the_tokenizers(pieces, text):
    vocabulary = [("<unk>", 0.0)] + [(p, float(s)) for p, s in pieces.items()]
    assert token_counts.Counter(vocabulary, byte_fallback=False).text(text)[0] == len(unigram(vocabulary, False).encode(text).ids)


def test_count_tokens(nasty_docs, nasty_rows, no_docs):
    tok = unigram(token_counts.read_vocabulary(PIECES), True)
    got = sorted(((r.doc_id, r.tokens) for r in token_counts.count_tokens(nasty_docs, PIECES).collect()), key=repr)
    assert got == sorted(((i, len(tok.encode(t or "").ids)) for i, t, *_ in nasty_rows), key=repr)
    assert token_counts.count_tokens(no_docs, PIECES).collect() == []


def test_encoder_equals_the_tokenizer():
    tok, own = Tokenizer.from_file(WORDS), packing.Encoder(WORDS)
    rng = random.Random(4)
    texts = ["", " ", "It's DON'T 'tis we'll. Ünïcode,(x)!? 12½ a_b__ ²³ ª ÀÉÎ ß ſt ǅ", "İ K Å Σς <|startoftext|>x", "a\x1cb\x85c d­e"]
    texts += ["".join(rng.choice("aB'sT.é1_ \n½,-ÿĀİ漢<|>😀") for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    for t in texts:
        assert own.ids(t) == np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t


def check_packed(rows, want, size):
    """rows of packing.SCHEMA; want: list of (doc_id, ids)."""
    at, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        at[r[0]].append(r)
        windows[r[5]].append(r)
    for rows_ in windows.values():
        end = 0
        for r in sorted(rows_, key=lambda r: r[6]):
            assert r[6] == end and r[2] > 0
            end += r[2]
        assert end <= size
    pieces = defaultdict(int)
    for i, ids in want:
        pieces[i] += len(ids) // 4
        assert all(r[4] == len(ids) // 4 for r in at[i])
    for i, ids in want:
        copies = sum(1 for j, _ in want if j == i)
        for r in at[i]:
            assert zlib.crc32(ids[4 * r[1]:4 * (r[1] + r[2])]) == r[3]
        cover = sorted((r[1], r[2]) for r in at[i])
        assert sum(n for _, n in cover) == pieces[i]
        if copies == 1:
            assert [s for s, _ in cover] == [0, *np.cumsum([n for _, n in cover])[:-1].tolist()]
    return windows


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(2, 6), st.sampled_from([8, 16, 33]))
def test_windows(lengths, max_open, size):
    docs = [(i, np.arange(1000 * i, 1000 * i + n, dtype="<u4").tobytes()) for i, n in enumerate(lengths)]
    windows = check_packed(list(packing.pack_documents(iter(docs), size, max_open)), docs, size)
    total = sum(lengths)
    if max_open > size:
        assert len(windows) == -(-total // size)


def test_place_minimises_the_sum_of_squares():
    rng = np.random.default_rng(1)
    for _ in range(300):
        w = packing.Windows(16, 99)
        w.count[1:16] = rng.integers(0, 4, 15)
        s = int(rng.integers(1, 16))

        def cost(h):
            n = w.count.copy()
            if h:
                n[h] -= 1
            if h + s < 16:
                n[h + s] += 1
            return int((n[1:16] ** 2).sum())

        open_ = [0, *(h for h in range(1, 17 - s) if w.count[h])]
        best = min(map(cost, open_))
        assert w.place(s) == max(h for h in open_ if cost(h) == best)


def test_pack(nasty_docs, nasty_rows, no_docs):
    tok = Tokenizer.from_file(WORDS)
    want = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for i, t, *_ in nasty_rows]
    rows = [tuple(r) for r in packing.pack(nasty_docs, WORDS).collect()]
    windows = check_packed(rows, want, 2048)
    assert sum(sum(r[2] for r in w) < 2048 for w in windows.values()) <= nasty_docs.rdd.getNumPartitions()
    assert packing.pack(no_docs, WORDS).collect() == []
