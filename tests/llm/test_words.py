"""Alignment of two tokenizers, BPE by prefixes and spelling variants, each against a plain version of its own."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attrition.llm import alignment, bpe, spelling

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n=1500, letters="aB'sT.é1_ \n½,-ÿĀİ漢<|>😀ther in\x00▁\t"):
    rng = random.Random(4)
    fixed = ["", " ", "  ", "\n", " \n", "\n ", "a  ", "<|endoftext|><|endoftext|> x <|endoftext|>", "<s><0x0A><unk>", "a" * 301, "a\x1cb\x85c d­e ՘ 漢字 😀 ꟎", "don't  'tis we'll", "a▁b"]
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["".join(rng.choice("abetin") for _ in range(rng.randint(0, 80))) for _ in range(n)]


# -- BPE ---------------------------------------------------------------------

def test_coder_equals_the_tokenizer():
    tok, own = Tokenizer.from_file(BYTES), bpe.Coder(BYTES)
    plain_tok, plain = Tokenizer.from_file(BYTES), bpe.Coder(BYTES, special=False)
    plain_tok.encode_special_tokens = True
    for t in odd_texts():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert own.ids(t) == ids, t
        assert own.text(ids) == tok.decode(ids, skip_special_tokens=False) == t
        assert plain.ids(t) == plain_tok.encode(t, add_special_tokens=False).ids, t
    rng = random.Random(1)
    for _ in range(500):  # ids that no text has: bytes that are no UTF-8
        ids = [rng.choice([rng.randrange(256), rng.randrange(50257)]) for _ in range(rng.randint(0, 12))]
        assert own.text(ids) == tok.decode(ids, skip_special_tokens=False)


def test_settled_characters_are_cut_alike():
    """Every character that goes by the pattern is of the class that the library has for it."""
    own = bpe.Coder(BYTES)
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        if own.settled(c):
            text = f"a{c}1{c} b!{c}"
            assert own.find(text) == [text[i:j] for _, (i, j) in own.by_library(text)], hex(ord(c))


def merged(piece, merges):
    """BPE as defined: the first pair of lowest rank is merged until none is left."""
    parts = list(piece)
    while True:
        ranked = [(merges[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
        if not ranked:
            return parts
        _, i = min(ranked)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 99), st.integers(0, 99)), min_size=1, max_size=10), st.text("abc", min_size=1, max_size=20))
def test_any_merges_equal_their_definition(picks, piece):
    tokens, merges = ["a", "b", "c"], {}
    for x, y in picks:
        pair = tokens[x % len(tokens)], tokens[y % len(tokens)]
        if "".join(pair) not in tokens:
            merges[pair] = len(merges)
            tokens.append("".join(pair))
    vocabulary = {t: i for i, t in enumerate(tokens)}
    own = bpe.Merges(vocabulary, list(merges))
    assert [tokens[i] for i in own.encode(piece)] == merged(piece, merges)


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")])


def test_round_trips(nasty_docs, nasty_rows, no_docs):
    tok = Tokenizer.from_file(BYTES)
    ids = {t: tok.encode(t or "", add_special_tokens=False).ids for _, t, *_ in nasty_rows}
    want = sorted(((i, len(ids[t]), hashlib.sha256(",".join(map(str, ids[t])).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
                   for i, t, *_ in nasty_rows), key=repr)
    assert sorted(map(tuple, bpe.round_trips(nasty_docs, BYTES).collect()), key=repr) == want
    coded = bpe.encode(nasty_docs, BYTES)
    assert sorted(((r.doc_id, tuple(r.ids)) for r in coded.collect()), key=repr) == sorted(((i, tuple(ids[t])) for i, t, *_ in nasty_rows), key=repr)
    assert sorted(map(tuple, bpe.decode(coded, BYTES).collect()), key=repr) == sorted(((i, t or "") for i, t, *_ in nasty_rows), key=repr)
    for none in (bpe.round_trips(no_docs, BYTES), bpe.encode(no_docs, BYTES), bpe.decode(coded.limit(0), BYTES)):
        assert none.collect() == []


# -- alignment ---------------------------------------------------------------

def plain_alignment(text, tok, model):
    """(a, b, groups, links) by comparing every token of A with every one of B near it."""
    if not text:
        return None
    a, b, letters = tok.encode(" " + text, add_special_tokens=False), model.encode(text), bpe.byte_letters()
    ends = []
    for raws in ([bytes(letters.index(c) for c in t) for t in a.tokens],
                 [bytes([i - 3]) if 3 <= i < 259 else model.id_to_piece(i).replace("▁", " ").encode() for i in b]):
        if b"".join(raws) != (" " + text).encode():
            return None
        spans, at = [], 0
        for r in raws:
            spans.append((at, at + len(r)))
            at += len(r)
        ends.append(spans)
    links, low = [], 0
    for x, (s, e) in zip(a.ids, ends[0], strict=True):
        while low < len(b) and ends[1][low][1] <= s:
            low += 1
        k = low
        while k < len(b) and ends[1][k][0] < e:
            links.append((x, b[k]))
            k += 1
    shared = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
    sides = [defaultdict(list), defaultdict(list)]
    for side, ids, spans in zip(sides, (a.ids, b), ends, strict=True):
        cut = iter(shared)
        here = next(cut)
        for i, (_, e) in zip(ids, spans, strict=True):
            while e > here:
                here = next(cut)
            side[here].append(i)
    groups = ";".join(",".join(map(str, sides[0][c])) + "|" + ",".join(map(str, sides[1][c])) for c in shared)
    return a.ids, b, groups, len(shared), links


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 0])
def test_align_corpus(spark, nasty_docs, nasty_rows, no_docs, broadcast_pairs):
    tok, model = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tok.encode_special_tokens = True
    odd = [(1000 + i, t) for i, t in enumerate(odd_texts(150))]
    docs = nasty_docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    plain = [(i, plain_alignment(t, tok, model)) for i, t in [(r[0], r[1]) for r in nasty_rows] + odd]
    counts = Counter(p for _, found in plain if found for p in set(found[4]))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    want = []
    for i, found in plain:
        if not found:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, n_groups, links = found
        want.append((i, len(a), len(b), n_groups, len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links),
                     hashlib.sha256(groups.encode()).hexdigest()))
    got = alignment.align_corpus(docs, BYTES, PIECES, broadcast_pairs=broadcast_pairs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[1] == 0 for w in want) > 10  # texts with B's mark for a space
    assert alignment.align_corpus(no_docs, BYTES, PIECES, broadcast_pairs=broadcast_pairs).collect() == []


def test_chunks_and_windows_equal_the_whole_text():
    """Aligned by chunks and windows, or as one window, a text has the same groups and links; its ids are those of the libraries."""
    tok, model, own = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES), alignment.Aligner(BYTES, PIECES)
    tok.encode_special_tokens = True
    assert own.by_chunk
    seen, texts = 0, odd_texts() + odd_texts(800, "aB's,.;)(-1é \n") + ["漢" * 500]
    for t, chunks in zip(texts, own.learn(texts), strict=True):
        found = own.document(t, chunks)
        if found:
            seen += 1
            a, b = tok.encode(" " + t, add_special_tokens=False).ids, model.encode(t)
            assert found == alignment.align(a, b, *own.sides, own.base), t
            assert re.split("[|;,]", found[2]) and found[0] + found[1] == len(a) + len(b)
    assert seen > 3000 and len(own.chunks) > 1000 and len(own.windows) > 1000
    assert all(len(k[0]) <= 256 for k in own.windows)


def test_windows_begin_at_shared_ends_before_blanks():
    own = alignment.Aligner(BYTES, PIECES)
    tok, model = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = "Antidisestablishmentarianism\nis 漢字  a long word, isn't it?"
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    windows = own.cut(a, b)
    assert len(windows) > 5 and tuple(map(b"".join, zip(*windows))) == (alignment.packed(a), alignment.packed(b))
    for w in windows:
        x, y = (b"".join(own.raw[k][i] for i in memoryview(side).cast("I")) for k, side in enumerate(w))
        assert x == y and x[:1] in (b" ", b"\n")


def test_new_chunks_are_encoded_in_rows_and_aligned_together(monkeypatch):
    """A batch's new chunks go to the libraries as few texts, and get the alignment that each has alone."""
    own = alignment.Aligner(BYTES, PIECES)
    texts = [t for t in odd_texts(1500, "aB's,.;)(-1é \n") + odd_texts(400) + ["漢" * 30, "a <|endoftext|>\n<unk> <s>"] if own.chunked(t)]
    chunks = sorted({c for t in texts for c in own.find(" " + t) if len(c) <= 64})
    want, asked, ids = own.encode(chunks), [], own.ids
    monkeypatch.setattr(own, "ids", lambda texts: asked.extend(texts) or ids(texts))
    found = own.learn(texts)
    assert len(chunks) > 2000 and len(asked) < len(chunks) / 8
    assert all(own.chunks[c] == x for c, x in zip(chunks, want, strict=True))
    assert [None if c is None else "".join(c) for c in found] == [" " + t if t else None for t in texts]
    small = ["  ", " a", "\n", " b▁c", "\n\nd", " ", " e"]  # one has B's mark: no tokens, and those of its row go by themselves
    assert dict(own.encode_new(small)) == dict(zip(small, own.encode(small), strict=True)) and own.encode([" b▁c"]) == [None]
    assert list(own.encode_new([])) == []


def test_runs_with_an_end_inside_a_token_are_not_cut():
    own = alignment.Aligner(BYTES, PIECES)
    (a, b), = own.ids([" the other"])
    a, b = np.array(a), np.array(b)
    assert alignment.align_runs(a, b, np.array([10]), own.widths, own.names, own.base) == own.encode([" the other"])
    assert len(alignment.align_runs(a, b, np.array([4, 10]), own.widths, own.names, own.base)) == 2
    assert alignment.align_runs(a, b, np.array([5, 10]), own.widths, own.names, own.base) is None


def test_chunks_of_a_batch_are_not_dropped_before_they_are_used(monkeypatch):
    """Chunks are turned out between batches, so that none of a batch has to be encoded by itself."""
    own = alignment.Aligner(BYTES, PIECES)
    own.chunks.most = 30
    words = [f"w{i}x" for i in range(65)]
    batches = [words[:25], words[25:50], words[:10] + words[50:], words[:25]]
    want = [own.encode([" " + " ".join(b)])[0] for b in batches]
    learn = own.learn
    for batch, whole in zip(batches, want, strict=True):
        text = " ".join(batch)
        (chunks,) = learn([text])
        with monkeypatch.context() as patched:
            patched.setattr(own, "encode", None)
            assert own.document(text, chunks) == whole


# -- spelling ----------------------------------------------------------------

def edits_of(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {x + y[1:] for x, y in cuts if y} | {x + c + y[1:] for x, y in cuts if y for c in letters} | {x + c + y for x, y in cuts for c in letters}


def plain_spelling(rows, least=7, drop=31, ratio=10):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % drop == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1:]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least and n >= 2}
    letters = {c for w in counts for c in w}
    near = {w: sorted((edits_of(w, letters) - {w}) & counts.keys(), key=lambda v: (-counts[v], v)) if len(w) < 300 else [] for w in counts}
    form = {w: v[0] for w, v in near.items() if v and counts[v[0]] >= ratio * counts[w]}
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def misspelt(seed=3):
    """Texts with words, their misspellings (at every place, of one and two edits), anagrams and odd letters."""
    rng, rows = random.Random(seed), []
    base = ["".join(rng.choice("abcdeéÿ×") for _ in range(rng.randint(7, 12))) for _ in range(25)]
    base += ["aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "ÀÉÎÕÜàéî", "zzzzzzzzzzzzzzzz"]
    for i in range(300):
        found = []
        for _ in range(rng.randint(5, 30)):
            w = base[min(int(rng.expovariate(0.2)), len(base) - 1)]
            if rng.random() < 0.3:
                for _ in range(rng.randint(1, 2)):
                    k = rng.randrange(len(w))
                    w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abz") + w[k:], w[:k] + rng.choice("abz") + w[k + 1:], w[:k] + w[k:][::-1]])
            found.append(rng.choice([w, w, w.upper(), w + ",", w.capitalize()]))
        rows.append((i, rng.choice([" ", "\n", "1"]).join(found)))
    return rows + [(400 + i, "kkkkkmm " * 400 + "kkkkkkm " * 25 + "kkkkkkk " * (i < 2)) for i in range(3)]


def test_group_spellings(spark, nasty_docs, nasty_rows, no_docs):
    rows = misspelt() + [(r[0], r[1]) for r in nasty_rows]
    docs = nasty_docs.unionByName(spark.createDataFrame(misspelt(), "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.withColumns({c: F.lit("clash") for c in ("word", "n", "signature", "form")})
    want = plain_spelling(rows)
    assert sorted(map(tuple, spelling.group_spellings(spelling.count_words(docs)).collect())) == want
    assert sum(w[1] is not None for w in want) > 50 and any(w[1] not in (None, w[2]) for w in want)
    assert spelling.group_spellings(spelling.count_words(no_docs)).collect() == []


def test_near_pairs_are_all_pairs(spark):
    """Every word of three letters of length 3 and 4: all pairs at distance one, by comparing all."""
    from itertools import product

    words = ["".join(p) for n in (3, 4) for p in product("abc", repeat=n)]
    got = {(r.a, r.b) for r in spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), least=3, parts=4).collect()}
    assert got == {(v, w) for v in words for w in edits_of(v, "abc") & set(words) if v < w}


def test_roots_of_long_paths(spark):
    path = [("w" * (i + 1), "w" * (i + 2) if i < 17 else None, 10 ** i) for i in range(18)]
    found = spark.createDataFrame(path, "word string, form string, n long")
    assert {(r.word, r.root) for r in spelling.roots(found, 10).collect()} == {(w, "w" * 18) for w, f, _ in path if f}
