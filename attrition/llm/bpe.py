"""Byte-level BPE by dynamic programming over prefixes, and its inverse.

An automaton over the vocabulary reads a piece byte by byte and lists, longest first, the tokens that
are suffixes of the prefix read so far. Exactly one of them ends the encoding of that prefix: the one
that is compatible with the last token of the prefix before it, or that is the whole prefix and encodes
as itself. It is stored for every prefix; the ids are read off backwards from the end, so a piece of any
length takes time in proportion to its length, without a queue of merges.

Two adjacent tokens are compatible if merging their joined bytes gives the two back: going back through
the merges that made them, latest first, no merge of the two tokens that touch at the joint may come
before the one undone (of equal ranks the left one is done first). Results for pairs are kept.

The vocabulary's pattern cuts a text into pieces; pieces are cached. Characters whose class differs
between Unicode versions send a text to the library's own pre-tokenizer.

Defined results: null and empty texts have no ids and decode to an empty text; repeated ids are encoded
row by row; an empty table gives no rows; other columns are ignored. ``special=True`` gives special
tokens found in a text their own ids, as the library does by default; else they are ordinary text.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

from pyspark.sql import DataFrame, functions as F

from attrition.session import ship_package

# FIXED VALUES: the pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blocks whose characters have the same class in the pattern's library and in the tokenizers library (tests go through all of them).
SETTLED = (r"[\x00-՗ՙ-֊֍-ࢎ࢐-౛ౝ-೛ೝ-₎ₐ-ₜ₠-ꟍ"
           r"ꠀ-꭫꭮-￿\U0001f000-\U0001faff]*")


def byte_letters() -> list:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Recent(dict):
    """Key -> ``make(key)``. Holds the last ``most`` keys and what is still used of the ``most`` before them; long keys (by ``size``) are not kept."""

    def __init__(self, make, most: int = 400_000, size=len):
        self.make, self.most, self.size, self.older = make, most, size, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
            if self.size(key) > 64:
                return found
        self.keep(key, found)
        return found

    def keep(self, key, found) -> None:
        if len(self) >= self.most:
            self.room(1)
        self[key] = found

    def room(self, n: int) -> None:
        """Room for ``n`` keys more."""
        if len(self) + n > self.most:
            self.older = dict(self)
            self.clear()


class Merges:
    """Vocabulary and merges of one file: single bytes have rank -1, every other token is made by one merge."""

    def __init__(self, vocabulary: dict, merges: list):
        import ahocorasick

        self.rank, self.halves, self.made = {}, {}, {}
        for rank, (left, right) in enumerate(merges):
            a, b, t = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if t in self.rank or any(len(x) > 1 and i not in self.rank for x, i in ((left, a), (right, b))):
                raise ValueError(f"merge {rank} makes a token that was made before, or joins one that is made later")
            self.rank[t], self.halves[t], self.made[a, b] = rank, (a, b), rank
        self.fits = Recent(lambda pair: self.compatible(*pair))
        self.rank |= {t: -1 for text, t in vocabulary.items() if len(text) == 1}
        self.width, self.tokens = {t: len(text) for text, t in vocabulary.items()}, ahocorasick.Automaton()
        stands: dict = {}
        for t in sorted(self.rank, key=self.rank.get):  # tokens that their own bytes do not encode as are in no encoding
            a, b = self.halves.get(t, (t, t))
            stands[t] = self.rank[t] < 0 or (stands[a] and stands[b] and self.compatible(a, b, self.rank[t]))
        for text, t in vocabulary.items():
            if stands.get(t):
                self.tokens.add_word(text, (t, len(text)))
        self.tokens.make_automaton()

    def compatible(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether the joined bytes of ``a`` and ``b`` stay cut between them by all merges of a rank below ``before``."""
        rank, halves, made = self.rank, self.halves, self.made
        latest = before  # first rank at which the touching tokens are no longer both there
        while True:
            joint = made.get((a, b))
            if joint is not None and joint < latest:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                latest, a = rank[a], halves[a][1]
            else:  # of one rank, the right one was made later: undone first; a joint of that rank lies to its left and would come before
                latest, b = rank[b] + 1, halves[b][0]

    def encode(self, piece: str) -> tuple:
        """Ids of a piece written in byte letters."""
        last, fits, done = [0] * (len(piece) + 1), self.fits, -1
        for end, (t, width) in self.tokens.iter(piece):
            if end != done:
                start = end + 1 - width
                if not start or fits[last[start], t]:
                    last[end + 1], done = t, end
        ids, at = [], len(piece)
        while at:
            t = last[at]
            ids.append(t)
            at -= self.width[t]
        return tuple(reversed(ids))


class Coder:
    """Text to ids and back by the vocabulary file at ``path``."""

    def __init__(self, path: str, special: bool = True):
        import regex
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        model = json.loads(own.to_str())["model"]
        merges = Merges(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        letters = byte_letters()
        to_letters, to_byte = {i: c for i, c in enumerate(letters)}, {c: i for i, c in enumerate(letters)}
        self.raw = [b""] * own.get_vocab_size()
        for text, t in model["vocab"].items():
            self.raw[t] = bytes(to_byte[c] for c in text)
        names = {}
        for t, token in own.get_added_tokens_decoder().items():
            self.raw[t], names[token.content] = token.content.encode(), (t,)
        self.names = names if special else {}
        self.cut = re.compile(f"({'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})").split
        self.find, self.settled = regex.compile(PATTERN).findall, re.compile(SETTLED).fullmatch
        self.by_library = own.pre_tokenizer.pre_tokenize_str
        self.pieces = Recent(lambda piece: merges.encode(piece.encode().decode("latin-1").translate(to_letters)))
        self.spelled = Recent(merges.encode)

    def ids(self, text: str) -> list:
        if self.names and any(name in text for name in self.names):
            parts = [self.names[part] if part in self.names else self.ids(part) for part in self.cut(text) if part]
            return list(chain.from_iterable(parts))
        if self.settled(text):
            return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))
        return list(chain.from_iterable([self.spelled[piece] for piece, _ in self.by_library(text)]))

    def text(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")


_CODERS: dict = {}


def coder(path: str, special: bool = True) -> Coder:
    """One coder for the life of a Python worker."""
    if (path, special) not in _CODERS:
        _CODERS[path, special] = Coder(path, special)
    return _CODERS[path, special]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> DataFrame:
    """(doc_id, ids): the token ids of every text."""
    ship_package(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        of = coder(vocabulary, special).ids
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(t.as_py() or "") for t in b.column(1)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the text behind the ids; bytes that are no UTF-8 become U+FFFD; null ids give an empty text."""
    ship_package(coded.sparkSession)

    def run(batches):
        import pyarrow as pa

        of = coder(vocabulary).text
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(i.as_py() or ()) for i in b.column(1)], pa.string())], names=["doc_id", "text"])

    return coded.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded again in one pass, as digests."""
    ship_package(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        code = coder(vocabulary)
        decimal = [str(i) for i in range(len(code.raw))].__getitem__
        for b in batches:
            counts, sums, back = [], [], []
            for t in b.column(1):
                ids = code.ids(t.as_py() or "")
                counts.append(len(ids))
                sums.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(code.text(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
            .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text through the 50k byte-level vocabulary and back."""
    import public_tokenizers

    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
