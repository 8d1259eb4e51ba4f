"""Sum-of-squares online packing of tokenised documents into windows.

Each task packs the documents of its own split in the order they arrive, with no
shuffle. ``count[h]`` is the number of open windows filled to level h. A remainder of
length s goes to the level h (or a new window) that makes the sum of count[h]**2
smallest; of equal levels the fullest wins. Documents longer than a window are cut
into full windows first, so only their remainder is placed. When the split ends, or
``max_open`` windows are open (the memory bound), open windows are drained: their
pieces, fullest window first, are laid end to end and cut every ``size`` tokens, which
leaves at most one window part-filled.

Defined results: a null or empty text is its end token alone; repeated ids are packed
row by row; an empty table gives no rows; other columns are ignored. ``sequence_id`` is
unique: (split << 33) + window of that split. Ids of words are cached (``Encoder``).
"""

from __future__ import annotations

import re
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from attrition.session import ship_package

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


class Ids(dict):
    """Key -> ids as little-endian unsigned 32-bit by ``make``; emptied when it holds ``most`` keys, long keys are not kept."""

    def __init__(self, make, most: int = 250_000):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        ids = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = ids
        return ids


class Encoder:
    """Ids of a text by the vocabulary at ``path``: words are cached, and so are the letters of a word without the marks around it.

    This vocabulary lower-cases, drops white space and never merges over it, so words are independent. Texts with
    characters beyond Latin letters and printable ASCII, or with a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        cut, self.whole = own.model.tokenize, own.encode
        self.special = [t.content for t in own.get_added_tokens_decoder().values()]
        # FIXED VALUES: the pattern of the vocabulary file's pre-tokenizer.
        pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.plain = re.compile(r"[ -~\n\t\u00a1-\u012f\u0131-\u024f]*").fullmatch
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        as_text = {b: 256 + i for i, b in enumerate(hidden)}

        def of_piece(piece: str) -> bytes:
            ids = [t.id for t in cut(piece if piece.isascii() else piece.encode().decode("latin-1").translate(as_text))]
            return struct.pack(f"<{len(ids)}I", *ids)

        def of_word(word: str) -> bytes:
            core = word.rstrip(string.punctuation)
            if core.isalpha():
                return self.pieces[core] + self.pieces[word[len(core):]] if len(core) < len(word) else self.pieces[core]
            return b"".join([self.pieces[p] for p in pieces.findall(word)])

        self.pieces, self.words = Ids(of_piece), Ids(of_word)

    def ids(self, text: str) -> bytes:
        if self.plain(text) and not any(t in text for t in self.special):
            words = self.words
            return b"".join([words[w] for w in text.lower().split()])
        return np.array(self.whole(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_ENCODERS: dict = {}


def encoder(path: str) -> Encoder:
    """One encoder for the life of a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Windows:
    """The level array and the open windows behind it. A window is a list of (doc_id, start, doc_tokens, ids)."""

    def __init__(self, size: int, max_open: int):
        self.size, self.max_open = size, max_open
        self.count, self.open, self.total = np.zeros(size + 1, dtype=np.int64), {}, 0

    def place(self, length: int) -> int:
        """Level to put ``length`` < size on; 0 is a new window."""
        n, s = self.count, self.size
        top = s - length
        # change of the sum of squares: level h loses a window, level h + length gains one
        delta = 2 * n[length:s + 1] + 1
        delta[top] = 0  # a full window counts nowhere
        delta[1:] -= 2 * n[1:top + 1] - 1
        delta[1:][n[1:top + 1] == 0] = np.iinfo(np.int64).max
        return int(top - np.argmin(delta[::-1]))

    def add(self, piece: tuple, length: int) -> Iterator[list]:
        """Places a piece; yields the windows that this closes."""
        if length == self.size:
            yield [piece]
            return
        h = self.place(length)
        if h:
            window = self.open[h].pop()
            self.count[h] -= 1
            self.total -= 1
        else:
            window = []
        window.append(piece)
        if h + length == self.size:
            yield window
            return
        self.open.setdefault(h + length, []).append(window)
        self.count[h + length] += 1
        self.total += 1
        if self.total >= self.max_open:
            yield from self.drain()

    def drain(self) -> Iterator[list]:
        """All open windows, their pieces cut to fill windows; the last may stay short."""
        window, room = [], self.size
        for h in sorted(self.open, reverse=True):
            for doc, start, tokens, ids in (p for w in self.open[h] for p in w):
                while ids:
                    part, ids = ids[:4 * room], ids[4 * room:]
                    window.append((doc, start, tokens, part))
                    start, room = start + len(part) // 4, room - len(part) // 4
                    if not room:
                        yield window
                        window, room = [], self.size
        if window:
            yield window
        self.open, self.total = {}, 0
        self.count[:] = 0


def pack_documents(docs: Iterator[tuple], size: int, max_open: int, first: int = 0) -> Iterator[tuple]:
    """(doc_id, ids as bytes) -> rows of ``SCHEMA``, window by window."""
    windows, number = Windows(size, max_open), first

    def closed():
        for doc, ids in docs:
            tokens = len(ids) // 4
            for start in range(0, tokens, size):
                part = ids[4 * start:4 * (start + size)]
                yield from windows.add((doc, start, tokens, part), len(part) // 4)
        yield from windows.drain()

    for window in closed():
        at = 0
        for doc, start, tokens, ids in window:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), tokens, number, at
            at += len(ids) // 4
        number += 1


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, max_open: int = 4096,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in windows of at most ``size`` tokens; ``tokenizer`` is the path of the vocabulary file."""
    ship_package(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        import pyarrow as pa

        enc = encoder(tokenizer)

        def rows():
            for b in batches:
                for i, t in zip(b.column(0), b.column(1), strict=True):
                    yield i.as_py(), enc.ids(t.as_py() or "") + end

        out, kinds = [], pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
        for row in pack_documents(rows(), size, max_open, TaskContext.get().partitionId() << 33):
            out.append(row)
            if len(out) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=kinds)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
