"""Two tokenisations of the same text, aligned: which tokens of one overlap which of the other.

Every text is tokenised whole by both vocabularies (A: byte-level BPE; B: sentencepiece). Where tokens with
a leading space or line end begin in both at the same byte, both have an end just before: these verified shared
ends are the anchors that cut a document into windows of token ids. A window's alignment depends on nothing but
its two id tuples, so it is worked out once and kept; a document's groups, links and pairs are its windows'
put together. A text without anchors is one window. New words of a batch of texts are encoded some in a row and
aligned all at once, by arrays.

How many documents hold a linked pair of ids is counted over the whole corpus. The documents' distinct
pairs are written once; they are counted by partial aggregates and joined with the counts, which are
broadcast if there are at most ``BROADCAST_PAIRS`` of them, else joined by shuffle with the same result.

Defined results: a text that is null or empty, or whose joined token bytes differ from a space and the text
(B's mark for a space inside it, say), has no tokens: zeros and an empty digest. Repeated ids are documents
of their own and are counted row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from array import array
from itertools import accumulate, chain

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from attrition.llm.bpe import Recent, byte_letters
from attrition.llm.common import written
from attrition.session import ship_package

MARK = "▁"
#: Blanks beside space and line end that A's pattern knows, and B's mark for a space.
OTHER_BLANKS = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000" + MARK + "]").search
BROADCAST_PAIRS = 1_000_000  # 16 bytes each in a hash table
JOINED, BLOCK = 16, 8192  # new chunks that are encoded as one text; that are aligned at once
SCHEMA = "at long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def sentence_pieces(path: str) -> tuple:
    """(model, bytes of every piece by id)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    named = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return model, [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(named)]


def align(a, b, a_side: tuple, b_side: tuple, base: int) -> tuple:
    """(number of a, of b, groups as text, links as ``a * base + b``, packed) of two runs of tokens that cover the same bytes.
    A side has by id the token's width in bytes and the id in decimal."""
    (a_width, a_name), (b_width, b_name) = a_side, b_side
    groups, links, a_rest, b_rest = [], [], iter(a), iter(b)
    x, y = next(a_rest), next(b_rest)
    x_end, y_end, xs, ys = a_width[x], b_width[y], a_name[x], b_name[y]
    while True:
        links.append(x * base + y)
        if x_end == y_end:
            groups.append(f"{xs}|{ys}")
            x = next(a_rest, None)
            if x is None:
                return len(a), len(b), ";".join(groups), array("q", links).tobytes()
            y = next(b_rest)
            x_end, y_end, xs, ys = x_end + a_width[x], y_end + b_width[y], a_name[x], b_name[y]
        elif x_end < y_end:
            x = next(a_rest)
            x_end += a_width[x]
            xs = f"{xs},{a_name[x]}"
        else:
            y = next(b_rest)
            y_end += b_width[y]
            ys = f"{ys},{b_name[y]}"


def spelled(n: int, separators: str) -> np.ndarray:
    """Ids below ``n`` in decimal, one row for each, with each separator behind."""
    return np.array([[f"{i}{s}".encode() for s in separators] for i in range(n)])


def align_runs(a: np.ndarray, b: np.ndarray, ends: np.ndarray, widths: list, names: list, base: int) -> list | None:
    """What ``align`` gives of each of many runs that follow each other and end after ``ends`` bytes; None if not all of these are ends of
    both sides. ``names``: A's ids before "," and "|", B's before ",", ";" and a line end."""
    a_end, b_end = (np.cumsum(width[ids]) for width, ids in zip(widths, (a, b), strict=True))
    a_last, b_last = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    if not (np.array_equal(a_end[a_last], ends) and np.array_equal(b_end[b_last], ends)):
        return None
    first, last = np.searchsorted(b_end, a_end - widths[0][a], "right"), np.searchsorted(b_end, a_end)  # of B's tokens, those with A's first and last byte
    number = last - first + 1
    stop = np.cumsum(number)
    links = (np.repeat(a, number) * base + b[np.arange(stop[-1]) + np.repeat(first - stop + number, number)]).tobytes()
    a_shared = b_end[last] == a_end
    b_shared = np.zeros(len(b), dtype=np.int64)
    b_shared[last[a_shared]] = 1
    a_stop, b_stop = np.flatnonzero(a_shared) + 1, np.flatnonzero(b_shared) + 1  # of the groups
    row = np.empty(len(a) + len(b), dtype=max(n.dtype for n in names))
    row[np.arange(len(a)) + np.append(0, b_stop)[np.cumsum(a_shared) - a_shared]] = names[0][a, a_shared.astype(np.int64)]
    places = np.arange(len(b)) + a_stop[np.cumsum(b_shared) - b_shared]
    b_shared[b_last] = 2
    row[places] = names[1][b, b_shared]
    groups = row.tobytes().translate(None, b"\0").decode().split("\n")
    cuts = [0, *(stop[a_last] * 8).tolist()]
    return list(zip(np.diff(a_last, prepend=-1).tolist(), np.diff(b_last, prepend=-1).tolist(), groups, [links[p:q] for p, q in zip(cuts, cuts[1:])]))


def together(found) -> tuple:
    """What ``align`` gives of windows that follow each other."""
    n_a, n_b, groups, links = zip(*found, strict=True)
    return sum(n_a), sum(n_b), ";".join(groups), b"".join(links)


def packed(ids) -> bytes:
    return array("I", ids).tobytes()


class Aligner:
    """Both vocabularies, and the chunks and windows met so far.

    A chunk is a run of spaces and line ends with what follows up to the next. A's pattern looks at blanks by their
    run only, and where no piece of B has a mark behind another character, or a line end beside one, B merges nothing
    over the beginning of a run: then the ids of a text are those of its chunks, and every chunk begins at an anchor.
    The alignment of its windows is kept with a chunk; a text for which this does not hold is encoded and cut whole.
    """

    def __init__(self, a_path: str, b_path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a, (self.b, b_raw) = Tokenizer.from_file(a_path), sentence_pieces(b_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters = {c: i for i, c in enumerate(byte_letters())}
        a_raw = [b""] * self.a.get_vocab_size()
        for text, t in self.a.get_vocab(with_added_tokens=False).items():
            a_raw[t] = bytes(letters[c] for c in text)
        self.raw, self.base = (a_raw, b_raw), len(b_raw)
        self.sides = [([len(r) for r in raw], [str(i) for i in range(len(raw))]) for raw in self.raw]
        self.widths = [np.array(width) for width, _ in self.sides]
        self.names = [spelled(len(raw), s) for raw, s in zip(self.raw, (",|", ",;\n"), strict=True)]
        self.marked = [[r[:1] in (b" ", b"\n") for r in raw] for raw in self.raw]
        named = [self.b.id_to_piece(i) for i in range(self.base)]
        self.by_chunk = MARK in named and not any(re.search(f"[^{MARK}]{MARK}|\n.|.\n", p) for p in named)
        self.lone = [named.index(MARK)] if self.by_chunk else []
        self.find = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
        self.chunks = Recent(lambda chunk: self.encode([chunk])[0], 250_000)
        self.windows = Recent(self.window, 120_000, lambda key: len(key[0]) // 4)

    def ids(self, texts: list) -> list:
        """Per text its tokens of A and of B; None if their bytes are not the text's. B's model puts a mark in front of what it is given."""
        out = []
        for text, x, y in zip(texts, self.a.encode_batch_fast(texts, add_special_tokens=False),
                              self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1), strict=True):
            a, b, want = x.ids, y[1:] if text[0] == "\n" else y or self.lone, text.encode()
            same = all(b"".join(map(raw.__getitem__, ids)) == want for raw, ids in zip(self.raw, (a, b), strict=True))
            out.append((a, b) if same else None)
        return out

    def encode(self, chunks: list) -> list:
        """Per chunk its alignment; None if the bytes of A's or B's tokens are not the chunk's."""
        return [found and together([self.windows[key] for key in self.cut(*found)]) for found in self.ids(chunks)]

    def encode_new(self, chunks: list):
        """Every chunk with what ``encode`` gives of it. ``JOINED`` of them in a row are a text, whose ids are theirs; a chunk of blanks
        alone would be one with the next, so these go by themselves, and so do those of a row whose bytes are not its tokens'."""
        single = [c for c in chunks if not c.strip(" \n")]
        words = [c for c in chunks if c.strip(" \n")]
        for block in (words[k:k + BLOCK] for k in range(0, len(words), BLOCK)):
            rows = [block[k:k + JOINED] for k in range(0, len(block), JOINED)]
            found = self.ids(list(map("".join, rows)))
            good = [c for row, ids in zip(rows, found, strict=True) if ids for c in row]
            a, b = (np.fromiter(chain.from_iterable([ids[k] for ids in found if ids]), dtype=np.int64) for k in (0, 1))
            ends = np.cumsum([len(c.encode()) for c in good], dtype=np.int64)
            aligned = align_runs(a, b, ends, self.widths, self.names, self.base) if good else []
            if aligned is None:
                single += block
                continue
            single += [c for row, ids in zip(rows, found, strict=True) if not ids for c in row]
            yield from zip(good, aligned)
        yield from zip(single, self.encode(single) if single else [], strict=True)

    def cut(self, a: list, b: list) -> tuple:
        """Windows of two tokenisations of the same bytes, as their packed ids: cut before spaces or line ends at which tokens of both begin."""
        if not any(map(self.marked[0].__getitem__, a[1:])):
            return ((packed(a), packed(b)),)
        starts = [list(accumulate(map(width.__getitem__, ids), initial=0)) for (width, _), ids in zip(self.sides, (a, b), strict=True)]
        places = [{s: k for k, (s, t) in enumerate(zip(at, ids)) if k and mark[t]} for at, ids, mark in zip(starts, (a, b), self.marked, strict=True)]
        shared = sorted(places[0].keys() & places[1].keys())
        i, j = ([0, *map(place.__getitem__, shared), len(ids)] for place, ids in zip(places, (a, b), strict=True))
        return tuple([(packed(a[p:q]), packed(b[r:s])) for p, q, r, s in zip(i, i[1:], j, j[1:])])

    def chunked(self, text: str) -> bool:
        return self.by_chunk and not OTHER_BLANKS(text)

    def learn(self, texts) -> list:
        """Per text its chunks (None for one that goes whole, or has no tokens); new ones are encoded together. Room for all that
        the texts add is made first, so that none of their chunks is dropped before it is used."""
        known = self.chunks
        found = [self.find(" " + t) if t and self.chunked(t) else None for t in texts]
        here = [c for c in set().union(*filter(None, found)).difference(known) if len(c) <= 64]
        again = {c: known.older[c] for c in here if c in known.older}
        known.room(len(here))
        for c, aligned in chain(again.items(), self.encode_new([c for c in here if c not in again])):
            known.keep(c, aligned)
        return found

    def window(self, key: tuple) -> tuple:
        return align(*[array("I", side) for side in key], *self.sides, self.base)

    def document(self, text: str, chunks: list | None) -> tuple | None:
        """The alignment of a whole text; None if it has no tokens."""
        if not text:
            return None
        if chunks is None:
            return self.encode([" " + text])[0]
        found = list(map(self.chunks.__getitem__, chunks))
        return None if None in found else together(found)


_ALIGNERS: dict = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner for the life of a Python worker."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``SCHEMA``: a number of the row, counts, the digest of the groups, and the distinct linked pairs with their number of links."""
    ship_package(docs.sparkSession)

    def run(batches):
        gc.disable()  # nothing here refers to itself, and the kept chunks are many objects to look through
        try:
            yield from documents(batches, aligner(a_path, b_path), TaskContext.get().partitionId() << 33)
        finally:
            gc.enable()

    def documents(batches, of, number):
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                rows, pairs, times, offsets, texts = [], [], [], [0], batch.column(1).to_pylist()
                for text, chunks in zip(texts, of.learn(texts), strict=True):
                    found = of.document(text, chunks)
                    if found is None:
                        rows.append((0, 0, 0, 0, ""))
                        offsets.append(offsets[-1])
                        continue
                    n_a, n_b, groups, links = found
                    links = np.frombuffer(links, dtype=np.int64)
                    rows.append((n_a, n_b, groups.count(";") + 1, len(links), hashlib.sha256(groups.encode()).hexdigest()))
                    distinct, count = np.unique(links, return_counts=True)
                    pairs.append(distinct)
                    times.append(count)
                    offsets.append(offsets[-1] + len(distinct))
                at = pa.array(np.arange(number, number + batch.num_rows))
                number += batch.num_rows
                ends = pa.array(offsets, pa.int32())
                flat = [np.concatenate(x) if x else np.array([], dtype=np.int64) for x in (pairs, times)]
                kinds = [pa.int64()] * 4 + [pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                lists = [pa.ListArray.from_arrays(ends, pa.array(flat[0], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(flat[1].astype(np.int32), pa.int32()))]
                yield pa.RecordBatch.from_arrays([at, batch.column(0), *columns, *lists],
                                                 names=["at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def rate_pairs(aligned: DataFrame, base: int) -> DataFrame:
    """(pair, n, best): in how many documents the pair is linked, and whether no other pair of its A id is in more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.expr(f"pair div {base}L"))
    top = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def rate_documents(aligned: DataFrame, base: int, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` (a written table) with n_best and count_sum; without its pairs."""
    rated = written(rate_pairs(aligned, base), "alignment-pairs")
    if rated.count() <= broadcast_pairs:
        rated = F.broadcast(rated)
    links = aligned.select("at", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    sums = links.join(rated, "pair").groupBy("at").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                                       F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return aligned.drop("pairs", "times").join(sums, "at", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def align_corpus(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Alignment of every document and the standing of its links in the corpus."""
    aligned = written(align_documents(docs, a_path, b_path, id_col, text_col), "aligned")
    return rate_documents(aligned, len(sentence_pieces(b_path)[1]), broadcast_pairs)


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document by the 50k byte-level and the 32k sentencepiece vocabulary."""
    import public_tokenizers

    return align_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
