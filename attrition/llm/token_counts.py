"""Token counts of a unigram vocabulary without making the tokens.

Aho-Corasick finds every vocabulary piece in the text; dynamic programming over character
positions carries the best score and the number of pieces behind it, nothing else. The rules
are those of the tokenizers library's Unigram model: pieces are tried in order of their start
and a later one must be strictly better (so of equal scores the longest last piece wins); a
character that is no piece costs the lowest score less 10 and counts as its UTF-8 bytes with
byte fallback, and as one unknown token for each run without. Blanks become ``MARK`` and the
text gets one in front. Where no piece has a mark after another character, the best path
breaks at every mark, so words are counted apart and cached, and within a word around every
character that is in no longer piece; else the whole text is one word.
Only the last (longest piece) positions are kept, so memory does not grow with a word.

Defined results: null and empty texts count 0 tokens with score 0; repeated ids are counted row
by row; an empty table gives no rows; other columns are ignored. Scores are added word by word
in double precision, exact for the integral scores of the vocabulary used here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from attrition.session import ship_package

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def read_vocabulary(path: str) -> list:
    """(piece, score) of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Word -> (pieces, score); emptied when it holds ``most`` words."""

    def __init__(self, vocabulary: list, unknown: str = "<unk>", byte_fallback: bool = True, most: int = 500_000):
        import ahocorasick

        self.pieces = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        known = {p for p, _ in vocabulary}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in known for b in range(256))
        self.unknown, self.most = min(s for _, s in vocabulary) - UNKNOWN_PENALTY, most
        self.keep = max(len(p) for p in known) + 1
        self.by_word = MARK in known and not any(re.search(f"[^{MARK}]{MARK}", p) for p in known)
        joined = {c for p in known if len(p) > 1 for c in p}
        # a character of no longer piece stands alone on every path; unknown runs count as one without byte fallback, so not then
        self.alone = re.compile(f"([^{''.join(map(re.escape, sorted(joined)))}])").split if joined and self.bytes else lambda word: [word]

    def __missing__(self, word: str):
        parts = [p for p in self.alone(word) if p]
        if len(parts) > 1:
            each = [self[p] for p in parts]
            found = sum(n for n, _ in each), sum(s for _, s in each)
        else:
            found = self.best_path(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found

    def best_path(self, word: str) -> tuple:
        keep, unknown = self.keep, self.unknown
        score, count, dark = [0.0] * keep, [0] * keep, [False] * keep  # dark: the path ends in an unknown character
        done = 0  # positions settled

        def settle(end: int, matches: list):
            best, n, is_dark, single = None, 0, False, False
            for length, s in matches:  # longest first: earliest start first
                at = (end - length) % keep
                if best is None or score[at] + s > best:
                    best, n, is_dark = score[at] + s, count[at] + 1, False
                single = single or length == 1
            if not single:
                at = (end - 1) % keep
                if best is None or score[at] + unknown > best:
                    width = len(word[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else 1 - dark[at]
                    best, n, is_dark = score[at] + unknown, count[at] + width, True
            at = end % keep
            score[at], count[at], dark[at] = best, n, is_dark

        here: list = []
        for last, match in self.pieces.iter(word):
            if last + 1 != done + 1:
                settle(done + 1, here)
                done, here = done + 1, []
                while done < last:
                    settle(done + 1, [])
                    done += 1
            here.append(match)
        while done < len(word):
            settle(done + 1, here)
            done, here = done + 1, []
        return count[done % keep], score[done % keep]

    def text(self, text: str) -> tuple:
        """(pieces, score) of a text."""
        if not text:
            return 0, 0.0
        marked = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return self.best_path(marked)
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            found = [self[w] for w in re.findall(f"{MARK}+[^{MARK}]*", marked)]
        else:
            found = [self[MARK + w] for w in text.split(" ")]
        return sum(n for n, _ in found), sum(s for _, s in found)


_COUNTERS: dict = {}


def counter(path: str) -> Counter:
    """One counter for the life of a Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(read_vocabulary(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, score): pieces on the best path of every text, and its score."""
    ship_package(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        of = counter(vocabulary)
        for b in batches:
            if b.num_rows:
                n, s = zip(*[of.text(t.as_py() or "") for t in b.column(1)], strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s, pa.float64())], names=["doc_id", "tokens", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, tokens long, score double")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document by the pieces and scores of the 32k vocabulary, read as a unigram one."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
