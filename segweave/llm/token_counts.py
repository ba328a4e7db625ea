"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton (pyahocorasick) lists the vocabulary pieces that end at each place; the dynamic programme
carries the best score and the number of pieces, and no path. Blanks become U+2581, one is put in front, and nothing
else is changed. Ties go as in unigram tokenizers, which try starts from left to right and replace a path only by a
strictly better one: of equal candidates for an end, the longest piece stays. A code point that is no piece itself may
be passed at the least score minus 10, for as many byte pieces as it has UTF-8 bytes. Scores are doubles.

Where no piece has a blank mark after another character (checked when the vocabulary is loaded), every path breaks
before each run of marks, so a text's count is the sum over its words, and counts of words are kept in a bounded memo.

Defined cases: null or empty text has 0 tokens. Repeated rows count alike; other columns pass through.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows

MARK = "▁"
WORDS = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
MEMO = 400_000


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], unknown_gap: float = 10.0, words: bool | None = None) -> None:
        self.scores = dict(pieces)
        self.unknown = min(self.scores.values(), default=0.0) - unknown_gap
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if self.scores:
            self.automaton.make_automaton()
        breaks = not any(MARK in piece.lstrip(MARK) for piece in self.scores)
        self.by_word = breaks if words is None else words and breaks
        self.memo: dict[str, int] = {}

    def viterbi(self, text: str) -> int:
        """The number of pieces on the best path through ``text`` (already with marks)."""
        n = len(text)
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        done, known = 0, self.scores

        def unknown(at: int, have: bool) -> None:
            c = text[at]
            if c not in known and (not have or best[at] + self.unknown > best[at + 1]):
                best[at + 1], pieces[at + 1] = best[at] + self.unknown, pieces[at] + len(c.encode("utf-8", "surrogatepass"))

        reached = False
        for end, (size, score) in self.automaton.iter(text) if self.scores else ():
            while done < end:  # places before this end are settled
                unknown(done, reached)
                reached, done = False, done + 1
            start = end + 1 - size
            total = best[start] + score
            if not reached or total > best[end + 1]:
                best[end + 1], pieces[end + 1], reached = total, pieces[start] + 1, True
        while done < n:
            unknown(done, reached)
            reached, done = False, done + 1
        return pieces[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return self.viterbi(marked)
        memo, total = self.memo, 0
        if len(memo) > MEMO:
            memo.clear()
        for word in WORDS.findall(marked):
            n = memo.get(word)
            if n is None:
                n = self.viterbi(word)
                if len(word) < 64:
                    memo[word] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    """The pieces and scores of a sentencepiece model file, without its control, unknown, unused and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
    return UnigramCounter([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not odd(i)])


def count_tokens(df: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of each whole text."""
    keep = [c for c in df.columns if c != out]

    def run(batch):
        own = counter(path)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.count(t) for t in batch.column(keep.index(text_col)).to_pylist()], pa.int64())], [*keep, out])

    return map_rows(df.select(*keep), run, T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.LongType())]))
