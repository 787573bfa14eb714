"""Token counts under a unigram vocabulary by count-only Viterbi (operator 8).

An Aho-Corasick automaton names all vocabulary pieces that end at each character of a word; dynamic programming keeps,
for each place, only the best score and the number of pieces on the best way there. Ties are settled as the tokenizers
library's Unigram model does: of equal scores the piece that begins first wins, and an unknown character, scored 10
below the least piece, competes only where no piece is that one character. Unknown characters next to each other are
one piece, or with byte fallback (when the vocabulary has all byte pieces) one piece for each of their bytes.

Words are what the Metaspace pre-tokenizer makes (prepend_scheme "always"): each space becomes the replacement
character, one is put before the text, and a word begins at each. Pieces never cross words, so a task counts each
distinct word once and keeps a bounded number of counts.

Defined cases: a null text counts as the empty text, which has no tokens; whole texts are counted, in linear time for
pieces of bounded length; repeated rows and other columns are untouched, as this is a column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Bounds of what a worker keeps between batches: words, and the longest word kept.
WORDS_KEPT, LONGEST_KEPT = 400_000, 40


def sentencepiece_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """The pieces with their scores, and the unknown piece's id, of a SentencePiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class Counts:
    """Counts the tokens of words and texts; see the module's docstring."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        known = {p for p, _ in pieces}
        self.by_byte = all(f"<0x{b:02X}>" in known for b in range(256))
        self.kept: dict[str, int] = {}

    def word(self, word: str) -> int:
        size = len(word)
        score, count, unknown = [0.0] + [None] * size, [0] * (size + 1), [False] * (size + 1)

        def unknown_at(end: int) -> None:
            """An unknown character is the last to compete for a place."""
            candidate = score[end - 1] + self.unknown
            if score[end] is None or candidate > score[end]:
                score[end], unknown[end] = candidate, True
                count[end] = count[end - 1] + (len(word[end - 1].encode()) if self.by_byte else not unknown[end - 1])

        done, single = 0, True  # whether a piece is just the character that ends at `done`
        for last, (length, own) in self.automaton.iter(word):
            end = last + 1
            while done < end:
                if not single:
                    unknown_at(done)
                done, single = done + 1, False
            start = end - length  # of the pieces that end here, the longest comes first
            candidate = own + score[start]
            if score[end] is None or candidate > score[end]:
                score[end], count[end], unknown[end] = candidate, count[start] + 1, False
            if length == 1:
                single = True
        while done < size:
            if not single:
                unknown_at(done)
            done, single = done + 1, False
        if not single:
            unknown_at(size)
        return count[size]

    def text(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        words = (text if text[0] == SPACE else SPACE + text).split(SPACE)[1:]
        kept, total = self.kept, 0
        for w in words:
            n = kept.get(w)
            if n is None:
                n = self.word(SPACE + w)
                if len(w) <= LONGEST_KEPT:
                    if len(kept) >= WORDS_KEPT:
                        kept.clear()
                    kept[w] = n
            total += n
        return total


_loaded: dict[str, Counts] = {}


def _counts(name: str, sent: Broadcast) -> Counts:
    """A worker builds each automaton once."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Counts(sent.value)
    return _loaded[name]


class UnigramCounter:
    """A column expression that counts tokens under one vocabulary of (piece, score)."""

    def __init__(self, spark: SparkSession, pieces: list[tuple[str, float]]):
        sent, name = spark.sparkContext.broadcast(pieces), sha256(repr(pieces).encode()).hexdigest()

        def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = _counts(name, sent)
            for batch in batches:
                yield pa.array([own.text(t.as_py() or "") for t in batch], pa.int64())

        self._count = F.arrow_udf(count, T.LongType())

    def count(self, text: Column | str) -> Column:
        """bigint: the number of tokens."""
        return self._count(text)
