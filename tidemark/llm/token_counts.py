"""Token counts of a unigram tokenizer by a Viterbi pass that keeps counts only.

An Aho-Corasick automaton lists the vocabulary's pieces in a word; dynamic programming over the word's
positions carries the best score and, instead of a way back, the number of pieces on it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import map_arrow, type_of

#: The mark that stands for a space, and the penalty of an unknown character below the lowest score.
SPACE, UNKNOWN_PENALTY = "▁", 10.0
#: Words whose counts a task keeps at a time, and the characters of the longest of them.
CACHED_WORDS, CACHED_CHARS = 800_000, 40


def pieces_of(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter(dict):
    """Word to (pieces, score), filled as words are asked for.

    Ties: of the best ways to a position, the one whose last piece begins first. A character that is no piece
    of its own may be read as unknown; unknown characters count a piece for each of their UTF-8 bytes if the
    vocabulary has all byte pieces, else one piece for each run of them.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton, self.single, self.longest = ahocorasick.Automaton(), set(), max((len(p) for p, _ in pieces), default=1)
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.by_byte = {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in pieces}

    def __missing__(self, word: str) -> tuple[int, float]:
        found = self._best(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = found
        return found

    def _best(self, word: str) -> tuple[int, float]:
        # a piece begins at most `longest` positions back, so the pass keeps a ring of them, whatever the word's length
        ring = self.longest + 1
        best, count, unknown = [0.0] * ring, [0] * ring, False
        found = self.automaton.iter(word)
        match = next(found, None)
        for end in range(1, len(word) + 1):
            ways = []
            while match is not None and match[0] < end:
                ways.append((end - match[1][0], match[1][1]))
                match = next(found, None)
            top, start = None, 0
            for low, score in sorted(ways):
                if top is None or best[low % ring] + score > top:
                    top, start = best[low % ring] + score, low
            before, at = (end - 1) % ring, end % ring
            if word[end - 1] not in self.single and (top is None or best[before] + self.unknown > top):
                more = len(word[end - 1].encode()) if self.by_byte else not unknown
                best[at], count[at], unknown = best[before] + self.unknown, count[before] + more, True
            else:
                count[at], best[at], unknown = count[start % ring] + 1, top, False
        return count[len(word) % ring], best[len(word) % ring]


def split(text: str) -> list[str]:
    """The words of a text, each with the mark in front, that pieces never cross."""
    if not text:
        return []
    text = text.replace(" ", SPACE)
    return [SPACE + w for w in text.removeprefix(SPACE).split(SPACE)]


def count_tokens(documents: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_words and score (the sum over words) of every whole text.

    Defined cases: a null or empty text has none; repeated rows are counted each; an empty table gives no
    rows; other columns are ignored. Narrow: no shuffle. The vocabulary is a parameter of fixed size.
    """
    shared = documents.sparkSession.sparkContext.broadcast(pieces)

    def count(batch: pa.RecordBatch) -> dict:
        if _COUNTER.get("pieces") is not shared.value:
            _COUNTER.update(pieces=shared.value, counter=UnigramCounter(shared.value))
        counter = _COUNTER["counter"]
        tokens, words, scores = [], [], []
        for text in batch.column("text").to_pylist():
            found = [counter[w] for w in split(text or "")]
            tokens.append(sum(x[0] for x in found))
            words.append(len(found))
            scores.append(float(sum(x[1] for x in found)))
        return {id_col: batch.column("id"), "n_tokens": tokens, "n_words": words, "score": scores}

    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(docs, count, f"`{id_col}` {type_of(documents, id_col)}, n_tokens long, n_words long, score double")


_COUNTER: dict = {}
