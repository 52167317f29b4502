"""Token counts: a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches by their ends; the
search carries only best score and piece count per position, no back pointers.
Ties are the tokenizer's: candidates for one end are taken by their start, the
earliest first, and a later one must be strictly better. A character no piece
covers is unknown, at the least score of the vocabulary less 10; unknown
characters in a row are one piece.

Defined results: a null or empty text has no pieces and score 0; repeated rows
give repeated results; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from guardwalk.llm.arrow import map_rows

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Entries of a worker's word memory; it bounds memory, not results.
MEMORY = 400_000


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.names = {p for p, _ in pieces}
        #: Whether a space mark is a piece and only ever begins one (or follows space marks), so that words can be searched apart:
        #: no piece, and no run of unknown characters, then goes over the bound of two words.
        self.by_word = SPACE in self.names and not any(a != SPACE and b == SPACE for p in self.names for a, b in zip(p, p[1:], strict=False))
        self.memory: dict[str, tuple[int, int, float]] = {}

    def search(self, text: str) -> tuple[int, int, float]:
        """(pieces, unknown pieces, best score) of a marked text."""
        score, pieces, unknown = [0.0], [0], [0]
        run = [False]  # whether the best way to here ends in unknown characters
        open_, single = False, False

        def close() -> None:
            """The unknown character is the last candidate for an end; without any other the first."""
            nonlocal open_, single
            if not single:
                at = len(score) - 1 - open_
                s = score[at] + self.unknown
                if not open_:
                    score.append(s), pieces.append(pieces[at] + (not run[at])), unknown.append(unknown[at] + (not run[at])), run.append(True)
                elif s > score[-1]:
                    score[-1], pieces[-1], unknown[-1], run[-1] = s, pieces[at] + (not run[at]), unknown[at] + (not run[at]), True
            open_ = single = False

        for end, (size, gain) in self.automaton.iter(text):  # ends rise; at one end the longest, so the earliest start, is first
            while len(score) - open_ <= end:
                close()
            at = end + 1 - size
            s = score[at] + gain
            if not open_:
                score.append(s), pieces.append(pieces[at] + 1), unknown.append(unknown[at]), run.append(False)
                open_ = True
            elif s > score[-1]:
                score[-1], pieces[-1], unknown[-1], run[-1] = s, pieces[at] + 1, unknown[at], False
            if size == 1:
                single = True
        while len(score) - open_ <= len(text):
            close()
            if len(score) > len(text):
                break
        return pieces[-1], unknown[-1], score[-1]

    def count(self, text: str) -> tuple[int, int, float]:
        if not text:
            return 0, 0, 0.0
        if not self.by_word:
            return self.search(SPACE + text.replace(" ", SPACE))
        text = text.replace(SPACE, " ")  # a mark in the text is taken for a space
        pieces = unknown = 0
        total = 0.0
        get = self.memory.get
        gap = ""
        for word in text.split(" "):
            if not word:  # a longer run of spaces goes with the word behind it
                gap += SPACE
                continue
            key = gap + word
            gap = ""
            found = get(key)
            if found is None:
                found = self.search(SPACE + key)
                if len(self.memory) >= MEMORY:
                    self.memory.clear()
                if len(key) < 40:
                    self.memory[key] = found
            pieces += found[0]
            unknown += found[1]
            total += found[2]
        if gap:
            a, b, s = self.search(gap)
            pieces, unknown, total = pieces + a, unknown + b, total + s
        return pieces, unknown, total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per worker process, from the ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return Counter([(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))])


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces, unknown pieces and best score of every whole text."""

    def make():
        c = counter(path)

        def one(doc_id, text):
            n, unknown, score = c.count(text or "")
            return doc_id, len(text or ""), n, unknown, score

        return one

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs, [docs[id_col], docs[text_col]], f"doc_id {kind}, n_chars long, n_pieces long, n_unknown long, best_score double", make)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
