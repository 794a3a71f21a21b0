"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton of the vocabulary gives all pieces that end at each character, longest first; dynamic programming
carries the best score and the number of pieces of that path alone, so no path is kept or walked back. The rules are those of
the ``tokenizers`` library's Unigram model with byte fallback after Metaspace splitting: scores add from the left in 64 bits;
on a tie the piece that starts first stays; a character that no piece of length one covers may be unknown, at the least score
less 10, and then counts its UTF-8 bytes.

Texts are counted whole. A word's count is kept in a bounded table of each worker. A null or empty text has no tokens; repeated rows
are counted each; an empty table gives an empty one; other columns, under any names, are carried along.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_FILE = "piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
KEPT = 300_000
KEPT_LENGTH = 64


def pieces(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece file, by id."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


class Counter:
    def __init__(self, vocab: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        held = {p for p, _ in vocab}
        self.fallback = all(f"<0x{b:02X}>" in held for b in range(256))
        counter = self

        class Kept(dict):
            def __missing__(self, word: str) -> tuple[int, float]:
                found = counter.best(SPACE + word)
                if len(word) <= KEPT_LENGTH:
                    if len(self) >= KEPT:
                        self.clear()
                    self[word] = found
                return found

        self.kept = Kept()

    def best(self, word: str) -> tuple[int, float]:
        """Number of tokens and score of the best path through a word."""
        n = len(word)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        run = [False] * (n + 1)  # the best path ends in an unknown character
        unknown, done = self.unknown, 0

        def missing(upto: int) -> None:
            nonlocal done
            while done < upto:  # nothing ends there: an unknown character
                add(done)
                done += 1

        def add(i: int) -> None:
            fresh = len(word[i].encode()) if self.fallback else int(not run[i])
            score[i + 1], count[i + 1], run[i + 1] = score[i] + unknown, count[i] + fresh, True

        ended, single = -1, True
        for at, (length, value) in self.automaton.iter(word):
            end = at + 1
            if end != ended:
                if ended >= 0 and not single and score[ended - 1] + unknown > score[ended]:
                    add(ended - 1)
                missing(at)
                done = ended = end
                single = False
                score[end] = None
            start = end - length
            got = score[start] + value
            if score[end] is None or got > score[end]:
                score[end], count[end], run[end] = got, count[start] + 1, False
            single = single or length == 1
        if ended >= 0 and not single and score[ended - 1] + unknown > score[ended]:
            add(ended - 1)
        missing(n)
        return count[n], score[n]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:
            del words[0]
        found = list(map(self.kept.__getitem__, words))
        return sum(f[0] for f in found), sum(f[1] for f in found)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


@functools.lru_cache(2)
def counter(path: str | None = None) -> Counter:
    return Counter(pieces(path or default_path()))


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens and best_score (the sum of the pieces' scores on the best path), in place of any of these names."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c not in ("n_tokens", "best_score")]).alias("_row"), docs[text].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [c.count(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.float64())], names=["_row", "n_tokens", "best_score"])
        c.kept.clear()  # an idle worker holds no words

    row = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(run, f"_row {row}, n_tokens long, best_score double").select("_row.*", "n_tokens", "best_score")
