"""Token counts of a unigram tokenizer without making tokens: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates the pieces that end at each character of a word; dynamic
programming carries the best score and the number of tokens of the best segmentation. Ties go the way of the
`tokenizers` library: of equally good segmentations the one whose last piece starts first wins. Words repeat, so each
task keeps the counts of words it has met, up to a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_measured

#: Where the public vocabularies are; a parameter of the operator.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a task remembers at most, and the longest of them in characters.
MEMORY, MEMORY_WORD = 500_000, 64


def vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, in order of their ids."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_proto=Path(path).read_bytes())
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class Counter(dict):
    """Word (without its leading mark) to its number of tokens, worked out when first met."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: str = "<unk>"):
        super().__init__()
        self.automaton, self.unknown = ahocorasick.Automaton(), unknown
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score, piece == unknown))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        #: With a piece for each byte, an unknown character is as many tokens as it has bytes; else runs are one token.
        self.bytes = all(f"<0x{i:02X}>" in names for i in range(256))
        self.worst = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.ring = max((len(p) for p in names), default=0) + 2

    def __missing__(self, word: str) -> int:
        n = self.tokens(META + word)
        if len(word) <= MEMORY_WORD:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = n
        return n

    def tokens(self, word: str) -> int:
        """Tokens of the best segmentation. The automaton reports matches by their end, the longest, which starts first, before shorter ones.

        What is known of the last `ring` ends is enough, as no piece is longer; so a long word takes no more room."""
        size, ring = len(word), self.ring
        best, count = [0.0] * ring, [0] * ring
        # of a run of unknowns that ends here: where it starts (-1: none ends here), the tokens before it, its bytes
        run, before, width = [-1] * ring, [0] * ring, [0] * ring
        done, top, single = 0, None, False  # the end being worked on is done + 1

        def unknown(start: int, end: int) -> None:
            """Unknowns that follow each other are one text: its bytes, or one token."""
            i, k = start % ring, end % ring
            begin, base, wide = (run[i], before[i], width[i]) if run[i] >= 0 else (start, count[i], 0)
            run[k], before[k], width[k] = begin, base, wide + len(word[start:end].encode("utf-8", "surrogatepass"))
            whole = end - begin == len(self.unknown) and word[begin:end] == self.unknown
            count[k] = base + (width[k] if self.bytes and not whole else 1)

        def close() -> None:
            nonlocal done, top, single
            end = done + 1
            if not single:
                value = best[done % ring] + self.worst
                if top is None or value > top:
                    top = value
                    unknown(done, end)
            best[end % ring], done, top, single = top, end, None, False

        for last, (length, score, is_unknown) in self.automaton.iter(word) if len(self.automaton) else ():
            while done < last:
                close()
            start = last + 1 - length
            value = best[start % ring] + score
            single |= length == 1
            if top is None or value > top:
                top = value
                if is_unknown:
                    unknown(start, last + 1)
                else:
                    k = (last + 1) % ring
                    count[k], run[k] = count[start % ring] + 1, -1
        while done < size:
            close()
        return count[size % ring]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(META, " ").split(" ")
        return sum(map(self.__getitem__, words[1:] if not words[0] else words))


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]] | None = None, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """docs with `out_col` (long): the number of tokens of each whole text.

    The tokenizer: every blank becomes the mark U+2581, one is put before the text unless it starts with it, words
    begin at each mark, and each word gets the segmentation with the highest sum of scores. Null and empty texts have
    none. Other columns pass through; one named like the new one is replaced. The vocabulary, of bounded size, goes to
    the tasks with the function.
    """
    pieces = vocabulary() if pieces is None else pieces

    def measure(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(pieces)
        for column in texts:
            yield pa.array([counter.count(t.as_py()) for t in column], pa.int64())

    return with_measured(docs, F.col(text_col).cast("string"), out_col, "long", measure)


def digest(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id (null stays null), n_chars (code points; null text: 0), n_tokens. Repeated rows are
    counted one by one."""
    slim = docs.select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    return count_tokens(slim.select("doc_id", "n_chars", "text")).select("doc_id", "n_chars", "n_tokens")
