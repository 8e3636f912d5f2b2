"""Operator 2: token counts of a unigram tokenizer by dynamic programming over a trie.

The count of a word is the number of pieces of its best segmentation. The best score of a prefix depends on the prefix alone, so
distinct words are put in a trie and each node's score is computed once, from the pieces that end there; a
word's count is stored at its terminal. The trie is walked in sorted order with one path in memory. Words, not occurrences, cost
anything; what a worker remembers of earlier batches is bounded.

Pieces are those of a public vocabulary file and are scored by rank: the logarithm of Zipf's law. The best segmentation has the
largest sum of scores, then the fewest pieces. A character without a piece counts one token per byte of UTF-8, each below the worst piece.

Defined cases: null and empty texts have no tokens; words are runs of characters other than ASCII white space; other columns are not
read; rows that repeat are counted alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from cardwatch.llm.text import table

MARK = "▁"  # stands for the white space before a word
REMEMBERED = 500_000
ROWS = 500


class Pieces:
    """Scores of pieces, and for every ending of a piece its score or None, so that looking for longer pieces can stop early."""

    def __init__(self, ranked: list[str]):
        self.score: dict[str, float] = {}
        for rank, piece in enumerate(ranked):
            self.score.setdefault(piece, -math.log(rank + 2))
        self.byte = (min(self.score.values()) if self.score else 0.0) - 1.0
        self.endings: dict[str, float | None] = {}
        for piece, score in self.score.items():
            self.endings[piece] = score
            for i in range(1, len(piece)):
                self.endings.setdefault(piece[i:], self.score.get(piece[i:]))

    @classmethod
    def of_model(cls, path: str) -> Pieces:
        """Ordinary pieces of a sentencepiece file, in order of their ids."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        return cls([model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)])

    def counts(self, words: list[str]) -> dict[str, int]:
        """Tokens of each distinct word."""
        endings, byte = self.endings, self.byte
        found: dict[str, int] = {}
        before, best, tokens = "", [0.0], [0]
        for word in sorted(words):
            text = MARK + word
            shared, limit = 0, min(len(before), len(text))
            while shared < limit and before[shared] == text[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                size = len(text[end - 1].encode("utf-8", "surrogatepass"))
                top, least = best[end - 1] + size * byte, tokens[end - 1] + size
                for start in range(end - 1, -1, -1):
                    score = endings.get(text[start:end], 0.0)
                    if score == 0.0:  # no piece ends like this
                        break
                    if score is not None:
                        total, n = best[start] + score, tokens[start] + 1
                        if total > top or total == top and n < least:
                            top, least = total, n
                best.append(top)
                tokens.append(least)
            found[word] = tokens[-1]
            before = text
        return found


_PIECES: dict[str, Pieces] = {}
_KNOWN: dict[str, dict[str, int]] = {}


def _words(text: str) -> list[str]:
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every row of docs (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _PIECES:
            _PIECES[model], _KNOWN[model] = Pieces.of_model(model), {}
        pieces, known = _PIECES[model], _KNOWN[model]
        for batch in batches:
            n_words, n_tokens = [], []
            for a in range(0, batch.num_rows, ROWS):
                texts = [_words(t) if t else [] for t in batch.column("text").slice(a, ROWS).to_pylist()]
                if len(known) > REMEMBERED:
                    known.clear()
                known.update(pieces.counts([w for w in set().union(*texts) if w not in known]))
                n_words += map(len, texts)
                n_tokens += [sum(map(known.__getitem__, t)) for t in texts]
            made = [pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n_words", "n_tokens"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long"
    return docs.select("doc_id", "text").mapInArrow(count, schema)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
