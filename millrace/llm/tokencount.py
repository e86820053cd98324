"""Token counts by a unigram model: forward scores over a trie of pre-tokens, once for each shared prefix.

The pieces are a fixed public vocabulary; its order stands for frequency, so a piece of rank r gets the score
``-log(r + 2.7)`` (Zipf and Mandelbrot's rule) in whole micro-nats, which makes sums exact. A pre-token is a run
without ASCII white space with the vocabulary's word mark before it. Its token count is that of its best
segmentation: the highest total score, and of equal ones that with the fewest tokens. A character that is no
piece counts as its UTF-8 bytes, each with the score ``UNKNOWN``.

Distinct pre-tokens are inserted in order into a trie, of which only the path to the last one is held: the scores
of a prefix are computed when its node is made and serve all pre-tokens below it. The terminal count of each
pre-token goes to a bounded table of the worker; texts are then sums over the table.

Scale. One narrow pass over the texts, no shuffle. Memory is bounded by the table and the longest pre-token.

Defined cases. A null or empty text has no pre-token and no token. Equal rows give equal rows. Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.words import WordTable, chunks, split_words, string_array, sums_by_text
from millrace.session import importable_by_workers

MARK = "▁"
UNKNOWN = -round(1e6 * math.log(1e6))


def piece_scores(path: str) -> dict[str, int]:
    """Pieces of a sentencepiece vocabulary with their scores; control, unknown and byte pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return {model.id_to_piece(i): -round(1e6 * math.log(rank + 2.7)) for rank, i in enumerate(ids)}


class Trie:
    """Terminal counts of pre-tokens; `count` takes sorted pre-tokens and makes the nodes of each prefix once."""

    def __init__(self, scores: dict[str, int]):
        self._scores = scores
        self._longest = max(map(len, scores), default=1)
        self.nodes = 0

    def count(self, ordered: list[str]) -> list[int]:
        scores, longest = self._scores, self._longest
        # State of the nodes on the path: best score, and its number of tokens, of the prefix that ends there.
        best, tokens, path, out = [0], [0], "", []
        for word in ordered:
            text = MARK + word
            shared, most = 0, min(len(path), len(text))
            while shared < most and path[shared] == text[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                size = len(text[end - 1].encode())
                top, few = best[end - 1] + size * UNKNOWN, tokens[end - 1] + size
                for start in range(max(0, end - longest), end):
                    score = scores.get(text[start:end])
                    if score is not None:
                        score += best[start]
                        if score > top or score == top and tokens[start] + 1 < few:
                            top, few = score, tokens[start] + 1
                best.append(top)
                tokens.append(few)
            self.nodes += len(text) - shared
            path = text
            out.append(tokens[-1])
        return out


class TokenCounts:
    """Token counts of texts, with a bounded table of the pre-tokens that the worker has met."""

    def __init__(self, path: str):
        self.trie = Trie(piece_scores(path))
        self._clear()
        self._table = WordTable(self._add, self._clear)

    def _clear(self) -> None:
        self._counts, self._size = np.zeros(1 << 16, np.int64), 0

    def _add(self, words: list[str]) -> None:
        order = sorted(range(len(words)), key=words.__getitem__)
        while self._size + len(words) > len(self._counts):
            self._counts = np.concatenate([self._counts, np.zeros_like(self._counts)])
        self._counts[self._size + np.array(order, np.int64)] = self.trie.count([words[i] for i in order])
        self._size += len(words)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each text."""
        flat, n_words = split_words(texts)
        codes = self._table.codes(flat)
        return n_words, sums_by_text(self._counts[codes], n_words)


_loaded: dict[str, TokenCounts] = {}


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for each row of `docs`."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _loaded:
            _loaded[vocabulary] = TokenCounts(vocabulary)
        for batch in batches:
            texts = string_array(batch.column("text"))
            for a, b in chunks(texts):
                words, tokens = _loaded[vocabulary].of(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(words), pa.array(tokens)], names=["doc_id", "n_pretokens", "n_tokens"])

    importable_by_workers(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(counted, "doc_id bigint, n_pretokens bigint, n_tokens bigint")
