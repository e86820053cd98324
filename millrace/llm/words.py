"""Words of texts in Python workers: split in Arrow, numbered through a bounded table of known words.

A worker meets the same words again and again. ``WordTable`` keeps those it has seen in one Arrow array and
computes what belongs to a word only when it first meets it; when the table is full it starts anew, so its
memory is bounded however many words the corpus has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split at once, and words that a table holds.
CHUNK_BYTES, TABLE_WORDS = 8 << 20, 1_000_000


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of `texts` of at most CHUNK_BYTES together, or of one longer text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > CHUNK_BYTES:
            yield start, i
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield start, len(sizes)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without ASCII white space) in order, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    full = np.asarray(pc.binary_length(flat)) > 0
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    before = np.concatenate([[0], np.cumsum(full)])
    counts = before[offsets[1:]] - before[offsets[:-1]]
    return (flat if full.all() else flat.filter(pa.array(full))), counts


class WordTable:
    """Numbers words; `add` gets the new ones as a list and is told to `reset` before numbering starts anew."""

    def __init__(self, add: Callable[[list[str]], None], reset: Callable[[], None], most: int = TABLE_WORDS):
        self._add, self._reset, self._most = add, reset, most
        self._words = pa.array([], pa.string())

    def codes(self, flat: pa.Array) -> np.ndarray:
        """A number below the table's size for each word."""
        if not len(flat):
            return np.zeros(0, np.int64)
        encoded = flat.dictionary_encode()
        words = encoded.dictionary
        known = pc.fill_null(pc.index_in(words, value_set=self._words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if (known < 0).any():
            if len(self._words) and len(self._words) + int((known < 0).sum()) > self._most:
                self._reset()
                self._words = pa.array([], pa.string())
                known[:] = -1
            fresh = words.filter(pa.array(known < 0))
            self._add(fresh.to_pylist())
            known[known < 0] = len(self._words) + np.arange(len(fresh))
            self._words = pa.concat_arrays([self._words, fresh])
        return known[encoded.indices.to_numpy(zero_copy_only=False)]


def string_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of Arrow's `string` type."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if column.type == pa.string() else column.cast(pa.string())


def sums_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive `counts` of `values` (by the first axis); a text's sum depends on its values alone."""
    out = np.zeros((len(counts), *values.shape[1:]), values.dtype)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0)
    return out
