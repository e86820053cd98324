"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary. The probability of a word is the sum over all
its segmentations into pieces, by the forward algorithm; that of a text is the product over its words, of which
none counts for more than ``MOST_PER_WORD`` nats between languages.

``train`` learns the piece probabilities by expectation maximisation (forward and backward sums, no single best
segmentation) from the words of a bounded sample: at most ``SAMPLE_DOCS`` documents of each language, those of
smallest hash, whole texts, of labelled rows only. Its size is bounded by these parameters and the vocabulary.
``predict`` scores every whole text in one pass without a shuffle. A worker computes the forward sums of a word
once, for all languages together, and keeps them in a bounded table.

Words are lower-cased runs without ASCII white space, with the vocabulary's word mark before them; a run longer
than ``SPAN`` characters is scored in spans of that many. Every single character is a piece with at least a small
probability, so that every word can be scored.

Defined cases. A text that is null or has no letter is `und` with score 0, as are all texts if there is nothing to
learn from. Null languages are not learned. Equal texts get equal predictions; equal scores go to the
language first in order. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.words import WordTable, chunks, split_words, string_array, sums_by_text
from millrace.session import importable_by_workers

SAMPLE_DOCS, ROUNDS, SPAN = 150, 2, 48
#: Weight of the pieces' shares over all languages, floor of a piece's probability, and per-character factor that
#: keeps forward sums near one.
SMOOTHING, FLOOR, LIFT = 0.02, 1e-9, 12.0
#: Most that one word can speak for a language against another, in nats (numbers and keys are no language).
MOST_PER_WORD = 6.0
#: Words after which more text makes the score no surer.
SURE = 20
MARK = "▁"
_MIX = 0x9E3779B97F4A7C15


def pieces_of(path: str) -> list[str]:
    """Pieces of a sentencepiece vocabulary without control, unknown and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [model.id_to_piece(i) for i in ids]


class Pieces:
    """Finds pieces in many words at once; number 0 is a character that is no piece."""

    def __init__(self, pieces: list[str]):
        pieces = sorted({p for p in pieces if p})
        self.size = len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        self.lengths = np.array([1, *map(len, pieces)])
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        assert len(np.unique(hashes)) == len(hashes)
        # Open addressing in a table of 2^21 slots, filled round by round of displacement.
        self._keys, self._ids = np.zeros(1 << 21, np.uint64), np.zeros(1 << 21, np.int32)
        left, shift = np.arange(len(pieces)), 0
        while len(left):
            slot = self._slot(hashes[left], shift)
            _, first = np.unique(slot, return_index=True)
            free = first[self._ids[slot[first]] == 0]
            self._keys[slot[free]], self._ids[slot[free]] = hashes[left[free]], left[free] + 1
            left = np.delete(left, free)
            shift += 1
        self.probes = shift

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * _MIX + ord(c) + 1) & (1 << 64) - 1
        return h

    @staticmethod
    def _slot(hashes: np.ndarray, shift: int) -> np.ndarray:
        return ((hashes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(43)).astype(np.int64) + shift) & (1 << 21) - 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, 0 for none."""
        out = np.zeros(len(hashes), np.int32)
        for shift in range(self.probes):
            slot = self._slot(hashes, shift)
            hit = self._keys[slot] == hashes
            out[hit] = self._ids[slot[hit]]
        return out

    def spans(self, words: list[str]) -> Iterator[tuple[np.ndarray, list[list[tuple[int, np.ndarray, np.ndarray]]]]]:
        """For each length: the words' positions, and for each end the (start, rows, pieces) found there."""
        sizes = np.array([len(w) for w in words])
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            text = np.frombuffer("".join([words[i] for i in rows]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), n)
            codes = text.astype(np.uint64) + np.uint64(1)
            ends = []
            hashes: list[np.ndarray] = []  # of the text from each start to the current end
            for end in range(1, n + 1):
                hashes = [h * np.uint64(_MIX) + codes[:, end - 1] for h in hashes[-(self.longest - 1) :]] if self.longest > 1 else []
                hashes.append(codes[:, end - 1].copy())
                found = []
                for back, h in enumerate(reversed(hashes)):
                    ids = self.find(h)
                    if not back:
                        found.append((end - 1, np.arange(len(rows)), ids))
                    elif len(hit := np.flatnonzero(ids)):
                        found.append((end - 1 - back, hit, ids[hit]))
                ends.append(found)
            yield rows, ends


def marked(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Spans of at most SPAN characters of the marked words, and the number of each word's spans."""
    out, counts = [], np.ones(len(words), np.int64)
    for i, w in enumerate(words):
        text = MARK + w
        if len(text) <= SPAN:
            out.append(text)
        else:
            parts = [text[a : a + SPAN] for a in range(0, len(text), SPAN)]
            out += parts
            counts[i] = len(parts)
    return out, counts


def forward(n: int, ends: list, rows: int, chances: np.ndarray) -> list[np.ndarray]:
    """Sums over all segmentations of each prefix; `chances` (pieces, languages) hold LIFT per character."""
    sums = [np.ones((rows, chances.shape[1]))]
    for end in range(n):
        total = np.zeros((rows, chances.shape[1]))
        for start, hit, ids in ends[end]:
            if len(hit) == rows:
                total += sums[start] * chances[ids]
            else:
                total[hit] += sums[start][hit] * chances[ids]
        sums.append(total)
    return sums


def log_chances(pieces: Pieces, spans: list[str], chances: np.ndarray) -> np.ndarray:
    out = np.zeros((len(spans), chances.shape[1]))
    for at in range(0, len(spans), 20_000):
        for rows, ends in pieces.spans(spans[at : at + 20_000]):
            n = len(ends)
            out[at + rows] = np.log(forward(n, ends, len(rows), chances)[n]) - n * np.log(LIFT)
    return out


def expected(pieces: Pieces, spans: list[str], weights: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language; `weights` (spans, languages) are the spans' counts."""
    uses = np.zeros(chances.shape)
    for at in range(0, len(spans), 20_000):
        for rows, ends in pieces.spans(spans[at : at + 20_000]):
            n, m = len(ends), len(rows)
            sums = forward(n, ends, m, chances)
            after = [np.zeros((m, chances.shape[1])) for _ in range(n)] + [np.ones((m, chances.shape[1]))]
            share = weights[at + rows] / sums[n]
            for end in range(n, 0, -1):
                for start, hit, ids in ends[end - 1]:
                    step = chances[ids] * after[end][hit]
                    after[start][hit] += step
                    used = sums[start][hit] * step * share[hit]
                    for k in range(chances.shape[1]):
                        uses[:, k] += np.bincount(ids, used[:, k], len(uses))
    return uses


def fit(pieces: Pieces, words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (pieces, languages), times LIFT per character, from counts (words, languages)."""
    spans, n_spans = marked(words)
    weights = np.repeat(counts, n_spans, axis=0)
    lift = LIFT ** pieces.lengths[:, None]
    share = np.full((pieces.size, counts.shape[1]), 1 / pieces.size)
    for _ in range(rounds):
        uses = expected(pieces, spans, weights, share * lift)
        own = uses / np.maximum(uses.sum(axis=0), 1e-300)
        share = (1 - SMOOTHING) * own + SMOOTHING * own.mean(axis=1, keepdims=True) + FLOOR
    return share * lift


def train(docs: DataFrame, vocabulary: str, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their piece probabilities, from labelled rows (doc_id, text, lang)."""
    ids = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", F.xxhash64(F.col("doc_id"), F.lit(17)).alias("_h"))
    chosen = (
        ids.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id")))
        .filter(F.col("_k") <= sample_docs).select("doc_id", "lang").distinct()
    )
    some = docs.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"], "left_semi")
    words = some.select("lang", F.explode(F.split(F.lower("text"), "[\\x20\\x09-\\x0D]+")).alias("word")).filter("word <> ''")
    rows = words.groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    langs = sorted(set(rows.column("lang").to_pylist()))
    if not langs:
        return [], np.zeros((1, 0))
    encoded = rows.column("word").combine_chunks().dictionary_encode()
    counts = np.zeros((len(encoded.dictionary), len(langs)))
    counts[encoded.indices.to_numpy(), [langs.index(x) for x in rows.column("lang").to_pylist()]] = rows.column("n").to_numpy()
    return langs, fit(Pieces(pieces_of(vocabulary)), encoded.dictionary.to_pylist(), counts)


class Scorer:
    """Log probabilities of texts in all languages, with a bounded table of the words the worker has met."""

    def __init__(self, pieces: Pieces, chances: np.ndarray):
        self._pieces, self._chances = pieces, chances
        self._clear()
        self._table = WordTable(self._add, self._clear)

    def _clear(self) -> None:
        self._known, self._size = np.zeros((1 << 14, self._chances.shape[1])), 0

    def _add(self, words: list[str]) -> None:
        spans, n_spans = marked(words)
        found = sums_by_text(log_chances(self._pieces, spans, self._chances), n_spans)
        found = np.maximum(found, found.max(axis=1, keepdims=True) - MOST_PER_WORD)
        while self._size + len(words) > len(self._known):
            self._known = np.concatenate([self._known, np.zeros_like(self._known)])
        self._known[self._size : self._size + len(words)] = found
        self._size += len(words)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = split_words(pc.utf8_lower(pc.fill_null(texts, "")))
        codes = self._table.codes(flat)
        return sums_by_text(self._known[codes], counts), counts


_scorers: dict[tuple, Scorer] = {}


def predict(docs: DataFrame, vocabulary: str, langs: list[str], chances: np.ndarray, model_id: str) -> DataFrame:
    """doc_id, lang_pred, score for each row. Workers keep the scorer of `model_id`."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, "und"], object)
        if langs and (vocabulary, model_id) not in _scorers:
            _scorers.clear()
            _scorers[vocabulary, model_id] = Scorer(Pieces(pieces_of(vocabulary)), model.value)
        for batch in batches:
            texts, letters = string_array(batch.column("text")), batch.column("letters").to_numpy(zero_copy_only=False)
            for a, b in chunks(texts):
                best, score = np.full(b - a, len(langs)), np.zeros(b - a)
                if langs:
                    logs, n = _scorers[vocabulary, model_id].of(texts.slice(a, b - a))
                    logs = (logs - logs.max(axis=1, keepdims=True)) * (np.minimum(n, SURE) / np.maximum(n, 1))[:, None]
                    shares = np.exp(logs) / np.exp(logs).sum(axis=1, keepdims=True)
                    some = letters[a:b].astype(bool)
                    best[some], score[some] = logs.argmax(axis=1)[some], shares.max(axis=1)[some]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    spark = docs.sparkSession
    importable_by_workers(spark)
    model = spark.sparkContext.broadcast(chances)  # languages times the fixed vocabulary
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(scored, "doc_id bigint, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """True for documents that are never learned from: crc32 of the id's text is a multiple of 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out, predicted for all."""
    import uuid

    langs, chances = train(docs.filter(~held_out()), vocabulary)
    found = predict(docs, vocabulary, langs, chances, uuid.uuid4().hex)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
