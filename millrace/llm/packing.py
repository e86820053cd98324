"""Best-fit packing of token sequences by bin completion with branch and bound.

``tokenize`` turns each whole text into ids (plus an end id) and cuts what is longer than the capacity.
``plan`` packs the histogram of piece lengths. Pieces of one length are interchangeable, so the problem has
at most ``capacity`` distinct sizes however many documents there are, and a filling found once is used as
often as its lengths last. ``assign`` gives every piece the slot of its rank within its length.

Planning. Best-fit decreasing gives the incumbent. Then bins are completed around the largest length left:
undominated fillings of the rest (a single length, pairs that fill more, and the fullest of any number of pieces, alone
and beside each of the longest) are tried from the least waste up, depth first, and a branch is cut when its waste
exceeds what the incumbent allows. First the lower bound (total size, or Martello and Toth's L2) is tried, then one
sequence less than the incumbent, again and again. A search that has not ended after a number of nodes, which is a
parameter, leaves the best plan found.

Scale. Only the histogram (at most ``capacity`` rows) reaches the driver. Ranks are counted within (length,
salt), where a length gets a salt for every ``PER_SALT`` pieces, so that no task sorts a hot length. The
plan that workers get is bounded by the number of distinct lengths.

Defined cases. A null or empty text is the end id alone. Equal rows are pieces of their own. Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.words import WordTable, chunks, split_words, string_array, sums_by_text
from millrace.session import importable_by_workers, written

CAPACITY, END_ID, NODES, PER_SALT = 2048, 0, 4_000, 50_000
#: Parts of words whose ids a worker remembers.
PARTS = 100_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


#: Words of these characters are cut without the tokenizer's own, much slower, normalizer and splitter.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\\[-`{-~]+")
_PARTS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")


class WordIds:
    """The ids of words, for one tokenizer that treats white space as a border.

    If the tokenizer lower-cases, splits letters, digits and other signs, and then uses byte-level BPE, plain
    words go straight to its model; all others, and all words of other tokenizers, go through it as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model, self._letters = self._tokenizer.model, _byte_letters()
        probe = ["Ab", "ÀÿßØ", "a,!b", "x1.", "12", "|", "a-b_c", "($%&", "ÉÉ3é?"]
        self._parts: dict[str, list[int]] = {}
        try:
            self._direct = all(self._plain(x) == self._tokenizer.encode(x, add_special_tokens=False).ids for x in probe)
        except Exception:  # a model that knows no such characters
            self._direct = False
        self._clear()
        self._table = WordTable(self._add, self._clear)

    def _plain(self, word: str) -> list[int]:
        ids: list[int] = []
        parts, letters = self._parts, self._letters
        for part in _PARTS.findall(word.lower()):
            known = parts.get(part)
            if known is None:
                known = [x.id for x in self._model.tokenize(part if part.isascii() else "".join([letters[b] for b in part.encode()]))]
                if len(parts) >= PARTS:
                    parts.clear()
                parts[part] = known
            ids += known
        return ids

    def _clear(self) -> None:
        self._ids, self._ends = np.zeros(1 << 20, np.int32), np.zeros(1 << 16, np.int64)
        self._words, self._size = 0, 0
        self._parts.clear()

    def _add(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            found = [self._plain(x) if self._direct and _PLAIN.fullmatch(x) and "<|" not in x else None for x in some]
            rest = [i for i, x in enumerate(found) if x is None]
            for i, x in zip(rest, self._tokenizer.encode_batch_fast([some[i] for i in rest], add_special_tokens=False), strict=True):
                found[i] = x.ids
            ids = np.fromiter(itertools.chain.from_iterable(found), np.int32)
            ends = self._size + np.cumsum([len(x) for x in found])
            while self._size + len(ids) > len(self._ids):
                self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
            while self._words + len(ends) + 1 > len(self._ends):
                self._ends = np.concatenate([self._ends, np.zeros_like(self._ends)])
            self._ids[self._size : self._size + len(ids)] = ids
            self._ends[self._words + 1 : self._words + 1 + len(ends)] = ends
            self._size += len(ids)
            self._words += len(ends)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and the number of ids of each."""
        flat, counts = split_words(texts)
        if self._direct and not pc.any(pc.match_substring(flat, "<|")).as_py():  # names of special ids are as they are
            flat = pc.ascii_lower(flat)
        codes = self._table.codes(flat)
        starts, lengths = self._ends[codes], self._ends[codes + 1] - self._ends[codes]
        shift = starts - (np.cumsum(lengths) - lengths)
        ids = self._ids[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]
        return ids, sums_by_text(lengths, counts)


_loaded: dict[str, WordIds] = {}


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = WordIds(tokenizer)
        words = _loaded[tokenizer]
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, doc_ids = string_array(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in chunks(texts):
                ids, counts = words.of(texts.slice(a, b - a))
                raw = ids.astype("<u4").tobytes()
                out, at = [], 0
                for doc_id, n in zip(doc_ids[a:b], counts.tolist(), strict=True):
                    for piece, start in enumerate(range(0, n + 1, capacity)):
                        stop = min(start + capacity, n + 1)
                        crc = zlib.crc32(raw[4 * (at + start) : 4 * (at + min(stop, n))])
                        out.append((doc_id, piece, start, stop - start, zlib.crc32(end, crc) if stop > n else crc))
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    importable_by_workers(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


Pattern = tuple[tuple[int, ...], int]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of total size and Martello and Toth's L2."""
    lengths = sorted(counts)
    best = -(-sum(x * n for x, n in counts.items()) // capacity)
    for k in [0, *(x for x in lengths if x <= capacity // 2)]:
        big = sum(counts[x] for x in lengths if x > capacity - k)
        mid = [x for x in lengths if capacity // 2 < x <= capacity - k]
        free = sum((capacity - x) * counts[x] for x in mid)
        small = sum(x * counts[x] for x in lengths if k <= x <= capacity // 2)
        best = max(best, big + sum(counts[x] for x in mid) + max(0, -(-(small - free) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: equal bins are filled together."""
    open_bins: dict[int, list[Pattern]] = {}
    rests: list[int] = []

    def put(items: tuple[int, ...], many: int) -> None:
        if many:
            rest = capacity - sum(items)
            if rest not in open_bins:
                open_bins[rest] = []
                rests.insert(bisect_left(rests, rest), rest)
            open_bins[rest].append((items, many))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rests, length)
            if at == len(rests):
                each = capacity // length
                put((length,) * each, left // each)
                put((length,) * (left % each), 1 if left % each else 0)
                break
            rest = rests[at]
            items, many = open_bins[rest].pop()
            if not open_bins[rest]:
                del open_bins[rest], rests[at]
            each = rest // length
            full = min(many, left // each)
            put(items + (length,) * each, full)
            left -= full * each
            if full < many:
                part = min(left, each - 1)
                put(items + (length,) * part, 1)
                put(items, many - full - 1)
                left -= part
    return [pattern for group in open_bins.values() for pattern in group]


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> tuple[int, ...]:
    """A filling of `room` of the largest sum that any number of pieces can have; of these, one of long pieces.

    Sums that can be reached are the bits of a number; lengths join from the longest down until `room` itself is reached.
    """
    mask, reach, taken = (1 << (room + 1)) - 1, 1, []
    for x in reversed(lengths[: bisect_right(lengths, room)]):
        left, many = min(counts[x], room // x), 1
        while left:
            many = min(many, left)
            taken.append((reach, x, many))
            reach |= (reach << (many * x)) & mask
            left -= many
            many *= 2
        if reach >> room:
            break
    total, found = reach.bit_length() - 1, []
    for before, x, many in reversed(taken):
        if not before >> total & 1:
            found += [x] * many
            total -= many * x
    return tuple(sorted(found, reverse=True))


def fillings(lengths: list[int], counts: dict[int, int], room: int, most: int = 6) -> list[tuple[int, ...]]:
    """Undominated fillings of `room`, by waste: the largest single, the pairs that fill more, the fullest of any number,
    and the fullest beside each of the longest pieces."""
    fit = lengths[: bisect_right(lengths, room)]
    if not fit:
        return [()]
    single = fit[-1]
    found = {(single,)}
    if single < room:
        sizes = np.array(fit)
        seconds = np.searchsorted(sizes, room - sizes, "right") - 1
        ok = seconds >= 0
        ok[ok] &= sizes[seconds[ok]] <= sizes[ok]
        same = ok & (sizes[seconds] == sizes)
        ok &= ~same | (np.array([counts[x] for x in fit]) > 1)
        sums = np.where(ok, sizes + sizes[seconds], 0)
        order = np.argsort(-sums, kind="stable")[:most]
        found |= {(fit[i], fit[seconds[i]]) for i in order if sums[i] > single}
        best = fullest(fit, counts, room)
        found.add(best)
        for x in fit[: -most - 1 : -1]:
            counts[x] -= 1
            inside = [y for y in fit[: bisect_right(fit, min(x, room - x))] if counts[y]]
            found.add((x, *fullest(inside, counts, room - x)))
            counts[x] += 1
    return sorted(found, key=lambda f: (room - sum(f), len(f), [-x for x in f]))[:most]


def complete(counts: dict[int, int], capacity: int, target: int, nodes: int) -> list[Pattern] | None:
    """A packing in at most `target` bins by bin completion, or None if none was found within `nodes` nodes."""
    left, allowed = dict(counts), target * capacity - sum(x * n for x, n in counts.items())
    lengths = sorted(left)
    # A frame: [choices, index, filling in use, bins it was used for, waste so far]
    stack: list[list] = []
    wasted = 0
    while nodes > 0:
        nodes -= 1
        if not lengths:
            return [(frame[2], frame[3]) for frame in stack]
        largest = lengths[-1]
        left[largest] -= 1  # while its company is sought
        inside = lengths if left[largest] else lengths[:-1]
        choices = [(largest, *f) for f in fillings(inside, left, capacity - largest)]
        left[largest] += 1
        stack.append([choices, -1, (), 0, wasted])
        while stack:
            frame = stack[-1]
            for x in frame[2]:
                if not left.get(x):
                    lengths.insert(bisect_left(lengths, x), x)
                left[x] = left.get(x, 0) + frame[3]
            frame[1] += 1
            frame[2], frame[3] = (), 0
            if frame[1] >= len(frame[0]):
                stack.pop()
                continue
            chosen = frame[0][frame[1]]
            need = {x: chosen.count(x) for x in chosen}
            many = min(left[x] // n for x, n in need.items())
            waste = frame[4] + many * (capacity - sum(chosen))
            if many and waste > allowed:
                many = (allowed - frame[4]) // max(1, capacity - sum(chosen))
                waste = frame[4] + many * (capacity - sum(chosen))
            if many <= 0:
                continue
            frame[2], frame[3], wasted = chosen, many, waste
            for x, n in need.items():
                left[x] -= n * many
            # a length that stands twice in a filling is given back once for each
            lengths = [x for x in lengths if left[x] > 0]
            break
        if not stack:
            return None
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """Fillings and how often each is used; uses all of `counts`."""
    counts = {x: n for x, n in counts.items() if n}
    incumbent = best_fit(counts, capacity)
    used, bound = sum(n for _, n in incumbent), lower_bound(counts, capacity)
    # The bound at once, then the incumbent one sequence at a time.
    for target in (bound, None):
        while used > bound:
            better = complete(counts, capacity, used - 1 if target is None else target, nodes // 2)
            if better is None:
                break
            incumbent, used = better, sum(n for _, n in better)
    return incumbent


def slots(patterns: list[Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length and first rank), first sequence and offset of each place in the patterns."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for items, many in patterns:
        offset = 0
        for x in items:
            rows.append(((x << 44) + rank.get(x, 0), sequence, offset))
            rank[x] = rank.get(x, 0) + many
            offset += x
        sequence += many
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def assign(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """`pieces` (a written table) with sequence_id and offset."""
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    keys, sequences, offsets = slots(plan(counts, capacity, nodes))
    hot = {x: -(-n // PER_SALT) for x, n in counts.items() if n > PER_SALT}
    salts = F.lit(1)
    if hot:
        salts = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for pair in hot.items() for v in pair)), F.col("length").cast("int")), F.lit(1))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts.cast("bigint")))
    before = (
        salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
        .select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    )
    ranked = (
        salted.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")))
        .join(before, ["length", "_salt"])
        .withColumn("_rank", F.col("_before") + F.col("_row") - 1)
        .select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = (batch.column("length").to_numpy() << 44) + batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, wanted, "right") - 1
            columns = [batch.column(i) for i in range(5)]
            columns += [pa.array(sequences[at] + wanted - keys[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    importable_by_workers(pieces.sparkSession)
    return ranked.mapInArrow(place, f"{PIECES}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, nodes: int = NODES) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return assign(written(tokenize(docs, tokenizer, capacity, end_id), "pieces"), capacity, nodes)
