"""Long repeats: removes every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere.

Exact, by a run-length index over what can repeat:

1. Anchors. Every window of LENGTH bytes has a smallest hash among its GRAM-byte substrings. Equal windows have equal
   anchors, so the windows that share one (its territory) can only repeat in territories of the same anchor hash.
   A row for each territory, about one in 170 bytes, has that hash and a hash of all its bytes.
2. An anchor hash that occurs once settles its windows: they do not repeat. A territory that occurs twice or more as
   a whole repeats as a whole. What is left are different territories with one anchor hash.
3. Index. Their bytes, one copy of each, meet by anchor hash. Each task builds the Burrows-Wheeler transform of its
   bytes, compresses it to runs and samples the suffix array at run ends. Only at sampled positions is the length of
   the match with the neighbouring suffix compared; between samples it falls by one with each byte, so matching
   statistics stream over the text from the samples alone. Windows whose match is at least LENGTH repeat.
4. Spans of all repeating windows join the texts, and the bytes outside them stay.

Passages. Strings are counted in bytes and removed; passages of ``PASSAGE`` words or more that another document has
too, at whatever length in bytes, are only counted (``n_passage_words``). They take the same way, with hashes of words
(runs without ASCII white space) in the place of bytes and hashes of windows in the place of the index.

Scale. Text moves once, to cut the territories of step 3 and to remove spans; all else are rows of hashes, and the
written tables of them are deleted once the next one is there. A task of step 3 indexes ``INDEX_BYTES`` at a time. An
anchor hash of more than ``MANY`` territories is settled by hashes of its windows in the task instead of by the index,
and one of more than ``VERY_MANY`` (a fiftieth of it for words) is first split by the distance of windows from the anchor
over several tasks. All of these are exact.

Defined cases. Null texts are empty bytes. Rows of equal id and text are documents of their own and repeat each other;
for passages they are one document.
Other columns are ignored. Texts under LENGTH bytes lose nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import drop_written, importable_by_workers, shared_folder, written

LENGTH, GRAM = 400, 64
#: Words of a passage, words hashed together, and bytes from which a word's hash is xxh3's.
PASSAGE, WORD_GRAM, LONG_WORD = 51, 8, 1024
#: Bytes hashed at once (arrays that stay in the processor's cache) and sent at once; bytes in an index, and territories
#: of one anchor for the index, and for one task.
CHUNK, SENT, INDEX_BYTES, MANY, VERY_MANY, BAND = 1 << 16, 4 << 20, 1 << 17, 400, 50_000, 16
#: Bytes of territories in a task, and territories sent at once.
TASK_BYTES, ROWS = 8 << 20, 50_000
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def gram_hashes(symbols: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `gram` (a power of two) symbols from each position."""
    h = (symbols.astype(np.uint64) + np.uint64(1)) * _ODD[0]
    size = 1
    while size < gram:
        h = h[:-size] * _ODD[1] + h[size:] * _ODD[2]
        h ^= h >> np.uint64(29)
        h *= _ODD[3]
        size *= 2
    return h


def territories(symbols: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of documents that stand end to end: first and last window start, anchor position and hash of each territory."""
    none = np.zeros(0, np.int64)
    if len(symbols) < length:
        return none, none, none, none.astype(np.uint64)
    h = gram_hashes(symbols, gram)
    width, n = length - gram + 1, len(symbols) - length + 1
    low = np.uint64((1 << 24) - 1)
    keys = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    pad = -len(keys) % width
    blocks = np.concatenate([keys, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    anchor = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=change[1:])
    begins = np.concatenate([[0], ends[:-1]])
    change[begins[begins < n]] = True
    first = np.flatnonzero(change)
    beyond = np.concatenate([first[1:], [n]])
    final = ends[np.searchsorted(ends, first, "right")] - length  # the last window of the document
    last = np.minimum(beyond - 1, final)
    whole = first <= final
    first, last = first[whole], last[whole]
    return first, last, anchor[first], h[anchor[first]]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class WordHashes:
    """Hashes of the words of texts: polynomials of their bytes, from prefix sums."""

    def __init__(self, most: int):
        odd = int(_ODD[1])
        self._letters = gram_hashes(np.arange(256), 1)
        self._letters ^= self._letters >> np.uint64(31)
        self._powers, self._inverse = np.ones(most + 1, np.uint64), np.ones(most + 1, np.uint64)
        np.multiply.accumulate(np.full(most, odd, np.uint64), out=self._powers[1:])
        np.multiply.accumulate(np.full(most, pow(odd, -1, 1 << 64), np.uint64), out=self._inverse[1:])

    def _short(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        from xxhash import xxh3_64_intdigest

        array = np.frombuffer(raw, np.uint8)
        inside = ~_SPACE[array]
        begins = np.zeros(len(array) + 1, bool)
        begins[np.concatenate([[0], ends[:-1]])] = True  # no word crosses from one document to the next
        edge = np.zeros(len(array) + 1, np.int8)
        edge[1:-1] = inside[1:].astype(np.int8) - inside[:-1]
        start = np.flatnonzero((edge[:-1] > 0) | (begins[:-1] & inside))
        before = np.concatenate([[False], inside[:-1]])
        stop = np.flatnonzero(np.concatenate([(edge[:-1] < 0) | (begins[:-1] & before), inside[-1:]]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self._letters[array] * self._powers[: len(array)], dtype=np.uint64)])
        words = (sums[stop] - sums[start]) * self._inverse[start]
        words ^= words >> np.uint64(32)
        for i in np.flatnonzero(stop - start >= LONG_WORD).tolist():
            words[i] = xxh3_64_intdigest(raw[start[i] : stop[i]], 5)
        counts = np.searchsorted(start, ends) - np.searchsorted(start, np.concatenate([[0], ends[:-1]]))
        return words, counts

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes of all texts and the number of words of each; `texts` are at most CHUNK bytes together, or one."""
        ends = np.cumsum([len(t) for t in texts])
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
        if ends[-1] <= CHUNK:
            return self._short(b"".join(texts), ends)
        found = []
        raw, at = texts[0], 0
        from xxhash import xxh3_64_intdigest

        while at < len(raw):
            stop = at + CHUNK
            if stop < len(raw):  # back to the last white space, or on to the end of a word that is longer
                piece = raw[at:stop]
                back = max(piece.rfind(x) for x in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
                if back < 0:
                    later = _WHITE.search(raw, stop)
                    end = later.start() if later else len(raw)
                    found.append(np.array([xxh3_64_intdigest(raw[at:end], 5)], np.uint64))
                    at = end
                    continue
                stop = at + back + 1
            piece = raw[at:stop]
            found.append(self._short(piece, np.array([len(piece)]))[0])
            at = stop
        words = np.concatenate(found)
        return words, np.array([len(words)])


_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_hashes: list[WordHashes] = []


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    if not _hashes:
        _hashes.append(WordHashes(CHUNK))
    return _hashes[0].of(texts)


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > CHUNK:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


#: A territory: hash of the anchor (odd for those of words) and of all it holds, document; first window start, and how far
#: after it the last one and the anchor are, as one number.
ANCHORS = "k bigint, t bigint, rid bigint, place bigint"
#: Bits of the two distances, which are below the length of a window.
NEAR = 12


def placed() -> list[Column]:
    """lo, hi, at: what `place` holds."""
    lo = F.shiftright("place", 2 * NEAR)
    after = lambda shift: F.shiftright("place", shift).bitwiseAND(F.lit((1 << NEAR) - 1).cast("bigint"))
    return [x.cast("int").alias(n) for n, x in (("lo", lo), ("hi", lo + after(NEAR)), ("at", lo + after(0)))]


def _found(symbols: np.ndarray, ends: np.ndarray, rids: np.ndarray, shift: int, length: int, gram: int) -> list[np.ndarray]:
    """The columns of ANCHORS for territories in documents end to end, or (with `shift`) in a part of one."""
    from xxhash import xxh3_64_intdigest

    lo, hi, at, k = territories(symbols, ends, length, gram)
    raw = symbols.tobytes()
    doc = np.searchsorted(ends, lo, "right")
    begin = (ends - np.diff(ends, prepend=0))[doc] - shift
    size, odd = symbols.itemsize, np.uint64(symbols.itemsize > 1)
    t = np.fromiter((xxh3_64_intdigest(raw[x:y], 5) for x, y in zip((lo * size).tolist(), ((hi + length) * size).tolist(), strict=True)), np.uint64, len(lo))
    k = (k & ~np.uint64(1)) | odd
    return [k.view(np.int64), t.view(np.int64), rids[doc], ((lo - begin) << (2 * NEAR)) | ((hi - lo) << NEAR) | (at - lo)]


def _joined(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["k", "t", "rid", "place"])


def anchors(rows: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """rid, text -> a row for each territory of windows of `length` bytes and of `passage` words."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            texts, rids = batch.column("text").to_pylist(), np.array(batch.column("rid").to_pylist(), np.int64)
            whole = [t.encode() for t in texts]
            for a, b in _parts([len(t) for t in whole]):
                some, ids = whole[a:b], rids[a:b]
                words, counts = word_hashes(some)
                both = ((np.frombuffer(b"".join(some), np.uint8), np.cumsum([len(t) for t in some]), length, GRAM), (words, np.cumsum(counts), passage, WORD_GRAM))
                for symbols, ends, window, gram in both:
                    if len(symbols) <= CHUNK:
                        pieces = [(0, symbols, ends)]
                    else:  # one very long text, in windows of a part each
                        cuts = range(0, len(symbols), CHUNK)
                        pieces = [(s, x, np.array([len(x)])) for s in cuts for x in [symbols[s : s + CHUNK + window - 1]]]
                    for shift, x, stops in pieces:
                        rows = _found(x, stops, ids, shift, window, gram)
                        held.append(rows)
                        size += len(rows[0])
                        if size >= ROWS:
                            yield _joined(held)
                            held, size = [], 0
            if size:
                yield _joined(held)

    importable_by_workers(rows.sparkSession)
    return rows.mapInArrow(found, ANCHORS)


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """By prefix doubling; the last of `symbols` occurs once. Also the ranks by each number of first symbols on the way.

    A rank is the place of the first of those that are equal so far, so each round sorts only these; rank, rank of what
    follows and position are one number, so they are sorted without an index.
    """
    n = len(symbols)
    bits = n.bit_length()
    if 3 * bits > 64:
        raise ValueError("too long for one index")
    wide = (int(symbols.max()) + 1).bit_length()
    size = max(1, (64 - bits) // wide)
    padded = np.concatenate([symbols.astype(np.uint64) + np.uint64(1), np.zeros(size, np.uint64)])
    key = padded[:n].copy()
    for k in range(1, size):
        key = (key << np.uint64(wide)) | padded[k : n + k]
    bits = np.uint64(bits)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    at = np.arange(n, dtype=np.uint64)
    rank, levels, width = np.zeros(n + 1, np.uint64), [], 0  # what follows the end has rank 0
    while True:
        packed = np.sort((key << bits) | at)
        at, key = packed & mask, packed >> bits
        new = np.concatenate([[True], key[1:] != key[:-1]])
        places = np.arange(1, len(at) + 1, dtype=np.uint64)
        begins = np.maximum.accumulate(np.where(new, places, np.uint64(0)))
        if not levels:
            rank[at] = begins
        else:
            older = key >> bits
            group = np.maximum.accumulate(np.where(np.concatenate([[True], older[1:] != older[:-1]]), places, np.uint64(0)))
            rank[at] = older + (begins - group)
        width = 2 * width or size
        levels.append((width, rank.copy()))
        at = at[~(new & np.concatenate([new[1:], [True]]))]
        if not len(at):
            order = np.empty(n, np.int64)
            order[rank[:n].astype(np.int64) - 1] = np.arange(n)
            return order, levels
        key = (rank[at] << bits) | rank[np.minimum(at + np.uint64(width), np.uint64(n))]


def matching_statistics(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest string from each position that also starts at another one.

    From a run-compressed transform: matches with the neighbours in suffix order are compared at the samples of run
    ends only. Where a suffix and its neighbour are preceded by one symbol, the match from the position before is
    one longer, so between samples it falls by one with each position.
    """
    n = len(symbols)
    order, levels = suffix_array(symbols)
    transform = symbols[order - 1]  # of position 0 the last symbol, which occurs once
    borders = np.flatnonzero(transform[1:] != transform[:-1]) + 1
    starts, stops = order[np.concatenate([[0], borders])], order[np.concatenate([borders - 1, [n - 1]])]
    before = np.concatenate([[-1], order[borders - 1]])
    after = np.concatenate([order[borders], [-1]])

    def match(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        lengths = np.zeros(len(i), np.int64)
        there = j >= 0
        i, j = i[there], j[there]
        x, y = i.copy(), j.copy()
        for width, rank in reversed(levels):  # different suffixes differ in the last rank, so each step is taken once at most
            step = np.where(rank[x] == rank[y], width, 0)
            x += step
            y += step
        live = np.arange(len(x))
        while len(live):
            live = live[symbols[x[live]] == symbols[y[live]]]
            x[live] += 1
            y[live] += 1
        lengths[there] = x - i
        return lengths

    def streamed(samples: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        held = np.full(n, -1, np.int64)
        held[samples] = lengths + samples
        last = np.maximum.accumulate(np.where(held >= 0, np.arange(n), -1))
        return np.where(last < 0, 0, held[last] - np.arange(n))

    return np.maximum(streamed(starts, match(starts, before)), streamed(stops, match(stops, after)))


def repeating(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part: whether the window from each possible start also starts elsewhere in the parts, by the index."""
    # A symbol beside bytes ends a part; no window holds one.
    symbols = np.concatenate([x for p in parts for x in (np.frombuffer(p, np.uint8).astype(np.int32), np.array([256], np.int32))])
    symbols[-1] = 257
    statistics = matching_statistics(symbols)
    out, at = [], 0
    for p in parts:
        out.append(statistics[at : at + len(p) - length + 1] >= length)
        at += len(p) + 1
    return out


def repeating_hashed(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """The same for parts of one anchor, by 128-bit hashes of their windows."""
    counts = [len(p) - length + 1 for p in parts]
    digests = np.frombuffer(b"".join(hashlib.blake2b(p[s : s + length], digest_size=16).digest() for p, n in zip(parts, counts, strict=True) for s in range(n)), "S16")
    _, back, times = np.unique(digests.view("V16").view([("a", "<u8"), ("b", "<u8")]), return_inverse=True, return_counts=True)
    return np.split(times[back] > 1, np.cumsum(counts)[:-1])


def repeating_windows(parts: list[bytes], owners: list[int], several: list[bool]) -> list[np.ndarray]:
    """For parts that are window hashes: whether each window is also in a part of another owner, or in one that several have."""
    hashes = np.frombuffer(b"".join(parts), np.uint64)
    sizes = [len(p) // 8 for p in parts]
    owner, known = np.repeat(np.array(owners, np.int64), sizes), np.repeat(np.array(several, bool), sizes)
    order = np.lexsort((owner, hashes))
    ordered, by = hashes[order], owner[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    shared = (by[begins] != by[np.concatenate([begins[1:], [len(by)]]) - 1]) | np.logical_or.reduceat(known[order], begins)
    flags = np.empty(len(hashes), bool)
    flags[order] = np.repeat(shared, np.diff(np.concatenate([begins, [len(by)]])))
    return np.split(flags, np.cumsum(sizes)[:-1])


def _settle(groups: dict[int, list[int]], parts: list[bytes], owners: list[int], whole: list[bool], length: int) -> dict[int, np.ndarray]:
    """Flags of the windows of each part; groups: rows by anchor hash."""
    found: dict[int, np.ndarray] = {}
    held: list[int] = []
    size = 0

    def index() -> None:
        if held:
            found.update(zip(held, repeating([parts[i] for i in held], length), strict=True))
            held.clear()

    words = [i for key, rows in groups.items() if key & 1 for i in rows]  # equal windows have equal anchors, so all at once
    found.update(zip(words, repeating_windows([parts[i] for i in words], [owners[i] for i in words], [whole[i] for i in words]) if words else (), strict=True))
    for key, rows in groups.items():
        if key & 1:
            continue
        if len(rows) > MANY:
            found.update(zip(rows, repeating_hashed([parts[i] for i in rows], length), strict=True))
            continue
        own = sum(len(parts[i]) for i in rows)
        if held and size + own > INDEX_BYTES:
            index()
            size = 0
        held += rows
        size += own
    index()
    return found


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Ranges (first, end) that touch or overlap, as one."""
    merged: list[list[int]] = []
    for lo, hi in sorted(spans):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi])
    return merged


def remove_repeats(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_passage_words, kept (binary) for each row of `docs`.

    Steps 3 and 4 run with the result, so a caller who needs it twice should write it.
    """
    spark = docs.sparkSession
    importable_by_workers(spark)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("rid", F.xxhash64("doc_id", "text"))
    folder = shared_folder(spark)
    found = written(anchors(base.select("rid", "text"), length, passage), "anchors", folder)
    of_words = F.col("k").bitwiseAND(F.lit(1).cast("bigint")) == 1
    apart = F.min("rid") != F.max("rid")
    # Most anchors occur once: they are left out by their number alone, before anything else is compared. Written, so that
    # the join has an exchange of its own on either side, and a hot anchor is split.
    several = written(found.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("k"), "several", folder)
    repeated = written(found.join(several, "k"), "repeated", folder)
    drop_written(spark, folder, "anchors", "several")
    by_anchor = repeated.groupBy("k").agg((F.min("t") != F.max("t")).alias("mixed"), apart.alias("apart"))
    by_anchor = written(by_anchor.filter(~of_words | F.col("apart")).select("k", "mixed"), "by_anchor", folder)
    shared = repeated.join(by_anchor, "k").select("k", "t", "rid", *placed(), "mixed")
    shared = written(shared, "shared", folder)
    drop_written(spark, folder, "repeated", "by_anchor")
    kinds = shared.filter("mixed").groupBy("k", "t").agg(
        F.when(of_words, apart).otherwise(F.count(F.lit(1)) > 1).alias("whole"), F.min(F.struct("rid", "lo", "hi", "at")).alias("one")
    )
    kinds = written(kinds.select("k", "t", "whole", "one.*"), "kinds")
    # Equal territories of words in one document alone: what of them is in other documents is so at each place.
    again = shared.filter(F.col("mixed") & of_words).join(kinds.filter(of_words & ~F.col("whole")).select("k", "t", F.col("lo").alias("_lo")), ["k", "t"])
    again = again.filter("lo <> _lo").select("k", "t", F.lit(False).alias("whole"), "rid", "lo", "hi", "at")
    per_anchor = kinds.groupBy("k").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > F.when(of_words, VERY_MANY // 50).otherwise(VERY_MANY))
    hot = written(per_anchor.select("k", F.lit(True).alias("band")), "hot")
    total = kinds.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo") + length), F.lit(0)).alias("b")).first()["b"]
    tasks = max(1, -(-int(total) // TASK_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = kinds.unionByName(again).join(hot, "k", "left").select("rid", F.struct("k", "lo", "hi", "at", "whole", F.coalesce("band", F.lit(False)).alias("band")).alias("w"))
    wanted = wanted.groupBy("rid").agg(F.collect_list("w").alias("wanted"))
    # Both joins read the same columns of `base` in one query, so its exchange, which holds the texts, is made once.
    texts = base.join(wanted, "rid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_digest

        for batch in batches:
            out: list[tuple] = []
            size = 0
            seen: set[tuple] = set()  # rows of equal id and text give their territories once
            for rid, text, wanted in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                raw = text.encode()
                words = word_hashes([raw])[0].tobytes() if any(w["k"] & 1 for w in wanted) else b""
                for w in wanted:
                    lo, hi = w["lo"], w["hi"]
                    if (rid, lo, w["k"] & 1) in seen:
                        continue
                    seen.add((rid, lo, w["k"] & 1))
                    s, wide = lo, 1 if w["k"] & 1 else BAND
                    while s <= hi:  # by distance from the anchor, equal windows have equal bands
                        band = (w["at"] - s) // wide if w["band"] else 0
                        e = min(hi, w["at"] - band * wide) if w["band"] else hi
                        if w["k"] & 1:
                            part = b"".join(xxh3_64_digest(words[8 * i : 8 * (i + passage)], 5) for i in range(s, e + 1))
                        else:
                            part = raw[s : e + length]
                        out.append(((w["k"] * 31 + band) % tasks, w["k"], rid, s, w["whole"], part))
                        size += len(part)
                        s = e + 1
                if size > SENT:
                    yield _context_batch(out)
                    out, size = [], 0
            if out:
                yield _context_batch(out)

    contexts = texts.mapInArrow(cut, "bucket int, k bigint, rid bigint, lo int, whole boolean, part binary")

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by([("k", "ascending"), ("rid", "ascending"), ("lo", "ascending")])
        keys, rids, starts = (table.column(c).to_pylist() for c in ("k", "rid", "lo"))
        parts, whole = table.column("part").to_pylist(), table.column("whole").to_pylist()
        # The same territory may come from two equal rows that Spark read apart.
        unique = [i for i in range(len(keys)) if not i or (keys[i], rids[i], starts[i]) != (keys[i - 1], rids[i - 1], starts[i - 1])]
        groups: dict[int, list[int]] = {}
        for i in unique:
            groups.setdefault(keys[i], []).append(i)
        flags = _settle(groups, parts, rids, whole, length)
        out = []
        for i, flag in flags.items():
            if whole[i]:
                continue  # repeats as a whole; it is here for the others to meet
            edges = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
            out += [(rids[i], starts[i] + int(a), starts[i] + int(b) - 1, keys[i] & 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("rid", "lo", "hi", "words"), columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)})

    settled = contexts.groupBy("bucket").applyInArrow(settle, "rid bigint, lo int, hi int, words int")
    of_kind = F.when(of_words, 1).otherwise(0).alias("words")
    whole = shared.filter("NOT mixed").select("rid", "lo", "hi", of_kind).unionAll(
        shared.filter("mixed").join(kinds.filter("whole").select("k", "t"), ["k", "t"]).select("rid", "lo", "hi", of_kind)
    )
    spans = settled.unionAll(whole).groupBy("rid").agg(F.collect_set(F.struct("lo", "hi", "words")).alias("spans"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode()
                merged = _merged([(s["lo"], s["hi"] + length) for s in found or () if not s["words"]])
                words = _merged([(s["lo"], s["hi"] + passage) for s in found or () if s["words"]])
                at, kept = 0, []
                for lo, hi in merged:
                    kept.append(raw[at:lo])
                    at = hi
                out.append((doc_id, len(raw), sum(hi - lo for lo, hi in merged), len(merged), sum(hi - lo for lo, hi in words), b"".join([*kept, raw[at:]])))
            kinds = (*[pa.int64()] * 5, pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "n_passage_words", "kept"])

    joined = base.join(spans, "rid", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(removed, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, n_passage_words bigint, kept binary")


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "k", "rid", "lo", "whole", "part"])
