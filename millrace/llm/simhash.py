"""SimHash near-duplicates: 64-bit fingerprints, linked within a Hamming distance by vantage-point trees.

``fingerprints`` hashes word shingles in the Python workers and takes the majority of each bit. ``links``
finds exact pairs of distinct fingerprints within ``radius``:

* The upper levels of one vantage-point tree are fitted on a bounded sample (``SAMPLE``) and cut the space into
  shards: at each level a fingerprint goes in or out by its distance from the vantage point. By the triangle
  inequality its partners can only be across a border that is within ``radius`` of it, so it is stored in its own
  shard and asks only those other shards that its ball overlaps, and of these only the ones numbered higher.
* Each shard is searched with a tree of its own. Points within ``radius`` of a vantage point are linked to it at
  once, and pairs that are already known to be in one component are not compared again, so a crowd of near
  copies costs about its size and not its square.
* A task gives out a forest (each node and its root in the task), never all pairs of a group.

Copies are brought together before: one row for each distinct fingerprint, with its smallest id.

Scale. The tree's depth grows until a shard has at most ``SHARD`` points, and questions to a shard are dealt over
several tasks. Shards are even in distinct fingerprints, whatever the copies are.

Defined cases. Null and empty texts have fingerprint zero and are linked like any other. Equal rows share
a component. Other columns are ignored. Rows with a null id take part; a component's id is the smallest non-null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.session import importable_by_workers, written

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints that the upper tree is fitted on, points in a shard, least depth, and questions in a task.
SAMPLE, SHARD, LEAST_DEPTH, ASKED = 8192, 2_000_000, 5, 1_000_000
#: Points that are compared directly, and questions compared with them at once.
LEAF, BLOCK = 512, 512


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Of the lower-cased (A-Z) words; a bit is set if over half of the shingles' hashes have it."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    parts = [joined[a:b] for a, b in zip([0, *ends], [e - 1 for e in ends[shingle - 1 :]], strict=False)]
    ones, n = np.zeros(64, np.int64), len(parts)
    for at in range(0, n, 1 << 15):
        hashes = np.fromiter(map(xxh64_intdigest, parts[at : at + (1 << 15)], repeat(seed)), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Sums of up to 255 rows fit a byte; these are then summed.
        full = len(bits) // 255 * 255
        ones += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[full:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text) and fp (the fingerprint as a signed long) for each row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(found.view(np.int64))], names=["doc_id", "th", "fp"])

    importable_by_workers(docs.sparkSession)
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(hashed, "doc_id bigint, th bigint, fp bigint")


def _distance(points: np.ndarray, one: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ one)


Tree = list[tuple[int, int]]


def fit_tree(sample: np.ndarray, depth: int) -> Tree:
    """Vantage point and largest inner distance of each inner node, in heap order."""
    tree: Tree = []
    parts = [np.sort(sample)]
    for _ in range(depth):
        below = []
        for part in parts:
            # The point that a fixed position names; any point serves, its median halves the part.
            vantage = part[len(part) // 3] if len(part) else np.uint64(0)
            d = _distance(part, vantage)
            border = int(np.median(d)) if len(part) else 32
            tree.append((int(vantage), border))
            below += [part[d <= border], part[d > border]]
        parts = below
    return tree


def route(points: np.ndarray, tree: Tree, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own shard of each point; and (point's index, shard) for every other, higher shard that its ball overlaps."""
    own = np.zeros(len(points), np.int64)
    at, index = np.zeros(len(points), np.int64), np.arange(len(points))
    first = 0
    for level in range(depth):
        vantages = np.array([v for v, _ in tree[first : first + (1 << level)]], np.uint64)
        borders = np.array([b for _, b in tree[first : first + (1 << level)]], np.int64)
        own = 2 * own + (np.bitwise_count(points ^ vantages[own]) > borders[own])
        d = np.bitwise_count(points[index] ^ vantages[at]).astype(np.int64)
        inner, outer = d - radius <= borders[at], d + radius > borders[at]
        at = np.concatenate([2 * at[inner], 2 * at[outer] + 1])
        index = np.concatenate([index[inner], index[outer]])
        first += 1 << level
    keep = at > own[index]
    return own, index[keep], at[keep]


class Forest:
    """Labels of nodes: the smallest index of a node known to be in the same component."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def search(points: np.ndarray, asked: np.ndarray, radius: int) -> np.ndarray:
    """Labels over points, then asked: joined wherever an asked one is within `radius` of a point.

    Every pair of an asked one and a point is either compared, or ruled out by a triangle bound, or already
    in one component.
    """
    values = np.concatenate([points, asked])
    forest, n = Forest(len(values)), len(points)
    # each entry: indices of points, of asked ones
    todo = [(np.arange(n), np.arange(n, len(values)))]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        if len(p) <= LEAF:
            _compare(values, p, q, radius, forest)
            continue
        vantage = p[len(p) // 2]
        dp, dq = _distance(values[p], values[vantage]).astype(np.int64), _distance(values[q], values[vantage]).astype(np.int64)
        near_p, near_q = p[dp <= radius], q[dq <= radius]
        forest.join(near_p, np.full(len(near_p), vantage))
        forest.join(near_q, np.full(len(near_q), vantage))
        border = int(np.median(dp))
        inside = dp <= border
        if inside.all():
            border = int(dp.max()) - 1
            inside = dp <= border
        if not inside.any() or inside.all():
            _compare(values, p, q, radius, forest)
            continue
        todo.append((p[inside], q[dq - radius <= border]))
        todo.append((p[~inside], q[dq + radius > border]))
    return forest.label


def _compare(values: np.ndarray, p: np.ndarray, q: np.ndarray, radius: int, forest: Forest) -> None:
    """All of q with all of p, except where a whole block of q is in one component with a point."""
    q = q[np.argsort(forest.label[q], kind="stable")]
    for at in range(0, len(q), BLOCK):
        block = q[at : at + BLOCK]
        labels = forest.label[block]
        some = p[forest.label[p] != labels[0]] if (labels == labels[0]).all() else p
        for start in range(0, len(some), 4096):
            part = some[start : start + 4096]
            i, j = np.nonzero(np.bitwise_count(values[block][:, None] ^ values[part][None, :]) <= radius)
            if len(i):
                forest.join(block[i], part[j])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) of signed fingerprints whose components are those of all pairs within `radius`.

    `distinct` is a written table with one row for each value in `fp`.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    depth = LEAST_DEPTH
    while n >> depth > SHARD and depth < 16:
        depth += 1
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    tree = fit_tree(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), depth)
    # A question goes to some shards; how many tasks share those of a shard follows from the number of rows.
    spread = max(1, -(-4 * n // (1 << depth) // ASKED))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            own, index, shard = route(fp.view(np.uint64), tree, depth, radius)
            part = (fp.view(np.uint64) % np.uint64(spread)).astype(np.int64)
            points = [(own * spread + k, fp, np.zeros(len(fp), np.int8)) for k in range(spread)]
            asked = [(own * spread + part, fp, np.ones(len(fp), np.int8)), (shard * spread + part[index], fp[index], np.ones(len(index), np.int8))]
            key, value, kind = (np.concatenate(x) for x in zip(*points, *asked, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(value), pa.array(kind)], names=["key", "fp", "asked"])

    def searched(table: pa.Table) -> pa.Table:
        fp, asked = table.column("fp").to_numpy(), table.column("asked").to_numpy() > 0
        points, questions = np.sort(fp[~asked]), np.sort(fp[asked])
        values = np.concatenate([points, questions])
        label = search(points.view(np.uint64), questions.view(np.uint64), radius)
        a, b = values, values[label]
        apart = a != b
        return pa.table({"a": a[apart], "b": b[apart]})

    importable_by_workers(spark)
    rows = distinct.select("fp").mapInArrow(dealt, "key bigint, fp bigint, asked tinyint")
    return rows.groupBy("key").applyInArrow(searched, "a bigint, b bigint")


def _rooted(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and fp, least, root for each distinct one; both written tables."""
    hashed = written(fingerprints(docs), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("least")
    distinct = written(hashed.groupBy("fp").agg(first), "distinct")
    grouped = components(links(distinct, radius).select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = distinct.join(grouped, distinct["fp"] == grouped["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    return hashed, written(named, "roots")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for each row of `docs`."""
    hashed, named = _rooted(docs, radius)
    least = named.groupBy("root").agg(F.min("least").alias("first"))
    return hashed.join(named.join(least, "root").select("fp", F.col("first.doc_id").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`docs` with one row of each component: that of smallest id; of equal ids, that of smallest text hash."""
    hashed, named = _rooted(docs, radius)
    chosen = named.groupBy("root").agg(F.min("least").alias("first")).select(F.col("first.doc_id").alias("__mr_d"), F.col("first.th").alias("__mr_th")).distinct()
    stay = docs.withColumn("__mr_h", F.xxhash64("text")).join(chosen, F.col("doc_id").eqNullSafe(F.col("__mr_d")) & (F.col("__mr_h") == F.col("__mr_th")), "left_semi")
    if hashed.groupBy("doc_id", "th").count().filter("count > 1").limit(1).count():
        stay = stay.dropDuplicates(["doc_id", "__mr_h"])
    return stay.select(*docs.columns)
