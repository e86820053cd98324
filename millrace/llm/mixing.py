"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

Targets. Sources in order of code points (null last) have the weights 3, 1, 2, repeating, and share ``SHARE`` times
all words. A source gives at most ``MOST`` times its words; what is over is shared again by weight (``targets``
finds the level at which all of it is shared in one step).

Draws. A source's documents are dealt by hash into blocks. Whole passes take every block; the last, partial one
takes blocks in a permuted order while they fit, then documents of the next block in hash order while they fit,
then, in the same order from there on, every document that still fits into what is missing, until none does, and
last the one document of those left that brings the words nearer to the target, if any does. So what is missing at
the end is less than every document left, and what is over is less than what was missing.

Shards. The numbers of blocks drawn from each source are split down a binary tree: at each node the left half
gets a multivariate hypergeometric draw of the node's blocks, so that every output shard has an exact, random
share of each source. A shard takes its number of blocks from consecutive places of the source's permuted blocks,
which are disjoint, and orders its documents by a hash (``order_key``); ``by_shard`` brings a shard together and
shuffles it locally.

All draws are hashes of ``SEED`` and names, so reruns agree.

Scale. Documents are dealt by (source, block), of which a hot source has up to ``MOST_BLOCKS``; text never moves.
What is ordered in one task has a row for each source, block of a source, or block's document. Quotas are arrays
with an entry for each source. A round of the search for documents that fit (``fitting``) reads narrow rows and passes
at least one block; as the rest of a passed block is above what is missing, few rounds are needed.

Defined cases. Null texts have no words; documents without words have copies like others (``MOST`` at most) and take nothing. A
source without words has target 0. Rows with equal ids are documents of their own. An empty table gives
none. Names of other columns cannot clash: ``mix`` adds copy, shard and order_key last and drops the input's
columns of these names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written

WEIGHTS, SHARE, MOST, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 20_240_229
BLOCK_DOCS, MOST_BLOCKS, SHARD_WORDS, LEAST_DEPTH = 64, 4096, 4_000_000, 2
#: Levels of the tree that are split in one task; below, its nodes are dealt out.
LEVELS = 4


def source_key() -> Column:
    """A non-null name of the source: no value has the name of null."""
    return F.coalesce(F.concat(F.lit("v"), F.col("source")), F.lit(""))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint"), F.lit(0).cast("bigint"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size: the words of the text."""
    return docs.select("doc_id", "source", _size().alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """A row for each source: skey, n, source_size, weight, target, passes, rest (words of the partial pass), blocks."""
    sources = sizes.groupBy(source_key().alias("skey"), "source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    k = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (k % len(WEIGHTS) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", "skey")
    everything = Window.partitionBy()
    left = SHARE * F.sum("source_size").over(everything) - (F.sum("cap").over(by) - F.col("cap"))
    weights = F.sum("weight").over(everything) - F.sum("weight").over(by) + F.col("weight")
    sources = sources.withColumn("level", left / weights)
    # The first source, from the lowest cap by weight, whose cap is above its share: there the level is the right one.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "skey", "level"))).over(everything)["level"]
    sources = sources.withColumn("target", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    blocks = F.least(F.lit(MOST_BLOCKS), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / BLOCK_DOCS)))).cast("bigint"))
    return (
        sources.withColumn("passes", passes)
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("blocks", blocks)
        .select("skey", "n", "source_size", "weight", "target", "passes", "rest", "blocks")
    )


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11) / float(1 << 53)


def _log_factorial(n: Column) -> Column:
    """Stirling's series from eight up; exact below."""
    small = [1, 1, 2, 6, 24, 120, 720, 5040]
    table = F.array(*(F.log(F.lit(float(x))) for x in small))
    x = F.greatest(n, F.lit(8)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n < 8, F.get(table, F.greatest(n, F.lit(0)).cast("int"))).otherwise(series)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """The number of marked among `drawn` of `total`, by inverting the distribution at `u`."""
    mean = drawn * marked / F.greatest(total, F.lit(1))
    spread = F.sqrt(F.greatest(mean * (total - marked) * (total - drawn) / F.greatest(total * total, F.lit(1)), F.lit(0.0)))
    least, most = F.greatest(F.lit(0), drawn - (total - marked)), F.least(marked, drawn)
    low = F.greatest(least, F.floor(mean - 12 * spread) - 2).cast("bigint")
    high = F.greatest(low, F.least(most, F.ceil(mean + 12 * spread) + 2).cast("bigint"))

    def log_chance(x: Column) -> Column:
        return -(_log_factorial(x) + _log_factorial(marked - x) + _log_factorial(drawn - x) + _log_factorial(total - marked - drawn + x))

    def chosen(parts: Column) -> Column:
        logs = parts["logs"]
        top = F.array_max(logs)
        whole = F.aggregate(logs, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        below = F.aggregate(
            logs, F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("bigint").alias("k")),
            lambda a, x: F.struct((a["sum"] + F.exp(x - top)).alias("sum"), (a["k"] + F.when(a["sum"] + F.exp(x - top) < u * whole, 1).otherwise(0)).alias("k")),
        )
        return F.least(parts["low"] + below["k"], parts["high"])

    bound = F.array(F.struct(low.alias("low"), high.alias("high"), F.transform(F.sequence(low, high), log_chance).alias("logs")))
    return F.get(F.transform(bound, chosen), F.lit(0))


def split_quotas(quotas: DataFrame, depth: int) -> DataFrame:
    """skey, quota -> skey, shard, first, quota: blocks of each of 2^depth shards and their place in the source's order."""
    parts = int(quotas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("skey", F.col("quota").cast("bigint").alias("quota")))).alias("parts")).select(F.lit(0).cast("bigint").alias("shard"), "parts")
    for level in range(depth):
        whole = F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["quota"])
        start = F.struct(F.col("whole").alias("total"), F.floor(F.col("whole") / 2).cast("bigint").alias("drawn"), F.array().cast("array<bigint>").alias("left"))

        def step(acc: Column, part: Column) -> Column:
            u = _uniform(F.col("_level"), F.col("shard"), part["skey"])
            bound = F.array(hypergeometric(acc["total"], part["quota"], acc["drawn"], u))
            return F.get(
                F.transform(bound, lambda x: F.struct((acc["total"] - part["quota"]).alias("total"), (acc["drawn"] - x).alias("drawn"), F.concat(acc["left"], F.array(x)).alias("left"))),
                F.lit(0),
            )

        node = node.withColumn("_level", F.lit(level)).withColumn("whole", whole).withColumn("left", F.aggregate("parts", start, step, lambda a: a["left"]))
        left = F.transform("parts", lambda p, i: F.struct(p["skey"].alias("skey"), F.get("left", i).alias("quota")))
        right = F.transform("parts", lambda p, i: F.struct(p["skey"].alias("skey"), (p["quota"] - F.get("left", i)).alias("quota")))
        halves = F.array(F.struct((2 * F.col("shard")).alias("shard"), left.alias("parts")), F.struct((2 * F.col("shard") + 1).alias("shard"), right.alias("parts")))
        node = node.select(F.explode(halves).alias("half")).select("half.shard", "half.parts")
        if level % LEVELS == LEVELS - 1 and level < depth - 1:
            node = written(node.repartition(min(2 << level, parts), "shard"), "nodes")
    rows = node.select("shard", F.explode("parts").alias("part")).select("part.skey", "shard", "part.quota")
    before = F.sum("quota").over(Window.partitionBy("skey").orderBy("shard")) - F.col("quota")
    return rows.withColumn("first", before).select("skey", "shard", "first", "quota")


def _place(block: Column, blocks: Column, turn: Column) -> Column:
    """Place of a block in the permuted order of a pass: multiplication by an odd number and a shift, modulo a power of two."""
    odd = F.xxhash64(F.lit(SEED), F.lit("odd"), F.col("skey"), turn).bitwiseOR(F.lit(1).cast("bigint"))
    shift = F.xxhash64(F.lit(SEED), F.lit("shift"), F.col("skey"), turn)
    low = blocks - 1
    return ((odd.bitwiseAND(low) * block).bitwiseAND(low) + shift.bitwiseAND(low)).bitwiseAND(low)


def _swept(missing: Column, documents: Column) -> Column:
    """Of documents (row, size) in order, the rows of those that fit into what is missing, one after the other, and what is missing then."""
    start = F.struct(missing.alias("missing"), F.array().cast("array<int>").alias("rows"))

    def step(state: Column, d: Column) -> Column:
        fits = d["size"] <= state["missing"]
        return F.struct(
            F.when(fits, state["missing"] - d["size"]).otherwise(state["missing"]).alias("missing"),
            F.when(fits, F.concat(state["rows"], F.array(d["row"]))).otherwise(state["rows"]).alias("rows"),
        )

    return F.aggregate(documents, start, step)


def fitting(left: DataFrame, missing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`left` (skey, place, row, size), `missing` (skey, missing) -> what is taken of each place, and what is missing then.

    In the order of place and row, every document is taken that fits into what is missing when its turn comes. A
    place's part is skey, place, upper and rows: its documents of at most `upper` words, only those in `rows` if that is
    not null. Each round takes places as a whole while their documents that fit do so together, and goes through the
    next place one by one.
    """
    state, parts = missing.select("skey", "missing", F.lit(0).cast("bigint").alias("begin")), None
    while True:
        fits = left.join(state, "skey").filter((F.col("size") <= F.col("missing")) & (F.col("place") >= F.col("begin")))
        sums = fits.groupBy("skey", "place", "missing").agg(F.sum("size").alias("words"))
        sums = sums.withColumn("ends", F.sum("words").over(Window.partitionBy("skey").orderBy("place")))
        stop = F.min(F.when(F.col("ends") > F.col("missing"), F.col("place"))).over(Window.partitionBy("skey"))
        sums = written(sums.withColumn("stop", stop).filter(F.coalesce(F.col("place") <= F.col("stop"), F.lit(True))), "fitting")
        if sums.isEmpty():
            return parts, state.select("skey", "missing")
        at_stop = sums.filter("place = stop").select("skey", "place", F.col("missing").alias("upper"), (F.col("missing") - F.col("ends") + F.col("words")).alias("room"))
        documents = F.array_sort(F.collect_list(F.struct("row", "size")))
        cut = left.join(at_stop, ["skey", "place"]).filter("size <= room").groupBy("skey", "place", "upper", "room").agg(documents.alias("documents"))
        cut = cut.select("skey", "place", "upper", _swept(F.col("room"), F.col("documents")).alias("swept"))
        cut = written(at_stop.join(cut.drop("upper"), ["skey", "place"], "left").select("skey", "place", "upper", F.coalesce("swept.rows", F.array().cast("array<int>")).alias("rows"), F.coalesce("swept.missing", "room").alias("missing")), "cut")
        whole = sums.filter("stop IS NULL OR place < stop").select("skey", "place", F.col("missing").alias("upper"), F.lit(None).cast("array<int>").alias("rows"))
        part = whole.unionByName(cut.drop("missing"))
        parts = part if parts is None else parts.unionByName(part)
        # A source whose documents that fit are all taken is done.
        done = sums.filter("stop IS NULL").groupBy("skey").agg((F.first("missing") - F.sum("words")).alias("now"), F.lit(MOST_BLOCKS).cast("bigint").alias("next"))
        moved = done.unionByName(cut.select("skey", F.col("missing").alias("now"), (F.col("place") + 1).alias("next")))
        state = written(state.join(moved, "skey", "left").select("skey", F.coalesce("now", "missing").alias("missing"), F.coalesce("next", "begin").alias("begin")), "missing")


def draws(sizes: DataFrame, shards: int | None = None) -> DataFrame:
    """`sizes` (as of ``sized``) with source_size, target and copies: an array of (copy, shard), one for each draw."""
    rows = written(sizes.select("doc_id", "source", "size", source_key().alias("skey"), F.xxhash64(F.lit(SEED), "doc_id").alias("h")), "sizes")
    plan = written(targets(rows), "targets")
    total = plan.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("t")).first()["t"]
    depth = LEAST_DEPTH
    while (1 << depth < shards) if shards else total / (1 << depth) > SHARD_WORDS:
        depth += 1
    block = F.pmod(F.xxhash64(F.lit("block"), "h"), F.col("blocks"))
    dealt = rows.join(plan.select("skey", "blocks"), "skey").withColumn("block", block)
    in_block = Window.partitionBy("skey", "block").orderBy("h", "size", "doc_id")
    placed = written(
        dealt.select("*", F.row_number().over(in_block).alias("row"), F.sum("size").over(in_block.rowsBetween(Window.unboundedPreceding, 0)).alias("upto")).drop("blocks"),
        "placed",
    )
    # Blocks of the partial pass: taken while they fit; the next one is cut at a document.
    words = placed.groupBy("skey", "block").agg(F.sum("size").alias("words"))
    words = words.join(plan.select("skey", "passes", "rest", "blocks"), "skey").withColumn("place", _place(F.col("block"), F.col("blocks"), F.col("passes")))
    by_place = Window.partitionBy("skey").orderBy("place")
    words = words.withColumn("ends", F.sum("words").over(by_place)).withColumn("begins", F.col("ends") - F.col("words"))
    cut = F.min(F.when(F.col("ends") > F.col("rest"), F.col("place"))).over(Window.partitionBy("skey"))
    words = written(words.withColumn("cut", cut).withColumn("room", F.when(F.col("place") == F.col("cut"), F.col("rest") - F.col("begins"))), "blocks")
    # Quotas in blocks, split among the shards; the cut block counts as one.
    quotas = words.groupBy("skey").agg((F.first("passes") * F.first("blocks") + F.coalesce(F.first("cut") + 1, F.first("blocks"))).alias("quota"))
    ranges = split_quotas(quotas, depth).filter("quota > 0").groupBy("skey").agg(F.array_sort(F.collect_list(F.struct("first", "shard"))).alias("ranges"))

    def shard_of(place: Column) -> Column:
        return F.element_at(F.filter("ranges", lambda r: r["first"] <= place), -1)["shard"]

    turns = F.sequence(F.lit(0).cast("bigint"), F.col("passes"))
    at = F.transform(turns, lambda t: F.struct(t.alias("copy"), shard_of(t * F.col("blocks") + _place(F.col("block"), F.col("blocks"), t)).alias("shard")))
    whole = F.coalesce(F.col("place") < F.col("cut"), F.lit(True))
    per_block = written(words.join(ranges, "skey").select("skey", "block", "place", "room", whole.alias("whole"), at.alias("at")), "copies")
    chosen = written(placed.join(per_block, ["skey", "block"]).withColumn("partial", F.col("whole") | F.coalesce(F.col("upto") <= F.col("room"), F.lit(False))), "chosen")
    # Where words are still missing: the documents that fit in the order of the partial pass, then the nearest one left.
    got = chosen.groupBy("skey").agg(F.sum(F.when(F.col("partial"), F.col("size")).otherwise(0)).alias("got"))
    missing = written(plan.join(got, "skey").select("skey", (F.col("rest") - F.col("got")).alias("missing")), "gaps")
    left = chosen.filter(~F.col("partial") & (F.col("size") > 0)).select("skey", "place", "block", "row", "h", "size")
    parts, missing = fitting(left, missing)
    if parts is not None:
        fits = (F.col("size") <= F.col("upper")) & (F.col("rows").isNull() | F.array_contains("rows", F.col("row")))
        taken = F.col("partial") | ((F.col("size") > 0) & F.coalesce(fits, F.lit(False)))
        chosen = written(chosen.join(parts, ["skey", "place"], "left").withColumn("partial", taken).drop("upper", "rows"), "fitted")
        left = chosen.filter(~F.col("partial") & (F.col("size") > 0)).select("skey", "place", "block", "row", "h", "size")
    gap = F.abs(F.col("missing") - F.col("size"))
    nearest = written(
        left.join(missing, "skey").filter(gap < F.col("missing")).groupBy("skey")
        .agg(F.min(F.struct(gap.alias("gap"), "h", "block", "row")).alias("one")).select("skey", "one.block", "one.row", F.lit(True).alias("extra")),
        "nearest",
    )
    # A document outside the blocks drawn so far has no place in the partial pass; it goes to the shard of the last one drawn.
    final = chosen.join(nearest, ["skey", "block", "row"], "left").join(plan.select("skey", "source_size", "target", "passes"), "skey")
    # A document without words fits into any rest; it has no more copies than others may have.
    n = F.least(F.col("passes") + F.when(F.col("partial") | F.coalesce("extra", F.lit(False)), 1).otherwise(0), F.lit(int(MOST)))
    copies = F.transform(F.slice("at", F.lit(1), n.cast("int")), lambda c: F.struct(c["copy"].alias("copy"), F.coalesce(c["shard"], F.lit(0).cast("bigint")).alias("shard")))
    return final.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The drawn documents: the columns of `docs` once for each copy, with copy, shard and order_key.

    Rows of one id are drawn as the documents they are; where an id repeats, its rows are told apart by source,
    size and a hash of the text.
    """
    added = ["copy", "shard", "order_key"]
    docs = docs.drop(*added)
    keyed = docs.withColumn("__mr_text_hash", F.xxhash64("text"))
    per_row = draws(sized(docs), shards)
    w = Window.partitionBy("doc_id", "source", "size").orderBy(F.size("copies").desc(), F.col("copies"))
    numbered = per_row.withColumn("__mr_k", F.row_number().over(w)).select(F.col("doc_id").alias("__mr_d"), F.col("source").alias("__mr_s"), F.col("size").alias("__mr_n"), "__mr_k", "copies").filter(F.size("copies") > 0)
    own = keyed.withColumn("__mr_n", _size()).withColumn("__mr_k", F.row_number().over(Window.partitionBy("doc_id", "source", "__mr_n").orderBy("__mr_text_hash")))
    joined = own.join(
        numbered,
        reduce(lambda a, b: a & b, [F.col("doc_id").eqNullSafe(F.col("__mr_d")), F.col("source").eqNullSafe(F.col("__mr_s")), own["__mr_n"] == numbered["__mr_n"], own["__mr_k"] == numbered["__mr_k"]]),
    )
    drawn = joined.withColumn("__mr_c", F.explode("copies"))
    return drawn.select(
        *docs.columns, F.col("__mr_c.copy").alias("copy"), F.col("__mr_c.shard").alias("shard"),
        F.xxhash64(F.lit(SEED), F.col("__mr_c.shard"), F.col("doc_id"), F.col("__mr_c.copy")).alias("order_key"),
    )


def by_shard(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix``, those of a shard together and in its local order."""
    return mixed.repartition("shard").sortWithinPartitions("shard", "order_key", "doc_id", "copy")
