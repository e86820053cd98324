"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash space is kept.

Whether a shingle is kept depends on it alone, so sketches of any two texts, however unequal in length, hold the
same part of what they share: the share of one sketch that the other has estimates containment, and the union of
two sketches is the sketch of both texts together (``merged``). A text without a hash below the threshold keeps its
smallest one, so that equal short texts are alike. A longer text does not keep that hash, so two sketches alone cannot
tell whether such a text is in it; ``edited_and_next`` then counts its shingles in all those of the other text, which
is exact (``counted``). DataFrame functions only.

A shingle is ``SHINGLE`` words (the whole sequence if there are fewer); its hash chains XXH64 over the words.

``edited_and_next`` compares each text with an edited form of it and with the next document. Scale: ids are
ordered by range partitions and stitched at their borders; a text then moves once to meet its successor's
beginning, and half of it once more as a beginning. Nothing else but ids and sketches moves, and all hashes of a text
if the one before it has none below the threshold; no order is made over all rows in one task.

Defined cases. Null texts count as empty; a text without words has the empty sketch, which is like another empty
one (1.0) and unlike any other (0.0). Documents are ordered by descending id, null ids last, equal ids by a
hash of the text; repeated rows follow each other. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written

SPACE = "[\\x20\\x09-\\x0D]+"
SHINGLE = 5
#: One in 2^FRACTION_BITS hashes is kept; a kept hash then has DIGITS hex digits.
FRACTION_BITS, DIGITS = 3, 16
#: Ids in a range partition.
RANGE = 200_000
#: Code points in which a hash below the threshold is looked for before the whole text is split.
GLANCE = 1000
_LEAST = -(1 << 63)


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def _is_low(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - FRACTION_BITS) == 0


def _shingle_hash(words: Column, i: Column, shingle: int) -> Column:
    return F.xxhash64(*(F.get(words, i + k) for k in range(shingle)))


def with_hashes(df: DataFrame, text: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """`df` with the hashes of all shingles of the non-null column `text`, in the order of the text."""
    words = F.col(f"_{name}_words")
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: _shingle_hash(words, i, shingle))
    hashes = F.when(n >= shingle, each).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(f"_{name}_words", _words(F.col(text))).withColumn(name, hashes).drop(f"_{name}_words")


def kept(hashes: Column) -> Column:
    """The sketch: distinct hashes below the threshold, in order; the smallest one if there is none below."""
    low = F.filter(hashes, _is_low)
    # The least as unsigned: flipping the top bit makes the signed order that of unsigned numbers.
    flip = lambda h: h.bitwiseXOR(F.lit(_LEAST))
    least = F.array(flip(F.array_min(F.transform(hashes, flip))))
    return F.when(F.size(low) > 0, F.sort_array(F.array_distinct(low))).when(F.size(hashes) > 0, least).otherwise(F.array().cast("array<bigint>"))


def with_sketch(df: DataFrame, text: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """`df` with the sketch of the non-null column `text`."""
    df = with_hashes(df, text, f"_{name}_hashes", shingle)
    return df.withColumn(name, kept(F.col(f"_{name}_hashes"))).drop(f"_{name}_hashes")


def has_no_low(text: Column, shingle: int = SHINGLE) -> Column:
    """Whether a non-null text has shingles, but no hash below the threshold.

    Most texts have one among their first words, so these are looked at before the whole text is.
    """

    def any_low(words: Column, n: Column) -> Column:
        return F.exists(F.sequence(F.lit(0), n - shingle), lambda i: _is_low(_shingle_hash(words, i, shingle)))

    def in_part(words: Column) -> Column:  # the last word of a part may be cut
        return F.when(F.size(words) > shingle, any_low(words, F.size(words) - 1)).otherwise(False)

    def in_whole(words: Column) -> Column:
        n = F.size(words)
        return F.when(n >= shingle, any_low(words, n)).when(n > 0, _is_low(F.xxhash64(F.array_join(words, " ")))).otherwise(True)

    # An array of one makes the words a variable, so they are split once.
    once = lambda part, test: F.get(F.transform(F.array(_words(part)), test), F.lit(0))
    return F.when(once(F.left(text, F.lit(GLANCE)), in_part), False).otherwise(~once(text, in_whole))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), DIGITS, "0"))), "")


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts together: a hash above the threshold stays only where there is none below."""
    both = F.array_distinct(F.concat(a, b))
    return kept(both)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has."""
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def counted(a: Column, b: Column) -> Column:
    """Share of the first text's shingles that the second has, from all hashes of both; the first has some."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a))


def _successors(rows: DataFrame) -> DataFrame:
    """kid, h, n, c, s -> the same as ck, ch, cn, cc, cs, with nk, nh: the key of the next row in descending order, and of the first after the last."""
    parts = max(1, -(-rows.count() // RANGE))
    order = (F.col("kid").desc_nulls_last(), F.col("h").desc())
    ranged = written(rows.repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id()), "ranges")
    heads = ranged.groupBy("pid").agg(F.max(F.struct("kid", "h")).alias("head"))  # a row for each range; null is least
    by = Window.orderBy("pid")
    following = heads.select(
        "pid",
        F.coalesce(F.lead("head").over(by), F.first("head").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"),
    )
    w = Window.partitionBy("pid").orderBy(*order)
    found = ranged.withColumn("nxt", F.lead(F.struct("kid", "h")).over(w)).join(following, "pid")
    nxt = F.coalesce("nxt", "head")
    return found.select(F.col("kid").alias("ck"), F.col("h").alias("ch"), F.col("n").alias("cn"), F.col("c").alias("cc"), F.col("s").alias("cs"), nxt["kid"].alias("nk"), nxt["h"].alias("nh"))


def edited_and_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    measured = base.select(F.col("doc_id").alias("kid"), "h", F.char_length("text").cast("bigint").alias("n"), has_no_low(F.col("text")).alias("s"))
    rows = written(measured.groupBy("kid", "h").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("c"), F.first("s").alias("s")), "ids")
    repeated = rows.filter("c > 1").limit(1).count() > 0
    if repeated:  # one row for all equal ones, told apart again at the end
        base = base.dropDuplicates(["doc_id", "h"])
    follows = written(_successors(rows), "successors")

    def at(key: str, hashed: str):
        return F.col("doc_id").eqNullSafe(F.col(key)) & (F.col("h") == F.col(hashed))

    # A row gives its beginning and sketch to the one before it. Both joins read the same columns of `base`, so its
    # exchange, which holds the texts, is made once.
    giving = base.join(follows, at("nk", "nh")).select("text", "ck", "ch", "cn", "cc", "cs")
    giving = giving.withColumn("beginning", F.expr("left(text, cast(cn div 2 as int))"))
    giving = with_hashes(giving, "text", "hashes").withColumn("next_sketch", kept(F.col("hashes")))
    giving = giving.withColumn("next_hashes", F.when(F.col("cs"), F.array_distinct("hashes"))).drop("text", "hashes")
    both = base.join(giving, at("ck", "ch")).withColumnsRenamed({"cn": "n", "cc": "c", "cs": "s"})
    if repeated:  # all but the last of equal rows are followed by one like themselves
        own = F.struct(F.expr("left(text, cast(n div 2 as int))").alias("beginning"), F.lit(True).alias("same"))
        other = F.struct(F.col("beginning"), F.lit(False).alias("same"))
        both = both.withColumn("x", F.explode(F.when(F.col("c") > 1, F.concat(F.array(other), F.array_repeat(own, (F.col("c") - 1).cast("int")))).otherwise(F.array(other))))
        both = both.withColumn("beginning", F.col("x.beginning")).withColumn("same", F.col("x.same"))
    else:
        both = both.withColumn("same", F.lit(False))
    both = both.withColumn("edited", F.expr("concat(left(text, cast(n - n div 2 as int)), beginning)"))
    both = with_hashes(with_hashes(both, "text", "hashes"), "edited", "edited_hashes")
    both = both.withColumn("sketch", kept(F.col("hashes"))).withColumn("edited_sketch", kept(F.col("edited_hashes")))

    def near(sketch: str, hashes: str) -> Column:
        return F.when(F.col("s"), counted(F.col("hashes"), F.col(hashes))).otherwise(containment(F.col("sketch"), F.col(sketch)))

    return both.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        near("edited_sketch", "edited_hashes").alias("near_edited"),
        F.when(F.col("same"), F.lit(1.0)).otherwise(near("next_sketch", "next_hashes")).alias("near_next"),
    )
