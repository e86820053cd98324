"""Line dedup: equal lines, and lines within an edit distance, by a segment-partition join. DataFrame functions only.

A line (between newlines, with at least one word) is dropped if an equal line, or one within ``EDITS`` edits
of it, occurs earlier: in a document of smaller id, or before it in the same one. Lines under ``LEAST_CHARS``
characters only count as equal if they are. Lines without a word stay.

1. Equal lines meet by hash; one row remains for each distinct line, with its first place.
2. Segment partition. Of lines within k edits, cut into k + 1 segments, one segment of the shorter line is whole in
   the longer one, at most k places from where it stands there. Every distinct line gives its k + 1 segments to an
   index by (length, segment, content), and probes it with the substrings that can match, for each length up to k
   less than its own (the multi-match-aware choice of places); its own segments, which are among these, meet within
   the index. Rows carry a summary of letter counts, which k
   edits change by at most 2 k, so that most accidental meetings end in the join itself. Whole lines are counted: where variants of
   one line differ in its middle, its ends alone tell nothing.
3. Candidates are verified with a banded bit-parallel edit distance (Hyyrö's form of Myers' algorithm): the
   2 k + 1 diagonals that matter are the bits of a word; only the part between common beginning and end is read.

Scale. A distinct line's text moves once, in step 1, and stays where it is for steps 2 and 3 (the same exchange is
used again); else only hashes move. The most frequent line is one row after a partial aggregation.

Defined cases. Null and empty texts have no lines. Rows of equal id and text are one document and are judged alike;
rows of equal id and different texts follow a hash of the text; null ids come first. Other columns are kept
as they are by ``dedup_lines``. An edit is the change, insertion or removal of a code point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import written

EDITS, LEAST_CHARS = 2, 20
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
#: Characters whose counts, modulo 16, make a line's summary.
COUNTED = " eatnorishldugcm"


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), line_no (from 0), line for each line with a word."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text")).withColumn("th", F.xxhash64("_text"))
    return rows.select("doc_id", "th", F.posexplode(F.split("_text", "\n")).alias("line_no", "line")).filter(F.col("line").rlike(NOT_SPACE))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """h, line, counts, place: the line's hash, text and letter counts, and its first place (a second hash, doc_id, th, line_no)."""
    place = F.struct(F.xxhash64(F.lit(7), "line").alias("h2"), "doc_id", "th", "line_no")
    counted = lines.withColumn("counts", letter_counts(F.col("line")))
    return counted.groupBy(F.xxhash64("line").alias("h")).agg(F.min(place).alias("place"), F.first("line").alias("line"), F.first("counts").alias("counts"))


def _measured(lines: DataFrame, edits: int) -> DataFrame:
    """With n, and size and extra of each length from n to `edits` less: the length of its segments, of which the last
    `extra` are one longer. Columns of their own keep the code that Spark makes of the keys below the size from which
    the JVM only interprets it."""
    lines = lines.withColumn("n", F.char_length("line"))
    lines = lines.withColumns({f"size{short}": F.floor((F.col("n") - short) / (edits + 1)).cast("int") for short in range(edits + 1)})
    return lines.withColumns({f"extra{short}": F.col("n") - short - F.col(f"size{short}") * (edits + 1) for short in range(edits + 1)})


def _segment(size: Column, extra: Column, i: int, edits: int) -> tuple[Column, Column]:
    """First place (from 1) and size of segment i (from 0)."""
    return 1 + i * size + F.greatest(F.lit(0), i - (edits + 1) + extra), size + F.when(extra >= edits + 1 - i, 1).otherwise(0)


def _key(length: Column, i: int, content: Column) -> Column:
    return F.xxhash64(length, F.lit(i), content)


def segment_keys(edits: int = EDITS) -> Column:
    """Of a line as ``_measured`` gives it."""
    keys = []
    for i in range(edits + 1):
        at, size = _segment(F.col("size0"), F.col("extra0"), i, edits)
        keys.append(_key(F.col("n"), i, F.substring("line", at, size)))
    return F.array(*keys)


def probe_keys(least: int, edits: int = EDITS) -> Column:
    """Keys of the substrings that can be a segment of an indexed line; null for lines below `least`.

    Without those that are the line's own segments: lines that share one of these meet within the index.
    """
    found = []
    for short in range(edits + 1):
        length = F.col("n") - short
        size, extra = F.col(f"size{short}"), F.col(f"extra{short}")
        for i in range(edits + 1):
            at, wide = _segment(size, extra, i, edits)
            low, high = max(-i, short - (edits - i)), min(i, short + (edits - i))
            for off in range(low, high + 1):
                if not short and not off:
                    continue
                key = _key(length, i, F.substring("line", at + off, wide))
                found.append(F.when(length >= least, key) if short else key)
    return F.array(*found)


def letter_counts(line: Column) -> Column:
    """Counts of COUNTED modulo 16, each in four bits of a long."""
    total = F.lit(0).cast("bigint")
    for k, c in enumerate(COUNTED):
        count = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit(15)).cast("bigint")
        total = total.bitwiseOR(F.shiftleft(count, 4 * k))
    return total


def counts_apart(a: Column, b: Column) -> Column:
    """Sum of the counts' differences, at least (modulo 16): an edit changes it by two at most."""
    total = F.lit(0).cast("bigint")
    for k in range(len(COUNTED)):
        d = F.abs(F.shiftright(a, 4 * k).bitwiseAND(F.lit(15)) - F.shiftright(b, 4 * k).bitwiseAND(F.lit(15)))
        total = total + F.least(d, 16 - d)
    return total


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _common(x: Column, y: Column, cut) -> Column:
    """Length of the common beginning (or end) of two texts, of whatever length."""
    n = F.least(F.char_length(x), F.char_length(y))
    # From the highest power of two in the shorter length downwards, bit by bit.
    powers = F.array(*(F.lit(1 << k) for k in reversed(range(31))))
    digits = F.length(F.bin(n))
    return F.aggregate(F.slice(powers, 32 - digits, digits), F.lit(0), lambda p, s: F.when((p + s <= n) & (cut(x, p + s) == cut(y, p + s)), p + s).otherwise(p))


def middles(a: Column, b: Column) -> Column:
    """What is left of two lines without their common beginning and end: a struct of x and y."""

    def after_beginning(p: Column) -> Column:
        rest = F.struct(F.substring(a, p + 1, F.char_length(a)).alias("x"), F.substring(b, p + 1, F.char_length(b)).alias("y"))

        def after_end(pair: Column) -> Column:
            x, y = pair["x"], pair["y"]
            cut = lambda t, s: F.left(t, F.char_length(t) - s)
            return _let(_common(x, y, F.right), lambda s: F.struct(cut(x, s).alias("x"), cut(y, s).alias("y")))

        return _let(rest, after_end)

    return _let(_common(a, b, F.left), after_beginning)


def may_be_within_two(x: Column, y: Column) -> Column:
    """For middles: two edits leave only the first and the last character unlike, so what is between must agree."""
    inner = lambda t, first, last: F.substring(t, first + 1, F.char_length(t) - first - last)
    ends = ((1, 1), (0, 1), (1, 0))
    agree = F.least(F.char_length(x), F.char_length(y)) <= 2
    for fx, fy in ends:
        for lx, ly in ends:
            agree = agree | (inner(x, fx, lx) == inner(y, fy, ly))
    return agree


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """True if the lines `a` and `b`, of lengths at most `edits` apart, are within `edits` edits."""
    chars = lambda x: F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))

    def verified(m: Column) -> Column:
        exact = _let(F.struct(chars(m["x"]).alias("x"), chars(m["y"]).alias("y")), lambda c: _banded(c["x"], c["y"], edits))
        return F.when(may_be_within_two(m["x"], m["y"]), exact).otherwise(False) if edits <= 2 else exact

    return _let(middles(a, b), verified)


def _banded(x: Column, y: Column, k: int) -> Column:
    """Whether arrays of characters are within k edits: the band's vertical differences are the bits of `vp` and `vn`."""
    m, n, width = F.size(x), F.size(y), 2 * k + 1
    full, top = (1 << width) - 1, 1 << (width - 1)

    def inv(v: Column) -> Column:
        return v.bitwiseXOR(F.lit(full))

    def step(state: Column, c: Column, i: Column) -> Column:
        first = i + (k + 1 - width)
        match = F.lit(0)
        for d in range(width):
            match = match.bitwiseOR(F.when(F.coalesce((first + d >= 0) & (F.get(x, F.greatest(first + d, F.lit(0))) == c), F.lit(False)), 1 << d).otherwise(0))

        def with_d0(d0: Column) -> Column:
            vp, vn = state["vp"], state["vn"]
            hp = vn.bitwiseOR(inv(d0.bitwiseOR(vp)))
            hn = d0.bitwiseAND(vp)
            half = F.shiftright(d0, 1)
            down = F.when(d0.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)
            bit = F.coalesce(F.get(F.array(*(F.lit(top >> (j + 1)) for j in range(width))), F.greatest(F.lit(0), i - (m - k))), F.lit(0))
            along = F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(bit) != 0, 1).otherwise(0)
            return F.struct(
                hn.bitwiseOR(inv(half.bitwiseOR(hp))).alias("vp"),
                half.bitwiseAND(hp).alias("vn"),
                (state["dist"] + F.when(i < m - k, down).otherwise(along)).alias("dist"),
                state["i"].alias("i"),
            )

        def with_match(pm: Column) -> Column:
            vp, vn = state["vp"], state["vn"]
            d0 = (pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(F.lit(full))
            return _let(d0, with_d0)

        return _let(match, with_match)

    start = F.struct(F.lit(full & (full << (width - k - 1))).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("dist"), F.lit(0).alias("i"))

    def advance(state: Column, c: Column) -> Column:
        # The last row gives back at most one for each of its steps; beyond that all is settled.
        moved = step(state, c, state["i"])
        return F.when(state["dist"] > 2 * k + n - m, state).otherwise(_let(moved, lambda s: F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["dist"].alias("dist"), (s["i"] + 1).alias("i"))))

    far = F.aggregate(y, start, advance, lambda s: s["dist"])
    return F.when((m <= k) | (n <= k), F.levenshtein(F.array_join(x, ""), F.array_join(y, "")) <= k).otherwise(far <= k)


def near_pairs(distinct: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """(a, place_a, b, place_b) of distinct lines within `edits` edits, each pair once."""
    # Both uses of this table read all its columns, so that its exchange, which holds the texts, is made once.
    long = distinct.filter((F.char_length("line") >= least) & (F.col("place.line_no") >= 0) & (F.pmod("counts", F.lit(2)) >= 0))
    long = _measured(long, edits)
    index = long.select(F.explode(segment_keys(edits)).alias("key"), F.col("h").alias("a"), F.col("counts").alias("ca"))
    probe = long.select(F.explode(probe_keys(least, edits)).alias("key"), F.col("h").alias("b"), F.col("counts").alias("cb")).filter("key IS NOT NULL")
    alike = counts_apart(F.col("ca"), F.col("cb")) <= 2 * edits
    own = index.select("key", F.col("a").alias("b"), F.col("ca").alias("cb"))
    met = index.join(probe, "key").filter((F.col("a") != F.col("b")) & alike).unionByName(index.join(own, "key").filter((F.col("a") < F.col("b")) & alike))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = long.select(F.col("h").alias("a"), F.col("line").alias("line_a"), F.col("place").alias("place_a"))
    second = long.select(F.col("h").alias("b"), F.col("line").alias("line_b"), F.col("place").alias("place_b"))
    return pairs.join(first, "a").join(second, "b").filter(within(F.col("line_a"), F.col("line_b"), edits)).select("a", "place_a", "b", "place_b")


def kept_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, th, firsts, kept, n_links: numbers of the lines that are the first of their kind, those of them that
    stay, and the links of a document's first lines to lines within the edit distance; for documents with any."""
    distinct = distinct_lines(lines_of(docs))
    pairs = near_pairs(distinct, edits, least)
    place = lambda p: F.struct(p["doc_id"].alias("doc_id"), p["th"].alias("th"), p["line_no"].alias("line_no"))
    a, b = place(F.col("place_a")), place(F.col("place_b"))
    near = written(pairs.select(a.alias("pa"), b.alias("pb")), "links")
    # A first line is known by its place; of two near ones the later goes.
    marks = near.select(F.explode(F.array(F.struct(F.least("pa", "pb").alias("place"), F.lit(0).alias("late")), F.struct(F.greatest("pa", "pb").alias("place"), F.lit(1).alias("late")))).alias("m"))
    marks = marks.groupBy("m.place").agg(F.max("m.late").alias("late"), F.count(F.lit(1)).alias("links"))
    links = marks.groupBy("place.doc_id", "place.th").agg(F.collect_list(F.when(F.col("late") == 1, F.col("place.line_no"))).alias("late"), F.sum("links").alias("n_links"))
    firsts = distinct.select("place.doc_id", "place.th", "place.line_no").groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("line_no")).alias("firsts"))
    same = firsts["doc_id"].eqNullSafe(links["doc_id"]) & (firsts["th"] == links["th"])
    joined = firsts.join(links, same, "left")
    return joined.select(
        firsts["doc_id"], firsts["th"], "firsts",
        F.array_except("firsts", F.coalesce("late", F.array().cast("array<int>"))).alias("kept"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
    )


def dedup_report(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_lines, n_equal, n_near (dropped), n_kept, n_links, kept_lines (a hash of their numbers)."""
    counted = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_t")).select(
        "doc_id", F.xxhash64("_t").alias("th"), F.size(F.filter(F.split("_t", "\n"), lambda x: x.rlike(NOT_SPACE))).cast("bigint").alias("n_lines")
    )
    kept = kept_lines(docs)
    none = F.array().cast("array<int>")
    joined = counted.join(kept, counted["doc_id"].eqNullSafe(kept["doc_id"]) & (counted["th"] == kept["th"]), "left")
    firsts, stay = F.coalesce("firsts", none), F.coalesce("kept", none)
    return joined.select(
        counted["doc_id"], "n_lines",
        (F.col("n_lines") - F.size(firsts)).alias("n_equal"),
        (F.size(firsts) - F.size(stay)).cast("bigint").alias("n_near"),
        F.size(stay).cast("bigint").alias("n_kept"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.sha2(F.array_join(stay, ","), 256).alias("kept_lines"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`docs` with the dropped lines gone from `text`; n_chars, if there, follows. Null texts stay null."""
    columns = docs.columns
    kept = written(kept_lines(docs).select(F.col("doc_id").alias("__mr_d"), F.col("th").alias("__mr_th"), "kept"), "kept").withColumnRenamed("kept", "__mr_kept")
    rows = docs.withColumn("__mr_h", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    joined = rows.join(kept, rows["doc_id"].eqNullSafe(kept["__mr_d"]) & (rows["__mr_h"] == kept["__mr_th"]), "left").withColumn("__mr_lines", F.split("text", "\n"))
    blank = F.filter(F.transform("__mr_lines", lambda x, i: F.when(~x.rlike(NOT_SPACE), i)), lambda i: i.isNotNull())
    stay = F.sort_array(F.concat(F.coalesce("__mr_kept", F.array().cast("array<int>")), blank))
    joined = joined.withColumn("__mr_stay", stay)
    lines = F.col("__mr_lines")
    text = F.when(F.col("text").isNotNull(), F.array_join(F.transform("__mr_stay", lambda i: F.get(lines, i)), "\n"))
    out = joined.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("bigint"))
    return out.select(*columns)
