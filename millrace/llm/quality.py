"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD).

Two steps, both DataFrame functions only.

1. ``base_statistics``: counts of words, symbols, repeated lines and repeated word triples of each whole
   text, and two fixed rules on them (``base_failed``).
2. ``robust_outliers``: documents that pass the fixed rules become vectors of transformed statistics. Per
   (language, source) group the MCD estimate of location and scatter is found by concentration steps from several
   starts (the coordinate-wise median, and the lower and upper quartiles): keep the ``support`` share of documents
   with the smallest distance, take their mean and covariance, and repeat. Of the estimates that the starts lead to,
   that with the smallest determinant is the group's. Documents whose squared Mahalanobis distance from it exceeds
   ``cutoff`` are rejected.

Scale. A concentration step is one partial aggregation of a narrow table, by (group, distance bin): the
kept share is cut at the edge of a distance bin, so no group is ever sorted or gathered in a task. The
statistics are integers (thousandths), so that sums are exact and reruns agree to the last bit whatever
order tasks end in. ``SCALE_FLOOR`` is added to the scatter, so that a statistic that is constant in the
kept share (no symbols at all, say) does not make every other document infinitely far.

Defined cases. A null or empty text has no words, fails the base rules and is not kept. Null languages and
sources are groups of their own. Groups under ``min_group`` documents are pooled by language, then over all;
if even that pool has under ``MIN_POOL``, its documents are kept without a verdict. Equal rows get equal verdicts.
Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written

SPACE = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"

#: Smallest standard deviation of each statistic, in thousandths: each alone can pass the cutoff (repetition, which the
#: fixed rule ends at 3932, from about 40 % of the words in a group without any).
SCALE_FLOOR = (350, 350, 120, 550)
#: Share of a group that the MCD estimate rests on, number of concentration steps, rejecting distance. The chi-square
#: quantile of 0.999 with four degrees is 18.5; the statistics' tails are heavier than a normal sample's, hence the margin.
SUPPORT, STEPS, CUTOFF, MIN_GROUP = 0.75, 3, 45.0, 30
#: Documents that the pool of all small groups needs for an estimate.
MIN_POOL = 9
#: Makes the covariance of the inner 75 % of a four-dimensional normal sample consistent.
CONSISTENCY = 1.6
P = len(SCALE_FLOOR)
BINS_PER_UNIT, LAST_BIN = 16, 255

_LOW_BITS = 21
_LOW = (1 << _LOW_BITS) - 1


def with_words(df: DataFrame, text: str = "text", name: str = "_words") -> DataFrame:
    """`df` with the array of the text's words, split at ASCII white space; empty for null."""
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return df.withColumn(name, F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE)))


def _covered(starts):
    """Words in three-word windows that begin at the sorted positions `starts`."""
    gaps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
    return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, base_failed.

    Repeated windows are found by sorting one long a window: 43 bits of its hash and 21 of its position.
    Neighbours of equal hash are compared word by word; a text in which two different windows share those
    bits, or of over two million words, is counted by sorting the windows themselves instead.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    base = with_words(docs.select("doc_id", "lang", "source", "text")).select(
        "doc_id", "lang", "source", "_words",
        F.size("_words").cast("bigint").alias("n_words"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit("\\p{Lu}")).cast("bigint").alias("n_upper"),
        lines.alias("_lines"),
    )
    w, n = F.col("_words"), F.size("_words")
    last = F.sequence(F.lit(0), n - 3)
    key = F.transform(last, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(~_LOW).bitwiseOR(i))
    base = base.withColumn("_keys", F.when((n >= 4) & (n <= _LOW), F.sort_array(key)).otherwise(F.array().cast("array<bigint>")))
    keys = F.col("_keys")
    head = lambda x: F.shiftright(x, _LOW_BITS)
    base = base.withColumn(
        "_hits",
        F.filter(keys, lambda x, k: F.coalesce(head(F.get(keys, k + 1)) == head(x), F.lit(False)) | F.coalesce(head(F.get(keys, k - 1)) == head(x), F.lit(False))),
    ).drop("_keys")
    hits = F.col("_hits")
    at = lambda x: x.bitwiseAND(F.lit(_LOW).cast("bigint")).cast("int")

    def unlike(x, k):
        p, q = at(x), at(F.get(hits, k - 1))
        differ = F.lit(False)
        for j in range(3):
            differ = differ | (F.get(w, p + j) != F.get(w, q + j))
        return (k > 0) & F.coalesce(head(F.get(hits, k - 1)) == head(x), F.lit(False)) & differ

    marks = F.transform(hits, lambda x, k: unlike(x, k))
    base = base.select(
        "*",
        F.sort_array(F.transform(hits, at)).alias("_starts"),
        (F.exists(marks, lambda x: x) | (n > _LOW)).alias("_slow"),
    )
    triples = F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, 3)).alias("t"), i.alias("i"))))
    base = base.withColumn("_sorted", F.when(F.col("_slow") & (n >= 3), triples))
    s = F.col("_sorted")
    same = lambda x, k: F.coalesce(F.get(s, k)["t"] == x["t"], F.lit(False))
    slow = F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k + 1) | same(x, k - 1)), lambda x: x["i"]))
    base = base.withColumn("_starts", F.when(F.col("_slow"), F.coalesce(slow, F.array().cast("array<int>"))).otherwise(F.col("_starts")))
    out = base.select(
        "doc_id", "lang", "source", "n_words",
        F.char_length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _covered(F.col("_starts")).alias("n_repeat_words"),
        "n_upper",
    )
    return out.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


# What follows is SQL text that Spark and DuckDB read alike, so that one description serves both.

def vector_sql() -> list[str]:
    """The transformed statistics of a document with words, in thousandths."""
    return [
        "round(1000 * ln(1 + 100.0E0 * n_symbols / n_words))",
        "round(1000 * ln(1 + 100.0E0 * n_upper / word_chars))",
        "round(1000 * ln(word_chars * 1.0E0 / n_words))",
        "round(1000 * ln(1 + 100.0E0 * n_repeat_words / n_words))",
    ]


def moments_sql() -> list[str]:
    sums = [f"sum(q{i}) AS s{i}" for i in range(P)]
    return ["sum(1) AS n", *sums, *(f"sum(q{i} * q{j}) AS t{i}{j}" for i in range(P) for j in range(i + 1))]


def resummed_sql() -> list[str]:
    names = ["n", *(f"s{i}" for i in range(P)), *(f"t{i}{j}" for i in range(P) for j in range(i + 1))]
    return [f"sum({x}) AS {x}" for x in names]


def cholesky_sql() -> list[list[str]]:
    """Levels of a Cholesky factor of the scatter, each a list of 'expression AS name' over the level before."""
    first = [f"s{i} * 1.0E0 / n AS m{i}" for i in range(P)]
    second = []
    for i in range(P):
        for j in range(i + 1):
            cov = f"{CONSISTENCY}E0 * (t{i}{j} * 1.0E0 / n - m{i} * m{j})"
            second.append(f"{cov}{f' + {SCALE_FLOOR[i] ** 2}.0E0' * (i == j)} AS c{i}{j}")
    levels = [first, second]
    for j in range(P):
        inner = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        levels.append([f"sqrt(c{j}{j}{inner}) AS l{j}{j}"])
        below = [f"(c{i}{j}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, P)]
        if below:
            levels.append(below)
    return levels


def distance_levels() -> list[list[str]]:
    levels = []
    for i in range(P):
        inner = "".join(f" - l{i}{k} * y{k}" for k in range(i))
        levels.append([f"(q{i} - m{i}{inner}) / l{i}{i} AS y{i}"])
    levels.append([" + ".join(f"y{i} * y{i}" for i in range(P)) + " AS d2"])
    return levels


#: Where the concentration steps begin, and the quartile that it is.
STARTS = {0: "a", 1: "lo", 2: "hi"}


def start_sql() -> str:
    """Squared distance from the start's point, in units of the interquartile range."""
    at = lambda i: f"CASE start {' '.join(f'WHEN {k} THEN {x}{i}' for k, x in STARTS.items())} END"
    parts = [f"(q{i} - {at(i)}) * (q{i} - {at(i)}) / ((b{i} / 1.349E0) * (b{i} / 1.349E0) + {SCALE_FLOOR[i] ** 2}.0E0)" for i in range(P)]
    return " + ".join(parts) + " AS d2"


BIN_SQL = f"least({LAST_BIN}, cast(floor({BINS_PER_UNIT} * ln(1 + d2)) AS bigint)) AS bin"
FIT = [*(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i in range(P) for j in range(i + 1))]


def _levels(df: DataFrame, levels: list[list[str]]) -> DataFrame:
    for level in levels:
        df = df.selectExpr("*", *level)
    return df


DETERMINANT_SQL = " * ".join(f"l{i}{i}" for i in range(P))


def _fit_of(binned: DataFrame, support: float) -> DataFrame:
    """Location and scatter of the `support` share with the smallest distances, by group and start."""
    from pyspark.sql import Window

    by_bin = binned.groupBy("gl", "gs", "start", "bin").agg(*map(F.expr, moments_sql()))
    w = Window.partitionBy("gl", "gs", "start")
    up = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inner = by_bin.select("*", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("before"), F.sum("n").over(w).alias("total"))
    inner = inner.filter(f"before < {support}E0 * total").groupBy("gl", "gs", "start").agg(*map(F.expr, resummed_sql()))
    return _levels(inner, cholesky_sql()).select("gl", "gs", "start", *FIT)


def robust_outliers(stats: DataFrame, support: float = SUPPORT, steps: int = STEPS, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """`stats` (as of ``base_statistics``) with group, distance and ``kept``.

    `stats` is read once a concentration step, so pass a written table.
    """
    named = [f"cast({x} AS bigint) AS q{i}" for i, x in enumerate(vector_sql())]
    fitted = stats.filter(~F.col("base_failed"))
    # A letter before the value keeps null, and the names of pools, apart from every value.
    keyed = lambda c: F.concat(F.lit("="), F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit("null")))
    sizes = fitted.groupBy(keyed("lang").alias("kl"), keyed("source").alias("ks")).agg(F.count(F.lit(1)).alias("n_group"))
    small = sizes.filter(F.col("n_group") < min_group)
    pools = small.groupBy("kl").agg(F.sum("n_group").alias("n_lang"))
    rest = pools.filter(F.col("n_lang") < min_group).agg(F.coalesce(F.sum("n_lang"), F.lit(0)).alias("n_rest"))
    groups = (
        sizes.join(pools, "kl", "left").crossJoin(rest)  # one row of totals
        .select(
            "kl", "ks",
            F.when(F.col("n_group") >= min_group, F.col("kl")).when(F.col("n_lang") >= min_group, F.col("kl")).when(F.col("n_rest") >= MIN_POOL, F.lit("*")).alias("gl"),
            F.when(F.col("n_group") >= min_group, F.col("ks")).otherwise(F.lit("*")).alias("gs"),
        )
    )
    groups = written(groups, "groups")  # a row for each source and language: broadcast if its size allows
    vectors = (
        fitted.select("*", keyed("lang").alias("kl"), keyed("source").alias("ks"))
        .join(groups, ["kl", "ks"])
        .selectExpr("doc_id", "kl", "ks", "gl", "gs", *named)
    )
    usable = vectors.filter(F.col("gl").isNotNull())
    quarter = lambda i, share: F.percentile(f"q{i}", F.lit(share))
    quartiles = usable.groupBy("gl", "gs").agg(
        *(quarter(i, share).alias(f"{name}{i}") for i in range(P) for name, share in (("a", 0.5), ("lo", 0.25), ("hi", 0.75))),
        *((quarter(i, 0.75) - quarter(i, 0.25)).alias(f"b{i}") for i in range(P)),
    )
    quartiles = written(quartiles, "quartiles")
    begun = F.explode(F.array(*map(F.lit, STARTS))).alias("start")
    distances = usable.join(quartiles, ["gl", "gs"]).select("*", begun).selectExpr("*", start_sql())
    for _ in range(steps):
        fits = written(_fit_of(distances.selectExpr("*", BIN_SQL), support), "fit")
        distances = _levels(usable.join(fits, ["gl", "gs"]), distance_levels())
    least = F.min_by(F.struct(*FIT), F.struct(F.expr(DETERMINANT_SQL).alias("det"), "start")).alias("fit")
    fit = written(fits.groupBy("gl", "gs").agg(least).select("gl", "gs", "fit.*"), "least")
    # Groups and estimates are small tables by group; a row meets its verdict without another shuffle of documents.
    judged = stats.select("*", keyed("lang").alias("kl"), keyed("source").alias("ks")).join(groups, ["kl", "ks"], "left").join(fit, ["gl", "gs"], "left")
    judged = judged.selectExpr("*", *(f"CASE WHEN n_words > 0 THEN {x} END AS q{i}" for i, x in enumerate(vector_sql())))
    judged = _levels(judged, distance_levels())
    return judged.select(
        *stats.columns,
        F.col("d2").alias("distance"),
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).alias("kept"),
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """Statistics and verdict of every document, one row for each row of `docs`."""
    return robust_outliers(written(base_statistics(docs), "statistics"))


def keep_good(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that the rules reject; columns as they are."""
    key = F.struct("doc_id", F.xxhash64("text").alias("th"), "lang", "source")
    found = quality_rules(docs.select(key.alias("doc_id"), "lang", "source", "text"))
    gone = found.filter(~F.col("kept")).select(*(F.col(f"doc_id.{c}").alias(f"__mr_{c}") for c in ("doc_id", "th", "lang", "source"))).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__mr_doc_id")) & (F.xxhash64("text") == F.col("__mr_th")) & F.col("lang").eqNullSafe(F.col("__mr_lang")) & F.col("source").eqNullSafe(F.col("__mr_source"))
    return docs.join(gone, same, "left_anti")


def oracle_sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL; columns as of the query over ``quality_rules``."""
    ctes = [
        f"""words AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
          list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
          list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln,
          row_number() OVER () AS rid FROM {table})""",
        """grams AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM words))""",
        """twice AS (SELECT rid, i FROM grams JOIN (SELECT rid, g FROM grams GROUP BY ALL HAVING count(*) > 1) USING (rid, g))""",
        """covered AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY rid)""",
        """stats AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
          length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
          coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '[^\\p{Lu}]', '', 'g'))::BIGINT AS n_upper, rid
          FROM words LEFT JOIN covered USING (rid))""",
        """base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
          '=' || coalesce('v' || lang, 'null') AS kl, '=' || coalesce('v' || source, 'null') AS ks FROM stats)""",
        "sizes AS (SELECT kl, ks, count(*) AS n_group FROM base WHERE NOT base_failed GROUP BY ALL)",
        f"pools AS (SELECT kl, sum(n_group) AS n_lang FROM sizes WHERE n_group < {MIN_GROUP} GROUP BY ALL)",
        f"rest AS (SELECT coalesce(sum(n_lang), 0) AS n_rest FROM pools WHERE n_lang < {MIN_GROUP})",
        f"""grp AS (SELECT kl, ks, CASE WHEN n_group >= {MIN_GROUP} OR n_lang >= {MIN_GROUP} THEN kl WHEN n_rest >= {MIN_POOL} THEN '*' END AS gl,
          CASE WHEN n_group >= {MIN_GROUP} THEN ks ELSE '*' END AS gs FROM sizes LEFT JOIN pools USING (kl), rest)""",
        f"usable AS (SELECT gl, gs, {', '.join(f'cast({x} AS bigint) AS q{i}' for i, x in enumerate(vector_sql()))} FROM base JOIN grp USING (kl, ks) WHERE NOT base_failed AND gl IS NOT NULL)",
        f"quart AS (SELECT gl, gs, {', '.join(f'quantile_cont(q{i}, 0.5) AS a{i}, quantile_cont(q{i}, 0.25) AS lo{i}, quantile_cont(q{i}, 0.75) AS hi{i}, quantile_cont(q{i}, 0.75) - quantile_cont(q{i}, 0.25) AS b{i}' for i in range(P))} FROM usable GROUP BY ALL)",
        f"dist0 AS (SELECT gl, gs, start, {', '.join(f'q{i}' for i in range(P))}, {start_sql()} FROM usable JOIN quart USING (gl, gs), (VALUES {', '.join(f'({k})' for k in STARTS)}) v(start))",
    ]
    for k in range(STEPS):
        ctes += [
            f"bin{k} AS (SELECT *, {BIN_SQL} FROM dist{k})",
            f"mom{k} AS (SELECT gl, gs, start, bin, {', '.join(moments_sql())} FROM bin{k} GROUP BY ALL)",
            f"cum{k} AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY gl, gs, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY gl, gs, start) AS total FROM mom{k})",
            f"in{k}_0 AS (SELECT gl, gs, start, {', '.join(resummed_sql())} FROM cum{k} WHERE before < {SUPPORT}E0 * total GROUP BY ALL)",
        ]
        levels = cholesky_sql()
        ctes += [f"in{k}_{i + 1} AS (SELECT *, {', '.join(level)} FROM in{k}_{i})" for i, level in enumerate(levels)]
        ctes.append(f"fit{k} AS (SELECT gl, gs, start, {', '.join(FIT)} FROM in{k}_{len(levels)})")
        if k < STEPS - 1:
            ctes.append(f"d{k}_0 AS (SELECT * FROM usable JOIN fit{k} USING (gl, gs))")
            ctes += [f"d{k}_{i + 1} AS (SELECT *, {', '.join(level)} FROM d{k}_{i})" for i, level in enumerate(distance_levels())]
            ctes.append(f"dist{k + 1} AS (SELECT gl, gs, start, {', '.join(f'q{i}' for i in range(P))}, d2 FROM d{k}_{P + 1})")
    ctes.append(f"least AS (SELECT * EXCLUDE (start, r) FROM (SELECT *, row_number() OVER (PARTITION BY gl, gs ORDER BY {DETERMINANT_SQL}, start) AS r FROM fit{STEPS - 1}) WHERE r = 1)")
    ctes.append(f"j_0 AS (SELECT * FROM (SELECT *, {', '.join(f'CASE WHEN n_words > 0 THEN {x} END AS q{i}' for i, x in enumerate(vector_sql()))} FROM base LEFT JOIN grp USING (kl, ks)) LEFT JOIN least USING (gl, gs))")
    ctes += [f"j_{i + 1} AS (SELECT *, {', '.join(level)} FROM j_{i})" for i, level in enumerate(distance_levels())]
    return f"""WITH {', '.join(ctes)}
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND coalesce(d2 <= {CUTOFF}E0, true) AS kept FROM j_{P + 1}"""
