"""Every operator and stage over nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import contract, langid, linededup, mixing, packing, quality, repeats, simhash, sketch, tokencount, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, fp string, kept string, size string, copy string, h string"
PROSE = "one quick brown fox jumps over the lazy dog while seven other foxes look on and wonder why it does so again today"


def _rows():
    texts = [None, "", "   \n\t ", "word", PROSE, PROSE, PROSE + " now", "\n".join([PROSE] * 3), "1234 5678", "é ü 　x 😀 y", PROSE.upper()]
    texts.append(" ".join(f"w{i % 977}x{i % 31}" for i in range(30_000)))
    rows = [(i, t, "en" if i % 3 else None, "a" if i % 2 else None) for i, t in enumerate(texts)]
    rows += [(None, PROSE, "en", "a"), (None, None, None, None), (4, PROSE, "en", "a"), (4, "another text under one id", "de", "b")]
    rows += [(4, texts[4], rows[4][2], rows[4][3])] * 2  # repeated rows
    rows += [(100 + i, f"{PROSE} number {i} of the many like it {i * i} with words to make it long enough for rules " * 2, "en", "c") for i in range(40)]
    return [(*r, None if r[1] is None else len(r[1]), "x", "x", "x", "x", "x", "x") for r in rows]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


VOCABULARY, TOKENIZER = contract.tokenizer_path("piece_bpe_32k.model"), contract.tokenizer_path("word_bpe_49k.json")
PER_ROW = {
    "quality": quality.quality_rules,
    "sketch": sketch.edited_and_next,
    "langid": lambda d: langid.identify(d, VOCABULARY),
    "lines": linededup.dedup_report,
    "tokens": lambda d: tokencount.token_counts(d, VOCABULARY),
    "simhash": simhash.near_duplicates,
    "mixing": lambda d: mixing.draws(mixing.sized(d)),
    "repeats": repeats.remove_repeats,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_each_row(name, hard, empty):
    ids = sorted(map(str, (r["doc_id"] for r in hard.select("doc_id").collect())))
    assert sorted(map(str, (r["doc_id"] for r in PER_ROW[name](hard).collect()))) == ids
    assert PER_ROW[name](empty).collect() == []


def test_packing_keeps_all_ids(hard, empty):
    rows = packing.pack(hard, TOKENIZER).collect()
    assert len({r["doc_id"] for r in rows}) == len({r["doc_id"] for r in hard.collect()})
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty, TOKENIZER).collect() == []


def test_warc_hard_pages(spark):
    rows = [(1, "a", "x"), (None, None, "x"), (1, "a", "x"), (2, None, None), (3, "b\r\nc", ""), (None, None, None), (9, "z", "y" * 300_000)]
    found = warc.archive_pages(spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, payload string")).collect()
    assert len(found) == len(rows)
    xs = [r for r in found if r["payload_digest"] == warc.digest_of(b"x")]
    assert sorted(r["record_type"] for r in xs) == ["response", "revisit", "revisit"]
    assert all(r["refers_to"] == 1 and r["payload_bytes"] == 1 for r in xs if r["record_type"] == "revisit")
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archive_pages(none).collect() == []


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(k, spark, hard, empty):
    name, stage = corpus_pipeline.STAGES[k]
    out, none = stage(spark, hard, ""), stage(spark, empty, "")
    assert none.count() == 0
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == hard.columns
        kept = out.collect()
        assert kept and all(r["n_words"] == "x" and r["h"] == "x" for r in kept)
        if name == "line dedup":
            assert len(kept) == hard.count()


def test_repeated_rows_are_judged_alike(hard):
    found = {}
    for r in quality.quality_rules(hard.filter("doc_id = 4")).collect():
        found.setdefault((r["lang"], r["source"], r["n_words"]), set()).add(r["kept"])
    assert all(len(v) == 1 for v in found.values())


def test_equal_texts_have_equal_fingerprints(hard):
    rows = sketch.edited_and_next(hard.filter("text is not null")).select("doc_id", "fingerprint", "n_chars").collect()
    texts = {r["doc_id"]: r["text"] for r in hard.collect() if r["doc_id"] in (4, 5)}
    assert texts[5] == PROSE
    five = next(r["fingerprint"] for r in rows if r["doc_id"] == 5)
    assert any(r["doc_id"] == 4 and r["fingerprint"] == five for r in rows)


def test_repeats_of_repeated_rows(spark):
    long = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(20))
    rows = repeats.remove_repeats(spark.createDataFrame([(1, long), (1, long), (2, "short")], "doc_id bigint, text string")).collect()
    assert [r["n_removed"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [len(long), len(long), 0]


def test_simhash_keeps_one_of_repeated_rows(hard):
    kept = simhash.keep_one(hard.filter("doc_id = 4")).collect()
    assert len(kept) == len({r["text"] for r in hard.filter("doc_id = 4").collect()})


def test_und_without_letters(hard):
    found = {r["doc_id"]: r for r in langid.identify(hard, VOCABULARY).collect()}
    for i in (0, 1, 2, 8):
        assert found[i]["lang_pred"] == "und" and found[i]["score"] == 0.0
    assert hard.filter(F.col("doc_id") == 8).first()["text"] == "1234 5678"
