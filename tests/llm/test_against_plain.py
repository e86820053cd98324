"""Operators against plain versions of what they compute."""

import base64
import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import contract, langid, linededup, mixing, packing, quality, repeats, simhash, sketch, tokencount
from millrace.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r for r in docs.collect()}


def test_quality_base(docs, texts):
    for r in quality.quality_rules(docs).collect():
        words = WORD.findall(texts[r["doc_id"]]["text"])
        grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
        assert (r["n_words"], r["n_repeat_words"]) == (len(words), len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_quality_rejects_what_is_unlike_its_group(spark):
    good = [(i, " ".join(random.Random(i).choices("alpha beta gamma delta epsilon zeta eta theta iota kappa".split(), k=120)) , "en", "s") for i in range(80)]
    bad = [(1000 + i, " ".join(w + "###" for w in t.split()), "en", "s") for i, (_, t, _, _) in enumerate(good[:8])]
    found = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).filter("not base_failed").collect()}
    assert all(k for i, k in found.items() if i < 1000) and not any(k for i, k in found.items() if i >= 1000)


def test_quality_rejects_repetition_alone(spark):
    """45 % of the words in repeated windows, in a group without any: rejected; the clean ones stay."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(4000)]
    rows = [(i, " ".join(rng.sample(words, 200)), "en", "s") for i in range(90)]
    part = rng.sample(words, 45)
    rows.append((500, " ".join([*part, *rng.sample(words, 55), *part, *rng.sample(words, 55)]), "en", "s"))
    found = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not found[500]["base_failed"] and found[500]["n_repeat_words"] == 90 and not found[500]["kept"]
    assert sum(r["kept"] for r in found.values()) >= 89


def test_quality_takes_the_smallest_determinant(spark):
    """Two crowds: the tighter one, three quarters of the documents, is the estimate whichever start finds it."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(3000)]
    crowd = lambda i, share: (i, " ".join(w + ("#" if rng.random() < share else "") for w in rng.sample(words, 150)), "en", "s")
    rows = [crowd(i, 0.0) for i in range(120)] + [crowd(1000 + i, rng.uniform(0.1, 0.9)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.quality_rules(docs).filter("kept").collect()}
    assert set(range(120)) <= kept and len(kept) < 125


def test_quality_slow_path(spark):
    """The count of repeated windows by whole strings equals that by hashes."""
    text = " ".join(random.Random(1).choices("a b c d".split(), k=300))
    row = quality.base_statistics(spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")).first()
    words = text.split()
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    assert row["n_repeat_words"] == len({i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)})


def test_sketch_edits_and_estimates(docs, texts):
    ids = sorted(texts, reverse=True)
    found = {r["doc_id"]: r for r in sketch.edited_and_next(docs).collect()}
    errors = []
    for i, k in enumerate(ids):
        own, nxt = texts[k]["text"], texts[ids[(i + 1) % len(ids)]]["text"]
        half = len(own) // 2
        edited = own[: len(own) - half] + nxt[:half]
        assert found[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        shingles = lambda t: set(zip(*(WORD.findall(t)[j:] for j in range(5)), strict=False))
        mine = shingles(own)
        if len(mine) > 200:
            errors.append(abs(len(mine & shingles(edited)) / len(mine) - found[k]["near_edited"]))
    assert sum(errors) / len(errors) < 0.1


def test_sketches_against_plain_hashes(spark, docs):
    """Fingerprints and likeness of every row; short texts that lie in the next one, and a long one of a single shingle, too."""
    rng = random.Random(5)
    longer = [" ".join(rng.choices([f"w{i}" for i in range(400)], k=900)) for _ in range(40)]
    made = [(2 * i + 1, " ".join(t.split()[i : i + 1 + i % 12])) for i, t in enumerate(longer)] + [(2 * i, t) for i, t in enumerate(longer)]
    made += [(101, "so " * 3000), (100, "and " * 500 + "so " * 9), (99, None), (98, "")]
    own = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000_000 + i, t) for i, t in made], "doc_id long, text string"))

    def hashes(text):
        words, out = WORD.findall(text), []
        for i in range(len(words) - 4):
            h = 42
            for w in words[i : i + 5]:
                h = xxhash.xxh64_intdigest(w.encode(), seed=h)
            out.append(h)
        return set(out) or ({xxhash.xxh64_intdigest(" ".join(words).encode(), seed=42)} if words else set())

    def held(all_of):
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        return sorted((h for h in all_of if h >> 61 == 0), key=signed) or sorted(all_of)[:1]

    def likeness(a, b):
        low, other = {h for h in a if h >> 61 == 0}, {h for h in b if h >> 61 == 0}
        if not a:
            return float(not b)
        return len(low & other) / len(low) if low else len(a & b) / len(a)

    rows = sorted(((r["doc_id"], r["text"] or "") for r in own.collect()), reverse=True)
    found = {r["doc_id"]: r for r in sketch.edited_and_next(own).collect()}
    assert len(found) == len(rows)
    stand_ins = 0
    for i, (k, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        a, b, c = hashes(text), hashes(edited), hashes(following)
        r = found[k]
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple("".join(f"{h:016x}" for h in held(x)) for x in (a, b))
        assert (r["near_edited"], r["near_next"]) == (likeness(a, b), likeness(a, c))
        stand_ins += bool(a) and not any(h >> 61 == 0 for h in a) and r["near_next"] == 1.0
    assert stand_ins > 10


def test_sketches_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(200)), " ".join(f"b{i}" for i in range(300))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = sketch.with_sketch(sketch.with_sketch(df, "a", "x"), "b", "y")
    row = df.select(sketch.merged(F.col("x"), F.col("y")).alias("m"), "x", "y").first()
    assert row["m"] == sorted(set(row["x"]) | set(row["y"]))


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(["▁a", "b", "ab", "▁ab", "bb", "▁"])
    rng = np.random.default_rng(0)
    chances = rng.random((pieces.size, 3)) / 10
    names = sorted(["▁a", "b", "ab", "▁ab", "bb", "▁"])
    number = {p: i + 1 for i, p in enumerate(names)}

    def total(text, k):
        if not text:
            return 1.0
        out = 0.0
        for n in range(1, len(text) + 1):
            head = text[:n]
            if head in number:
                out += chances[number[head], k] * total(text[n:], k)
            elif n == 1:
                out += chances[0, k] * total(text[n:], k)
        return out

    for word in ("▁ab", "▁abb", "▁bba", "▁x", "▁"):
        got = langid.log_chances(pieces, [word], chances)[0] + len(word) * math.log(langid.LIFT)
        assert np.allclose(got, [math.log(total(word, k)) for k in range(3)])


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.identify(docs, contract.tokenizer_path("piece_bpe_32k.model")).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held) > 0.97


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bit_parallel_distance(spark):
    rng = random.Random(5)
    pairs = []
    while len(pairs) < 400:
        a = "".join(rng.choices("abé", k=rng.randint(0, 28)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 1)] = rng.choices("abc", k=rng.randint(0, 1))
        if abs(len(a) - len(b)) <= 2:
            pairs.append((a, "".join(b)))
    chars = lambda x: F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", linededup.within(F.col("a"), F.col("b")).alias("w"), linededup._banded(chars(F.col("a")), chars(F.col("b")), 2).alias("v")
    )
    for r in rows.collect():
        assert r["w"] == r["v"] == (_distance(r["a"], r["b"]) <= 2), r


def test_edits_change_letter_counts_by_two_at_most(spark):
    rng, pairs = random.Random(3), []
    for _ in range(600):
        a = "".join(rng.choices(linededup.COUNTED + "zé", k=rng.choice([20, 21, 80, 150])))
        b = list(a)
        for _ in range(2):
            at, kind = rng.randrange(len(b)), rng.randrange(3)
            b[at : at + (kind != 0)] = rng.choice(linededup.COUNTED) if kind < 2 else ""
        pairs.append((a, "".join(b)))
    of = lambda c: linededup.letter_counts(F.col(c))
    found = spark.createDataFrame(pairs, "a string, b string").select(linededup.counts_apart(of("a"), of("b")).alias("d")).collect()
    assert 0 < max(r["d"] for r in found) <= 4


def test_near_lines_of_several_lengths(spark):
    rng, rows, links = random.Random(4), [], 0
    for n in (30, 96, 97, 98, 400):
        for _ in range(15):
            a = "".join(rng.choices("abcdefgh ", k=n))
            b = list(a)
            for _ in range(2):
                at, kind = rng.randrange(len(b)), rng.randrange(3)
                b[at : at + (kind != 0)] = "#" if kind < 2 else ""
            rows += [(len(rows), a), (len(rows) + 1, "".join(b))]
            links += 1
    report = linededup.dedup_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sum(r["n_near"] for r in report) == links and sorted(r["doc_id"] for r in report if r["n_near"]) == list(range(1, len(rows), 2))


def test_edits_far_inside_very_long_lines(spark):
    n, pairs = 2_000_000, []
    line = "".join(random.Random(6).choices("abcdefgh ", k=n))

    def changed(*places):
        out = list(line)
        for p in places:
            out[p] = "X"
        return "".join(out)

    # Long common beginnings, ends and both.
    for places in ((1_200_000, 1_700_000), (300_000, 900_000), (1_500_000, 1_500_010), (1_999_999,), (0, 1_200_000, 1_999_000)):
        pairs.append((len(places) <= 2, line, changed(*places)))
    pairs.append((True, line, line[:1_100_000] + line[1_100_001:1_900_000] + "X" + line[1_900_000:]))
    pairs.append((True, "a" * (1 << 20), "a" * (1 << 20) + "b"))
    found = spark.createDataFrame(pairs, "near boolean, a string, b string").repartition(4).select("near", linededup.within(F.col("a"), F.col("b")).alias("w")).collect()
    assert all(r["w"] == r["near"] for r in found)
    docs = spark.createDataFrame([(1, line), (2, changed(1_500_000, 1_500_010)), (3, changed(5, 1_200_000, 1_200_009))], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_near"], r["n_links"]) for r in linededup.dedup_report(docs).collect()) == [(1, 0, 1), (2, 1, 1), (3, 0, 0)]


def test_common_length_of_lines(spark):
    pairs = [("a" * i + x, "a" * j + y) for i in range(10) for j in range(10) for x in ("", "b", "ca") for y in ("", "b", "da")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", linededup._common(F.col("a"), F.col("b"), F.left).alias("n"))
    assert all(r["n"] == len(os.path.commonprefix([r["a"], r["b"]])) for r in rows.collect())


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefgh ", k=rng.randint(15, 45))).strip() + "z" for _ in range(30)]
    docs = []
    for i in range(25):
        lines = []
        for _ in range(4):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                line[rng.randrange(len(line))] = rng.choice("abcxyz")
            lines.append("".join(line))
        docs.append((i, "\n".join(lines) + rng.choice(["", "\n \n"])))
    seen, want, near = {}, [], 0
    for i, t in docs:
        kept = []
        for k, line in enumerate(t.split("\n")):
            if not line.strip():
                kept.append(line)
            elif line not in seen:
                seen[line] = (i, k)
    for i, t in docs:
        kept = []
        for k, line in enumerate(t.split("\n")):
            if line.strip():
                earlier = [x for x in seen if seen[x] < seen[line] and len(line) >= 20 and len(x) >= 20 and _distance(x, line) <= 2]
                near += bool(earlier) and seen[line] == (i, k)
                if seen[line] != (i, k) or earlier:
                    continue
            kept.append(line)
        want.append((i, "\n".join(kept)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert near > 3
    assert sorted(map(tuple, linededup.dedup_lines(frame).collect())) == want
    report = linededup.dedup_report(frame).agg(F.sum("n_near")).first()[0]
    assert report == near


def test_token_counts_against_word_by_word():
    path = contract.tokenizer_path("piece_bpe_32k.model")
    scores = tokencount.piece_scores(path)
    words = sorted({"hello", "help", "helping", "хай", "naïve", "x" * 40, "the", "then", "thenth", "😀a"})

    def plain(word):
        text = "▁" + word
        best = [(0, 0)]
        for end in range(1, len(text) + 1):
            size = len(text[end - 1].encode())
            options = [(best[end - 1][0] + size * tokencount.UNKNOWN, -(-best[end - 1][1] + size))]
            options += [(best[s][0] + scores[text[s:end]], best[s][1] - 1) for s in range(end) if text[s:end] in scores]
            best.append(max(options))
        return -best[-1][1]

    trie = tokencount.Trie(scores)
    assert trie.count(words) == [plain(w) for w in words]
    assert trie.nodes < sum(len(w) + 1 for w in words)


def test_simhash_components(docs, texts):
    found = {r["doc_id"]: r for r in contract.queries()["op7_simhash_near_dedup"](docs.sparkSession, "/root/testdata/sf0.001").collect()}
    ids = sorted(texts)

    def plain(text):
        words = WORD.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: plain(texts[i]["text"]) for i in ids}
    assert all(found[i]["fingerprint"] == f"{prints[i]:016x}" for i in ids)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(ids, 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert all(found[i]["component_id"] == find(i) for i in ids)


def test_vantage_search_finds_all_pairs():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**64, 2500, dtype=np.uint64)
    near = values[:600].copy()
    for i in range(len(near)):
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            near[i] ^= np.uint64(1) << np.uint64(b)
    values = np.unique(np.concatenate([values, near]))
    want = simhash.Forest(len(values))
    for i in range(len(values)):
        j = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4)
        want.join(np.full(len(j), i), j)
    label = simhash.search(values, values, 4)
    got = simhash.Forest(len(values))
    for half in (label[: len(values)], label[len(values) :]):
        got.join(np.arange(len(values)), half % len(values))
    assert np.array_equal(got.label, want.label)
    tree = simhash.fit_tree(values[::3], 5)
    own, index, shard = simhash.route(values, tree, 5, 4)
    asked = set(zip(index.tolist(), shard.tolist(), strict=True))
    for i in range(0, len(values), 7):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4):
            low, high = (i, j) if own[i] <= own[j] else (j, i)
            assert own[low] == own[high] or (low, own[high]) in asked


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 102), (102, 101), (7, 3)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(found[i] == 0 for i in range(61)) and {found[i] for i in (100, 101, 102)} == {100}


def test_mixing_targets_and_quotas(docs, texts):
    rows = mixing.draws(mixing.sized(docs)).collect()
    assert sorted(rows, key=str) == sorted(mixing.draws(mixing.sized(docs)).collect(), key=str)
    size = collections.Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]]["text"])) and len(r["copies"]) <= 2
        size[r["source"]] += r["size"]
    free, left, target = set(size), 1.5 * sum(size.values()), {}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 2 * size[s]]
        for s in full or free:
            target[s] = 2 * size[s] if full else level * weight[s]
        if not full:
            break
        left -= sum(target[s] for s in full)
        free -= set(full)
    for r in rows:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * target[r["source"]] and r["source_size"] == size[r["source"]]
    taken = collections.Counter()
    for r in rows:
        taken[r["source"]] += len(r["copies"]) * r["size"]
    assert abs(sum(taken.values()) - sum(target.values())) < 0.05 * sum(target.values())


def test_mixing_meets_each_target_beside_very_long_documents(spark):
    rng = random.Random(4)
    rows = [(1000 * s + i, f"s{s}", n) for s in range(12) for i, n in enumerate([rng.randint(40, 160) for _ in range(300)] + [20_000] * 5)]
    found = mixing.draws(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert len(found) == len(rows)
    for s in {r["source"] for r in found}:
        mine = [r for r in found if r["source"] == s]
        missing = mine[0]["target"] - sum(len(r["copies"]) * r["size"] for r in mine)
        assert abs(missing) < 0.01 * mine[0]["target"]
        most = max(len(r["copies"]) for r in mine)
        assert all(r["size"] > missing for r in mine if len(r["copies"]) < most)


def test_documents_without_words_have_two_copies_at_most(spark):
    """A source held at twice its words: nothing is a third time in the mix, and all copies have a shard."""
    rows = [(i, "a", "w " * 40 if i % 2 else "") for i in range(60)] + [(100 + i, "b", "w " * 4000) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.draws(mixing.sized(docs)).collect()
    assert max(len(r["copies"]) for r in found) == 2
    assert sum(len(r["copies"]) * r["size"] for r in found if r["source"] == "a") == 2 * 30 * 40
    mixed = mixing.by_shard(mixing.mix(docs, 8)).withColumn("p", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id()).orderBy("k").collect()
    assert len(mixed) == sum(len(r["copies"]) for r in found)
    places = collections.defaultdict(list)
    for r in mixed:
        places[r["shard"]].append((r["p"], r["order_key"]))
    assert len(places) > 1
    for held in places.values():
        assert len({p for p, _ in held}) == 1 and [k for _, k in held] == sorted(k for _, k in held)


def test_fitting_follows_the_order(spark):
    rng, order, want = random.Random(8), {}, {}
    for s in range(20):
        order[f"s{s}"] = sorted({(rng.randrange(30), rng.randrange(5)) for _ in range(60)})
    rows = [(s, place, row, rng.choice([1, 2, 5, 30, 400])) for s in order for place, row in order[s]]
    gaps = {s: float(rng.choice([0, 1, 90, 600.5, 10**6])) for s in order}
    for s, room in gaps.items():
        want[s] = set()
        for _, place, row, size in (r for r in rows if r[0] == s):
            if size <= room:
                want[s].add((place, row))
                room -= size
        want[s, "missing"] = room
    left = spark.createDataFrame(rows, "skey string, place long, row int, size long")
    parts, missing = mixing.fitting(left, spark.createDataFrame(list(gaps.items()), "skey string, missing double"))
    assert {(s, "missing"): m for s, m in missing.collect()} == {k: v for k, v in want.items() if isinstance(k, tuple)}
    taken = left.join(parts, ["skey", "place"]).filter("size <= upper AND (rows IS NULL OR array_contains(rows, row))").collect()
    assert sorted((r["skey"], r["place"], r["row"]) for r in taken) == sorted((s, *p) for s in order for p in want[s])


def test_splitting_tree_is_exact_and_fair(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 300), ("c", 1), ("d", 0)], "skey string, quota long")
    rows = mixing.split_quotas(quotas, 3).collect()
    by = collections.defaultdict(dict)
    for r in rows:
        by[r["skey"]][r["shard"]] = r["quota"]
    assert {s: sum(q.values()) for s, q in by.items()} == {"a": 1000, "b": 300, "c": 1, "d": 0}
    for shard in range(8):
        assert abs(sum(by[s][shard] for s in by) - 1301 / 8) <= 1
        assert 60 < by["a"][shard] < 180
    for s in by:
        ranges = sorted((r["first"], r["quota"]) for r in rows if r["skey"] == s and r["quota"])
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(ranges))


def test_hypergeometric_follows_its_distribution(spark):
    draws = spark.range(4000).select(mixing.hypergeometric(F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(10).cast("long"), (F.col("id") + 0.5) / 4000).alias("x"))
    got = dict(map(tuple, draws.groupBy("x").count().collect()))
    for k in range(11):
        want = 4000 * math.comb(20, k) * math.comb(30, 10 - k) / math.comb(50, 10)
        assert abs(got.get(k, 0) - want) <= 2


def test_packing_plan():
    rng = random.Random(2)
    for _ in range(30):
        counts = collections.Counter(rng.choices(range(1, 101), k=rng.randint(1, 60)))
        plan = packing.plan(counts, 100)
        used = collections.Counter()
        for items, n in plan:
            assert sum(items) <= 100
            for x in items:
                used[x] += n
        assert used == counts
        assert packing.lower_bound(counts, 100) <= sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(counts, 100))
    # Best-fit decreasing needs three bins here; completion finds the two of the bound.
    assert sum(n for _, n in packing.plan({6: 1, 4: 1, 3: 2, 2: 2}, 10)) == 2


def test_completion_is_below_best_fit():
    """Sixty pieces that fill twenty sequences without waste: best-fit decreasing needs one more, completion does not."""
    better = 0
    for seed in (1, 2, 4, 7, 10, 18, 23, 25):
        rng, pieces = random.Random(seed), []
        for _ in range(20):
            a = rng.randint(300, 480)
            b = rng.randint(150, min(400, 900 - a))
            pieces += [a, b, 1000 - a - b]
        counts = dict(collections.Counter(pieces))
        plan = packing.plan(counts, 1000)
        used = collections.Counter()
        for items, n in plan:
            used.update({x: n * k for x, k in collections.Counter(items).items()})
            assert sum(items) <= 1000
        assert used == counts
        better += sum(n for _, n in plan) == 20 < sum(n for _, n in packing.best_fit(counts, 1000))
    assert better >= 6


def test_fullest_filling():
    rng = random.Random(8)
    for _ in range(50):
        counts = collections.Counter(rng.choices(range(3, 30), k=8))
        room = rng.randint(5, 90)
        filling = packing.fullest(sorted(counts), dict(counts), room)
        assert not collections.Counter(filling) - counts
        sums = {0}
        for x in counts.elements():
            sums |= {y + x for y in sums}
        assert sum(filling) == max(y for y in sums if y <= room)


def test_packed_ids(docs, texts):
    from tokenizers import Tokenizer

    path = contract.tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = collections.defaultdict(dict)
    for r in packing.pack(docs, path).collect():
        rows[r["doc_id"]][r["piece"]] = r
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t["text"], add_special_tokens=False).ids, 0], "<u4")
        for piece, r in rows[i].items():
            part = ids[2048 * piece : 2048 * (piece + 1)]
            assert (r["start"], r["length"], r["ids_crc32"]) == (2048 * piece, len(part), zlib.crc32(part.tobytes()))
        assert len(rows[i]) == -(-len(ids) // 2048)


def test_plain_words_equal_the_tokenizer():
    import pyarrow as pa

    path = contract.tokenizer_path("word_bpe_49k.json")
    words = packing.WordIds(path)
    assert words._direct
    hard = ["It's we'LL x'S", "a b", "<|endoftext|> <|ENDOFTEXT|>", "é É İstanbul ẞ", "a1b22c333 $%&.,!", "½ ² 😀 ñandú|x", "", "  \n"]
    ids, counts = words.of(pa.array(hard))
    at = 0
    for text, n in zip(hard, counts, strict=True):
        assert ids[at : at + n].tolist() == words._tokenizer.encode(text, add_special_tokens=False).ids
        at += n


def plain_passages(texts, size=51):
    """Words of each document in windows of `size` words that another document has."""
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    owners = collections.defaultdict(set)
    for i, w in words.items():
        for s in range(len(w) - size + 1):
            owners[tuple(w[s : s + size])].add(i)
    return {i: len({s + k for s in range(len(w) - size + 1) if len(owners[tuple(w[s : s + size])]) > 1 for k in range(size)}) for i, w in words.items()}


def test_passages_of_short_words_are_marked(spark):
    """51 words of under 400 bytes are a passage, though no byte goes; 50 are none, nor are repeats in one document."""
    rng = random.Random(9)
    own = lambda n: [rng.choice("abcdefgh") + rng.choice("ijklmno") + rng.choice("pqrstuvwxyz") for _ in range(n)]
    shared, fewer, inside = own(51), own(50), own(60)
    docs = {}
    for i in range(30):
        middle = (shared, fewer, inside + own(1) + inside)[i % 3] if i < 28 else []
        docs[i] = "  ".join(own(40)) + "\n" + " ".join(middle) + "\t" + " ".join(own(70))
    docs[2] = docs[5]  # a whole copy
    for i, (a, b) in enumerate([(300, 90), (60, 55), (52, 200), (53, 0)]):  # long runs of one word beside others
        docs[50 + i] = " ".join(["no"] * a + own(60) + ["no"] * b + own(5) + ["no"] * 51)
    docs[40] = None
    rows = repeats.remove_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    want = plain_passages(docs)
    assert {r["doc_id"]: r["n_passage_words"] for r in rows} == want
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] < 50 and r["doc_id"] not in (2, 5)) and want[0] >= 51 and want[1] < 50


def test_word_hashes_of_long_texts_are_those_of_short_ones():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 12))) for _ in range(90_000)]
    words[500], words[40_000], words[70_000] = "x" * 5000, "y" * 700_000, "z" * 1024
    text = "".join(w + rng.choice([" ", "\n", " \t"]) for w in words).encode()
    assert len(text) > 4 * repeats.CHUNK
    got, counts = repeats.word_hashes([text])
    assert counts.tolist() == [len(words)]
    alone = {w: repeats.word_hashes([b" " + w.encode()])[0][0] for w in {*words[:2000], *words[39_990:40_010], words[70_000]}}
    assert all(got[i] == alone[w] for i, w in enumerate(words) if w in alone)
    several, each = repeats.word_hashes([b"ab cd", b"", b"cd", b" ", b"ab"])
    assert each.tolist() == [2, 0, 1, 0, 1] and several[0] == several[3] and several[1] == several[2] != several[0]


def test_repeats_in_texts_above_a_chunk(spark):
    rng = random.Random(3)
    own = lambda n: "".join(rng.choices("abcdefg hij", k=n))
    passage = own(3000)
    size = repeats.CHUNK
    docs = [(1, own(size - 1500) + passage + own(size)), (2, own(200) + passage + own(50)), (3, own(2 * size + 7))]
    rows = {r["doc_id"]: r for r in repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert 3000 <= rows[1]["n_removed"] < 3010 and rows[1]["n_removed"] == rows[2]["n_removed"] and rows[3]["n_removed"] == 0
    assert rows[1]["n_passage_words"] > 200 and rows[3]["n_passage_words"] == 0


def test_repeats_against_all_windows(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghé", k=rng.randint(2, 8)))
    shared = " ".join(word() for _ in range(140))
    docs = []
    for i in range(40):
        own = " ".join(word() for _ in range(rng.randint(20, 200)))
        a = rng.randint(0, 300)
        docs.append((i, own[:400] + shared[a : a + rng.randint(300, 700)] + own[400:] if i % 2 else own))
    docs.append((90, docs[3][1]))
    docs.append((91, "ab" * 600))
    raw = {i: t.encode() for i, t in docs}
    seen = collections.Counter(t[s : s + 400] for t in raw.values() for s in range(len(t) - 399))
    passages = plain_passages(dict(docs))
    for mode in ("index", "hashes"):
        many = repeats.MANY
        repeats.MANY = many if mode == "index" else 1
        try:
            rows = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        finally:
            repeats.MANY = many
        for r in rows:
            t = raw[r["doc_id"]]
            gone = np.zeros(len(t), bool)
            for s in range(len(t) - 399):
                if seen[t[s : s + 400]] > 1:
                    gone[s : s + 400] = True
            assert r["n_removed"] == gone.sum() and bytes(r["kept"]) == bytes(np.frombuffer(t, np.uint8)[~gone])
            assert r["n_spans"] == (np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()
            assert r["n_passage_words"] == passages[r["doc_id"]]


def test_repeats_move_texts_once(spark, tmp_path):
    """One exchange holds the texts, read by both joins; tables that nothing reads any more are gone."""
    rng = random.Random(8)
    own = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared = own(900)
    docs = [(i, own(300) + shared[i % 7 * 50 :] + own(200)) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of a real size
    try:
        found = repeats.remove_repeats(spark.read.parquet(f"{tmp_path}/docs"))
        assert all(r["n_removed"] >= 600 for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plan = found._jdf.queryExecution().executedPlan().executedPlan().toString()
    assert plan.count("ReusedExchange [doc_id") == 1, [line for line in plan.splitlines() if "Exchange" in line]
    folder = next(f for f in found.inputFiles() if "/shared/part-" in f).removeprefix("file://").rsplit("/", 2)[0]
    assert os.listdir(folder) == ["shared"]


def test_matching_statistics():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(2, 80))
        symbols = np.concatenate([rng.integers(0, 2, n), [300]]).astype(np.int32)
        text = symbols.tolist()
        got = repeats.matching_statistics(symbols)
        for i in range(n):
            best = 0
            for j in range(n):
                k = 0
                while j != i and max(i, j) + k < len(text) and text[i + k] == text[j + k]:
                    k += 1
                best = max(best, k)
            assert got[i] == best


def test_window_bands_are_exact(spark):
    """Anchors of very many territories are split by distance; the result is the same."""
    rng = random.Random(6)
    shared = "".join(rng.choices("abcdef ", k=600))
    docs = [(i, "".join(rng.choices("uvwxyz ", k=300)) + shared + "".join(rng.choices("uvwxyz ", k=100))) for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    plain = sorted(map(tuple, repeats.remove_repeats(frame).collect()))
    many = repeats.VERY_MANY
    repeats.VERY_MANY = 2  # of words: 0
    try:
        assert sorted(map(tuple, repeats.remove_repeats(frame).collect())) == plain
    finally:
        repeats.VERY_MANY = many
    assert all(r[2] >= 600 for r in plain)  # neighbours of the passage may agree by chance


def test_archives(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    rows = pages.unionAll(pages.withColumn("page_id", F.col("page_id") + 1000).limit(10)).collect()
    found = contract.warc.archive_pages(spark.createDataFrame(rows, pages.schema)).collect()
    first = {}
    for r in rows:
        first[r["html"]] = min(first.get(r["html"], r["page_id"]), r["page_id"])
    want = []
    for r in rows:
        raw, head = r["html"].encode(), first[r["html"]]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((r["page_id"], len(raw), digest, "response" if head == r["page_id"] else "revisit", None if head == r["page_id"] else head))
    assert sorted(map(tuple, found)) == sorted(want)


def test_archives_of_several_members_and_long_records():
    import gzip

    body = bytes(range(256)) * 20_000
    head = lambda n, kind: f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{n}>\r\nX-Page-Id: {n}\r\nWARC-Payload-Digest: sha1:X\r\n"
    http = contract.warc.HTTP.encode()
    one = head(1, "response").encode() + f"Content-Length: {len(http) + len(body)}\r\n\r\n".encode() + http + body + b"\r\n\r\n"
    two = head(2, "revisit").encode() + b"Content-Length: 0\r\n\r\n\r\n\r\n"
    content = gzip.compress(one + two[:40]) + gzip.compress(two[40:] + one)
    rows = list(contract.warc.parse(contract.warc.unpacked(content), True))
    assert [(r[0], r[2], r[6]) for r in rows] == [(1, "response", len(body)), (2, "revisit", None), (1, "response", len(body))]
    assert rows[0][-1] == body and rows[0][3] == contract.warc.digest_of(body) and rows[1][3] == "X"
    for broken in (gzip.compress(one[:-9]), gzip.compress(one)[:-30], gzip.compress(one + two[:20])):
        with pytest.raises(ValueError):
            list(contract.warc.parse(contract.warc.unpacked(broken), False))


def test_archives_do_not_depend_on_splits(spark, tmp_path):
    """The input is split otherwise when the records are written than when the responses are chosen."""
    rows = [(i if i % 9 else None, f"u{i % 4}" if i % 5 else None, f"payload {i % 12}") for i in range(120)]
    rows += [(7, "u3", "payload 7")] * 3
    spark.createDataFrame(rows, "page_id bigint, url string, payload string").repartition(6).write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    minimum, cost = "spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"

    def split(many):
        spark.conf.set(minimum, "64" if many else "1")
        spark.conf.set(cost, str(1 << 27) if many else "1")

    found = []
    try:
        for many in (False, True):
            split(many)
            resolved = contract.warc.resolve(pages)
            split(not many)
            contract.warc.write_archives(resolved, f"{tmp_path}/archives{many}")
            found.append(contract.warc.read_archives(spark, f"{tmp_path}/archives{many}").collect())
    finally:
        spark.conf.unset(minimum)
        spark.conf.unset(cost)
    assert sorted(found[0], key=str) == sorted(found[1], key=str)
    ids = [r["record_id"] for r in found[0]]
    responses = {r["record_id"]: r for r in found[0] if r["record_type"] == "response"}
    assert len(ids) == len(set(ids)) == len(rows) and sorted(r["payload"].decode() for r in responses.values()) == sorted({r[2] for r in rows})
    assert all(responses[r["refers_to_record"]]["payload_digest"] == r["payload_digest"] for r in found[0] if r["record_type"] == "revisit")
