"""Small planted cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import math
import random

import numpy as np
import public_tokenizers
import pytest
from brute import best_products, contaminated, deduplicated, near_classes
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bayes, bpe, bpe_codec, components, decontaminate, langid, packing, sharding, substring, token_tree, url_filter, va_file

PATH = public_tokenizers.path("byte_bpe_50k.json")
DDL = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "word"), (4, "word"), (None, "lost and found"), (5, "x" * 30000), (6, "a b " * 4000), (7, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DDL)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def prose(rng, n, words=("red", "blue", "stone", "river", "cloud", "tree", "light", "house", "winter", "sand", "bird", "iron")):
    return " ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(n))


# language ID


def test_language_odd_rows(spark, odd):
    docs = odd.withColumn("lang", F.when(F.col("text").isNotNull(), "en")).withColumn("score", F.lit("mine"))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()]
    assert len(got) == len(ODD)
    assert sum(p == "und" and s == 0 for _, p, s in got) == 4
    assert langid.identify(docs.where("false")).count() == 0
    unlabeled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(unlabeled).collect()} == {"und"}
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(ODD) - 4


def test_language_scores_dont_depend_on_batches():
    data = np.frombuffer("Füße laufen. 12 ÉTÉ x".encode(), np.uint8)
    codes, marks = langid._letters(data, np.array([0, 13, len(data)]))
    assert "".join(map(chr, codes)) == " füße laufen été x "
    assert marks.tolist() == [0, 12, len(codes) - 1] or codes[marks].tolist() == [32, 32, 32]


@pytest.mark.parametrize("n_langs", [1, 2, 4])
def test_language_rejects_planted_junk_and_keeps_clean_rows(spark, n_langs):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lexicon = [["".join(rng.choice(own) for _ in range(rng.randint(2, 9))) for _ in range(150)] for own in ("aeinrst", "aoulmnd", "eiuchgk", "aobpvzt")]
    say = lambda i, n: " ".join(rng.choice(lexicon[i]) for _ in range(n))
    clean = [(i, say(i % n_langs, rng.randint(30, 80)), f"l{i % n_langs}") for i in range(400)]
    junk = [(1000 + i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(40)), None) for i in range(60)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in langid.keep_known(docs).collect()}
    assert sum(i in kept for i, _, _ in junk) == 0
    assert sum(i in kept for i, _, _ in clean) >= 396


def test_language_sample_is_bounded_and_takes_copies_once(spark):
    rows = spark.range(20000).select("id", F.lit("one text that all of them share").alias("text"), F.lit("en").alias("lang"))
    more = spark.range(300).select("id", F.concat(F.lit("text number "), "id").alias("text"), F.concat(F.lit("l"), F.col("id") % 2).alias("lang"))
    own = langid.Settings(sample_rows=60)
    got = langid.sample(rows.union(more), "text", "lang", F.col("text"), own)
    assert [r["lang"] for r in got].count("en") == 1
    assert len(got) <= 60
    assert len({(r["lang"], r["key"]) for r in got}) == len(got)
    few = langid.sample(more, "text", "lang", F.col("text"), langid.Settings(sample_rows=60, sample_grams=300))
    assert 0 < len(few) <= 300 / 3 / len("text number")


def test_language_with_more_labels_than_the_sample_has_rows(spark):
    rows = [(i, f"word{i % 400} again word{i % 400}", f"l{i % 400}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, settings=langid.Settings(sample_rows=100)).collect()
    assert len(got) == 1000
    assert 1 <= len({r["lang_pred"] for r in got}) <= 100


def test_temperature_is_inside_the_grid_and_calibrates():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 4, 400)
    for size in (0.01, 1.0, 50.0):
        sure = np.eye(4)[y] * size  # all predicted right, by logits of any size
        t = langid.calibrated(sure, y, 0.5)
        assert langid.TEMPERATURES[0] < t < langid.TEMPERATURES[-1]
        assert 0.99 < langid._softmax(sure / t).max(1).mean() < 1
    guess = np.where(rng.random(400) < 0.7, y, (y + 1) % 4)  # three of ten wrong
    p = langid._softmax(np.eye(4)[guess] * 30 / langid.calibrated(np.eye(4)[guess] * 30, y, 0.5))
    assert abs(p.max(1).mean() - (guess == y).mean()) < 0.05


def test_language_rejects_what_is_no_learned_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    noise = ["x", "これは日本語の文章です。今日は天気がいい。", "asdkjh qwelkj zxmcnb", "Αυτό είναι ένα κείμενο στα ελληνικά.", "Это русский текст для проверки"]
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(noise)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs.union(more)).collect()}
    assert all(got[-1 - i]["rejected"] and got[-1 - i]["score"] < 0.5 for i in range(len(noise)))
    own = [r for i, r in got.items() if i >= 0]
    assert sum(not r["rejected"] for r in own) >= 0.99 * len(own)


# sharding


def test_sharding_odd_rows(spark, odd, nothing):
    got = sharding.shard_documents(odd, shards=4).collect()
    counts = [sum(r["shard"] == s for r in got) for s in range(4)]
    assert sum(counts) == len(ODD)
    assert max(counts) - min(counts) <= 1
    assert sharding.shard_documents(nothing).count() == 0


def test_a_group_larger_than_a_shard_is_split_and_others_stay_whole(spark):
    docs = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"pair {i // 2}" if i % 3 == 1 else f"single {i}") for i in range(600)], DDL)
    got = sharding.shard_documents(docs, shards=6).toPandas()
    counts = got["shard"].value_counts()
    assert counts.max() - counts.min() <= 1
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    hot = got[got["doc_id"] % 3 == 0]["shard"].nunique()
    assert hot <= 4


def test_propagation_cuts_fewer_links_than_chance(spark):
    members = spark.createDataFrame([(n, n // 5) for n in range(500)] + [(n, 1000 + n // 50) for n in range(0, 500, 5)], "node long, link long")
    placed = sharding.propagate(members, [50] * 10)
    cut = sharding.cut_share(placed).first()
    assert cut["cut"] < 0.5 * float(cut["pairs"])


# token trees


def test_edits_equal_encoding_again(library):
    rng, enc = random.Random(5), bpe.encoder(PATH)
    letters = [*"abc de \n\t f's1.,", "<|endoftext|>", "  ", "é", "\x1c"]
    for _ in range(60):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 200)))
        leaves = token_tree.split_leaves(text, 16)
        assert "".join(leaves) == text
        tree = token_tree.Tree(leaves, token_tree.token_counts(leaves, enc))
        for _ in range(6):
            at, cut, more = rng.randint(-2, len(text) + 3), rng.choice([0, 1, 5, 40]), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 60])))
            tree.edit(at, cut, more, 16)
            at = min(max(at, 0), len(text))
            text = text[:at] + more + text[at + cut :]
            if rng.random() < 0.5:
                token_tree.encode_dirty([tree], enc)
        token_tree.encode_dirty([tree], enc)
        assert "".join(tree.leaves) == text
        assert tree.tokens[1] == len(library.encode(text, add_special_tokens=False).ids)
        assert tree.tokens[1] == sum(tree.tokens[tree.size :])


def test_token_trees_odd_rows(spark, odd, nothing, library):
    edit = F.array(F.struct(F.lit(1).alias("place"), F.lit(2).alias("delete"), F.lit("zz").alias("insert")), F.lit(None).cast("struct<place:int,delete:int,insert:string>"))
    built = token_tree.build(odd.withColumn("n_tokens", F.lit("mine")), PATH)
    got = token_tree.apply_edits(built.withColumn("edits", edit), PATH).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r["n_tokens"] == len(library.encode(r["text"], add_special_tokens=False).ids) == sum(r["leaf_tokens"])
    long = next(r for r in got if r["doc_id"] == 6)
    assert long["encoded_chars"] < 2000
    both = token_tree.count_edited(odd.withColumn("tokens_after", F.lit("mine")).withColumn("edits", edit), PATH).collect()
    want = [(r["doc_id"], r["n_tokens"], len(r["text"]), r["encoded_chars"], len(r["leaf_chars"])) for r in got]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["tokens_after"], r["chars_after"], r["encoded_chars"], r["n_leaves"])) for r in both)
    assert sum(r["tokens_before"] for r in both) == sum(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in ODD)
    assert token_tree.build(nothing, PATH).count() == 0
    none = token_tree.apply_edits(built.withColumn("edits", F.lit(None).cast("array<struct<place:int,delete:int,insert:string>>")), PATH)
    assert {r["encoded_chars"] for r in none.collect()} == {0}


# exact search


@pytest.mark.parametrize("scale", [1, 1000])
def test_top_k_equals_brute_force(spark, scale):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * scale for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = va_file.top_k(df, F.col("vec_id") % 50 == 0, bits=3)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = best_products(whole, [i for i, _ in rows if i % 50 == 0])
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_top_k_of_huge_components(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.randint(0, 12) for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in va_file.top_k(df, F.col("vec_id") % 50 == 0).collect())
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for q in (0, 50, 100):
        scored = sorted((-min(max(sum(a * b for a, b in zip(whole[q][1], v)), -(2**63)), 2**63 - 1), i) for i, v in whole if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])]
    assert got == want
    far = spark.createDataFrame([(0, [1e300, -1e300]), (1, [1e300, 1.0]), (2, [-1e300, 1e300]), (3, [2.0, 2.0])], "vec_id long, embedding array<double>")
    ends = va_file.top_k(far, F.col("vec_id") == 0).collect()
    assert [r["vec_id"] for r in ends] == [1, 3, 2]
    assert (ends[0]["score"], ends[2]["score"]) == (2**63 - 1, -(2**63))


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, []), (5, [1.0]), (6, [-1.0, 0.5]), (None, [1.0, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (50, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("mine"))
    got = [tuple(r) for r in va_file.top_k(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 7), (0, 2, 7), (0, 3, 6)]
    assert va_file.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


# near duplicates


def planted(rng):
    rows = []
    for g in range(12):
        base = prose(rng, 120).split()
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = "changed" + str(rng.randint(0, 9))
            rows.append(" ".join(own))
    hot = prose(rng, 60)
    rows += [hot] * 30 + [hot + f" tail{i % 90}" for i in range(150)]
    return [(i, t) for i, t in enumerate(rows)] + [(900, None), (901, None), (902, ""), (903, ""), (904, "one two"), (905, "one two"), (906, "one two three")]


def test_near_duplicates_equal_brute_force(spark):
    rows = planted(random.Random(11))
    links, classes = near_classes(rows)
    got = bayes.near_duplicates(spark.createDataFrame(rows, DDL).withColumn("class_id", F.lit("mine"))).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (classes[i], links[i]) for i, _ in rows}
    assert sum(r["is_first"] for r in got) == len(set(classes.values()))


def test_large_buckets_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(bayes, "BLOCK_ROWS", 40)
    rows = planted(random.Random(12))
    links, classes = near_classes(rows)
    got = bayes.near_duplicates(spark.createDataFrame(rows, DDL)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (classes[i], links[i]) for i, _ in rows}


def test_near_duplicates_odd_rows(spark, odd, nothing):
    got = bayes.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert [r["n_links"] for r in got if r["doc_id"] == 4] == [1, 1]
    assert bayes.near_duplicates(nothing).count() == 0
    kept = bayes.keep_first(odd.withColumn("digest", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "digest"]
    assert kept.count() == len(ODD) - 1


def test_each_candidate_counts_once_in_a_bucket_that_it_is_in(monkeypatch):
    # band 0: three equal values, and a fourth that agrees in 16 bits only; bands 3 and 7 are equal; the rest of the values mostly is
    import pyarrow as pa

    rng = np.random.default_rng(4)
    values = np.tile(rng.integers(0, 2**63, bayes.BANDS * bayes.ROWS, dtype=np.uint64), (2, 1))
    values[1, [4 * b for b in range(1, bayes.BANDS) if b not in (3, 7)]] += np.uint64(1)
    other = rng.integers(0, 2**63, 1 << 20, dtype=np.uint64)
    values[1, 2] = other[(bayes.mix(other) >> np.uint64(48)) == bayes.mix(values[:1, 2]) >> np.uint64(48)][0]
    monkeypatch.setattr(bayes, "minhash", lambda own, places: values)
    out = pa.Table.from_batches(bayes._signatures(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a", "b"]})]))).to_pylist()
    sig = np.array([np.frombuffer(r["sig"], "<u2") for r in out])
    assert (sig[0, :4] == sig[1, :4]).all()
    assert values[0, 2] != values[1, 2]
    counted = 0
    for b in range(bayes.BANDS):
        if out[0]["bands"][b] == out[1]["bands"][b]:
            p, _ = bayes.survivors(sig, np.array([b, b]), np.array([0]), np.array([1]), bayes.THRESHOLD, bayes.TOLERANCE)
            counted += len(p)
    assert counted == 1


def test_pruning_bound_is_a_tail_of_the_posterior():
    for n in (16, 48, 80):
        m = bayes.least_agreements(0.8, 1e-5, n)
        x = np.linspace(0, 1, 200001)
        density = x**m * (1 - x) ** (n - m)
        below = x ** (m - 1) * (1 - x) ** (n - m + 1)
        assert density[x >= 0.8].sum() / density.sum() >= 1e-5
        assert below[x >= 0.8].sum() / below.sum() < 1e-5


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# substring dedup


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    bases = [" ".join(rng.choice("abcé") for _ in range(60)) for _ in range(5)]
    rows = [(i, " \n".join(rng.choice(bases)[a : a + rng.randint(20, 100)] for a in [rng.randint(0, 40) for _ in range(rng.randint(0, 4))])) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "x " * 50), (1003, " ".join("abc" * 20)), (1004, " ".join("abc" * 20)), (1005, "w" * 3)]
    df = spark.createDataFrame(rows, DDL).withColumn("n_words", F.lit("mine"))
    got = substring.dedup(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(tuple(r) for r in got) == deduplicated(rows)


def test_substring_dedup_odd_rows(spark, odd, nothing):
    got = substring.dedup(odd).collect()
    assert len(got) == len(ODD)
    assert next(r for r in got if r["doc_id"] == 6)["n_removed"] == 7998
    assert substring.dedup(nothing).count() == 0
    kept = substring.dedup_text(odd.withColumn("kept", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "kept"]
    assert kept.count() == len(ODD)
    copies = spark.createDataFrame([(i, " ".join(map(str, range(30)))) for i in range(4)], DDL)
    assert [r["doc_id"] for r in substring.dedup_text(copies).collect()] == [0]


def test_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))
    with pytest.raises(ValueError, match="cover"):
        substring.dedup(None, cover=(0, 1))


# BPE


def test_bpe_equals_the_library_on_odd_texts(library):
    rng, enc = random.Random(1), bpe.encoder(PATH)
    letters = [*"abstrevlmd''' \n\t  0123.,!é日本ßÀ ́😀", "<|endoftext|>", "'re", "'s", "'ll ", "aaaa", "    ", "\r\n", "½", "Ⅷ", "\x1c", "\x85", "\0"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["", "a" * 5001, "'" * 77, " " * 99, "<|endoftext|>" * 3]
    got = []
    for a, z, flat, at in enc.lookup(texts):
        got += [flat[at[k] : at[k + 1]].tolist() for k in range(z - a)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [b"".join([enc.bytes_of[i] for i in x]).decode("utf-8", "replace") for x in got] == [library.decode(x, skip_special_tokens=False) for x in got]


def test_bpe_table_may_be_forgotten(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP", 3)
    monkeypatch.setattr(bpe, "CUT_CHARS", 50)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 150)
    enc = bpe.Encoder(PATH)
    texts = [prose(random.Random(i), 9) for i in range(30)]
    got = []
    for a, z, flat, at in enc.lookup(texts):
        got += [flat[at[k] : at[k + 1]].tolist() for k in range(z - a)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_tells_pre_tokens_of_one_hash_apart(library, monkeypatch):
    whole = bpe.span_hashes
    calls = []

    def weak(values, starts, ends):  # the first hash of each block has two bits, the other all
        calls.append(1)
        return whole(values, starts, ends) & (np.uint64(3) if len(calls) % 2 else np.uint64(2**64 - 1))

    monkeypatch.setattr(bpe, "span_hashes", weak)
    monkeypatch.setattr(bpe, "CUT_CHARS", 100)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 300)
    enc = bpe.Encoder(PATH)
    texts = [prose(random.Random(i), 9) for i in range(30)]
    got = []
    for a, z, flat, at in enc.lookup(texts):
        got += [flat[at[k] : at[k + 1]].tolist() for k in range(z - a)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_blocks_take_little_memory(library, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    enc = bpe.Encoder(PATH)
    data = np.random.default_rng(1).integers(97, 123, 1 << 20).astype(np.uint8)
    tracemalloc.start()
    enc.merge_all(data, np.arange(0, len(data) + 1, 8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(data)
    # of a column, only a block's texts are strings at once
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 150)
    seen, made = [], bpe.texts_of
    monkeypatch.setattr(bpe, "texts_of", lambda column: seen.append(len(column)) or made(column))
    texts = [None, "", *[prose(random.Random(i), 9) for i in range(30)], "é本😀" * 99, None]
    got = {}
    for a, z, flat, at in bpe.lookup_column(enc, pa.array(["x", *texts]).slice(1)):
        got |= {a + k: flat[at[k] : at[k + 1]].tolist() for k in range(z - a)}
    assert [got[i] for i in range(len(texts))] == [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert sum(seen) == len(texts) and max(seen) < 9


def test_bpe_special_tokens_are_taken_from_the_left(tmp_path):
    import json

    with open(PATH) as f:
        spec = json.load(f)
    new = [{**spec["added_tokens"][0], "id": 50257 + i, "content": c} for i, c in enumerate(["<bc>", "<a<bc>d>", "<a<", "d><a<"])]
    spec["added_tokens"] += new
    path = str(tmp_path / "more.json")
    with open(path, "w") as f:
        json.dump(spec, f)
    texts = ["<a<bc>", "<a<bc>d>", "x<a<bc>d><a< <bc><a<", "<a<<a<bc> d><a<bc>d>", "d>d><a<bc>d> dd"]
    enc = bpe.Encoder(path)
    got = []
    for a, z, flat, at in enc.lookup(texts):
        got += [flat[at[k] : at[k + 1]].tolist() for k in range(z - a)]
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    bare = str(tmp_path / "bare.json")
    with open(bare, "w") as f:
        json.dump({**spec, "added_tokens": []}, f)
    (one,) = bpe.Encoder(bare).lookup(texts)
    assert [one[2][one[3][k] : one[3][k + 1]].tolist() for k in range(len(texts))] == [e.ids for e in Tokenizer.from_file(bare).encode_batch(texts, add_special_tokens=False)]
    for key, value in (("lstrip", True), ("single_word", True)):
        with pytest.raises(ValueError, match=key):
            bpe.refuse_unsupported({**spec, "added_tokens": [{**new[0], key: value}]})
    with pytest.raises(ValueError, match="normalizer"):
        bpe.refuse_unsupported({**spec, "normalizer": {"type": "NFC"}})


def test_bpe_columns(spark, odd, nothing):
    coded = bpe_codec.encode(odd.withColumn("ids", F.lit("mine")), PATH, check=True)
    assert bpe_codec.encode(odd.withColumn("n_tokens", F.lit("mine")), PATH, keep_text=False).columns == ["doc_id", "ids", "n_tokens"]
    back = bpe_codec.decode(coded, PATH).collect()
    assert all(r["decoded"] == (r["text"] or "") and r["round_trip"] for r in back)
    assert bpe_codec.digests(nothing, PATH).count() == 0


# decontamination


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randint(1, 50))) for i in range(25)] + [(90, None), (91, ""), (92, "two words"), (93, "the the the the the the the the")]
    items.append((94, items[3][1].upper()))
    docs = [(i, prose(rng, 80)) for i in range(40)]
    for k, (_, t) in enumerate(items):
        w = (t or "").split()
        for j in range(3):
            own = list(w)
            for _ in range(j):
                if own:
                    own[rng.randrange(len(own))] = "other"
            docs.append((100 + 10 * k + j, prose(rng, 30) + "... " + ", ".join(own) + " - " + prose(rng, 20)))
    docs += [(900, None), (901, ""), (902, "The two WORDS"), (903, "the " * 40), (904, "two words"), (904, "two words")]
    df = spark.createDataFrame(docs, DDL).withColumn("item_id", F.lit("mine"))
    got = decontaminate.matches(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in got} == {k: round(v, 6) for k, v in contaminated(docs, items).items()}
    clean = decontaminate.keep_clean(df, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == df.columns
    bad = {i for i, _ in contaminated(docs, items)}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, _ in docs if i not in bad)


def test_decontamination_finds_windows_between_aligned_starts(spark):
    rng = random.Random(31)
    item = [f"w{i}" for i in range(100)]
    pad = lambda n: [f"p{rng.randrange(10**6)}" for _ in range(n)]
    docs = [(1, " ".join(pad(40) + item[3:50] + pad(6) + item[50:97] + pad(40)))]
    items = [(1, " ".join(item))] + [(i, prose(rng, rng.randint(20, 120))) for i in range(2, 8)] + [(8, "to be or not to be or not to be or not to be " * 3)]
    for i, text in items:
        for j in range(12):
            own = text.split()
            own = own[rng.randint(0, 3) : len(own) - rng.randint(0, 3)]
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(own))
                own[at : at + rng.choice([0, 0, 1])] = pad(rng.randint(0, 5))
            again = own if j % 4 == 3 else []
            docs.append((100 * i + j, " ".join(pad(rng.choice([0, 2, 30])) + own + pad(rng.choice([0, 1, 3])) + again + pad(rng.choice([0, 2, 30])))))
    df = spark.createDataFrame(docs, DDL)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contaminated(docs, items)
    assert round(want[1, 1], 4) == 0.8113
    got = decontaminate.matches(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in got} == {k: round(v, 6) for k, v in want.items()}
    assert [r["word"] for r in got if r["doc_id"] == 1] == [40]
    bad = {i for i, _ in want}
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(df, bench).collect()) == sorted(i for i, _ in docs if i not in bad)


def test_decontamination_of_items_changed_in_three_places(spark):
    """Two words replaced in front, three put into the middle, one replaced at the end: similarity near the threshold on both sides of it."""
    rng = random.Random(77)
    fresh = iter(range(10**6))
    new = lambda n: [f"new{next(fresh)}" for _ in range(n)]
    items = [(i, prose(rng, 60 + i % 20)) for i in range(40)]
    docs = []
    for i, text in items:
        w = text.split()
        at = len(w) // 2 + rng.randint(-10, 10)
        own = new(2) + w[2:at] + new(3) + w[at:-1] + new(1)
        docs.append((i, " ".join(new(rng.randint(0, 40)) + own + new(rng.randint(0, 40)))))
    want = contaminated(docs, items)
    assert 10 < len(want) < 40
    got = decontaminate.matches(spark.createDataFrame(docs, DDL), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in got} == {k: round(v, 6) for k, v in want.items()}


def test_decontamination_empty(spark, odd, nothing):
    items = spark.createDataFrame([(1, "lost and found")], "item_id long, text string")
    assert decontaminate.matches(nothing, items).count() == 0
    assert decontaminate.matches(odd, items.where("false")).count() == 0
    assert [r["doc_id"] for r in decontaminate.matches(odd, items).collect()] == [None]


def test_hamming_blocks_lose_nothing_within_the_radius(spark):
    rng = random.Random(2)
    pairs = []
    for i in range(200):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randint(0, 6)):
            b ^= 1 << k
        pairs.append((i, a - (1 << 63), b - (1 << 63)))
    df = spark.createDataFrame(pairs, "i long, a long, b long")
    left = df.select("i", decontaminate.blocks(F.col("a"), 6).alias("x"))
    right = df.select("i", decontaminate.blocks(F.col("b"), 6).alias("x"))
    assert left.join(right, ["i", "x"]).select("i").distinct().count() == 200


# URL filters


def test_url_filters(spark):
    urls = [None, "", "nothing", "http://a.com", "http://A.Com/", "https://x.a.com/en/1?q#f", "http://a.com/english", "http://ba.com/en/", "ftp://net/es/x", "http://user@net/es/", "x://a.com/en/", "http://.com/", "http://a.com?/en/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(5, urls[5])], "page_id long, url string").withColumn("host", F.lit("mine"))
    rules = spark.createDataFrame([("com", "/", "allow"), ("a.com", "/en", "block"), ("x.a.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/", "allow"), (None, "/", "block")], "host string, path string, verdict string")

    def plain(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(len(h + p), v == "block", h + p) for h, p, v in (("com", "/", "allow"), ("a.com", "/en", "block"), ("x.a.com", "/en/", "allow"), ("net", "/es/", "block")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[2], "allow" if best is None or not best[1] else "block"

    got = url_filter.filter_urls(pages, rules).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(urls[r["page_id"]])
    none = url_filter.filter_urls(pages, rules.where("false")).collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "allow")}
    assert url_filter.filter_urls(pages.where("false"), rules).count() == 0


def test_url_filters_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    pages = spark.createDataFrame([(i, f"http://s{i % 7}.a.com/en/{i}") for i in range(50)], "page_id long, url string")
    rules = spark.createDataFrame([(f"s{i}.a.com", "/en/", "block") for i in range(3)], "host string, path string, verdict string")
    assert url_filter.filter_urls(pages, rules).where("verdict = 'block'").count() == 22


# packing


def test_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(30):
        capacity = rng.choice([7, 64, 100])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        rooms, want = [], []
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            fits = [r for r in rooms if r >= sizes[k]]
            room = min(fits) if fits else capacity
            if fits:
                rooms.remove(room)
            if room > sizes[k]:
                rooms.append(room - sizes[k])
            want.append(room)
        rows = packing.best_fit_decreasing(sizes, capacity)
        assert sorted(k for r in rows for k in r) == list(range(len(sizes)))
        assert all(sum(sizes[k] for k in r) <= capacity for r in rows)
        assert len(rows) == sum(w == capacity for w in want)


def test_packing_splits_long_documents_losslessly(spark, odd, nothing, library):
    packed = packing.pack(odd.withColumn("ids", F.lit("mine")).withColumn("doc_rows", F.lit(1)), PATH, capacity=64, group_ids=500)
    got = packing.unpacked(packed).collect()
    assert len({r["doc_row"] for r in got}) == len(ODD)
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in ODD]
    assert sorted(repr((r["doc_id"], r["ids"])) for r in got) == sorted(map(repr, want))
    bare = packing.pack(odd.where("text is null or text = ''"), PATH, capacity=64)
    assert {r["used"] for r in bare.collect()} == {0}
    assert sorted(r["doc_id"] for r in packing.unpacked(bare).collect()) == [1, 2, 7]
    assert packing.pack(nothing, PATH).count() == 0


# shared helpers


def test_semi_join_with_a_salt_equals_the_plain_one(spark):
    from millrace.llm import common

    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("_salt"))
    keys = common.stage_table(spark.createDataFrame([(1,), (4,), (99,)], "k long"), "keys")
    plain = common.semi_join(rows, keys, "k", 1)
    salted = common.semi_join(rows, keys, "k", 1 << 40)
    assert salted.columns == rows.columns
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))
    assert plain.count() == sum(i % 7 in (1, 4) for i in range(1000))


def test_staged_tables_are_deleted(spark):
    from millrace.llm import common

    staged = common.stage_table(spark.range(5).toDF("n"), "five")
    path = staged._millrace_path
    assert spark.read.parquet(path).count() == 5
    common.drop_staged(staged, staged, spark.range(1))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    from types import SimpleNamespace

    from millrace.llm import common

    fake = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master), conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        common.ensure_checkpoint_dir(fake)


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([(1, 1), (2, None), (None, None), (5, 3), (3, 5), (5, 3)], "a long, b long")
    assert {r["node"]: r["root"] for r in components.components(edges).collect()} == {3: 3, 5: 3}
    assert components.components(edges.where("false")).count() == 0


def test_simhash_of_long_runs_counts_all_of_them(spark, monkeypatch):
    runs = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.xxhash64(i)).alias("r"))
    whole = runs.select(decontaminate.simhash(F.col("r")).alias("x")).first()["x"]
    monkeypatch.setattr(decontaminate, "LANE_RUNS", 7)
    assert runs.select(decontaminate.simhash(F.col("r")).alias("x")).first()["x"] == whole
