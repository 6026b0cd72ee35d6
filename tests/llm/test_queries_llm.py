"""The registered queries over the smallest tables: SQL where there is some, laws elsewhere."""

import hashlib
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import same_as_sql
from millrace.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(name, spark, sf_dir, duck):
    same_as_sql(queries.QUERIES[name](spark, sf_dir), duck, queries.SQL[name])


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_language_id(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    held = [(lang, got[i]["lang_pred"]) for i, _, lang in documents if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) >= 0.95


def test_language_id_equals_brute_force(spark, sf_dir, documents):
    from brute import language
    from pyspark.sql import functions as F

    from millrace.llm import langid

    pool = spark.read.parquet(f"{sf_dir}/documents.parquet").where(~langid.held_out(F.col("doc_id")))
    model = langid.train(langid.sample(pool, "text", "lang", F.col("doc_id").cast("string"), langid.Settings()), langid.Settings())
    assert langid.TEMPERATURES[0] < model.temperature < langid.TEMPERATURES[-1]
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, sf_dir).collect()}
    for i, text, _ in documents:
        lang, score, rejected = language(text, model)
        assert (got[i]["lang_pred"], got[i]["rejected"]) == (lang or "und", rejected)
        assert abs(got[i]["score"] - score) < 2e-6


def test_bpe_equals_the_library(spark, sf_dir, documents, library):
    got = {r["doc_id"]: r for r in queries.op7_bpe(spark, sf_dir).collect()}
    for (i, text, _), e in zip(documents, library.encode_batch([t or "" for _, t, _ in documents], add_special_tokens=False)):
        back = library.decode(e.ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(e.ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_shards(spark, sf_dir, documents):
    got = queries.op2_sharding(spark, sf_dir).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == len(documents)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts.get(s, 0)))
    size = {i: len((t or "").encode()) + 8 for i, t, _ in documents}
    crc = {i: zlib.crc32((t or "").encode()) for i, t, _ in documents}
    # cut edges, counted pair by pair: only groups that no shard has room for may be cut, and few others
    where = {r["doc_id"]: r["shard"] for r in got}
    groups = {}
    for i, t, _ in documents:
        groups.setdefault(t, []).append(i)
    pairs = [(len(g), where[a] != where[b]) for t, g in groups.items() if t is not None for k, b in enumerate(g) for a in g[:k]]
    fit = [cut for n, cut in pairs if n <= len(documents) // 24]
    assert sum(fit) <= 0.05 * len(fit)
    assert all(r["size"] == size[r["doc_id"]] and r["text_crc32"] == crc[r["doc_id"]] and r["law"] == "rows" and r["grown_shard"] is None for r in got)


def test_packing_is_lossless(spark, sf_dir, documents, library):
    from millrace.llm import packing

    packed = queries.op10_packing(spark, sf_dir)
    rows = packed.collect()
    for r in rows:
        assert r["cu_seqlens"][0] == 0
        assert r["cu_seqlens"][-1] == r["used"] <= packing.CAPACITY
        assert r["position_resets"] == r["cu_seqlens"][:-1]
        assert len(r["ids"]) == 4 * packing.CAPACITY
        assert hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"]
        assert not packing.matrix_of(r)[r["used"] :].any()
    got = {r["doc_id"]: list(r["ids"]) for r in packing.unpacked(packed).collect()}
    want = {i: e.ids for (i, _, _), e in zip(documents, library.encode_batch([t or "" for _, t, _ in documents], add_special_tokens=False))}
    assert got == want
    assert sum(r["used"] for r in rows) / (len(rows) * packing.CAPACITY) > 0.9
    from brute import best_fit_rows

    # the table is one file, so one group
    assert sorted(r["used"] for r in rows) == best_fit_rows([len(x) for x in want.values()], packing.CAPACITY)


def test_token_counts_after_edits(spark, sf_dir, documents, library):
    got = {r["doc_id"]: r for r in queries.op3_token_counts(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    edits = {r["doc_id"]: r["e"] for r in docs.select("doc_id", queries.planned_edits(docs["doc_id"], docs["text"]).alias("e")).collect()}
    for i, text, _ in documents:
        t = text or ""
        assert got[i]["tokens_before"] == len(library.encode(t, add_special_tokens=False).ids)
        for e in edits[i]:
            at = min(e["place"], len(t))
            t = t[:at] + e["insert"] + t[at + e["delete"] :]
        assert got[i]["chars_after"] == len(t)
        assert got[i]["tokens_after"] == len(library.encode(t, add_special_tokens=False).ids)
        assert got[i]["encoded_chars"] <= len(t)


def test_near_duplicates_equal_brute_force(spark, sf_dir, documents):
    from brute import near_classes

    links, classes = near_classes([(i, t) for i, t, _ in documents])
    for r in queries.op5_ngram_join(spark, sf_dir).collect():
        assert r["n_links"] == links[r["doc_id"]]
        assert r["class_id"] == classes[r["doc_id"]]


def test_decontamination_equals_brute_force(spark, sf_dir, documents):
    from brute import contaminated

    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = contaminated([(i, t) for i, t, _ in documents], items)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in queries.op8_decontamination(spark, sf_dir).collect()}
    assert got == {k: round(v, 6) for k, v in want.items()}


def test_pipeline(spark, sf_dir, documents):
    from brute import near_classes

    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = corpus_pipeline.language_id(spark, docs, sf_dir)
    assert known.columns == docs.columns
    first = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    _, classes = near_classes([(i, t) for i, t, _ in documents])
    assert sorted(r["doc_id"] for r in first.select("doc_id").collect()) == sorted(set(classes.values()))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(got) <= len(set(classes.values()))
    assert all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in got)


def test_pipeline_equals_brute_force(spark, sf_dir, documents, library):
    from brute import contaminated, deduplicated_texts, near_classes

    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, sf_dir).select("doc_id").collect()}
    rows = [(i, t) for i, t, _ in documents if i in known]
    _, classes = near_classes(rows)
    rows = deduplicated_texts([(i, t) for i, t in rows if classes[i] == i])
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, _ in contaminated(rows, items)}
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows if i not in bad}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in got} == want
    assert len(got) == len(want)


def odd_tables(spark, folder, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rejected string, _digest int, marks string, bits string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(30))), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_over_odd_rows(spark, tmp_path):
    import random

    import corpus_pipeline

    rng = random.Random(4)
    words = {"en": ["stone", "river", "cloud", "light", "house"], "de": ["fluss", "wolke", "licht", "hauses", "stein"]}
    prose = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice("aeiou") for _ in range(n))
    clean = [(100 + i, prose("en" if i % 2 else "de", 60), "en" if i % 2 else "de") for i in range(60)]
    leak = " ".join(f"item{i}" for i in range(30))
    rows = [*clean, clean[0], (1, None, "en"), (2, "", "en"), (3, " \n", None), (None, clean[3][1], "de"), (4, clean[5][1], "de"), (5, clean[7][1] + " " + leak, "en"), (6, clean[9][1] + " " + " ".join(clean[13][1].split()[:30]), "en"), (7, prose("en", 9000), "en")]
    folder = odd_tables(spark, tmp_path / "odd", [(i, t, lang, None, None if t is None else len(t), "mine", 7, "mine", None) for i, t, lang in rows])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "rejected", "_digest", "marks", "bits"]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    # no letters: gone. Copies: the smallest id stays (4 for 105), the repeated row once. A leak: gone.
    assert not {1, 2, 3, 105, 5, None} & set(got)
    assert {4, 6, 7, 100} <= set(got)
    assert len(got) >= 60
    assert all(r["round_trip"] for r in got.values())


def test_pipeline_over_empty_tables(spark, tmp_path):
    import corpus_pipeline

    folder = odd_tables(spark, tmp_path / "none", [])
    assert corpus_pipeline.run(spark, folder).count() == 0
