"""Operators over the whole of their tables: more rows than a block, full maps, missing languages, words of documents."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import corpus as C
from tessera.operators import curate as U
from tessera.operators import embed as E
from tessera.plans import guard_plans, registry


def test_unigrams_count_documents_without_a_language(spark, tmp_path):
    spark.createDataFrame([(0, "ab cd", "en"), (1, "ab ef", "de"), (2, "ab gh", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["tok"]: (r["c"], r["total"]) for r in guard_plans.unigram_counts(spark, str(tmp_path)).collect()}
    assert got["ab"] == (3, 12) and got["gh"] == (1, 12)


def test_known_takes_any_number_of_candidates(spark):
    cand = [(i, [math.cos(i), math.sin(i), 0.1 * i]) for i in range(50)]
    table = [(i, [math.sin(3 * i), 1.0, math.cos(i)]) for i in range(7)]

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (math.hypot(*a) * math.hypot(*b))

    one, other = (spark.createDataFrame(x, "vec_id long, vec array<double>") for x in (cand, table))
    got = dict(U.known(one, other, "vec_id", block_bytes=48).collect())
    assert got == {i: pytest.approx(max(cosine(v, t) for _, t in table)) for i, v in cand}
    assert set(dict(U.known(one, other.limit(0), "vec_id").collect()).values()) == {0.0}


def test_queries_of_a_full_map(spark):
    word = "alpha bravo carol delta eagle flame grape house igloo joker karma lemon".split()
    rows = [(10 * node + k, f"{word[node]} x{k}", node) for node in range(12) for k in range(3 + (node >= 9))]
    table = spark.createDataFrame(rows, "item_id long, text string, bmu int")
    docs, assigned = table.select("item_id", "text"), table.select("item_id", "bmu")
    got = U.autonomous_queries(assigned, docs, "item_id").collect()
    assert len(got) == 3 and all(r["node_id"] < 9 and r["query"] == word[r["node_id"]] for r in got)
    empty = spark.range(8).select((F.col("id") + 100).alias("node_id")).unionByName(assigned.select(F.col("bmu").cast("long").alias("node_id")).distinct())
    got = U.autonomous_queries(assigned, docs, "item_id", nodes=empty).collect()
    assert [(r["node_id"], r["query"]) for r in got] == [(0, "alpha")]
    one = assigned.where("item_id not in (50, 51)")
    assert [r["node_id"] for r in U.autonomous_queries(one, docs, "item_id").collect()] == [5]


TEXTS = [(0, "the cat saw a cat. it is so", "en"), (1, "der hund ist so da", "de"), (2, "the cat is here", None), (3, None, "en")]


@pytest.fixture
def corpus(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_corpus_queries_equal_brute_force(spark, corpus):
    docs = {r["doc_id"]: r["t"] for r in spark.read.parquet(f"{corpus}/documents.parquet").select("doc_id", T.tokenize(F.col("text")).alias("t")).collect() if r["t"]}
    pairs = Counter((t[i], t[j]) for t in docs.values() for i in range(len(t)) for j in range(len(t)) if 1 <= abs(i - j) <= 2)
    assert {(r["center"], r["context"]): r["n"] for r in registry.QUERIES["corpus_skip_gram_pairs"](spark, corpus).collect()} == pairs
    vec: dict = {}
    for r in registry.QUERIES["corpus_hash_vectors"](spark, corpus).collect():
        vec.setdefault(r["word"], {})[r["dim"]] = r["x"]
    words = {w for t in docs.values() for w in t}
    assert set(vec) == words and "so" in words and all(len(v) == 8 for v in vec.values())
    got = {(r["doc_id"], r["dim"]): r["x"] for r in registry.QUERIES["corpus_sentence_mean"](spark, corpus).collect()}
    assert got == {(i, k): pytest.approx(sum(vec[w][k] for w in t) / len(t), abs=3e-6) for i, t in docs.items() for k in range(8)}
    assert {r["word"] for r in registry.QUERIES["generator_vectors"](spark, corpus).collect()} == words


def test_skip_gram_trains_on_every_language_of_the_documents(spark, tmp_path):
    def text(lang, k):
        return " ".join(f"{lang}word{chr(97 + (k * 5 + i * i) % 14)}" for i in range(12)) + "."

    rows = [(k, text(lang or "no", k), lang) for k, lang in enumerate(["en", "de", None] * 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["skip_gram_training"](spark, str(tmp_path)).collect()
    assert {(r["grp"], r["word"][:2]) for r in got} == {("en", "en"), ("de", "de"), ("und", "no")} and all(r["norm"] == pytest.approx(1, abs=2e-3) for r in got)
