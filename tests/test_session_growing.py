"""Session state in one visible save, and the embedding that grows with the corpus."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import growing as W
from tessera.operators import guard as G
from tessera.sources import session as N
from tessera.sources.workspace import Folder, Workspace, shared_dir

NODES = "node_id long, w array<double>, cx double, cy double, err double"
TEXTS = [f"the river {w} runs past the old stone bridge" for w in "alpha bravo carol delta eagle flame grape house igloo joker karma lemon".split()]


def whole(spark, round=1):
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (98, ""), (0, TEXTS[0])], "seq long, text string")
    log = spark.createDataFrame([(i, f"q{i}", i / 10) for i in range(400)], "seq long, query string, reward double")
    history = spark.createDataFrame([(0, 5, None), (1, None, 0.5)], "round long, occupancy long, mean_qe double")
    policy = spark.createDataFrame([("q", 1.5, 2, "kept too")], "word string, reward_sum double, n long, extra string")
    nodes = spark.createDataFrame([(0, [1.0, -2.0], 0.5, 0.0, 3.0), (1, [0.25, 0.0], 0.0, 1.0, 0.0)], NODES)
    return N.Session(nodes=nodes, corpus=corpus, history=history, policy=policy, policy_log=log, dim=2, round=round, created=12.5, extra={"a": 1})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_session_comes_back(spark, tmp_path):
    s = whole(spark)
    model, threshold, locked = G.fit_guardrail(s.corpus.where("text is not null"), "seq")
    s.baseline = (model, locked)
    assert N.save(s, str(tmp_path), spark) == 0
    back = N.load(spark, str(tmp_path))
    for part in ("corpus", "history", "policy"):
        assert rows(getattr(back, part)) == rows(getattr(s, part)) and getattr(back, part).columns == getattr(s, part).columns
    assert sorted(r["seq"] for r in back.policy_log.collect()) == list(range(100, 400))
    assert (back.dim, back.round, back.created, back.extra) == (2, 1, 12.5, {"a": 1})
    w = {r["node_id"]: list(r["w"]) for r in back.nodes.collect()}
    assert w[0] == pytest.approx([1.0, -2.0], abs=0.02) and w[1] == pytest.approx([0.25, 0.0], abs=0.02)
    assert back.baseline[1] == locked and rows(back.baseline[0].bi) == rows(model.bi) and rows(back.baseline[0].uni) == rows(model.uni)
    assert back.guardrail[1] == pytest.approx(threshold) and rows(back.guardrail[0].bi) == rows(model.bi)


def test_baseline_is_kept_only_if_locked_and_small_corpora_have_no_guardrail(spark, tmp_path):
    s = whole(spark)
    s.guardrail = G.fit_guardrail(s.corpus.where("text is not null"), "seq")[:2]
    s.corpus = s.corpus.limit(0)
    N.save(s, str(tmp_path), spark)
    back = N.load(spark, str(tmp_path))
    assert back.baseline is None and back.guardrail is None and back.corpus.count() == 0
    N.save(N.Session(round=7), str(tmp_path), spark)
    back = N.load(spark, str(tmp_path))
    assert back.round == 7 and back.nodes is None and back.corpus is None


def test_a_save_that_breaks_off_between_two_tables_is_never_read(spark, tmp_path):
    N.save(whole(spark, round=1), str(tmp_path), spark)
    bad = whole(spark, round=2)
    bad.policy = bad.policy.withColumn("n", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        N.save(bad, str(tmp_path), spark)
    folder = Folder(spark, str(tmp_path))
    assert len([n for n in folder.names() if n.startswith("save-")]) == 2  # the broken one lies there
    assert N.saves(spark, str(tmp_path)) == [0] and N.load(spark, str(tmp_path)).round == 1
    N.save(whole(spark, round=3), str(tmp_path), spark)
    assert N.load(spark, str(tmp_path)).round == 3 and N.load(spark, str(tmp_path), 0).round == 1


def test_manifests_are_whole_or_not_there(spark, tmp_path):
    N.save(whole(spark), str(tmp_path), spark)
    folder = Folder(spark, str(tmp_path))
    folder.write_text("manifests/.half", "{")  # a manifest that was being written
    assert not folder.write_text("manifests/000000000000.json", "{}")  # a number that is taken stays
    assert json.loads(folder.read_text("manifests/000000000000.json"))["values"]["round"] == 1
    with pytest.raises(FileNotFoundError):
        N.load(spark, str(tmp_path), 5)
    with pytest.raises(FileNotFoundError):
        N.load(spark, str(tmp_path / "nowhere"))


def test_old_saves_go_after_the_new_one_is_visible(spark, tmp_path):
    for k in range(4):
        N.save(N.Session(round=k, history=spark.range(k + 1)), str(tmp_path), spark, keep=2)
    folder = Folder(spark, str(tmp_path))
    assert N.saves(spark, str(tmp_path)) == [2, 3] and len([n for n in folder.names() if n.startswith("save-")]) == 2
    assert N.load(spark, str(tmp_path), 2).history.count() == 3


def test_workspace_closes(spark):
    ws = Workspace(spark, "test-close")
    t = ws.stage(spark.range(3), "a")
    assert t.count() == 3 and ws.root.startswith(shared_dir(spark))
    ws.close()
    assert Folder(spark, ws.root).names() == []


# --- growing embedding ---

SEED = {"river": [1.0, 0.0], "stone": [0.0, 1.0], "bridge": [2.0, 2.0]}
DOCS = [(0, "river newword stone river"), (1, "newword bridge"), (2, "lonely strange"), (3, None), (4, ""), (5, "river"), (6, "newword newword stone"), (6, "newword newword stone")]


def vocabulary(spark):
    return W.seeded(spark.createDataFrame(list(SEED.items()), "word string, vec array<double>"))


def docs(spark, some=DOCS):
    return spark.createDataFrame([(*r, "x", 1.0) for r in some], "doc_id long, text string, word string, freq double")


def test_first_vectors_are_means_of_known_words_around(spark):
    toks = docs(spark).select("doc_id", F.explode(T.tokenize(F.col("text"))).alias("tok"))
    got = {r["word"]: (r["n"], r["vec"] and list(r["vec"])) for r in W.first_vectors(toks, vocabulary(spark), "doc_id", 2).collect()}
    # sentences 0, 1 and 6 (twice): river twice, stone, bridge, stone twice
    assert got["newword"] == (6, pytest.approx([(2 + 2) / 6, (1 + 2 + 2) / 6]))
    assert got["lonely"] == (0, None) and got["strange"] == (0, None) and set(got) == {"newword", "lonely", "strange"}


def test_growth_is_a_version_that_merges(spark):
    old = vocabulary(spark)
    new = W.grown(docs(spark), old, "doc_id", 2, noise=0.0)
    rows = {r["word"]: r for r in new.collect()}
    assert set(rows) == {"newword", "lonely", "strange", "river", "stone"} | {"bridge"}
    assert all(r["version"] == 1 for r in rows.values()) and not rows["newword"]["is_seed"] and rows["river"]["is_seed"]
    assert rows["river"]["freq"] == 1 + 2 and rows["newword"]["freq"] == 1 + 1 + 4 and rows["stone"]["freq"] == 1 + 3  # one word alone doesn't count
    assert all(abs(x) <= 0.5 / 2 for x in rows["lonely"]["vec"]) and list(rows["lonely"]["ctx"]) == [0.0, 0.0]
    both = {r["word"]: r for r in W.merge(old, new, old).collect()}
    assert set(both) == set(rows) and both["river"]["version"] == 1
    noisy = {r["word"]: r for r in W.grown(docs(spark), old, "doc_id", 2).collect()}
    assert 0 < math.dist(noisy["newword"]["vec"], rows["newword"]["vec"]) < 0.1
    assert W.grown(docs(spark, []), old, "doc_id", 2).count() == 0


def test_a_round_moves_words_at_their_own_rates(spark):
    vocab = spark.createDataFrame([("a", [1.0, 0.0], [0.5, 0.5], 1.0, True, 0), ("b", [0.0, 1.0], [1.0, -1.0], 1.0, False, 0), ("c", [3.0, 3.0], [0.0, 0.0], 1.0, False, 0)], "word string, vec array<double>, ctx array<double>, freq double, is_seed boolean, version int")
    terms = spark.createDataFrame([("a", "b", 2, 1.0), ("b", "a", 1, 1.0), ("a", "a", 3, 0.0)], "center string, other string, n long, label double")
    got = {r["word"]: r for r in W.train_round(terms, vocab, 2).collect()}

    def g(u, v, label):
        return 1 / (1 + math.exp(-sum(x * y for x, y in zip(u, v, strict=True)))) - label

    v, u = {"a": [1.0, 0.0], "b": [0.0, 1.0]}, {"a": [0.5, 0.5], "b": [1.0, -1.0]}
    ab, ba, aa = g(u["b"], v["a"], 1), g(u["a"], v["b"], 1), g(u["a"], v["a"], 0)
    want_a = [v["a"][i] - W.SEED_RATE * (2 * ab * u["b"][i] + 3 * aa * u["a"][i]) / 5 for i in range(2)]
    want_b = [v["b"][i] - W.NEW_RATE * ba * u["a"][i] for i in range(2)]
    ctx_a = [u["a"][i] - W.SEED_RATE * (ba * v["b"][i] + 3 * aa * v["a"][i]) / 4 for i in range(2)]
    assert list(got["a"]["vec"]) == pytest.approx(want_a) and list(got["b"]["vec"]) == pytest.approx(want_b) and list(got["a"]["ctx"]) == pytest.approx(ctx_a)
    assert list(got["c"]["vec"]) == [3.0, 3.0] and got["b"]["freq"] == 1.0


def test_pairs_stay_within_the_window_and_repeat(spark):
    some = docs(spark, [(i, " ".join(f"w{chr(97 + j)}x" for j in range(10))) for i in range(30)] + [(50, None), (51, "one")])
    one, two = (rows(W.pairs(some, "doc_id")) for _ in range(2))
    assert one == two and one
    assert all(1 <= abs(ord(a[1]) - ord(b[1])) <= 3 for a, b, _ in one)
    assert {abs(ord(a[1]) - ord(b[1])) for a, b, _ in one} == {1, 2, 3}


def test_negatives_follow_frequencies(spark):
    freq = {"often": 81.0, "some": 16.0, "rare": 1.0, "never": 0.0}
    vocab = spark.createDataFrame([(w, [0.0], [0.0], f, False, 0) for w, f in freq.items()], "word string, vec array<double>, ctx array<double>, freq double, is_seed boolean, version int")
    pairs = spark.createDataFrame([(f"c{i}", f"o{i}", 1) for i in range(4000)], "center string, other string, n long")
    ws = Workspace(spark, "test-negatives")
    out = W.negatives(pairs, vocab, ws, number=5)
    drawn = {r["other"]: r["n"] for r in out.where("label = 0").groupBy("other").agg(F.sum("n").alias("n")).collect()}
    assert sum(drawn.values()) == 20_000 and "never" not in drawn and out.where("label = 1").count() == 4000
    total = sum(f**0.75 for f in freq.values())
    assert all(drawn[w] / 20_000 == pytest.approx(freq[w] ** 0.75 / total, abs=0.02) for w in ("often", "some", "rare"))
    ws.close()


def test_growing_pulls_words_of_one_topic_together(spark, tmp_path):
    rng = random.Random(4)
    topics = [[f"{t}{chr(97 + k)}word" for k in range(6)] for t in ("red", "blue")]
    some = docs(spark, [(i, " ".join(rng.choices(topics[i % 2], k=12))) for i in range(200)])
    seed = W.seeded(spark.createDataFrame([(topics[0][0], [1.0, 0.0, 0.1, 0.0]), (topics[1][0], [0.0, 1.0, 0.0, 0.1])], "word string, vec array<double>"))
    ws = Workspace(spark, "test-grow")
    vocab = W.grow(some, seed, ws, "doc_id", 4, epochs=2)
    got = {r["word"]: r for r in vocab.collect()}
    assert set(got) == {w for t in topics for w in t} and sum(r["is_seed"] for r in got.values()) == 2

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)

    same = [cosine(got[a]["vec"], got[b]["vec"]) for t in topics for a in t for b in t if a < b]
    other = [cosine(got[a]["vec"], got[b]["vec"]) for a in topics[0] for b in topics[1]]
    assert min(same) > max(other)
    vecs = {r["doc_id"]: r["vec"] for r in W.encode(docs(spark, [(0, "redaword redbword"), (1, "unknown"), (2, None)]), vocab, "doc_id", 4).collect()}
    assert math.hypot(*vecs[0]) == pytest.approx(1, abs=1e-6) and list(vecs[1]) == list(vecs[2]) == [0.0] * 4
    W.save(vocab, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).schema["vec"].dataType.elementType.typeName() == "float"
    ws.close()
