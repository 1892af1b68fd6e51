"""Exact ranks, similarity by blocks, new maps, the registry of experts and the log of rejected sentences."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import curate as U
from tessera.operators import guard as G
from tessera.operators import mapnet as M
from tessera.operators import ranks, similar
from tessera.sources.experts import Experts
from tessera.streaming import loop


def scores(spark, values):
    return spark.createDataFrame([(v,) for v in values], "score double")


@pytest.mark.parametrize("most", [1, 50, 50_000])
def test_ranks_are_exact(spark, most):
    rng = random.Random(1)
    values = [rng.gauss(-7, 2) for _ in range(900)] + [-6.25] * 700 + [1e6, -1e9, 0.0, -0.0, 5e-324, 1e-300] + [-6.25 + i * 1e-15 for i in range(5)]
    rng.shuffle(values)
    df = scores(spark, values + [None, float("nan")]).repartition(5)
    order = sorted(values)
    wanted = [0, 1, 3, 400, 401, 800, len(order) - 2, len(order) - 1]
    assert ranks.at_ranks(df, "score", [*wanted, len(order), -1], most) == {k: order[k] for k in wanted}


def test_percentiles_equal_numpy(spark):
    values = [math.sin(i) * i for i in range(301)]
    for share in (0.0, 0.15, 0.25, 0.5, 1.0):
        assert ranks.percentile(scores(spark, values), "score", share) == pytest.approx(float(np.quantile(values, share)), abs=1e-12)
    assert ranks.percentile(scores(spark, []), "score", 0.5) is None and ranks.percentile(scores(spark, [3.0]), "score", 0.9) == 3.0


def test_thresholds_equal_numpy(spark):
    values = [-6 - abs(math.sin(i)) for i in range(200)]
    want = max(-9.0, min(-5.0, float(np.quantile(values, 0.15)) - 0.5 * float(np.std(values))))
    assert G.suggest_threshold(scores(spark, values)).first()[0] == pytest.approx(want)
    assert G.suggest_threshold(scores(spark, [])).first()[0] == G.THRESHOLD
    assert G.suggest_threshold(scores(spark, [-3.0] * 9)).first()[0] == G.SHORT_CAP


@pytest.mark.parametrize("block_bytes", [64, 1 << 20])
def test_most_similar_equal_brute_force(spark, block_bytes):
    rng = np.random.default_rng(2)
    vecs = np.round(rng.normal(size=(60, 4)), 2)
    vecs[10] = vecs[11] = vecs[12] = vecs[3]  # ties
    vecs[20] = 0
    rows = [(f"w{i:02d}", [float(x) for x in v]) for i, v in enumerate(vecs)]
    df = spark.createDataFrame([*rows, ("null", None)], "word string, vec array<double>").repartition(3)
    got = {}
    for r in similar.top(df.where("word < 'w20'") if block_bytes == 64 else df, df, 4, block_bytes=block_bytes).collect():
        got.setdefault(r["word"], []).append((-r["sim"], r["other"]))

    def cosine(a, b):
        return float(np.dot(a, b)) / max(math.sqrt(np.dot(a, a)) * math.sqrt(np.dot(b, b)), 1e-12)

    for w, v in rows[: 20 if block_bytes == 64 else 60]:
        want = sorted((-round(cosine(np.array(v), np.array(o)), 9), x) for x, o in rows if x != w)[:4]
        assert sorted((round(s, 9) + 0.0, x) for s, x in got[w]) == [(s + 0.0, x) for s, x in want]
    assert similar.top(df.limit(0), df, 4).count() == 0 and similar.top(df, df.limit(0), 4).count() == 0


def test_known_takes_exact_members_by_a_join(spark):
    cand = spark.createDataFrame([(1, [1.0, 0.0], "here"), (2, [1.0, 0.0], "there"), (3, [0.0, 1.0], None), (4, None, "here"), (5, None, "gone")], "id long, vec array<double>, text string")
    table = spark.createDataFrame([([-1.0, 0.0], "here"), ([0.6, 0.8], None)], "vec array<double>, text string")
    got = {r["id"]: r["known"] for r in U.known(cand, table, "id", key="text").collect()}
    assert got == {1: 1.0, 2: pytest.approx(0.6), 3: pytest.approx(0.8), 4: 1.0, 5: 0.0}
    assert {r["id"]: r["known"] for r in U.known(cand, table, "id").collect()}[1] == pytest.approx(0.6)


def test_new_maps(spark):
    a, b = (sorted(map(tuple, M.init_nodes(spark, 16, 8, seed).collect())) for seed in (0, 1))
    assert len(a) == 16 and a != b and a == sorted(map(tuple, M.init_nodes(spark, 16, 8).collect()))
    w = np.array([r[1] for r in a])
    assert w.shape == (16, 8) and 0.2 < w.std() < 0.4 and all(r[4] == 0.0 for r in a)
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(50)] + [(7, [7.0, 1.0, 2.0])] * 20 + [(60, None)]
    v = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    one, two = (sorted(map(tuple, M.reinit(v.repartition(n)).collect())) for n in (1, 6))
    assert one == two and [r[0] for r in one] == list(range(36)) and len({r[1] for r in one}) == 36
    assert all(abs(r[2][0] - r[1]) < 0.1 for r in one) and any(r[2][0] != r[1] for r in one)
    assert [r["node_id"] for r in M.reinit(v.where("vec_id < 3"), noise=0).orderBy("node_id").collect()] == [0, 1, 2]
    assert M.reinit(v.limit(0)).count() == 0


def test_registry_of_experts(spark, tmp_path):
    held = Experts(spark, str(tmp_path / "experts"))
    assert held.names() == [] and held.list().count() == 0
    for name in ("cats", "dogs", "007", "a/b=c d"):
        held.add(name, f"about {name}")
    held.add("cats", "another text")  # stays as it is
    words = "alpha bravo carol delta eagle flame grape house igloo joker karma lemon".split()
    rows = [("cats", i, f"the cat sees the {w} and purrs") for i, w in enumerate(words)] + [("cats", 90, "the cat sees the alpha and purrs"), ("cats", 91, None), ("birds", 0, "nobody"), (None, 0, "none")]
    rows += [("dogs", i, f"a dog chases {w} barking loudly") for i, w in enumerate(words)] + [("007", 0, "short corpus"), ("a/b=c d", 0, "odd name")]
    df = spark.createDataFrame(rows, "expert string, seq long, text string")
    assert {tuple(r) for r in held.add_to(df).collect()} == {("cats", 12, 0), ("dogs", 12, 0), ("007", 1, 0), ("a/b=c d", 1, 0)}
    assert held.add_to(df).count() == 0
    held.train("cats", "dogs")
    got = {r["expert"]: (r["about"], r["n_sentences"], r["threshold"]) for r in held.list().collect()}
    assert got["cats"][:2] == ("about cats", 12) and got["007"] == ("about 007", 1, None) and -9 <= got["dogs"][2] <= -5
    texts = spark.createDataFrame([(1, "the cat sees the house and purrs"), (2, "a dog chases karma barking loudly"), (3, "zzz qqq")], "id long, text string")
    routed = {r["id"]: r["expert"] for r in held.route(texts, "id").collect()}
    assert routed == {1: "cats", 2: "dogs", 3: None}
    held.train("007")
    after = {r["expert"]: r["threshold"] for r in held.list().collect()}
    assert after["007"] == G.STATE_THRESHOLD and after["cats"] == got["cats"][2]  # the others stay
    more = spark.createDataFrame([("cats", 200, "the cat sees the wagon and purrs"), ("cats", 201, "quite unlike anything before")], "expert string, seq long, text string")
    assert [tuple(r) for r in held.add_to(more, threshold=-3.0).collect()] == [("cats", 1, 1)]
    held.remove("a/b=c d")
    held.remove("nobody")
    assert held.names() == ["007", "cats", "dogs"] and held.table("corpus").where("expert = 'a/b=c d'").count() == 0
    held.add("a/b=c d")
    assert {r["expert"]: r["n_sentences"] for r in held.list().collect()}["a/b=c d"] == 0
    with pytest.raises(ValueError):
        held.add("")


def test_the_log_of_rejected_sentences_is_that_of_one_batch(spark, tmp_path):
    model = G.Model.fit(spark.createDataFrame([(i, "the river runs past the old stone bridge") for i in range(3)], "id long, text string"))
    nodes = spark.createDataFrame([(0, [0.0, 0.0], 0.0, 0.0, 0.0)], "node_id long, w array<double>, cx double, cy double, err double")

    def encode(df):
        return df.select("seq", F.array(F.length("text") / 10.0, F.lit(1.0)).alias("vec"))

    rows = [(i, "q", f"Unheard of number {'x' * (i + 1)} sentence stands here again" if i % 3 else "the river runs past the old stone bridge") for i in range(12)]

    def learn(name, parts):
        learner = loop.Learner(spark, str(tmp_path / name), encode, nodes, baseline=(model, -2.0), rounds=1)
        for k, part in enumerate(parts):
            learner.step(spark.createDataFrame(part, "seq long, query string, text string"), k)
        return [tuple(r) for r in learner.rejected().orderBy("seq").collect()]

    batch = learn("batch", [rows])
    assert batch == learn("stream", [rows[:5], rows[5:6], rows[6:]]) and len(batch) == 8
    assert all(s == round(s, 2) for _, _, s in batch)
    assert loop.Learner(spark, str(tmp_path / "none"), encode, nodes).rejected().count() == 0
    judged = spark.range(500).select(F.col("id"), F.lit("t").alias("text"), F.lit(-8.123).alias("score"), (F.col("id") % 2 == 0).alias("added"))
    log = G.last_rejected(judged, "id").collect()
    assert len(log) == 200 and min(r["id"] for r in log) == 101 and log[0]["score"] == -8.12
