"""Findings of round 4."""

import tracemalloc

import numpy as np
import pytest

from tessera.operators import embed as E


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _slow_step(s, words, w_in, w_out, window, negative, lr):
    """A sentence's pairs one by one, all from the vectors before it; words: negative ones by pair."""
    d_in, d_out, pair = np.zeros_like(w_in), np.zeros_like(w_out), 0
    for i in range(len(s)):
        for j in range(max(0, i - window), min(len(s), i + window + 1)):
            if i == j:
                continue
            for label, t in [(1, s[j]), *((0, w) for w in words[pair * negative : (pair + 1) * negative])]:
                g = 1 / (1 + np.exp(-w_out[t] @ w_in[s[i]])) - label
                d_in[s[i]] += g * w_out[t]
                d_out[t] += g * w_in[s[i]]
            pair += 1
    return w_in - lr * d_in, w_out - lr * d_out


def test_a_step_of_skip_gram_equals_its_pairs_one_by_one():
    cdf = np.cumsum([0.4, 0.3, 0.1, 0.1, 0.05, 0.05])
    w_in, w_out = (np.random.default_rng(k).uniform(-0.5, 0.5, (6, 4)) for k in (1, 2))
    s = np.array([0, 1, 0, 2, 5, 1, 0, 3, 3, 4])
    rng = np.random.default_rng(7)
    rng.permutation(1)
    pairs = sum(min(len(s), i + 4) - max(0, i - 3) - 1 for i in range(len(s)))
    want = _slow_step(s, E._Draws(cdf / cdf[-1]).take(rng, pairs * 5), w_in, w_out, 3, 5, 0.05)
    E._train([s], w_in, w_out, cdf / cdf[-1], np.random.default_rng(7), 3, 5, 0.05)
    assert w_in == pytest.approx(want[0]) and w_out == pytest.approx(want[1])


def test_draws_follow_the_shares():
    share = np.array([0.5, 0.2, 0.0, 0.2, 0.1])
    drawn = E._Draws(np.cumsum(share)).take(np.random.default_rng(0), 100_000)
    assert np.bincount(drawn, minlength=5) / 100_000 == pytest.approx(share, abs=0.01)


def test_skip_gram_makes_no_row_for_a_term_of_a_long_sentence():
    rng = np.random.default_rng(0)
    w_in, w_out = rng.random((300, 32)) / 32, np.zeros((300, 32))
    cdf = np.arange(1, 301) / 300
    tracemalloc.start()
    E._train([rng.integers(0, 300, 3000)], w_in, w_out, cdf, rng, 4, 5, 0.05)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(w_in).all() and peak < 20 << 20  # 144,000 terms of 32 numbers are 35 MB


def test_means_of_sorted_rows_are_weighted(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [("en", f"w{i % 4}", i, [float(i), 1.0]) for i in range(1, 30)] + [("de", "w1", 5, [2.0, 3.0])]
        got = E._means(spark.createDataFrame(rows, "grp string, word string, n long, vin array<float>"), "grp", ["vin"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {("en", f"w{k}"): [sum(i * i for i in range(1, 30) if i % 4 == k) / sum(i for i in range(1, 30) if i % 4 == k), 1.0] for k in range(4)}
    assert {(r["grp"], r["word"]): r["vin"] for r in got} == {k: pytest.approx(v) for k, v in {**want, ("de", "w1"): [2.0, 3.0]}.items()}


def _tfidf(texts):
    """Unit weights of the texts' words by plain loops, and idf."""
    import math
    from collections import Counter

    idf = {w: math.log((len(texts) + 1) / (n + 1)) + 1 for w, n in Counter(w for t in texts.values() for w in set(t.split())).items()}

    def unit(t):
        x = {w: n / len(t.split()) * idf[w] for w, n in Counter(t.split()).items() if w in idf}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {w: v / norm for w, v in x.items()}

    return {i: unit(t) for i, t in texts.items()}, unit


@pytest.mark.parametrize("hot", [0, 5, 1000])
def test_tfidf_search_makes_no_row_for_a_pair(spark, monkeypatch, hot):
    """However many words are sent to the tasks, the best equal plain loops; what search returns was found within the tasks."""
    import random

    from tessera.operators import search

    monkeypatch.setattr(search, "HOT_WORDS", hot)
    rng = random.Random(5)
    words = ["w" + a + b for a in "abcdefgh" for b in "abcdefgh"]
    texts = {i: " ".join(["shared", *rng.choices(words[: 8 + i % 50], k=rng.randint(2, 9))]) for i in range(120)} | {500: "12.3 ! ?"}
    asked = {q: " ".join(["shared", "unknown", *rng.choices(words, k=4)]) for q in range(30)} | {77: "nothing known"}
    rows = spark.createDataFrame([*texts.items(), (None, "shared waa")], "doc_id long, text string")
    index = search.Index(rows.where("doc_id is not null"), "doc_id")
    found = index.search(spark.createDataFrame(list(asked.items()), "q long, text string"), 3)
    assert "sum(" not in found._jdf.queryExecution().optimizedPlan().toString()  # similarities are added up within the tasks
    texts[500] = "12"
    units, unit = _tfidf(texts)
    want = set()
    for q, text in asked.items():
        qw = unit(text)
        sims = sorted((-round(sum(v * w.get(k, 0.0) for k, v in qw.items()), 9), i) for i, w in units.items())
        want |= {(q, i, round(-s, 6)) for s, i in sims[:3] if -s > 0.01}
    assert {(r["q"], r["doc_id"], round(r["sim"], 6)) for r in found.collect()} == want


def test_hash_means_shuffle_nothing(spark):
    from pyspark.sql import functions as F

    rows = [(1, ["ab", "cd", "ab"]), (2, []), (3, None), (4, ["나무"])]
    df = spark.createDataFrame(rows, "doc_id long, t array<string>")
    got = E.hash_means(df, "doc_id", 8)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    words = spark.createDataFrame([("ab",), ("cd",), ("나무",)], "word string").select("word", E.hash_vector(F.col("word"), 8).alias("vec"))
    vec = {r["word"]: np.array(r["vec"]) for r in words.collect()}
    assert {r["doc_id"]: r["vec"] for r in got.collect()} == {1: pytest.approx((2 * vec["ab"] + vec["cd"]) / 3), 4: pytest.approx(vec["나무"])}


@pytest.mark.parametrize("spread", [1.0, 1e-7])
def test_products_in_32_bits_rule_out_no_best_text(spark, tmp_path, spread):
    """Cosines that differ in the eighth digit only, and some that are equal: the best are those of 64 bits."""
    from tessera.operators import fused
    from tessera.sources.workspace import Workspace

    rng = np.random.default_rng(4)
    base = rng.normal(size=6)
    x = base + spread * rng.normal(size=(400, 6))
    x[7] = x[9]
    q = rng.normal(size=(20, 6))
    q[3] = 0
    a = rng.random((400, 3)) * (rng.random((400, 3)) < 0.5)
    w = rng.random((20, 3))
    kinds = "vec array<double>, toks array<bigint>, ws array<double>"

    def table(vecs, weights, key):
        rows = [(i, v.tolist(), np.flatnonzero(u).tolist(), u[np.flatnonzero(u)].tolist()) for i, (v, u) in enumerate(zip(vecs, weights, strict=True))]
        df = spark.createDataFrame(rows, f"{key} long, {kinds}")
        df.write.parquet(f"{tmp_path}/{key}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{key}")

    got = fused.top(table(q, w, "q"), table(x, a, "id"), 3, Workspace(spark, "test"), 5, (0.5, 0.5), 0.01).collect()
    sims = w @ a.T
    cos = q @ x.T / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1), 1e-12)

    def scaled(s):
        low, high = s.min(1, keepdims=True), s.max(1, keepdims=True)
        return np.where(high - low > 1e-12, (s - low) / np.where(high - low > 1e-12, high - low, 1), 0)

    score = 0.5 * scaled(sims) + 0.5 * scaled(cos)
    want = {(i, int(j)) for i in range(20) for j in np.lexsort((np.arange(400), -np.round(score[i], 12)))[:5]}
    assert {(r["q"], r["id"]) for r in got} == want
    assert all(r["score"] == pytest.approx(score[r["q"], r["id"]], abs=1e-6) for r in got)


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_training_by_numbers_equals_plain_rounds(spark, monkeypatch, tmp_path, hot):
    """However many words are sent to the tasks, rounds over numbered pairs equal joins with all terms."""
    import random

    from tessera.operators import growing as W
    from tessera.sources.workspace import Workspace

    monkeypatch.setattr(W, "HOT_WORDS", hot)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    kinds = "word string, vec array<double>, ctx array<double>, freq double, is_seed boolean, version int"
    vec = lambda: [rng.uniform(-1, 1) for _ in range(3)]
    vocab = spark.createDataFrame([(w, vec(), vec(), float(1 + i * i), i % 2 == 0, i % 3) for i, w in enumerate(words)] + [("bare", None, vec(), 2.0, True, 0)], kinds)
    pairs = spark.createDataFrame(sorted({(rng.choice([*words, "bare"]), rng.choice(words), 1 + rng.randrange(3)) for _ in range(300)}), "center string, other string, n long")
    pairs = pairs.groupBy("center", "other").sum("n").withColumnRenamed("sum(n)", "n")
    ws = Workspace(spark, "test")
    vocab, pairs = ws.stage(vocab, "vocab"), ws.stage(pairs, "pairs")
    got = W.trained(pairs, vocab, ws, 3, 2, seed=1, slots=32)
    want, terms = vocab, ws.stage(W.negatives(pairs, vocab, ws, seed=1, slots=32), "plain")
    for _ in range(2):
        want = W.train_round(terms, want, 3)
    row = lambda r: (r["freq"], r["is_seed"], r["version"], r["vec"] and pytest.approx(r["vec"]), pytest.approx(r["ctx"]))
    got, want = ({r["word"]: r for r in x.collect()} for x in (got, want))
    assert got.keys() == want.keys() and len(got) == 41
    assert all((r["freq"], r["is_seed"], r["version"], r["vec"], r["ctx"]) == row(want[w]) for w, r in got.items())


@pytest.mark.parametrize("words, pairs", [(0, 0), (4, 3), (1000, 1000)])
def test_own_scores_equal_loops_however_much_is_sent(spark, monkeypatch, words, pairs):
    import math
    import random
    from collections import Counter

    from tessera.operators import guard as G
    from tessera.sources.workspace import Workspace

    monkeypatch.setattr(G, "HOT_WORDS", words)
    monkeypatch.setattr(G, "HOT_PAIRS", pairs)
    rng = random.Random(1)
    texts = [(i, "de" if i % 3 else "en", rng.choices(["aa", "bb", "cc", f"x{i}", "나무"], weights=[9, 5, 2, 1, 1], k=rng.randint(0, 9))) for i in range(40)]
    rows = spark.createDataFrame([*texts, (99, "de", None)], "row long, expert string, text array<string>")
    ws = Workspace(spark, "test")
    uni, bi = G.fit_experts(rows, "expert", ws)
    framed = {(i, e): list(zip(["<s>", *t], [*t, "</s>"], strict=True)) for i, e, t in texts}
    c12 = Counter((e, *p) for (_, e), t in framed.items() for p in t)
    c1 = Counter((e, w) for _, e, t in texts for w in ["<s>", *t, "</s>"])
    assert {(r["expert"], r["w1"], r["w2"]): r["c"] for r in bi.collect()} == c12
    assert {(r["expert"], r["tok"]): r["c"] for r in uni.collect()} == c1
    total, v = Counter(), Counter(e for e, _ in c1)
    for (e, _), c in c1.items():
        total[e] += c
    p = lambda e, a, b: 0.7 * c12[e, a, b] / c1[e, a] + 0.3 * (c1[e, b] + 1) / (total[e] + v[e])
    want = {k: pytest.approx(sum(math.log(p(k[1], a, b)) for a, b in t) / len(t)) for k, t in framed.items()}
    assert {(r["row"], r["expert"]): r["score"] for r in G.own_scores(rows, uni, bi, ws).collect()} == want


def test_an_expert_is_trained_again_only_if_its_corpus_grew(spark, tmp_path, monkeypatch):
    from tessera.operators import guard as G
    from tessera.sources.experts import Experts

    held, fitted, fit = Experts(spark, str(tmp_path / "x")), [], G.fit_experts
    monkeypatch.setattr(G, "fit_experts", lambda df, *a: (fitted.append(sorted({r[0] for r in df.select("expert").collect()})), fit(df, *a))[1])
    for name in ("de", "en"):
        held.add(name)
    held.add_to(spark.createDataFrame([(e, i, f"ab cd {e} {'ef ' * i}") for e in ("de", "en") for i in range(12)], "expert string, seq long, text string"))
    held.train("de")
    before = {r["expert"]: r["threshold"] for r in held.list().collect()}
    held.train()
    held.add_to(spark.createDataFrame([("de", 50, "quite another one")], "expert string, seq long, text string"))
    held.train()
    held.remove("en")
    held.add("en")
    held.train()
    assert fitted[:3] == [["de"], ["en"], ["de"]] and all(not f for f in fitted[3:])
    after = {r["expert"]: r["threshold"] for r in held.list().collect()}
    assert before["en"] is None and before["de"] is not None and after["de"] is not None and after["en"] is None
