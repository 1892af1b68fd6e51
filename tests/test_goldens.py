"""Small cases with results worked out by hand."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vec as V
from tessera.operators import corpus as C
from tessera.operators import curate as U
from tessera.operators import guard as G
from tessera.operators import mapnet as M
from tessera.operators import metrics as X
from tessera.operators import refine as R
from tessera.operators import search as Q
from tessera.sources.workspace import Workspace


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("q0,q1,v0,v1,want", [(2.0, 1.5, 0.5, 0.55, 0.89), (2.0, 2.2, 0.5, 0.4, -0.17), (2.0, 1.9, 0.5, 0.5, 0.15), (2.0, 0.5, 0.5, 0.5, 1.05)])
def test_reward(spark, q0, q1, v0, v1, want):
    assert one(spark, X.reward(*(F.col(c) for c in "abcd")), a=q0, b=q1, c=v0, d=v1) == pytest.approx(want, abs=1e-6)


def test_guardrail_scores(spark):
    model = G.Model.fit(spark.createDataFrame([(0, "ab cd")], "id int, text string"))
    assert tuple(model.totals.first()) == (4, 4)
    got = dict(model.score(spark.createDataFrame([(0, "ab cd"), (1, "zz"), (2, "")], "id int, text string"), "id").collect())
    assert got[0] == pytest.approx(math.log(0.775), abs=1e-9)
    assert got[1] == pytest.approx((math.log(0.0375) + math.log(0.075)) / 2, abs=1e-9)


def test_threshold_of_few_scores(spark):
    few = spark.createDataFrame([(i, -7.0 - i) for i in range(5)], "id int, score double")
    assert G.suggest_threshold(few).first()[0] == -11.0
    assert G.fit_guardrail(spark.createDataFrame([(0, "ab cd")], "id int, text string"), "id") is None


def test_identity_without_any_model_passes(spark):
    df = spark.createDataFrame([(0, "x y")], "id int, text string")
    assert G.check_identity(df, "id", None, None).first()["inside"] is True


def test_tfidf(spark):
    df = spark.createDataFrame([(1, "abc def"), (2, "abc ghi")], "doc_id long, text string")
    index = Q.Index(Q.searchable(df, "doc_id"), "doc_id")
    hits = index.search(spark.createDataFrame([(0, "def"), (1, "nothing known")], "q int, text string")).collect()
    assert [(r["q"], r["doc_id"], round(r["sim"], 4)) for r in hits] == [(0, 1, 0.8148)]


def test_sentences_split_after_korean_endings(spark):
    text = "한국어 문장을 나누는 시험입니다 그 문장도 여기서 끝납니다. short. This is a fine English sentence here."
    rows = C.sentences(spark.createDataFrame([(0, text)], "doc_id int, text string")).collect()
    assert [r["sentence"] for r in rows] == ["한국어 문장을 나누는 시험입니다", "그 문장도 여기서 끝납니다.", "This is a fine English sentence here."]


@pytest.mark.parametrize(
    "s,bad",
    [
        ("a plain sentence of words", False),
        ("upstream sources are fine", True),
        ("the bell \x07 rings loudly", True),
        ("### $$$ ### $$$ words here", True),
        ("12 34 56", True),
        ("word 12345 !!", True),
        ("ABC DEF GHI words of text", True),
        ("abc def ghi words of text", False),
        ("^ a footnote of some page", True),
        ("Archived from the original page of text which is long enough", True),
        ("see the note [ 12 ] in the text of this long page for more", True),
        ("메뉴와 로그인 화면을 봅니다", True),
        ("메뉴를 화면에서 봅니다", False),
        ("글자를 넣으세요 (0 / 100) 여기에", True),
        ("print (x) shows words of a thing which is long enough here", True),
        ("print (x)는 화면에 글을 보여줍니다", False),
        ("", True),
    ],
)
def test_garbage(spark, s, bad):
    assert one(spark, T.garbage(F.col("s")), s=s) is bad


def test_tokens(spark):
    text = " See https://a.b/c or me@x.org: Été 한글 A1 b 22 x9 "
    assert one(spark, T.tokenize(F.col("s")), s=text) == ["see", "or", "한글", "22"]


def test_words_for_queries(spark):
    cut = {w: one(spark, T.clean_word(F.col("s")), s=w) for w in ("학교에서", "사과", "사람과", "책을", "word")}
    assert cut == {"학교에서": "학교", "사과": "사과", "사람과": "사람", "책을": "책을", "word": "word"}
    good = {w: one(spark, T.good_word(F.col("s")), s=w) for w in ("그리고", "학교", "abc", "abcd", "ab12")}
    assert good == {"그리고": False, "학교": True, "abc": False, "abcd": True, "ab12": False}
    general = {q: one(spark, T.too_generic(F.col("s")), s=q) for q in ("", "data", "data model", "the data model", "연구 방법")}
    assert general == {"": True, "data": True, "data model": False, "the data model": True, "연구 방법": True}


def test_links_unwrap_redirects(spark):
    html = """<a href="//x/l/?uddg=https%3A%2F%2Fa.org%2Fp">1</a><a href='/url?q=https://b.org/&amp;x=1'>2</a><a href="https://c.org">3</a>
    <a href="https://c.org">again</a><a href="https://www.google.com/x">no</a><a href="mailto:x@y">no</a><a href="/rel">no</a>"""
    assert one(spark, T.links(F.col("s")), s=html) == ["https://a.org/p", "https://b.org/", "https://c.org"]
    assert one(spark, T.links(F.col("s"), 1), s=html) == ["https://a.org/p"]


def test_html_text(spark):
    html = "<html><!-- c --><NAV>menu</NAV><p>A &amp; B&nbsp;&lt;c&gt;</p><script>x</script><footer class='f'>end</footer></html>"
    assert one(spark, T.html_text(F.col("s")), s=html) == "A & B <c>"


def nodes(spark, rows):
    return spark.createDataFrame(rows, "node_id long, w array<double>, cx double, cy double, err double")


def test_nearest_node_ties_go_to_the_smaller_id(spark):
    n = nodes(spark, [(5, [1.0, 0.0], 0.0, 0.0, 0.0), (3, [-1.0, 0.0], 1.0, 0.0, 0.0)])
    v = spark.createDataFrame([(0, [0.0, 0.0])], "vec_id long, vec array<double>")
    assert M.bmu(v, n).first()["bmu"] == 3
    two = M.bmu2(v, n.where("node_id = 5")).first()
    assert (two["bmu"], two["second"]) == (5, None)


def paths(spark, edges, pairs):
    ws = Workspace(spark, "test-paths")
    table = spark.createDataFrame(edges, "src long, dst long, w double")
    out = M.shortest_paths(table, spark.createDataFrame(pairs, "src long, dst long"), ws).collect()
    ws.close()
    return {(r["src"], r["dst"]): (r["path"], r["cost"], r["hops"]) for r in out}


def test_paths(spark):
    edges = [(0, 1, 5.0), (0, 2, 1.0), (2, 1, 1.0), (1, 3, 1.0)]
    got = paths(spark, edges, [(0, 0), (0, 1), (0, 3), (0, 3), (3, 0), (7, 7), (7, 0)])
    assert got == {(0, 0): ([0], 0.0, 0), (0, 1): ([0, 2, 1], 2.0, 2), (0, 3): ([0, 2, 1, 3], 3.0, 3), (3, 0): ([3, 0], math.inf, -1), (7, 7): ([7], 0.0, 0), (7, 0): ([7, 0], math.inf, -1)}
    assert paths(spark, edges, []) == {} and paths(spark, [], [(1, 1), (1, 2)]) == {(1, 1): ([1], 0.0, 0), (1, 2): ([1, 2], math.inf, -1)}


def test_paths_longer_than_any_bound_ties_and_cycles(spark):
    chain = [(i, i + 1, 1.0) for i in range(12)] + [(i + 1, i, 0.0) for i in range(12)]
    got = paths(spark, chain, [(0, 12), (12, 0)])
    assert got[0, 12] == (list(range(13)), 12.0, 12) and got[12, 0] == (list(range(12, -1, -1)), 0.0, 12)
    tie = [(0, 5, 1.0), (5, 9, 1.0), (0, 4, 1.0), (4, 9, 1.0), (0, 9, 2.0), (0, 9, 7.0)]
    assert paths(spark, tie, [(0, 9)])[0, 9] == ([0, 9], 2.0, 1)  # fewer steps first
    assert paths(spark, tie[:4], [(0, 9)])[0, 9] == ([0, 4, 9], 2.0, 2)  # then the smaller node


def test_pair_paths_are_means_over_pairs_that_have_a_way(spark):
    grid = nodes(spark, [(0, [0.0], 0.0, 0.0, 0.0), (1, [1.0], 1.0, 0.0, 0.0), (2, [2.0], 2.0, 0.0, 0.0)])
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 3.0)], "src long, dst long, w double")
    pairs = spark.createDataFrame([([0.1], [2.2]), ([0.1], [2.2]), ([0.0], [1.1]), ([1.0], [0.9]), ([2.0], [0.0])], "q array<double>, a array<double>")
    ws = Workspace(spark, "test-pairs")
    assert tuple(X.pair_paths(pairs, grid, edges, ws).first()) == (5, 4, (4.0 + 4.0 + 1.0 + 0.0) / 4, (2 + 2 + 1 + 0) / 4)
    assert tuple(X.pair_paths(pairs.limit(0), grid, edges, Workspace(spark, "test-pairs")).first()) == (0, 0, None, None)


def test_quantization_bounds(spark):
    n = nodes(spark, [(0, [2.0, -1.0], 0.0, 0.0, 0.0), (1, [-2.0, 0.5], 0.0, 0.0, 0.0)])
    q = {r["node_id"]: list(r["wq"]) for r in M.quantized(n).collect()}
    assert q == {0: [127, -127], 1: [-127, 63]} or q == {0: [127, -127], 1: [-127, 64]}
    assert X.quantization_report(spark.createDataFrame([(0, [1.0] * 64)], "vec_id long, vec array<double>"), nodes(spark, [(i, [float(i)] * 64, 0.0, 0.0, 0.0) for i in range(16)])).first()["ratio"] == pytest.approx(16 / 3)


def history(spark, rows):
    cols = ("round", "occupancy", "occ_ratio", "nodes", "mean_qe", "vocab_div")
    return spark.createDataFrame([tuple(r) for r in rows], "round long, occupancy long, occ_ratio double, nodes long, mean_qe double, vocab_div double").select(*cols)


@pytest.mark.parametrize(
    "rows,alarm",
    [
        ([(i, 10 - i, 0.5, 20, 2.0 - i / 10, 0.9 - i / 10) for i in range(4)], "echo"),
        ([(i, 10 - i, 0.05, 20, 2.0, 0.9) for i in range(4)], "point"),
        ([(i, 10, 0.5, 20, 2.0, 0.9) for i in range(5)] + [(5, 10, 0.5, 20, 2.0, 0.1)], "vocabulary"),
        ([(i, 10, 0.12, 300, 2.0, 0.9) for i in range(4)], "overgrown"),
        ([(i, 10, 0.5, 20, 2.0, 0.9) for i in range(8)], None),
        ([(i, 10 - i, 0.05, 300, 2.0, 0.9) for i in range(3)], None),
    ],
)
def test_alarms(spark, rows, alarm):
    last = X.collapse_alarm(history(spark, rows)).orderBy(F.desc("round")).first()
    assert last["alarm"] == alarm


def test_band_of_one_round_takes_all(spark):
    far = spark.createDataFrame([(0, 9.0)], "vec_id long, qe double")
    assert X.domain_band(far, history(spark, [(0, 1, 0.5, 1, 1.0, 0.5)])).first()["inside"] is True
    assert X.domain_band(far, history(spark, [(i, 1, 0.5, 1, 1.0, 0.5) for i in range(2)])).first()["inside"] is False


def test_softmax_sums_to_one(spark):
    p = one(spark, V.softmax(F.col("z"), 0.5), z=[-1.0, -2.0, 0.0])
    assert sum(p) == pytest.approx(1.0, abs=1e-9) and p[2] > p[0] > p[1]


def test_growth_stops_at_threshold(spark):
    n = nodes(spark, [(i, [float(i)], 0.0, 0.0, e) for i, e in enumerate((1.0, 3.0, 2.0, 9.0, 5.0, 4.0, 8.0))])
    assert [(r["node_id"], r["child_id"]) for r in M.growth(n).orderBy("child_id").collect()] == [(3, 7), (6, 8), (4, 9), (5, 10)]
    after = {r["node_id"]: r["err"] for r in M.grown(n).collect()}
    assert len(after) == 11 and after[3] == 4.5 and after[7] == 0.0 and after[1] == 3.0


def test_batch_rounds_do_not_raise_the_error(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), float(i % 3)]) for i in range(60)], "vec_id long, vec array<double>")
    n = nodes(spark, [(i, [i / 2, 1.0, 1.0], float(i), 0.0, 0.0) for i in range(6)])
    before = M.bmu(v, n).agg(F.avg("qe")).first()[0]
    assert M.bmu(v, M.batch_round(v, n, 0.5)).agg(F.avg("qe")).first()[0] <= before + 1e-9


def test_region_refinement_stays_in_range(spark):
    q = M.quantized(nodes(spark, [(i, [i / 3, -i / 2], 0.0, 0.0, 0.0) for i in range(8)])).select("node_id", "wq", "scale")
    region = spark.createDataFrame([("a", i, [0.5 + i / 10, -1.0]) for i in range(4)], "grp string, seq long, vec array<double>")
    rows = R.refine_region(region, q).collect()
    assert len(rows) == 8 and all(abs(x) <= 127 for r in rows for x in r["wq"]) and sum(r["use_count"] for r in rows) == pytest.approx(32, rel=1e-6)


def test_regions_are_greedy(spark):
    v = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.9, 0.1]), ("a", 2, [0.0, 1.0]), ("a", 3, [0.7, 0.7])], "grp string, seq long, vec array<double>")
    assert [r["region"] for r in R.regions(v).orderBy("seq").collect()] == [0, 0, 1, 0]


def test_policy_prefers_rewarded_words(spark):
    log = spark.createDataFrame([("a b", 1.0), ("a c", 0.0)], "query string, reward double")
    ranked = U.rank_queries(spark.createDataFrame([("b",), ("c",), ("new",)], "query string"), U.policy(log)).collect()
    assert [r["query"] for r in ranked] == ["b", "c", "new"]


def test_kth_smallest(spark):
    df = spark.createDataFrame([(x,) for x in [5, 1, 9, 9, 9, 3, -7]], "v long")
    assert [C.kth_smallest(df, "v", k) for k in range(1, 8)] == [-7, 1, 3, 5, 9, 9, 9]
    assert C.kth_smallest(spark.range(5000).select((F.col("id") * 1_000_003).alias("v")), "v", 2500, most=10) == 2499 * 1_000_003


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert C.corpus(none).count() == 0
    assert C.type_token_ratio(C.tokens(none)).first()[0] == 0.0
    assert Q.Index(Q.searchable(none, "doc_id"), "doc_id").search(spark.createDataFrame([(0, "x y")], "q int, text string")).count() == 0
