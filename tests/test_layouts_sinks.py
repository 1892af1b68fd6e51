"""Embedding layouts, files as one corpus, numbers in order, and files that are handed out."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import corpus as C
from tessera.operators import growing as W
from tessera.sources import files, layouts, sinks
from tessera.sources.experts import Experts
from tessera.sources.workspace import Workspace

MATRIX = [[1.0, 2.0], [3, 4.5], [-1.0, 0.0]]
WORDS = {"aa": 0, "b b": 1, "한글": 2}
WANT = {("aa", 0, (1.0, 2.0)), ("b b", 1, (3.0, 4.5)), ("한글", 2, (-1.0, 0.0))}
LIST = list(WORDS)


@pytest.mark.parametrize(
    "doc",
    [
        {"tok_emb": MATRIX, "word2idx": WORDS, "dim": 2},
        {"weights": MATRIX, "stoi": WORDS},
        {"embeddings": [1, 2], "emb": MATRIX, "vocab": WORDS},  # the first name is no matrix
        {"vectors": MATRIX, "idx2word": {str(i): w for w, i in WORDS.items()}},
        {"embedding": MATRIX, "idx2word": LIST},
        {"som": {"w": [1]}, "tok": {"inner.x": {"weight": MATRIX, "vocab": WORDS}}, "n": 3},
        {w: MATRIX[i] for w, i in WORDS.items()},
    ],
)
def test_layouts(spark, tmp_path, doc):
    (tmp_path / "e.json").write_text(json.dumps(doc, ensure_ascii=False), "utf-8")
    got = layouts.load(spark, str(tmp_path / "e.json"))
    assert got.error is None and got.mode == "tok_emb"
    rows = {(r["word"], r["idx"], tuple(r["vec"])) for r in got.table.collect()}
    assert rows == WANT if "aa" not in doc else {(w, v) for w, _, v in rows} == {(w, v) for w, _, v in WANT}


@pytest.mark.parametrize("text,says", [("[1, 2]", "no object"), ("not json", "not a JSON"), ('{"a": 1, "b": {"tok_emb": [[1]]}}', "top names: ['a', 'b']"), ("{}", "top names: []"), ('{"tok_emb": [1, 2], "vocab": {"a": 0}}', "no matrix")])
def test_layouts_that_cannot_be_read(spark, tmp_path, text, says):
    (tmp_path / "e.json").write_text(text)
    got = layouts.load(spark, str(tmp_path / "e.json"))
    assert got.table is None and got.mode == "hash" and says in got.error
    assert "PATH_NOT_FOUND" in layouts.load(spark, str(tmp_path / "missing.json")).error


def test_files_as_one_corpus(spark, tmp_path):
    one, two = "The river runs past the old stone bridge.", "Another sentence tells of mountains and lakes."
    (tmp_path / "a.txt").write_text(f"{one} {two} {one}")
    (tmp_path / "b.md").write_bytes(f"{two} 한국어 문장을 나누는 시험입니다.".encode("cp949"))
    (tmp_path / "c.txt").write_text(" ")
    (tmp_path / "d.doc").write_bytes(b"x")
    raw = spark.read.format("binaryFile").load(str(tmp_path)).withColumn("text", F.lit("clash"))
    found, status = files.sentences(raw)
    got = sorted((r["path"].rsplit("/", 1)[-1], r["pos"], r["sentence"]) for r in found.collect())
    assert got == [("a.txt", 0, one), ("a.txt", 1, two), ("b.md", 1, "한국어 문장을 나누는 시험입니다.")]
    info = {r["path"].rsplit("/", 1)[-1]: (r["kind"], r["n_sentences"], r["error"], r["info"]) for r in status.collect()}
    assert info["a.txt"] == ("txt", 2, None, "txt, 130 characters, 2 sentences") and info["b.md"][1] == 2
    assert info["c.txt"] == ("txt", 0, None, "txt, 1 characters, 0 sentences") and info["d.doc"][3] == "convert .doc to .docx"


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id").repartition(5)
    ws = Workspace(spark, "test-numbers")
    got = C.numbered(df, [F.desc("k"), F.col("id")], "rank", ws).collect()
    want = {r: i for i, r in enumerate(sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1])))}
    assert {(r["k"], r["id"]): r["rank"] for r in got} == want
    assert C.numbered(df.limit(0), ["id"], "rank", ws).count() == 0
    ws.close()


def test_corpus_text_round_trip(spark, tmp_path):
    rows = [(i, f"line {i}") for i in range(300)] + [(1000, "two\nlines\r\nhere"), (1001, "  "), (1002, None), (1003, "  last ")]
    df = spark.createDataFrame(rows, "seq long, text string").repartition(4)
    sinks.write_corpus(df, str(tmp_path / "c"))
    got = [r["text"] for r in sinks.read_corpus(spark, str(tmp_path / "c")).orderBy("seq").collect()]
    assert got == [f"line {i}" for i in range(300)] + ["two lines here", "last"]


def test_metrics_round_trip(spark, tmp_path):
    rows = [(0, 5, 3, 0.5, None), (1, None, 2, 0.25, 7.5)]
    sinks.write_metrics(spark.createDataFrame(rows, "round long, n_inputs long, occupancy long, mean_qe double, mean_path_cost double").withColumn("note", F.lit("x")), str(tmp_path / "m"))
    lines = [json.loads(x) for f in (tmp_path / "m").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(lines, key=lambda x: x["round"])[0] == {"round": 0, "n_inputs": 5, "occupancy": 3, "mean_qe": 0.5}
    got = sinks.read_metrics(spark, str(tmp_path / "m")).select("round", "n_inputs", "occupancy", "mean_qe", "mean_path_cost").collect()
    assert sorted(map(tuple, got)) == rows


def test_embeddings_and_experts_round_trip(spark, tmp_path):
    table = W.seeded(spark.createDataFrame([("a", [0.1, 1.0]), ("b", None)], "word string, vec array<double>"))
    sinks.write_embedding(table, str(tmp_path / "e"))
    got = {r["word"]: r for r in sinks.read_embedding(spark, str(tmp_path / "e")).collect()}
    assert got["a"]["vec"] == pytest.approx([0.1, 1.0], abs=1e-7) and got["b"]["vec"] is None and got["a"]["is_seed"]
    held = Experts(spark, str(tmp_path / "x"))
    held.add("one", "first")
    held.add("two")
    held.add_to(spark.createDataFrame([("one", i, f"word number {i} of the corpus here") for i in range(12)], "expert string, seq long, text string"))
    held.train("one")
    held.remove("two")
    copy = sinks.write_experts(held, str(tmp_path / "y"))
    for name in ("about", "corpus", "uni", "bi", "gate"):
        assert sorted(map(tuple, copy.table(name).collect())) == sorted(map(tuple, held.table(name).collect()))
    assert copy.names() == ["one"]
