"""Files, stored state and streams."""

import io
import zipfile

from pyspark.sql import functions as F

from tessera.operators import embed as E
from tessera.operators import guard as G
from tessera.sources import files, store
from tessera.streaming import loop


def docx(path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "<w:p><w:r><w:t>First </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>last</w:t></w:r></w:p>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    path.write_bytes(raw.getvalue())


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("한글 text".encode("cp949"))
    (tmp_path / "b.md").write_text("é plain", "utf-8")
    docx(tmp_path / "c.docx")
    (tmp_path / "d.doc").write_bytes(b"x")
    (tmp_path / "e.docx").write_bytes(b"no zip")
    (tmp_path / "f.html").write_text("<nav>a<nav>b</nav>c</nav><p>seen</p>", "utf-8")
    (tmp_path / "g.bin").write_bytes(b"\x00")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert got["a.txt"]["text"] == "한글 text" and got["b.md"]["text"] == "é plain"
    assert got["c.docx"]["text"] == "First line\nlast\ncell" and got["f.html"]["text"] == "seen"
    assert got["d.doc"]["error"] == "convert .doc to .docx" and got["e.docx"]["error"].startswith("BadZipFile")
    assert got["g.bin"]["error"] == "unsupported: .bin"


def test_search_results(spark):
    body = '{"web":{"results":[{"title":"t","url":"u"},{"title":"s","url":"v","description":"d","extra_snippets":["x"]}]}}'
    rows = files.parse_results(spark.createDataFrame([(body,), ("{}",), ("broken",)], "body string")).collect()
    assert [(r["title"], r["description"], list(r["extra"])) for r in rows] == [("t", "", []), ("s", "d", ["x"])]
    assert files.http_hint(429).startswith("rate") and files.http_hint(500) == "HTTP 500"


def encode(df):
    words = df.select("seq", F.explode(F.split("text", " ")).alias("tok"))
    table = words.select(F.col("tok").alias("word")).distinct().select("word", E.hash_vector(F.col("word"), 4).alias("vec"))
    long = E.sentence_mean(words, table, "seq")
    return long.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda v: v.x).alias("vec"))


def test_learning_cycle(spark, tmp_path):
    nodes = spark.createDataFrame([(i, [float(i), 0.0, 1.0, 0.5], float(i), 0.0, 0.0) for i in range(3)], "node_id long, w array<double>, cx double, cy double, err double")
    learner = loop.Learner(spark, str(tmp_path / "state"), encode, nodes, rounds=1)
    first = learner.step(spark.createDataFrame([(0, "q one", "The first sentence is about rivers and lakes. Another sentence tells of mountains high.")], "seq long, query string, text string"), 0)
    assert first["added"] >= 1 and first["reward"] != loop.PENALTY_EMPTY
    again = learner.step(spark.createDataFrame([(9, "q", "x")], "seq long, query string, text string"), 0)
    assert again["note"] == "already done"
    empty = learner.step(spark.createDataFrame([], "seq long, query string, text string"), 1)
    assert empty["reward"] == loop.PENALTY_EMPTY
    same = learner.step(spark.createDataFrame([(5, "q two", "The first sentence is about rivers and lakes.")], "seq long, query string, text string"), 2)
    assert same["reward"] == loop.PENALTY_REJECTED
    assert {r["word"] for r in learner.policy().collect()} == {"q", "one", "two"}


def test_streamed_counts_equal_batch(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.createDataFrame([(0, "ab cd ef"), (1, "ab cd"), (2, "")], "seq long, text string")
    df.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = loop.running_bigrams(stream).writeStream.outputMode("complete").format("memory").queryName("bigrams").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("bigrams").select("w1", "w2", "c").collect()}
    assert got == {tuple(r) for r in G.Model.fit(df).bi.select("w1", "w2", "c").collect()}


def test_streamed_windows(spark, tmp_path, sf):
    stream = spark.readStream.schema(loop.EVENTS).parquet(f"{sf}/events.parquet*")
    q = loop.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("win").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_versions_are_written_once(spark, tmp_path):
    for n in (1, 2):
        store.save_table(spark.range(n), str(tmp_path / "t"), 0)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
