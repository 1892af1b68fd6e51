"""The pipeline's stages one by one, and as a whole."""

import corpus_pipeline as P


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in P.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"]
    before = docs
    for i, (_, stage) in enumerate(P.STAGES):
        after = stage(spark, before, sf).cache()
        ids = [r["doc_id"] for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and 0 < len(ids) <= before.count()
        if i < 4:
            assert after.columns == P.COLUMNS
        if i != 1 and i < 4:
            assert all(r["text"] == s for r in after.collect() for s in [{x["doc_id"]: x["text"] for x in before.collect()}[r["doc_id"]]])
        before = after
    assert all(r["round_trip"] and r["piece_ids"] for r in before.collect())
    assert P.run(spark, sf).count() == before.count() <= len(text)


def test_empty_documents(spark):
    sf = "/root/testdata/sf0.001"
    before = spark.createDataFrame([], spark.read.parquet(f"{sf}/documents.parquet").schema)
    for _, stage in P.STAGES:
        before = stage(spark, before, sf)
    assert before.count() == 0


def test_long_line_of_two_documents_stays_once(spark):
    def words(name, n):
        return " ".join(f"{name}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n))

    shared, other = words("shared", 60), words("other", 60)
    texts = [f"{words('first', 90)}\n{shared}\nshort line here", f"{shared}\n{words('second', 90)}\nshort line here", other, f"{words('third', 90)}\n{other}"]
    before = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[1:]:
        before = stage(spark, before, "/root/testdata/sf0.001")
    got = {r["doc_id"]: r for r in before.collect()}
    assert {i: r["text"] for i, r in got.items()} == {0: texts[0], 1: f"{words('second', 90)}\nshort line here", 2: other, 3: words("third", 90)}
    assert all(r["n_chars"] == len(r["text"]) and r["round_trip"] for r in got.values())
