"""Operators without SQL against plain loops: the ring walk, the risk, the features, the compressors, the pipeline's odd rows."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import language, quality, sharding
from tessera.llm.textbytes import Block

DOCS = "doc_id long, text string"
LONG = "a very long text of words " * 40_000
ODD = ["", "a", "A b.\nA b.\nc", "é 12 !?", "one one two\ttwo two", "\n\n", "x" * 3000, "日本 ab", "the cat.\nthe cat.\n\nthe dog"]


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# --- op4: one row at a time around the ring ---


def walk(cells_of, n_shards, vnodes, slack):
    """Shard counts by cell of rows (their cells), each row going on clockwise by itself."""
    cells, owners = sharding.ring(n_shards, vnodes)
    room = sharding.bounds(len(cells_of), n_shards, slack)
    used, out, over = [0] * n_shards, Counter(), []
    for cell in sorted(cells_of):
        node = next((k for k, c in enumerate(cells) if c >= cell), 0)
        if used[owners[node]] < room[owners[node]]:
            used[owners[node]] += 1
            out[cell, int(owners[node])] += 1
        else:
            over.append((cell, node))
    for cell, node in over:
        while used[owners[node]] >= room[owners[node]]:
            node = (node + 1) % len(cells)
        used[owners[node]] += 1
        out[cell, int(owners[node])] += 1
    return out


def cell_of():
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("ring")), 48).cast("int")


@pytest.mark.parametrize("slack,split", [(0.0, 50_000), (0.1, 50_000), (0.0, 40)])
def test_shards_equal_a_walk_row_by_row(spark, monkeypatch, slack, split):
    monkeypatch.setattr(sharding, "SPLIT", split)
    rows = [(i if i % 3 else 5, f"t{i % 7}", i, "x") for i in range(900)] + [(5, LONG, 0, "y"), (None, None, 1, None)] + [(5, "t0", 0, "z")] * 300
    d = table(spark, rows, DOCS + ", shard int, key string")
    got = sharding.shard(d, 5, vnodes=8, slack=slack).withColumn("cell", cell_of()).groupBy("cell", "shard").count().collect()
    want = walk([r["cell"] for r in d.select(cell_of().alias("cell")).collect()], 5, 8, slack)
    assert {(r["cell"], r["shard"]): r["count"] for r in got} == want


@pytest.mark.parametrize("split", [50_000, 30])
def test_shards_and_slots_do_not_depend_on_the_layout(spark, monkeypatch, split):
    monkeypatch.setattr(sharding, "SPLIT", split)
    rows = [(i % 200, f"t{i % 5}") for i in range(1500)] + [(7, "same")] * 400
    found = [Counter(map(tuple, sharding.shard(table(spark, rows).repartition(n), 4, vnodes=16).collect())) for n in (1, 7)]
    assert found[0] == found[1] and sum(found[0].values()) == 1900
    for shard in range(4):
        slots = sorted(r[4] for r in found[0].elements() if r[3] == shard)
        assert slots == list(range(len(slots)))


# --- op3: features and risk ---


def plain_features(text):
    raw = text.encode()
    n = max(1, len(raw))
    single = [math.sqrt(raw.count(bytes([b])) / n) for b in range(256)]
    kinds = [int(quality._CLASS[b]) for b in raw]
    pairs = Counter(zip(kinds, kinds[1:], strict=False))
    double = [math.sqrt(pairs[a, b] / n) for a in range(quality.N_CLASS) for b in range(quality.N_CLASS)]
    words = raw.split()  # the six ASCII spaces

    def repeated(items):
        seen, again = set(), 0
        for x in items:
            again += x in seen
            seen.add(x)
        return again / max(1, len(items))

    rest = [math.log1p(len(words)) / 10, math.log1p(len(raw)) / 15, sum(map(len, words)) / max(1, len(words)) / 20, repeated(words)]
    rest += [sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words)), repeated(raw.split(b"\n"))]
    return single + double + rest


def test_features_equal_plain_counts():
    texts = [*ODD, LONG]
    x = quality.features(Block([t.encode() for t in texts]))
    assert x == pytest.approx(np.array([plain_features(t) for t in texts]), abs=1e-12)


def test_risk_is_minimised_as_by_plain_loops():
    rng = np.random.default_rng(1)
    for shift, prior in ((1.5, 0.3), (0.2, 0.9)):  # in the second the negative part falls below zero
        pos, unl = rng.normal(shift, 1, (14, 3)), np.concatenate([rng.normal(shift, 1, (8, 3)), rng.normal(-1, 1, (9, 3))])
        model = quality.fit(pos, unl, prior, steps=60)
        both = np.concatenate([pos, unl])
        mean, scale = both.mean(0), both.std(0) + 0.01
        p, u = [[[min(8, max(-8, (v - m) / s)) for v, m, s in zip(r, mean, scale, strict=True)] + [1.0] for r in x] for x in (pos, unl)]
        w, m1, m2 = [0.0] * 4, [0.0] * 4, [0.0] * 4
        turned = 0

        def loss(x, sign):
            total, slope = 0.0, [0.0] * 4
            for r in x:
                z = sign * sum(a * b for a, b in zip(r, w, strict=True))
                total += math.log1p(math.exp(-z)) / len(x)
                for i in range(4):
                    slope[i] -= sign * r[i] / (1 + math.exp(z)) / len(x)
            return total, slope

        for t in range(1, 61):
            (_, gp), (lpn, gpn), (lun, gun) = loss(p, 1), loss(p, -1), loss(u, -1)
            ok = lun - prior * lpn >= 0
            turned += not ok
            g = [prior * a + b - prior * c if ok else prior * c - b for a, b, c in zip(gp, gun, gpn, strict=True)]
            for i in range(4):
                gi = g[i] + 1e-4 * w[i]
                m1[i], m2[i] = 0.9 * m1[i] + 0.1 * gi, 0.999 * m2[i] + 0.001 * gi * gi
                w[i] -= 0.02 * (m1[i] / (1 - 0.9**t)) / (math.sqrt(m2[i] / (1 - 0.999**t)) + 1e-8)
        assert [*model.weight, model.bias] == pytest.approx(w, abs=1e-9)
        assert (turned > 0) == (prior == 0.9)


def test_quality_of_long_texts_and_clashing_names(spark):
    d = table(spark, [(1, LONG, "q", 1.0), (2, "short", "r", 2.0), (None, None, None, None)], DOCS + ", x string, quality_score double")
    model = quality.train(d, table(spark, [(1, 1), (2, 0)], "doc_id long, quality int"))
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(d, model).collect()}
    x = np.array([plain_features(t) for t in (LONG, "short", "")])
    assert [got[1], got[2], got[None]] == pytest.approx(list(model(x)), abs=1e-6)


# --- op7: each compressor by itself ---


def test_languages_equal_a_direct_loop(spark):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    content = language.dictionaries(d.where(language.fold(F.col("doc_id"), 4) != 2))
    texts = [(i, t) for i, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()] + [(1000 + i, t) for i, t in enumerate([*ODD, LONG, None])]
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language.identify(table(spark, [(*r, 5) for r in texts], DOCS + ", lang_rejected int"), content).collect()}
    for i, text in texts:
        if not text or not any(c.isalpha() for c in text):
            assert got[i] == ("und", 0.0)
            continue
        raw, sizes = language.letters(text), {}
        for lang, words in content.items():
            one = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(one.compress(raw[k : k + language.PIECE])) for k in range(0, len(raw), language.PIECE))
        best = min(sizes, key=sizes.get)  # the first, and more frequent, among equals
        second = min(s for lang, s in sizes.items() if lang != best)
        assert got[i] == (best, pytest.approx(0.5 + 0.5 * min(1.0, 5 * (second - sizes[best]) / second)))


def test_dictionaries_are_excerpts_of_their_own_language(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choices(["alpha", "bravo", "carol", "delta"], k=200)) + f" {lang}", lang) for lang in ("xx", "yy") for _ in range(40)]
    got = language.dictionaries(table(spark, rows * 3, "text string, lang string"), docs_per_lang=25, excerpt=100)
    own = {lang: [t for t, x in rows if x == lang] for lang in ("xx", "yy")}
    for lang, content in got.items():
        assert 25 * 60 < len(content) <= 26 * 101
        assert all(any(language.letters(part).strip() in language.letters(t) for t in own[lang]) for part in [content.decode()[:80]])


# --- the pipeline ---


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(9)
    words = {x: [f"{x}{a}{b}" for a in "abcdefgh" for b in "klmnop"] for x in ("en", "de")}

    def text(x, n=80):
        return " ".join(rng.choices(words[x], k=n))

    rows = [(i, text("en" if i % 2 else "de"), "en" if i % 2 else "de", "web", 0, "more") for i in range(60)]
    same = rows[5][1]
    rows += [(100, same, "en", "web", 0, None), (100, same, "en", "web", 0, None), (None, text("en"), None, None, None, "n"), (101, None, "en", "s", 1, "x"), (102, "  \n ", None, "s", 1, "x"), (103, "123 !!", "de", "s", 1, "x")]
    table(spark, rows, DOCS + ", lang string, source string, n_chars long, extra string").write.parquet(str(tmp_path / "documents.parquet"))
    item = rows[7][1].split()[10:25]
    table(spark, [(0, " ".join(item)), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = P.run(spark, str(tmp_path)).collect()
    ids = Counter(r["doc_id"] for r in out)
    assert max(ids.values()) == 1 and 100 not in ids and 5 in ids  # one of the copies, the smallest id
    assert 7 not in ids and not {101, 102, 103} & set(ids)  # contaminated; without letters
    assert set(ids) >= {i for i in range(60)} - {7} and None in ids
    assert all(r["round_trip"] and r["piece_ids"] for r in out) and "extra" not in out[0]


def test_pipeline_of_no_rows(spark, tmp_path):
    import corpus_pipeline as P

    table(spark, [], DOCS + ", lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, [], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


# --- op6: a very long text, clashing names, one passage in every text ---


def test_repeats_in_a_long_text_and_under_clashing_names(spark):
    import hashlib

    from tessera.llm import suffixdedup

    rng = np.random.default_rng(3)
    far = rng.integers(97, 123, 3_000_000, dtype=np.uint8).tobytes()
    passage = rng.integers(97, 123, 700, dtype=np.uint8).tobytes()
    raws = [far + b"Z" + passage, *(rng.integers(97, 123, 150, dtype=np.uint8).tobytes() + bytes([65 + k]) + passage + bytes([97 + k]) * 3 for k in range(12)), b"short"]
    rows = [(i, r.decode(), 1, "x", [2]) for i, r in enumerate(raws)]
    df = table(spark, rows, DOCS + ", k1 long, gram string, spans array<int>")
    got = {r["doc_id"]: (r["n_bytes"], [tuple(x) for x in r["spans"]], hashlib.sha256(r["kept"]).hexdigest()) for r in suffixdedup.remove_repeats(df).collect()}
    for i, raw in enumerate(raws):
        at = raw.find(passage)
        spans = [(at, at + 700)] if at >= 0 else []
        kept = raw[:at] + raw[at + 700 :] if at >= 0 else raw
        assert got[i] == (len(raw), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("near", [0, 6, 10_000])
def test_halves_of_members_tell_pairs_and_whole_ones_those_at_the_threshold(spark, monkeypatch, near):
    """Pairs at, just below and far from the threshold; the sets that meet in the first comparison hold 32 bits a member."""
    from tessera.llm import parityjoin
    from tessera.sources.workspace import Workspace

    kinds, stage = {}, Workspace.stage
    monkeypatch.setattr(Workspace, "stage", lambda self, df, name: (kinds.__setitem__(name, dict(df.dtypes).get("set")), stage(self, df, name))[1])
    monkeypatch.setattr(parityjoin, "NEAR", near)
    words = [f"w{i}" for i in range(400)]
    # one-word shingles: 90 of 100 in common is a similarity of 90 / 100 against the shorter set, 89 of 99 and so on below it
    sets = [words[:100], words[:90], words[100:200], words[100:189], words[200:300], words[200:299], words[300:400], words[300:340]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(sets)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in parityjoin.near_duplicates(docs, 1, 90).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}
    assert kinds["star-sets"] == "array<int>" and kinds.get("star-near-sets", "array<bigint>") == "array<bigint>"
