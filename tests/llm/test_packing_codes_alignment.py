"""Packing, vector codes and tokenizer alignment against brute force and DuckDB."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment, codebooks, packing, tokens

DOCS = "doc_id long, text string"
ODD = [" ", "  ", "\n", "\t", "a", "word", "<|endoftext|>", "é", "▁", "1", "12", "!", "'s", " ", "\x1c", "\x85", "　", "①", "日本", "\0", "👍", "\r\n", "<0x0A>", "<s>", "'"]


@pytest.fixture(scope="module")
def library():
    """The two libraries' own ids."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    special, plain = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    return special, plain, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 9))) for _ in range(n)]


# --- tokenizers ---


def test_ids_are_the_libraries_own(library, sf):
    special, plain, sp = library
    docs = [x or "" for (x,) in duckdb.sql(f"select text from '{sf}/documents.parquet'").fetchall()]
    for texts in (docs, odd_texts(3000)):
        for kind, ref, name in (("byte", special, "byte_bpe_50k.json"), ("byte-plain", plain, "byte_bpe_50k.json")):
            coder = tokens.coder(kind, tokens.read(tokens.public(name)))
            assert coder.fast is not None
            assert [coder.encode(t).tolist() for t in texts] == [e.ids for e in ref.encode_batch(texts, add_special_tokens=False)]
        coder = tokens.coder("piece", tokens.read(tokens.public("piece_bpe_32k.model")))
        assert [coder.encode(t).tolist() for t in texts] == sp.encode(texts)


def test_ids_are_equal_for_every_class_of_characters(library):
    coder = tokens.coder("byte-plain", tokens.read(tokens.public("byte_bpe_50k.json")))
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000][::7]
    texts = [f"a{chr(c)}{chr(c)}1{chr(c)} {chr(c)}a!{chr(c)} b" for c in points]
    assert [coder.encode(t).tolist() for t in texts] == [e.ids for e in library[1].encode_batch(texts)]


# --- op11 packing ---


def fewest(items, cap):
    best, bins = [len(items)], []
    items = sorted(items, reverse=True)

    def put(i):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in dict.fromkeys(bins):
            if room + items[i] <= cap:
                j = bins.index(room)
                bins[j] += items[i]
                put(i + 1)
                bins[j] -= items[i]
        bins.append(items[i])
        put(i + 1)
        bins.pop()

    put(0)
    return best[0]


def test_patterns_are_as_few_as_exhaustive_search_finds():
    rng = random.Random(1)
    better = 0
    for _ in range(300):
        cap = rng.choice([10, 20, 50, 100])
        items = [rng.randint(1, cap) if rng.random() < 0.5 else rng.randint(cap // 5, cap // 2) for _ in range(rng.randint(1, 11))]
        found = packing.patterns(Counter(items), cap)
        used = Counter()
        for chosen, n in found:
            assert sum(a * b for a, b in chosen) <= cap
            for a, b in chosen:
                used[a] += b * n
        assert used == Counter(items)
        least = fewest(items, cap)
        assert sum(n for _, n in found) == least >= packing.least_sequences(Counter(items), cap)
        better += sum(n for _, n in packing.best_fit(Counter(items), cap)) > least
    assert better  # best fit alone would not do


def test_patterns_of_many_lengths_meet_the_bound():
    rng = random.Random(2)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(30_000)) + Counter({2048: 3000, 1: 9000})
    found = packing.patterns(counts, 2048)
    assert sum(n for _, n in found) == packing.least_sequences(counts, 2048)
    assert packing.patterns({}, 2048) == [] and packing.patterns({7: 1}, 7) == [(((7, 1),), 1)]


def check_packed(rows, cap):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= cap
    return len(by)


def test_packing_equals_row_by_row_cutting(spark, library):
    texts = [None, "", "a", "x <|endoftext|> y", "word " * 9000, "\n", *odd_texts(300), *["same text of a copy"] * 2500]
    rows = [(i if i % 50 else None, t, "e") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS + ", length string")
    cut = packing.cut(docs)
    out = packing.place(cut).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = library[0].encode(t or "", add_special_tokens=False).ids + [0]
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for piece, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            want[(i, piece, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes()))] += 1
    assert Counter((r["id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in out) == want
    total = sum(r["length"] for r in out)
    assert check_packed(out, 2048) == math.ceil(total / 2048)
    ids = Counter()
    for r in packing.sequences(cut).collect():
        assert 0 < len(r["ids"]) <= 2048
        ids.update(r["ids"])
    assert ids == Counter(x for r in out for x in np.frombuffer(r["ids"], "<u4").tolist())


def test_placing_with_clashing_names_one_hot_length_and_none(spark):
    pieces = spark.range(5000).select(F.lit(3).cast("long").alias("length"), F.col("id").alias("salt"), F.lit(1).alias("part"), F.lit("x").alias("sequence_id"), F.lit(2).alias("_number"))
    out = packing.place(pieces, 10).collect()
    assert check_packed(out, 10) == math.ceil(5000 / 3) and sorted(r["salt"] for r in out) == list(range(5000))
    assert packing.place(pieces.limit(0), 10).count() == 0
    assert packing.cut(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        packing.place(pieces, 2)


# --- op12 vector codes ---


def plain_codes(rows, parts, entries, rounds):
    """Row by row in Python's whole numbers: rows (id, vector of numbers)."""
    kept = [(i, [math.floor(x * 256) for x in v]) for i, v in rows]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in kept]
    first = sorted(range(len(kept)), key=lambda k: kept[k])[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = [near(c[p], books[p])[1] for c in cut]
            groups = [[c[p] for c, e in zip(cut, of, strict=True) if e == k] for k in range(len(books[p]))]
            new.append([[sum(x) // len(g) for x in zip(*g, strict=True)] if g else old for g, old in zip(groups, books[p], strict=True)])
        books = new
    return [[near(c[p], books[p]) for p in range(parts)] for c in cut], books


@pytest.mark.parametrize("n,spread", [(5, 1.0), (300, 0.3), (300, 0.004)])
def test_codes_equal_brute_force(spark, n, spread):
    rng = random.Random(n)
    good = [(i, [float(np.float32(rng.gauss(0, spread))) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(0, 2 * n, 2)]
    good += good[:3] * 2  # repeated rows
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 1), (3, [None] * 8, 1), (5, [0.0] * 7 + [nan], 2), (7, [inf] + [0.0] * 7, 2), (9, [-inf] * 8, 1), (11, [1.0, 2.0], 1), (13, [], 1)]
    rows = [(*r, "x") for r in good + bad]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, codes string").repartition(5)
    out, books = codebooks.compress(df, parts=2, entries=16, rounds=2)
    want, want_books = plain_codes([(i, v) for i, v, _ in good], 2, 16, 2)
    assert [b.tolist() for b in books] == want_books
    got = Counter((r["id"], tuple(r["codes"]), r["error"], r["label"]) for r in out.collect())
    assert got == Counter((i, tuple(e for _, e in w), sum(d for d, _ in w), label) for (i, _, label), w in zip(good, want, strict=True))
    sums = Counter()
    for i, _, error, label in got.elements():
        sums[label] += error
    assert all(r["label_error"] == sums[r["label"]] for r in out.collect())


def test_cells_bound_and_ties():
    rng = np.random.default_rng(0)
    for spread in (3, 50, codebooks.LARGEST):
        entries, parts = rng.integers(-spread, spread, (64, 4)), rng.integers(-spread, spread, (500, 4))
        entries[40] = entries[7]
        entry, distance = codebooks.Cells(entries).nearest(parts)
        full = ((parts[:, None] - entries[None]) ** 2).sum(2)
        assert (entry == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_codes_of_nothing_odd_numbers_and_null_ids(spark):
    none, books = codebooks.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert none.count() == 0 and books == []
    df = spark.createDataFrame([(None, [1e30] * 4), (2, [-1e30] * 4), (None, [0.5] * 4)], "vec_id long, embedding array<double>")
    out, books = codebooks.compress(df, parts=2, entries=2, rounds=0)
    assert books[0].tolist() == [[-codebooks.LARGEST] * 2, [128] * 2] and out.count() == 3
    with pytest.raises(ValueError):
        codebooks.compress(df, parts=3)


def test_codes_equal_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.execute(codebooks.ORACLE).fetchall()
    columns = [c[0] for c in con.description]
    got = [tuple(r[c] for c in columns) for r in codebooks.query(spark, sf).collect()]
    assert sorted(got) == sorted(want)


# --- op13 alignment ---


def plain_alignment(texts, library):
    """Token by token: two pointers over the ends of both sides."""
    _, byte, sp = library
    chars = tokens._byte_characters()
    out, counts = [], Counter()
    for t in texts:
        row = {"a": [], "b": [], "groups": [], "links": []}
        out.append(row)
        if not t:
            continue
        a, b = byte.encode(" " + t).ids, sp.encode(t)
        spell_a = [bytes(chars[c] for c in byte.id_to_token(i)) for i in a]
        spell_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(spell_a) == b"".join(spell_b) == (" " + t).encode():
            continue
        row["a"], row["b"] = a, b
        i = j = end_a = end_b = 0
        part_a, part_b = [], []
        while i < len(a) or j < len(b):
            if end_a <= end_b:
                end_a += len(spell_a[i])
                part_a.append(a[i])
                i += 1
            else:
                end_b += len(spell_b[j])
                part_b.append(b[j])
                j += 1
            if end_a == end_b:
                row["groups"].append(",".join(map(str, part_a)) + "|" + ",".join(map(str, part_b)))
                row["links"].append((part_a[-1], part_b[-1]))
                part_a, part_b = [], []
        counts.update(row["links"])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for row in out:
        links = row["links"]
        row["result"] = (len(row["a"]), len(row["b"]), len(row["groups"]), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(row["groups"]).encode()).hexdigest() if links else "")
    return out


def test_alignment_equals_two_pointers(spark, library, tmp_path):
    texts = [None, "", " ", "word " * 60_000, "a▁b", *odd_texts(400), *["a hot text, very common."] * 700]
    texts += [x for (x,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    rows = [(i // 2 if i % 9 else None, t, "z") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS + ", n_a string").repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    got = alignment.query(spark, str(tmp_path)).collect()
    want = plain_alignment(texts, library)
    assert Counter(tuple(r) for r in got) == Counter((i, *w["result"]) for (i, _, _), w in zip(rows, want, strict=True))
    found = alignment.align(spark.createDataFrame(rows[5:200], DOCS + ", n_a string")).collect()
    assert [r["groups"] for r in found] == [";".join(w["groups"]) for w in want[5:200]]


def test_alignment_of_nothing_and_bytes_that_are_no_text(spark, tmp_path):
    assert alignment.align(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.sql("select 1L as doc_id, cast(X'61FF62' as string) as text union all select 2L, 'a�b'")
    got = {r["id"]: r["n_a"] for r in alignment.align(odd).collect()}
    assert got[1] == 0 and got[2] > 0
