"""The operators in free style against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, language, parityjoin, pieces, quality, sharding, suffixdedup
from tessera.llm.textbytes import Block

DOCS = "doc_id long, text string"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# --- op2 chat formatting ---


@pytest.mark.parametrize(
    "turns",
    [
        [],
        [("user", ""), ("assistant", "")],
        [("user", "<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n")],
        [("user", "a <\\| b"), ("assistant", "<|im_end|>")],
        [("us\ner", "x"), ("<|im_start|>", "y"), ("a\\n", "z\n")],
        [("user", "<\\\\|<||><|"), ("user", "<|im_start|>user\n")],
        [("", "<|im_end|>"), ("\\", "\n<|im_end|>\n\n")],
    ],
)
def test_chat_reads_back(turns):
    text, found = chat.format_chat(turns)
    assert [(r, t) for r, t, _, _ in found] == turns
    assert [chat.unescape(text[b:e]) for _, _, b, e in found] == [t for _, t in turns]


def test_chat_random_round_trips():
    rng = random.Random(1)
    bits = ["<|im_start|>", "<|im_end|>", "\n", "\\", "<", "|", ">", "<\\|", "user", "é", ""]
    for _ in range(500):
        turns = [("".join(rng.choices(bits, k=2)), "".join(rng.choices(bits, k=rng.randint(0, 6)))) for _ in range(rng.randint(1, 4))]
        assert [(r, t) for r, t, _, _ in chat.format_chat(turns)[1]] == turns


def test_chat_nulls_ties_and_extra_columns(spark):
    rows = [(1, 0, "user", None, "x"), (1, 1, None, "b", "y"), (1, 1, "assistant", "a", "z"), (1, 1, "assistant", "a", "z"), (None, 0, "assistant", "n", "q")]
    out = {r["conv_id"]: r for r in chat.format_conversations(docs(spark, rows, "conv_id long, turn long, role string, text string, formatted string")).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("user", ""), ("", "b"), ("assistant", "a"), ("assistant", "a")]
    assert len(out[1]["loss_spans"]) == 2 and out[None]["turns"][0]["text"] == "n"
    none = chat.format_conversations(docs(spark, [], "conv_id long, turn long, role string, text string"))
    assert none.count() == 0


# --- op3 quality classifier ---


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in out if r["quality"] == 1], [r["score"] for r in out if r["quality"] == 0]
    assert good and bad and np.mean([g > b for g in good for b in bad]) > 0.95
    assert all((r["score"] >= 0.5) == bool(r["predicted"]) for r in out)


def test_quality_without_labels_and_odd_texts(spark):
    some = docs(spark, [(0, None), (1, ""), (2, "x " * 50_000), (2, "x " * 50_000), (None, "a b")])
    labels = docs(spark, [], "doc_id long, quality int")
    model = quality.train(some, labels)
    assert model == 0.5 and [r["quality_score"] for r in quality.score(some, model).collect()] == [0.5] * 5
    model = quality.train(some, docs(spark, [(2, 1)], "doc_id long, quality int"))
    assert all(0 <= r["quality_score"] <= 1 for r in quality.score(some, model).collect())
    assert quality.score(docs(spark, []), model).count() == 0


# --- op4 sharding ---


def test_shards_are_full_and_slots_gapless(spark, sf):
    out = sharding.query(spark, sf).collect()
    by = Counter(r["shard"] for r in out)
    assert sorted(by) == list(range(16)) and max(by.values()) - min(by.values()) <= 1
    for s in by:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(by[s]))
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and r["size"] == len(text[r["doc_id"]].encode()) + 1 for r in out)


def test_shards_move_few_rows_when_one_is_added(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a = {r["doc_id"]: r["shard"] for r in sharding.shard(d, 16, slack=0.1).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.shard(d, 17, slack=0.1).collect()}
    assert max(Counter(a.values()).values()) <= 276 and sum(a[i] != b[i] for i in a) < 4000 * 0.16


def test_shards_of_repeated_and_null_rows(spark):
    d = docs(spark, [(None, None)] * 3 + [(1, "é")] * 7 + [(2, "")])
    out = sharding.shard(d, 4).collect()
    assert len(out) == 11 and sorted(Counter(r["shard"] for r in out).values()) == [2, 3, 3, 3]
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in out} == {(None, 1, 0), (1, 3, zlib.crc32("é".encode())), (2, 1, 0)}
    assert sharding.shard(docs(spark, []), 4).count() == 0


def test_crowded_cells_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SPLIT", 50)
    d = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    out = sharding.shard(d, 4).collect()
    assert sorted(Counter(r["shard"] for r in out).values()) == [250] * 4
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(250)) for s in range(4))


# --- op6 suffix dedup ---


def brute_repeats(raws):
    w = suffixdedup.WIDTH
    seen = Counter(r[i : i + w] for r in raws for i in range(len(r) - w + 1))
    out = []
    for r in raws:
        hit = np.zeros(len(r), bool)
        for i in range(len(r) - w + 1):
            if seen[r[i : i + w]] > 1:
                hit[i : i + w] = True
        edge = np.diff(np.concatenate([[0], hit.astype(int), [0]]))
        out.append((len(r), int(hit.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~hit])).hexdigest()))
    return out


def repeats_fixture():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmno é", k=rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    common = text(120)
    texts = [None, "", "short", "ab" * 700, "x" * 399, "x" * 400, "x" * 401, common, common]
    texts += [text(rng.randint(1, 60)) + common[rng.randint(0, 80) : rng.randint(300, 700)] + text(rng.randint(1, 60)) for _ in range(60)]
    base = text(400)
    for _ in range(30):
        at = rng.randint(0, len(base) - 10)
        texts.append(base[:at] + word() + base[at + rng.randint(0, 9) :])
    return texts


@pytest.mark.parametrize("most", [1024, 3])
def test_repeats_equal_brute_force(spark, most, monkeypatch):
    texts = repeats_fixture()
    if most == 3:
        raws = [t.encode() for t in texts if t and len(t.encode()) > 800][:6]
        owner, start, cls = suffixdedup.sort_suffixes(raws, [500] * len(raws))
        want = {}
        for o, s, c in zip(owner, start, cls, strict=True):
            want.setdefault(c, set()).add((500 - s, raws[o][s : s + 400]))
        assert all(len(v) == 1 for v in want.values()) and len({next(iter(v)) for v in want.values()}) == len(want)
        return
    out = suffixdedup.remove_repeats(docs(spark, list(enumerate(texts)))).collect()
    got = {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["begin"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out}
    assert got == dict(enumerate(brute_repeats([(t or "").encode() for t in texts])))


def test_repeats_across_buckets(spark):
    texts = repeats_fixture()
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        out = suffixdedup.remove_repeats(docs(spark, list(enumerate(texts)))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["begin"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out}
    assert got == dict(enumerate(brute_repeats([(t or "").encode() for t in texts])))
    assert suffixdedup.remove_repeats(docs(spark, [])).count() == 0


# --- op7 language ID ---


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = language.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out and n_chars > 40").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.97


def test_language_edges(spark):
    learn = docs(spark, [("the cat and the dog sat on the mat and slept", "en"), ("der Hund und die Katze schliefen auf dem Sofa", "de"), ("x", None), (None, "fr")], "text string, lang string")
    content = language.dictionaries(learn)
    assert set(content) == {"en", "de"}
    odd = docs(spark, [(0, None, 1), (1, "", 2), (2, "123 !?", 3), (3, "und die Katze und der Hund schliefen", 4), (3, "und die Katze und der Hund schliefen", 4)], "doc_id long, text string, lang_pred int")
    got = sorted((r["doc_id"], r["lang_pred"], r["lang_rejected"]) for r in language.identify(odd, content).collect())
    assert got == [(0, "und", True), (1, "und", True), (2, "und", True), (3, "de", False), (3, "de", False)]
    assert [r["lang_pred"] for r in language.identify(odd, {}).collect()] == ["und"] * 5
    assert language.identify(docs(spark, []), content).count() == 0
    assert language.Classifier({"en": b"the"})("a word")[:2] == ("en", 1.0)


# --- op9 pieces ---


def tiny():
    normal = ["▁", "a", "b", "▁a", "ab", "▁ab", "aba", "é", "▁▁"]
    p = ["<unk>", *(f"<0x{i:02X}>" for i in range(256)), *normal]
    scores = [0.0] * 257 + [-3.0, -2.0, -2.5, -2.2, -2.1, -6.0, -2.3, -4.0, -4.5]
    return pieces.Vocabulary(p, scores, list(range(257, 257 + len(normal))), list(range(1, 257)))


def brute_best(vocab, text):
    """The best sum over all ways to write the text, by trying every end."""
    known = {vocab.pieces[i]: vocab.scores[i] for i in vocab.normal}

    def best(t):
        if not t:
            return 0.0
        ways = [known[t[:k]] + best(t[k:]) for k in range(1, len(t) + 1) if t[:k] in known]
        return max(ways + ([vocab.unk + best(t[1:])] if t[0] not in known else []))

    return best(text.replace(" ", pieces.MARK))


def test_viterbi_is_optimal():
    vocab, rng = tiny(), random.Random(3)
    codec = pieces.Codec(vocab)
    for _ in range(300):
        text = "".join(rng.choices("aab é ☃", k=rng.randint(1, 9)))
        ids = codec.encode(text)
        score, held = 0.0, 0
        for i in ids:
            if i < 257:
                held += 1
            else:
                score += vocab.scores[i]
        chars = held / len("☃".encode())
        assert score + chars * vocab.unk == pytest.approx(brute_best(vocab, " " + text)) and codec.decode(ids) == text


def test_pieces_round_trip(spark):
    texts = [None, "", " ", "  a  b ", "a▁b\n\n", "\0x", "日本 ☃ é", "word " * 30_000, "x" * 100_000]
    out = {r["doc_id"]: r for r in pieces.encode(docs(spark, list(enumerate(texts)))).collect()}
    assert all(out[i]["piece_text"] == t for i, t in enumerate(texts)) and out[0]["piece_ids"] is None and out[1]["piece_ids"] == []
    assert pieces.encode(docs(spark, [])).count() == 0


def test_trie_finds_every_piece():
    codec = pieces.Codec(pieces.load(pieces.default_path()))
    assert all(codec.trie.find(codec.vocab.pieces[i].encode()) == i for i in codec.vocab.normal)
    assert codec.trie.find("▁notapieceatall".encode()) == -1


# --- op10 parity join ---


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").translate({i: i + 32 for i in range(65, 91)}).split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def near_fixture():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "  ", "One", "one", "one two", "ONE two", "one two three"]
    for size in (8, 12, 30, 80, 200):
        base = rng.choices(words, k=size)
        for _ in range(14):
            t = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t[rng.randint(0, 1) :]))
    return texts


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (2, 70)])
def test_components_equal_brute_force(spark, n, percent):
    texts = near_fixture()
    out = parityjoin.near_duplicates(docs(spark, list(enumerate(texts))), n, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(texts, n, percent)


def test_numbers_of_blocks_are_found_at_once_at_every_threshold():
    for percent in (1, 20, 50, 60, 65, 70, 80, 90, 99, 100):
        bands = parityjoin.Bands(percent)
        for size in (1, 7, 60, 1000, 200_000):
            width, spare = bands.widths(int(bands.of(np.array([size]))[0]))
            assert width >= 1 and -1 <= spare < width


@pytest.mark.parametrize("n,percent", [(2, 50), (3, 60)])
def test_components_at_low_thresholds(spark, n, percent):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    texts = near_fixture()[:40]
    for _ in range(4):
        base = rng.choices(words, k=1000)
        for share in (0.02, 0.08, 0.11, 0.14, 0.2, 0.4):
            texts.append(" ".join(rng.choice(words) if rng.random() < share else w for w in base))
    out = parityjoin.near_duplicates(docs(spark, list(enumerate(texts))), n, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(texts, n, percent)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_components_among_shared_passages_one_long_text_and_clashing_names(spark, n, percent):
    rng = random.Random(7)
    words = [f"v{i}" for i in range(20_000)]
    passages = [rng.choices(words, k=90) for _ in range(3)]
    texts = ["huge " * 5 + " ".join(f"h{i}" for i in range(150_000))]
    for k in range(240):
        text = rng.choices(words, k=rng.randint(20, 60))
        for p in rng.sample(passages, rng.randint(1, 3)):
            at = rng.randint(0, len(text))
            text = text[:at] + p + text[at:]
        texts.append(" ".join(text))
        while rng.random() < 0.3:  # chains of near copies
            text = [rng.choice(words) if rng.random() < 0.015 else w for w in text]
            texts.append(" ".join(text))
    rows = [(i, t, i, "x", [1]) for i, t in enumerate(texts)]
    df = docs(spark, rows, "doc_id long, text string, id long, label string, set array<int>")
    out = parityjoin.near_duplicates(df, n, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(texts, n, percent)


def test_sketch_distance_is_below_symmetric_difference():
    rng = np.random.default_rng(0)
    bands = parityjoin.Bands(90)
    for size in (5, 40, 300):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[3:], rng.integers(0, 1 << 63, 2, dtype=np.uint64)]))
        names = []
        for s in (a, b):
            band = bands.of(np.array([len(a)]))[0]
            below = bands.of(np.array([len(s)]))[0] - band
            if below not in (0, 1):
                break
            names.append(parityjoin.sketches(np.zeros(len(s), np.int64), s, np.array([len(s)]), bands, int(below))[1])
        if len(names) == 2:
            assert (names[0] != names[1]).sum() <= len(np.setxor1d(a, b))


def test_keep_one(spark):
    texts = near_fixture()
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, texts[9]), (None, texts[9]), (None, "all alone in this world of words")]
    kept = parityjoin.keep_one(docs(spark, rows)).collect()
    want = brute_components(texts, 5, 80)
    assert Counter(r["doc_id"] for r in kept) == Counter([i for i, (n, c) in want.items() if c == i] + [None])
    assert parityjoin.keep_one(docs(spark, [])).count() == 0


def test_shingles_of_short_texts():
    owner, gram = parityjoin.shingles(Block([b"", b"a", b"a b", b"a b c", b"a b c a b c"]), 3)
    assert np.bincount(owner, minlength=5).tolist() == [0, 1, 1, 1, 3] and len(np.unique(gram)) == 5


def test_copies_do_not_eat_the_dictionary_sample(spark):
    from tessera.llm import language

    rows = [(f"rare text number {i} of many", "aa") for i in range(400)] + [("one copied text of the rare language", "aa")] * 20_000
    got = language.dictionaries(spark.createDataFrame(rows, "text string, lang string"), docs_per_lang=100)
    assert got["aa"].count(b"rare text number") >= 95
