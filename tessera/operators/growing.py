"""A word embedding that grows with the corpus: known words are kept, new ones start from the words around them.

A vocabulary is a table (word, vec, ctx, freq, is_seed, version). Seed words are loaded once and learn slowly; words met
later learn faster. A new word's first vector is the mean over the known words that stand in its sentences, each counted
as often as it stands there; sentences are summed first and the sums of a word's sentences added up, in two
aggregations with a column for each dimension. A word without any known word around it starts from small numbers made of its hash.

Training is skip-gram with negative sampling in batches: gradients of all pairs are computed from the vocabulary of the
round before, added up by word, divided by the word's number of terms and applied at the word's own rate. `grow` numbers the
words once, those first that negative words are drawn from or that are frequent. The vectors of these are sent to every task, which adds up
the gradients of its pairs by word; only pairs with a rarer word are shuffled to meet its vector. A repeated run gives the same vectors.

A growth is a version: the rows that changed. `merge` takes the newest row of each word. Null and empty texts have no
words; a sentence of one word trains nothing and doesn't count towards frequencies; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T
from ..functions import vec as V
from ..sources.workspace import Workspace
from .corpus import numbered
from .guard import frequent, with_counts

# Learning rates of seed words and of others, spread of a new word's noise, share of the context vectors
SEED_RATE, NEW_RATE, NOISE, CONTEXT_SHARE = 0.01, 0.05, 0.01, 0.1
#: Words whose vectors are broadcast in a round or for first vectors, the most frequent ones.
HOT_WORDS = 50_000
COLUMNS = ["word", "vec", "ctx", "freq", "is_seed", "version"]


def _normal(word: Column, i: Column, salt: int) -> Column:
    """A normal number made of a word and a place (Box-Muller on two hashes)."""
    u = [(F.pmod(F.xxhash64(word, i, F.lit(salt), F.lit(j)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1) for j in (0, 1)]
    return F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * 3.141592653589793 * u[1])


def _uniform(word: Column, i: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(word, i, F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)


def seeded(words: DataFrame) -> DataFrame:
    """The vocabulary of seed words (word, vec), version 0."""
    vec = F.transform("vec", lambda x: x.cast("double"))
    return words.select("word", vec.alias("vec"), F.transform("vec", lambda x: x.cast("double") * CONTEXT_SHARE).alias("ctx"), F.lit(1.0).alias("freq"), F.lit(True).alias("is_seed"), F.lit(0).alias("version"))


def rate(is_seed: Column) -> Column:
    """Learning rate of a word."""
    return F.when(is_seed, SEED_RATE).otherwise(NEW_RATE)


def first_vectors(toks: DataFrame, vocab: DataFrame, id_col: str, dim: int) -> DataFrame:
    """word, n, vec of the words of toks (id, tok) that vocab lacks: how many known tokens stand in their sentences, and
    the mean of these tokens' vectors (null where n is 0).

    Frequent words are broadcast with their vectors (`HOT_WORDS`, known or not): they are summed, or listed as new, within the
    text's own task, which hands on a row for each text. Only the other words are shuffled, to meet the vocabulary and then
    their text. The list of a text's new words is exploded beside its sums: sentences are not joined with their own words again.
    """
    ws = Workspace(toks.sparkSession, "first-vectors")
    known = vocab.select(F.col("word").alias("tok"), "vec", F.lit(True).alias("_known"))
    words = ws.stage(toks.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).join(known, "tok", "left").withColumnRenamed("c", "all"), "words")
    edge = frequent(words.select(F.col("all").alias("c")), HOT_WORDS)
    hot = F.broadcast(words.where(F.col("all") >= edge).drop("all"))
    named = F.col(id_col).isNotNull()  # without an id no words stand together
    sums = [F.sum(F.when(named, F.col("c") * F.get("vec", F.lit(i)))).alias(f"_{i}") for i in range(dim)]
    n = F.coalesce(F.sum(F.when(F.col("_known") & named, F.col("c"))), F.lit(0)).alias("n")
    new = F.when(F.col("_known").isNull(), F.col("tok"))
    near = toks.select(id_col, "tok").join(hot, "tok").withColumn("c", F.lit(1)).groupBy(id_col).agg(n, *sums, F.collect_set(new).alias("new"))
    counts = toks.join(hot.select("tok"), "tok", "left_anti").groupBy(id_col, "tok").agg(F.count(F.lit(1)).alias("c"))
    far = counts.join(words.where(F.col("all") < edge).drop("all"), "tok").groupBy(id_col).agg(n, *sums, F.collect_list(new).alias("new"))
    every = near.unionByName(far).groupBy(id_col)
    by_text = every.agg(F.sum("n").alias("n"), *(F.sum(f"_{i}").alias(f"_{i}") for i in range(dim)), F.flatten(F.collect_list("new")).alias("new"))
    around = by_text.select("n", *(f"_{i}" for i in range(dim)), F.explode("new").alias("tok"))
    total = around.groupBy(F.col("tok").alias("word")).agg(F.sum("n").alias("n"), *(F.sum(f"_{i}").alias(f"_{i}") for i in range(dim)))
    means = F.array(*(F.try_divide(f"_{i}", "n") for i in range(dim)))
    return total.select("word", "n", F.when(F.col("n") > 0, means).alias("vec"))


def grown(docs: DataFrame, vocab: DataFrame, id_col: str, dim: int, noise: float = NOISE, seed: int = 0, text_col: str = "text") -> DataFrame:
    """The rows of the next version: the new words of docs (id, text), and the known words with their new frequencies."""
    docs = docs.where(F.col(id_col).isNotNull())
    toks = docs.select(F.col(id_col), T.tokenize(F.col(text_col)).alias("t")).select(id_col, F.explode("t").alias("tok"))
    version = vocab.agg(F.coalesce(F.max("version") + 1, F.lit(0)).cast("int").alias("next"))
    start = first_vectors(toks, vocab, id_col, dim)
    zero = F.sequence(F.lit(0), F.lit(dim - 1))
    chance = F.transform(zero, lambda i: (_uniform(F.col("word"), i, seed) - 0.5) / dim)
    first = F.transform(F.col("vec"), lambda x, i: x + _normal(F.col("word"), i, seed) * noise)
    new = start.select("word", F.coalesce(first, chance).alias("vec"), F.transform(zero, lambda i: F.lit(0.0)).alias("ctx"), F.lit(0.0).alias("freq"), F.lit(False).alias("is_seed"))
    # all tokens less those that are their sentence's only one, which is a row for each sentence
    size = docs.select(F.col(id_col), T.tokenize(F.col(text_col)).alias("t")).groupBy(id_col).agg(F.sum(F.size("t")).alias("size"), F.max(F.get("t", F.lit(0))).alias("word"))
    alone = size.where("size = 1").groupBy("word").agg(F.count(F.lit(1)).alias("less"))
    seen = toks.groupBy(F.col("tok").alias("word")).agg(F.count(F.lit(1)).alias("all")).join(alone, "word", "left")
    seen = seen.select("word", (F.col("all") - F.coalesce("less", F.lit(0))).alias("more")).where("more > 0")
    old = vocab.select("word", "vec", "ctx", "freq", "is_seed").join(seen.select("word"), "word", "left_semi")
    rows = new.unionByName(old).join(seen, "word", "left").withColumn("freq", F.col("freq") + F.coalesce("more", F.lit(0))).drop("more")
    return rows.crossJoin(F.broadcast(version)).select("word", "vec", "ctx", "freq", "is_seed", F.col("next").alias("version"))  # one row


def merge(*versions: DataFrame) -> DataFrame:
    """One vocabulary: of each word the row of the newest version."""
    every = versions[0].select(*COLUMNS)
    for v in versions[1:]:
        every = every.unionByName(v.select(*COLUMNS))
    newest = every.groupBy("word").agg(F.max_by(F.struct("vec", "ctx", "freq", "is_seed", "version"), "version").alias("r"))
    return newest.select("word", "r.*")


def pairs(docs: DataFrame, id_col: str, window: int = 3, seed: int = 0, text_col: str = "text") -> DataFrame:
    """center, other, n: the words around each word, within 1 to `window` places as a hash of text and place says."""
    # the text beside itself, moved by each distance: a place's row holds its few neighbours, never the whole text
    t = F.col("t")
    far = [d for d in range(1, window + 1)]
    after = [F.slice(t, d + 1, F.size(t)).alias(f"r{d}") for d in far]
    before = [F.concat(F.array_repeat(F.lit(None).cast("string"), d), t).alias(f"l{d}") for d in far]
    moved = docs.select(F.col(id_col), T.tokenize(F.col(text_col)).alias("t")).where(F.size("t") >= 2).select(id_col, t.alias("center"), *after, *before)
    zipped = F.arrays_zip("center", *(f"{s}{d}" for s in "rl" for d in far))
    at = moved.select(id_col, F.posexplode(zipped).alias("place", "z")).where("z.center is not null")
    reach = F.pmod(F.xxhash64(F.col(id_col), F.col("place"), F.lit(seed)), F.lit(window)) + 1
    at = at.select("z.*", reach.alias("reach"))
    others = F.array(*(F.when(F.col("reach") >= d, F.col(f"{s}{d}")) for s in "rl" for d in far))
    return at.select("center", F.explode(others).alias("other")).where("other is not null").groupBy("center", "other").agg(F.count(F.lit(1)).alias("n"))


def slot_words(vocab: DataFrame, ws: Workspace, seed: int = 0, slots: int = 1 << 14) -> DataFrame:
    """slot, drawn: a table of `slots` places, to which each word has a share by its frequency to the power 0.75, written.

    Words own the places between their rounded cumulative shares, in order of a hash. A word with less than a place is met by
    chance of the rounding.
    """
    from pyspark.sql import Window

    mass = vocab.where("freq > 0").select("word", F.pow("freq", F.lit(0.75)).alias("m"), F.xxhash64("word", F.lit(seed)).alias("h"))
    # Cumulative sums in two levels, so no task sees more than a part of the words.
    mass = ws.stage(mass.withColumn("part", F.shiftrightunsigned("h", 54)), f"mass-{seed}")
    parts = mass.groupBy("part").agg(F.sum("m").alias("pm"))  # 1,024 rows at most
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("pm").over(before), F.lit(0.0)).alias("base"), F.sum("pm").over(Window.partitionBy(F.lit(0))).alias("total"))
    run = F.sum("m").over(Window.partitionBy("part").orderBy("h", "word").rowsBetween(Window.unboundedPreceding, 0))
    cum = mass.withColumn("run", run).join(F.broadcast(parts), "part")
    lo = F.floor((F.col("base") + F.col("run") - F.col("m")) / F.col("total") * slots + F.pmod("h", F.lit(997)) / 997.0)
    hi = F.floor((F.col("base") + F.col("run")) / F.col("total") * slots + F.pmod("h", F.lit(997)) / 997.0)
    table = cum.where(hi > lo).select(F.explode(F.sequence(lo, hi - 1)).alias("slot"), F.col("word").alias("drawn"))
    return ws.stage(table.groupBy(F.pmod("slot", F.lit(slots)).alias("slot")).agg(F.min("drawn").alias("drawn")), f"slots-{seed}")


def _slots(number: int, seed: int, slots: int) -> Column:
    """The places that a pair's negative words are drawn from."""
    return F.transform(F.sequence(F.lit(1), F.lit(number)), lambda k: F.pmod(F.xxhash64(F.col("center"), F.col("other"), k, F.lit(seed)), F.lit(slots)))


def negatives(pairs: DataFrame, vocab: DataFrame, ws: Workspace, number: int = 5, seed: int = 0, slots: int = 1 << 14) -> DataFrame:
    """center, other, n, label: the pairs (label 1) and, for each, `number` words drawn by frequency to the power 0.75 (label 0)."""
    table = slot_words(vocab, ws, seed, slots)
    slot = F.explode(_slots(number, seed, slots)).alias("slot")
    drawn = pairs.select("center", "n", slot).join(F.broadcast(table), "slot").select("center", F.col("drawn").alias("other"), "n")  # `slots` rows at most
    return pairs.select("center", "other", "n", F.lit(1.0).alias("label")).unionByName(drawn.groupBy("center", "other").agg(F.sum("n").alias("n")).withColumn("label", F.lit(0.0)))


def train_round(terms: DataFrame, vocab: DataFrame, dim: int, edge: float | None = None) -> DataFrame:
    """The vocabulary after one round over the terms (center, other, n, label). Words of a frequency of `edge` or more are
    broadcast, so of the terms only those with a rarer word are shuffled to it; every term is in one of the four parts."""
    words = vocab.select("word", "vec", "ctx", "freq")
    often = F.lit(False) if edge is None else F.col("freq") >= edge
    parts = []
    for hot in ((True, True), (True, False), (False, True), (False, False)) if edge is not None else ((False, False),):
        t = terms
        for side, is_hot in zip(("center", "other"), hot, strict=True):
            if not is_hot and edge is not None:
                t = t.join(F.broadcast(words.where(often).select(F.col("word").alias(side))), side, "left_anti")  # HOT_WORDS rows at most
        for side, name, short, is_hot in (("center", "vec", "v", hot[0]), ("other", "ctx", "u", hot[1])):
            own = words.where(often if is_hot else ~often).select(F.col("word").alias(side), F.col(name).alias(short))
            t = t.join(F.broadcast(own) if is_hot else own, side)
        parts.append(t.select("center", "other", "n", "label", "v", "u"))
    t = parts[0]
    for p in parts[1:]:
        t = t.unionByName(p)
    dot = sum((F.get("u", F.lit(i)) * F.get("v", F.lit(i)) for i in range(1, dim)), F.get("u", F.lit(0)) * F.get("v", F.lit(0)))
    g = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), dot)))) - F.col("label")
    # a term moves its center by u and its other word by v: both in one pass over the joined terms
    both = F.array(F.struct(F.col("center").alias("word"), F.lit(True).alias("into"), F.col("u").alias("x")), F.struct(F.col("other").alias("word"), F.lit(False).alias("into"), F.col("v").alias("x")))
    moves = t.withColumn("g", g * F.col("n")).select("n", "g", F.inline(both)).groupBy("word", "into")
    sums = moves.agg(F.sum("n").alias("k"), *(F.sum(F.col("g") * F.get("x", F.lit(i))).alias(f"_{i}") for i in range(dim)))
    sums = sums.select("word", "into", F.array(*(F.col(f"_{i}") / F.col("k") for i in range(dim))).alias("d"))
    steps = sums.groupBy("word").agg(F.max(F.when(F.col("into"), F.col("d"))).alias("dv"), F.max(F.when(~F.col("into"), F.col("d"))).alias("du"))
    both = vocab.join(steps, "word", "left")
    r = rate(F.col("is_seed"))
    moved = [F.coalesce(F.zip_with(a, b, lambda x, d: x - r * d), F.col(a)).alias(a) for a, b in (("vec", "dv"), ("ctx", "du"))]
    return both.select("word", *moved, "freq", "is_seed", "version")


def _filled(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of numbers; a null or empty list is a row of NaN."""
    out = np.full((len(lists), dim), np.nan)
    out[np.asarray(lists.value_lengths().fill_null(0)) == dim] = np.asarray(lists.flatten(), float).reshape(-1, dim)
    return out


def _moves(rows: DataFrame, held, dim: int, number: int) -> DataFrame:
    """no, into, k, sums: number of terms and sum of the gradients of a word's vec (into) or ctx, from a task's part of rows
    (c, o, n, slots, v, u). v and u are the vectors of words that are not among those held; else empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec, ctx, drawn = held.value
        hot = len(vec)
        sums = np.zeros((2, dim + 1, hot))

        def out(numbers: np.ndarray, into: bool, k: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1, dtype=np.int32) * dim), pa.array(parts.reshape(-1)))
            return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.full(len(numbers), into)), pa.array(k), lists], names=["no", "into", "k", "sums"])

        for batch in batches:
            if not batch.num_rows:
                continue
            c, o, n = (batch.column(i).to_numpy() for i in range(3))
            target = np.concatenate([o[:, None], drawn[np.asarray(batch.column(3).flatten()).reshape(len(c), number)]], axis=1)
            v, u = (vec[np.where(c < hot, c, 0)], ctx[np.where((target >= 0) & (target < hot), target, 0)]) if hot else (np.zeros((len(c), dim)), np.zeros((*target.shape, dim)))
            v[c >= hot] = _filled(batch.column(4), dim)[c >= hot]
            u[o >= hot, 0] = _filled(batch.column(5), dim)[o >= hot]
            dot = np.einsum("mkd,md->mk", u, v)
            g = 1 / (1 + np.exp(-np.clip(dot, -30, 30)))
            g[:, 0] -= 1
            k = np.where(target >= 0, n[:, None], 0).astype(float)  # a place without a word draws nothing
            lost = np.isnan(dot)  # a vector is missing
            if lost.any():
                g[lost] = 0
                v, u = np.nan_to_num(v), np.nan_to_num(u)
            g *= k
            for into, numbers, moves, terms in (
                (0, c, np.einsum("mk,mkd->md", g, u), k.sum(1)),
                (1, target.reshape(-1), (g[..., None] * v[:, None, :]).reshape(-1, dim), k.reshape(-1)),
            ):
                near, far = (numbers >= 0) & (numbers < hot), numbers >= hot
                at = numbers[near]
                for i in range(dim):
                    np.add.at(sums[into, i], at, moves[near, i])
                np.add.at(sums[into, dim], at, terms[near])
                if far.any():
                    cold, at = np.unique(numbers[far], return_inverse=True)
                    parts = np.stack([np.bincount(at, moves[far, i]) for i in range(dim)], axis=1)
                    yield out(cold, not into, np.bincount(at, terms[far]), parts)
        for into in (0, 1):
            used = np.flatnonzero(sums[into, dim])
            yield out(used, not into, sums[into, dim, used], np.ascontiguousarray(sums[into, :dim, used]))

    return rows.select("c", "o", "n", "slots", "v", "u").mapInArrow(run, "no long, into boolean, k double, sums array<double>")


def _round(pairs: DataFrame, now: DataFrame, drawn: np.ndarray, hot: int, dim: int, number: int) -> DataFrame:
    """The vocabulary (no, word, vec, ctx, freq, is_seed, version) after one round over pairs (c, o, n, slots) of words by number.
    The vectors of the first `hot` words are sent to every task; a rarer word's is joined to its pairs."""
    top = now.where(F.col("no") < hot).select("no", "vec", "ctx").toArrow().combine_chunks()
    order = np.argsort(top["no"].to_numpy())
    held = now.sparkSession.sparkContext.broadcast((*(_filled(top[c].combine_chunks(), dim)[order] if len(order) else np.zeros((0, dim)) for c in ("vec", "ctx")), drawn))
    own = {x: now.where(F.col("no") >= hot).select(F.col("no").alias(x), F.col(y).alias(z)) for x, y, z in (("c", "vec", "v"), ("o", "ctx", "u"))}
    none = F.array().cast("array<double>")  # not null: Spark's writer to Python walks over all nulls before a row again
    rows = None
    for far_c in (False, True):
        for far_o in (False, True):
            part = pairs.where((F.col("c") >= hot) == F.lit(far_c)).where((F.col("o") >= hot) == F.lit(far_o))
            part = part.join(own["c"], "c") if far_c else part.withColumn("v", none)
            part = part.join(own["o"], "o") if far_o else part.withColumn("u", none)
            part = part.select("c", "o", "n", "slots", "v", "u")
            rows = part if rows is None else rows.unionByName(part)
    moves = _moves(rows, held, dim, number).groupBy("no", "into").agg(F.sum("k").alias("k"), *(F.sum(F.get("sums", F.lit(i))).alias(f"_{i}") for i in range(dim)))
    steps = moves.select("no", "into", F.array(*(F.col(f"_{i}") / F.col("k") for i in range(dim))).alias("d"))
    steps = steps.groupBy("no").agg(F.max(F.when(F.col("into"), F.col("d"))).alias("dv"), F.max(F.when(~F.col("into"), F.col("d"))).alias("du"))
    r = rate(F.col("is_seed"))
    moved = [F.coalesce(F.zip_with(a, b, lambda x, d: x - r * d), F.col(a)).alias(a) for a, b in (("vec", "dv"), ("ctx", "du"))]
    return now.join(steps, "no", "left").select("no", "word", *moved, "freq", "is_seed", "version")


def trained(pairs: DataFrame, vocab: DataFrame, ws: Workspace, dim: int, epochs: int, number: int = 5, seed: int = 0, slots: int = 1 << 14) -> DataFrame:
    """The vocabulary after `epochs` rounds over pairs (center, other, n) and their negative words: the same terms as of
    `negatives` in each `train_round`. Words are numbered, and a pair's negative words are kept as the places they are drawn from."""
    table = slot_words(vocab, ws, seed, slots)
    chosen = table.select(F.col("drawn").alias("word"), F.lit(True).alias("drawn")).distinct()
    ranked = vocab.join(F.broadcast(chosen), "word", "left").withColumn("drawn", F.coalesce("drawn", F.lit(False)))  # `slots` rows at most
    now = ws.stage(numbered(ranked, [F.desc("drawn"), F.desc("freq"), F.col("word")], "no", ws).drop("drawn"), "vocab-0")
    drawn, hot = np.full(slots, -1, np.int64), HOT_WORDS + chosen.count()
    for r in table.join(now.select(F.col("word").alias("drawn"), "no"), "drawn").select("slot", "no").collect():  # `slots` rows at most
        drawn[r["slot"]] = r["no"]
    # numbers of frequent words are broadcast, as counts are; a lower number is a higher count
    named = pairs.select(F.col("center").alias("w1"), F.col("other").alias("w2"), "n")
    named = with_counts(named, now.select(F.col("word").alias("tok"), (-F.col("no")).alias("c")), -(hot - 1))
    named = named.where("c1 is not null and c2 is not null").withColumnsRenamed({"w1": "center", "w2": "other"})
    named = ws.stage(named.select((-F.col("c1")).alias("c"), (-F.col("c2")).alias("o"), "n", _slots(number, seed, slots).alias("slots")), "terms")
    for epoch in range(epochs):
        now = ws.stage(_round(named, now, drawn, hot, dim, number), f"vocab-{epoch + 1}")
    return now.select("word", "vec", "ctx", "freq", "is_seed", "version")


def grow(docs: DataFrame, vocab: DataFrame, ws: Workspace, id_col: str, dim: int, epochs: int = 3, window: int = 3, number: int = 5, noise: float = NOISE, seed: int = 0) -> DataFrame:
    """The vocabulary after new texts: new words added, frequencies counted, `epochs` rounds trained. Every round is written."""
    vocab = ws.stage(vocab, "known")
    now = ws.stage(merge(vocab, ws.stage(grown(docs, vocab, id_col, dim, noise, seed), "grown")), "merged")
    near = ws.stage(pairs(docs, id_col, window, seed), "pairs")
    return trained(near, now, ws, dim, epochs, number, seed)


def encode(docs: DataFrame, vocab: DataFrame, id_col: str, dim: int, text_col: str = "text") -> DataFrame:
    """id, vec: unit mean of a text's words, unknown ones as zeros; zeros for a text without words."""
    from .embed import text_vectors

    toks = docs.select(F.col(id_col), F.explode(T.tokenize(F.col(text_col))).alias("tok"))
    zero = F.lit([0.0] * dim).cast(ST.ArrayType(ST.DoubleType()))
    vecs = text_vectors(toks, vocab.select("word", "vec"), id_col, dim)
    return docs.select(id_col).distinct().join(vecs, id_col, "left").select(id_col, V.unit(F.coalesce("vec", zero)).alias("vec"))


def save(vocab: DataFrame, path: str) -> None:
    """word, vec, is_seed, freq: vectors as 32-bit floats; a save replaces an earlier one."""
    vocab.select("word", F.transform("vec", lambda x: x.cast("float")).alias("vec"), "is_seed", "freq").write.mode("overwrite").parquet(path)
