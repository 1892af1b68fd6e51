"""Word and sentence vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vec as V
from ..sources.workspace import Workspace
from . import corpus, similar


def hash_vector(word: Column, dim: int = 64) -> Column:
    """A normal vector from the word's digest."""
    return V.digest_vector(word, dim)


def generator_vectors(words: DataFrame, dim: int = 64, col: str = "word") -> DataFrame:
    """word, vec drawn from numpy's generator seeded by the word's md5; for parity with vectors made that way."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for df in batches:
            seeds = [int(hashlib.md5(w.encode()).hexdigest(), 16) % (1 << 32) for w in df[col]]
            yield pd.DataFrame({"word": df[col], "vec": [np.random.default_rng(s).normal(size=dim) for s in seeds]})

    return words.select(col).distinct().mapInPandas(run, "word string, vec array<double>")


def matrix_layout(table: DataFrame, key: str, value: str) -> DataFrame:
    """word, idx, vec from any table of names and vectors, indexed in order of name."""
    rows = table.select(F.col(key).cast("string").alias("word"), F.transform(value, lambda x: x.cast("double")).alias("vec"))
    return corpus.numbered(rows, ["word"], "idx", Workspace(table.sparkSession, "layout"))


def sentence_mean(toks: DataFrame, words: DataFrame, id_col: str = "doc_id", dim: int | None = None) -> DataFrame:
    """id, dim, x: mean over all tokens; a token without a vector counts as zeros, a text without any vector has no rows.

    Tokens are counted by sentence and word first, so a frequent word costs one row for each sentence. These rows are summed
    in one aggregation with a sum for each dimension; only the means are exploded. dim: of the vectors, looked up if None.
    """
    counts = toks.groupBy(id_col, "tok").agg(F.count(F.lit(1)).alias("c"))
    dim = dim if dim is not None else words.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0]
    held = counts.join(words.select(F.col("word").alias("tok"), "vec"), "tok", "left").withColumn("_any", F.col("vec").isNotNull())
    parts = (F.sum(F.col("c") * F.get("vec", F.lit(i))).alias(f"_{i}") for i in range(dim))
    sums = held.groupBy(id_col).agg(F.sum("c").alias("n"), F.max("_any").alias("_any"), *parts).where("_any")
    means = sums.select(id_col, F.array(*(F.col(f"_{i}") / F.col("n") for i in range(dim))).alias("means"))
    return means.select(id_col, F.posexplode("means").alias("dim", "x")).where("x is not null")


def vector_sums(rows: DataFrame, by: list[str], vec: str, weight: str, dim: int) -> DataFrame:
    """by, n (sum of the weights) and sums (of the weighted vectors): one aggregation with a sum for each dimension, so no
    row is multiplied by the dimension and every task adds up its own rows first."""
    w = F.col(weight)
    sums = rows.groupBy(*by).agg(F.sum(w).alias("n"), *(F.sum(w * F.get(F.col(vec), F.lit(i))).alias(f"_{i}") for i in range(dim)))
    return sums.select(*by, "n", F.array(*(F.col(f"_{i}") for i in range(dim))).alias("sums"))


def text_vectors(toks: DataFrame, words: DataFrame, id_col: str, dim: int) -> DataFrame:
    """id, vec: mean over a text's tokens as an array; a token without a vector counts as zeros."""
    counts = toks.groupBy(id_col, "tok").agg(F.count(F.lit(1)).alias("c"))
    held = counts.join(words.select(F.col("word").alias("tok"), "vec"), "tok", "left")
    zero = F.array(*(F.lit(0.0) for _ in range(dim)))
    means = vector_sums(held.withColumn("vec", F.coalesce("vec", zero)), [id_col], "vec", "c", dim)
    return means.select(id_col, F.transform("sums", lambda x: x / F.col("n")).alias("vec"))


#: Words whose vectors a task keeps.
KEPT_WORDS = 1 << 18


def hash_means(lists: DataFrame, id_col: str, dim: int) -> DataFrame:
    """id, vec: mean of the `hash_vector`s of a text's tokens (id, t). A text without tokens has no row. A vector is made of its word
    alone, so every task makes those of its own words, keeps them, and shuffles nothing."""
    from . import search

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        index: dict[str, int] = {}
        held = np.empty((0, dim))
        for ids, n, distinct, row, word, count in search.token_counts(batches):
            words = distinct.to_pylist()
            if len(index) > KEPT_WORDS:
                index, held = {}, np.empty((0, dim))
            new = [w for w in words if w not in index]
            digests = b"".join(md5(f"{w}:{i}".encode()).digest()[:8] for w in new for i in range(dim))
            u = (np.frombuffer(digests, ">u4").astype(float).reshape(len(new), dim, 2) + 1) / 4294967297.0
            index.update(zip(new, range(len(held), len(held) + len(new)), strict=True))
            held = np.concatenate([held, np.sqrt(-2 * np.log(u[..., 0])) * np.cos(2 * np.pi * u[..., 1])])
            vecs = held[[index[w] for w in words]] if words else held[:0]
            sums = np.stack([np.bincount(row, count * vecs[word, i], minlength=len(n)).astype(float) for i in range(dim)], axis=1)[n > 0] / n[n > 0, None]
            at = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(n > 0)), pa.ListArray.from_arrays(at, pa.array(sums.reshape(-1)))], names=[id_col, "vec"])

    return lists.select(id_col, "t").mapInArrow(run, f"`{id_col}` {lists.schema[id_col].dataType.simpleString()}, vec array<double>")


def zscored(vectors: DataFrame, id_col: str, vec: str = "vec") -> DataFrame:
    """Vectors less the mean over the deviation of each dimension; the two rows of moments are broadcast, nothing is exploded and regrouped by vector."""
    by = vectors.select(F.posexplode(vec).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    one = by.agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("moments"))
    return vectors.crossJoin(F.broadcast(one)).select(id_col, F.zip_with(vec, "moments", lambda x, m: (x - m.m) / (m.s + 1e-8)).alias("vec"))  # one row


def nearest(words: DataFrame, table: DataFrame, k: int = 5) -> DataFrame:
    """word, other, sim: the k most similar other words of table for each of words, by blocked matrix products."""
    return similar.top(words, table, k)


def cold_start(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, known: new words and how many of the known tokens that stand in their sentences would shape their first vector."""
    toks = docs.select(id_col, F.explode(T.tokenize(F.col(text_col))).alias("word"))
    have = words.select("word").distinct()
    known = toks.join(have, "word", "left_semi").groupBy(id_col).agg(F.count(F.lit(1)).alias("k"))
    new = toks.join(have, "word", "left_anti").distinct()
    return new.join(known, id_col, "left").groupBy("word").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("known"))


#: Centers whose pairs are updated together, at most; a longer sentence takes several steps, one after the other.
STEP = 16
#: Tokens whose negative words are drawn at once.
DRAWN = 1 << 13
#: Most tasks that blocks are dealt to in an epoch.
TASKS = 1 << 13


class _Draws:
    """Words drawn by their shares (alias table): two lookups a draw, whatever the vocabulary."""

    def __init__(self, cdf: np.ndarray):
        n = len(cdf)
        share = np.diff(cdf, prepend=0.0) * n
        self.keep, self.other = np.ones(n), np.arange(n)
        rest = share.tolist()
        small, large = np.flatnonzero(share < 1).tolist(), np.flatnonzero(share >= 1).tolist()
        while small and large:
            i, j = small.pop(), large[-1]
            self.keep[i], self.other[i] = rest[i], j
            rest[j] -= 1 - rest[i]
            if rest[j] < 1:
                small.append(large.pop())

    def take(self, rng: np.random.Generator, n: int) -> np.ndarray:
        u = rng.random(n) * len(self.keep)
        i = np.minimum(u.astype(np.int64), len(self.keep) - 1)
        return np.where(u - i < self.keep[i], i, self.other[i])


@lru_cache(maxsize=1 << 12)
def _pattern(left: int, n: int, right: int, window: int, negative: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of n centers with `left` and `right` words beside them: their number, each pair's center, and each term's target
    and center. Targets are the pairs' negative words and then the words that stand there."""
    around = np.array([d for d in range(-window, window + 1) if d])
    j = np.arange(left, left + n)[:, None] + around
    inside = (j >= 0) & (j < left + n + right)
    center = np.nonzero(inside)[0]
    drawn = len(center) * negative
    return len(center), center, np.concatenate([j[inside] + drawn, np.arange(drawn)]), np.concatenate([center, np.repeat(center, negative)])


def _train(ids: list[np.ndarray], w_in: np.ndarray, w_out: np.ndarray, cdf: np.ndarray, rng: np.random.Generator, window: int, negative: int, lr: float) -> None:
    """One pass over the sentences (word numbers) in random order; the matrices are changed in place.

    A step takes the pairs of up to `STEP` neighbouring centers of a sentence. All gradients of a step come from the vectors before
    it and are added up by word: terms are counted by (target, center), and the sums are two small matrix products with these
    counts, so no row is made for a term. A word's sum is bounded by the number of its pairs (terms, as a target).
    """
    draws, place = _Draws(cdf), np.empty(len(cdf), np.int64)
    steps: list[tuple] = []
    waiting, upto, kind = 0, np.arange((STEP + 2 * window) * (1 + 2 * window * negative)), w_in.dtype

    def flush() -> None:
        words, done = draws.take(rng, waiting * negative), 0
        for s, left, n, right in steps:
            pairs, center, term_target, term_center = _pattern(left, n, right, window, negative)
            drawn = pairs * negative
            own, target = s[left : left + n], np.concatenate([words[done : done + drawn], s])
            done += drawn
            # a word that stands there several times is counted in its last place; others get no gradient, and the last place is written last
            place[own] = upto[:n]
            row = place[own]
            place[target] = upto[: len(target)]
            column = place[target]
            column *= n
            at = column[term_target]
            at += row[term_center]
            count = np.bincount(at, minlength=n * len(target)).astype(kind).reshape(-1, n)
            v, u = w_in.take(own, axis=0), w_out.take(target, axis=0)
            g = u @ v.T
            np.negative(g, out=g)
            with np.errstate(over="ignore"):  # a share of 0
                np.exp(g, out=g)
            g += 1
            np.divide(count, g, out=g)
            g[drawn:] -= np.bincount(at[:pairs] - drawn * n, minlength=len(s) * n).reshape(-1, n)
            d_in, d_out = g.T @ u, g @ v
            most = np.bincount(row[center], minlength=n).astype(kind)[:, None]
            np.clip(d_in, -most, most, out=d_in)
            if max(v.max(), -v.min()) > 1:  # no sum exceeds the number of its terms otherwise
                most = count.sum(1)[:, None]
                np.clip(d_out, -most, most, out=d_out)
            d_in *= lr
            d_out *= lr
            v -= d_in
            u -= d_out
            w_in[own], w_out[target] = v, u
        steps.clear()

    for s in (ids[i] for i in rng.permutation(len(ids))):
        if len(s) < 2:
            continue
        parts = -(-len(s) // STEP)
        cuts = [len(s) * k // parts for k in range(parts + 1)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            left, right = min(window, lo), min(window, len(s) - hi)
            steps.append((s[lo - left : hi + right], left, hi - lo, right))
            waiting += _pattern(left, hi - lo, right, window, negative)[0]
        if waiting >= DRAWN * window:
            flush()
            waiting = 0
    flush()


def _means(rows: DataFrame, group: str, vecs: list[str]) -> DataFrame:
    """group, word and the means of the vectors of rows (group, word, n, vecs), weighted by n.

    Rows are sorted by word within their partition and added up as they pass, so a task holds a batch and one word's sums.
    """
    kinds = f"{group} string, word string, " + ", ".join(f"{v} array<float>" for v in vecs)

    def out(keys: list, n: np.ndarray, sums: list[np.ndarray]) -> pa.RecordBatch:
        means = [(x / n[:, None]).astype(np.float32) for x in sums]
        lists = [pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.reshape(-1))) for x in means]
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)] + lists, names=[group, "word", *vecs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # key, n and sums of the word that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(i) for i in (0, 1)]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.logical_or(*(pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in names))
            at = np.flatnonzero(new)
            keys = list(zip(*(c.take(pa.array(at)).to_pylist() for c in names), strict=True))
            weight = batch.column(2).to_numpy().astype(float)
            n = np.add.reduceat(weight, at)
            sums = [np.add.reduceat(similar._matrix(batch.column(3 + i)) * weight[:, None], at, axis=0) for i in range(len(vecs))]
            if held is not None and held[0] == keys[0]:
                n[0] += held[1]
                for x, y in zip(sums, held[2], strict=True):
                    x[0] += y
            elif held is not None:
                yield out([held[0]], np.array([held[1]]), [y[None] for y in held[2]])
            held = keys[-1], n[-1], [x[-1] for x in sums]
            if len(keys) > 1:
                yield out(keys[:-1], n[:-1], [x[:-1] for x in sums])
        if held is not None:
            yield out([held[0]], np.array([held[1]]), [y[None] for y in held[2]])

    return rows.repartition(group, "word").sortWithinPartitions(group, "word").mapInArrow(run, kinds)


def skip_gram_blocks(sentences: DataFrame, ws: Workspace, dim: int = 32, window: int = 4, negative: int = 5, epochs: int = 2, lr: float = 0.05, min_count: int = 2, seed: int = 0, group: str = "grp", block_tokens: int = 1 << 18) -> DataFrame:
    """group, word, vec: skip-gram with negative sampling by parameter averaging, unit rows.

    A group's sentences (group, seq, text) are dealt into blocks of about `block_tokens` tokens. In each epoch a block trains all
    its sentences in a task of its own, on the vectors of its own words; then a word's vectors are averaged over the
    blocks that have it, weighted by its count there, and the next epoch starts from the averages. Every sentence and every word
    of `min_count` occurrences is trained; groups of under ten such words have no rows. Words start from their hashes.
    """
    toks = sentences.select(group, "seq", T.tokenize(F.col("text")).alias("toks")).where(F.size("toks") > 0)
    toks = ws.stage(toks, "tokens")
    sizes = ws.stage(toks.groupBy(group).agg(F.ceil(F.sum(F.size("toks")) / block_tokens).alias("blocks")), "sizes")
    # blocks are small in bytes and long in work: by bytes many of them would be one task
    tasks = max(1, min(TASKS, 3 * int(sizes.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0])))
    block = F.pmod(F.xxhash64("seq", F.lit(seed)), F.col("blocks")).alias("block")
    toks = toks.join(F.broadcast(sizes), group).select(group, block, "seq", "toks")  # a row for each group
    uses = ws.stage(toks.select(group, "block", F.explode("toks").alias("word")).groupBy(group, "block", "word").agg(F.count(F.lit(1)).alias("n")), "uses")
    vocab = uses.groupBy(group, "word").agg(F.sum("n").alias("c")).where(F.col("c") >= min_count)
    rich = vocab.groupBy(group).agg(F.count(F.lit(1)).alias("words")).where("words >= 10").select(group)
    vocab = ws.stage(vocab.join(F.broadcast(rich), group), "vocab")  # a row for each group
    uniform = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: ((F.pmod(F.xxhash64("word", i, F.lit(seed)), F.lit(1 << 24)) / float(1 << 24) - 0.5) / dim).cast("float"))
    now = vocab.select(group, "word", "c", uniform.alias("vin"), F.array_repeat(F.lit(0.0).cast("float"), dim).alias("vout"))
    kinds = f"{group} string, word string, n long, vin array<float>, vout array<float>"

    def trainer(epoch: int):
        def run(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
            if words.empty or texts.empty:
                return pd.DataFrame({group: pd.Series(dtype=str), "word": pd.Series(dtype=str), "n": pd.Series(dtype="int64"), "vin": pd.Series(dtype=object), "vout": pd.Series(dtype=object)})
            words, texts = words.sort_values(["c", "word"], ascending=[False, True]), texts.sort_values("seq")
            index = {w: i for i, w in enumerate(words["word"])}
            ids = [np.array([index[w] for w in t if w in index]) for t in texts["toks"]]
            w_in, w_out = np.stack(words["vin"].to_list()).astype(np.float32), np.stack(words["vout"].to_list()).astype(np.float32)
            cdf = np.cumsum(words["c"].to_numpy(float) ** 0.75)
            cdf /= cdf[-1]
            _train(ids, w_in, w_out, cdf, np.random.default_rng([seed, epoch, int(texts["block"].iloc[0])]), window, negative, lr)
            return pd.DataFrame({group: texts[group].iloc[0], "word": words["word"].to_numpy(), "n": words["n"].to_numpy(), "vin": list(w_in), "vout": list(w_out)})

        return run

    for epoch in range(epochs):
        own = uses.join(now, [group, "word"]).select(group, "block", "word", "n", "c", "vin", "vout")
        texts, own = (x.repartition(tasks, group, "block").groupBy(group, "block") for x in (toks, own))
        blocks = texts.cogroup(own).applyInPandas(trainer(epoch), kinds)
        both = ["vin", "vout"] if epoch + 1 < epochs else ["vin"]
        means = _means(blocks.select(group, "word", "n", *both), group, both)
        now = ws.stage(means.join(vocab, [group, "word"]), f"epoch-{epoch}") if epoch + 1 < epochs else means
    return now.select(group, "word", V.unit(F.transform("vin", lambda x: x.cast("double"))).alias("vec"))


def skip_gram(sentences: DataFrame, dim: int = 32, window: int = 4, negative: int = 5, epochs: int = 2, lr: float = 0.05, min_count: int = 2, seed: int = 0, group: str = "grp") -> DataFrame:
    """group, word, vec: skip-gram with negative sampling, unit rows. Each step reads the one before, so a group is one task; groups train side by side.

    sentences: group, seq, text. Batches of pairs are updated together within a sentence.
    """
    toks = sentences.select(group, "seq", T.tokenize(F.col("text")).alias("toks"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        from collections import Counter

        df = df.sort_values("seq")
        lists = [list(t) for t in df["toks"]]
        count = Counter(w for t in lists for w in t)
        vocab = [w for w, c in sorted(count.items(), key=lambda x: (-x[1], x[0])) if c >= min_count]
        out = pd.DataFrame({group: pd.Series(dtype=str), "word": pd.Series(dtype=str), "vec": pd.Series(dtype=object)})
        if len(vocab) < 10:
            return out
        index = {w: i for i, w in enumerate(vocab)}
        rng = np.random.default_rng(seed)
        p = np.array([count[w] for w in vocab], float) ** 0.75
        cdf = np.cumsum(p / p.sum())
        cdf /= cdf[-1]
        w_in, w_out = rng.uniform(-0.5, 0.5, (len(vocab), dim)) / dim, np.zeros((len(vocab), dim))
        ids = [np.array([index[w] for w in t if w in index]) for t in lists]
        for _ in range(epochs):
            _train(ids, w_in, w_out, cdf, rng, window, negative, lr)
        w_in /= np.linalg.norm(w_in, axis=1, keepdims=True) + 1e-8
        return pd.DataFrame({group: df[group].iloc[0], "word": vocab, "vec": list(w_in)})

    return toks.groupBy(group).applyInPandas(run, f"{group} string, word string, vec array<double>")
