"""A quality classifier learned from positives and unlabelled text.

Trusted positives and unlabelled web text train a logistic model on the non-negative unbiased risk: with class prior p,
p * (loss of positives as positive) + max(0, loss of unlabelled as negative - p * loss of positives as negative); where
the second part falls below zero, a step is taken against it instead. The prior is estimated from the labels of the
learning fold. Features come from the text's bytes alone: shares of each byte, of pairs of character classes, of
repeated words and lines, and lengths.

The model is fitted on the driver on a bounded sample: `SAMPLE` distinct positive texts and as many unlabelled ones,
picked by a hash of the text. Scoring covers every whole text. Without trusted positives, the score is the prior (0.5).
Null texts score as empty ones. Repeated rows score alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .language import fold
from .textbytes import Block, Hasher, blocks

#: Texts of either kind that the model is fitted on, at most.
SAMPLE = 6000
#: Classes of bytes: white space, line feed, lower, upper, digit, stop, other ASCII, lead and trail bytes above ASCII.
_CLASS = np.full(256, 6, np.int64)
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[10] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
_CLASS[192:] = 7
_CLASS[128:192] = 8
N_CLASS = 9
N_FEATURES = 256 + N_CLASS * N_CLASS + 6


def _share_repeated(key: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """By text, the share of keys that occur in it before."""
    order = np.lexsort((key, text))
    k, t = key[order], text[order]
    again = np.zeros(len(k), bool)
    again[1:] = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    return np.bincount(t, again, n) / np.maximum(1, np.bincount(t, minlength=n))


def features(block: Block) -> np.ndarray:
    """A row of N_FEATURES numbers for each text of the block."""
    n = len(block.begin)
    sizes = block.end - block.begin
    owner = np.repeat(np.arange(n), sizes + 1)
    inside = np.ones(len(block.data), bool)
    inside[block.end] = False
    data, owner = block.data[inside], owner[inside]
    total = np.maximum(1, sizes)[:, None]
    single = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256) / total
    kind = _CLASS[data]
    together = owner[1:] == owner[:-1]
    pair = (owner[1:] * N_CLASS + kind[:-1]) * N_CLASS + kind[1:]
    pairs = np.bincount(pair[together], minlength=n * N_CLASS * N_CLASS).reshape(n, -1) / total
    begin, end, text = block.words()
    word = Hasher(block.data)(begin, end)
    n_words = np.bincount(text, minlength=n)
    next_same = np.zeros(len(word), bool)
    next_same[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    line_end = np.flatnonzero(block.data == 10)
    line_begin = np.concatenate([[0], line_end[:-1] + 1])
    line_text = np.searchsorted(block.begin, line_begin, "right") - 1
    lines = Hasher(block.data)(line_begin, line_end)
    rest = np.stack(
        [
            np.log1p(n_words) / 10,
            np.log1p(sizes) / 15,
            np.bincount(text, end - begin, n) / np.maximum(1, n_words) / 20,
            _share_repeated(word, text, n),
            np.bincount(text, next_same, n) / np.maximum(1, n_words),
            _share_repeated(lines, line_text, n),
        ],
        axis=1,
    )
    return np.concatenate([np.sqrt(single), np.sqrt(pairs), rest], axis=1)


class Model:
    """Weights of a logistic model on standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, bias: float):
        self.mean, self.scale, self.weight, self.bias = mean, scale, weight, bias

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """Minimise the non-negative risk with Adam on the whole sample."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 0.01
    xp, xu = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    w = np.zeros(xp.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)

    def side(x: np.ndarray, sign: float) -> tuple[float, np.ndarray]:
        """Mean logistic loss of x taken as of that sign, and its gradient."""
        z = sign * (x @ w[:-1] + w[-1])
        slope = -sign / (1 + np.exp(np.clip(z, -30, 30))) / len(x)
        return float(np.logaddexp(0, -z).mean()), np.append(slope @ x, slope.sum())

    for t in range(1, steps + 1):
        _, g_pos = side(xp, 1.0)
        l_pn, g_pn = side(xp, -1.0)
        l_un, g_un = side(xu, -1.0)
        negative = l_un - prior * l_pn
        g = prior * g_pos + g_un - prior * g_pn if negative >= 0 else prior * g_pn - g_un
        g = g + decay * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, block in blocks(batch.column(0)):
            x = features(block).astype(np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([flat], names=["x"])


def _sample(texts: DataFrame, most: int, ids: DataFrame | None = None) -> np.ndarray:
    """Features of distinct texts (of rows whose doc_id is in ids, if given), those with the smallest hashes, `most` at most.

    Only ids and hashes are joined and counted; texts travel where their hash is small enough for the sample.
    """
    h = F.xxhash64("text")

    def wanted(rows: DataFrame) -> DataFrame:
        return rows if ids is None else rows.join(ids, "doc_id", "left_semi")

    n = wanted(texts.select("doc_id", h.alias("h"))).agg(F.approx_count_distinct("h")).first()[0]  # of distinct texts, so that copies don't eat the sample
    share = min(1.0, 4.0 * most / max(1, n))
    small = texts.select("doc_id", "text", h.alias("h")).where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    # the least hashes first, then one text of each
    least = wanted(small.select("doc_id", "h")).select("h").distinct().orderBy("h").limit(most)
    rows = small.join(F.broadcast(least), "h", "left_semi").select("text", "h").dropDuplicates(["h"])  # `most` rows
    found = rows.orderBy("h").limit(most).select("text").mapInArrow(_vectors, "x array<float>").toArrow().column("x").combine_chunks()
    return found.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | float:
    """From docs (doc_id, text) and labels (doc_id, quality); a plain prior where there is nothing to learn from."""
    marked = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n, good = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if not n or not good:
        return 0.5
    prior = min(0.98, max(0.02, good / n))
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    positive = _sample(whole, sample, marked.where("quality = 1").select("doc_id"))
    unlabelled = _sample(whole, sample)
    return fit(positive, unlabelled, prior) if len(positive) and len(unlabelled) else 0.5


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and quality_score (0 to 1) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.full(len(b.begin), model) if isinstance(model, float) else model(features(b)) for _, b in blocks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], names=[id_col, "quality_score"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(run, T.StructType([rows.schema[id_col], T.StructField("quality_score", T.DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels of the folds other than 1 of 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = fold(F.col("doc_id"), 3) != 1
    model = train(docs.where(learn), labels.where(learn))
    s = F.col("quality_score")
    return score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted")
    )
