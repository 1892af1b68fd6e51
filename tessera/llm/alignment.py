"""Alignment of two tokenizers over the same texts.

Both tokenizers write the bytes of a space and the text. The byte offsets at which tokens end are an ascending run for
each; the two runs are merged, and an offset in both is a cut. Between two cuts lies a group: some tokens of A and some
of B that spell the same bytes. The two tokens that end at a cut are linked.

Corpus-wide: how often each pair of ids is linked, and the greatest such count of each side's ids. A pair's bytes end
alike, so the pairs are at most the suffixes of one vocabulary in the other: the table of pairs is bounded by the
vocabularies, whatever the corpus, and is sent to every task.

Texts that are null or empty have no tokens; nor have those whose tokens do not spell a space and the text (a marker
character of B's in the text, bytes that aren't UTF-8). Repeated rows count each time; null ids are kept; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .workspace import Workspace

#: Bytes of texts that are merged at once, but for a single longer text.
BLOCK = 1 << 20


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Offsets at which tokens of both end. The sort is a merge: it finds two ascending runs and walks along both."""
    both = np.concatenate([ends_a, ends_b])
    both.sort(kind="stable")
    return both[1:][both[1:] == both[:-1]]


class Spelled:
    """Texts of a block that both tokenizers spell: ids side by side, with the length of every token."""

    def __init__(self, texts: list[str | None], valid: list[bool], a, b, sizes: tuple[np.ndarray, np.ndarray]):
        self.rows: list[int] = []
        ids: tuple[list, list] = ([], [])
        for i, text in enumerate(texts):
            if not text or not valid[i]:
                continue
            raw = (" " + text).encode()
            found = a.encode(" " + text), b.encode(text)
            if all(b"".join(map(c.token_bytes.__getitem__, x.tolist())) == raw for c, x in zip((a, b), found, strict=True)):
                self.rows.append(i)
                for side, x in zip(ids, found, strict=True):
                    side.append(x)
        self.counts = [np.array([len(x) for x in side], np.int64) for side in ids]
        self.ids = [np.concatenate(side).astype(np.int64) if side else np.zeros(0, np.int64) for side in ids]
        self.ends = [np.cumsum(s[x]) for s, x in zip(sizes, self.ids, strict=True)]


def labels(size: int, ends: tuple[bytes, bytes]) -> np.ndarray:
    """For each id its decimal digits with one of two ends, at 2 id and 2 id + 1, as rows of fixed width."""
    return np.array([str(i).encode() + e for i in range(size) for e in ends])


def align_block(block: Spelled, of: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """For each text: groups, their string; for each cut: the number of its text, and the linked ids."""
    (ids_a, ids_b), (ends_a, ends_b) = block.ids, block.ends
    cuts = merged(ends_a, ends_b)
    at_a, at_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    last_a[at_a] = last_b[at_b] = True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    # A group's tokens of A, then those of B: a token stands behind its own side's before it and the other side's earlier groups.
    before_b = np.concatenate([[0], at_b + 1])[group_a]
    upto_a = (at_a + 1)[group_b]
    width = max(of.dtype.itemsize, 1)
    line = np.zeros(len(ids_a) + len(ids_b), of.dtype)
    line[np.arange(len(ids_a)) + before_b] = of[2 * ids_a + last_a]
    line[np.arange(len(ids_b)) + upto_a] = of[2 * (ids_b + len(of) // 4) + last_b]
    edges = np.concatenate([[0], np.cumsum(block.counts[0] + block.counts[1])]) * width
    raw = line.tobytes()
    strings = [raw[lo:hi].replace(b"\0", b"")[:-1] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    text_of_cut = np.searchsorted(np.cumsum(block.counts[0]), at_a, "right")
    groups = np.bincount(text_of_cut, minlength=len(block.rows))
    return groups, strings, text_of_cut, np.stack([ids_a[at_a], ids_b[at_b]])


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`) and links (distinct pairs: a, b, times) of every row."""
    sc = docs.sparkSession.sparkContext
    data = sc.broadcast((tokens.read(path_a or tokens.public("byte_bpe_50k.json")), tokens.read(path_b or tokens.public("piece_bpe_32k.model"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokens.coder("byte-plain", data.value[0]), tokens.coder("piece", data.value[1])
        sizes = tuple(np.array([len(x) for x in c.token_bytes], np.int64) for c in (a, b))
        n = max(len(a.token_bytes), len(b.token_bytes))
        of = np.concatenate([labels(n, (b",", b"|")), labels(n, (b",", b";"))])
        for batch in batches:
            texts: list[str | None] = []
            valid: list[bool] = []
            first = held = 0
            for i, value in enumerate(batch.column(1)):
                text = tokens.text_of(value)
                texts.append(text)
                valid.append(text is not None and ("�" not in text or text.encode() == value.as_buffer().to_pybytes()))
                held += 4 * len(text or "")
                if held >= 4 * BLOCK or i + 1 == batch.num_rows:
                    yield block(batch.column(0).slice(first, len(texts)), Spelled(texts, valid, a, b, sizes), of, n)
                    texts, valid, first, held = [], [], i + 1, 0

    def block(ids: pa.Array, spelled: Spelled, of: np.ndarray, n: int) -> pa.RecordBatch:
        rows = len(ids)
        counts = np.zeros((3, rows), np.int64)
        strings = [b""] * rows
        ends = np.zeros(rows + 1, np.int32)
        pair_a = pair_b = times = np.zeros(0, np.int32)
        if spelled.rows:
            groups, found, text, (link_a, link_b) = align_block(spelled, of)
            at = np.array(spelled.rows)
            counts[:, at] = *spelled.counts, groups
            for i, s in zip(spelled.rows, found, strict=True):
                strings[i] = s
            keys, times = np.unique((text * n + link_a) * n + link_b, return_counts=True)
            pair_a, pair_b = keys // n % n, keys % n
            ends[1:] = np.cumsum(np.bincount(at[keys // (n * n)], minlength=rows))
        pairs = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (pair_a, pair_b, times)], ["a", "b", "times"])
        arrays = [ids, *(pa.array(c) for c in counts), pa.array(strings, pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(pa.array(ends), pairs)]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "n_a", "n_b", "n_groups", "groups", "links"])

    kind = docs.schema[id_col].dataType
    link = T.StructType([T.StructField(c, T.IntegerType()) for c in ("a", "b", "times")])
    long = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups")]
    schema = T.StructType([T.StructField("id", kind), *long, T.StructField("groups", T.StringType()), T.StructField("links", T.ArrayType(link))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count: how many links corpus-wide hold the pair."""
    return aligned.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum("l.times").alias("count"))


def with_best(counts: DataFrame) -> DataFrame:
    """counts with the greatest count of each side's id; both tables are as small as a vocabulary."""
    best_a = counts.groupBy("a").agg(F.max("count").alias("best_a"))
    best_b = counts.groupBy("b").agg(F.max("count").alias("best_b"))
    return counts.join(F.broadcast(best_a), "a").join(F.broadcast(best_b), "b")


def scored(aligned: DataFrame, ws: Workspace) -> DataFrame:
    """Staged rows (key, links, ...) with n_links, n_best (links whose count is their b's greatest) and count_sum."""
    counts = ws.stage(pair_counts(aligned), "counts")
    pairs = ws.stage(with_best(counts), "pairs")
    each = aligned.select("key", F.explode("links").alias("l")).select("key", "l.a", "l.b", "l.times")
    # The pairs are bounded by the vocabularies (see above): a few hundred thousand rows for those of 50,000 and 32,000.
    each = each.join(F.broadcast(pairs.select("a", "b", "count", (F.col("count") == F.col("best_b")).alias("best"))), ["a", "b"])
    sums = each.groupBy("key").agg(
        F.sum("times").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
    )
    zero = F.lit(0).cast("long")
    return aligned.join(sums, "key", "left").withColumns({c: F.coalesce(F.col(c), zero) for c in ("n_links", "n_best", "count_sum")})


def query(spark, sf_dir: str) -> DataFrame:
    """Groups and links of every whole text, with the links' counts over all texts."""
    ws = Workspace(spark, "alignment")
    found = align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups"), 256)).otherwise("")
    rows = ws.stage(found.select(F.monotonically_increasing_id().alias("key"), F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "links"), "rows")
    return scored(rows, ws).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
