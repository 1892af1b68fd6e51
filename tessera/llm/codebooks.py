"""Product codes of vectors, their codebooks found by rounds of assignment and means, in whole numbers throughout.

Each component x becomes floor(256 x). A vector is cut into equal consecutive parts, and every part position has a
codebook, which starts as that part of the vectors of the smallest ids. A round hands every part to its nearest entry
(squared Euclidean distance, ties to the lower index) and makes each entry the floor of its parts' mean; an entry without
parts stays.

The nearest entry is found as in a vector-approximation file. Each coordinate of the entries is quantised to a few bits,
and a cell keeps the least and greatest coordinate in it. For a batch of parts a lookup table has, for each dimension and
cell, the least and the greatest squared difference that a coordinate of the cell can have. Their sums over dimensions
bound an entry's distance from below and above; only entries whose lower bound is within the least upper bound are refined by
exact integer distances.

Codebooks are entries x dimension numbers, whatever the number of vectors: they reach the driver and are sent to the tasks.
Tasks add up the parts of their own vectors first; what is shuffled is a row for each task, entry and dimension.

Rows whose vector is null or holds a null or a number that isn't finite are dropped. So are vectors of another length
than most have (ties: the longer one), since they have no such parts. Components beyond +-`LARGEST` count as that, so
distances and their sums over a vector stay within 64 bits. Null ids come last in the order of ids; rows of equal ids are ordered by
their vectors; repeated rows are coded alike. With fewer vectors than entries a codebook is shorter. An empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Workspace

#: Greatest size of a component that is told apart, after scaling: (2 LARGEST) squared times 64 dimensions is 2**62.
LARGEST = 1 << 27
#: Bits of a quantised coordinate.
BITS = 3
#: Vectors that are compared with all entries at once.
BATCH = 4096
#: Bytes of the table of labels that are sent to every task at most.
BROADCAST = 64 << 20


class Cells:
    """The entries of one codebook (entries x dimension) as cells, for nearest-entry search."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n, dims = entries.shape
        cells = 1 << bits
        rank = entries.argsort(0, kind="stable").argsort(0, kind="stable")
        self.cell = rank * cells // max(n, 1)  # about as many entries in each cell
        self.low = np.full((dims, cells), np.iinfo(np.int64).max // 4)
        self.high = np.full((dims, cells), -(np.iinfo(np.int64).max // 4))
        for d in range(dims):
            np.minimum.at(self.low[d], self.cell[:, d], entries[:, d])
            np.maximum.at(self.high[d], self.cell[:, d], entries[:, d])
        self.used = self.low <= self.high

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, and its squared distance."""
        n = len(parts)
        lower = np.zeros((n, len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for d in range(parts.shape[1]):
            x = parts[:, d, None]
            low, high = np.where(self.used[d], self.low[d], 0), np.where(self.used[d], self.high[d], 0)
            below, above = low - x, x - high  # positive where the coordinate lies outside the cell
            out = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(-below, -above)  # to the farther edge
            lower += (out * out).take(self.cell[:, d], 1)
            upper += (far * far).take(self.cell[:, d], 1)
        query, entry = np.nonzero(lower <= upper.min(1, keepdims=True))
        gap = parts[query] - self.entries[entry]
        distance = np.einsum("ij,ij->i", gap, gap)
        starts = np.searchsorted(query, np.arange(n))
        least = np.minimum.reduceat(distance, starts)
        hit = np.flatnonzero(distance == least[query])
        first = hit[np.searchsorted(query[hit], np.arange(n))]  # the lowest index among equals
        return entry[first], least


def whole(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id, label, x (whole numbers) of the rows that have a vector of the usual length without gaps."""
    x = F.col(vec_col)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    kept = vectors.where(x.isNotNull() & ~odd)
    sizes = kept.groupBy(F.size(x).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = sizes[0]["size"] if sizes else 0
    scaled = F.transform(x, lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(v.cast("double") * 256))).cast("long"))
    label = F.col(label_col) if label_col in vectors.columns else F.lit(None).cast("int")
    return kept.where(F.size(x) == size).select(F.col(id_col).alias("id"), label.alias("label"), scaled.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dims)


def means(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round. books: for each part entries x dimension."""
    spark, width = rows.sparkSession, books[0].shape[1]
    held = spark.sparkContext.broadcast([Cells(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = held.value
        sums = np.zeros((len(cells), len(cells[0].entries), width), np.int64)
        counts = np.zeros(sums.shape[:2], np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                x = _matrix(batch.column(0).slice(lo, BATCH), len(cells) * width)
                for p, book in enumerate(cells):
                    part = x[:, p * width : (p + 1) * width]
                    entry, _ = book.nearest(part)
                    np.add.at(sums[p], entry, part)
                    counts[p] += np.bincount(entry, minlength=len(counts[p]))
        p, e = np.nonzero(counts)
        if len(p):
            shape = (len(p), width)
            columns = [np.broadcast_to(a[:, None], shape) for a in (p, e)] + [np.broadcast_to(np.arange(width), shape), sums[p, e], np.broadcast_to(counts[p, e][:, None], shape)]
            yield pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in columns], names=["part", "entry", "dim", "s", "n"])

    found = rows.select("x").mapInArrow(run, "part long, entry long, dim long, s long, n long")
    # entries x dimension rows: bounded by the codebooks
    total = found.groupBy("part", "entry", "dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    books = [b.copy() for b in books]
    for r in total:
        books[r["part"]][r["entry"], r["dim"]] = int(r["s"]) // r["n"]
    return books


def codebooks(rows: DataFrame, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The codebooks of rows (id, x) after so many rounds; empty without rows."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    if not first:
        return []
    x = np.array([r["x"] for r in first], np.int64)
    if x.shape[1] % parts or not x.shape[1]:
        raise ValueError(f"vectors of {x.shape[1]} components have no {parts} equal parts")
    books = np.split(x, parts, axis=1)
    for _ in range(rounds):
        books = means(rows, books)
    return books


def coded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """rows (id, label, x) as id, label, codes (an index for each part) and error."""
    held = rows.sparkSession.sparkContext.broadcast([Cells(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                width = cells[0].entries.shape[1]
                x = _matrix(part.column(2), len(cells) * width)
                found = [book.nearest(x[:, p * width : (p + 1) * width]) for p, book in enumerate(cells)]
                codes = np.stack([entry for entry, _ in found], 1).astype(np.int32)
                ends = np.arange(0, codes.size + 1, len(cells), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.ravel())), pa.array(sum(d for _, d in found))],
                    names=["id", "label", "codes", "error"],
                )

    own = [rows.schema[c] for c in ("id", "label")]
    new = [T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())]
    if not books:
        return rows.select("id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
    return rows.select("id", "label", "x").mapInArrow(run, T.StructType([*own, *new]))


def text(books: list[np.ndarray]) -> str:
    """All entries' components by part, entry and position, joined by commas."""
    return ",".join(str(v) for b in books for v in b.ravel().tolist())


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """id, label, codes, error and label_error (error summed over equal labels, nulls together) of the kept rows; codebooks."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "codebooks")
    rows = whole(vectors, id_col, vec_col, label_col)
    books = codebooks(rows, parts, entries, rounds)
    out = ws.stage(coded(rows, books), "coded")
    sums = ws.stage(out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    size = sums.agg(F.coalesce(F.sum(F.octet_length(F.coalesce(F.col("of").cast("string"), F.lit(""))) + 32), F.lit(0))).first()[0]
    sums = F.broadcast(sums) if size <= BROADCAST else sums  # beyond that a join by label, whose hot labels AQE splits
    return out.join(sums, out.label.eqNullSafe(sums.of), "left").drop("of"), books


def query(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 16 parts, 64 entries, two rounds."""
    out, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(text(books).encode()).hexdigest()
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return out.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


_ROUND = """
a{i} AS (SELECT k, part, x, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
  SELECT p.k, p.part, p.x, c.e, list_sum(list_transform(range(1, 5), lambda j: (p.x[j] - c.c[j]) * (p.x[j] - c.c[j]))) AS d FROM p JOIN c{i} c USING (part)) GROUP BY ALL),"""
_MEANS = """
m{i} AS (SELECT part, e, list(((s - ((s % n) + n) % n) // n) ORDER BY j) AS c FROM (SELECT part, e, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 5) t(j) GROUP BY part, e, j) GROUP BY part, e),
c{j} AS (SELECT part, e, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m USING (part, e)),"""

ORACLE = (
    """WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT k, CAST(part AS INT) AS part, v[4 * part + 1 : 4 * part + 4] AS x FROM kept, range(16) t(part)),
c0 AS (SELECT part, CAST(k - 1 AS BIGINT) AS e, x AS c FROM p WHERE k <= 64),"""
    + "".join(_ROUND.format(i=i) + _MEANS.format(i=i, j=i + 1) for i in range(2))
    + _ROUND.format(i=2)
    + """
f AS (SELECT k, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY k)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c[j] AS VARCHAR), ',' ORDER BY part, e, j)) FROM c2, range(1, 5) t(j)) AS codebooks_sha256
FROM f JOIN kept USING (k)"""
)
