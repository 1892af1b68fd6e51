"""Most similar vectors by cosine, exact, by blocked matrix products.

The query vectors come in blocks of a bounded number of bytes. A block is sent to every task; a task multiplies its
batches of the table with the block, a bounded number of products at a time, and keeps the k best of each query. So what
leaves a task is k rows for each query, not a row for each pair, and a plan that merges these needs no more.
A large query set takes one pass over the table for each block. All pairs are compared, so the work is that of
the product of both sides; candidates that are found exactly are settled by a join before it.

Null vectors are left out. Vectors of norm 0 have similarity 0 with all. Ties go to the smaller id; equal vectors get equal similarities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import Workspace

#: Bytes of query vectors in a block, and products that a task holds at once.
BLOCK_BYTES, PRODUCTS = 32 << 20, 1 << 21
#: Queries of a block that are multiplied at once, so that many rows of the table meet them and few pairs pass.
QUERIES = 1 << 10
_FLOOR = 1e-12


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = np.asarray(column.flatten(), float)
    return flat.reshape(n, len(flat) // n if n else 0)


def _best(rows: np.ndarray, sims: np.ndarray, ids: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries (query number, similarity, id) the k best of each query."""
    order = np.lexsort((ids, -sims, rows))
    rows, sims, ids = rows[order], sims[order], ids[order]
    first = np.searchsorted(rows, np.arange(n))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], sims[keep], ids[keep]


def _candidates(of: slice, unit, turned, edge, names, ids, own: bool, k: int, q, norm, x, across) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, rows of the table and exact similarities of the pairs that may be among the k best of the queries `of`.

    The products rule out all pairs below what the task has found before; only the rest is computed exactly.
    """
    sims = unit[of] @ turned
    some = norm[of]
    if some[some > 0].min(initial=1) * across[across > 0].min(initial=1) < _FLOOR:  # such products are divided by the floor
        sims = (q[of] @ x.T) / np.maximum(some[:, None] * across[None, :], _FLOOR)
    if not own:
        sims[names[of, None] == ids[None, :]] = -np.inf
    least = edge[of]
    new = np.isneginf(least)
    if new.any() and k < sims.shape[1]:
        least = least.copy()
        least[new] = np.partition(sims[new], -k, axis=1)[:, -k]
    row, col = np.nonzero(sims >= np.maximum(least - 1e-9, -2.0)[:, None])
    row += of.start
    exact = np.einsum("ij,ij->i", q[row], x[col]) / np.maximum(norm[row] * across[col], _FLOOR)  # the same sum for equal vectors
    return row, col, exact


def _against(block: pa.Table, table: DataFrame, k: int, own: bool) -> DataFrame:
    """word, other, sim: for each query of the block the k best of every task's part of the table."""
    names = np.asarray(block.column(0).to_numpy(zero_copy_only=False))
    names = names.astype(str) if names.dtype == object else names
    q = _matrix(block.column(1).combine_chunks())
    held = table.sparkSession.sparkContext.broadcast((names, q, _norms(q)))
    id_type, word_type = table.schema["other"].dataType, T.LongType() if names.dtype.kind in "iu" else T.StringType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, norm = held.value
        n = len(q)
        best: tuple | None = None
        unit = q / np.maximum(norm, _FLOOR)[:, None]
        edge = np.full(n, -np.inf)  # the k-th best similarity of each query so far in this task
        few = max(1, min(n, QUERIES))
        for batch in batches:
            step = max(1, PRODUCTS // few)
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                ids = ids.astype(str) if ids.dtype == object else ids
                x = _matrix(part.column(1))
                across = _norms(x)
                turned = (x / np.maximum(across, _FLOOR)[:, None]).T
                found = [] if best is None else [best]
                for first in range(0, n, few):
                    row, col, exact = _candidates(slice(first, first + few), unit, turned, edge, names, ids, own, k, q, norm, x, across)
                    found.append((row, exact, ids[col]))
                best = _best(*map(np.concatenate, zip(*found, strict=True)), k, n)
                count = np.bincount(best[0], minlength=n)
                full = count >= k
                edge[full] = best[1][np.cumsum(count) - 1][full]
        if best is not None:
            row, sims, ids = best
            yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(ids), pa.array(sims)], names=["word", "other", "sim"])

    schema = T.StructType([T.StructField("word", word_type), T.StructField("other", id_type), T.StructField("sim", T.DoubleType())])
    return table.select("other", "vec").mapInArrow(run, schema)


def _blocks(queries: DataFrame, ws: Workspace, block_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """The query vectors in blocks of about so many bytes; each is read from the written table."""
    rows = ws.stage(queries.where("vec is not null").select("word", F.transform("vec", lambda x: x.cast("double")).alias("vec")), "queries")
    size = rows.agg(F.coalesce(F.sum(F.size("vec")) * 8, F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b).orderBy("word").toArrow()
        if block.num_rows:
            yield b, block


def top(queries: DataFrame, table: DataFrame, k: int, own: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """word, other, sim: the k most similar rows of table (word, vec) for each row of queries (word, vec).

    own: a query may find the row of its own id. Ids are whole numbers or strings.
    """
    table = table.where("vec is not null").select(F.col("word").alias("other"), F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    ws = Workspace(queries.sparkSession, "similar")
    # each block is one scan of the table
    found = [ws.stage(_against(block, table, k, own), f"found-{b}") for b, block in _blocks(queries, ws, block_bytes)]
    if not found:
        return queries.select("word").join(table, F.lit(False)).select("word", "other", F.lit(0.0).alias("sim"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    r = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("sim"), "other"))
    return every.withColumn("r", r).where(F.col("r") <= k).select("word", "other", "sim")
