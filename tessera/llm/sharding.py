"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**16 cells. Each shard owns `vnodes` of them (virtual nodes); a row's id hashes to a cell and belongs to
the next virtual node clockwise. No shard takes more than its bound. Rows beyond it, the last of their cell, continue
clockwise to the next virtual node of a shard that has room. With slack 0 the bounds add up to the number of rows, so
every shard ends full and counts differ by one at most; a larger slack moves fewer rows and lets counts differ more.

What reaches the driver is a count per cell (2**16 rows at most), whatever the input's size. A cell that holds more than
`SPLIT` rows is ranked in several parts, by hashes of the rows; equal rows on more than `SPLIT` places, such as one id on a
third of all rows, are a part of their own, which is numbered in several pieces. Where parts and pieces begin is summed up in
Spark. Shards and slots depend on the rows alone and not on how files or tasks hold them (equal rows can't be told apart).

Null texts have size 1 and checksum 0; a null id is a key as any other; repeated rows each get a slot of their own; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

CELL_BITS = 16
CELLS = 1 << CELL_BITS
#: Rows that are ranked together at most (about), before a cell is ranked in parts.
SPLIT = 50_000
#: Rows of a table of offsets or of hot rows that is sent to every task, at most.
BROADCAST_ROWS = 500_000


def ring(n_shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and shards of the virtual nodes, in ring order. A shard's nodes do not depend on how many shards there are."""
    taken: dict[int, tuple[int, int]] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            digest = hashlib.blake2b(f"{shard}:{v}".encode(), digest_size=8).digest()
            cell = int.from_bytes(digest, "big") >> (64 - CELL_BITS)
            taken.setdefault(cell, (shard, v))  # the older shard keeps a cell that two want
    cells = np.array(sorted(taken), dtype=np.int64)
    return cells, np.array([taken[c][0] for c in cells], dtype=np.int64)


def bounds(n_rows: int, n_shards: int, slack: float) -> list[int]:
    """Most rows of each shard."""
    if slack > 0:
        return [int(np.ceil((1 + slack) * n_rows / n_shards))] * n_shards
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def place(counts: dict[int, int], n_shards: int, vnodes: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """Ranges of ranks within cells: (cell, first rank, end rank, shard, first slot)."""
    cells, owners = ring(n_shards, vnodes)
    room = bounds(sum(counts.values()), n_shards, slack)
    used = [0] * n_shards
    out, over = [], []

    def put(cell: int, lo: int, hi: int, shard: int) -> int:
        take = min(hi - lo, room[shard] - used[shard])
        if take > 0:
            out.append((cell, lo, lo + take, shard, used[shard]))
            used[shard] += take
        return lo + max(take, 0)

    for cell in sorted(counts):
        node = int(np.searchsorted(cells, cell)) % len(cells)
        lo = put(cell, 0, counts[cell], int(owners[node]))
        if lo < counts[cell]:
            over.append((cell, lo, node))
    for cell, lo, node in over:
        while lo < counts[cell]:
            node = (node + 1) % len(cells)
            lo = put(cell, lo, counts[cell], int(owners[node]))
    return out


def shard(docs: DataFrame, n_shards: int, vnodes: int = 256, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot of every row of docs."""
    spark = docs.sparkSession
    ws = Workspace(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = ws.stage(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("ring")), 64 - CELL_BITS).cast("int").alias("cell"),
            F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"),
            F.monotonically_increasing_id().alias("nr"),  # written, so that every plan sees the same
        ),
        "rows",
    )
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    crowded = [(c, -(-n // SPLIT)) for c, n in counts.items() if n > SPLIT]
    if crowded:
        rows = rows.join(F.broadcast(spark.createDataFrame(crowded, "cell int, parts long")), "cell", "left")  # 2**16 rows at most
        hot = rows.where("parts is not null").groupBy("cell", "key").count().where(F.col("count") > SPLIT)
        hot = ws.stage(hot.select("cell", "key", F.ceil(F.col("count") / SPLIT).alias("pieces")), "hot")
        rows = rows.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, ["cell", "key"], "left")
        whole = F.when(F.col("pieces").isNull(), F.coalesce(F.pmod("key", "parts"), F.lit(0)))
        rows = rows.select(
            "id", "size", "crc", "cell", "key", F.coalesce(whole, F.lit(-1)).alias("part"), F.when(F.col("pieces").isNull(), 0).otherwise(F.col("key")).alias("own"),
            F.coalesce(F.pmod(F.xxhash64("nr"), F.col("pieces")), F.lit(0)).alias("piece"),
        )
        place_in_cell = ["part", "own", "piece"]
        before = F.sum("count").over(Window.partitionBy("cell").orderBy(*place_in_cell).rowsBetween(Window.unboundedPreceding, -1))
        first = ws.stage(rows.groupBy("cell", *place_in_cell).count().withColumn("offset", F.coalesce(before, F.lit(0))).drop("count"), "offsets")
        rows = rows.join(F.broadcast(first) if first.count() <= BROADCAST_ROWS else first, ["cell", *place_in_cell])
    else:
        place_in_cell = []
        rows = rows.withColumn("offset", F.lit(0).cast("long"))
    ranges = place(counts, n_shards, vnodes, slack)
    names = ("cell", "lo", "hi", "shard", "first")
    columns = list(zip(*ranges, strict=True)) if ranges else [[]] * 5
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    table = spark.createDataFrame(pa.table({k: pa.array(v, t) for k, v, t in zip(names, columns, kinds, strict=True)}))
    rank = F.row_number().over(Window.partitionBy("cell", *place_in_cell).orderBy("key", "id", "crc", "size")) - 1 + F.col("offset")
    # One range for each cell, and some more where shards are full: 2**16 and a few, at any input size.
    return (
        rows.withColumn("rank", rank)
        .join(F.broadcast(table), "cell")
        .where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            "shard",
            (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts differ by one at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
