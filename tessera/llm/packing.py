"""Packing into sequences of at most `cap` tokens by bin completion with branch-and-bound.

A piece's length is a whole number from 1 to cap, so all that matters of the input is how many pieces each length has:
at most cap counts, whatever the input's size. These reach the driver. It finds patterns (lengths that share a
sequence) and how many sequences follow each. Spark numbers the pieces of every length and a piece's number tells its
sequence and its place there; no piece passes through the driver.

Patterns: the largest length left opens a sequence, and the undominated fillings of the room around it are enumerated,
those that waste least first. A filling is dominated if a free length fits beside it, or fits in place of one or two
of its own. A pattern is used as often as the counts allow. Lower bounds on sequences give the waste that may be spent;
a branch that spends more is cut. Best fit decreasing gives the first solution; the search ends where a solution meets
the bound, and keeps the best one after `nodes` given-up branches.

Null and empty texts have the end id alone, one piece of length 1. Repeated rows are pieces of their own; a null id
is kept. Only texts of more than cap ids are cut: into pieces of cap, of which the first may be shorter. An empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .workspace import Workspace, spare_names

#: Branches that the search gives up for each number of sequences that is tried, before it ends.
NODES = 500
#: Fillings of one gap that a sequence tries at most, and of how many these are chosen.
FILLINGS, TRIES = 8, 1000
#: Pieces of a length that are numbered together, at least, and the most parts of all lengths together (besides one each).
SPLIT, PARTS = 1000, 10_000

Pattern = tuple[tuple[int, int], ...]


def least_sequences(counts: dict[int, int], cap: int) -> int:
    """A lower bound: for each k, lengths over cap - k take a sequence alone, those over half take one each and leave room
    to lengths from k on."""
    n = np.zeros(cap + 2, dtype=object)
    for length, count in counts.items():
        n[length] = count
    size = np.array([i * c for i, c in enumerate(n)], dtype=object)
    upto, space = np.cumsum(n), np.cumsum(size)
    best = -(-int(space[cap]) // cap)
    for k in range(1, cap // 2 + 1):
        alone = upto[cap] - upto[cap - k]
        large = upto[cap - k] - upto[cap // 2]
        room = large * cap - (space[cap - k] - space[cap // 2])
        small = space[cap // 2] - space[k - 1]
        best = max(best, int(alone + large + max(0, -((room - small) // cap))))
    return best


def best_fit(counts: dict[int, int], cap: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing over equal sequences at once."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:
                each = min(cap // length, left)  # several of this length open a sequence together
                items, uses = (length,) * each, left // each
                by_room.setdefault(cap - each * length, []).append((items, uses))
                left -= each * uses
                continue
            items, uses = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            each = min(room // length, left)
            take = min(uses, left // each)
            if take < uses:
                by_room.setdefault(room, []).append((items, uses - take))
            by_room.setdefault(room - each * length, []).append((items + (length,) * each, take))
            left -= each * take
    return [(pattern(items), uses) for group in by_room.values() for items, uses in group]


def pattern(items) -> Pattern:
    lengths, uses = np.unique(np.asarray(items, np.int64), return_counts=True)
    return tuple((int(a), int(b)) for a, b in zip(lengths[::-1], uses[::-1], strict=True))


class Fillings:
    """Undominated fillings of the room beside a length, from the lengths left."""

    def __init__(self, counts: dict[int, int], length: int, cap: int):
        self.counts = counts | {length: counts[length] - 1}
        self.room = cap - length
        self.lengths = sorted(x for x, c in self.counts.items() if c and x <= self.room)
        self.reached: dict[int, tuple[list[int], list[int]]] = {}

    def reach(self, least: int) -> tuple[list[int], list[int]]:
        """Lengths from `least` on, and the sums that those up to each one can make, as bits: a search for a sum that is
        among them meets no dead end."""
        if least not in self.reached:
            lengths, bits = self.lengths[bisect_left(self.lengths, least) :], [1]
            full = (1 << (self.room + 1)) - 1
            for x in lengths:
                now, left, step = bits[-1], min(self.counts[x], self.room // x), 1
                while left:
                    use = min(step, left)
                    now |= now << (use * x) & full
                    left -= use
                    step *= 2
                bits.append(now)
            self.reached[least] = lengths, bits
        return self.reached[least]

    def exact(self, total: int, least: int, at: int) -> Iterator[list[int]]:
        """Lengths from `least` on, below index `at` of these, that sum to total; larger ones first."""
        if total == 0:
            yield []
            return
        lengths, bits = self.reach(least)
        for i in range(min(at, bisect_right(lengths, total)), 0, -1):
            if not bits[i] >> total & 1:
                return
            x = lengths[i - 1]
            for use in range(min(self.counts[x], total // x), 0, -1):
                if bits[i - 1] >> (total - use * x) & 1:
                    for rest in self.exact(total - use * x, least, i - 1):
                        yield [x] * use + rest

    def dominated(self, items: list[int], gap: int) -> bool:
        """Whether a free length fits beside the items, or in place of one or two of them."""
        used: dict[int, int] = {}
        for x in items:
            used[x] = used.get(x, 0) + 1

        def free(lo: int, hi: int) -> bool:
            near = self.lengths[bisect_left(self.lengths, lo) : bisect_right(self.lengths, hi)]
            return any(self.counts[x] > used.get(x, 0) for x in near)

        if free(1, gap) or any(free(x + 1, x + gap) for x in used if gap):
            return True
        kinds = sorted(used)
        pairs = {a + b for i, a in enumerate(kinds) for b in kinds[i + (used[a] == 1) :]}
        return any(free(s, s + gap) for s in pairs)

    def all(self, waste: int) -> Iterator[tuple[list[int], int]]:
        """Fillings with their gap: smaller gaps first, and without the shortest lengths first, which fill what others
        leave; `FILLINGS` of each kind at most, of the first `TRIES` there are."""
        for gap in range(min(waste, self.room) + 1):
            for least in dict.fromkeys((self.room // 4, self.room // 16, self.room // 64, 1)):
                found = 0
                for items in islice(self.exact(self.room - gap, max(1, least), len(self.lengths)), TRIES):
                    if not self.dominated(items, gap):
                        yield items, gap
                        found += 1
                        if found == FILLINGS:
                            break


def search(counts: dict[int, int], cap: int, sequences: int, nodes: int) -> list[tuple[Pattern, int]] | None:
    """Patterns that fill at most so many sequences, or None if none was found before so many branches were given up."""
    counts = dict(counts)
    waste = sequences * cap - sum(x * c for x, c in counts.items())
    if waste < 0:
        return None
    out: list[tuple[Pattern, int, int]] = []

    def branches() -> Iterator[tuple[Pattern, int, int]]:
        """Ways to use the largest length left: (pattern, uses, waste spent)."""
        length = max(x for x, c in counts.items() if c)
        spare = waste
        for items, gap in Fillings(counts, length, cap).all(spare):
            chosen = pattern([length, *items])
            most = min(counts[x] // u for x, u in chosen)
            if gap:
                most = min(most, spare // gap)
            while most:
                yield chosen, most, gap * most
                most //= 2

    stack: list[Iterator] = []
    while any(counts.values()):
        if len(stack) == len(out):
            stack.append(branches())
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            nodes -= 1
            if not out or nodes < 0:
                return None
            chosen, uses, spent = out.pop()  # undo the step above and take its next branch
            waste += spent
            for x, u in chosen:
                counts[x] += u * uses
            continue
        chosen, uses, spent = step
        out.append(step)
        waste -= spent
        for x, u in chosen:
            counts[x] -= u * uses
    return [(p, n) for p, n, _ in out]


def patterns(counts: dict[int, int], cap: int, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """Patterns ((length, uses), ...), and how many sequences follow each: as few sequences as the search finds."""
    counts = {x: c for x, c in counts.items() if c}
    if not counts:
        return []
    best = best_fit(counts, cap)
    most, least = sum(n for _, n in best), least_sequences(counts, cap)
    for target in range(least, most):
        found = search(counts, cap, target, nodes)
        if found is not None:
            return found
        if target - least >= 4:  # far above the bound nothing was found: the first solution stays
            break
    return best


def cut(docs: DataFrame, cap: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Pieces of the texts: id, piece, start, length and ids (little-endian unsigned 32-bit numbers)."""
    data = docs.sparkSession.sparkContext.broadcast(tokens.read(path or tokens.public("byte_bpe_50k.json")))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.coder("byte", data.value)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows, found, held = [], [], 0
            for i, value in enumerate(batch.column(1)):
                text = tokens.text_of(value)
                ids = np.concatenate([coder.encode(text), end]) if text else end
                edge = list(range(len(ids) % cap or cap, len(ids) + 1, cap))
                for piece, (lo, hi) in enumerate(zip([0, *edge], edge, strict=False)):
                    rows.append((i, piece, lo, hi - lo))
                    found.append(ids[lo:hi].astype("<u4").tobytes())
                held += len(ids)
                if held > 1 << 20 or i + 1 == batch.num_rows:
                    of, piece, start, length = np.array(rows, np.int64).reshape(-1, 4).T
                    arrays = [batch.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(found, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["id", "piece", "start", "length", "ids"])
                    rows, found, held = [], [], 0

    schema = T.StructType([T.StructField("id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def ranges(found: list[tuple[Pattern, int]]) -> list[np.ndarray]:
    """By length and first number: length, number, first sequence, uses in a sequence, first offset."""
    next_of: dict[int, int] = {}
    rows, first = [], 0
    for chosen, sequences in found:
        offset = 0
        for length, uses in chosen:
            rows.append((length, next_of.get(length, 0), first, uses, offset))
            next_of[length] = next_of.get(length, 0) + uses * sequences
            offset += length * uses
        first += sequences
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return list(table.T)


def place(pieces: DataFrame, cap: int = 2048, nodes: int = NODES) -> DataFrame:
    """pieces (with a column length) with sequence_id and offset, in as few sequences as the search finds.

    The counts of lengths and the patterns are bounded by cap, the parts by `PARTS`; the pieces are staged once, so that
    all that is derived from them agrees if a task is run again.
    """
    spark = pieces.sparkSession
    ws = Workspace(spark, "packing")
    pieces = pieces.drop("sequence_id", "offset")
    columns = pieces.columns
    salt, part, parts, base, number = spare_names(pieces, "salt", "part", "parts", "base", "number")
    rows = ws.stage(pieces.withColumn(salt, F.xxhash64(F.monotonically_increasing_id(), "length")), "pieces")
    counts = {r[0]: r[1] for r in rows.groupBy("length").agg(F.count(F.lit(1))).limit(cap + 1).collect()}
    if any(x is None or not 1 <= x <= cap for x in counts):
        raise ValueError(f"lengths must be 1 to {cap}")
    table = ranges(patterns(counts, cap, nodes))
    each = max(SPLIT, -(-sum(counts.values()) // PARTS))
    by_length = spark.createDataFrame([(x, -(-c // each)) for x, c in counts.items()], f"length long, {parts} long")
    rows = rows.join(F.broadcast(by_length), "length").withColumn(part, F.pmod(salt, parts))  # cap rows at most
    before = F.sum(base).over(Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    bases = rows.groupBy("length", part).agg(F.count(F.lit(1)).alias(base)).select("length", part, F.coalesce(before, F.lit(0)).alias(base))
    rank = F.row_number().over(Window.partitionBy("length", part).orderBy(salt)) - 1
    rows = rows.withColumn(number, rank).join(F.broadcast(bases), ["length", part])  # cap + PARTS rows at most
    rows = rows.select(*columns, (F.col(number) + F.col(base)).alias(number))
    at, to = columns.index("length"), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, numbers, first, uses, offset = table
        order = (lengths << 48) + numbers
        for batch in batches:
            length, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (at, to))
            k = np.searchsorted(order, (length << 48) + number, "right") - 1
            own = number - numbers[k]
            arrays = [*batch.columns[:to], pa.array(first[k] + own // uses[k]), pa.array(offset[k] + own % uses[k] * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "sequence_id", "offset"])

    new = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return rows.mapInArrow(run, T.StructType([*pieces.schema.fields, *new]))


def sequences(pieces: DataFrame, cap: int = 2048) -> DataFrame:
    """sequence_id and ids (an array) of the packed sequences; a sequence holds cap ids at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in row), "<u4").astype(np.int32) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    full = place(pieces.select("length", "ids"), cap)
    grouped = full.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.mapInArrow(run, "sequence_id long, ids array<int>")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = cut(docs).select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(pieces).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
