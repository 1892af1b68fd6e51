"""Removal of repeated byte strings by sorting suffixes.

A byte goes if a string of `WIDTH` bytes that covers it also starts anywhere else, in the same text or another. Whole
texts are bytes; strings never cross texts.

Only suffixes that can matter are sorted. Every window of WIDTH bytes has an anchor: of its grams of `GRAM` bytes, the
one with the smallest hash, the first among equals. Equal windows have equal anchors at equal places. The consecutive
windows of one anchor form a context. Contexts that occur twice or more repeat whole; anchors whose gram occurs nowhere
else repeat nothing; both are settled by counting hashes. Different contexts around one gram are cut into stretches of
`STRETCH` windows by their distance to the anchor, and counted once more by the bytes that all windows of the stretch
share (the core) and by all of its bytes. What remains are different stretches around one core. Their suffixes (one for
each window) go through the suffix sort: sampled splitters
range-partition them by the leading bytes at the anchor, each bucket sorts its suffixes locally by multikey quicksort
(eight bytes at a time, only ties go on), and neighbours that agree on WIDTH bytes are repeats. Groups that touch a
bucket's boundary, or are larger than a block of `MOST` stretches, are compared across boundaries: each part hands on
two 64-bit hashes for each different window, and these are counted. (Both come from one polynomial modulo 2**64, so they are
less than 128 independent bits; a false repeat would need two different windows that agree in it.) So one passage in a
third of all texts is split over buckets and never gathered.

Null texts are empty. Texts under WIDTH bytes keep all. Repeated rows are repeats of each other. Null ids are ids. An
empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import Block, Hasher, blocks, mix
from .workspace import Workspace

WIDTH, GRAM = 400, 100
#: Windows of a stretch.
STRETCH = 16
#: Stretches of one core that are sorted together, and stretches of a bucket (about).
MOST, BUCKET = 4096, 20_000
BROADCAST_ROWS = 1_000_000
#: Bits of a place within a block: no string of Spark is longer.
_PLACE = np.uint64(32)
_ODD = np.uint64(0x9FB21C651E98DF25)


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive elements."""
    n = len(x)
    pad = np.concatenate([x, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def contexts(block: Block, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For each anchor of the block's texts: text, place, first and last window start (in the text), hash of gram and context."""
    n = len(block.data)
    if n < width:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    hasher = Hasher(block.data)
    at = np.arange(n - gram + 1)
    grams = hasher(at, at + gram)
    least = _slide_min((grams >> _PLACE << _PLACE) | at.astype(np.uint64), width - gram + 1)
    anchor = (least & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    starts = np.arange(len(anchor))
    text = np.searchsorted(block.begin, starts, "right") - 1
    inside = np.flatnonzero(starts + width <= block.end[text])
    if not len(inside):
        return contexts(Block([b""]), width, gram)
    new = np.ones(len(inside), bool)
    new[1:] = (np.diff(inside) > 1) | (np.diff(anchor[inside]) != 0)
    lo = inside[new]
    hi = inside[np.append(np.flatnonzero(new)[1:] - 1, len(inside) - 1)]
    p, owner = anchor[lo], text[lo]
    base = block.begin[owner]
    whole = mix(hasher(lo, hi + width) * _ODD + (p - lo).astype(np.uint64))
    return owner, p - base, lo - base, hi - base, grams[p], whole


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k1, k2, texts = batch.columns
        for first, block in blocks(texts):
            owner, p, lo, hi, gram, whole = contexts(block)
            take = pa.array(owner + first)
            yield pa.RecordBatch.from_arrays(
                [k1.take(take), k2.take(take), pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (p, lo, hi))],
                names=["k1", "k2", "gram", "c", "p", "lo", "hi"],
            )


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of the wanted contexts: their core's and their own hash, and distances of their windows to the anchor."""
    for batch in batches:
        for first, block in blocks(batch.column(0)):
            lists = batch.column(1).slice(first, len(block.begin))
            wanted = lists.flatten()
            if not len(wanted):
                continue
            gram, c, p, lo, hi = (wanted.field(n).to_numpy() for n in ("gram", "c", "p", "lo", "hi"))
            owner = np.repeat(np.arange(len(block.begin)), np.diff(lists.offsets.to_numpy()))
            hasher = Hasher(block.data)
            near, far = (p - hi) // STRETCH, (p - lo) // STRETCH
            n = far - near + 1
            row = np.repeat(np.arange(len(p)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + near[row]
            d0, d1 = np.maximum((p - hi)[row], k * STRETCH), np.minimum((p - lo)[row], k * STRETCH + STRETCH - 1)
            at = (block.begin[owner] + p)[row]
            core = mix(hasher(at - k * STRETCH, at - k * STRETCH + WIDTH - STRETCH + 1) * _ODD + k.astype(np.uint64))
            own = mix(hasher(at - d1, at - d0 + WIDTH) * _ODD + (d0 * 1024 + d1).astype(np.uint64))
            longs = (gram[row], c[row], core.view(np.int64), own.view(np.int64))
            ints = (p[row], d0, d1, (p - lo)[row] - d1)
            names = ["gram", "c", "core", "own", "p", "d0", "d1", "shift"]
            yield pa.RecordBatch.from_arrays([*map(pa.array, longs), *(pa.array(x.astype(np.int32)) for x in ints)], names=names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted stretch, with the leading bytes at its anchor."""
    kind = pa.schema([("lead", pa.binary()), ("core", pa.int64()), ("gram", pa.int64()), ("c", pa.int64()), ("shift", pa.int32()), ("off", pa.int32()), ("raw", pa.binary())])
    for batch in batches:
        rows = []
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes()
            for w in wanted.as_py():
                p, d0, d1 = w["p"], w["d0"], w["d1"]
                rows.append((raw[p : p + 16], w["core"], w["gram"], w["c"], w["shift"], d1, raw[p - d1 : p - d0 + WIDTH]))
            if len(rows) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)


def sort_suffixes(raws: list[bytes], offs: list[int], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes (one for each window) of contexts around one gram: context, start in it, and class of equal windows.

    Multikey quicksort: suffixes are split by their distance to the anchor, then by eight bytes after eight; a suffix
    that is alone in its part is done.
    """
    size = np.array([len(r) for r in raws])
    data = np.frombuffer(b"".join(raws) + bytes(8), np.uint8)
    base = np.cumsum(size) - size
    count = size - width + 1
    owner = np.repeat(np.arange(len(raws)), count)
    start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    word = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        word |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    at = base[owner] + start
    part = np.array(offs)[owner] - start  # distance to the anchor
    alive = np.arange(len(owner))
    cls = np.full(len(owner), -1, np.int64)
    done = 0
    depth = 0
    while len(alive):
        if depth == 0:
            order = np.argsort(part, kind="stable")
            a, first = alive[order], np.ones(len(alive), bool)
            first[1:] = part[order][1:] != part[order][:-1]
        else:
            w = word[at[alive] + min((depth - 1) * 8, width - 8)]
            order = np.lexsort((w, group))
            a, gw, ww = alive[order], group[order], w[order]
            first = np.ones(len(a), bool)
            first[1:] = (gw[1:] != gw[:-1]) | (ww[1:] != ww[:-1])
        number = np.cumsum(first) - 1
        members = np.bincount(number)
        single = members[number] == 1
        cls[a[single]] = done + np.arange(int(single.sum()))
        done += int(single.sum())
        alive, group = a[~single], number[~single]
        if depth * 8 >= width:
            kinds, back = np.unique(group, return_inverse=True)
            cls[alive] = done + back
            break
        depth += 1
    return owner, start, cls


def _hashes(raws: list[bytes], owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window."""
    size = np.array([len(r) for r in raws])
    hasher = Hasher(np.frombuffer(b"".join(raws), np.uint8))
    at = (np.cumsum(size) - size)[owner] + start
    half = WIDTH // 2
    second = mix(hasher(at, at + half) * _ODD + hasher(at + half, at + WIDTH))
    return hasher(at, at + WIDTH).view(np.int64), second.view(np.int64)


_FOUND = pa.schema([("gram", pa.int64()), ("c", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("alone", pa.bool_())])


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket sorted by anchor: runs of repeated windows (first to last start in the context), and hashes to compare across."""

    def settle(rows: list[tuple], across: bool) -> Iterator[pa.RecordBatch]:
        grams, ids, shifts, offs, raws = zip(*rows, strict=True)
        gram, c, shift = np.array(grams), np.array(ids), np.array(shifts)
        owner, start, cls = sort_suffixes(list(raws), list(offs))
        alone = np.bincount(cls)[cls] == 1

        def found(lo: np.ndarray, hi: np.ndarray, h1: pa.Array, h2: pa.Array, single: pa.Array) -> pa.RecordBatch:
            o = owner[lo]
            places = [pa.array((start[x] + shift[o]).astype(np.int32)) for x in (lo, hi)]
            return pa.RecordBatch.from_arrays([pa.array(gram[o]), pa.array(c[o]), *places, h1, h2, single], schema=_FOUND)

        rep = np.flatnonzero(~alone)
        if len(rep):
            new = np.ones(len(rep), bool)
            new[1:] = (np.diff(rep) > 1) | (np.diff(owner[rep]) != 0)
            lo = rep[new]
            hi = rep[np.append(np.flatnonzero(new)[1:] - 1, len(rep) - 1)]
            yield found(lo, hi, pa.nulls(len(lo), pa.int64()), pa.nulls(len(lo), pa.int64()), pa.nulls(len(lo), pa.bool_()))
        if across:
            _, one = np.unique(cls, return_index=True)
            h1, h2 = _hashes(list(raws), owner[one], start[one])
            yield found(one, one, pa.array(h1), pa.array(h2), pa.array(alone[one]))

    held: list[tuple] = []
    key, last = None, None
    before, resumed = True, False  # no group is over yet; held goes on with the core of the block before
    for batch in batches:
        for core, gram, c, shift, off, raw in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
            if (core, gram, c, off) == last:
                continue  # a copy of the same text
            last = (core, gram, c, off)
            if held and (key != core or len(held) >= MOST):
                goes_on = key == core
                yield from settle(held, before or resumed or goes_on)
                before, resumed, held = before and goes_on, goes_on, []
            key = core
            held.append((gram, c, shift, off, raw))
    if held:
        yield from settle(held, True)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n_bytes, spans and kept bytes from id, text and found intervals."""
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            sizes, spans, kept = [], [], []
            for text, found in zip(part.column(1), part.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                merged: list[list[int]] = []
                for x in sorted((f["lo"], f["hi"]) for f in found.as_py() or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append([*x])
                at, rest = 0, []
                for b, e in merged:
                    rest.append(raw[at:b])
                    at = e
                rest.append(raw[at:])
                sizes.append(len(raw))
                spans.append([{"begin": b, "end": e} for b, e in merged])
                kept.append(b"".join(rest))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"]
            )


def _merged(spans: Column) -> Column:
    """Sorted intervals (lo, hi) with those that touch made one."""

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last.lo.alias("lo"), F.greatest(last.hi, x.hi).alias("hi"))
        return F.when(last.hi >= x.lo, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.slice(spans, 2, F.greatest(F.lit(0), F.size(spans) - 1)), F.slice(spans, 1, 1), add)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (removed, as byte offsets) and kept (the remaining bytes) of every row."""
    spark = docs.sparkSession
    ws = Workspace(spark, "suffixdedup")

    def small(df: DataFrame, listed: str | None = None) -> DataFrame:
        """df for every task if it has few rows, and few entries in its lists; a list's entry counts as a row."""
        size = F.count(F.lit(1)) + (F.coalesce(F.sum(F.size(listed)), F.lit(0)) if listed else F.lit(0))
        return F.broadcast(df) if df.agg(size).first()[0] <= BROADCAST_ROWS else df

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"))
    long = rows.where(F.octet_length("text") >= WIDTH).select("k1", "k2", "text")
    anchors = ws.stage(long.mapInArrow(_anchors, "k1 long, k2 long, gram long, c long, p int, lo int, hi int"), "anchors")
    counts = ws.stage(anchors.groupBy("gram", "c").agg(F.count(F.lit(1)).alias("n")), "contexts")
    grams = counts.groupBy("gram").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    grams = ws.stage(grams.where("total > 1").select("gram", ((F.col("kinds") > 1) & (F.col("least") == 1)).alias("open")), "grams")
    marked = ws.stage(counts.join(small(grams), "gram").where("n > 1 or open").select("gram", "c", (F.col("n") > 1).alias("whole"), "open"), "marked")
    found = ws.stage(anchors.join(small(marked), ["gram", "c"]), "found")
    ws.drop("contexts", "grams")

    place = F.struct("k1", "k2", "p", "lo", "hi")
    chosen = found.where("open").groupBy("gram", "c").agg(F.min(place).alias("at")).select("gram", "c", "at.*")
    wanted = ws.stage(chosen.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "c", "p", "lo", "hi")).alias("wanted")), "wanted")
    kinds = "gram long, c long, core long, own long, p int, d0 int, d1 int, shift int"
    pieces = long.join(small(wanted, "wanted"), ["k1", "k2"]).select("text", "wanted").mapInArrow(_stretches, kinds).dropDuplicates(["gram", "c", "d1"])
    pieces = ws.stage(pieces, "stretches")
    counts = ws.stage(pieces.groupBy("core", "own").agg(F.count(F.lit(1)).alias("n")), "owns")
    cores = counts.groupBy("core").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    cores = ws.stage(cores.where("total > 1").select("core", ((F.col("kinds") > 1) & (F.col("least") == 1)).alias("mixed")), "cores")
    settled = ws.stage(counts.join(small(cores), "core").where("n > 1 or mixed").select("core", "own", (F.col("n") > 1).alias("twice"), "mixed"), "settled")
    pieces = ws.stage(pieces.join(small(settled), ["core", "own"]), "pieces")
    ws.drop("stretches", "owns", "cores")
    # one of each kind goes to be sorted
    pick = F.struct("gram", "c", "p", "d0", "d1", "shift")
    single = pieces.where("mixed").groupBy("core", "own").agg(F.min(pick).alias("s")).select("core", "s.*")
    texts_of = chosen.select("gram", "c", "k1", "k2")
    listed = single.join(texts_of, ["gram", "c"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("core", "gram", "c", "p", "d0", "d1", "shift")).alias("wanted"))
    listed = ws.stage(listed, "listed")
    cut = long.join(small(listed, "wanted"), ["k1", "k2"]).select("text", "wanted").mapInArrow(_cut, "lead binary, core long, gram long, c long, shift int, off int, raw binary")
    cut = ws.stage(cut, "cut")
    n = cut.count()
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["lead", "core", "gram", "c", "off"]
    buckets = cut.repartitionByRange(max(shuffle, -(-n // BUCKET)), *order).sortWithinPartitions(*order)
    result = ws.stage(buckets.mapInArrow(_sorted, "gram long, c long, first int, last int, h1 long, h2 long, alone boolean"), "sorted")
    open_rows = result.where("h1 is not null")
    shared = ws.stage(open_rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"), "across")
    over = open_rows.where("alone").join(small(shared), ["h1", "h2"]).select("gram", "c", "first", "last")
    again = pieces.where("twice").select("gram", "c", F.col("shift").alias("first"), (F.col("shift") + F.col("d1") - F.col("d0")).alias("last"))
    runs = ws.stage(result.where("h1 is null").select("gram", "c", "first", "last").unionByName(over).unionByName(again), "runs")

    whole = found.where("whole").select("k1", "k2", "lo", (F.col("hi") + WIDTH).alias("hi"))
    parts = found.where("open and not whole").join(small(runs), ["gram", "c"])
    parts = parts.select("k1", "k2", (F.col("lo") + F.col("first")).alias("lo"), (F.col("lo") + F.col("last") + WIDTH).alias("hi"))
    both = whole.unionByName(parts).groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("all"))
    spans = ws.stage(both.select("k1", "k2", _merged(F.col("all")).alias("found")), "spans")
    held = spans.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(spans) if held <= 2 * BROADCAST_ROWS else spans, ["k1", "k2"], "left").select("doc_id", "text", "found")
    out = joined.mapInArrow(_removed, "doc_id long, n_bytes long, spans array<struct<begin:int,end:int>>, kept binary")
    return out.withColumnRenamed("doc_id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """Bytes of every document that stand in repeated 400-byte strings, and a digest of the rest."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["begin"]))
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
