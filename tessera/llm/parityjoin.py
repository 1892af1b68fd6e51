"""Similarity join of word n-gram sets by parity sketches.

A document's set has the distinct hashes of its word n-grams. In a band of sizes, a sketch of p blocks is kept for each
set: every member flips one bit of one block, so the Hamming distance of two sketches is at most the sets' symmetric
difference. Sets whose Jaccard similarity reaches the threshold differ in at most T members, T given by their sizes, so
all but T blocks are equal (pigeonhole). A block has 2**16 bits and is named by the exclusive or of a random number for
each bit that is set. Bands are so wide that a partner is in the same band or the next, and every set is sketched for its
own band and the one below.

Blocks without a set bit are equal in very many sets and say nothing, so they are not joined. With p = T + 1 + k blocks
two similar sets still share a block with bits, if one of the two has k empty blocks at most; k is chosen so that nearly
every set has. The sets that have more are sketched once more with other hashes, and so on; two of them meet there. What
is left after `SEEDS` sketches (with thresholds so low that no sketch can do) joins by its empty blocks as well, so the
join is exact at every threshold.

Sets that share a block are candidates; those whose sizes and short sketches allow it get their exact similarity verified. What is wanted is classes of
linked documents, so candidates that earlier links have joined already need no test. In every block's group, the
members are tested against a leader (the one with the least hash, which leads most groups that it is in) and the linked
ones join. Groups of at most `PAIRED` members that still hold several classes are compared pair by pair, which is a bounded
number of pairs for each row. Members of larger ones are joined by their rarest n-grams (a prefix filter, exact as well).
No link between different classes is lost, and large groups of near copies cost a few tests for each member.

Documents with equal sets are one node. Shuffles carry hashes; the sets themselves travel only for candidates. Tables
are broadcast behind a count of their rows, and joined by a shuffle beyond.

Null and empty texts, and texts without words, have no set and are linked with nothing. Texts of fewer than n words
have one n-gram, the whole. Repeated rows are linked. Null ids take part and are never a component's name; a component
without any id has a null one. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .textbytes import LOWER, Block, Hasher, blocks, mix
from .workspace import Workspace

BROADCAST_ROWS = 2_000_000
#: Members of all leaders' sets together that are broadcast at most.
BROADCAST_MEMBERS = 4_000_000
#: Sketches of a set with too many empty blocks, before these are joined too.
SEEDS = 8
#: 64-bit words of the short sketch that rules out pairs before their sets are read.
WORDS = 16
#: Members besides the leader of a block's group whose pairs are formed within it; larger groups take the prefix filter.
PAIRED = 64
#: Buckets of counts that tell rare members from frequent ones in the order of the prefix filter.
BUCKETS = 1 << 16
#: Members by which halves of members must tell a pair from the threshold at least.
NEAR = 6
#: Members of sets that a task works on at once.
MEMBERS = 1 << 18
_ODD = np.uint64(0xD6E8FEB86659FD93)


def shingles(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts and hashes of their distinct word n-grams, sorted by both."""
    begin, end, text = block.words()
    word = Hasher(LOWER[block.data])(begin, end)
    count = np.bincount(text, minlength=len(block.begin))
    first = np.cumsum(count) - count
    owners, grams = [], []
    for k in range(1, n + 1):
        at = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if k == n else first[count == k]
        gram = np.full(len(at), k, np.uint64)
        for j in range(k):
            gram = mix(gram * _ODD + word[at + j])
        owners.append(text[at])
        grams.append(gram)
    owner, gram = np.concatenate(owners), np.concatenate(grams)
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.ones(len(gram), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    return owner[new], gram[new]


def _at_most(k: int, mean: float) -> float:
    """About the chance that k or fewer blocks are empty where `mean` are on average (Poisson, or normal for large means)."""
    if mean > 60:
        return 0.5 * (1 + math.erf((k + 0.5 - mean) / math.sqrt(2 * mean)))
    return math.fsum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(min(k, 400) + 1)) if mean else 1.0


class Bands:
    """Bands of set sizes for a threshold in hundredths."""

    def __init__(self, percent: int):
        self.percent, self.low = percent, [1]
        self.known: dict[int, tuple[int, int]] = {}

    def _reach(self, size: int) -> None:
        while self.low[-1] <= size:
            self.low.append(100 * self.low[-1] // self.percent + 1)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self._reach(int(sizes.max(initial=1)))
        return np.searchsorted(np.array(self.low), sizes, "right") - 1

    def widths(self, band: int) -> tuple[int, int]:
        """Blocks of a sketch in the band, and how many of them may be empty.

        There is one more than the largest symmetric difference of a similar pair whose smaller set is in the band, and
        one for each that may be empty: about as many as make the fewest blocks in all, with those of the sets sketched
        again. -1: so low a threshold leaves empty blocks in every sketch, and they are joined at once.
        """
        if band not in self.known:
            while len(self.low) < band + 3:
                self.low.append(100 * self.low[-1] // self.percent + 1)
            size, a, b = self.low[band], self.low[band + 1] - 1, self.low[band + 2] - 1
            least = (100 - self.percent) * (a + b) // (100 + self.percent) + 1
            # With more blocks than members some stay empty at any number: then there is no such number.
            best, k = (math.inf, -1), 0
            while least <= size and least + k < best[0] and least + k <= 2 * size + 2:
                p = least + k
                best = min(best, (p / max(_at_most(k, p * (1 - 1 / p) ** size), 1e-9), k))
                k += 1 + k // 64
            if best[1] < 0:
                self.known[band] = (least, -1)
                return self.known[band]
            self.known[band] = (least + best[1], best[1])
        return self.known[band]


def sketches(owner: np.ndarray, gram: np.ndarray, sizes: np.ndarray, bands: Bands, below: int, seeds: int = SEEDS) -> tuple[np.ndarray, np.ndarray]:
    """Owners and names of the sketch blocks for each set's band less `below`; sets without such a band have none."""
    band = bands.of(np.maximum(1, sizes)) - below
    pending = (band >= 0) & (sizes > 0)
    table = np.array([bands.widths(b) for b in range(int(band.max(initial=-1)) + 1)] or [(1, 0)], np.int64)
    width, spare = table[np.maximum(band, 0)].T
    owners, names = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for seed in range(seeds):
        p = np.where(pending, width, 0)
        start = np.cumsum(p) - p
        keep = pending[owner]
        o, g = owner[keep], gram[keep]
        h = mix(g ^ np.uint64(0xA24BAED4963EE407 + (seed << 1)))
        block = (h >> np.uint64(32)) * p[o].astype(np.uint64) >> np.uint64(32)
        out = np.zeros(int(p.sum()), np.uint64)
        np.bitwise_xor.at(out, start[o] + block.astype(np.int64), mix((h & np.uint64(0xFFFF)) + np.uint64(1)))
        who = np.repeat(np.arange(len(sizes)), p)
        where = np.arange(len(out)) - start[who]
        name = mix(out ^ mix((band[who].astype(np.uint64) << np.uint64(32)) + (where * seeds + seed).astype(np.uint64) + np.uint64(7)))
        empty = out == 0
        pending &= np.bincount(who[empty], minlength=len(sizes)) > spare
        joined = pending if seed == seeds - 1 else pending & (spare < 0)
        pending &= ~joined
        full = ~empty | joined[who]
        owners.append(who[full])
        names.append(name[full])
        if not pending.any():
            break
    return np.concatenate(owners), np.concatenate(names)


def parities(owner: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    """A short parity sketch of each set: WORDS * 64 bits, of which every member flips one."""
    bit = mix(gram ^ np.uint64(0x8CB92BA72F3D8DD7)) % np.uint64(64 * WORDS)
    out = np.zeros(n * WORDS, np.uint64)
    np.bitwise_xor.at(out, owner * WORDS + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(n, WORDS)


def _sums(owner: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    edge = np.searchsorted(owner, np.arange(n + 1))
    out = []
    for salt in (1, 2):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(gram + np.uint64(salt)))])
        out.append(mix(total[edge[1:]] - total[edge[:-1]] + (edge[1:] - edge[:-1]).astype(np.uint64)))
    return out[0].view(np.int64), out[1].view(np.int64)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, k, n, a, b, parity: hash of each row's text; size, hashes and short parity sketch of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in blocks(batch.column(1)):
                owner, gram = shingles(block, n)
                m = len(block.begin)
                a, b = _sums(owner, gram, m)
                size = np.bincount(owner, minlength=m)
                own = [batch.column(0).slice(first, m), batch.column(2).slice(first, m)]
                short = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * WORDS), pa.array(parities(owner, gram, m).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (size, a, b)), short], names=["doc_id", "k", "n", "a", "b", "parity"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("k")).mapInArrow(run, "doc_id long, k long, n long, a long, b long, parity array<long>")


def _blocks(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """sig, id: names of the sketch blocks of each row's set. A set seen shortly before in the partition isn't repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for batch in batches:
            for _, block in blocks(batch.column(0)):
                owner, gram = shingles(block, n)
                m = len(block.begin)
                ids, _ = _sums(owner, gram, m)
                fresh = np.zeros(m, bool)
                for i, x in enumerate(ids.tolist()):
                    if x not in seen:
                        fresh[i] = True
                        seen.add(x)
                if len(seen) > 100_000:
                    seen.clear()
                sizes = np.where(fresh, np.bincount(owner, minlength=m), 0)
                for below in (0, 1):
                    who, name = sketches(owner, gram, sizes, bands, below)
                    yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(ids[who])], names=["sig", "id"])

    return docs.mapInArrow(run, "sig long, id long")


def _members(docs: DataFrame, n: int, halves: bool = False) -> DataFrame:
    """id and set of each row; halves: the upper 32 bits of every member, as many as there are members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, block in blocks(batch.column(0)):
                owner, gram = shingles(block, n)
                m = len(block.begin)
                ids, _ = _sums(owner, gram, m)
                edge = np.searchsorted(owner, np.arange(m + 1)).astype(np.int32)
                held = (gram >> np.uint64(32)).astype(np.uint32).view(np.int32) if halves else gram.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(edge), pa.array(held))], names=["id", "set"])

    return docs.mapInArrow(run, f"id long, set array<{'int' if halves else 'long'}>")


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `MEMBERS` members of the sets in the column, so a task holds few of them at once."""
    ends = np.cumsum(np.asarray(batch.column(column).value_lengths().fill_null(0), np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MEMBERS, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _bucket_counts(sets: DataFrame) -> DataFrame:
    """b, c: how many members of the sets (id, set, ...) fall into each hashed bucket; a row for each task and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for part in (p for batch in batches for p in _slices(batch, 0)):
            counts += np.bincount(_bucket(np.asarray(part.column(0).flatten(), np.int64)), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["b", "c"])

    return sets.select("set").mapInArrow(run, "b long, c long")


def _bucket(members: np.ndarray) -> np.ndarray:
    return (mix(members.view(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def _rare_first(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """e, id, label: the first members of each set, in order of their bucket's count and then of the member itself."""
    held = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _slices(batch, 2)):
            members = np.asarray(part.column(2).flatten(), np.int64)
            sizes = np.asarray(part.column(2).value_lengths(), np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((members, held.value[_bucket(members)], owner))
            rank = np.arange(len(members)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            prefix = sizes + 1 - -(-sizes * percent // 100)
            keep = order[rank < prefix[owner]]
            at = pa.array(owner[keep])
            yield pa.RecordBatch.from_arrays([pa.array(members[keep]), part.column(0).take(at), part.column(1).take(at)], names=["e", "id", "label"])

    return sets.select("id", "label", "set").mapInArrow(run, "e long, id long, label long")


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key (its text's hash), n_shingles and component_id of every row of docs."""
    ws = Workspace(docs.sparkSession, "parityjoin")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    def once_each(table: DataFrame) -> DataFrame:
        """The text of one row of each set; rows equal in id and text may come again."""
        own = F.struct("k", "doc_id")
        twice = ws.stage(table.groupBy("a").agg(F.min(own).alias("of"), F.max(own).alias("other")).where("of <> other").select("a", "of"), "twice")
        go = table.join(small(twice), "a").where(~own.eqNullSafe(F.col("of"))).select(F.col("k").alias("go_k"), F.col("doc_id").alias("go_id")).distinct()
        go = ws.stage(go, "copies")
        return rows.join(small(go), (F.xxhash64("text") == F.col("go_k")) & F.col("doc_id").eqNullSafe(F.col("go_id")), "left_anti").select("text")

    table = ws.stage(_sets(rows, n), "table")
    blocks_of = _blocks(once_each(table), n, percent)
    # nearly every set comes once here, so a count tells shared blocks and no id need travel; members settle what doesn't
    shared = ws.stage(blocks_of.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("sig"), "shared")
    held = ws.stage(blocks_of.join(small(shared), "sig").select("sig", "id").distinct(), "held")
    leaders = held.groupBy("sig").agg(F.min("id").alias("u"), F.max("id").alias("other")).where("u <> other").select("sig", "u")
    members = ws.stage(held.join(small(ws.stage(leaders, "leaders")), "sig"), "members")
    nodes = ws.stage(members.select("id").distinct(), "nodes")

    # of every candidate the size and short sketch, and the rows of one text and id that have its set
    ours = table.join(small(nodes.select(F.col("id").alias("a"))), "a")
    one = ours.groupBy("a").agg(F.min(F.struct("k", "doc_id")).alias("of"))
    one = ws.stage(one.select(F.col("a").alias("id"), F.col("of.k").alias("of_k"), F.col("of.doc_id").alias("of_id")), "chosen")
    shorts = ws.stage(ours.select(F.col("a").alias("id"), "n", "parity").dropDuplicates(["id"]), "shorts")
    ws.drop("shared", "twice", "copies", "held", "leaders")

    def texts_of(ids: DataFrame, name: str, halves: bool = False) -> DataFrame:
        """id and set of the ids, made anew from their texts where they are read."""
        texts = ws.stage(one.join(small(ids), "id", "left_semi"), f"{name}-texts")
        same = (F.xxhash64("text") == F.col("of_k")) & F.col("doc_id").eqNullSafe(F.col("of_id"))
        return _members(rows.join(small(texts.drop("id")), same).select("text"), n, halves)

    def sets_of(ids: DataFrame, name: str, halves: bool = False) -> DataFrame:
        """The sets of the ids; only these texts are read to the end."""
        sets = ws.stage(texts_of(ids, name, halves).join(small(ids), "id", "left_semi"), f"{name}-sets")
        return ws.stage(sets.dropDuplicates(["id"]), f"{name}-once") if sets.count() > ids.count() else sets  # repeated rows

    def within_bounds(pairs: DataFrame) -> DataFrame:
        """The pairs whose sizes and short parity sketches allow the similarity; the sets themselves aren't read."""
        both = pairs
        for side in ("u", "v"):
            both = both.join(shorts.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("parity").alias(f"p{side}")), side)
        apart = sum((F.bit_count(F.get(F.col("pu"), F.lit(i)).bitwiseXOR(F.get(F.col("pv"), F.lit(i)))) for i in range(WORDS)), F.lit(0))
        sizes = (F.col("nu") * 100 >= F.col("nv") * percent) & (F.col("nv") * 100 >= F.col("nu") * percent)
        return both.where(sizes & (apart * (100 + percent) <= (F.col("nu") + F.col("nv")) * (100 - percent))).select(*pairs.columns)

    def compared(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """u, v, nu, nv, over: by how much the similarity of the pairs (u, v) passes the threshold, in whole numbers; there are few different u."""
        left = ws.stage(sets.join(pairs.select(F.col("u").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("u"), F.col("set").alias("su")), f"{name}-leaders")
        held = left.agg(F.coalesce(F.sum(F.size("su")), F.lit(0))).first()[0]
        both = small(pairs).join(sets.select(F.col("id").alias("v"), F.col("set").alias("sv")), "v").join(F.broadcast(left) if held <= BROADCAST_MEMBERS else left, "u")
        shared = F.size(F.array_intersect("su", "sv"))
        both = both.select("u", "v", F.size("su").alias("nu"), F.size("sv").alias("nv"), shared.alias("shared"))
        return both.withColumn("over", F.col("shared") * (100 + percent) - percent * (F.col("nu") + F.col("nv"))).drop("shared")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (u, v) whose similarity reaches the threshold.

        Halves of the members tell nearly all pairs: among nu + nv of them about (nu + nv)^2 / 2^33 are equal without being
        one member. Pairs that are nearer to the threshold than `NEAR` members and 64 times that number are compared once
        more by whole members.
        """
        sides = lambda p: p.select(F.col("u").alias("id")).union(p.select(F.col("v").alias("id"))).distinct()
        sets = sets_of(ws.stage(sides(pairs), f"{name}-ids"), name, True)
        sure = (100 + percent) * (NEAR + F.pow(F.col("nu") + F.col("nv"), 2) / (1 << 27))
        told = ws.stage(compared(pairs, sets, name).select("u", "v", F.when(F.col("over") > sure, True).when(F.col("over") < -sure, False).alias("linked")), f"{name}-told")
        ws.drop(*(f"{name}-{x}" for x in ("ids", "texts", "sets", "once", "leaders")))
        links = told.where("linked").select("u", "v")
        unsure = told.where("linked is null").select("u", "v")
        if unsure.isEmpty():
            return links
        sets = sets_of(ws.stage(sides(unsure), f"{name}-near-ids"), f"{name}-near")
        return links.unionByName(compared(unsure, sets, f"{name}-near").where("over >= 0").select("u", "v"))

    def prefix_pairs(left: DataFrame) -> DataFrame:
        """Candidates (u, v, lu, label) of different classes among the (id, label) that the star left over.

        Similar sets share one of their first members in any one order of all members (prefix filter). The order here
        has rare members first, so what an edit brought in stands in the prefix, and what thousands of near copies have
        in common does not; rare is told by counts over `BUCKETS` hashed buckets, which the driver holds. Only prefixes
        are written. Members whose sets are of one class only need no pair. Of the rest, pairs go whose short parity
        sketches differ in more bits than their sets may differ in members.
        """
        mine = texts_of(left.select("id"), "left").join(small(left), "id")
        counts = np.zeros(BUCKETS, np.int64)
        for r in _bucket_counts(mine).groupBy("b").agg(F.sum("c").alias("c")).collect():  # BUCKETS rows at most
            counts[r["b"]] = r["c"]
        each = ws.stage(_rare_first(mine, counts, percent), "each")
        mixed = each.groupBy("e").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("e")
        first = each.join(small(ws.stage(mixed, "kinds")), "e").distinct()
        words = shorts.select("id", "n", *(F.get("parity", F.lit(i)).alias(f"p{i}") for i in range(WORDS)))
        first = ws.stage(first.join(words, "id"), "prefixes")
        other = first.select("e", F.col("id").alias("u"), F.col("label").alias("lu"), F.col("n").alias("nu"), *(F.col(f"p{i}").alias(f"q{i}") for i in range(WORDS)))
        sizes = (F.col("n") * 100 >= F.col("nu") * percent) & (F.col("nu") * 100 >= F.col("n") * percent)
        apart = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"q{i}"))) for i in range(WORDS)), F.lit(0))
        near = apart * (100 + percent) <= (F.col("n") + F.col("nu")) * (100 - percent)
        return first.join(other, "e").where((F.col("label") < F.col("lu")) & sizes & near).select("u", F.col("id").alias("v"), "lu", "label")

    def joined(labels: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        """(id, label) after the links among the pairs (u, v, lu, label)."""
        pairs = ws.stage(pairs.distinct(), f"{name}-pairs")
        links = verified(pairs.select("u", "v"), name).join(pairs, ["u", "v"]).select(F.col("lu").alias("u"), F.col("label").alias("v")).distinct()
        links = ws.stage(links, f"{name}-links")
        if not links.isEmpty():
            merged = components(ws, links, f"{name}-merged").select(F.col("id").alias("label"), F.col("label").alias("to"))
            labels = ws.stage(labels.join(small(merged), "label", "left").select("id", F.coalesce("to", "label").alias("label")), f"{name}-labels")
        ws.drop(*(f"{name}-{x}" for x in ("pairs", "told", "links")), *(f"{name}-near-{x}" for x in ("ids", "texts", "sets", "once", "leaders")))
        return labels

    labels = nodes.select("id", F.col("id").alias("label"))
    star = within_bounds(ws.stage(members.where("id <> u").select("u", F.col("id").alias("v")).distinct(), "candidates"))
    labels = joined(labels, star.select("u", "v", F.col("u").alias("lu"), F.col("v").alias("label")), "star")
    rest = members.where("id <> u").select("sig", "id")

    def still_mixed(rows: DataFrame, name: str) -> DataFrame:
        """sig and number of rows (sig, id, label) of the groups with several classes."""
        classes = rows.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("c"))
        return ws.stage(classes.where("lo <> hi").select("sig", "c"), name)

    mixed = still_mixed(rest.join(small(labels), "id"), "mixed")
    if not mixed.where(F.col("c") <= PAIRED).isEmpty():
        few = rest.join(small(mixed.where(F.col("c") <= PAIRED).select("sig")), "sig", "left_semi").join(small(labels), "id")
        few = ws.stage(few.select("sig", "id", "label"), "few")
        other = few.select("sig", F.col("id").alias("u"), F.col("label").alias("lu"))
        pairs = few.join(other, "sig").where(F.col("label") < F.col("lu")).select("u", F.col("id").alias("v"), "lu", "label").distinct()
        labels = joined(labels, within_bounds(pairs), "pairs")
    many = mixed.where(F.col("c") > PAIRED).select("sig")
    if not many.isEmpty():
        held = rest.join(small(many), "sig", "left_semi").join(small(labels), "id")
        kinds = still_mixed(held, "many")
        left = ws.stage(held.join(small(kinds.select("sig")), "sig", "left_semi").select("id", "label").distinct(), "left")
        if not left.isEmpty():
            labels = joined(labels, prefix_pairs(left), "rest")
    ws.drop("few", "many")
    # the nodes stay: without any link the labels are read from them
    ws.drop("candidates", "members", "chosen", "shorts", "mixed", "left", "left-texts", "each", "kinds", "prefixes")

    smallest = table.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    smallest = ws.stage(smallest, "classes")
    linked = smallest.join(small(labels), smallest.a == labels.id)
    named = linked.join(small(ws.stage(linked.groupBy("label").agg(F.min("least").alias("component")), "components")), "label").select("a", "b", "component")
    other = smallest.where("copies > 1").join(labels, smallest.a == labels.id, "left_anti").select("a", "b", F.col("least").alias("component"))
    named = ws.stage(named.unionByName(other), "named")
    return table.join(small(named), ["a", "b"], "left").select(
        F.col("doc_id").alias(id_col), F.col("k").alias("text_key"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near duplicates, the one with the smallest id.

    Of rows equal in id and text one stays. Rows without an id stay unless linked to one with an id; rows without a set stay.
    """
    ws = Workspace(docs.sparkSession, "keepone")
    found = ws.stage(near_duplicates(docs, n, percent, id_col, text_col), "found")
    own = F.col(id_col)
    go = ws.stage(found.where(F.col("component_id").isNotNull() & ~own.eqNullSafe(F.col("component_id"))).select(own.alias("go_id"), F.col("text_key").alias("go_key")).distinct(), "go")
    twice = found.where("n_shingles > 0").groupBy(own.alias("go_id"), F.col("text_key").alias("go_key")).agg(F.count(F.lit(1)).alias("c"))
    twice = ws.stage(twice.where("c > 1 and go_id is not null").select("go_id", "go_key"), "twice")

    def pick(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
        return df.join(keys, (F.xxhash64(df[text_col]) == keys.go_key) & df[id_col].eqNullSafe(keys.go_id), how)

    stay = pick(docs, go, "left_anti")
    if twice.isEmpty():
        return stay
    return pick(stay, twice, "left_anti").unionByName(pick(stay, twice, "left_semi").dropDuplicates([id_col, text_col]))


def query(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles and components of all documents at a Jaccard similarity of 0.9."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 190 * k >= 90 * (x.n + y.n)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id AS node, doc_id AS top FROM d UNION SELECT b.v, r.top FROM r JOIN b ON b.u = r.node)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.top) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
"""
