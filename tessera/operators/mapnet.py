"""Semantic map: assignment to nodes, batch training, growth, graphs, paths, quantization.

Nodes are few (tens to some thousands) and vectors are many. Where nodes meet vectors, all nodes travel as one array in
one row, built from a table whose size is checked (`MAX_NODES`), so a vector's nearest node is found within its row:
no row is multiplied by the number of nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vec as V
from ..functions.vec import digest_vector
from ..sources.workspace import Workspace

#: Nodes that are sent to every task at most: at 64 dimensions about 50 MB.
MAX_NODES = 100_000


def packed(nodes: DataFrame, *cols: str) -> DataFrame:
    """One row: nodes, an array of (node_id, cols) in order of node_id."""
    n = nodes.count()
    if n > MAX_NODES:
        raise ValueError(f"{n} nodes; assignment holds {MAX_NODES} at most in a task")
    return nodes.agg(F.array_sort(F.collect_list(F.struct("node_id", *cols))).alias("nodes"))


def ranked(vectors: DataFrame, nodes: DataFrame, k: int, vec: str = "vec") -> DataFrame:
    """vectors with near: the k nearest nodes as (d2, node_id), ties by id."""
    one = packed(nodes, "w")
    d2 = F.transform("nodes", lambda n: F.struct(V.squared_distance(F.col(vec), n.w).alias("d2"), n.node_id.alias("node_id")))
    near = F.array(F.array_min(d2)) if k == 1 else F.slice(F.array_sort(d2), 1, k)
    return vectors.crossJoin(F.broadcast(one)).withColumn("near", near).drop("nodes")  # one row, checked above


def bmu(vectors: DataFrame, nodes: DataFrame, vec: str = "vec") -> DataFrame:
    """vectors with bmu and qe (the distance)."""
    out = ranked(vectors, nodes, 1, vec)
    return out.withColumn("bmu", F.col("near")[0].node_id).withColumn("qe", F.sqrt(F.col("near")[0].d2)).drop("near")


def bmu2(vectors: DataFrame, nodes: DataFrame, vec: str = "vec") -> DataFrame:
    """vectors with the two nearest nodes (second null if there is but one)."""
    out = ranked(vectors, nodes, 2, vec)
    return out.withColumn("bmu", F.col("near")[0].node_id).withColumn("qe", F.sqrt(F.col("near")[0].d2)).withColumn("second", F.get("near", F.lit(1)).node_id).drop("near")


def bmu_arrow(vectors: DataFrame, nodes: DataFrame, id_col: str = "vec_id", vec: str = "vec") -> DataFrame:
    """id, bmu, qe for large maps: a matrix product for each Arrow batch, in blocks of 2**22 distances."""
    rows = nodes.orderBy("node_id").limit(MAX_NODES + 1).select("node_id", "w").toArrow()
    if rows.num_rows > MAX_NODES:
        raise ValueError("too many nodes")
    ids = rows.column("node_id").to_numpy()
    w = np.array(rows.column("w").to_pylist(), float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (w * w).sum(1)
        for batch in batches:
            step = max(1, (1 << 22) // max(1, len(w)))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                x = np.array(part.column(1).to_pylist(), float)
                best = (half - 2 * (x @ w.T)).argmin(1)
                qe = np.sqrt(((x - w[best]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids[best]), pa.array(qe)], names=[id_col, "bmu", "qe"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, vec).mapInArrow(run, f"{id_col} {kind}, bmu {nodes.schema['node_id'].dataType.simpleString()}, qe double")


def _normals(key: Column, dim: int, spread: float) -> Column:
    """An array of normal numbers made of a key's digests, so that any run and any SQL engine gives the same."""
    return F.transform(digest_vector(key, dim), lambda x: x * spread)


def places(ids: DataFrame, seed: int = 0) -> DataFrame:
    """node_id, cx, cy: where a new map's nodes lie."""
    at = _normals(F.concat(F.lit(f"place {seed} "), F.col("node_id").cast("string")), 2, 1.0)
    return ids.select("node_id", at.alias("_at")).select("node_id", F.col("_at")[0].alias("cx"), F.col("_at")[1].alias("cy"))


def init_nodes(spark: SparkSession, n: int = 16, dim: int = 64, seed: int = 0) -> DataFrame:
    """A new map: n nodes with small normal weights, normal places and no error."""
    ids = spark.range(n).select(F.col("id").alias("node_id"))
    w = _normals(F.concat(F.lit(f"weight {seed} "), F.col("node_id").cast("string")), dim, 0.3)
    return places(ids, seed).select("node_id", w.alias("w"), "cx", "cy", F.lit(0.0).alias("err"))


def reinit(vectors: DataFrame, id_col: str = "vec_id", vec: str = "vec", most: int = 36, noise: float = 0.01, seed: int = 0) -> DataFrame:
    """A new map of the vectors' own dimension: node_id, id (of the vector it starts from), w, cx, cy, err.

    `most` vectors are drawn without replacement, those whose ids have the least digests: the same ones in any run and
    on any layout of the table, found by a top-k and not a sort. Rows of one id count once; null vectors not at all. With
    fewer vectors there are fewer nodes; places and errors follow their number.
    """
    rows = vectors.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
    rows = rows.withColumn("h", F.md5(F.concat(F.lit(f"{seed} "), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    least = rows.select("h").distinct().orderBy("h").limit(most)
    drawn = rows.join(F.broadcast(least), "h").groupBy("h").agg(F.min(F.struct("v", "id")).alias("r"))  # `most` rows
    number = (F.row_number().over(Window.orderBy("h")) - 1).cast("long")  # `most` rows
    nodes = drawn.select(number.alias("node_id"), F.col("r.id").alias("id"), F.col("r.v").alias("v"), "h")
    shaken = F.zip_with("v", digest_vector(F.concat(F.lit("noise "), F.col("h")), F.size("v")), lambda x, z: x + z * noise)
    w = shaken if noise else F.col("v")
    at = places(nodes.select("node_id"), seed)
    return nodes.select("node_id", "id", w.alias("w")).join(F.broadcast(at), "node_id").select("node_id", "id", "w", "cx", "cy", F.lit(0.0).alias("err"))


def scales(nodes: DataFrame) -> DataFrame:
    """dim, scale: the largest magnitude of each dimension plus 1e-8, over 127."""
    return nodes.select(F.posexplode("w").alias("dim", "x")).groupBy("dim").agg(((F.max(F.abs("x")) + 1e-8) / 127).alias("scale"))


def scale_array(nodes: DataFrame) -> DataFrame:
    return scales(nodes).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "scale"))), lambda s: s.scale).alias("scale"))


def scale_array_of(quantized: DataFrame) -> DataFrame:
    """One row with the scale that quantized nodes carry."""
    return quantized.agg(F.first("scale").alias("scale"))


def quantized(nodes: DataFrame) -> DataFrame:
    """nodes with wq (INT8) and the scale."""
    return nodes.crossJoin(F.broadcast(scale_array(nodes))).withColumn("wq", F.zip_with("w", "scale", V.quantize))  # one row


def dequantized(nodes: DataFrame) -> DataFrame:
    """Quantized nodes with w read back from wq."""
    return nodes.withColumn("w", F.zip_with("wq", "scale", lambda q, s: q * s))


def bmu_int8(vectors: DataFrame, nodes: DataFrame, vec: str = "vec") -> DataFrame:
    """vectors with bmu and d2 in INT8 space: vectors are quantized with the nodes' scale."""
    q = quantized(nodes).select("node_id", F.transform("wq", lambda x: x.cast("double")).alias("w"))
    scaled = vectors.crossJoin(F.broadcast(scale_array(nodes)))  # one row
    scaled = scaled.withColumn("vq", F.zip_with(vec, "scale", lambda x, s: V.quantize(x, s).cast("double"))).drop("scale")
    out = ranked(scaled, q, 1, "vq")
    return out.withColumn("bmu", F.col("near")[0].node_id).withColumn("d2", F.col("near")[0].d2.cast("long")).drop("near", "vq")


def sums_by_bmu(assigned: DataFrame, vec: str = "vec") -> DataFrame:
    """node_id, dim, s, n: sums of the vectors of each node; partial sums first."""
    long = assigned.select(F.col("bmu").alias("node_id"), F.posexplode(vec).alias("dim", "x"))
    return long.groupBy("node_id", "dim").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))


def batch_round(vectors: DataFrame, nodes: DataFrame, radius: float, vec: str = "vec", lattice: bool = False) -> DataFrame:
    """One round of the batch map: each node becomes the kernel-weighted mean of all vectors.

    Kernel exp(-d2 / 2r2) of the nodes' places; on a lattice nothing beyond the radius. Nodes that no vector reaches stay.
    """
    sums = sums_by_bmu(bmu(vectors, nodes, vec), vec)
    place = nodes.select("node_id", "cx", "cy")
    other = place.select(F.col("node_id").alias("src"), F.col("cx").alias("sx"), F.col("cy").alias("sy"))
    g2 = F.pow(F.col("cx") - F.col("sx"), F.lit(2.0)) + F.pow(F.col("cy") - F.col("sy"), F.lit(2.0))
    kernel = place.crossJoin(F.broadcast(other)).select("node_id", "src", g2.alias("g2"), F.exp(-g2 / (2 * radius * radius)).alias("h"))  # nodes x nodes, checked by packed()
    if lattice:
        kernel = kernel.where(F.col("g2") <= radius * radius)
    joined = kernel.join(sums.withColumnRenamed("node_id", "src"), "src")
    means = joined.groupBy("node_id", "dim").agg((F.sum(F.col("h") * F.col("s")) / F.sum(F.col("h") * F.col("n"))).alias("x"))
    new = means.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda v: v.x).alias("w_new"))
    return nodes.join(new, "node_id", "left").withColumn("w", F.coalesce("w_new", "w")).drop("w_new")


def growth(nodes: DataFrame, threshold: float = 2.0, most: int = 4) -> DataFrame:
    """node_id, err, child_id of the nodes that grow: the largest errors, down to the threshold; children get the next ids."""
    top = nodes.where(F.col("err") >= threshold).orderBy(F.desc("err"), "node_id").limit(most)
    last = nodes.agg((F.max("node_id") + 1).alias("next"))
    number = F.row_number().over(Window.orderBy(F.desc("err"), "node_id"))  # `most` rows
    return top.crossJoin(F.broadcast(last)).select("node_id", "err", (F.col("next") + number - 1).alias("child_id"))  # one row


def grown(nodes: DataFrame, threshold: float = 2.0, most: int = 4, seed: int = 0) -> DataFrame:
    """nodes and their children: a child's weights and place are its parent's plus noise; the parent's error halves."""
    pick = growth(nodes, threshold, most)

    key = F.concat(F.lit(f"child {seed} "), F.col("child_id").cast("string"))  # digests, so that a rerun gives the same child
    at = digest_vector(F.concat(key, F.lit(" at")), 2)
    parents = nodes.join(F.broadcast(pick.select("node_id", "child_id")), "node_id", "left")
    kids = parents.where("child_id is not null").select(
        F.col("child_id").alias("node_id"),
        F.zip_with("w", digest_vector(F.concat(key, F.lit(" w")), F.size("w")), lambda x, z: x + 0.1 * z).alias("w"),
        (F.col("cx") + 0.3 * at[0]).alias("cx"),
        (F.col("cy") + 0.3 * at[1]).alias("cy"),
        F.lit(0.0).alias("err"),
    )
    kept = parents.withColumn("err", F.when(F.col("child_id").isNull(), F.col("err")).otherwise(F.col("err") / 2)).select("node_id", "w", "cx", "cy", "err")
    return kept.unionByName(kids)


def schedule(round: Column, lr0: float = 0.4, lr_rate: float = 0.9, lr_floor: float = 0.02, r0: float = 2.0, r_rate: float = 0.85, r_floor: float = 0.5) -> tuple[Column, Column]:
    """Learning rate and radius of a round."""
    return F.greatest(F.lit(lr_floor), lr0 * F.pow(F.lit(lr_rate), round)), F.greatest(F.lit(r_floor), r0 * F.pow(F.lit(r_rate), round))


def knn_graph(nodes: DataFrame, k: int = 6) -> DataFrame:
    """src, dst, w: each node's k nearest in place, weighted by the distance of weights. Within rows over packed nodes."""
    one = packed(nodes, "cx", "cy", "w")

    def near(all_nodes: Column) -> Column:
        others = F.filter(all_nodes, lambda n: n.node_id != F.col("node_id"))
        far = F.transform(
            others,
            lambda n: F.struct(
                F.sqrt((n.cx - F.col("cx")) * (n.cx - F.col("cx")) + (n.cy - F.col("cy")) * (n.cy - F.col("cy"))).alias("d"),
                n.node_id.alias("dst"),
                F.sqrt(V.squared_distance(F.col("w"), n.w)).alias("cost"),
            ),
        )
        return F.slice(F.array_sort(far), 1, k)

    out = nodes.crossJoin(F.broadcast(one)).select(F.col("node_id").alias("src"), F.explode(near(F.col("nodes"))).alias("e"))  # one row
    return out.select("src", "e.dst", F.col("e.cost").alias("w"))


def lattice_edges(nodes: DataFrame) -> DataFrame:
    """src, dst, w between the eight neighbours of a lattice with row and col; an equi-join on the neighbours' cells."""
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c))
    left = nodes.select(F.col("node_id").alias("src"), F.col("w").alias("a"), "row", "col", F.explode(steps).alias("s"))
    left = left.select("src", "a", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    return left.join(nodes.select(F.col("node_id").alias("dst"), F.col("w").alias("b"), "row", "col"), ["row", "col"]).select(
        "src", "dst", F.sqrt(V.squared_distance(F.col("a"), F.col("b"))).alias("w")
    )


def shortest_labels(edges: DataFrame, sources: DataFrame, ws: Workspace) -> DataFrame:
    """source, node, cost, hops, pred of every node that each source reaches: the cheapest way, the fewest hops among
    equals, then the smallest predecessor. The source itself has cost 0 and no predecessor.

    Rounds of relaxation: the labels that the last round improved meet the edges, and the best label of each (source,
    node) stays. Every round is written, so plans don't grow; it ends when a round improves nothing, which takes at most
    as many rounds as there are nodes. Edges: src, dst, w (not negative).
    """
    s, none = F.col("source"), F.lit(None).cast(edges.schema["src"].dataType)
    label = F.struct("cost", "hops", "pred")
    graph = ws.stage(edges.select("src", "dst", F.col("w").cast("double").alias("w")), "edges")
    best = ws.stage(sources.select(s).distinct().select(s, s.alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), none.alias("pred"), F.lit(True).alias("new")), "labels-0")
    step = 0
    while True:
        step += 1
        front = best.where("new").select("source", F.col("node").alias("src"), "cost", "hops")
        reached = front.join(graph, "src").where(F.col("dst") != s).select(s, F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("src").alias("pred"))
        found = reached.groupBy("source", "node").agg(F.min(label).alias("found"))
        both = best.select("source", "node", label.alias("old")).join(found, ["source", "node"], "full")
        better = F.col("found").isNotNull() & (F.col("old").isNull() | (F.col("found") < F.col("old")))
        after = both.select("source", "node", F.when(better, F.col("found")).otherwise(F.col("old")).alias("l"), better.alias("new"))
        best = ws.stage(after.select("source", "node", "l.cost", "l.hops", "l.pred", "new"), f"labels-{step}")
        if step > 1:
            ws.drop(f"labels-{step - 2}")
        if best.where("new").isEmpty():
            return best.drop("new")


def shortest_paths(edges: DataFrame, pairs: DataFrame, ws: Workspace) -> DataFrame:
    """src, dst, path, cost, hops of the wanted pairs (src, dst).

    A node to itself is ([src], 0, 0); a pair without a way is ([src, dst], inf, -1). Paths are read off the predecessors,
    from their ends, one step of all pairs in each round.
    """
    wanted = ws.stage(pairs.select("src", "dst").distinct(), "wanted")
    labels = ws.stage(shortest_labels(edges, wanted.select(F.col("src").alias("source")), ws), "labels")
    back = labels.select(F.col("source").alias("src"), F.col("node").alias("at"), "pred")
    own = labels.select(F.col("source").alias("src"), F.col("node").alias("dst"), "cost", "hops")
    reached = wanted.join(own, ["src", "dst"])
    trail = ws.stage(reached.select("src", "dst", F.col("dst").alias("at"), F.col("hops").alias("place")), "trail-0")
    steps = [trail]
    while not trail.where("at <> src").isEmpty():
        further = trail.where("at <> src").join(back, ["src", "at"]).select("src", "dst", F.col("pred").alias("at"), (F.col("place") - 1).alias("place"))
        trail = ws.stage(further, f"trail-{len(steps)}")
        steps.append(trail)
    every = steps[0]
    for one in steps[1:]:
        every = every.unionByName(one)
    paths = every.groupBy("src", "dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "at"))), lambda x: x.at).alias("path"))
    out = wanted.join(reached, ["src", "dst"], "left").join(paths, ["src", "dst"], "left")
    return out.select(
        "src",
        "dst",
        F.coalesce("path", F.array("src", "dst")).alias("path"),
        F.coalesce("cost", F.lit(float("inf"))).alias("cost"),
        F.coalesce("hops", F.lit(-1)).alias("hops"),
    )


def low_density_centers(nodes: DataFrame, k: int = 4) -> DataFrame:
    """The k nodes of the smallest norm."""
    return nodes.select("node_id", V.norm(F.col("w")).alias("norm")).orderBy("norm", "node_id").limit(k)


def density(assigned: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, n: how many vectors each node has, 0 included."""
    counts = assigned.groupBy(F.col("bmu").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("node_id").join(counts, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n"))


def train_online(vectors: DataFrame, nodes: DataFrame, rounds: int, group: str = "expert", lr0: float = 0.4, r0: float = 2.0, lattice: bool = False) -> DataFrame:
    """Exact sequential training, one map for each group: every vector in order moves all nodes before the next is read.

    Sequential by definition, so a map is one task; maps train side by side. vectors: group, seq, vec; nodes: group,
    node_id, w, cx, cy, err. Returns the nodes' new w and err (the error sums up over rounds).
    """
    import pandas as pd

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x = np.array(left.sort_values("seq")["vec"].tolist(), float)
        right = right.sort_values("node_id").reset_index(drop=True)
        w = np.array(right["w"].tolist(), float)
        at = right[["cx", "cy"]].to_numpy(float)
        err = right["err"].to_numpy(float).copy()
        for r in range(rounds if len(w) and len(x) else 0):
            rate, radius = max(0.02, lr0 * 0.9**r), max(0.5, r0 * 0.85**r)
            for v in x:
                d = ((w - v) ** 2).sum(1)
                b = int(d.argmin())
                err[b] += np.sqrt(d[b])
                g = ((at - at[b]) ** 2).sum(1)
                h = np.exp(-g / (2 * radius * radius))
                if lattice:
                    h = np.where(g <= radius * radius, h, 0.0)
                w += rate * h[:, None] * (v - w)
        return right.assign(w=list(w), err=err)[[group, "node_id", "w", "cx", "cy", "err"]]

    schema = f"{group} string, node_id long, w array<double>, cx double, cy double, err double"
    own = nodes.select(*(F.col(c).alias(c) for c in nodes.columns))  # the two sides may stem from one table
    return vectors.groupBy(group).cogroup(own.groupBy(group)).applyInPandas(run, schema)
