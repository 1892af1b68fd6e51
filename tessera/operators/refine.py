"""Local refinement of a quantized map."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec as V
from . import mapnet


def soft_assign(vectors: DataFrame, quantized: DataFrame, k: int = 8, temp: float = 1.0) -> DataFrame:
    """vectors with soft: the k nearest dequantized nodes as (node_id, d, p), p the softmax of the negative squared distance."""
    near = mapnet.ranked(vectors, mapnet.dequantized(quantized).select("node_id", "w"), k)
    p = V.softmax(F.transform("near", lambda n: -n.d2), temp)
    return near.withColumn("p", p).withColumn("soft", F.zip_with("near", "p", lambda n, q: F.struct(n.node_id.alias("node_id"), F.sqrt(n.d2).alias("d"), q.alias("p")))).drop("near", "p")


def local_qe(assigned: DataFrame) -> DataFrame:
    return assigned.withColumn("local_qe", F.aggregate("soft", F.lit(0.0), lambda a, s: a + s.p * s.d))


def refine(vector: DataFrame, quantized: DataFrame, k: int = 8, temp: float = 1.0, lr: float = 0.25) -> DataFrame:
    """The nodes after one update by a one-row vector table: w += lr * p * (x - w) on its k nearest, quantized again; moved marks them."""
    soft = soft_assign(vector, quantized, k, temp).select("vec", F.explode("soft").alias("s")).select("vec", "s.node_id", "s.p")
    both = mapnet.dequantized(quantized).join(F.broadcast(soft), "node_id", "left")  # k rows
    new = F.zip_with("w", "vec", lambda w, x: w + lr * F.col("p") * (x - w))
    both = both.withColumn("w", F.when(F.col("p").isNull(), F.col("w")).otherwise(new)).withColumn("moved", F.col("p").isNotNull())
    return both.withColumn("wq", F.when(F.col("moved"), F.zip_with("w", "scale", V.quantize)).otherwise(F.col("wq"))).drop("vec", "p")


def refine_each(vectors: DataFrame, quantized: DataFrame, k: int = 8, temp: float = 1.0, lr: float = 0.25) -> DataFrame:
    """vectors with before, after and moved: the local error before and after an update by the vector alone, and the nodes
    that it moves as (node_id, p, wq), quantized again. Within rows: each vector has its k nodes with it, whatever the map."""
    nodes = mapnet.dequantized(quantized)
    one = mapnet.packed(nodes, "w")
    scale = mapnet.scale_array_of(quantized)
    near = local_qe(soft_assign(vectors, quantized, k, temp)).withColumnRenamed("local_qe", "before")
    held = near.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(scale))  # one row each
    own = F.transform("soft", lambda s: F.struct(s.node_id.alias("node_id"), s.p.alias("p"), F.filter("nodes", lambda n: n.node_id == s.node_id)[0].w.alias("w")))
    held = held.withColumn("own", own).drop("nodes", "soft")
    moved = F.transform("own", lambda o: F.struct(o.node_id.alias("node_id"), o.p.alias("p"), F.zip_with(F.zip_with(o.w, "vec", lambda w, x: w + lr * o.p * (x - w)), "scale", V.quantize).alias("wq")))
    held = held.withColumn("moved", moved).drop("own")
    d2 = F.transform("moved", lambda m: V.squared_distance(F.zip_with(m.wq, "scale", lambda q, s: q * s), F.col("vec")))
    held = held.withColumn("d2", d2).withColumn("q", V.softmax(F.transform("d2", lambda d: -d), temp))
    return held.withColumn("after", V.total(F.zip_with("q", "d2", lambda q, d: q * F.sqrt(d)))).drop("d2", "q", "scale")


def use_counts(assigned: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, use_count: the sum of the soft assignments to each node, 0 included; what forgetting goes by."""
    by = assigned.select(F.explode("soft").alias("s")).groupBy("s.node_id").agg(F.sum("s.p").alias("use_count"))
    return nodes.select("node_id").join(by, "node_id", "left").select("node_id", F.coalesce("use_count", F.lit(0.0)).alias("use_count"))


def auto_params(vectors: DataFrame) -> DataFrame:
    """One row: k, temp, lr, spread and region_size from the spread of a region."""
    by = vectors.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.stddev_pop("x").alias("sd"), F.count(F.lit(1)).alias("m"))
    one = by.agg(F.max("m").alias("region_size"), F.avg("sd").alias("mean_sd"))
    spread = F.when(F.col("region_size") > 1, F.col("mean_sd")).otherwise(0.1)
    return one.select(
        F.least(F.lit(16), F.greatest(F.lit(4), F.rint(F.col("region_size") * 2.0))).cast("int").alias("k"),
        F.least(F.lit(4.0), F.greatest(F.lit(0.8), spread * 8.0)).alias("temp"),
        F.least(F.lit(0.35), F.greatest(F.lit(0.15), F.lit(0.4) - spread)).alias("lr"),
        spread.alias("spread"),
        "region_size",
    )


def refine_region(region: DataFrame, quantized: DataFrame, passes: int = 8, group: str = "grp") -> DataFrame:
    """Repeated refinement by the vectors of a region in order. Each update reads the one before, so a region is one task;
    regions (group) run side by side on their own copy of the map. Returns group, node_id, wq, use_count."""
    import pandas as pd

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x = np.array(left.sort_values("seq")["vec"].tolist(), float)
        right = right.sort_values("node_id").reset_index(drop=True)
        out = right[[group, "node_id"]].copy()
        q = np.array(right["wq"].tolist(), float)
        scale = np.array(right["scale"].iloc[0], float) if len(right) else np.ones(0)
        use = np.zeros(len(q))
        if len(x) and len(q):
            spread = float(x.std(0).mean()) if len(x) > 1 else 0.1
            k, temp, lr = int(np.clip(2 * len(x), 4, 16)), float(np.clip(spread * 8, 0.8, 4)), float(np.clip(0.4 - spread, 0.15, 0.35))
            for _ in range(passes):
                for v in x:
                    w = q * scale
                    d2 = ((w - v) ** 2).sum(1)
                    near = np.argsort(d2, kind="stable")[:k]
                    z = -d2[near] / temp
                    p = np.exp(z - z.max())
                    p /= p.sum() + 1e-12
                    q[near] = np.clip(np.rint((w[near] + lr * p[:, None] * (v - w[near])) / scale), -127, 127)
                    use[near] += p
        return out.assign(wq=[r.astype(int).tolist() for r in q], use_count=use)

    schema = f"{group} string, node_id long, wq array<int>, use_count double"
    groups = region.select(group).distinct()
    maps = groups.crossJoin(F.broadcast(quantized.select("node_id", "wq", "scale")))  # a copy of the map for each region
    maps = maps.select(*(F.col(c).alias(c) for c in maps.columns))
    return region.groupBy(group).cogroup(maps.groupBy(group)).applyInPandas(run, schema)


def regions(vectors: DataFrame, threshold: float = 0.6, group: str = "grp") -> DataFrame:
    """group, seq, region: greedy leaders in order. A vector joins the first leader within the cosine, or leads. Order makes
    it sequential, so a group is one task."""
    import pandas as pd

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("seq").reset_index(drop=True)
        x = np.array(df["vec"].tolist(), float)
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
        leaders = np.zeros((0, x.shape[1]))
        out = np.zeros(len(x), int)
        for i, v in enumerate(x):
            hit = np.flatnonzero(leaders @ v >= threshold)
            out[i] = hit[0] if len(hit) else len(leaders)
            if not len(hit):
                leaders = np.vstack([leaders, v])
        return pd.DataFrame({group: df[group], "seq": df["seq"], "region": out})

    return vectors.groupBy(group).applyInPandas(run, f"{group} string, seq long, region long")


def forget(nodes: DataFrame, decay: float = 0.95, share: float = 0.3, coarse: float = 1.5) -> DataFrame:
    """Quantized nodes with use_count decayed; the least used share is stored more coarsely (truncated as a cast does)."""
    decayed = nodes.withColumn("use_count", F.col("use_count") * decay)
    edge = decayed.agg(F.percentile("use_count", F.lit(share)).alias("edge"))

    def blur(q, s):
        step = F.rint(q * s / (coarse * s)) * coarse
        return F.greatest(F.lit(-127.0), F.least(F.lit(127.0), step)).cast("tinyint")

    both = decayed.crossJoin(F.broadcast(edge))  # one row
    return both.withColumn("wq", F.when(F.col("use_count") <= F.col("edge"), F.zip_with("wq", "scale", blur)).otherwise(F.col("wq"))).drop("edge")
