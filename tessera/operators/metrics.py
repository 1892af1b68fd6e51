"""Instruments over the map and over the history of rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import Workspace
from . import corpus, mapnet


def _top_two(vectors: DataFrame, nodes: DataFrame, *place: str) -> DataFrame:
    two = mapnet.bmu2(vectors, nodes)
    at = nodes.select("node_id", *place)
    first = at.select(F.col("node_id").alias("bmu"), *(F.col(p).alias(f"a_{p}") for p in place))
    second = at.select(F.col("node_id").alias("second"), *(F.col(p).alias(f"b_{p}") for p in place))
    return two.join(F.broadcast(first), "bmu").join(F.broadcast(second), "second", "left")  # nodes: checked when packed


def measure(vectors: DataFrame, nodes: DataFrame, toks: DataFrame) -> DataFrame:
    """One row: nodes, occupancy, occ_ratio, mean_qe, topo_error, vocab_div."""
    t = _top_two(vectors, nodes, "cx", "cy")
    far = F.sqrt(F.pow(F.col("a_cx") - F.col("b_cx"), F.lit(2.0)) + F.pow(F.col("a_cy") - F.col("b_cy"), F.lit(2.0)))
    # sums for each node first: what meets in one task is a row for each node, not each vector
    by = t.groupBy("bmu").agg(F.sum("qe").alias("qe"), F.count(F.lit(1)).alias("n"), F.sum(F.when(far > 1.5, 1).otherwise(0)).alias("bad"))
    m = by.agg(F.count(F.lit(1)).alias("occupancy"), (F.sum("qe") / F.sum("n")).alias("mean_qe"), (F.sum("bad") / F.sum("n")).alias("topo_error"))
    one = m.crossJoin(nodes.agg(F.count(F.lit(1)).alias("nodes"))).crossJoin(corpus.type_token_ratio(toks))  # one row each
    return one.select("nodes", "occupancy", (F.col("occupancy") / F.col("nodes")).alias("occ_ratio"), "mean_qe", "topo_error", "vocab_div")


def lattice_measure(vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for a lattice map: inputs, occupancy, empty cells, error, share of inputs whose two nearest are no neighbours."""
    t = _top_two(vectors, nodes, "row", "col")
    steps = F.greatest(F.abs(F.col("a_row") - F.col("b_row")), F.abs(F.col("a_col") - F.col("b_col")))
    by = t.groupBy("bmu").agg(F.sum("qe").alias("qe"), F.count(F.lit(1)).alias("n"), F.sum(F.when(steps > 1, 1).otherwise(0)).alias("bad"))
    m = by.agg(F.count(F.lit(1)).alias("occupancy"), F.sum("n").alias("n_inputs"), (F.sum("qe") / F.sum("n")).alias("mean_qe"), (F.sum("bad") / F.sum("n")).alias("topo_error"))
    one = m.crossJoin(nodes.agg(F.count(F.lit(1)).alias("nodes")))  # one row each
    o, n = F.col("occupancy"), F.col("nodes")
    return one.select("n_inputs", "occupancy", (o / n).alias("occupancy_ratio"), (n - o).alias("empty_cells"), "mean_qe", "topo_error")


def path_length(assigned: DataFrame, nodes: DataFrame, order: str, group: str) -> DataFrame:
    """Lattice steps between the nodes of consecutive vectors of each reasoning path (group), walked in order."""
    w = Window.partitionBy(group).orderBy(order)
    at = assigned.select(group, order, F.col("bmu").alias("node_id")).join(F.broadcast(nodes.select("node_id", "row", "col")), "node_id")
    steps = F.greatest(F.abs(F.col("row") - F.lag("row").over(w)), F.abs(F.col("col") - F.lag("col").over(w)))
    return at.select(group, steps.alias("s")).groupBy(group).agg(F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("path_len"))


def pair_paths(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, ws: Workspace) -> DataFrame:
    """One row: pairs, reached, mean_cost and mean_hops of the shortest paths between the nodes of vector pairs (q, a).

    Means are over the pairs that have a way (null if none has). Pairs are counted by their two nodes first, so paths are
    sought for different pairs of nodes only, however many pairs of vectors there are.
    """
    q = mapnet.bmu(pairs, nodes, "q").select(F.col("bmu").alias("src"), "a")
    both = mapnet.bmu(q, nodes, "a").groupBy("src", F.col("bmu").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    both = ws.stage(both, "pairs")
    found = both.join(mapnet.shortest_paths(edges, both, ws), ["src", "dst"])
    finite = F.when(F.col("hops") >= 0, F.col("n"))
    return found.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum(finite), F.lit(0)).alias("reached"),
        (F.sum(finite * F.col("cost")) / F.sum(finite)).alias("mean_cost"),
        (F.sum(finite * F.col("hops")) / F.sum(finite)).alias("mean_hops"),
    )


def _rounds() -> Window:
    return Window.orderBy("round")  # a history has a row for each round


def collapse_alarm(history: DataFrame) -> DataFrame:
    """history with alarm: echo, point, vocabulary, overgrown or null, each judged on the rounds so far."""
    w = _rounds()

    def down(k: str) -> Column:
        s = [F.lag(k, i).over(w) for i in (3, 2, 1)] + [F.col(k)]
        return (s[1] <= s[0]) & (s[2] <= s[1]) & (s[3] <= s[2]) & (s[0] > s[3])

    recent = F.max("vocab_div").over(w.rowsBetween(-5, 0))
    alarm = (
        F.when(F.lag("round", 3).over(w).isNull(), None)
        .when(down("occupancy") & down("vocab_div") & down("mean_qe"), "echo")
        .when(down("occupancy") & (F.col("occ_ratio") < 0.1), "point")
        .when(F.lag("round", 5).over(w).isNotNull() & (F.col("vocab_div") < 0.12) & (recent > 0.25), "vocabulary")
        .when((F.col("occ_ratio") < 0.15) & (F.col("nodes") > 200), "overgrown")
    )
    return history.withColumn("alarm", alarm)


def trend(history: DataFrame) -> DataFrame:
    """First and last values of a history and its trend."""
    pick = {f"{k}_{e}": f(k, "round") for k in ("occupancy", "mean_qe", "vocab_div") for e, f in (("first", F.min_by), ("last", F.max_by))}
    one = history.agg(F.count(F.lit(1)).alias("rounds"), *(c.alias(n) for n, c in pick.items()))
    deep = (F.col("occupancy_last") >= F.col("occupancy_first")) & (F.col("vocab_div_last") >= F.col("vocab_div_first") * 0.9)
    return one.select(
        "rounds",
        "occupancy_first",
        "occupancy_last",
        F.round("mean_qe_first", 6).alias("mean_qe_first"),
        F.round("mean_qe_last", 6).alias("mean_qe_last"),
        F.when(deep, "deepening").otherwise("collapse-risk").alias("trend"),
    )


def domain_band(assigned: DataFrame, history: DataFrame) -> DataFrame:
    """assigned with inside: the distance is within the mean error of the history plus two deviations; always with one round or none."""
    band = history.agg(F.when(F.count(F.lit(1)) > 1, F.avg("mean_qe") + 2 * F.stddev_pop("mean_qe")).alias("band"))
    return assigned.crossJoin(F.broadcast(band)).withColumn("inside", F.col("qe") <= F.coalesce("band", 1.5 * F.col("qe"))).drop("band")  # one row


def reward(q0: Column, q1: Column, v0: Column, v1: Column, low: float = 0.15, high: float = 0.5) -> Column:
    """Assimilation, challenge within the zone of development, and diversity, from errors and diversities before and after."""
    base = F.abs(q0) + 1e-8
    change, dv = F.abs(q1 - q0) / base, v1 - v0
    challenge = (
        F.when(q1 > q0, -0.6 * F.least(F.lit(2.0), change / high) * 0.5)
        .when(change.between(low, high), 0.6)
        .when(change < low, 0.6 * (change / low) * 0.5)
        .otherwise(0.6 * (1 - F.least(F.lit(2.0), (change - high) / high)))
    )
    diversity = F.when(dv >= 0, 0.8 * dv).otherwise(-0.4 * F.greatest(F.lit(0.0), -dv - 0.05) * 0.5)
    return (q0 - q1) / base + challenge + diversity


def rewards(history: DataFrame) -> DataFrame:
    """round, reward of each round against the one before."""
    w = _rounds()
    h = history.select("round", F.lag("mean_qe").over(w).alias("q0"), F.col("mean_qe").alias("q1"), F.lag("vocab_div").over(w).alias("v0"), F.col("vocab_div").alias("v1"))
    return h.where("q0 is not null").select("round", reward(*(F.col(c) for c in ("q0", "q1", "v0", "v1"))).alias("reward"))


def quantization_report(vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean errors with full and INT8 weights and their difference in per cent, bytes of both and their ratio."""
    q = mapnet.quantized(nodes)
    full = mapnet.bmu(vectors, nodes).agg(F.avg("qe").alias("qe_full"))
    int8 = mapnet.bmu(vectors, mapnet.dequantized(q).select("node_id", "w")).agg(F.avg("qe").alias("qe_int8"))
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("w")).alias("dim"))
    n, dim = F.col("n"), F.col("dim")
    return full.crossJoin(int8).crossJoin(size).select(  # one row each
        "qe_full", "qe_int8", (n * dim * 8).alias("bytes_full"), (n * dim + dim * 8).alias("bytes_int8"), (n * dim * 8 / (n * dim + dim * 8)).alias("ratio"),
        (F.try_divide(F.abs(F.col("qe_int8") - F.col("qe_full")), F.col("qe_full")) * 100).alias("diff_percent"),
    )
