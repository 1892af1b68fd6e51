"""Curation: what to learn, skip or reject; queries, rewards and policy; identity measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vec as V
from ..sources.workspace import Workspace
from . import corpus, mapnet, similar

NEAR, LEAST_NOVELTY = 0.85, 0.15


def known(candidates: DataFrame, table: DataFrame, id_col: str, key: str | None = None, block_bytes: int = similar.BLOCK_BYTES) -> DataFrame:
    """id, known: the largest cosine of each candidate (id, vec) with the table (vec); 0 for an empty one.

    key: a column of both sides, such as the text. A candidate whose key the table holds is known to the full (1) by a
    semi-join, and only the others are compared by their vectors.
    """
    own = candidates.select(id_col, "vec", *([key] if key else []))
    exact = None
    if key:
        keys = table.select(key).where(F.col(key).isNotNull()).distinct()
        exact = own.join(keys, key, "left_semi").select(id_col).distinct()
        own = own.join(keys, key, "left_anti")
    ids = table.select(F.lit("").alias("word"), "vec")  # which of the table it is doesn't matter
    best = similar.top(own.select(F.col(id_col).alias("word"), "vec"), ids, 1, own=True, block_bytes=block_bytes)
    best = best.groupBy(F.col("word").alias("_id")).agg(F.max("sim").alias("sim"))
    out = candidates.select(id_col).join(best, F.col(id_col) == F.col("_id"), "left").select(id_col, F.coalesce("sim", F.lit(0.0)).alias("known"))
    if exact is None:
        return out
    flag = exact.select(F.col(id_col).alias("_id"), F.lit(1.0).alias("_one"))
    return out.join(flag, F.col(id_col) == F.col("_id"), "left").select(id_col, F.coalesce("_one", "known").alias("known"))


def novelty(candidates: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """id, novelty: least over mean distance to the nodes, 1 at most."""
    one = mapnet.packed(nodes, "w")
    far = F.transform("nodes", lambda n: F.sqrt(V.squared_distance(F.col("vec"), n.w)))
    d = candidates.crossJoin(F.broadcast(one)).select(id_col, far.alias("d"))  # one row, checked
    ratio = F.array_min("d") / (V.total(F.col("d")) / F.size("d") + 1e-9)
    return d.select(id_col, F.when(F.size("d") == 0, 1.0).otherwise(F.least(ratio, F.lit(1.0))).alias("novelty"))


def guide(candidates: DataFrame) -> DataFrame:
    """action and priority from known, novelty and inside (guardrail)."""
    action = F.when(~F.col("inside"), "reject").when(F.col("known") >= NEAR, "skip").when(F.col("novelty") < LEAST_NOVELTY, "skip").otherwise("learn")
    return candidates.withColumn("action", action).withColumn(
        "priority", F.when(F.col("action") == "learn", F.round(0.6 * F.col("novelty") + 0.4 * (1 - F.col("known")), 3)).otherwise(0.0)
    )


def guide_batch(guided: DataFrame, id_col: str) -> DataFrame:
    """The learn order: id, priority and rank by priority, from 1."""
    learn = guided.where("action = 'learn'").select(id_col, "priority")
    ranked = corpus.numbered(learn, [F.desc("priority"), F.col(id_col)], "rank", Workspace(guided.sparkSession, "order"))
    return ranked.withColumn("rank", F.col("rank") + 1)


def autonomous_queries(assigned: DataFrame, docs: DataFrame, id_col: str, n: int = 3, words: int = 2, most_share: float = 0.3, nodes: DataFrame | None = None) -> DataFrame:
    """node_id, query: queries from the nodes with one or two texts or, where there is none, from the 3n nodes with the fewest.

    nodes (node_id): the map, so that its empty nodes are among the fewest; without it all nodes have texts. Frequent words
    of the corpus are left out; nodes come in order of a hash.
    """
    held = assigned.groupBy("bmu").agg(F.count(F.lit(1)).alias("n"))
    every = held if nodes is None else nodes.select(F.col("node_id").alias("bmu")).join(held, "bmu", "left").select("bmu", F.coalesce("n", F.lit(0)).alias("n"))
    sparse = held.where("n <= 2").agg((F.count(F.lit(1)) > 0).alias("any"))
    fewest = every.orderBy("n", "bmu").limit(3 * n).select("bmu", F.lit(True).alias("few"))
    size = held.join(fewest, "bmu", "left").crossJoin(F.broadcast(sparse)).where(F.when(F.col("any"), F.col("n") <= 2).otherwise(F.col("few"))).select("bmu")  # one row
    toks = corpus.tokens(docs, id_col)
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    rare = toks.groupBy("tok").agg(F.count(F.lit(1)).alias("g")).crossJoin(F.broadcast(total)).where(F.col("g") <= F.col("total") * most_share)  # one row
    mine = toks.where(T.good_word(F.col("tok"))).join(rare.select("tok"), "tok").join(assigned.select(id_col, "bmu"), id_col).join(size, "bmu")
    counts = mine.groupBy("bmu", T.clean_word(F.col("tok")).alias("word")).agg(F.count(F.lit(1)).alias("c"))
    r = F.row_number().over(Window.partitionBy("bmu").orderBy(F.desc("c"), "word"))
    top = counts.withColumn("r", r).where(F.col("r") <= words)
    q = top.groupBy("bmu").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x.word), " ").alias("query"))
    return corpus.keep_first(q.select(F.md5(F.col("bmu").cast("string")).alias("o"), F.col("bmu").alias("node_id"), "query"), F.col("query"), ["o"]).orderBy("o").limit(n).select("node_id", "query")


def policy(log: DataFrame) -> DataFrame:
    """word, reward_sum, n, mean from a log of (query, reward)."""
    return log.select(F.explode(F.split(F.trim("query"), r"\s+")).alias("word"), "reward").where("word <> ''").groupBy("word").agg(
        F.sum("reward").alias("reward_sum"), F.count(F.lit(1)).alias("n"), (F.sum("reward") / F.count(F.lit(1))).alias("mean")
    )


def query_scores(queries: DataFrame, table: DataFrame) -> DataFrame:
    """query, score: the mean of the words' means, 0 for unseen ones."""
    words = queries.select("query", F.explode(F.split(F.trim("query"), r"\s+")).alias("word"))
    return words.join(table, "word", "left").groupBy("query").agg(F.avg(F.coalesce("mean", F.lit(0.0))).alias("score"))


def rank_queries(queries: DataFrame, table: DataFrame, explore: bool = False, seed: int = 0) -> DataFrame:
    """query, score in order of score; in order of a seeded hash when exploring."""
    score = query_scores(queries, table)
    return score.orderBy(F.xxhash64("query", F.lit(seed))) if explore else score.orderBy(F.desc("score"), "query")


def halves(vectors: DataFrame, order: str, share: float = 0.3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """The first share of the rows by a whole-number order, and the rest."""
    edge = corpus.kth_smallest(vectors, order, max(least, int(share * vectors.count())))
    return vectors.where(F.col(order) <= edge), vectors.where(F.col(order) > edge)


def mean_vector(vectors: DataFrame) -> DataFrame:
    by = vectors.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"))
    return by.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda v: v.m).alias("mean"))


def drift(early: DataFrame, late: DataFrame) -> DataFrame:
    """drift: half of one less the cosine of the mean vectors."""
    a, b = mean_vector(early).withColumnRenamed("mean", "a"), mean_vector(late).withColumnRenamed("mean", "b")
    return a.crossJoin(b).select(((1 - V.cosine(F.col("a"), F.col("b"))) / 2).alias("drift"))  # one row each


def coherence(vectors: DataFrame, id_col: str, most: int = 200) -> DataFrame:
    """coherence: mean cosine of at most `most` unit rows (by hash of the id) with their unit centre; 1 under five rows."""
    unit = vectors.orderBy(F.md5(F.col(id_col).cast("string"))).limit(most).select(V.unit(F.col("vec")).alias("vec"))
    centre = mean_vector(unit).select(V.unit(F.col("mean")).alias("centre"))
    one = unit.crossJoin(F.broadcast(centre)).agg(F.count(F.lit(1)).alias("n"), F.avg(V.dot(F.col("vec"), F.col("centre"))).alias("c"))  # one row
    return one.select(F.when(F.col("n") < 5, 1.0).otherwise(F.col("c")).alias("coherence"))


def identity_retention(retention: DataFrame, drifted: DataFrame, coherent: DataFrame) -> DataFrame:
    one = retention.crossJoin(drifted).crossJoin(coherent)  # one row each
    return one.select("retention", "drift", "coherence", F.round(0.40 * F.col("retention") + 0.30 * (1 - F.col("drift")) + 0.30 * F.col("coherence"), 3).alias("identity"))
