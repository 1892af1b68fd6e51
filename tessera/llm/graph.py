"""Connected components of tables of edges; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """id and label (the component's smallest id) of every node of edges (u, v).

    Each round hands every node the least label of its neighbours, then follows labels to their own label, so the
    distance covered doubles. A node with many edges costs partial minima, not a group in one task.
    """
    both = ws.stage(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    labels = ws.stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, both.v == labels.id).groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.id == near.u, "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = ws.stage(lower, f"{name}-{step}-a")
        up = lower.select(F.col("id").alias("label"), F.col("label").alias("top"))
        after = ws.stage(lower.join(up, "label", "left").select("id", "old", F.least("label", F.coalesce("top", "label")).alias("label")), f"{name}-{step}")
        changed = after.where(F.col("label") != F.col("old")).limit(1).count()
        labels = after.select("id", "label")
        ws.drop(f"{name}-{step}-a", f"{name}-{step - 1}")
        if not changed:
            ws.drop(f"{name}-edges")
            return labels
