"""State as Parquet tables: nodes with INT8 weights, their scale, and a manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mapnet
from .workspace import shared_dir


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster shares."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def save_state(nodes: DataFrame, path: str, meta: dict) -> None:
    """Nodes (node_id, w, cx, cy, err) quantized, and meta as one row of JSON text."""
    mapnet.quantized(nodes).select("node_id", "wq", "scale", "cx", "cy", "err").write.mode("overwrite").parquet(f"{path}/nodes")
    spark = nodes.sparkSession
    spark.range(1).select(F.to_json(F.map_from_arrays(F.array(*(F.lit(str(k)) for k in meta)), F.array(*(F.lit(str(v)) for v in meta.values())))).alias("meta")).write.mode("overwrite").json(f"{path}/meta")


def load_nodes(spark: SparkSession, path: str) -> DataFrame:
    return mapnet.dequantized(spark.read.parquet(f"{path}/nodes"))


def save_table(df: DataFrame, path: str, version: int) -> None:
    """One version of a table; a version that is there already is left as it is, so a replayed batch changes nothing."""
    df.write.mode("ignore").parquet(f"{path}/version={version}")
