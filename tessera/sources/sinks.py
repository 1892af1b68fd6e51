"""What is handed out as files: corpus text, metrics as JSON lines, word embeddings and sets of experts.

All go through Spark's writers, whose committed files don't change when a task is run again. A corpus is written in its order: ranges
of `seq`, sorted within, so reading the files in order of name gives the order back without a sort of all in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .experts import TABLES, Experts

#: Fields of a round of a lattice map; those after vocab_div may be missing.
METRICS = "round long, n_inputs long, occupancy long, occupancy_ratio double, empty_cells long, mean_qe double, topo_error double, vocab_div double, path_len double, mean_path_cost double, mean_path_hops double, wall_time_s double"


def write_corpus(corpus: DataFrame, path: str) -> None:
    """One line for each sentence (seq, text), in order of seq; line ends within a text become spaces, blank texts go."""
    line = F.trim(F.regexp_replace("text", r"[\r\n]+", " "))
    lines = corpus.select("seq", line.alias("value")).where("value <> ''")
    lines.repartitionByRange("seq").sortWithinPartitions("seq", "value").select("value").write.mode("overwrite").text(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """seq, text: non-blank lines with a number that rises in the order of files and lines."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("row"))
    return lines.where(F.trim("value") != "").select(F.struct("file", "block", "row").alias("seq"), F.trim("value").alias("text"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """JSON lines, a round each; what is null is left out."""
    own = [c.split()[0] for c in METRICS.split(", ")]
    metrics.select(*(c for c in own if c in metrics.columns)).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).json(path)


def write_embedding(table: DataFrame, path: str) -> None:
    """word, idx, vec as 32-bit floats, and is_seed and freq where the table has them."""
    vec = F.transform("vec", lambda x: x.cast("float")).alias("vec")
    more = [c for c in ("idx", "is_seed", "freq") if c in table.columns]
    table.select("word", vec, *more).write.mode("overwrite").parquet(path)


def read_embedding(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.parquet(path)
    return table.withColumn("vec", F.col("vec").cast(T.ArrayType(T.DoubleType())))


def write_experts(held: Experts, path: str) -> Experts:
    """A set of experts as tables under another path: what is listed, with corpora, models and thresholds."""
    out = Experts(held.spark, path)
    for name in sorted(TABLES, key=lambda t: t == "about"):  # descriptions last: a set that was broken off lists none
        held.table(name).write.mode("overwrite").partitionBy("expert").parquet(out.folder.path(name))
    return out
