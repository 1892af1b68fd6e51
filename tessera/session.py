"""Session factory used by tests, the bench and interactive work."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tessera") -> SparkSession:
    """A local session with AQE and Arrow on, UTC time and a modest shuffle width.

    On a cluster the master, memory and shuffle width come from spark-submit; nothing here overrides them there.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if "SPARK_MASTER" not in os.environ:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "12g"))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    spark = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
