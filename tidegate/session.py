"""What a query needs from the session: tables by name, and a place to cut lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back, so that its lineage ends and a lost executor costs nothing.

    The folder is spark.checkpoint.dir of the session. Where that is unset, a session in one process (tests) takes a
    temporary one and a cluster raises: a folder of one machine would be lost with it.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and re.fullmatch(r"local(\[.*\])?", context.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as the session runs at once, for costly row-wise work; moved only where a scan gives fewer."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def build_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tidegate") -> SparkSession:
    """A local session for tests and measurements; on a cluster the submitter's settings hold."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
