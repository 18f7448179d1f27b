"""A Spark session with the settings this library is written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quire", **conf: str) -> SparkSession:
    """Adaptive execution splits skewed joins and sizes shuffles; all times are UTC."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settled(rows: DataFrame) -> DataFrame:
    """Rows that several plans read, worked out once: checkpointed in the folder that `spark.checkpoint.dir` names; only in local mode in one of our own if there is none."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quire-checkpoints-"))
    return rows.checkpoint()
