"""Session builder with the settings the operators are written for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "hustings", cores: int | str = "*", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, AQE on, skew joins on. On a cluster pass the master through spark-submit instead."""
    n = shuffle_partitions or (os.cpu_count() or 8)
    builder = (
        SparkSession.builder.appName(app)
        .master(os.environ.get("SPARK_MASTER", f"local[{cores}]"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint: its lineage ends in files below ``spark.checkpoint.dir``, which all executors share. Only a
    local master may fall back to a temporary folder."""
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-hustings-"))
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()
