"""Written intermediate tables: they cut lineage, and every task that runs again reads the same rows in the same parts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one of our own on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return base.rstrip("/")


def keep(df: DataFrame, what: str = "table") -> DataFrame:
    """df's rows, written once to the shared folder and read from there."""
    path = f"{shared_dir(df.sparkSession)}/parchment-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
