"""The folder that the driver and all executors share, and rows dealt to tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below spark.checkpoint.dir; below a temporary folder only where that is unset and all runs in one process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="attesta-")
    return f"{top}/{name}-{uuid.uuid4().hex}"


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame) -> DataFrame:
    """df over as many tasks as the session names, for work that costs far more a row than its bytes say: a file of a few MB is one task whatever its rows cost."""
    return df.repartition(tasks(df))


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read back from the shared folder."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
