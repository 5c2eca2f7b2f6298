"""Folders that driver and executors share, and the size of inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset on one machine, as in tests, a temporary one. A cluster without a shared folder is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if where is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="stratalake-")
        sc.setCheckpointDir(where)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def stash(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder, for the small frames of iterations."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
