"""Folders that all executors share, and cutting lineage between the steps of iterative work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names; one of our own only on a local master without one, as in tests."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if not have.isEmpty():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df written as a table into the shared folder and read back.

    For loops of joins: a checkpoint keeps the constraints and partitionings of the plan that made it, which grow from
    round to round until planning takes longer than the work."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
