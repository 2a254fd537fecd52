"""Cutting lineage and reading tables, the same way on a laptop and on a cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Take the folder the cluster names in spark.checkpoint.dir. Only where all runs in one process and none is named
    is one made; a cluster's machines would not see it, so there its absence is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="fairloom-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for what outlives executors; what is in it goes with the cluster's scratch space."""
    use_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, in reliable storage that outlives executors."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, *keys: str, rows: int) -> DataFrame:
    """The same rows, dealt by keys into as many partitions as they fill, so that a task's share stays what it is as a
    table grows."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts, *keys)


def written(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: compressed, and read again by columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
