"""Cutting lineage in iterative operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names, else one in the warehouse, which executors share too."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/affinity-checkpoints"


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the driver's process ends."""
    path = f"{shared_folder(spark)}/affinity-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    atexit.register(_discard, spark, path)
    return path


def _discard(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended already
        return


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A result written to the shared folder and read again.

    Unlike a checkpoint it leaves nothing of the old plan, not even the constraints that
    the optimizer carries along, which grow without bound in long iterations; the number of
    partitions follows the size. It changes no setting of the session.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
