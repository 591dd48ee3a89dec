"""Tables that a plan reads more than once: written as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import BayesError


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the context's checkpoint folder; a temporary folder only where the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise BayesError("folder_missing")
        found = f"file://{tempfile.mkdtemp(prefix='bayesloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Rows of few, large splits (a file of few row groups, say) dealt to all cores before texts are cut into tokens; tables
    that have a split for each core already stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once; what reads it sees its size and prunes its columns. The files stay until they are deleted."""
    path = fresh_dir(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
