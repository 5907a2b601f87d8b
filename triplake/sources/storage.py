"""Tables that a job writes on its way, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, from spark.checkpoint.dir; a local one is chosen only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", f"file:///tmp/checkpoints/{uuid.uuid4().hex}")
    return spark.conf.get("spark.checkpoint.dir")


def run_folder(spark: SparkSession) -> str:
    """The part of the shared folder that this application writes to."""
    return f"{shared_folder(spark)}/run-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the run's folder that nothing was written to."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the run's folder: its lineage ends there and a lost executor costs nothing."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes all that this application has written there. Results that read it must be stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
