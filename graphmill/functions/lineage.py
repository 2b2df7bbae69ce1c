"""Cutting the lineage of iterated plans."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name that all executors see, in spark.checkpoint.dir; where that is
    unset, in a temporary one if the session has one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphmill-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Whether a query's shuffles go when it has ended; otherwise they stay until the driver's memory is swept.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder. Its last stage runs once (a checkpoint's
    runs twice), it is smaller, and its columns are read one by one. The shuffles that made
    it leave the disk, as nothing reads them any more."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, label)
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(RELEASE)
        else:
            spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """df without its lineage, as a table in the shared folder."""
    return stored(df, "settled")
