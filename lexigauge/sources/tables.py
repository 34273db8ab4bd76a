"""Parquet tables of a data folder, and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only where neither the setting nor the context names a folder, and on one machine (tests), a
    temporary one is made and set; on a cluster that is an error.
    """
    context = spark.sparkContext._jsc.sc()
    known = context.getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="shared-"))
    return context.getCheckpointDir().get()


def cut(df: DataFrame, what: str = "step") -> DataFrame:
    """``df`` written once to the shared folder and read back, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table that :func:`cut` wrote."""
    spark = df.sparkSession
    jvm, shared = spark.sparkContext._jvm, shared_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.toString().split(":", 1)[-1].lstrip("/").startswith(shared.split(":", 1)[-1].lstrip("/")):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
