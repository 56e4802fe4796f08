"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a local folder where none is set (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file:///tmp/larkspur-checkpoints"
    return path.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/larkspur/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{application_dir(spark)}/{uuid.uuid4().hex}/{name}"


def cleanup(spark: SparkSession) -> None:
    """Deletes all that this application wrote there; results that still read it must have been stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(application_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
