"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir; where that is unset, on a local master only, under one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="stratalog-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def moved(spark: SparkSession, folder: str, target: str) -> bool:
    """Give a folder another name, in a folder that is made if need be; False if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path(folder)):
        return False
    fs.mkdirs(path(target).getParent())
    if not fs.rename(path(folder), path(target)):
        raise OSError(f"{folder} cannot become {target}")
    return True
