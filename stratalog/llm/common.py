"""Pieces that several operators share: folds, words, the shared folder and cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Tables that save() has written in this process and that were not dropped.
_saved: list[str] = []
#: Names in the session's catalogue of those that are bucketed, by path.
_catalogued: dict[str, str] = {}
_lock, _cleaning, _before = threading.Lock(), 0, None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, on a local master only, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="stratalog-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that begin in here remove their shuffle files when they end; nested and concurrent uses keep it on until the last ends."""
    global _cleaning, _before
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _lock:
        if not _cleaning:
            _before = spark.conf.get(key, None)
            spark.conf.set(key, "true")
        _cleaning += 1
    try:
        yield
    finally:
        with _lock:
            _cleaning -= 1
            if not _cleaning and _before is None:
                spark.conf.unset(key)
            elif not _cleaning:
                spark.conf.set(key, _before)


def save(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: this cuts lineage and survives lost executors.

    Shuffle files of the write are removed when it ends, so a job of several phases holds one phase's shuffle at a time. With
    ``keep`` the table outlives a scratch() around it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.parquet(path)
    if not keep:
        _saved.append(path)
    return spark.read.schema(df.schema).parquet(path)


def save_bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """save(), bucketed by ``column``: grouping by it later moves no row of the table."""
    spark = df.sparkSession
    path, unique = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    with _cleaned(spark):
        df.repartition(buckets, column).write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(unique)
    _saved.append(path)
    _catalogued[path] = unique
    return spark.table(unique)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _catalogued:
        spark.sql(f"drop table if exists {_catalogued.pop(path)}")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_saved(df: DataFrame) -> None:
    """Remove a table that save() wrote and that no later result needs."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)
        _saved[:] = [p for p in _saved if p.rsplit("/", 1)[-1] != path.rsplit("/", 1)[-1]]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that save() writes in here go at the end: for jobs whose result is written or collected inside. One thread at a time."""
    before = len(_saved)
    try:
        yield
    finally:
        while len(_saved) > before:
            _delete(spark, _saved.pop())


def release(spark: SparkSession) -> None:
    """Remove all tables that save() wrote in this process; results that were not written or collected yet become unreadable."""
    while _saved:
        _delete(spark, _saved.pop())
