"""Session defaults shared by the tests, the benchmark and ad-hoc use."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent

#: Settings the operators rely on or that keep results portable.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "stratalog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; ``conf`` (underscores for dots) overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Let the executors import this package: the driver serves it as a zip, once a context, unless PYTHONPATH has it."""
    context = spark.sparkContext
    if str(ROOT) not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and not getattr(context, "_stratalog_shipped", False):
        target = Path(tempfile.mkdtemp(prefix="stratalog-")) / "stratalog.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted((ROOT / "stratalog").rglob("*.py")):
                archive.write(path, path.relative_to(ROOT))
        context.addPyFile(str(target))
        context._stratalog_shipped = True
    return spark
