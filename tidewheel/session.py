"""Session building and the few session-wide helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine is written for. A cluster's own settings win: they are only applied by build_session.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", app: str = "tidewheel", **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword arguments use `__` for dots and win over the defaults."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that their Python workers can import it wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="tidewheel-"), "tidewheel.zip")
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder, so that later stages survive lost executors and do not run it twice.

    The folder is the one the cluster names in spark.checkpoint.dir; only a local session without one (tests) uses a temporary one. With
    spark.cleaner.referenceTracking.cleanCheckpoints a checkpoint goes when nothing refers to it any more.
    """
    sc = df.sparkSession.sparkContext
    ship(df.sparkSession)
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master or "").startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "tidewheel-checkpoints")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def parallelism(spark: SparkSession) -> int:
    """The number of shuffle partitions of the session: the unit of all block counts that are derived from the cluster and not from the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
