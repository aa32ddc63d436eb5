"""Writing: partition overwrite, keyed upserts without MERGE, versioned publishing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators.relational import upsert
from tidewheel.session import cut
from tidewheel.sources import storage


def overwrite_partitions(df: DataFrame, path: str, partition: str, order: Sequence[str] = ()) -> None:
    """Replace the partitions that `df` has rows of; others stay. Rows are sorted within files, which keeps their statistics sharp."""
    out = df.repartition(partition).sortWithinPartitions(partition, *order) if order else df.repartition(partition)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upsert_table(spark: SparkSession, arriving: DataFrame, path: str, keys: Sequence[str], partition: str) -> None:
    """Upsert into a partitioned table: only the partitions that arriving rows name are read and rewritten. Keys include the partition."""
    arriving = cut(arriving.dropDuplicates(list(keys)))
    if not storage.exists(spark, path):
        overwrite_partitions(arriving, path, partition)
        return
    touched = arriving.select(partition).distinct()
    stored = spark.read.parquet(path).join(F.broadcast(touched), partition, "left_semi").select(*arriving.columns)
    overwrite_partitions(cut(upsert(stored, arriving, keys)), path, partition)


def ordered_export(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A table in total order: files follow each other, and rows are sorted within each. Make the order total."""
    df.orderBy(*order).write.mode("overwrite").parquet(path)


def create_table(df: DataFrame, name: str, path: str) -> DataFrame:
    """CREATE TABLE AS SELECT: written down at `path`, and named in the session; returns the table."""
    df.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    stored.createOrReplaceTempView(name)
    return stored


def array_rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "vector") -> DataFrame:
    """Rows of a float matrix: keys and one array of single-precision numbers, NaN where a column is NULL."""
    return df.select(*keys, F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(float("nan")).cast("float")) for c in columns]).alias(name))


def array_columns(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "vector") -> DataFrame:
    """The columns of array_rows again, NaN read as NULL."""
    value = lambda i: F.when(~F.isnan(F.col(name)[i]), F.col(name)[i])
    return df.select(*keys, *[value(i).alias(c) for i, c in enumerate(columns)])


def documents(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """(key, document): one JSON object for each row, NULL fields left out, fields in the order given."""
    return df.select(key, F.to_json(F.struct(*values)).alias("document"))


def publish(df: DataFrame, root: str, keep: int = 3) -> str:
    """Write a new version below `root`, then switch the pointer to it in one rename, then drop all but the `keep` newest. Returns its name."""
    spark = df.sparkSession
    existing = [d for d in storage.folders(spark, root) if d.startswith("v")]
    version = f"v{int(existing[-1][1:7]) + 1 if existing else 0:06d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{root}/{version}")
    storage.write_text(spark, f"{root}/_CURRENT", json.dumps({"version": version, "columns": df.columns}))
    for old in existing[: max(0, len(existing) + 1 - keep)]:
        storage.remove(spark, f"{root}/{old}")
    return version


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version that the pointer names."""
    return spark.read.parquet(f"{root}/{json.loads(storage.read_text(spark, root + '/_CURRENT'))['version']}")
