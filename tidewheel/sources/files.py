"""Reading: explicit schemas, optional columns, typed empty tables, coerced CSV."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.sources import storage


def typed_empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def table(spark: SparkSession, path: str, columns: Mapping[str, str] | None = None) -> DataFrame:
    """A Parquet table; with `columns` exactly those, in their types, NULL where the file lacks one. A missing path is a typed empty table."""
    if columns and not storage.exists(spark, path):
        return typed_empty(spark, ", ".join(f"`{c}` {t}" for c, t in columns.items()))
    df = spark.read.parquet(path)
    if not columns:
        return df
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def csv_rows(spark: SparkSession, path: str, schema: Mapping[str, str], nulls: Sequence[str] = ("", "null", "NA", "--")) -> DataFrame:
    """A CSV with header as typed rows plus `bad_columns`, the names of columns whose text could not be read as their type (then NULL).

    Columns are found by name; surplus ones are ignored, missing ones are NULL. Numbers may have thousands commas and a percent sign.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    known = {c.strip().lower(): c for c in raw.columns}

    def text(name: str) -> Column:
        if name.lower() not in known:
            return F.lit(None).cast("string")
        t = F.trim(F.col(f"`{known[name.lower()]}`"))
        return F.when(~t.isin(*nulls), t)

    def value(name: str, kind: str) -> Column:
        t = text(name)
        if kind in ("int", "bigint", "smallint", "double", "float"):
            t = F.regexp_replace(t, "[,%]", "")
        return t.try_cast(kind)

    bad = F.array_compact(F.array(*[F.when(text(c).isNotNull() & value(c, t).isNull(), F.lit(c)) for c, t in schema.items()]))
    return raw.select(*[value(c, t).alias(c) for c, t in schema.items()], bad.alias("bad_columns"))


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a declared schema; `corrupt` holds a line that cannot be read."""
    return spark.read.schema(f"{schema}, corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)


def attach(spark: SparkSession, root: str, alias: str) -> list[str]:
    """Make the Parquet tables below another root readable as `alias_table` views, for checks against a second store. Returns their names."""
    names = []
    for folder in storage.folders(spark, root):
        names.append(f"{alias}_{folder.removesuffix('.parquet')}")
        spark.read.parquet(f"{root}/{folder}").createOrReplaceTempView(names[-1])
    return names


def newest(df: DataFrame, partition: str, n: int) -> DataFrame:
    """Rows of the n newest partition values: a literal IN list, so that the scan prunes."""
    values = [r[0] for r in df.select(partition).distinct().orderBy(F.col(partition).desc_nulls_last()).limit(n).collect()]
    return df.filter(F.col(partition).isin(*values)) if values else df.limit(0)


def jdbc_table(spark: SparkSession, url: str, name: str, partition: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table of another database, read in `parts` ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=partition, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()
