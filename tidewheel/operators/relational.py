"""Relational operators that Spark has no single word for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first `n` rows of every key: QUALIFY ROW_NUMBER() and DISTINCT ON. Make the order total. The rank filter stops early map-side."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def top_per(df: DataFrame, keys: Sequence[str], best: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """The row with the greatest `best` of every key, by a partial aggregate: for few columns cheaper than a window, and proof against hot keys."""
    row = F.max(F.struct(*best, *[c for c in carry if c not in best])).alias("__r")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in [*best, *[c for c in carry if c not in best]]])


def merge_outer(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FULL OUTER JOIN with one set of key columns; NULL keys meet nothing."""
    return left.join(right, list(keys), "full_outer")


def upsert(stored: DataFrame, arriving: DataFrame, keys: Sequence[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE: arriving rows replace stored rows of their key. Keys must be unique in `arriving`."""
    return stored.join(arriving.select(*keys), list(keys), "left_anti").unionByName(arriving)


def insert_if_absent(stored: DataFrame, arriving: DataFrame, keys: Sequence[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING: only arriving rows of new keys are added."""
    return stored.unionByName(arriving.join(stored.select(*keys), list(keys), "left_anti"))


def upsert_where(stored: DataFrame, arriving: DataFrame, keys: Sequence[str], condition: str) -> DataFrame:
    """An upsert whose keys are unique only among rows for which `condition` holds: such rows replace such rows, all others are added."""
    marked = stored.withColumn("__in", F.coalesce(F.expr(condition), F.lit(False)))
    target = arriving.filter(condition).select(*keys).distinct().withColumn("__in", F.lit(True))
    return marked.join(target, [*keys, "__in"], "left_anti").select(*stored.columns).unionByName(arriving)


def broken_rules(rules: Mapping[str, Column]) -> Column:
    """The names of all rules that hold for a row, as an array; a rule that is NULL does not hold."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()]))


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """UPDATE ... FROM: `columns` of matched rows are taken from `source` (unique by key), NULLs included; others stay."""
    marked = source.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = target.join(marked, list(keys), "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose rows differ between two tables with the same columns, and on which side they stand: 'left', 'right' or 'changed'."""
    values = [c for c in a.columns if c not in keys]
    x = a.select(*keys, F.struct(*values).alias("__a"), F.lit(True).alias("__in_a"))
    y = b.select(*keys, F.struct(*values).alias("__b"), F.lit(True).alias("__in_b"))
    j = x.join(y, list(keys), "full_outer")
    side = F.when(F.col("__in_b").isNull(), "left").when(F.col("__in_a").isNull(), "right").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return j.select(*keys, side.alias("side")).filter("side is not null")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """EXCEPT ALL both ways: rows of one table that the other has less often, with their side. Empty where the tables are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), frames)


def rules_union(df: DataFrame, keep: Sequence[str], rules: Mapping[str, tuple[Column, Mapping[str, Column]]]) -> DataFrame:
    """One output row for every rule that holds for a row: an N-way UNION ALL in a single scan.

    `rules` maps a rule's name to its condition and its output columns (the same names in each).
    """
    rows = [F.when(condition, F.struct(F.lit(name).alias("rule"), *[v.alias(k) for k, v in values.items()])) for name, (condition, values) in rules.items()]
    return df.select(*keep, F.explode(F.array_compact(F.array(*rows))).alias("__r")).select(*keep, "__r.*")


def nearest_row(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, other: str, carry: Sequence[str]) -> DataFrame:
    """Every left row with the right row of its group whose `other` is nearest to its `at`, the smaller one on equal distance.

    Two running windows over the union of both sides, one looking back and one ahead: linear in the rows, where a join would pair them all.
    Left rows without a right row in their group keep NULLs.
    """
    row = F.struct(F.col(other).alias("__o"), *carry)
    both = left.select(*on, *[c for c in left.columns if c not in on], F.col(at).alias("__t"), F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("__r"), F.lit(1).alias("__side"))
    points = right.select(*on, F.col(other).alias("__t"), row.alias("__r"), F.lit(0).alias("__side"))
    mixed = both.unionByName(points, allowMissingColumns=True)
    back = Window.partitionBy(*on).orderBy(F.col("__t"), F.col("__side")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*on).orderBy(F.col("__t").desc(), F.col("__side")).rowsBetween(Window.unboundedPreceding, 0)
    found = mixed.withColumn("__b", F.last("__r", ignorenulls=True).over(back)).withColumn("__f", F.last("__r", ignorenulls=True).over(ahead)).filter("__side = 1")
    take_back = F.col("__b").isNotNull() & (F.col("__f").isNull() | (F.col("__t") - F.col("__b.__o") <= F.col("__f.__o") - F.col("__t")))
    pick = F.when(take_back, F.col("__b")).otherwise(F.col("__f"))
    return found.select(*left.columns, pick.getField("__o").alias(other if other not in left.columns else f"nearest_{other}"), *[pick.getField(c).alias(c) for c in carry])


def latest_as_of(df: DataFrame, keys: Sequence[str], date: str, cutoff, tie: Sequence[str]) -> DataFrame:
    """The latest row of every key whose date is not after `cutoff`."""
    return first_per(df.filter(F.col(date) <= F.lit(cutoff)), keys, [F.col(date).desc(), *tie])


def as_of(df: DataFrame, date: str, cutoff) -> DataFrame:
    """Rows that may contribute under a cutoff: a NULL date may not."""
    return df.filter(F.col(date) <= F.lit(cutoff))


def assert_no_leak(df: DataFrame, date: str, cutoff) -> DataFrame:
    """`df` unchanged, after failing if any of its rows is later than the cutoff."""
    latest = df.agg(F.max(date)).first()[0]
    if latest is not None and str(latest) > str(cutoff):
        raise ValueError(f"a row of {latest} contributes to a cutoff of {cutoff}")
    return df


def trailing_sum(df: DataFrame, key: str, day: str, value: str, days: int) -> Column:
    """Sum of the `days` days strictly before each row's day, as a range window over day numbers."""
    w = Window.partitionBy(key).orderBy(F.datediff(F.col(day), F.lit("1970-01-01"))).rangeBetween(-days, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def stale_partitions(source: DataFrame, recorded: DataFrame, partition: str, date: str, builder: str) -> DataFrame:
    """Partitions to rebuild: never recorded, no watermark, newer data, another row count (a NULL count is another), or another builder.

    `recorded` has (partition, watermark, row_count, builder_version).
    """
    now = source.groupBy(partition).agg(F.max(date).alias("max_date"), F.count(F.lit(1)).alias("n"))
    j = now.join(recorded.withColumn("__known", F.lit(True)), partition, "left")
    stale = F.col("__known").isNull() | F.col("watermark").isNull() | (F.col("max_date") > F.col("watermark")) | ~F.col("n").eqNullSafe(F.col("row_count")) | ~F.col("builder_version").eqNullSafe(F.lit(builder))
    return j.select(partition, "max_date", "n", stale.alias("stale"))
