"""Exact quantiles of groups of any size: a mergeable sketch brackets them, and only the rows in the brackets are ranked."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of the sketch; groups of up to 4 x STEPS rows are ranked as a whole.
STEPS = 10_000


def exact(df: DataFrame, by: Sequence[str], value: Column, qs: Sequence[float]) -> DataFrame:
    """(by, n, q0, q1, ...): the interpolated quantiles `qs` of the values of each group; NULL and NaN do not count.

    One pass gives brackets around each quantile that are certain to hold it, a second counts the rows below them and folds those inside to
    distinct values, at most about four in STEPS of a group's rows for each quantile. So no task holds a group. Groups without values do not
    come out; without `by` there is one row even of an empty table.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    v = F.col("__v")
    data = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], value.cast("double").alias("__v")).filter(v.isNotNull() & ~F.isnan(v))
    eps = 2 / STEPS
    ends = [p for q in qs for p in (max(q - eps, 0.0), min(q + eps, 1.0))]
    sketch = data.groupBy(*keys).agg(F.percentile_approx("__v", ends, STEPS).alias("__e"), F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    small = F.col("__n") <= 4 * STEPS
    low = lambda i: F.when(small | (F.lit(qs[i]) <= eps), F.col("__min")).otherwise(F.col("__e")[2 * i])
    high = lambda i: F.when(small | (F.lit(qs[i]) >= 1 - eps), F.col("__max")).otherwise(F.col("__e")[2 * i + 1])
    bounds = sketch.select(*[F.col(k).alias(f"{k}b") for k in keys], "__n", *[low(i).alias(f"__l{i}") for i in range(len(qs))], *[high(i).alias(f"__h{i}") for i in range(len(qs))])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}b")) for k in keys], F.lit(True))
    joined = data.join(bounds if keys else F.broadcast(bounds), same)
    within = [v.between(F.col(f"__l{i}"), F.col(f"__h{i}")) for i in range(len(qs))]
    # One row for each distinct value inside a bracket; all rows below and between fold into one that only carries counts.
    inside = reduce(lambda a, b: a | b, within)
    folded = joined.groupBy(*keys, F.when(inside, v).alias("__x")).agg(F.count(F.lit(1)).alias("__c"), F.max("__n").alias("__n"), *[F.count_if(v < F.col(f"__l{i}")).alias(f"__b{i}") for i in range(len(qs))], *[F.max(within[i]).alias(f"__w{i}") for i in range(len(qs))])
    every = Window.partitionBy(*keys)
    below = folded.select("*", *[F.sum(f"__b{i}").over(every).alias(f"__s{i}") for i in range(len(qs))]).filter("__x is not null")
    run = every.orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    cums = below.select("*", *[(F.col(f"__s{i}") + F.sum(F.when(F.col(f"__w{i}"), F.col("__c")).otherwise(0)).over(run)).alias(f"__r{i}") for i in range(len(qs))])
    at = lambda i: F.lit(float(qs[i])) * (F.col("__n") - 1)
    first = lambda i, rank: F.min(F.when(F.col(f"__w{i}") & (F.col(f"__r{i}") > rank), F.col("__x")))
    out = cums.groupBy(*keys).agg(F.max("__n").alias("__n"), *[first(i, F.floor(at(i))).alias(f"__lo{i}") for i in range(len(qs))], *[first(i, F.ceil(at(i))).alias(f"__hi{i}") for i in range(len(qs))])
    part = lambda i: at(i) - F.floor(at(i))
    value_of = lambda i: (1 - part(i)) * F.col(f"__lo{i}") + part(i) * F.col(f"__hi{i}")
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], F.coalesce("__n", F.lit(0)).alias("n"), *[value_of(i).alias(f"q{i}") for i in range(len(qs))])
