"""Attributes as known at event time: periodic as-known snapshots, a change log, and a join that replays only the intervening changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period_of(day: Column) -> Column:
    """Number of the calendar month that holds `day`; a snapshot is taken at the start of each."""
    return F.year(day) * 12 + F.month(day)


def change_log(facts: DataFrame, entity: Sequence[str], asof: str, known_at: str, fact_id: str) -> DataFrame:
    """(entity, eff, best): the best fact of those that became usable on day `eff`.

    A fact is usable for events of days after both its as-of date and the moment it became known, so its first day is one past the later of
    the two. `best` is (asof, known, id); its order is the order of preference. Facts that lack any of the three are never usable. Repeated
    rows fold into one map-side; an entity keeps at most one row per day.
    """
    ok = facts.filter(F.col(asof).isNotNull() & F.col(known_at).isNotNull() & F.col(fact_id).isNotNull())
    for c in entity:
        ok = ok.filter(F.col(c).isNotNull())
    eff = F.date_add(F.greatest(F.col(asof).cast("date"), F.col(known_at).cast("date")), 1)
    best = F.struct(F.col(asof).alias("asof"), F.col(known_at).alias("known"), F.col(fact_id).alias("id"))
    return ok.select(*entity, eff.alias("eff"), best.alias("best")).groupBy(*entity, "eff").agg(F.max("best").alias("best"))


def snapshots(log: DataFrame, entity: Sequence[str], asked: DataFrame) -> DataFrame:
    """(entity, period, base, changes) for every period in `asked` (distinct entity and period) or in the log.

    base is the best fact known when the period begins; changes are the log's entries of that period, at most one a day, so a row is bounded
    by the days of a month. The running maximum goes over months, not over rows delivered, so a hot entity stays small.
    """
    by_period = log.withColumn("period", period_of(F.col("eff"))).groupBy(*entity, "period").agg(F.max("best").alias("top"), F.collect_list(F.struct("eff", "best")).alias("changes"))
    grid = by_period.unionByName(asked.select(*entity, "period"), allowMissingColumns=True).groupBy(*entity, "period").agg(F.max("top").alias("top"), F.first("changes", ignorenulls=True).alias("changes"))
    before = Window.partitionBy(*entity).orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    return grid.select(*entity, "period", F.max("top").over(before).alias("base"), "changes")


def as_known_join(events: DataFrame, facts: DataFrame, entity: Sequence[str], day: str, asof: str, known_at: str, fact_id: str) -> DataFrame:
    """Every event with the fact of its entity as known before its day: the columns of `events` plus `fact_id`, NULL where none was known.

    Of the usable facts the latest as-of date counts, then the latest moment of becoming known, then the largest id. Events with a NULL
    entity or day get NULL. Only the distinct (entity, day) pairs meet the snapshots, so the join is as large as the calendar of the
    entities, however many events one of them holds; the events then look their pair up.
    """
    log = change_log(facts, entity, asof, known_at, fact_id)
    pairs = events.select(*entity, F.col(day).alias("__day")).filter(F.col("__day").isNotNull()).distinct().withColumn("period", period_of(F.col("__day")))
    snaps = snapshots(log, entity, pairs.select(*entity, "period").distinct())
    replayed = F.array_max(F.transform(F.filter(F.col("changes"), lambda c: c["eff"] <= F.col("__day")), lambda c: c["best"]))
    known = pairs.join(snaps, [*entity, "period"], "left").select(*entity, "__day", F.greatest("base", replayed)["id"].alias("__fact"))
    known = known.select(*[F.col(c).alias(f"__{c}") for c in entity], F.col("__day"), F.col("__fact"))
    on = [F.col(c) == F.col(f"__{c}") for c in entity] + [F.col(day) == F.col("__day")]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return events.join(known, condition, "left").drop(*[f"__{c}" for c in entity], "__day").withColumnRenamed("__fact", fact_id)
