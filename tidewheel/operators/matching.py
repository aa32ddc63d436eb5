"""Matching events of two sources that name the same pair of sides by the times they begin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_in_time(events: DataFrame, games: DataFrame, on: Sequence[str], event: str, game: str, begins: str, starts: str, near_hours: float = 2.0, far_hours: float = 12.0) -> DataFrame:
    """(event, game, gap_seconds, rule): each event with the game of the same sides that starts nearest to it.

    Within near_hours a game matches ('near'). Within far_hours it only does where the sides have one event and one game there ('single'), as
    on a day with two games a wide gap may mean the other one. Of several equally near games the smaller id counts. Sides or times that are
    NULL match nothing. Events meet games by side and by the day or the neighbouring days, so a pair of sides that meets very often costs its
    calendar, not its square.
    """
    day = lambda c: F.floor(F.unix_micros(F.col(c)) / 86400000000)
    e = events.select(event, *on, F.unix_micros(begins).alias("__b"), day(begins).alias("__d")).filter("__b is not null").distinct()
    g = games.select(game, *on, F.unix_micros(starts).alias("__s"), F.explode(F.sequence(day(starts) - 1, day(starts) + 1)).alias("__d")).filter("__s is not null").distinct()
    gap = F.abs(F.col("__b") - F.col("__s")) / 1000000
    met = e.join(g, [*on, "__d"]).withColumn("gap_seconds", gap).filter(F.col("gap_seconds") <= far_hours * 3600)
    games_of = met.groupBy(event).agg(F.count(F.lit(1)).alias("__ng"), F.min(F.struct("gap_seconds", game)).alias("best"))
    events_of = met.groupBy(game).agg(F.countDistinct(event).alias("__ne"))
    best = games_of.select(event, "__ng", F.col("best.gap_seconds").alias("gap_seconds"), F.col(f"best.{game}").alias(game)).join(events_of, game)
    rule = F.when(F.col("gap_seconds") <= near_hours * 3600, "near").when((F.col("__ng") == 1) & (F.col("__ne") == 1), "single")
    return best.withColumn("rule", rule).filter("rule is not null").select(event, game, "gap_seconds", "rule")


def one_each(matches: DataFrame, event: str, game: str) -> DataFrame:
    """Matches in which a game keeps its nearest event only; ties go to the smaller id."""
    w = Window.partitionBy(game).orderBy("gap_seconds", event)
    return matches.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
