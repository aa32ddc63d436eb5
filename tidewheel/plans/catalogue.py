"""Registration of queries: every plan module has its own QUERIES and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.session import read


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        """Register a function(t) -> DataFrame, where t(name) reads a table; `sql` says what it must return."""

        def add(f):
            key = name or f.__name__

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda table: PITCHES(spark, sf_dir) if table == "pitches" else read(spark, sf_dir, table))

            run.__doc__, run.__name__ = f.__doc__, key
            self.queries[key] = run
            if sql:
                self.sql[key] = f"WITH pitches AS ({PITCHES_SQL})\n{sql.strip()}" if "pitches" in sql and not sql.strip().upper().startswith("WITH") else (f"WITH pitches AS ({PITCHES_SQL}),\n{sql.strip()[4:]}" if "pitches" in sql else sql.strip())
            return f

        return add


def PITCHES(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    """pitch_pool with every pitch once: its latest delivery. NaN reads as NULL, features are doubles.

    Every column is an aggregate of its own, so that a query's scan and shuffle hold only the columns it uses; all deliveries of a pitch agree
    on everything but loaded_at.
    """
    raw = read(spark, sf_dir, "pitch_pool")
    seen = F.coalesce("loaded_at", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    floats = ("velo", "ivb", "hb", "spin_rate")
    value = lambda c: F.when(~F.isnan(c), F.col(c).cast("double")) if c in floats else F.col(c)
    columns = [c for c in raw.columns if c not in ("pitch_id", "loaded_at")]
    return raw.filter("pitch_id is not null").groupBy("pitch_id").agg(F.max("loaded_at").alias("loaded_at"), *[F.max_by(value(c), seen).alias(c) for c in columns])


PITCHES_SQL = """SELECT pitch_id, loaded_at, game_pk, at_bat_number, pitch_number, game_date, season, pitcher_id, p_throws, batter_id, stand,
    CASE WHEN isnan(velo) THEN NULL ELSE CAST(velo AS DOUBLE) END AS velo, CASE WHEN isnan(ivb) THEN NULL ELSE CAST(ivb AS DOUBLE) END AS ivb,
    CASE WHEN isnan(hb) THEN NULL ELSE CAST(hb AS DOUBLE) END AS hb, CASE WHEN isnan(spin_rate) THEN NULL ELSE CAST(spin_rate AS DOUBLE) END AS spin_rate,
    count_balls, count_strikes, outs, runners_state, inning, score_diff, events, outcome_type
  FROM (SELECT *, row_number() OVER (PARTITION BY pitch_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM pitch_pool WHERE pitch_id IS NOT NULL) WHERE rn = 1"""
