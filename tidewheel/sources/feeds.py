"""Game feeds as fetched, JSON text, to typed rows: pitches, events between pitches, and box scores. One scan each, all inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ID = "struct<id: int>"
_OFFENSE = f"struct<first: {_ID}, second: {_ID}, third: {_ID}>"
_EVENT = f"struct<index: int, type: string, isPitch: boolean, details: struct<eventType: string, isOut: boolean, call: struct<code: string>>, offense: {_OFFENSE}, defense: struct<pitcher: {_ID}>, player: {_ID}, count: struct<balls: int, strikes: int, outs: int>, base: int, pitchData: struct<startSpeed: double, breaks: struct<spinRate: double>>>"
_PLAY = f"struct<atBatIndex: int, about: struct<inning: int, halfInning: string>, matchup: struct<pitcher: {_ID}, batter: {_ID}>, result: struct<event: string, homeScore: int, awayScore: int>, playEvents: array<{_EVENT}>>"
GAME = f"struct<gamePk: int, liveData: struct<plays: struct<allPlays: array<{_PLAY}>>>>"
_STATS = "map<string, int>"
_PLAYER = f"struct<person: {_ID}, position: struct<abbreviation: string>, battingOrder: string, stats: struct<batting: {_STATS}, pitching: {_STATS}>>"
TEAM = f"struct<team: {_ID}, players: map<string, {_PLAYER}>>"
BOX = f"struct<home: {TEAM}, away: {TEAM}>"

# Events between pitches that count, by the words of the feed, and the statistics brought out of a box score.
BETWEEN = {"pickoff": "pickoff_throw", "stepoff": "step_off", "balk": "balk", "stolen_base": "steal", "caught_stealing": "caught_stealing", "wild_pitch": "wild_pitch", "passed_ball": "passed_ball", "pitching_substitution": "pitching_change"}
BATTING = {"atBats": "b_at_bats", "hits": "b_hits", "homeRuns": "b_home_runs", "baseOnBalls": "b_walks", "strikeOuts": "b_strikeouts", "stolenBases": "b_steals", "totalBases": "b_total_bases"}
PITCHING = {"outs": "p_outs", "strikeOuts": "p_strikeouts", "baseOnBalls": "p_walks", "hits": "p_hits", "earnedRuns": "p_earned_runs", "numberOfPitches": "p_pitches"}


def _bases(offense: Column) -> Column:
    """Occupied bases as three bits; NULL where the feed names no offence."""
    bit = lambda base, n: F.when(offense[base]["id"].isNotNull(), n).otherwise(0)
    return F.when(offense.isNotNull(), bit("first", 1) + bit("second", 2) + bit("third", 4))


def plays(df: DataFrame, payload: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per play of each game feed: (keep..., game_pk, at_bat_number, inning, top, pitcher_id, batter_id, event, score before, events).

    The score of a play stands behind it, so the one before comes from the play in front. Text that is no feed gives no rows.
    """
    g = df.select(*keep, F.from_json(payload, GAME).alias("__g"))
    p = g.select(*keep, F.col("__g.gamePk").alias("game_pk"), F.posexplode("__g.liveData.plays.allPlays").alias("__n", "p"))
    before = lambda c: F.coalesce(F.lag(F.col(f"p.result.{c}")).over(Window.partitionBy(*keep, "game_pk").orderBy("__n")), F.lit(0))
    return p.select(
        *keep, "game_pk", (F.col("p.atBatIndex") + 1).alias("at_bat_number"), F.col("p.about.inning").alias("inning"), F.lower("p.about.halfInning").startswith("top").alias("top"), F.col("p.matchup.pitcher.id").alias("pitcher_id"),
        F.col("p.matchup.batter.id").alias("batter_id"), F.col("p.result.event").alias("event"), before("homeScore").alias("home_before"), before("awayScore").alias("away_before"), F.col("p.playEvents").alias("events"),
    )


def _thrower(events: Column, at: Column, last: Column) -> Column:
    """Who is on the mound at an event: the last pitcher named up to it (by a pitch, or by coming in), else the next pitch's, else the play's."""
    named = lambda e: F.when(e["isPitch"], e["defense"]["pitcher"]["id"]).when(e["details"]["eventType"] == "pitching_substitution", e["player"]["id"])
    known = F.filter(events, lambda e: (e["index"] <= at) & named(e).isNotNull())
    later = F.filter(events, lambda e: (e["index"] > at) & e["isPitch"] & e["defense"]["pitcher"]["id"].isNotNull())
    return F.coalesce(named(F.try_element_at(known, F.lit(-1))), F.try_element_at(later, F.lit(1))["defense"]["pitcher"]["id"], last)


def pitches(df: DataFrame, payload: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per pitch of each game feed, numbered within its at-bat, with the pitcher who threw it and the score before its play."""
    p = plays(df, payload, keep)
    thrown = F.filter("events", lambda e: F.coalesce(e["isPitch"], F.lit(False)))
    x = p.select("*", F.posexplode(thrown).alias("__i", "e"))
    return x.select(
        *keep, "game_pk", "at_bat_number", (F.col("__i") + 1).alias("pitch_number"), "inning", "top", F.coalesce("e.defense.pitcher.id", "pitcher_id").alias("pitcher_id"), "batter_id", F.col("e.details.call.code").alias("call"), F.col("e.count.balls").alias("balls"),
        F.col("e.count.strikes").alias("strikes"), F.col("e.count.outs").alias("outs"), _bases(F.col("e.offense")).alias("runners_state"), F.col("e.pitchData.startSpeed").alias("velo"), F.col("e.pitchData.breaks.spinRate").alias("spin_rate"),
        F.when(F.col("top"), F.col("away_before") - F.col("home_before")).otherwise(F.col("home_before") - F.col("away_before")).alias("score_diff"), F.when(F.col("__i") == F.size(thrown) - 1, F.col("event")).alias("event"),
    )


def play_events(df: DataFrame, payload: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per event between pitches: (keep..., game_pk, at_bat_number, play_index, event_type, runners_state, base, is_out, pitcher_id, ...).

    An intentional walk is a play without events of its own: it comes out as one row of index -1, with the runners of the play before if the
    feed shows them.
    """
    p = plays(df, payload, keep)
    kind = F.create_map(*[F.lit(x) for pair in BETWEEN.items() for x in pair])
    word = lambda e: F.coalesce(e["details"]["eventType"], e["type"])
    code = lambda e: F.coalesce(F.try_element_at(kind, word(e)), F.try_element_at(kind, e["type"]), F.when(word(e).startswith("pickoff"), "pickoff_throw"), F.when(word(e).startswith("stolen_base"), "steal"), F.when(word(e).startswith("caught_stealing"), "caught_stealing"))
    x = p.select("*", F.explode(F.filter("events", lambda e: ~F.coalesce(e["isPitch"], F.lit(False)) & e["index"].isNotNull() & code(e).isNotNull())).alias("e"))
    cols = [*keep, "game_pk", "at_bat_number", "inning", "top", "batter_id"]
    rows = x.select(*cols, F.col("e.index").alias("play_index"), code(F.col("e")).alias("event_type"), _bases(F.col("e.offense")).alias("runners_state"), F.col("e.base").alias("base"), F.coalesce("e.details.isOut", F.lit(False)).alias("is_out"), _thrower(F.col("events"), F.col("e.index"), F.col("pitcher_id")).alias("pitcher_id"))
    last = F.try_element_at(F.filter("events", lambda e: e["offense"].isNotNull()), F.lit(-1))["offense"]
    w = Window.partitionBy(*keep, "game_pk", "inning", "top").orderBy("at_bat_number")
    walked = p.withColumn("__b", F.lag(_bases(last)).over(w)).filter((F.lower("event") == "intent walk") & (F.coalesce(F.size("events"), F.lit(0)) <= 0))
    walks = walked.select(*cols, F.lit(-1).alias("play_index"), F.lit("intentional_walk").alias("event_type"), F.col("__b").alias("runners_state"), F.lit(None).cast("int").alias("base"), F.lit(False).alias("is_out"), "pitcher_id")
    return rows.unionByName(walks)


def box_scores(df: DataFrame, payload: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per player who appears in a box score (`{"home": ..., "away": ...}`): side, team, order, position, batting and pitching numbers.

    A player without numbers on either side of the game did not appear; a player or team without id gives no row; missing numbers are 0.
    """
    b = df.select(*keep, F.from_json(payload, BOX).alias("__b"))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"__b.{s}.team.id").alias("team_id"), F.map_values(F.col(f"__b.{s}.players")).alias("players")) for s in ("home", "away")])
    x = b.select(*keep, F.explode(sides).alias("s")).select(*keep, "s.side", "s.team_id", F.explode("s.players").alias("p"))
    some = lambda block: F.coalesce(F.size(F.map_keys(F.col(f"p.stats.{block}"))), F.lit(0)) > 0
    x = x.filter(F.col("p.person.id").isNotNull() & F.col("team_id").isNotNull() & (some("batting") | some("pitching")))
    number = lambda block, name: F.coalesce(F.try_element_at(F.col(f"p.stats.{block}"), F.lit(name)), F.lit(0))
    return x.select(
        *keep, "side", "team_id", F.col("p.person.id").alias("player_id"), F.col("p.battingOrder").try_cast("int").alias("batting_order"), F.col("p.position.abbreviation").alias("position"), (number("batting", "gamesPlayed") >= 1).alias("played_bat"), (number("pitching", "gamesPlayed") >= 1).alias("played_pitch"),
        *[number("batting", k).alias(v) for k, v in BATTING.items()], *[number("pitching", k).alias(v) for k, v in PITCHING.items()],
    )
