"""Verdicts over ordered plays, and lines that move over time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators import quantiles
from tidewheel.session import ship

#: Outs without which a starter of the winning side does not win, and the widest lead that a save protects.
STARTER_OUTS, SAVE_LEAD = 15, 3


def decisions(plays: DataFrame, game: str, play: str, side: str, pitcher: str, outs: str, diff: str) -> DataFrame:
    """(game, winner_id, loser_id, saver_id) from the plays of each game in order.

    `side` is the fielding side, 'home' or 'away', `diff` the home side's lead behind the play. The pitchers of record are those of each
    side's last fielding play when the winner takes the lead for good, or the side's first pitcher if it has not fielded yet. A starter of
    fewer than 15 outs gives the win to the reliever of most outs, ties to the first seen, if any has one. The finisher saves it if they did
    not win and once led by 3 or less. A level game has no row. A game's plays are as few as its innings, so windows over a game are small.
    """
    g = Window.partitionBy(game)
    upto = g.orderBy(play).rowsBetween(Window.unboundedPreceding, 0)
    s = plays.withColumn("__final", F.max_by(diff, play).over(g)).filter(F.col("__final") != 0)
    mine = F.when(F.col("__final") > 0, "home").otherwise("away")
    s = s.withColumn("__lead", F.when(F.col("__final") > 0, F.col(diff)).otherwise(-F.col(diff))).withColumn("__own", F.col(side) == mine)
    s = s.withColumns({
        "__win": F.last(F.when(F.col("__own"), F.col(pitcher)), ignorenulls=True).over(upto), "__lose": F.last(F.when(~F.col("__own"), F.col(pitcher)), ignorenulls=True).over(upto),
        "__level": F.coalesce(F.max(F.when(F.col("__lead") <= 0, F.col(play))).over(g), F.lit(-1)),
    })
    decisive = F.col(play) > F.col("__level")
    per = s.groupBy(game).agg(
        F.min(F.when(decisive, F.struct(play, "__win", "__lose"))).alias("d"), F.max(F.struct(play, "__win"))["__win"].alias("finisher"),
        F.min(F.when(~F.col("__own"), F.struct(play, pitcher)))[pitcher].alias("loser_first"),
    )
    arms = s.filter("__own").groupBy(game, pitcher).agg(F.min(play).alias("first"), F.sum(outs).alias("outs"))
    w = Window.partitionBy(game).orderBy("first")
    ranked = arms.withColumn("n", F.row_number().over(w))
    staff = ranked.groupBy(game).agg(
        F.min(F.when(F.col("n") == 1, F.struct(pitcher, "outs"))).alias("st"),
        F.min(F.when((F.col("n") > 1) & (F.col("outs") > 0), F.struct((-F.col("outs")).alias("o"), F.col("first"), F.col(pitcher))))[pitcher].alias("best"),
    )
    record = F.coalesce("d.__win", F.col("st")[pitcher])
    short = (record == F.col("st")[pitcher]) & (F.col("st.outs") < STARTER_OUTS) & F.col("best").isNotNull()
    verdict = per.join(staff, game, "left").select(game, F.when(short, F.col("best")).otherwise(record).alias("winner_id"), F.coalesce("d.__lose", "loser_first").alias("loser_id"), "finisher")
    close = s.join(verdict.select(game, F.col("finisher").alias("__win")), [game, "__win"], "left_semi").groupBy(game).agg(F.max(F.col("__lead").between(1, SAVE_LEAD)).alias("close"))
    saved = F.col("finisher").isNotNull() & (F.col("finisher") != F.col("winner_id")) & F.coalesce("close", F.lit(False))
    return verdict.join(close, game, "left").select(game, "winner_id", "loser_id", F.when(saved, F.col("finisher")).alias("saver_id"))


def change_points(rows: DataFrame, group: str, sector: str, season: str, value: str, q: float, least_rows: int, least_gap: float) -> DataFrame:
    """(group, from_season, to_season, sectors): the neighbouring seasons of a group between which the q-quantile lines of some sectors moved.

    Seasons are split where the largest gap of any sector's lines before and behind is widest (then where gaps sum up most, then at the later
    season), and both parts again, as long as a gap reaches least_gap on least_rows rows on either side. Lines of all stretches of seasons are
    exact quantiles found in one pass; a group's search then reads one row for each sector and stretch, bounded by the square of its seasons.
    """
    ship(rows.sparkSession)
    ok = rows.filter(F.col(group).isNotNull() & F.col(sector).isNotNull() & F.col(season).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    seasons = ok.groupBy(group).agg(F.array_sort(F.collect_set(season)).alias("__all"))
    a = ok.join(seasons, group)
    own = F.col(season)
    stretches = F.flatten(F.transform(F.filter("__all", lambda x: x <= own), lambda lo: F.transform(F.filter("__all", lambda x: x >= own), lambda hi: F.struct(lo.alias("lo"), hi.alias("hi")))))
    spread = a.select(group, F.col(sector).alias("__sector"), F.explode(stretches).alias("__s"), F.col(value).alias("__v")).select(group, "__sector", F.col("__s.lo").alias("__lo"), F.col("__s.hi").alias("__hi"), "__v")
    lines = quantiles.exact(spread, [group, "__sector", "__lo", "__hi"], F.col("__v"), [q]).join(seasons, group)
    kinds = dict(rows.dtypes)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        line = {(r.lo, r.hi, r.sector): (r.q, r.n) for r in pdf.rename(columns={"__lo": "lo", "__hi": "hi", "__sector": "sector", "q0": "q"})[["lo", "hi", "sector", "q", "n"]].itertuples(index=False)}
        sectors, found = sorted(pdf["__sector"].unique()), []

        def split(members: list) -> None:
            best = None
            for i in range(1, len(members)):
                moved = []
                for s in sectors:
                    before, behind = line.get((members[0], members[i - 1], s)), line.get((members[i], members[-1], s))
                    if before and behind and min(before[1], behind[1]) >= least_rows and abs(behind[0] - before[0]) >= least_gap:
                        moved.append((s, abs(behind[0] - before[0])))
                if moved:
                    score = (max(g for _, g in moved), sum(g for _, g in moved), i)
                    if best is None or score > best[0]:
                        best = (score, [s for s, _ in moved])
            if best is not None:
                i = best[0][2]
                found.append((members[i - 1], members[i], best[1]))
                split(members[:i])
                split(members[i:])

        split(list(pdf["__all"].iloc[0]))
        return pd.DataFrame([(pdf[group].iloc[0], *f) for f in sorted(found)], columns=[group, "from_season", "to_season", "sectors"])

    return lines.groupBy(group).applyInPandas(search, f"{group} {kinds[group]}, from_season {kinds[season]}, to_season {kinds[season]}, sectors array<{kinds[sector]}>")
