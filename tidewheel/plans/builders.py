"""Profile builders and the remaining relational, evaluation and similarity queries, on the tables at hand.

Where the tables lack a column that a builder reads (catchers, fielders, runners), a column of the same kind stands in for it: the plan is
what counts.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel.functions import columns as C
from tidewheel.functions import console
from tidewheel.functions import field as P
from tidewheel.operators import evaluate as E
from tidewheel.operators import games as G
from tidewheel.operators import models
from tidewheel.operators import relational as R
from tidewheel.operators import scoring as K
from tidewheel.plans.catalogue import Catalogue
from tidewheel.plans.modelling import BATTERS_SQL, _forecasts, _query_pairs, batters

CATALOGUE = Catalogue()
query, QUERIES, SQL = CATALOGUE.query, CATALOGUE.queries, CATALOGUE.sql
FORECAST_SQL = "SELECT pitcher_id, season, 0.081 + 0.11 * count_strikes + 0.01 * count_balls AS p, (events = 'strikeout')::INT AS y FROM pitches WHERE events IS NOT NULL"
SWING = "outcome_type IN ('swinging_strike', 'foul', 'in_play')"


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


# --- builders


@query(f"""WITH p AS (SELECT batter_id, season, count(events) AS pa, count(*) FILTER (WHERE events = 'strikeout') / nullif(count(events), 0) AS k, count(*) FILTER (WHERE outcome_type = 'swinging_strike') / nullif(count(*) FILTER (WHERE {SWING}), 0) AS whiff,
  avg(velo) FILTER (WHERE outcome_type = 'in_play') AS speed, count(events) FILTER (WHERE p_throws = 'L') AS pa_l, count(events) FILTER (WHERE p_throws = 'R') AS pa_r, count(*) FILTER (WHERE events = 'strikeout' AND p_throws = 'L') AS k_l, count(*) FILTER (WHERE events = 'strikeout' AND p_throws = 'R') AS k_r FROM pitches GROUP BY 1, 2),
m AS ({BATTERS_SQL}), l AS (SELECT season, sum(k * pa) / sum(pa) AS league FROM p GROUP BY 1)
SELECT coalesce(p.batter_id, m.batter_id) AS batter_id, coalesce(p.season, m.season) AS season, coalesce(pa, sample_pa) AS pa, round(coalesce(p.k, m.k_rate, league), 6) AS k_rate, round(coalesce(p.whiff, m.whiff_rate), 6) AS whiff_rate, round(coalesce(p.speed, m.avg_exit_velo), 4) AS speed,
  round(CASE WHEN pa_l >= 3 THEN k_l / pa_l END, 6) AS k_vs_l, round(CASE WHEN pa_r >= 3 THEN k_r / pa_r END, 6) AS k_vs_r FROM p FULL OUTER JOIN m ON p.batter_id = m.batter_id AND p.season = m.season LEFT JOIN l ON l.season = coalesce(p.season, m.season)""")
def batter_profile(t):
    """Three sources in order of trust (pitches, stored metrics, league), with platoon splits where they have enough at-bats."""
    e, o = F.col("events"), F.col("outcome_type")
    side = lambda h: F.col("p_throws") == h
    p = t("pitches").groupBy("batter_id", "season").agg(
        F.count("events").alias("pa"), F.count_if(e == "strikeout").alias("ks"), F.count_if(o == "swinging_strike").alias("misses"), F.count_if(o.isin(*C.SWINGS)).alias("swings"), F.avg(F.when(o == "in_play", F.col("velo"))).alias("speed"),
        *[F.count(F.when(side(h), e)).alias(f"pa_{h}") for h in "LR"], *[F.count_if(side(h) & (e == "strikeout")).alias(f"k_{h}") for h in "LR"])
    league = p.groupBy("season").agg(C.ratio(F.sum("ks"), F.sum("pa")).alias("league"))
    m = batters(t).select("batter_id", "season", "sample_pa", "k_rate", "whiff_rate", "avg_exit_velo")
    j = R.merge_outer(p, m, ["batter_id", "season"]).join(league, "season", "left")
    split = lambda h: F.when(F.col(f"pa_{h}") >= 3, F.col(f"k_{h}") / F.col(f"pa_{h}"))
    k, whiff = F.coalesce(C.ratio(F.col("ks"), F.col("pa")), "k_rate", "league"), F.coalesce(C.ratio(F.col("misses"), F.col("swings")), "whiff_rate")
    return j.select("batter_id", "season", F.coalesce("pa", F.col("sample_pa").cast("long")).alias("pa"), F.round(k, 6).alias("k_rate"), F.round(whiff, 6).alias("whiff_rate"), F.round(F.coalesce("speed", "avg_exit_velo"), 4).alias("speed"), F.round(split("L"), 6).alias("k_vs_l"), F.round(split("R"), 6).alias("k_vs_r"))


RUNNER_SQL = """WITH a AS (SELECT game_pk, inning, at_bat_number, min(batter_id) AS batter_id, min(pitcher_id) AS pitcher_id, min(season) AS season, arg_min(runners_state, ROW(pitch_number, pitch_id)) AS b, max(events) AS e FROM pitches GROUP BY 1, 2, 3),
n AS (SELECT *, lag(batter_id) OVER w AS runner, lag(e) OVER w AS before, lead(b) OVER w AS b2 FROM a WINDOW w AS (PARTITION BY game_pk, inning ORDER BY at_bat_number))"""


def _runners(t):
    a = t("pitches").groupBy("game_pk", "inning", "at_bat_number").agg(F.min("batter_id").alias("batter_id"), F.min("pitcher_id").alias("pitcher_id"), F.min("season").alias("season"), F.min(F.struct("pitch_number", "pitch_id", "runners_state"))["runners_state"].alias("b"), F.max("events").alias("e"))
    w = Window.partitionBy("game_pk", "inning").orderBy("at_bat_number")
    return a.select("*", F.lag("batter_id").over(w).alias("runner"), F.lag("e").over(w).alias("before"), F.lead("b").over(w).alias("b2"))


@query(RUNNER_SQL + """ SELECT runner AS runner_id, season, count(*) AS n, count(*) FILTER (WHERE b2 & 4 > 0) AS n_third, round(count(*) FILTER (WHERE b2 & 4 > 0) / count(*), 6) AS rate FROM n WHERE before = 'single' AND e = 'single' AND b & 1 = 1 AND b2 IS NOT NULL GROUP BY 1, 2""")
def baserunner_profile(t):
    """How often a runner on first reaches third on a single behind their own."""
    n = _runners(t).filter((F.col("before") == "single") & (F.col("e") == "single") & (F.col("b").bitwiseAND(1) == 1) & F.col("b2").isNotNull())
    third = F.col("b2").bitwiseAND(4) > 0
    return n.groupBy(F.col("runner").alias("runner_id"), "season").agg(F.count(F.lit(1)).alias("n"), F.count_if(third).alias("n_third"), F.round(F.count_if(third) / F.count(F.lit(1)), 6).alias("rate"))


OPPORTUNITY_SQL = """WITH o AS (SELECT pitch_id, game_pk, at_bat_number, pitch_number, season, pitcher_id, runners_state AS b, outcome_type, lead(runners_state) OVER (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number, pitch_id) AS b2 FROM pitches),
s AS (SELECT *, CASE WHEN b & 3 = 1 THEN 2 WHEN b & 6 = 2 THEN 3 END AS target FROM o WHERE b & 3 = 1 OR b & 6 = 2),
x AS (SELECT *, coalesce(b2 & (1 << (target - 1)) > 0, FALSE) AS tried FROM s)"""


def _opportunities(t):
    """Pitches with a runner whose next base is open, first base before second; a try shows in the bases of the next pitch."""
    w = Window.partitionBy("game_pk", "at_bat_number").orderBy("pitch_number", "pitch_id")
    o = t("pitches").select("pitch_id", "game_pk", "at_bat_number", "pitch_number", "season", "pitcher_id", F.col("runners_state").alias("b"), "outcome_type").withColumn("b2", F.lead("b").over(w))
    target = F.when(F.col("b").bitwiseAND(3) == 1, 2).when(F.col("b").bitwiseAND(6) == 2, 3)
    s = o.withColumn("target", target).filter("target is not null")
    return s.withColumn("tried", F.coalesce(F.col("b2").bitwiseAND(F.when(F.col("target") == 2, 2).otherwise(4)) > 0, F.lit(False)))


@query(OPPORTUNITY_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY game_pk, at_bat_number ORDER BY tried, pitch_number, pitch_id) AS rn FROM x)
SELECT pitch_id, target, tried, rn = 1 AND outcome_type = 'ball' AND NOT tried AS pickoff FROM k""")
def steal_opportunities(t):
    """The pool of chances to steal; a throw to the base is laid on the first pitch of the at-bat that was not tried."""
    rn = F.row_number().over(Window.partitionBy("game_pk", "at_bat_number").orderBy("tried", "pitch_number", "pitch_id"))
    return _opportunities(t).select("pitch_id", "target", "tried", ((rn == 1) & (F.col("outcome_type") == "ball") & ~F.col("tried")).alias("pickoff"))


@query(OPPORTUNITY_SQL + " SELECT pitcher_id, season, count(*) AS n, count(*) FILTER (WHERE tried) AS n_tried, round((count(*) FILTER (WHERE tried) + 50 * 0.02) / (count(*) + 50), 6) AS rate FROM x GROUP BY 1, 2")
def pitcher_steal_profile(t):
    tried = F.count_if("tried")
    return _opportunities(t).groupBy("pitcher_id", "season").agg(F.count(F.lit(1)).alias("n"), tried.alias("n_tried"), F.round((tried + 50 * 0.02) / (F.count(F.lit(1)) + 50), 6).alias("rate"))


TAKEN_SQL = """WITH k AS (SELECT *, floor(coalesce(velo, 0) / 5) AS v, (outcome_type = 'called_strike')::INT AS y FROM pitches WHERE outcome_type IN ('ball', 'called_strike')), c AS (SELECT count_balls, count_strikes, v, avg(y) AS e FROM k GROUP BY ALL)"""


@query(TAKEN_SQL + " SELECT pitcher_id AS receiver_id, season, count(*) AS n, round(sum(y - e), 6) AS above, round(sum(y - e) / count(*), 6) AS rate FROM k JOIN c USING (count_balls, count_strikes, v) GROUP BY 1, 2")
def receiving_profile(t):
    """Strikes called above expectation of the pitch's cell."""
    k = t("pitches").filter(F.col("outcome_type").isin("ball", "called_strike")).select("pitcher_id", "season", "count_balls", "count_strikes", F.floor(F.coalesce("velo", F.lit(0.0)) / 5).alias("v"), (F.col("outcome_type") == "called_strike").cast("int").alias("y"))
    g = k.groupBy("pitcher_id", "season", "count_balls", "count_strikes", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    cell = g.groupBy("count_balls", "count_strikes", "v").agg((F.sum("y") / F.sum("n")).alias("e"))
    above = F.sum(F.col("y") - F.col("n") * F.col("e"))
    return g.join(cell, ["count_balls", "count_strikes", "v"]).groupBy(F.col("pitcher_id").alias("receiver_id"), "season").agg(F.sum("n").alias("n"), F.round(above, 6).alias("above"), F.round(above / F.sum("n"), 6).alias("rate"))


@query("""WITH g AS (SELECT pitcher_id, season, count(*) FILTER (WHERE events = 'strikeout') AS n, count(*) FILTER (WHERE events = 'strikeout' AND outcome_type = 'swinging_strike' AND pitch_number >= 5) AS x FROM pitches GROUP BY 1, 2), l AS (SELECT season, sum(x) / nullif(sum(n), 0) AS league FROM g GROUP BY 1)
SELECT pitcher_id, season, round((x + 25 * league) / (n + 25.0), 6) AS rate FROM g JOIN l USING (season)""")
def eb_rate_by_season(t):
    """(x + n0 league) / (n + n0), the league's rate by season."""
    hit = F.col("events") == "strikeout"
    g = t("pitches").groupBy("pitcher_id", "season").agg(F.count_if(hit).alias("n"), F.count_if(hit & (F.col("outcome_type") == "swinging_strike") & (F.col("pitch_number") >= 5)).alias("x"))
    league = g.groupBy("season").agg(C.ratio(F.sum("x"), F.sum("n")).alias("league"))
    return g.join(league, "season").select("pitcher_id", "season", F.round((F.col("x") + 25 * F.col("league")) / (F.col("n") + 25.0), 6).alias("rate"))


@query("""WITH k AS (SELECT batter_id, season, (events IN ('field_out', 'force_out'))::INT AS y, floor(velo / 5) AS v, floor(hb / 8) AS h FROM pitches WHERE outcome_type = 'in_play' AND events IS NOT NULL AND velo IS NOT NULL AND hb IS NOT NULL),
c AS (SELECT v, h, greatest(0.01, least(0.99, avg(y))) AS p FROM k GROUP BY ALL), x AS (SELECT *, CASE WHEN y = 1 THEN 1 - p ELSE -p END AS credit, CASE WHEN p <= 0.25 THEN 5 WHEN p <= 0.5 THEN 4 WHEN p <= 0.75 THEN 3 WHEN p <= 0.9 THEN 2 ELSE 1 END AS stars FROM k JOIN c USING (v, h))
SELECT batter_id AS fielder_id, season, count(*) AS n, round(sum(credit), 6) AS above, count(*) FILTER (WHERE stars >= 4 AND y = 1) AS n_hard, CAST(max(stars) AS INTEGER) AS most_stars FROM x GROUP BY 1, 2""")
def fielding_profile(t):
    """Outs above average: a caught ball earns 1 - p, another one -p; p of its cell within [0.01, 0.99]; stars by p."""
    k = t("pitches").filter("outcome_type = 'in_play' and events is not null and velo is not null and hb is not null").select("batter_id", "season", F.col("events").isin("field_out", "force_out").cast("int").alias("y"), F.floor(F.col("velo") / 5).alias("v"), F.floor(F.col("hb") / 8).alias("h"))
    p = k.groupBy("v", "h").agg(C.clamp(F.avg("y"), 0.01, 0.99).alias("p"))
    x = k.join(p, ["v", "h"]).withColumn("stars", C.ladder(F.col("p"), [0.0, 0.25, 0.5, 0.75, 0.9, 1.01], [5, 4, 3, 2, 1]))
    return x.groupBy(F.col("batter_id").alias("fielder_id"), "season").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(P.out_credit(F.col("y"), F.col("p"))), 6).alias("above"), F.count_if((F.col("stars") >= 4) & (F.col("y") == 1)).alias("n_hard"), F.max("stars").alias("most_stars"))


@query("""SELECT batter_id AS fielder_id, season, count(*) AS n, round(count(*) FILTER (WHERE events = 'force_out') / nullif(count(*) FILTER (WHERE events IN ('force_out', 'single')), 0), 6) AS pivot_rate, round(count(*) FILTER (WHERE events IN ('single', 'double')) / count(*), 6) AS miss_rate, round(avg(velo) FILTER (WHERE events = 'field_out'), 4) AS arm
FROM pitches WHERE outcome_type = 'in_play' AND events IS NOT NULL GROUP BY 1, 2""")
def fielder_rates(t):
    """Double-play, error and arm blocks of one aggregate."""
    e, n = F.col("events"), F.count(F.lit(1))
    rate = C.ratio(F.count_if(e == "force_out"), F.count_if(e.isin("force_out", "single")))
    return t("pitches").filter("outcome_type = 'in_play' and events is not null").groupBy(F.col("batter_id").alias("fielder_id"), "season").agg(n.alias("n"), F.round(rate, 6).alias("pivot_rate"), F.round(F.count_if(e.isin("single", "double")) / n, 6).alias("miss_rate"), F.round(F.avg(F.when(e == "field_out", F.col("velo"))), 4).alias("arm"))


@query("""SELECT season, CAST(runners_state AS INTEGER) AS bases, CAST(least(outs, 2) AS INTEGER) AS outs, CASE WHEN abs(score_diff) <= 1 AND inning >= 7 THEN 'high' WHEN abs(score_diff) >= 4 OR inning <= 5 THEN 'low' ELSE 'mid' END AS leverage, count(*) AS n, count(DISTINCT game_pk) AS n_games
FROM pitches WHERE pitch_number = 1 GROUP BY ALL""")
def situation_pool(t):
    g = t("pitches").filter("pitch_number = 1").groupBy("season", F.col("runners_state").cast("int").alias("bases"), F.least("outs", F.lit(2)).cast("int").alias("outs"), C.leverage_bucket(F.col("inning"), F.col("score_diff")).alias("leverage"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("game_pk").alias("n_games"))


# --- relational


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)")
def insert_if_absent(t):
    return R.insert_if_absent(t("region").select("r_regionkey", "r_name"), t("nation").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name")), ["r_regionkey"])


@query("""WITH s AS (SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 2 = 0), a AS (SELECT event_id, user_id, event_type, value + 1 AS value FROM events WHERE event_id % 3 = 0)
SELECT * FROM s WHERE NOT (event_type = 'purchase' AND event_id IN (SELECT event_id FROM a WHERE event_type = 'purchase')) UNION ALL SELECT * FROM a""")
def upsert_where_live(t):
    """An upsert whose key only counts among rows of one kind."""
    e = t("events").select("event_id", "user_id", "event_type", "value")
    return R.upsert_where(e.filter("event_id % 2 = 0"), e.filter("event_id % 3 = 0").withColumn("value", F.col("value") + 1), ["event_id"], "event_type = 'purchase'")


@query("SELECT season, max(game_date)::VARCHAR AS latest, count(*) AS n FROM pitches WHERE game_date <= DATE '2023-06-30' GROUP BY 1")
def leak_checked(t):
    p = R.assert_no_leak(R.as_of(t("pitches"), "game_date", "2023-06-30"), "game_date", "2023-06-30")
    return p.groupBy("season").agg(F.max("game_date").cast("string").alias("latest"), F.count(F.lit(1)).alias("n"))


@query("SELECT p.season, u.code, count(*) AS n FROM (SELECT unnest(['strikeout', 'walk', 'home_run']) AS code) u JOIN pitches p ON p.events = u.code GROUP BY 1, 2")
def join_unnested(t):
    """A parameter list as a table."""
    u = t("region").limit(1).select(F.explode(F.array(*[F.lit(x) for x in ("strikeout", "walk", "home_run")])).alias("code"))
    p = t("pitches")
    return p.join(F.broadcast(u), p["events"] == u["code"]).groupBy("season", "code").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN velo IS NULL THEN 'no velocity' END, CASE WHEN velo < 75 THEN 'slow' END, CASE WHEN count_strikes = 2 AND outcome_type = 'foul' THEN 'two-strike foul' END, CASE WHEN spin_rate IS NULL THEN 'no spin' END], lambda x: x IS NOT NULL)) AS reason FROM pitches) GROUP BY 1""")
def row_guard_reasons(t):
    """Every row with the names of all rules it breaks."""
    rules = {"no velocity": F.col("velo").isNull(), "slow": F.col("velo") < 75, "two-strike foul": (F.col("count_strikes") == 2) & (F.col("outcome_type") == "foul"), "no spin": F.col("spin_rate").isNull()}
    return t("pitches").select(F.explode(R.broken_rules(rules)).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT pitcher_id, n, k FROM (SELECT pitcher_id, count(*) AS n, count(*) FILTER (WHERE events = 'strikeout') AS k FROM pitches GROUP BY 1) ORDER BY k DESC NULLS LAST, pitcher_id LIMIT 15")
def leaderboard_sorted(t):
    """A sort column that a user names, from a list of allowed ones."""
    g = t("pitches").groupBy("pitcher_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("events") == "strikeout").alias("k"))
    return console.sort_by(g, "k", ["n", "k"], ["pitcher_id"], limit=15)


@query("""SELECT season, stand, p_throws, round(avg(y), 6) AS rate, n_l, n_r FROM (SELECT season, stand, p_throws, (events = 'strikeout')::INT AS y, count(*) FILTER (WHERE stand = 'L') OVER (PARTITION BY season) AS n_l, count(*) FILTER (WHERE stand = 'R') OVER (PARTITION BY season) AS n_r FROM pitches WHERE events IS NOT NULL) GROUP BY ALL
UNION ALL SELECT season, NULL, NULL, round(avg((events = 'strikeout')::INT), 6), count(*) FILTER (WHERE stand = 'L'), count(*) FILTER (WHERE stand = 'R') FROM pitches WHERE events IS NOT NULL GROUP BY 1""")
def masked_breakdowns(t):
    """A rate for every combination of masks, and for all rows: one fold, and then sums of its few rows."""
    g = t("pitches").filter("events is not null").groupBy("season", "stand", "p_throws").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("events") == "strikeout").alias("k"))
    mask = lambda h: F.coalesce(F.sum(F.when(F.col("stand") == h, F.col("n"))), F.lit(0))
    whole = g.groupBy("season").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), mask("L").alias("n_l"), mask("R").alias("n_r"))
    rate = F.round(F.col("k") / F.col("n"), 6).alias("rate")
    parts = g.join(whole.select("season", "n_l", "n_r"), "season").select("season", "stand", "p_throws", rate, "n_l", "n_r")
    return parts.unionByName(whole.select("season", F.lit(None).cast("string").alias("stand"), F.lit(None).cast("string").alias("p_throws"), rate, "n_l", "n_r"))


@query("""WITH d AS (SELECT velo, hb, velo - avg(velo) OVER w AS x, hb - avg(hb) OVER w AS y FROM pitches WHERE velo IS NOT NULL AND hb IS NOT NULL AND pitcher_id IS NOT NULL WINDOW w AS (PARTITION BY pitcher_id))
SELECT count(*) AS n, round(sum(x * y) / nullif(sum(x * x), 0), 6) AS slope FROM d""")
def least_squares_dummies(t):
    """The slope beside one dummy for each pitcher."""
    return E.slope_with_dummies(t("pitches"), "hb", "velo", "pitcher_id").select("n", F.round("slope", 6).alias("slope"))


# --- labels and geometry


@query("""SELECT events AS event, CAST(CASE WHEN events = 'strikeout' THEN 1 WHEN events IN ('field_out', 'force_out') THEN 1 WHEN events IS NOT NULL THEN 0 END AS INTEGER) AS n_outs, CAST(CASE WHEN runners_state & 1 = 0 THEN NULL WHEN events = 'home_run' THEN 4 WHEN events = 'double' THEN 3 WHEN events = 'single' THEN 2 WHEN events IN ('walk', 'hit_by_pitch') THEN 2 WHEN events = 'force_out' THEN 0 WHEN events IS NOT NULL THEN 1 END AS INTEGER) AS from_first, count(*) AS n FROM pitches GROUP BY ALL""")
def event_labels(t):
    """Outs of an event and where a runner on first ends up: NULL no runner, 4 scored, else the base, 0 retired."""
    e = F.col("events")
    after = F.when(e == "double", 3).when(e.isin("single", "walk", "hit_by_pitch"), 2).when(e == "force_out", 0).when(e.isNotNull(), 1)
    label = P.destination(F.col("runners_state").bitwiseAND(1) == 1, e == "home_run", after)
    return t("pitches").groupBy(e.alias("event"), P.outs_of(e).alias("n_outs"), label.alias("from_first")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH k AS (SELECT inning, velo * 1.467 * sin(radians(ivb)) AS vz, CASE WHEN ivb > 15 THEN 5.0 ELSE 0.0 END AS h, CASE WHEN ivb > 50 THEN 0.82 WHEN ivb > 25 THEN 0.87 WHEN ivb > 10 THEN 0.92 ELSE 0.95 END AS drag FROM pitches WHERE velo > 0 AND ivb BETWEEN -30 AND 90 AND outcome_type = 'in_play'),
f AS (SELECT inning, CASE WHEN vz * vz + 2 * 32.174 * (3 - h) >= 0 THEN greatest(0.5, (vz + sqrt(vz * vz + 2 * 32.174 * (3 - h))) / 32.174 * drag) END AS t FROM k)
SELECT CAST(inning AS INTEGER) AS inning, count(t) AS n, round(avg(t), 6) AS mean_time, round(max(t), 6) AS longest FROM f GROUP BY 1""")
def flight_times(t):
    """Time in the air from speed and angle (velocity and break stand in for the ball's)."""
    x = t("pitches").filter("velo > 0 and ivb between -30 and 90 and outcome_type = 'in_play'").select(F.col("inning").cast("int").alias("inning"), P.hang_time(F.col("velo"), F.col("ivb")).alias("t"))
    return x.groupBy("inning").agg(F.count("t").alias("n"), F.round(F.avg("t"), 6).alias("mean_time"), F.round(F.max("t"), 6).alias("longest"))


@query("SELECT game_pk, CAST(bit_or(CASE WHEN events = 'field_out' THEN (1 << (pitcher_id % 9)::INT) ELSE 0 END) AS BIGINT) | (CAST(bit_or(CASE WHEN events = 'force_out' THEN (1 << (pitcher_id % 9)::INT) ELSE 0 END) AS BIGINT) << 9) AS mask FROM pitches GROUP BY 1")
def credit_positions(t):
    """Nine positions by two slots of credit in one number."""
    at = F.col("pitcher_id") % 9
    slots = [F.bit_or(P.position_bit(at, F.col("events") == e)) for e in ("field_out", "force_out")]
    return t("pitches").groupBy("game_pk").agg(P.credit_mask(slots).alias("mask"))


# --- similarity


@query(f"""WITH b AS ({BATTERS_SQL}), s AS (SELECT season, avg(k_rate) AS mk, stddev_pop(k_rate) AS sk, avg(whiff_rate) AS mw, stddev_pop(whiff_rate) AS sw FROM b GROUP BY 1)
SELECT batter_id, season, round(CASE WHEN k_rate IS NOT NULL THEN CASE WHEN sk > 0 THEN (k_rate - mk) / sk ELSE 0 END END * 2, 5) AS k, round(CASE WHEN whiff_rate IS NOT NULL THEN CASE WHEN sw > 0 THEN (whiff_rate - mw) / sw ELSE 0 END END * 0.5, 5) AS w FROM b JOIN s USING (season)""")
def weighted_zscores(t):
    z = K.zscores(batters(t).select("batter_id", "season", "k_rate", "whiff_rate"), ["k_rate", "whiff_rate"], ["season"], {"k_rate": 2.0, "whiff_rate": 0.5})
    return z.select("batter_id", "season", F.round("k_rate", 5).alias("k"), F.round("whiff_rate", 5).alias("w"))


PAIR_SQL = "exp(-(0.5 * coalesce(power(q.k_rate - b.k_rate, 2), 0) + 0.25 * coalesce(power(q.walk_rate - b.walk_rate, 2), 0) + 0.25 * coalesce(power(q.whiff_rate - b.whiff_rate, 2), 0)) / (2 * 0.05 * 0.05))"


@query(f"WITH b AS ({BATTERS_SQL}) SELECT season, q.batter_id AS a, b.batter_id AS b, round({PAIR_SQL}, 6) AS score FROM b q JOIN b USING (season) WHERE q.batter_id % 50 = 0 AND b.batter_id % 50 = 0 AND q.batter_id < b.batter_id")
def pair_scores(t):
    """The score of stated pairs, both of the query set."""
    p = _query_pairs(t).filter("batter_id % 50 = 0 and query_id < batter_id")
    w = {"k_rate": 2.0, "walk_rate": 1.0, "whiff_rate": 1.0}
    return p.select("season", F.col("query_id").alias("a"), F.col("batter_id").alias("b"), F.round(C.rbf({c: F.col(f"q_{c}") for c in w}, {c: F.col(c) for c in w}, w, 0.05), 6).alias("score"))


@query(f"WITH b AS ({BATTERS_SQL}) SELECT q.batter_id AS query_id, q.season, count(*) AS n, round(sum({PAIR_SQL}), 4) AS total, round(max({PAIR_SQL}), 6) AS best FROM b q JOIN b USING (season) WHERE q.batter_id % 50 = 0 AND b.batter_id <> q.batter_id GROUP BY 1, 2")
def score_matrix_rows(t):
    """The score matrix as a pair table, and what each of its rows adds up to."""
    s = K.score_matrix(_query_pairs(t), "query_id", "batter_id", ["season"], {"k_rate": 2.0, "walk_rate": 1.0, "whiff_rate": 1.0}, 0.05)
    return s.groupBy("query_id", "season").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"), F.round(F.max("score"), 6).alias("best"))


@query(f"""WITH b AS ({BATTERS_SQL}), m AS (SELECT season, q.batter_id AS x, b.batter_id AS y, {PAIR_SQL} AS score FROM b q JOIN b USING (season) WHERE q.batter_id % 50 = 0 AND b.batter_id % 50 = 0 AND q.batter_id <> b.batter_id)
SELECT f.season, count(*) AS n_pairs, round(max(abs(f.score - g.score)), 9) AS worst, round(avg(f.score), 6) AS mean FROM m f JOIN m g ON f.season = g.season AND f.x = g.y AND f.y = g.x WHERE f.x < f.y GROUP BY 1""")
def score_symmetry(t):
    """How far a score depends on who asks, over the pairs of the query set; each pair is folded once, not joined to itself."""
    s = K.score_matrix(_query_pairs(t).filter("batter_id % 50 = 0"), "query_id", "batter_id", ["season"], {"k_rate": 2.0, "walk_rate": 1.0, "whiff_rate": 1.0}, 0.05)
    g = K.symmetry(s, "query_id", "batter_id", "score", ["season"])
    return g.groupBy("season").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.max("gap"), 9).alias("worst"), F.round(F.avg("first"), 6).alias("mean"))


@query(f"""WITH b AS ({BATTERS_SQL}), t AS (SELECT avg(power(q.k_rate - b.k_rate, 2)) AS k, avg(power(q.walk_rate - b.walk_rate, 2)) AS w, avg(power(q.whiff_rate - b.whiff_rate, 2)) AS f FROM b q JOIN b USING (season) WHERE q.batter_id % 50 = 0 AND b.batter_id <> q.batter_id)
SELECT unnest(['k_rate', 'walk_rate', 'whiff_rate']) AS feature, unnest([round(2 * k / (2 * k + w + f), 6), round(w / (2 * k + w + f), 6), round(f / (2 * k + w + f), 6)]) AS share FROM t""")
def score_balance(t):
    """What share of the weighted distance each feature makes."""
    w = {"k_rate": 2.0, "walk_rate": 1.0, "whiff_rate": 1.0}
    a = _query_pairs(t).agg(*[F.avg(F.pow(F.col(f"q_{c}") - F.col(c), F.lit(2))).alias(c) for c in w])
    total = sum((F.lit(x) * F.col(c) for c, x in w.items()), F.lit(0.0))
    return a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.lit(x) * F.col(c) / total, 6).alias("share")) for c, x in w.items()])).alias("x")).select("x.*")


MERGE_SQL = """WITH v AS (SELECT * FROM (SELECT DISTINCT vec_id, pitcher_id, season, CASE WHEN isnan(mean_velo) THEN NULL ELSE mean_velo / 6.0::DOUBLE END AS x, CASE WHEN isnan(mean_hb) THEN NULL ELSE mean_hb / 10.0::DOUBLE END AS y, n_pitches_assigned AS n, row_number() OVER (PARTITION BY vec_id ORDER BY n_pitches_assigned) AS rn FROM pitcher_gmm_components WHERE vec_id IS NOT NULL AND pitcher_id IS NOT NULL AND season IS NOT NULL AND n_pitches_assigned IS NOT NULL) WHERE rn = 1 AND x IS NOT NULL AND y IS NOT NULL),
m AS (SELECT s.vec_id, arg_min(l.vec_id, ROW(power(s.x - l.x, 2) + power(s.y - l.y, 2), l.vec_id)) AS into_id FROM v s JOIN v l ON s.pitcher_id = l.pitcher_id AND s.season = l.season AND s.n < 150 AND l.n >= 150 GROUP BY 1)
SELECT coalesce(m.into_id, v.vec_id) AS vec_id, count(*) AS n_parts, CAST(sum(n) AS BIGINT) AS n FROM v LEFT JOIN m USING (vec_id) GROUP BY 1"""


@query(MERGE_SQL)
def component_merge(t):
    """Components of few pitches go to the nearest large one of their pitcher and season; where there is none they stay."""
    v = t("pitcher_gmm_components").filter("vec_id is not null and pitcher_id is not null and season is not null and n_pitches_assigned is not null")
    v = R.first_per(v.select("vec_id", "pitcher_id", "season", (C.number(F.col("mean_velo")) / 6.0).alias("x"), (C.number(F.col("mean_hb")) / 10.0).alias("y"), F.col("n_pitches_assigned").alias("n")), ["vec_id"], ["n"]).filter("x is not null and y is not null")
    return K.merge_small(v, "vec_id", ["pitcher_id", "season"], ["x", "y"], "n", 150).groupBy(F.col("into_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n").alias("n"))


KNN_SQL = """SELECT q.vec_id AS query, b.vec_id AS neighbour, b.label, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS rank FROM embeddings q, embeddings b WHERE q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id"""


@query(f"SELECT query, round(sum((1 + neighbour % 3) / (1e-9 + d) * label) / sum((1 + neighbour % 3) / (1e-9 + d)), 5) AS predicted, round(avg(label), 6) AS plain FROM ({KNN_SQL}) WHERE rank <= 10 GROUP BY 1")
def knn_weighted_prediction(t):
    """Mean outcome of the neighbours by recency over distance."""
    e = t("embeddings")
    n = K.knn(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10, ["label"])
    return n.groupBy("query").agg(F.round(K.weighted_prediction(F.col("distance"), 1 + F.col("neighbour") % 3, F.col("label")), 5).alias("predicted"), F.round(F.avg("label"), 6).alias("plain"))


# --- results and evaluation


@query("""WITH g AS (SELECT DISTINCT game_pk, season, home_score_final AS h, away_score_final AS a FROM schedule_games WHERE status = 'Final' AND home_score_final IS NOT NULL AND away_score_final IS NOT NULL)
SELECT season, count(*) AS n, round(avg((h + a > 8.5)::INT), 6) AS p_total_over, round(avg((h + a < 8.5)::INT), 6) AS p_total_under, round(avg((h > a)::INT), 6) AS p_home, round(avg((a > h)::INT), 6) AS p_away, round(avg((h - 1.5 > a)::INT), 6) AS p_home_cover, round(avg((a + 1.5 > h)::INT), 6) AS p_away_cover, round(avg((h = a)::INT), 6) AS p_level FROM g GROUP BY 1""")
def game_market(t):
    """Chances of totals, sides and margins from played or simulated scores."""
    g = t("schedule_games").filter("status = 'Final' and home_score_final is not null and away_score_final is not null").select("game_pk", "season", "home_score_final", "away_score_final").distinct()
    return g.groupBy("season").agg(F.count(F.lit(1)).alias("n"), *[F.round(c, 6).alias(n) for n, c in E.market(F.col("home_score_final"), F.col("away_score_final"), 8.5, 1.5).items()])


PLAY_SQL = """plays AS (SELECT game_pk, at_bat_number AS play, CASE WHEN at_bat_number % 2 = 1 THEN 'home' ELSE 'away' END AS side, min(pitcher_id) AS pitcher_id, (max(events) IN ('field_out', 'force_out', 'strikeout'))::INT AS outs, arg_max(score_diff, ROW(pitch_number, pitch_id)) AS diff FROM pitches GROUP BY 1, 2)"""


@query(f"""WITH {PLAY_SQL}, f AS (SELECT game_pk, arg_max(diff, play) AS final FROM plays GROUP BY 1 HAVING arg_max(diff, play) <> 0), s AS (SELECT p.*, CASE WHEN final > 0 THEN 'home' ELSE 'away' END AS winner, CASE WHEN final > 0 THEN diff ELSE -diff END AS lead FROM plays p JOIN f USING (game_pk)),
r AS (SELECT *, last_value(CASE WHEN side = winner THEN pitcher_id END IGNORE NULLS) OVER w AS win_p, last_value(CASE WHEN side <> winner THEN pitcher_id END IGNORE NULLS) OVER w AS lose_p, coalesce(max(CASE WHEN lead <= 0 THEN play END) OVER (PARTITION BY game_pk), -1) AS last_level FROM s WINDOW w AS (PARTITION BY game_pk ORDER BY play ROWS UNBOUNDED PRECEDING)),
d AS (SELECT game_pk, arg_min(win_p, play) FILTER (WHERE play > last_level) AS win_d, arg_min(lose_p, play) FILTER (WHERE play > last_level) AS lose_d, arg_max(win_p, play) AS finisher FROM r GROUP BY 1),
a AS (SELECT game_pk, pitcher_id, min(play) AS first_play, sum(outs) AS outs FROM s WHERE side = winner GROUP BY 1, 2), st AS (SELECT game_pk, arg_min(pitcher_id, first_play) AS starter, arg_min(outs, first_play) AS starter_outs FROM a GROUP BY 1),
lf AS (SELECT game_pk, arg_min(pitcher_id, play) AS loser_first FROM s WHERE side <> winner GROUP BY 1), rel AS (SELECT a.game_pk, arg_min(pitcher_id, ROW(-a.outs, first_play)) AS best FROM a JOIN st USING (game_pk) WHERE pitcher_id <> starter AND a.outs > 0 GROUP BY 1),
w AS (SELECT d.game_pk, CASE WHEN coalesce(win_d, starter) = starter AND starter_outs < 15 AND best IS NOT NULL THEN best ELSE coalesce(win_d, starter) END AS winner_id, coalesce(lose_d, loser_first) AS loser_id, finisher FROM d LEFT JOIN st USING (game_pk) LEFT JOIN lf USING (game_pk) LEFT JOIN rel USING (game_pk)),
sv AS (SELECT r.game_pk, bool_or(lead BETWEEN 1 AND 3) AS close FROM r JOIN w ON w.game_pk = r.game_pk AND r.win_p = w.finisher GROUP BY 1)
SELECT w.game_pk, winner_id, loser_id, CASE WHEN finisher IS NOT NULL AND finisher <> winner_id AND close THEN finisher END AS saver_id FROM w LEFT JOIN sv USING (game_pk)""")
def pitcher_decisions(t):
    """Who wins, loses and saves, from the ordered plays of a game."""
    p = t("pitches").groupBy("game_pk", "at_bat_number").agg(F.min("pitcher_id").alias("pitcher_id"), F.max("events").isin("field_out", "force_out", "strikeout").alias("o"), F.max(F.struct("pitch_number", "pitch_id", "score_diff"))["score_diff"].alias("diff"))
    plays = p.select("game_pk", F.col("at_bat_number").alias("play"), F.when(F.col("at_bat_number") % 2 == 1, "home").otherwise("away").alias("side"), "pitcher_id", F.coalesce(F.col("o").cast("int"), F.lit(0)).alias("outs"), "diff")
    return G.decisions(plays, "game_pk", "play", "side", "pitcher_id", "outs", "diff")


@query(f"""WITH f AS ({FORECAST_SQL}), s AS (SELECT season, pitcher_id, count(*) AS n, sum(y) AS k FROM f GROUP BY 1, 2), a AS (SELECT x.season, x.pitcher_id, sum(y.n) AS n, sum(y.k) AS k FROM s x JOIN s y ON y.pitcher_id = x.pitcher_id AND y.season < x.season GROUP BY 1, 2),
l AS (SELECT x.season, sum(y.n) AS n, sum(y.k) AS k FROM (SELECT DISTINCT season FROM s) x JOIN s y ON y.season < x.season GROUP BY 1)
SELECT s.season, CAST(sum(s.n) AS BIGINT) AS n, round(sum(s.k * power(1 - l.k / l.n, 2) + (s.n - s.k) * power(l.k / l.n, 2)) / sum(s.n), 6) AS brier_base,
  round(sum(s.k * power(1 - (coalesce(a.k, 0) + 50 * l.k / l.n) / (coalesce(a.n, 0) + 50), 2) + (s.n - s.k) * power((coalesce(a.k, 0) + 50 * l.k / l.n) / (coalesce(a.n, 0) + 50), 2)) / sum(s.n), 6) AS brier_model FROM s JOIN l USING (season) LEFT JOIN a USING (season, pitcher_id) GROUP BY 1""")
def walk_forward_ablation(t):
    """Error of each season's forecasts from earlier seasons, with and without the pitcher's own record."""
    a = E.ablation(_forecasts(t), "season", "pitcher_id", "y", 50.0)
    return a.select("season", "n", *r6("brier_base", "brier_model"))


@query(f"SELECT round(sum(wins) / nullif(sum(pos) * sum(neg), 0), 6) AS auc, CAST(sum(pos) + sum(neg) AS BIGINT) AS n FROM (SELECT pos, neg, pos * (sum(neg) OVER (ORDER BY p) - neg / 2.0) AS wins FROM (SELECT round(p, 9) AS p, sum(y) AS pos, sum(1 - y) AS neg FROM ({FORECAST_SQL}) GROUP BY 1))")
def auc(t):
    f = _forecasts(t).withColumn("p", F.round(F.col("p") + 0.001, 9))
    return models.auc(f, "p", "y").select(F.round("auc", 6).alias("auc"), "n")


@query(f"WITH f AS ({FORECAST_SQL}) SELECT round(avg(CASE WHEN p <= 0.1 THEN 0.05 WHEN p <= 0.2 THEN 0.05 + (p - 0.1) * 1.5 WHEN p <= 0.3 THEN 0.2 + (p - 0.2) * 1.0 ELSE 0.3 END), 6) AS mean_mapped, round(avg(p), 6) AS mean_raw FROM f")
def reliability_mapped(t):
    """Forecasts through a monotone piecewise-linear map; a fall in its points is taken out."""
    m = E.reliability_map([0.1, 0.2, 0.3, float("nan")], [0.05, 0.2, 0.3, 0.9])
    f = _forecasts(t).withColumn("p", F.col("p") + 0.001)
    return f.agg(F.round(F.avg(m(F.col("p"))), 6).alias("mean_mapped"), F.round(F.avg("p"), 6).alias("mean_raw"))


@query("""WITH g AS (SELECT game_pk, pitcher_id, count(*) AS pitches_, count(*) FILTER (WHERE events = 'strikeout') AS k, count(*) FILTER (WHERE events = 'walk') AS bb, count(*) FILTER (WHERE events IN ('single', 'double', 'home_run')) AS h, count(*) FILTER (WHERE events IN ('strikeout', 'field_out', 'force_out')) AS o FROM pitches GROUP BY 1, 2)
SELECT game_pk, pitcher_id, unnest(['pitches', 'strikeouts', 'walks', 'hits', 'outs']) AS prop, unnest([pitches_, k, bb, h, o]) AS value FROM g""")
def realised_props(t):
    """What each pitcher did in each game, unpivoted from one aggregate."""
    e = F.col("events")
    props = {"pitches": F.count(F.lit(1)), "strikeouts": F.count_if(e == "strikeout"), "walks": F.count_if(e == "walk"), "hits": F.count_if(e.isin(*C.HITS)), "outs": F.count_if(e.isin(*C.OUTS))}
    g = t("pitches").groupBy("game_pk", "pitcher_id").agg(*[c.alias(n) for n, c in props.items()])
    return g.unpivot(["game_pk", "pitcher_id"], list(props), "prop", "value")


@query(f"""WITH f AS ({FORECAST_SQL}), l AS (SELECT avg(y) AS q FROM f) SELECT season, count(*) AS n, round((avg(y) - max(q)) / sqrt(max(q) * (1 - max(q)) / count(*)), 5) AS z, count(*) >= 30 AND abs((avg(y) - max(q)) / sqrt(max(q) * (1 - max(q)) / count(*))) > 2.7343687865 AS differs FROM f, l GROUP BY 1""")
def bonferroni_flags(t):
    """Seasons whose rate differs from the whole, at 5 % shared by eight tests and for 30 rows or more."""
    f = _forecasts(t)
    return E.bonferroni(f, "season", "y", tests=8, alpha=0.05, least=30).select("season", "n", F.round("z", 5).alias("z"), "differs")


@query(f"""SELECT season, CASE WHEN p < 0.2 THEN 'low' WHEN p < 0.3 THEN 'mid' ELSE 'high' END AS band, count(*) AS n, CAST(sum(y) AS BIGINT) AS hits, round(avg(p), 6) AS mean_p, round(avg(y) - avg(p), 6) AS bias, round(avg(2 * power(p - y, 2)), 5) AS brier FROM ({FORECAST_SQL}) GROUP BY 1, 2""")
def accuracy_report(t):
    """Forecasts by season and band: count, hits, bias and error."""
    f = _forecasts(t).withColumn("p", F.col("p") + 0.001).withColumn("band", F.when(F.col("p") < 0.2, "low").when(F.col("p") < 0.3, "mid").otherwise("high"))
    return f.groupBy("season", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y") - F.avg("p"), 6).alias("bias"), F.round(E.brier(F.col("p"), F.col("y")), 5).alias("brier"))


@query()
def change_points(t):
    """Seasons at which a line of some inning moved, found by splitting at the largest gap again and again (tested against a plain version)."""
    p = t("pitches").filter("events = 'home_run'").select(F.lit(1).alias("venue"), F.col("inning").cast("int").alias("sector"), F.col("season").cast("int").alias("season"), "velo")
    return G.change_points(p, "venue", "sector", "season", "velo", q=0.1, least_rows=3, least_gap=2.0)


@query()
def vendor_game_match(t):
    """Vendor events to scheduled games of the same teams by the smallest gap of their starts (tested on a small table)."""
    from tidewheel.plans import preparation

    return preparation.matched_events(t)
