"""Scans, filters, joins, aggregates, windows, top-k and set operations over the pitch, schedule and sales tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel.functions import columns as C
from tidewheel.operators import quantiles
from tidewheel.operators import relational as R
from tidewheel.plans.catalogue import Catalogue

CATALOGUE = Catalogue()
query, QUERIES, SQL = CATALOGUE.query, CATALOGUE.queries, CATALOGUE.sql
AT_BAT = ["game_pk", "at_bat_number"]


# --- scans, projections, predicates


@query("SELECT pitch_id, game_pk, at_bat_number, pitch_number, round(velo, 3) AS velo, round(spin_rate, 3) AS spin_rate FROM pitches WHERE velo IS NOT NULL AND spin_rate IS NOT NULL AND season IN (2023, 2024, 2025)")
def quality_filter(t):
    """Rows with complete features of the newest seasons."""
    p = t("pitches").filter("velo is not null and spin_rate is not null").filter(F.col("season").isin(2023, 2024, 2025))
    return p.select("pitch_id", "game_pk", "at_bat_number", "pitch_number", F.round("velo", 3).alias("velo"), F.round("spin_rate", 3).alias("spin_rate"))


@query("SELECT * EXCLUDE (o_orderpriority, o_orderdate), CAST(year(o_orderdate) AS INTEGER) AS o_year FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def star_except(t):
    o = t("orders").filter("o_orderdate >= timestamp_ntz'1995-01-01' and o_orderdate < timestamp_ntz'1996-01-01'")
    return o.withColumn("o_year", F.year("o_orderdate")).drop("o_orderpriority", "o_orderdate")


CLASS_SQL = """CASE WHEN events = 'hit_by_pitch' THEN 'hit_by_pitch' WHEN outcome_type = 'in_play' THEN 'in_play' WHEN outcome_type = 'foul' AND count_strikes = 2 THEN 'foul_two_strikes'
  WHEN outcome_type = 'foul' THEN 'foul' WHEN outcome_type = 'swinging_strike' THEN 'whiff' WHEN outcome_type = 'called_strike' THEN 'called_strike' WHEN outcome_type = 'ball' THEN 'ball' END"""


@query(f"SELECT {CLASS_SQL} AS pitch_class, count(*) AS n FROM pitches GROUP BY 1")
def classify_first_match(t):
    return t("pitches").groupBy(C.pitch_class(F.col("outcome_type"), F.col("events"), F.col("count_strikes")).alias("pitch_class")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(greatest(-5, least(5, score_diff)) AS INTEGER) AS diff, count(*) AS n FROM pitches GROUP BY 1")
def clamp_diff(t):
    return t("pitches").groupBy(C.clamp(F.col("score_diff"), -5, 5).cast("int").alias("diff")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, text ILIKE '%bullpen%' OR text ILIKE '%relieved%' AS relief, text LIKE '%HR:%' AS homers FROM documents WHERE text IS NOT NULL")
def ilike_flags(t):
    text = F.col("text")
    return t("documents").filter("text is not null").select("doc_id", (text.ilike("%bullpen%") | text.ilike("%relieved%")).alias("relief"), text.like("%HR:%").alias("homers"))


@query("SELECT feed, count(*) AS n, count(*) FILTER (WHERE NOT regexp_full_match(trim(officialdate), '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS n_odd FROM schedule_games WHERE officialdate IS NOT NULL GROUP BY 1")
def regex_audit(t):
    odd = ~F.trim("officialdate").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    return t("schedule_games").filter("officialdate is not null").groupBy("feed").agg(F.count(F.lit(1)).alias("n"), F.count_if(odd).alias("n_odd"))


@query("SELECT season, count(*) AS n, CAST(max(game_date) AS VARCHAR) AS last_date FROM pitches WHERE game_date <= DATE '2024-06-30' GROUP BY 1")
def asof_cutoff(t):
    """Point-in-time filter before aggregation: nothing after the cutoff contributes."""
    return R.as_of(t("pitches"), "game_date", "2024-06-30").groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.max("game_date").cast("string").alias("last_date"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size = ANY([1, 7, 15, 30]) AND p_type IS NOT NULL")
def array_param_isin(t):
    return t("part").filter(F.col("p_size").isin(1, 7, 15, 30) & F.col("p_type").isNotNull()).select("p_partkey", "p_name")


# --- joins


@query("""SELECT e.season, count(*) AS n_pairs, count(*) FILTER (WHERE b.events IN ('single', 'double', 'home_run')) AS n_hits FROM pitches e
JOIN (SELECT game_pk, at_bat_number, max(pitch_number) AS pitch_number FROM pitches GROUP BY 1, 2) l USING (game_pk, at_bat_number, pitch_number)
JOIN (SELECT game_pk, at_bat_number, max(events) AS events FROM pitches GROUP BY 1, 2) b USING (game_pk, at_bat_number) GROUP BY 1""")
def join_inner_multi_key(t):
    """The at-bat's outcome on its last pitch: one aggregate gives both sides of what is a three-key join in the pool's own terms."""
    p = t("pitches")
    last = p.groupBy(*AT_BAT).agg(F.max("pitch_number").alias("pitch_number"), F.max("events").alias("outcome"))
    return p.join(last, [*AT_BAT, "pitch_number"]).groupBy("season").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("outcome").isin("single", "double", "home_run")).alias("n_hits"))


@query("""SELECT s.schedule_id, s.game_pk, v.venue_name, v.city, h.team_abbrev AS home FROM (SELECT DISTINCT schedule_id, game_pk, venue_id, home_team_id FROM schedule_games) s
LEFT JOIN venues v USING (venue_id) LEFT JOIN (SELECT team_id, arg_max(trim(team_abbrev), ROW(snapshot_date, updated_at, trim(team_abbrev))) AS team_abbrev FROM teams WHERE team_abbrev IS NOT NULL GROUP BY 1) h ON h.team_id = s.home_team_id""")
def join_left_star(t):
    games = t("schedule_games").select("schedule_id", "game_pk", "venue_id", "home_team_id").distinct()
    teams = t("teams").filter("team_abbrev is not null").withColumn("team_abbrev", F.trim("team_abbrev")).groupBy("team_id").agg(F.max(F.struct("snapshot_date", "updated_at", "team_abbrev"))["team_abbrev"].alias("home"))
    return games.join(t("venues").select("venue_id", "venue_name", "city"), "venue_id", "left").join(teams, F.col("home_team_id") == F.col("team_id"), "left").select("schedule_id", "game_pk", "venue_name", "city", "home")


@query("""SELECT coalesce(b.season, p.season) AS season, coalesce(b.hand, p.hand) AS hand, b.n AS n_batters, p.n AS n_pitchers FROM
(SELECT season, bats AS hand, count(DISTINCT batter_id) AS n FROM batter_season_metrics WHERE bats IS NOT NULL GROUP BY 1, 2) b FULL OUTER JOIN
(SELECT season, p_throws AS hand, count(DISTINCT pitcher_id) AS n FROM pitcher_season_metrics WHERE p_throws IS NOT NULL GROUP BY 1, 2) p ON b.season = p.season AND b.hand = p.hand""")
def join_full_outer_coalesce(t):
    b = t("batter_season_metrics").filter("bats is not null").groupBy("season", F.col("bats").alias("hand")).agg(F.count_distinct("batter_id").alias("n_batters"))
    p = t("pitcher_season_metrics").filter("p_throws is not null").groupBy("season", F.col("p_throws").alias("hand")).agg(F.count_distinct("pitcher_id").alias("n_pitchers"))
    return R.merge_outer(b, p, ["season", "hand"])


@query("SELECT DISTINCT o.o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def join_anti_not_exists(t):
    returned = t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders").select("o_orderkey").join(returned, "o_orderkey", "left_anti")


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def join_semi_exists(t):
    big = t("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


TRAILING_SQL = """WITH d AS (SELECT pitcher_id, game_date, count(*) AS n FROM pitches GROUP BY 1, 2)
SELECT a.pitcher_id, CAST(a.game_date AS VARCHAR) AS game_date, a.n AS n_today, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS n_trailing FROM d a
LEFT JOIN d b ON a.pitcher_id = b.pitcher_id AND b.game_date < a.game_date AND b.game_date >= a.game_date - INTERVAL {days} DAY GROUP BY 1, 2, 3"""


@query(TRAILING_SQL.format(days=3))
def join_range_trailing_days(t):
    """Work of the three days before each day: a band self-join written as a range window, after pitches fold into days."""
    d = t("pitches").groupBy("pitcher_id", "game_date").agg(F.count(F.lit(1)).alias("n_today"))
    return d.withColumn("n_trailing", R.trailing_sum(d, "pitcher_id", "game_date", "n_today", 3)).withColumn("game_date", F.col("game_date").cast("string"))


@query("""WITH h AS (SELECT game_pk, at_bat_number AS hr FROM pitches WHERE events = 'home_run'),
k AS (SELECT DISTINCT game_pk, at_bat_number AS k FROM pitches WHERE events = 'strikeout'),
r AS (SELECT h.game_pk, h.hr, k.k, row_number() OVER (PARTITION BY h.game_pk, h.hr ORDER BY abs(h.hr - k.k), k.k) AS rn FROM h LEFT JOIN k ON h.game_pk = k.game_pk)
SELECT game_pk, CAST(hr AS INTEGER) AS hr, CAST(k AS INTEGER) AS k FROM r WHERE rn = 1""")
def join_nearest_match(t):
    """The strikeout nearest to each home run of the same game, the earlier one on equal distance."""
    p = t("pitches")
    homers = p.filter("events = 'home_run'").select("game_pk", F.col("at_bat_number").alias("hr")).distinct()
    outs = p.filter("events = 'strikeout'").select("game_pk", F.col("at_bat_number").alias("k")).distinct()
    return R.nearest_row(homers, outs, ["game_pk"], "hr", "k", [])


@query("""SELECT team_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date, venue_id FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY snapshot_date DESC, updated_at DESC, venue_id) AS rn
FROM teams WHERE snapshot_date <= DATE '2024-07-01' AND venue_id IS NOT NULL) WHERE rn = 1""")
def join_asof_latest_snapshot(t):
    latest = R.latest_as_of(t("teams").filter("venue_id is not null"), ["team_id"], "snapshot_date", "2024-07-01", [F.col("updated_at").desc(), F.col("venue_id")])
    return latest.select("team_id", F.col("snapshot_date").cast("string").alias("snapshot_date"), "venue_id")


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c.c_custkey, o.o_orderkey, o.o_totalprice, row_number() OVER (PARTITION BY c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey) AS rn
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey) WHERE rn = 1""")
def join_lateral_top1(t):
    """LEFT JOIN LATERAL (... ORDER BY ... LIMIT 1) as one partial aggregate per key in front of a plain join."""
    best = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("b"))
    return t("customer").select("c_custkey").join(best, "c_custkey", "left").select("c_custkey", (-F.col("b.k")).alias("o_orderkey"), F.col("b.o_totalprice").alias("o_totalprice"))


@query("""WITH g AS (SELECT pitcher_id, season, count(*) AS n, count(spin_rate) AS n_spin, avg(spin_rate) AS spin FROM pitches GROUP BY 1, 2),
v AS (SELECT DISTINCT vec_id, pitcher_id, season, mean_spin_rate FROM pitcher_gmm_components),
b AS (SELECT pitcher_id, season, avg(CASE WHEN isnan(mean_spin_rate) THEN NULL ELSE CAST(mean_spin_rate AS DOUBLE) END) AS board FROM v GROUP BY 1, 2)
SELECT g.pitcher_id, g.season, CASE WHEN n_spin >= 0.8 * n THEN 'pitches' WHEN board IS NOT NULL THEN 'board' ELSE 'none' END AS source,
  round(CASE WHEN n_spin >= 0.8 * n THEN spin ELSE board END, 3) AS spin FROM g LEFT JOIN b USING (pitcher_id, season)""")
def join_fallback_source(t):
    """Measured per pitch where at least 80 % is covered, else from the board."""
    g = t("pitches").groupBy("pitcher_id", "season").agg(F.count(F.lit(1)).alias("n"), F.count("spin_rate").alias("n_spin"), F.avg("spin_rate").alias("measured"))
    v = t("pitcher_gmm_components").select("vec_id", "pitcher_id", "season", C.number(F.col("mean_spin_rate")).alias("s")).distinct().groupBy("pitcher_id", "season").agg(F.avg("s").alias("board"))
    full = F.col("n_spin") >= 0.8 * F.col("n")
    source = F.when(full, "pitches").when(F.col("board").isNotNull(), "board").otherwise("none")
    return g.join(v, ["pitcher_id", "season"], "left").select("pitcher_id", "season", source.alias("source"), F.round(F.when(full, F.col("measured")).otherwise(F.col("board")), 3).alias("spin"))


@query("""SELECT o_orderkey, coalesce(x.status, o_orderstatus) AS o_orderstatus FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE l_linestatus = 'O') = 0 THEN 'DONE' ELSE 'OPEN' END AS status
FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) x ON l_orderkey = o_orderkey""")
def update_from_join(t):
    status = t("lineitem").filter("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(F.count_if(F.col("l_linestatus") == "O") == 0, "DONE").otherwise("OPEN").alias("o_orderstatus"))
    return R.update_from(t("orders").select("o_orderkey", "o_orderstatus"), status, ["o_orderkey"], ["o_orderstatus"])


@query("""SELECT event_id, user_id, value FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, user_id, value * 2 AS value FROM events WHERE event_type = 'error'""")
def upsert_by_key(t):
    """Corrected rows replace stored rows of their key."""
    e = t("events").select("event_id", "user_id", "value", "event_type")
    fixed = e.filter("event_type = 'error'").withColumn("value", F.col("value") * 2)
    return R.upsert(e, fixed, ["event_id"]).select("event_id", "user_id", "value")


@query("""SELECT n.n_name, r.r_name, round(sum(o.o_totalprice), 2) AS total, count(*) AS n_orders FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def join_dimensions(t):
    """Facts fold to one row per customer before they meet the dimensions, which the engine broadcasts by their own size."""
    per_customer = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"))
    j = per_customer.join(t("customer"), "c_custkey").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.round(F.sum("s"), 2).alias("total"), F.sum("n").alias("n_orders"))


# --- aggregates


@query("""SELECT pitcher_id, season, count(*) AS n, round(count(*) FILTER (WHERE outcome_type = 'swinging_strike') * 1.0 / nullif(count(*) FILTER (WHERE outcome_type IN ('swinging_strike', 'foul', 'in_play')), 0), 6) AS whiff_rate,
round(count(*) FILTER (WHERE outcome_type IN ('swinging_strike', 'called_strike')) * 1.0 / count(*), 6) AS csw_rate FROM pitches GROUP BY 1, 2""")
def agg_conditional_rates(t):
    o = F.col("outcome_type")
    return t("pitches").groupBy("pitcher_id", "season").agg(
        F.count(F.lit(1)).alias("n"), F.round(C.ratio(F.count_if(o == "swinging_strike"), F.count_if(o.isin(*C.SWINGS))), 6).alias("whiff_rate"),
        F.round(C.ratio(F.count_if(o.isin("swinging_strike", "called_strike")), F.count(F.lit(1))), 6).alias("csw_rate"),
    )


@query("SELECT season, count(DISTINCT CAST(game_pk AS BIGINT) * 1000 + at_bat_number) AS n_at_bats, count(DISTINCT CASE WHEN events IS NOT NULL THEN CAST(game_pk AS BIGINT) * 1000 + at_bat_number END) AS n_ended FROM pitches GROUP BY 1")
def agg_count_distinct_composite(t):
    key = F.struct(*AT_BAT)
    return t("pitches").groupBy("season").agg(F.count_distinct(key).alias("n_at_bats"), F.count_distinct(F.when(F.col("events").isNotNull(), key)).alias("n_ended"))


@query("""SELECT game_pk, at_bat_number, CAST(arg_min(outs, pitch_number) AS INTEGER) AS first_outs, arg_min(outcome_type, pitch_number) AS first_outcome, max(events) AS outcome, bool_or(outcome_type = 'foul') AS any_foul,
bool_and(stand = 'R') AS all_right FROM pitches GROUP BY 1, 2""")
def agg_arg_min(t):
    first = F.min(F.struct("pitch_number", "outs", "outcome_type"))
    return t("pitches").groupBy(*AT_BAT).agg(first["outs"].cast("int").alias("first_outs"), first["outcome_type"].alias("first_outcome"), F.max("events").alias("outcome"), F.bool_or(F.col("outcome_type") == "foul").alias("any_foul"), F.bool_and(F.col("stand") == "R").alias("all_right"))


@query("""SELECT pitcher_id, round(avg(velo) FILTER (WHERE stand = 'L'), 4) AS velo_l, round(avg(velo) FILTER (WHERE stand = 'R'), 4) AS velo_r, count(*) FILTER (WHERE stand = 'L') AS n_l, count(*) FILTER (WHERE stand = 'R') AS n_r FROM pitches GROUP BY 1""")
def agg_pivot_splits(t):
    wide = t("pitches").groupBy("pitcher_id").pivot("stand", ["L", "R"]).agg(F.round(F.avg("velo"), 4).alias("velo"), F.count(F.lit(1)).alias("n"))
    return wide.select("pitcher_id", F.col("L_velo").alias("velo_l"), F.col("R_velo").alias("velo_r"), F.coalesce("L_n", F.lit(0)).alias("n_l"), F.coalesce("R_n", F.lit(0)).alias("n_r"))


@query("SELECT pitcher_id, count(*) AS n, round(avg(velo), 4) AS velo FROM pitches GROUP BY 1 HAVING count(*) >= 100 AND avg(velo) > 85")
def agg_having_min_sample(t):
    g = t("pitches").groupBy("pitcher_id").agg(F.count(F.lit(1)).alias("n"), F.avg("velo").alias("velo"))
    return g.filter("n >= 100 and velo > 85").withColumn("velo", F.round("velo", 4))


@query("SELECT outcome_type, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM pitches GROUP BY 1")
def agg_share_of_total(t):
    g = t("pitches").groupBy("outcome_type").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()).cast("double"), 6))


@query("""SELECT season, '{"n":' || count(*) || ',"hits":' || count(*) FILTER (WHERE events IN ('single', 'double', 'home_run')) || '}' AS summary FROM pitches GROUP BY 1""")
def agg_json_object(t):
    g = t("pitches").groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("events").isin("single", "double", "home_run")).alias("hits"))
    return g.select("season", F.to_json(F.struct("n", "hits")).alias("summary"))


@query("SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.1), 4) AS q10, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.99), 4) AS q99 FROM lineitem GROUP BY 1, 2")
def agg_quantiles(t):
    q = quantiles.exact(t("lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_extendedprice"), [0.1, 0.5, 0.99])
    return q.select("l_returnflag", "l_linestatus", *[F.round(f"q{i}", 4).alias(n) for i, n in enumerate(("q10", "q50", "q99"))])


@query("SELECT CAST(floor(velo) AS INTEGER) AS velo, count(*) AS n FROM pitches WHERE velo IS NOT NULL GROUP BY 1")
def agg_histogram(t):
    return t("pitches").filter("velo is not null").groupBy(F.floor("velo").cast("int").alias("velo")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count_balls, count_strikes, round(sum(w) FILTER (WHERE outcome_type = 'ball'), 4) AS ball, round(sum(w) FILTER (WHERE outcome_type = 'in_play'), 4) AS in_play FROM (
SELECT *, CASE WHEN 2025 - season <= 1 THEN 2.0::DOUBLE ELSE greatest(0.25::DOUBLE, 2.0::DOUBLE * pow(0.75::DOUBLE, 2025 - season - 1)) END AS w FROM pitches) GROUP BY 1, 2""")
def agg_weighted_matrix(t):
    p = t("pitches").withColumn("w", C.recency_weight(F.col("season"), F.lit(2025)))
    wide = p.groupBy("count_balls", "count_strikes").pivot("outcome_type", ["ball", "in_play"]).agg(F.sum("w"))
    return wide.select("count_balls", "count_strikes", F.round("ball", 4).alias("ball"), F.round("in_play", 4).alias("in_play"))


@query("SELECT p_throws, count(velo) AS n, round(avg(velo), 4) AS mean, round(stddev_samp(velo), 4) AS sd, round(var_pop(velo), 4) AS var_p, round(corr(velo, ivb), 4) AS r FROM pitches GROUP BY 1")
def agg_stats_moments(t):
    return t("pitches").groupBy("p_throws").agg(F.count("velo").alias("n"), F.round(F.avg("velo"), 4).alias("mean"), F.round(F.stddev_samp("velo"), 4).alias("sd"), F.round(F.var_pop("velo"), 4).alias("var_p"), F.round(F.corr("velo", "ivb"), 4).alias("r"))


@query("SELECT count(*) AS n_keys, CAST(sum(n - 1) AS BIGINT) AS n_extra, CAST(max(n) AS BIGINT) AS most FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)")
def duplicate_audit(t):
    g = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return g.agg(F.count(F.lit(1)).alias("n_keys"), F.sum(F.col("n") - 1).alias("n_extra"), F.max("n").alias("most"))


# --- windows


@query("""SELECT pitch_id, lag(outcome_type) OVER w AS prev_outcome, round(velo - lag(velo) OVER w, 4) AS velo_step FROM pitches WINDOW w AS (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number, pitch_id)""")
def win_lag_context(t):
    w = Window.partitionBy(*AT_BAT).orderBy("pitch_number", "pitch_id")
    return t("pitches").select("pitch_id", F.lag("outcome_type").over(w).alias("prev_outcome"), F.round(F.col("velo") - F.lag("velo").over(w), 4).alias("velo_step"))


@query("""SELECT pitcher_id, CAST(game_date AS VARCHAR) AS game_date, CAST(least(coalesce(date_diff('day', lag(game_date) OVER (PARTITION BY pitcher_id ORDER BY game_date), game_date), 30), 30) AS INTEGER) AS rest FROM (SELECT DISTINCT pitcher_id, game_date FROM pitches)""")
def win_days_rest(t):
    """Days since the last appearance, capped; appearances fold to days first."""
    d = t("pitches").select("pitcher_id", "game_date").distinct()
    gap = F.datediff("game_date", F.lag("game_date").over(Window.partitionBy("pitcher_id").orderBy("game_date")))
    return d.select("pitcher_id", F.col("game_date").cast("string").alias("game_date"), F.least(F.coalesce(gap, F.lit(30)), F.lit(30)).alias("rest"))


@query("""SELECT pitch_id, count(*) OVER w AS thrown, count(*) FILTER (WHERE outcome_type <> 'ball') OVER w AS strikes FROM pitches
WINDOW w AS (PARTITION BY game_pk, pitcher_id ORDER BY at_bat_number, pitch_number, pitch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def win_running_sum(t):
    w = Window.partitionBy("game_pk", "pitcher_id").orderBy("at_bat_number", "pitch_number", "pitch_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("pitches").select("pitch_id", F.count(F.lit(1)).over(w).alias("thrown"), F.sum(F.when(F.col("outcome_type") != "ball", 1).otherwise(0)).over(w).alias("strikes"))


@query("""SELECT pitch_id, count(*) OVER (PARTITION BY game_pk, pitcher_id ORDER BY at_bat_number RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_at_bat FROM pitches""")
def win_range_before(t):
    """Pitches thrown before this at-bat: a range frame, so that all pitches of the at-bat share one value."""
    w = Window.partitionBy("game_pk", "pitcher_id").orderBy("at_bat_number").rangeBetween(Window.unboundedPreceding, -1)
    return t("pitches").select("pitch_id", F.count(F.lit(1)).over(w).alias("before_at_bat"))


@query("SELECT DISTINCT game_pk, inning, first_value(pitcher_id) OVER (PARTITION BY game_pk, inning ORDER BY at_bat_number, pitch_number, pitch_id) AS opener FROM pitches")
def win_first_value(t):
    """First of a group as a partial aggregate: no window needed where one value per group is asked."""
    return t("pitches").groupBy("game_pk", "inning").agg(F.min(F.struct("at_bat_number", "pitch_number", "pitch_id", "pitcher_id"))["pitcher_id"].alias("opener"))


@query("""SELECT game_pk, pitcher_id, at_bat_number, CAST((dense_rank() OVER (PARTITION BY game_pk, pitcher_id ORDER BY at_bat_number) - 1) // 9 + 1 AS INTEGER) AS times_through FROM (SELECT DISTINCT game_pk, pitcher_id, at_bat_number FROM pitches)""")
def win_dense_rank_cycle(t):
    d = t("pitches").select("game_pk", "pitcher_id", "at_bat_number").distinct()
    rank = F.dense_rank().over(Window.partitionBy("game_pk", "pitcher_id").orderBy("at_bat_number"))
    return d.select("game_pk", "pitcher_id", "at_bat_number", (F.floor((rank - 1) / 9) + 1).cast("int").alias("times_through"))


@query("""SELECT game_pk, at_bat_number, pitch_id, outcome_type FROM (SELECT *, row_number() OVER (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number, pitch_id) AS rn FROM pitches) WHERE rn = 1""")
def win_first_per_group(t):
    return R.first_per(t("pitches"), AT_BAT, ["pitch_number", "pitch_id"]).select(*AT_BAT, "pitch_id", "outcome_type")


@query("SELECT pitch_id, max(events) OVER (PARTITION BY game_pk, at_bat_number) AS ending, pitch_number = max(pitch_number) OVER (PARTITION BY game_pk, at_bat_number) AS is_last FROM pitches")
def win_partition_max(t):
    w = Window.partitionBy(*AT_BAT)
    return t("pitches").select("pitch_id", F.max("events").over(w).alias("ending"), (F.col("pitch_number") == F.max("pitch_number").over(w)).alias("is_last"))


@query("""WITH c AS (SELECT game_pk, at_bat_number, pitch_number, pitch_id, count(*) OVER (PARTITION BY game_pk ORDER BY at_bat_number, pitch_number, pitch_id) AS n FROM pitches)
SELECT pitch_id, lag(n, 1, 0) OVER (PARTITION BY game_pk ORDER BY at_bat_number, pitch_number, pitch_id) AS entering FROM c""")
def win_nested_lag(t):
    w = Window.partitionBy("game_pk").orderBy("at_bat_number", "pitch_number", "pitch_id")
    c = t("pitches").withColumn("n", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.select("pitch_id", F.lag("n", 1, 0).over(w).alias("entering"))


@query("""SELECT pitch_id, row_number() OVER (PARTITION BY game_pk, at_bat_number ORDER BY outcome_type = 'in_play', pitch_number, pitch_id) = 1 AS tagged FROM pitches""")
def win_tag_one_row(t):
    """One row of each group is tagged: the first that was not put in play."""
    w = Window.partitionBy(*AT_BAT).orderBy(F.col("outcome_type") == "in_play", "pitch_number", "pitch_id")
    return t("pitches").select("pitch_id", (F.row_number().over(w) == 1).alias("tagged"))


@query("""WITH d AS (SELECT pitcher_id, game_date, count(*) AS n FROM pitches GROUP BY 1, 2)
SELECT a.pitcher_id, CAST(a.game_date AS VARCHAR) AS game_date, count(b.n) FILTER (WHERE b.game_date >= a.game_date - INTERVAL 1 DAY) > 0 AS pitched_yesterday,
 CAST(coalesce(sum(b.n) FILTER (WHERE b.game_date >= a.game_date - INTERVAL 7 DAY), 0) AS BIGINT) AS pitches_7d, CAST(count(b.n) AS BIGINT) AS games_30d
FROM d a LEFT JOIN d b ON a.pitcher_id = b.pitcher_id AND b.game_date < a.game_date AND b.game_date >= a.game_date - INTERVAL 30 DAY GROUP BY 1, 2""")
def bullpen_workload(t):
    """Load of strictly earlier days: one sort serves all three range windows."""
    d = t("pitches").groupBy("pitcher_id", "game_date").agg(F.count(F.lit(1)).alias("n")).withColumn("day", F.datediff("game_date", F.lit("1970-01-01")))
    w = lambda days: Window.partitionBy("pitcher_id").orderBy("day").rangeBetween(-days, -1)
    return d.select("pitcher_id", F.col("game_date").cast("string").alias("game_date"), (F.count("n").over(w(1)) > 0).alias("pitched_yesterday"), F.coalesce(F.sum("n").over(w(7)), F.lit(0)).alias("pitches_7d"), F.count("n").over(w(30)).alias("games_30d"))


# --- top-k, distinct, sets


@query("SELECT pitcher_id, count(*) AS n, round(avg(velo), 4) AS velo FROM pitches GROUP BY 1 HAVING count(*) >= 50 ORDER BY velo DESC NULLS LAST, pitcher_id LIMIT 25")
def leaderboard_topk(t):
    g = t("pitches").groupBy("pitcher_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("velo"), 4).alias("velo")).filter("n >= 50")
    return g.orderBy(F.col("velo").desc_nulls_last(), "pitcher_id").limit(25)


@query("""SELECT game_pk, status, feed FROM (SELECT game_pk, status, feed, row_number() OVER (PARTITION BY game_pk ORDER BY (status = 'Final') DESC, list_position(['primary', 'statsapi', 'desk', 'mirror', 'park', 'intl'], feed), schedule_id) AS rn FROM schedule_games WHERE status IS NOT NULL) WHERE rn = 1""")
def distinct_on_preference(t):
    order = [(F.col("status") == "Final").desc(), F.array_position(F.array(*[F.lit(x) for x in ("primary", "statsapi", "desk", "mirror", "park", "intl")]), F.col("feed")), F.col("schedule_id")]
    return R.first_per(t("schedule_games").filter("status is not null"), ["game_pk"], order).select("game_pk", "status", "feed")


@query("SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events ORDER BY events.ts DESC, event_id LIMIT 20")
def latest_n(t):
    return t("events").orderBy(F.col("ts").desc(), "event_id").limit(20).select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("SELECT role, player_id, count(*) AS n FROM (SELECT 'pitcher' AS role, pitcher_id AS player_id FROM pitches UNION ALL SELECT 'batter', batter_id FROM pitches) GROUP BY 1, 2")
def union_all_generated(t):
    """Two roles of each pitch from one scan."""
    rules = {"pitcher": (F.lit(True), {"player_id": F.col("pitcher_id")}), "batter": (F.lit(True), {"player_id": F.col("batter_id")})}
    return R.rules_union(t("pitches"), [], rules).groupBy(F.col("rule").alias("role"), "player_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT pitcher_id, season FROM pitcher_season_metrics UNION SELECT pitcher_id, season FROM pitcher_gmm_components UNION SELECT pitcher_id, season FROM pitch_pool")
def union_distinct_keys(t):
    return R.union_all([t(x).select("pitcher_id", "season").distinct() for x in ("pitcher_season_metrics", "pitcher_gmm_components", "pitch_pool")]).distinct()


@query("SELECT pitch_id, 'right' AS side FROM (SELECT pitch_id FROM pitch_pool EXCEPT ALL SELECT DISTINCT pitch_id FROM pitch_pool)")
def except_all_equality(t):
    """What raw deliveries hold beyond one row for each pitch."""
    raw = t("pitch_pool").select("pitch_id")
    return R.same_rows(raw.distinct(), raw)


@query("""SELECT manager_id, side FROM (SELECT coalesce(a.manager_id, b.manager_id) AS manager_id, CASE WHEN b.manager_id IS NULL THEN 'left' WHEN a.manager_id IS NULL THEN 'right' WHEN a.team_id IS DISTINCT FROM b.team_id THEN 'changed' END AS side
FROM (SELECT manager_id, max(team_id) AS team_id FROM managers WHERE season = 2023 GROUP BY 1) a FULL OUTER JOIN (SELECT manager_id, max(team_id) AS team_id FROM managers WHERE season = 2024 GROUP BY 1) b ON a.manager_id = b.manager_id) WHERE side IS NOT NULL""")
def outer_equality_check(t):
    of = lambda season: t("managers").filter(F.col("season") == season).groupBy("manager_id").agg(F.max("team_id").alias("team_id"))
    return R.differences(of(2023), of(2024), ["manager_id"])


# --- scalars


@query("""SELECT pitch_id, CAST(game_pk || lpad(CAST(at_bat_number AS VARCHAR), 3, '0') || lpad(CAST(pitch_number AS VARCHAR), 3, '0') AS BIGINT) AS pitch_key FROM pitches""")
def surrogate_key(t):
    return t("pitches").select("pitch_id", C.packed_key((F.col("game_pk"), 0), (F.col("at_bat_number"), 3), (F.col("pitch_number"), 3)).alias("pitch_key"))


@query("SELECT season, round(CASE WHEN 2025 - season <= 1 THEN 2.0 ELSE greatest(0.25, 2.0 * pow(0.75, 2025 - season - 1)) END, 6) AS w FROM (SELECT DISTINCT season FROM pitches)")
def recency_weight(t):
    return t("pitches").select("season").distinct().select("season", F.round(C.recency_weight(F.col("season"), F.lit(2025)), 6).alias("w"))


LEVERAGE_SQL = """(CASE WHEN inning <= 3 THEN 0.6 WHEN inning <= 6 THEN 0.9 WHEN inning <= 8 THEN 1.3 ELSE 1.5 END)::DOUBLE * greatest(0.3::DOUBLE, 1.5::DOUBLE - 0.24::DOUBLE * least(abs(score_diff), 5))
  * (1 + 0.15::DOUBLE * bit_count(runners_state)) * (CASE WHEN outs = 2 THEN 1.1 ELSE 1.0 END)::DOUBLE"""


@query(f"SELECT pitch_id, round({LEVERAGE_SQL}, 6) AS leverage, CASE WHEN abs(score_diff) <= 1 AND inning >= 7 THEN 'high' WHEN abs(score_diff) >= 4 OR inning <= 5 THEN 'low' ELSE 'mid' END AS bucket FROM pitches")
def leverage_index(t):
    c = [F.col(x) for x in ("inning", "score_diff", "runners_state", "outs")]
    return t("pitches").select("pitch_id", F.round(C.leverage(*c), 6).alias("leverage"), C.leverage_bucket(c[0], c[1]).alias("bucket"))


@query("SELECT runners_state & 1 = 1 AS on_1b, (runners_state >> 1) & 1 = 1 AS on_2b, (runners_state >> 2) & 1 = 1 AS on_3b, CAST(bit_count(runners_state) AS INTEGER) AS runners, count(*) AS n FROM pitches GROUP BY ALL")
def bitmask_state(t):
    one, two, three = C.bases(F.col("runners_state"))
    return t("pitches").groupBy(one.alias("on_1b"), two.alias("on_2b"), three.alias("on_3b"), F.bit_count("runners_state").cast("int").alias("runners")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST((((runners_state * 3 + outs) * 5 + CASE WHEN score_diff <= -4 THEN 0 WHEN score_diff <= -1 THEN 1 WHEN score_diff = 0 THEN 2 WHEN score_diff <= 3 THEN 3 ELSE 4 END) * 4 + count_balls) * 3 + count_strikes AS INTEGER) AS cell, count(*) AS n FROM pitches
WHERE runners_state BETWEEN 0 AND 7 AND outs BETWEEN 0 AND 2 AND count_balls BETWEEN 0 AND 3 AND count_strikes BETWEEN 0 AND 2 AND score_diff IS NOT NULL GROUP BY 1""")
def cell_key(t):
    d = F.col("score_diff")
    band = F.when(d <= -4, 0).when(d <= -1, 1).when(d == 0, 2).when(d <= 3, 3).when(d > 3, 4)
    cell = C.mixed_radix((F.col("runners_state"), 8), (F.col("outs"), 3), (band, 5), (F.col("count_balls"), 4), (F.col("count_strikes"), 3))
    return t("pitches").groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).filter("cell is not null")


@query("SELECT CASE WHEN velo > 0 AND velo <= 80 THEN 1 WHEN velo > 80 AND velo <= 85 THEN 2 WHEN velo > 85 AND velo <= 90 THEN 3 WHEN velo > 90 AND velo <= 95 THEN 4 WHEN velo > 95 AND velo <= 110 THEN 5 END AS star, CAST(greatest(0, least(9, floor((velo - 70) / 3.5))) AS INTEGER) AS bin, count(*) AS n FROM pitches WHERE velo IS NOT NULL GROUP BY 1, 2")
def sector_bin(t):
    v = F.col("velo")
    return t("pitches").filter("velo is not null").groupBy(C.ladder(v, [0, 80, 85, 90, 95, 110], [1, 2, 3, 4, 5]).alias("star"), C.equal_width_bin(v, 70, 105, 10).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sha256(concat_ws('|', coalesce('=' || lower(trim(team_name)), '~'), coalesce('=' || lower(trim(team_abbrev)), '~'), coalesce('=' || CAST(venue_id AS VARCHAR), '~'))) AS digest, count(*) AS n, count(DISTINCT team_id) AS n_teams FROM teams GROUP BY 1")
def sha_dedup_key(t):
    key = C.digest(F.col("team_name"), F.col("team_abbrev"), F.col("venue_id"))
    return t("teams").groupBy(key.alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("team_id").alias("n_teams"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(strftime(min(o_orderdate), '%Y%m%d') AS INTEGER) AS first_ymd, CAST(max(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))) AS INTEGER) AS last_day FROM orders GROUP BY 1, 2")
def date_parts(t):
    d = F.col("o_orderdate")
    return t("orders").groupBy(F.year(d).alias("y"), F.month(d).alias("m")).agg(F.date_format(F.min(d), "yyyyMMdd").cast("int").alias("first_ymd"), F.max(F.datediff(d, F.lit("1992-01-01").cast("date"))).alias("last_day"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_extract(t):
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))
