"""Further profile, model and diagnostic queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel.functions import columns as C
from tidewheel.operators import evaluate as E
from tidewheel.operators import models, quantiles
from tidewheel.operators import relational as R
from tidewheel.plans.catalogue import Catalogue
from tidewheel.plans.modelling import BATTERS_SQL, batters

CATALOGUE = Catalogue()
query, QUERIES, SQL = CATALOGUE.query, CATALOGUE.queries, CATALOGUE.sql


@query("SELECT p_throws, count(*) AS n, count(*) FILTER (WHERE velo >= 88 AND ivb BETWEEN greatest(8, 26 - (velo - 88)) AND least(50, 30 + 2 * (velo - 88))) AS n_in_band FROM pitches GROUP BY 1")
def sliding_band(t):
    """A band whose bounds widen with another column."""
    v, x = F.col("velo"), F.col("ivb")
    band = (v >= 88) & x.between(F.greatest(F.lit(8.0), 26 - (v - 88)), F.least(F.lit(50.0), 30 + 2 * (v - 88)))
    return t("pitches").groupBy("p_throws").agg(F.count(F.lit(1)).alias("n"), F.count_if(band).alias("n_in_band"))


@query("SELECT coalesce(events = 'walk', FALSE) OR coalesce(outcome_type = 'ball', FALSE) AS free, count(*) AS n FROM pitches GROUP BY 1")
def null_safe_boolean(t):
    return t("pitches").groupBy(C.any_of(F.col("events") == "walk", F.col("outcome_type") == "ball").alias("free")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT season, stand, count(*) AS n FROM pitches WHERE season >= 2021 AND stand = 'L' AND game_pk IN (SELECT game_pk FROM pitches WHERE events = 'home_run') GROUP BY 1, 2")
def optional_filters(t):
    """Filters that are given are applied; a subquery becomes a semi-join."""
    p, given = t("pitches"), {"season_from": 2021, "stand": "L", "player": None, "games_with": "home_run"}
    rules = {"season_from": lambda v: F.col("season") >= v, "stand": lambda v: F.col("stand") == v, "player": lambda v: F.col("pitcher_id") == v}
    out = p
    for name, rule in rules.items():
        out = out.filter(rule(given[name])) if given[name] is not None else out
    if given["games_with"]:
        out = out.join(p.filter(F.col("events") == given["games_with"]).select("game_pk"), "game_pk", "left_semi")
    return out.groupBy("season", "stand").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_throws, round(regr_slope(hb, velo), 5) AS slope, round(regr_intercept(hb, velo), 4) AS intercept, round(regr_r2(hb, velo), 6) AS r2, CAST(regr_count(hb, velo) AS BIGINT) AS n FROM pitches GROUP BY 1")
def least_squares(t):
    return t("pitches").groupBy("p_throws").agg(F.round(F.regr_slope("hb", "velo"), 5).alias("slope"), F.round(F.regr_intercept("hb", "velo"), 4).alias("intercept"), F.round(F.regr_r2("hb", "velo"), 6).alias("r2"), F.regr_count("hb", "velo").alias("n"))


INNINGS = list(range(1, 10))


@query(f"SELECT game_pk, {', '.join(f'count(*) FILTER (WHERE inning = {i}) AS i{i}' for i in INNINGS)} FROM pitches WHERE events IN ('single', 'double', 'home_run') GROUP BY 1")
def linescore(t):
    hits = t("pitches").filter(F.col("events").isin("single", "double", "home_run"))
    wide = hits.groupBy("game_pk").pivot("inning", INNINGS).agg(F.count(F.lit(1)))
    return wide.select("game_pk", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"i{i}") for i in INNINGS])


@query("""WITH a AS (SELECT season, game_pk, at_bat_number, count(*) AS k FROM pitches GROUP BY 1, 2, 3), m AS (SELECT k, count(*) AS n FROM a WHERE season < 2024 GROUP BY 1),
c AS (SELECT k, CAST(sum(n) OVER (ORDER BY k) AS DOUBLE) / sum(n) OVER () AS cdf, n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM m)
SELECT a.season, count(*) AS n, round(avg(cdf - p / 2), 6) AS mean_pit, round(avg((cdf - p / 2 BETWEEN 0.1 AND 0.9)::INT), 6) AS coverage FROM a JOIN c USING (k) WHERE a.season >= 2024 GROUP BY 1""")
def pmf_coverage(t):
    """Where later outcomes fall in the distribution of earlier seasons: mean of the mid-CDF, and how much lies in its middle 80 %."""
    a = t("pitches").groupBy("season", "game_pk", "at_bat_number").agg(F.count(F.lit(1)).alias("k"))
    fit = E.pmf(a.filter("season < 2024"), [], "k").select("k", (F.col("cdf") - F.col("probability") / 2).alias("pit"))
    j = a.filter("season >= 2024").groupBy("season", "k").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(fit), "k")
    n = F.col("n")
    return j.groupBy("season").agg(F.sum("n").alias("n"), F.round(F.sum(n * F.col("pit")) / F.sum(n), 6).alias("mean_pit"), F.round(F.sum(F.when(F.col("pit").between(0.1, 0.9), n).otherwise(0)) / F.sum(n), 6).alias("coverage"))


@query("""WITH g AS (SELECT DISTINCT game_pk, season, home_score_final AS h, away_score_final AS a FROM schedule_games WHERE status = 'Final' AND home_score_final IS NOT NULL AND away_score_final IS NOT NULL),
s AS (SELECT season, count(*) AS n, sum(CASE WHEN h > a THEN 1.0 WHEN h = a THEN 0.5 ELSE 0 END)::DOUBLE AS k FROM g GROUP BY 1), p AS (SELECT *, (k + 2) / (n + 4) AS p FROM s)
SELECT season, n, round(p, 6) AS p, round(greatest(0, p - 1.959963984540054 * sqrt(p * (1 - p) / n)), 6) AS low, round(least(1, p + 1.959963984540054 * sqrt(p * (1 - p) / n)), 6) AS high FROM p""")
def win_probability(t):
    """Smoothed home win shares; ties count half."""
    g = t("schedule_games").filter("status = 'Final' and home_score_final is not null and away_score_final is not null").select("game_pk", "season", "home_score_final", "away_score_final").distinct()
    won = F.when(F.col("home_score_final") > F.col("away_score_final"), 1.0).when(F.col("home_score_final") == F.col("away_score_final"), 0.5).otherwise(0.0)
    s = g.groupBy("season").agg(F.count(F.lit(1)).alias("n"), ((F.sum(won) + 2) / (F.count(F.lit(1)) + 4)).alias("p"))
    low, high = E.proportion_interval(F.col("p"), F.col("n"))
    return s.select("season", "n", F.round("p", 6).alias("p"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""WITH g AS (SELECT pitcher_id, p_throws, count(*) FILTER (WHERE outcome_type IN ('ball', 'called_strike')) AS n, count(*) FILTER (WHERE outcome_type = 'called_strike') AS k FROM pitches GROUP BY 1, 2),
l AS (SELECT p_throws, sum(k) / CAST(sum(n) AS DOUBLE) AS league FROM g GROUP BY 1)
SELECT pitcher_id, p_throws, round(CASE WHEN n IS NULL OR league IS NULL OR league = 0 THEN 1.0 ELSE greatest(0, least(1 / league, ((k + 50 * league) / (n + 50.0)) / league)) END, 6) AS ratio FROM g JOIN l USING (p_throws)""")
def shrunk_ratio_clamped(t):
    """Shrunk rate over the league's, within what a rate of 1 would give; 1 where the league has none."""
    o = F.col("outcome_type")
    g = t("pitches").groupBy("pitcher_id", "p_throws").agg(F.count_if(o.isin("ball", "called_strike")).alias("n"), F.count_if(o == "called_strike").alias("k"))
    league = g.groupBy("p_throws").agg(C.ratio(F.sum("k"), F.sum("n")).alias("league"))
    rate = (F.col("k") + 50 * F.col("league")) / (F.col("n") + 50.0)
    ratio = F.when(F.col("league") > 0, F.greatest(F.lit(0.0), F.least(1 / F.col("league"), rate / F.col("league")))).otherwise(1.0)
    return g.join(league, "p_throws").select("pitcher_id", "p_throws", F.round(ratio, 6).alias("ratio"))


COMPOSITE_SQL = """WITH b AS ({base}), r AS (SELECT q.batter_id AS query_id, q.season, b.batter_id, (0.6 * exp(-power(q.k_rate - b.k_rate, 2) / 0.005) + 0.4 * exp(-power(q.walk_rate - b.walk_rate, 2) / 0.002))
  * CASE WHEN q.bats = b.bats THEN 1 ELSE 0.8 END * sqrt(least(q.sample_pa / (q.sample_pa + 60.0), b.sample_pa / (b.sample_pa + 60.0))) AS raw
  FROM b q JOIN b USING (season) WHERE q.batter_id % 50 = 0 AND b.batter_id <> q.batter_id), s AS (SELECT *, CASE WHEN raw IS NOT NULL THEN least(1.0, greatest(0.0, raw)) END AS score FROM r)"""


def _composite(t):
    b = batters(t).select("batter_id", "season", "bats", "sample_pa", "k_rate", "walk_rate")
    q = b.filter("batter_id % 50 = 0").select(F.col("batter_id").alias("query_id"), "season", *[F.col(c).alias(f"q_{c}") for c in ("bats", "sample_pa", "k_rate", "walk_rate")])
    j = q.join(b, "season").filter("batter_id <> query_id")
    near = lambda c, s: F.exp(-F.pow(F.col(f"q_{c}") - F.col(c), F.lit(2)) / s)
    alpha = lambda c: F.col(c) / (F.col(c) + 60.0)
    raw = (0.6 * near("k_rate", 0.005) + 0.4 * near("walk_rate", 0.002)) * F.when(F.col("q_bats") == F.col("bats"), 1.0).otherwise(0.8) * F.sqrt(F.least(alpha("q_sample_pa"), alpha("sample_pa")))
    return j.withColumn("score", C.clamp(raw, 0.0, 1.0))


@query(COMPOSITE_SQL.format(base=BATTERS_SQL) + " SELECT query_id, season, count(score) AS n, round(max(score), 6) AS best, round(avg(score), 6) AS mean FROM s GROUP BY 1, 2")
def composite_scores(t):
    """Weighted sub-scores, times a penalty for the other hand and the root of the smaller reliability."""
    return _composite(t).groupBy("query_id", "season").agg(F.count("score").alias("n"), F.round(F.max("score"), 6).alias("best"), F.round(F.avg("score"), 6).alias("mean"))


@query(COMPOSITE_SQL.format(base=BATTERS_SQL) + " SELECT season, round(quantile_cont(score, 0.1), 6) AS q10, round(quantile_cont(score, 0.5), 6) AS q50, round(quantile_cont(score, 0.9), 6) AS q90 FROM s WHERE score IS NOT NULL GROUP BY 1")
def score_distribution(t):
    q = quantiles.exact(_composite(t), ["season"], F.col("score"), [0.1, 0.5, 0.9])
    return q.select("season", *[F.round(f"q{i}", 6).alias(n) for i, n in enumerate(("q10", "q50", "q90"))])


@query(f"""WITH b AS ({BATTERS_SQL}) SELECT a.season, count(*) AS n, round(avg(exp(-power(a.k_rate - n.k_rate, 2) / 0.005)), 6) AS self_score FROM b a JOIN b n ON a.batter_id = n.batter_id AND n.season = a.season + 1 WHERE a.k_rate IS NOT NULL AND n.k_rate IS NOT NULL GROUP BY 1""")
def cross_season_similarity(t):
    """How like themselves players are a season later: one window step per player, no self-join."""
    b = batters(t).select("batter_id", "season", "k_rate")
    w = Window.partitionBy("batter_id").orderBy("season")
    n = b.withColumn("s", F.lead("season").over(w)).withColumn("k", F.lead("k_rate").over(w)).filter("s = season + 1 and k is not null and k_rate is not null")
    return n.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.exp(-F.pow(F.col("k_rate") - F.col("k"), F.lit(2)) / 0.005)), 6).alias("self_score"))


@query("""WITH s AS (SELECT inning, quantile_cont(velo, 0.1) FILTER (WHERE events = 'home_run') AS hr, count(velo) FILTER (WHERE events = 'home_run') AS n_hr, quantile_cont(velo, 0.99) FILTER (WHERE events = 'field_out') AS kept, count(velo) FILTER (WHERE events = 'field_out') AS n_kept FROM pitches GROUP BY 1)
SELECT CAST(inning AS INTEGER) AS sector, round(CASE WHEN n_hr >= 5 AND n_kept >= 20 THEN (hr + kept) / 2 WHEN n_hr >= 5 THEN hr WHEN n_kept >= 20 THEN kept END, 4) AS line FROM s""")
def sector_line(t):
    """A boundary between two kinds of outcomes: the midpoint of two quantiles where both are supported, one alone where the other is thin."""
    p = t("pitches").select(F.col("inning").cast("int").alias("sector"), "events", "velo")
    of = lambda e, q, n: quantiles.exact(p.filter(F.col("events") == e), ["sector"], F.col("velo"), [q]).select("sector", F.col("q0").alias(n), F.col("n").alias(f"n_{n}"))
    s = p.select("sector").distinct().join(of("home_run", 0.1, "hr"), "sector", "left").join(of("field_out", 0.99, "kept"), "sector", "left")
    line = F.when((F.col("n_hr") >= 5) & (F.col("n_kept") >= 20), (F.col("hr") + F.col("kept")) / 2).when(F.col("n_hr") >= 5, F.col("hr")).when(F.col("n_kept") >= 20, F.col("kept"))
    return s.select("sector", F.round(line, 4).alias("line"))


@query("SELECT game_pk, CAST(bit_or(CASE WHEN events = 'home_run' THEN 1 << inning ELSE 0 END) AS BIGINT) AS mask, CAST(bit_count(CAST(bit_or(CASE WHEN events = 'home_run' THEN 1 << inning ELSE 0 END) AS BIGINT)) AS INTEGER) AS n_innings FROM pitches GROUP BY 1")
def credit_mask(t):
    """Bits of the innings that saw an event, gathered by an aggregate."""
    bit = F.when(F.col("events") == "home_run", F.expr("shiftleft(1L, cast(inning as int))")).otherwise(F.lit(0).cast("long"))
    g = t("pitches").groupBy("game_pk").agg(F.bit_or(bit).alias("mask"))
    return g.withColumn("n_innings", F.bit_count("mask").cast("int"))


@query("SELECT label, CAST(d AS INTEGER) AS d, round(avg(CAST(x AS DOUBLE)), 5) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY 1, 2")
def unnest_arrays(t):
    x = t("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return x.groupBy("label", (F.col("i") + 1).alias("d")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(t):
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(revenue.alias("revenue"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("SELECT NOT (velo BETWEEN 60 AND 108) AS bad_velo, NOT (count_balls BETWEEN 0 AND 3) AS bad_count, count(*) AS n FROM pitches WHERE velo IS NOT NULL GROUP BY 1, 2")
def row_guards(t):
    """Rows with the names of the rules they break, counted."""
    return t("pitches").filter("velo is not null").groupBy((~F.col("velo").between(60, 108)).alias("bad_velo"), (~F.col("count_balls").between(0, 3)).alias("bad_count")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT DISTINCT event_row_id, event_id, home, visitor FROM vendor_events), t AS (SELECT upper(trim(team_abbrev)) AS abbrev, min(team_id) AS team_id FROM teams WHERE team_abbrev IS NOT NULL AND trim(team_abbrev) <> '' GROUP BY 1)
SELECT event_row_id, h.team_id AS home_team_id, a.team_id AS away_team_id FROM v LEFT JOIN t h ON h.abbrev = upper(trim(v.home)) LEFT JOIN t a ON a.abbrev = upper(trim(v.visitor))""")
def entity_match(t):
    """Vendor events to teams by normalised abbreviation; where several teams have had one, the smallest id."""
    norm = lambda c: F.upper(F.regexp_replace(F.col(c), "^ +| +$", ""))
    teams = t("teams").withColumn("abbrev", norm("team_abbrev")).filter("abbrev is not null and abbrev <> ''").groupBy("abbrev").agg(F.min("team_id").alias("team_id"))
    v = t("vendor_events").select("event_row_id", "event_id", "home", "visitor").distinct()
    out = v.withColumn("abbrev", norm("home")).join(teams.withColumnRenamed("team_id", "home_team_id"), "abbrev", "left").drop("abbrev")
    return out.withColumn("abbrev", norm("visitor")).join(teams.withColumnRenamed("team_id", "away_team_id"), "abbrev", "left").select("event_row_id", "home_team_id", "away_team_id")


@query()
def logistic_whiff(t):
    """AUC and coefficients of a logistic model of whiffs among swings (rows only: fitted iteratively over all rows)."""
    p = t("pitches").filter(F.col("outcome_type").isin(*C.SWINGS)).withColumn("y", (F.col("outcome_type") == "swinging_strike").cast("double")).dropna(subset=["velo", "ivb", "hb"])
    return models.logistic_report(p, ["velo", "ivb", "hb"], "y")


@query()
def chi2_at_bat_lengths(t):
    """Lengths of at-bats in the newest season against all earlier ones, tails pooled."""
    a = t("pitches").groupBy("season", "game_pk", "at_bat_number").agg(F.count(F.lit(1)).alias("k"))
    g = a.groupBy((F.col("season") == 2025).alias("new"), F.least("k", F.lit(12)).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 24 rows
    new, old = ({r["k"]: r["n"] for r in g if r["new"] == flag} for flag in (True, False))
    labels, n, total = range(1, 13), sum(new.values()), max(sum(old.values()), 1)
    stat, dof, _ = E.pooled_chi2([new.get(k, 0) for k in labels], [old.get(k, 0) * n / total for k in labels], [str(k) for k in labels])
    return t("region").limit(1).select(F.lit(round(stat, 6)).alias("chi2"), F.lit(dof).alias("dof"), F.lit(n).alias("n"))
