"""Composite profiles, similarity, weighted draws, distributions, evaluation and live-feed semantics (in their batch form)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel.functions import columns as C
from tidewheel.operators import evaluate as E
from tidewheel.operators import quantiles, simulate
from tidewheel.operators import relational as R
from tidewheel.operators import sampling as S
from tidewheel.operators import scoring as K
from tidewheel.plans.catalogue import Catalogue

CATALOGUE = Catalogue()
query, QUERIES, SQL = CATALOGUE.query, CATALOGUE.queries, CATALOGUE.sql
AT_BAT = ["game_pk", "at_bat_number"]
RATES = ("k_rate", "walk_rate", "whiff_rate", "contact_rate", "avg_exit_velo")

BATTERS_SQL = """SELECT batter_id, season, bats, sample_pa, k_rate, walk_rate, whiff_rate, contact_rate, avg_exit_velo FROM (
  SELECT *, row_number() OVER (PARTITION BY batter_id, season ORDER BY asof_date DESC, updated_at DESC, metric_id DESC) AS rn FROM batter_season_metrics WHERE asof_date IS NOT NULL) WHERE rn = 1"""


def batters(t):
    """The last metrics of every batter and season, by one partial aggregate."""
    m = t("batter_season_metrics").filter("asof_date is not null")
    return R.top_per(m, ["batter_id", "season"], ["asof_date", "updated_at", "metric_id"], ["bats", "sample_pa", *RATES])


# --- composite profiles


@query("""WITH g AS (SELECT DISTINCT game_pk, season, venue_id, home_score_final + away_score_final AS runs FROM schedule_games WHERE status = 'Final' AND venue_id IS NOT NULL AND home_score_final IS NOT NULL AND away_score_final IS NOT NULL),
v AS (SELECT venue_id, season, count(*) AS n, avg(runs) AS r FROM g GROUP BY 1, 2), l AS (SELECT season, avg(runs) AS league FROM g GROUP BY 1)
SELECT venue_id, season, n, round((n * r / nullif(league, 0) + 20.0) / (n + 20.0), 6) AS factor FROM v JOIN l USING (season)""")
def park_factors_shrunk(t):
    """Runs a game of each venue over the league's, shrunk towards 1."""
    g = t("schedule_games").filter("status = 'Final' and venue_id is not null").select("game_pk", "season", "venue_id", (F.col("home_score_final") + F.col("away_score_final")).alias("runs")).filter("runs is not null").distinct()
    v = g.groupBy("venue_id", "season").agg(F.count(F.lit(1)).alias("n"), F.sum("runs").alias("s"))
    league = v.groupBy("season").agg(F.sum("s").alias("ls"), F.sum("n").alias("ln"))
    factor = C.ratio(F.col("s") / F.col("n"), F.col("ls") / F.col("ln"))
    return v.join(league, "season").select("venue_id", "season", "n", F.round((F.col("n") * factor + 20.0) / (F.col("n") + 20.0), 6).alias("factor"))


@query("""WITH f AS (SELECT game_pk, at_bat_number, arg_min(runners_state, ROW(pitch_number, pitch_id)) AS b, arg_min(outs, ROW(pitch_number, pitch_id)) AS o, max(events) AS e FROM pitches WHERE inning <= 8 GROUP BY 1, 2)
SELECT CAST(b AS INTEGER) AS bases, CAST(o AS INTEGER) AS outs, count(*) AS n, round(sum(CASE e WHEN 'single' THEN 1 WHEN 'double' THEN 2 WHEN 'triple' THEN 3 WHEN 'home_run' THEN 4 ELSE 0 END) / count(*), 6) AS bases_gained FROM f WHERE e IS NOT NULL GROUP BY 1, 2""")
def base_out_expectancy(t):
    """Expectation of the 24 base-out states, one row for each at-bat, innings up to 8."""
    f = t("pitches").filter("inning <= 8").groupBy(*AT_BAT).agg(F.min(F.struct("pitch_number", "pitch_id", "runners_state", "outs")).alias("f"), F.max("events").alias("e")).filter("e is not null")
    gained = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in C.TOTAL_BASES.items() for x in kv]), F.col("e")), F.lit(0))
    return f.groupBy(F.col("f.runners_state").cast("int").alias("bases"), F.col("f.outs").cast("int").alias("outs")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(gained), 6).alias("bases_gained"))


CELL = "runners_state AS bases, least(outs, 2) AS outs, inning >= 7 AS late, abs(score_diff) <= 1 AS near"


@query(f"""WITH o AS (SELECT {CELL}, count(*) AS n FROM pitches WHERE pitch_number = 1 GROUP BY ALL), w AS (SELECT {CELL}, count(*) AS n FROM pitches WHERE events = 'walk' GROUP BY ALL)
SELECT CAST(coalesce(o.bases, w.bases) AS INTEGER) AS bases, CAST(coalesce(o.outs, w.outs) AS INTEGER) AS outs, coalesce(o.late, w.late) AS late, coalesce(o.near, w.near) AS near, greatest(coalesce(o.n, 0), coalesce(w.n, 0)) AS opportunities,
coalesce(w.n, 0) AS walks FROM o FULL OUTER JOIN w ON o.bases = w.bases AND o.outs = w.outs AND o.late = w.late AND o.near = w.near""")
def walk_rate_cells(t):
    """Opportunities and walks of each situation; both counts come from one scan and one aggregate."""
    p = t("pitches")
    cell = [F.col("runners_state").cast("int").alias("bases"), F.least("outs", F.lit(2)).cast("int").alias("outs"), (F.col("inning") >= 7).alias("late"), (F.abs("score_diff") <= 1).alias("near")]
    first, walk = F.col("pitch_number") == 1, F.coalesce(F.col("events") == "walk", F.lit(False))
    g = p.filter(first | walk).groupBy(*cell).agg(F.count_if(first).alias("o"), F.count_if(walk).alias("walks"))
    return g.select("bases", "outs", "late", "near", F.greatest("o", "walks").alias("opportunities"), "walks")


@query("""SELECT rule, from_base, count(*) AS n, count(*) FILTER (WHERE out) AS n_out FROM (
SELECT 'first_to_third' AS rule, 1 AS from_base, events IN ('force_out') AS out FROM pitches WHERE events IS NOT NULL AND runners_state & 1 = 1
UNION ALL SELECT 'second_to_home', 2, events IN ('field_out', 'force_out') FROM pitches WHERE events IS NOT NULL AND (runners_state >> 1) & 1 = 1
UNION ALL SELECT 'third_holds', 3, events IN ('strikeout', 'field_out') FROM pitches WHERE events IS NOT NULL AND (runners_state >> 2) & 1 = 1 AND outs < 2) GROUP BY 1, 2""")
def advancement_multi_rule(t):
    one, two, three = C.bases(F.col("runners_state"))
    e = F.col("events")
    rules = {
        "first_to_third": (one, {"from_base": F.lit(1), "out": e == "force_out"}),
        "second_to_home": (two, {"from_base": F.lit(2), "out": e.isin("field_out", "force_out")}),
        "third_holds": (three & (F.col("outs") < 2), {"from_base": F.lit(3), "out": e.isin("strikeout", "field_out")}),
    }
    return R.rules_union(t("pitches").filter("events is not null"), [], rules).groupBy("rule", "from_base").agg(F.count(F.lit(1)).alias("n"), F.count_if("out").alias("n_out"))


@query("""WITH a AS (SELECT game_pk, pitcher_id, min(at_bat_number) AS first_ab, max(at_bat_number) AS last_ab, count(*) AS n FROM pitches GROUP BY 1, 2)
SELECT game_pk, pitcher_id, CAST(row_number() OVER w AS INTEGER) AS arm, CAST(first_ab AS INTEGER) AS first_ab, CAST(sum(n) OVER w - n AS BIGINT) AS thrown_before FROM a WINDOW w AS (PARTITION BY game_pk ORDER BY first_ab, pitcher_id)""")
def pitching_change_boundaries(t):
    a = t("pitches").groupBy("game_pk", "pitcher_id").agg(F.min("at_bat_number").cast("int").alias("first_ab"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("game_pk").orderBy("first_ab", "pitcher_id")
    return a.select("game_pk", "pitcher_id", F.row_number().over(w).alias("arm"), "first_ab", (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("thrown_before"))


@query(f"""WITH b AS ({BATTERS_SQL}) SELECT season, metric, count(value) AS n, round(avg(value), 10) AS mean FROM (SELECT season, unnest(['k_rate', 'walk_rate', 'whiff_rate', 'contact_rate', 'avg_exit_velo']) AS metric, unnest([k_rate, walk_rate, whiff_rate, contact_rate, avg_exit_velo]) AS value FROM b) GROUP BY 1, 2""")
def league_averages(t):
    """Means of all metrics by season, unpivoted."""
    long = batters(t).select("season", F.explode(F.array(*[F.struct(F.lit(r).alias("metric"), F.col(r).alias("value")) for r in RATES])).alias("x"))
    return long.groupBy("season", F.col("x.metric").alias("metric")).agg(F.count("x.value").alias("n"), F.round(F.avg("x.value"), 10).alias("mean"))


@query(f"""WITH b AS ({BATTERS_SQL}), l AS (SELECT season, avg(k_rate) AS league FROM b GROUP BY 1)
SELECT batter_id, season, round(CASE WHEN k_rate IS NULL OR sample_pa IS NULL THEN league ELSE sample_pa / (sample_pa + 60.0) * k_rate + (1 - sample_pa / (sample_pa + 60.0)) * league END, 6) AS k_shrunk FROM b JOIN l USING (season)""")
def eb_shrinkage(t):
    b = batters(t)
    league = b.groupBy("season").agg(F.avg("k_rate").alias("league"))
    return b.join(league, "season").select("batter_id", "season", F.round(C.shrink(F.col("k_rate"), F.col("sample_pa"), F.col("league"), 60.0), 6).alias("k_shrunk"))


@query("""WITH s AS (SELECT season, max(game_date) AS d, count(*) AS n FROM pitches GROUP BY 1), r AS (SELECT season, CASE WHEN season = 2020 THEN NULL ELSE d - INTERVAL (CASE WHEN season = 2021 THEN 5 ELSE 0 END) DAY END AS w, CASE WHEN season = 2022 THEN n - 1 ELSE n END AS n, CASE WHEN season = 2023 THEN 'v1' ELSE 'v2' END AS v FROM s WHERE season <> 2019)
SELECT s.season, CAST(s.d AS VARCHAR) AS max_date, s.n, r.season IS NULL OR r.w IS NULL OR s.d > r.w OR s.n IS DISTINCT FROM r.n OR r.v IS DISTINCT FROM 'v2' AS stale FROM s LEFT JOIN r USING (season)""")
def incremental_gate(t):
    """Seasons to rebuild: one was never recorded, one lacks a watermark, one has newer data, one another count, one another builder."""
    p = t("pitches")
    s = F.col("season")
    recorded = p.filter(s != 2019).groupBy("season").agg(F.max("game_date").alias("d"), F.count(F.lit(1)).alias("n")).select(
        "season", F.when(s != 2020, F.date_sub("d", F.when(s == 2021, 5).otherwise(0))).alias("watermark"), (F.col("n") - F.when(s == 2022, 1).otherwise(0)).alias("row_count"), F.when(s == 2023, "v1").otherwise("v2").alias("builder_version"))
    return R.stale_partitions(p, recorded, "season", "game_date", "v2").withColumn("max_date", F.col("max_date").cast("string"))


# --- similarity


@query(f"""WITH b AS ({BATTERS_SQL}), s AS (SELECT bats, avg(k_rate) AS mk, stddev_pop(k_rate) AS sk, avg(walk_rate) AS mw, stddev_pop(walk_rate) AS sw FROM b GROUP BY 1)
SELECT batter_id, season, round(CASE WHEN k_rate IS NOT NULL THEN CASE WHEN sk > 0 THEN (k_rate - mk) / sk ELSE 0 END END, 5) AS z_k, round(CASE WHEN walk_rate IS NOT NULL THEN CASE WHEN sw > 0 THEN (walk_rate - mw) / sw ELSE 0 END END, 5) AS z_w FROM b JOIN s ON b.bats = s.bats""")
def zscore_features(t):
    z = K.zscores(batters(t).filter("bats is not null").select("batter_id", "season", "bats", "k_rate", "walk_rate"), ["k_rate", "walk_rate"], ["bats"])
    return z.select("batter_id", "season", F.round("k_rate", 5).alias("z_k"), F.round("walk_rate", 5).alias("z_w"))


WEIGHTS = {"k_rate": 2.0, "walk_rate": 1.0, "whiff_rate": 1.0}


def _query_pairs(t):
    """Batters with an id divisible by 50 against all batters of the season; the stated query set is the small side of an equi-join."""
    b = batters(t).select("batter_id", "season", *WEIGHTS)
    q = b.filter("batter_id % 50 = 0").select("season", F.col("batter_id").alias("query_id"), *[F.col(c).alias(f"q_{c}") for c in WEIGHTS])
    return q.join(b, "season").filter("batter_id <> query_id")


RBF_TERM = " + ".join(f"{w} * coalesce(power(q.{f} - b.{f}, 2), 0)" for f, w in {"k_rate": 0.5, "walk_rate": 0.25, "whiff_rate": 0.25}.items())


@query(f"""WITH b AS ({BATTERS_SQL}) SELECT query_id, season, batter_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, season ORDER BY round(score, 9) DESC, batter_id) AS INTEGER) AS rank FROM (
SELECT q.batter_id AS query_id, q.season, b.batter_id, exp(-({RBF_TERM}) / (2 * 0.05 * 0.05)) AS score FROM b q JOIN b USING (season) WHERE q.batter_id % 50 = 0 AND b.batter_id <> q.batter_id)) WHERE rank <= 10""")
def rbf_query_scores(t):
    p = _query_pairs(t)
    score = C.rbf({c: F.col(f"q_{c}") for c in WEIGHTS}, {c: F.col(c) for c in WEIGHTS}, WEIGHTS, 0.05)
    w = Window.partitionBy("query_id", "season").orderBy(F.round("score", 9).desc(), "batter_id")
    return p.withColumn("score", score).withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("query_id", "season", "batter_id", F.round("score", 6).alias("score"), "rank")


MASK = lambda f, w: (f"CASE WHEN q.{f} IS NOT NULL AND b.{f} IS NOT NULL THEN {w} * power(q.{f} - b.{f}, 2) ELSE 0 END", f"CASE WHEN q.{f} IS NOT NULL AND b.{f} IS NOT NULL THEN {w} ELSE 0 END")
MASKED = [MASK(f, w) for f, w in WEIGHTS.items()]


@query(f"""WITH b AS ({BATTERS_SQL}) SELECT query_id, season, count(score) AS n, round(max(score), 6) AS best, round(avg(score), 6) AS mean FROM (SELECT q.batter_id AS query_id, q.season, CASE WHEN {" + ".join(m[1] for m in MASKED)} > 0
THEN exp(-(({" + ".join(m[0] for m in MASKED)}) / ({" + ".join(m[1] for m in MASKED)})) / (2 * 0.05 * 0.05)) END AS score FROM b q JOIN b USING (season) WHERE q.batter_id % 50 = 0 AND b.batter_id <> q.batter_id) GROUP BY 1, 2""")
def rbf_masked(t):
    score = C.masked_rbf({c: F.col(f"q_{c}") for c in WEIGHTS}, {c: F.col(c) for c in WEIGHTS}, WEIGHTS, 0.05)
    return _query_pairs(t).withColumn("score", score).groupBy("query_id", "season").agg(F.count("score").alias("n"), F.round(F.max("score"), 6).alias("best"), F.round(F.avg("score"), 6).alias("mean"))


KNN_SQL = """SELECT q.vec_id AS query, b.vec_id AS neighbour, b.label, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS rank FROM embeddings q, embeddings b WHERE q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id"""


@query(f"SELECT query, neighbour, round(d, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM ({KNN_SQL}) WHERE rank <= 10")
def knn_exact_topk(t):
    e = t("embeddings")
    return K.knn(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10).withColumn("distance", F.round("distance", 5))


@query(f"SELECT query, label, round(count(*) / 10.0, 6) AS share FROM ({KNN_SQL}) WHERE rank <= 10 GROUP BY 1, 2")
def knn_outcome_share(t):
    e = t("embeddings")
    return K.outcome_shares(K.knn(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10, ["label"]), "label").withColumn("share", F.round("share", 6))


@query("""WITH g AS (SELECT pitcher_id AS owner, stand = p_throws AS own, CASE WHEN velo IS NOT NULL THEN exp(-power(velo - 90, 2) / 50) END AS w FROM pitches)
SELECT owner, round(avg(own::INT), 5) AS own_share, round(sum(coalesce(w, 1) * own::INT) / sum(coalesce(w, 1)), 5) AS own_share_weighted, round(power(sum(coalesce(w, 1)), 2) / sum(power(coalesce(w, 1), 2)) / count(*), 5) AS ess_share FROM g GROUP BY 1""")
def concentration_report(t):
    s = t("pitches").select(F.col("pitcher_id").alias("owner"), (F.col("stand") == F.col("p_throws")).alias("own"), F.when(F.col("velo").isNotNull(), F.exp(-F.pow(F.col("velo") - 90, F.lit(2)) / 50)).alias("w"))
    c = K.concentration(s, "owner", "own", "w")
    return c.select("owner", *[F.round(x, 5).alias(x) for x in ("own_share", "own_share_weighted", "ess_share")])


@query(f"""WITH b AS ({BATTERS_SQL}), d AS (SELECT power(q.k_rate - b.k_rate, 2) + power(q.walk_rate - b.walk_rate, 2) AS d2 FROM b q JOIN b USING (season) WHERE q.batter_id % 50 = 0 AND b.batter_id <> q.batter_id)
SELECT round(m, 8) AS median_d2, round(-ln(0.5) / m, 4) AS gamma, round(sqrt(0.5 / (-ln(0.5) / m)), 6) AS sigma FROM (SELECT quantile_cont(d2, 0.5) AS m FROM d WHERE d2 IS NOT NULL)""")
def sigma_calibration(t):
    p = _query_pairs(t).withColumn("d2", F.pow(F.col("q_k_rate") - F.col("k_rate"), F.lit(2)) + F.pow(F.col("q_walk_rate") - F.col("walk_rate"), F.lit(2)))
    fit = K.sigma_for(p, "d2", 0.5)
    return fit.select(F.round("median_d2", 8).alias("median_d2"), F.round("gamma", 4).alias("gamma"), F.round("sigma", 6).alias("sigma"))


@query(f"""WITH b AS ({BATTERS_SQL}), j AS (SELECT a.k_rate AS x1, n.k_rate AS y1, a.walk_rate AS x2, n.walk_rate AS y2 FROM b a JOIN b n ON a.batter_id = n.batter_id AND n.season = a.season + 1),
r AS (SELECT 'k_rate' AS feature, count(*) FILTER (WHERE x1 IS NOT NULL AND y1 IS NOT NULL) AS n_pairs, corr(x1, y1) AS r FROM j UNION ALL SELECT 'walk_rate', count(*) FILTER (WHERE x2 IS NOT NULL AND y2 IS NOT NULL), corr(x2, y2) FROM j)
SELECT feature, n_pairs, round(CASE WHEN n_pairs < 5 OR r IS NULL OR isnan(r) THEN 0.5 ELSE greatest(0.1, least(1.0, r)) END, 5) AS weight FROM r""")
def reliability_weights(t):
    return K.reliability(batters(t), "batter_id", "season", ["k_rate", "walk_rate"]).withColumn("weight", F.round("weight", 5))


@query(f"""WITH b AS ({BATTERS_SQL}), p AS (SELECT batter_id, count(*) AS n, var_pop(k_rate) AS vk, avg(k_rate) AS mk, var_pop(walk_rate) AS vw, avg(walk_rate) AS mw FROM b GROUP BY 1)
SELECT round(CASE WHEN n < 20 THEN 50.0 ELSE greatest(5.0, least(200.0, (a + c) / 2)) END, 5) AS n0, n AS n_rows FROM (SELECT CAST(sum(n) AS BIGINT) AS n, avg(vk) / var_pop(mk) AS a, avg(vw) / var_pop(mw) AS c FROM p)""")
def eb_prior_strength(t):
    return K.prior_strength(batters(t), "batter_id", ["k_rate", "walk_rate"]).withColumn("n0", F.round("n0", 5))


@query()
def w2_season_to_season(t):
    """Mixture distance of every pitcher's arsenal to that of their next season (rows only; tested against brute force)."""
    v = t("pitcher_gmm_components").filter("pitcher_id is not null and season is not null").select("vec_id", "pitcher_id", "season", C.number(F.col("weight")).alias("w"), *[(C.number(F.col(c)) / s).alias(c) for c, s in (("mean_velo", 6.0), ("mean_ivb", 8.0), ("mean_hb", 10.0))]).dropna().distinct().filter("w > 0")
    m = v.groupBy("pitcher_id", "season").agg(F.sort_array(F.collect_list(F.struct("vec_id", "w", F.array("mean_velo", "mean_ivb", "mean_hb").alias("m")))).alias("c"))
    a = m.select("pitcher_id", "season", F.col("c.w").alias("wa"), F.col("c.m").alias("ma"))
    b = m.select("pitcher_id", (F.col("season") - 1).alias("season"), F.col("c.w").alias("wb"), F.col("c.m").alias("mb"))
    pairs = a.join(b, ["pitcher_id", "season"]).withColumn("a", F.col("pitcher_id").cast("long")).withColumn("b", F.col("season").cast("long"))
    return K.mixture_distances(pairs).select(F.col("a").alias("pitcher_id"), F.col("b").alias("season"), F.round("w2", 6).alias("w2"))


@query()
def gmm_arsenals(t):
    """Mixtures of each pitcher-season's pitches with the best BIC (rows only: an iterative fit)."""
    g = K.mixtures(t("pitches"), ["pitcher_id", "season"], ["velo", "ivb", "hb"], "pitch_id")
    return g.select("pitcher_id", "season", "component", F.round("weight", 6).alias("weight"), "n_rows")


# --- weighted draws

U_SQL = "CAST(('0x' || substr(md5('{salt}|' || {key}), 1, 13)) AS BIGINT) / 4503599627370496.0"


@query(f"""WITH pool AS (SELECT p_throws, stand, pitch_id, outcome_type, CASE WHEN 2025 - season <= 1 THEN 2.0 ELSE greatest(0.25, 2.0 * pow(0.75, 2025 - season - 1)) END AS w FROM pitches),
c AS (SELECT *, sum(w) OVER (PARTITION BY p_throws, stand ORDER BY pitch_id) AS cum, sum(w) OVER (PARTITION BY p_throws, stand) AS total FROM pool),
q AS (SELECT pitch_id AS request_id, p_throws, stand, {U_SQL.format(salt="draw", key="pitch_id")} AS u FROM pitches WHERE pitch_number = 1),
r AS (SELECT q.request_id, q.p_throws, q.stand, q.u * t.total AS at FROM q JOIN (SELECT DISTINCT p_throws, stand, total FROM c) t USING (p_throws, stand))
SELECT request_id, c.pitch_id AS drawn_pitch_id, c.outcome_type AS drawn_outcome_type FROM r ASOF JOIN c ON r.p_throws = c.p_throws AND r.stand = c.stand AND r.at < c.cum""")
def weighted_draw_cdf(t):
    p = t("pitches")
    pool = p.withColumn("w", C.recency_weight(F.col("season"), F.lit(2025)))
    asked = p.filter("pitch_number = 1").select(F.col("pitch_id").alias("request_id"), "p_throws", "stand", C.hashed_uniform(F.col("pitch_id"), salt="draw").alias("u"))
    return S.draw(asked, pool, ["p_throws", "stand"], ["pitch_id"], "w", "u", ["pitch_id", "outcome_type"]).select("request_id", "drawn_pitch_id", "drawn_outcome_type")


@query("""WITH pool AS (SELECT * FROM pitches WHERE game_date <= DATE '2024-06-30'), q AS (SELECT DISTINCT runners_state, outs, count_balls, count_strikes, stand FROM pitches),
a AS (SELECT runners_state, outs, count_balls, count_strikes, stand, count(*) AS n FROM pool GROUP BY ALL), b AS (SELECT outs, count_balls, count_strikes, stand, count(*) AS n FROM pool GROUP BY ALL), c AS (SELECT count_balls, count_strikes, count(*) AS n FROM pool GROUP BY ALL)
SELECT q.*, CASE WHEN coalesce(a.n, 0) >= 30 THEN 'cell' WHEN coalesce(b.n, 0) >= 30 THEN 'no_bases' ELSE 'count' END AS level, CAST(CASE WHEN coalesce(a.n, 0) >= 30 THEN a.n WHEN coalesce(b.n, 0) >= 30 THEN b.n ELSE coalesce(c.n, 0) END AS BIGINT) AS n_rows
FROM q LEFT JOIN a USING (runners_state, outs, count_balls, count_strikes, stand) LEFT JOIN b USING (outs, count_balls, count_strikes, stand) LEFT JOIN c USING (count_balls, count_strikes)""")
def widening_ladder(t):
    p = t("pitches")
    keys = ["runners_state", "outs", "count_balls", "count_strikes", "stand"]
    levels = [("cell", keys), ("no_bases", keys[1:]), ("count", ["count_balls", "count_strikes"])]
    return S.widen(p.select(*keys).distinct(), R.as_of(p, "game_date", "2024-06-30"), levels, 30)


@query("""WITH s AS (SELECT pitch_id, p_throws, CASE WHEN velo IS NOT NULL THEN pow(exp(-power(velo - 90, 2) / 50), 0.5) END AS f, CASE WHEN spin_rate IS NOT NULL THEN exp(-power((spin_rate - 2300) / 300, 2) / 2) END AS k FROM pitches)
SELECT pitch_id, round(coalesce(f, avg(f) OVER (PARTITION BY p_throws), 1), 6) AS factor, round(CASE WHEN k IS NULL THEN 1 ELSE k / avg(k) OVER (PARTITION BY p_throws) END, 6) AS kernel FROM s""")
def draw_neutral_power(t):
    """Unscored rows are neutral: the mean of the scored in a power, 1 in a mean-one kernel."""
    score = F.when(F.col("velo").isNotNull(), F.exp(-F.pow(F.col("velo") - 90, F.lit(2)) / 50))
    kernel = F.when(F.col("spin_rate").isNotNull(), F.exp(-F.pow((F.col("spin_rate") - 2300) / 300, F.lit(2)) / 2))
    p = t("pitches").select("pitch_id", "p_throws", score.alias("s"), kernel.alias("k"))
    both = S.mean_one(S.neutral_power(p, "s", 0.5, ["p_throws"], "factor"), "k", ["p_throws"], "kernel")
    return both.select("pitch_id", F.round("factor", 6).alias("factor"), F.round("kernel", 6).alias("kernel"))


def _count_rates(t):
    g = t("pitches").filter("outcome_type is not null").groupBy("count_balls", "count_strikes", "outcome_type").agg(F.count(F.lit(1)).alias("n")).collect()
    rates: dict = {}
    for r in g:  # at most twelve counts by six outcomes
        rates.setdefault((r["count_balls"], r["count_strikes"]), {})[r["outcome_type"]] = r["n"]
    for cell in rates.values():
        total = sum(cell.values())
        cell.update({k: v / total for k, v in cell.items()})
    return rates


@query()
def count_chain(t):
    """How at-bats end by the twelve-state chain of count rates (tested in closed form)."""
    ends = S.count_chain(_count_rates(t))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("ending"), F.lit(round(v, 9)).alias("share")) for k, v in ends.items()])).alias("x")
    return t("region").limit(1).select(rows).select("x.*")


@query()
def simulate_half_innings(t):
    """2,000 simulated half-innings from the pool's event rates: the state machine, one task for many iterations."""
    events = t("pitches").filter("events is not null").groupBy("events").agg(F.count(F.lit(1)).alias("n")).collect()  # a few event codes
    return simulate.half_innings(t("region").sparkSession, {r["events"]: r["n"] for r in events}, 2000)


# --- distributions and evaluation


@query("""WITH a AS (SELECT season, game_pk, at_bat_number, count(*) AS k FROM pitches GROUP BY 1, 2, 3), g AS (SELECT season, k, count(*) AS n FROM a GROUP BY 1, 2)
SELECT season, k, n, round(n / CAST(sum(n) OVER (PARTITION BY season) AS DOUBLE), 6) AS probability, round(CAST(sum(n) OVER (PARTITION BY season ORDER BY k) AS DOUBLE) / sum(n) OVER (PARTITION BY season), 6) AS cdf FROM g""")
def pmf(t):
    a = t("pitches").groupBy("season", *AT_BAT).agg(F.count(F.lit(1)).alias("k"))
    d = E.pmf(a, ["season"], "k")
    return d.select("season", "k", "n", F.round("probability", 6).alias("probability"), F.round("cdf", 6).alias("cdf"))


@query("""WITH d AS (SELECT pitcher_id, game_pk, count(*) FILTER (WHERE events = 'strikeout') AS k FROM pitches GROUP BY 1, 2)
SELECT pitcher_id, count(*) AS n, round(avg((k > 4)::INT), 6) AS p_over, round(avg((k < 4)::INT), 6) AS p_under, round(avg((k = 4)::INT), 6) AS p_push FROM d GROUP BY 1""")
def over_under_push(t):
    d = t("pitches").groupBy("pitcher_id", "game_pk").agg(F.count_if(F.col("events") == "strikeout").alias("k"))
    o = E.over_under_push(F.col("k"), F.lit(4.0))
    return d.groupBy("pitcher_id").agg(F.count(F.lit(1)).alias("n"), *[F.round(c, 6).alias(n) for n, c in o.items()])


@query("""SELECT season, n, round(mean, 6) AS mean, round(mean - coalesce(1.959963984540054 * sd / sqrt(n), 0), 6) AS low, round(mean + coalesce(1.959963984540054 * sd / sqrt(n), 0), 6) AS high, round(greatest(0, p - 1.959963984540054 * sqrt(p * (1 - p) / n)), 6) AS p_low, median
FROM (SELECT season, count(*) AS n, avg(k) AS mean, stddev_samp(k) AS sd, avg((k >= 4)::INT) AS p, quantile_cont(k, 0.5) AS median FROM (SELECT season, game_pk, at_bat_number, count(*) AS k FROM pitches GROUP BY 1, 2, 3) GROUP BY 1)""")
def summary_ci(t):
    a = t("pitches").groupBy("season", *AT_BAT).agg(F.count(F.lit(1)).alias("k"))
    g = a.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.avg("k").alias("mean"), F.stddev_samp("k").alias("sd"), F.avg((F.col("k") >= 4).cast("int")).alias("p"))
    g = g.join(quantiles.exact(a, ["season"], F.col("k"), [0.5]).select("season", F.col("q0").alias("median")), "season")
    low, high = E.mean_interval(F.col("mean"), F.col("sd"), F.col("n"))
    return g.select("season", "n", F.round("mean", 6).alias("mean"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(E.proportion_interval(F.col("p"), F.col("n"))[0], 6).alias("p_low"), "median")


@query("""WITH i AS (SELECT game_pk, inning, count(*) FILTER (WHERE events = 'home_run') AS hr FROM pitches GROUP BY 1, 2)
SELECT game_pk, CAST(coalesce(sum(hr) FILTER (WHERE inning <= 5), 0) AS BIGINT) AS first_five, CAST(sum(hr) AS BIGINT) AS total, CAST(min(inning) FILTER (WHERE hr > 0) AS INTEGER) AS first_inning FROM i GROUP BY 1""")
def segment_totals(t):
    """Segments of a game's innings as an array: positional slices and the first scoring cell."""
    i = t("pitches").groupBy("game_pk", "inning").agg(F.count_if(F.col("events") == "home_run").alias("hr"))
    g = i.groupBy("game_pk").agg(F.sort_array(F.collect_list(F.struct(F.col("inning").cast("int").alias("inning"), "hr"))).alias("grid"))
    add = lambda arr: F.aggregate(arr, F.lit(0).cast("long"), lambda s, x: s + x["hr"])
    return g.select("game_pk", add(F.filter("grid", lambda x: x["inning"] <= 5)).alias("first_five"), add(F.col("grid")).alias("total"), F.try_element_at(F.filter("grid", lambda x: x["hr"] > 0), F.lit(1))["inning"].alias("first_inning"))


P_SQL = "SELECT pitcher_id, season, 0.08 + 0.11 * count_strikes + 0.01 * count_balls AS p, (events = 'strikeout')::INT AS y FROM pitches WHERE events IS NOT NULL"


def _forecasts(t):
    return t("pitches").filter("events is not null").select("pitcher_id", "season", (F.lit(0.08) + F.lit(0.11) * F.col("count_strikes") + F.lit(0.01) * F.col("count_balls")).alias("p"), (F.col("events") == "strikeout").cast("int").alias("y"))


@query(f"SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM ({P_SQL.replace('0.08 +', '0.081 +')}) GROUP BY 1")
def reliability_bins(t):
    f = _forecasts(t).withColumn("p", F.col("p") + F.lit(0.001))
    return E.reliability_bins(f, "p", "y").select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"))


@query(f"""WITH f AS (SELECT p + 0.001 AS p, y FROM ({P_SQL})), b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM f GROUP BY 1)
SELECT (SELECT round(sum(n * abs(mp - my)) / sum(n), 6) FROM b) AS ece, round(avg(2 * power(p - y, 2)), 6) AS brier, round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 6) AS log_loss FROM f""")
def ece_brier_logloss(t):
    f = _forecasts(t).withColumn("p", F.col("p") + F.lit(0.001))
    ece = E.calibration_error(E.reliability_bins(f, "p", "y")).select(F.round("ece", 6).alias("ece"))
    return ece.join(F.broadcast(f.agg(F.round(E.brier(F.col("p"), F.col("y")), 6).alias("brier"), F.round(E.log_loss(F.col("p"), F.col("y")), 6).alias("log_loss"))))


@query(f"""WITH s AS (SELECT season, count(*) AS n, sum(y) AS k FROM ({P_SQL}) GROUP BY 1)
SELECT a.season, a.n AS n_test, CAST(sum(b.n) AS BIGINT) AS n_train, round(sum(b.k) / sum(b.n), 6) AS baseline, round(a.k / a.n, 6) AS actual, round(sum(b.k) / sum(b.n) - a.k / a.n, 6) AS error FROM s a JOIN s b ON b.season < a.season GROUP BY a.season, a.n, a.k""")
def walk_forward_baseline(t):
    w = E.walk_forward(_forecasts(t), "season", "y")
    return w.select("season", "n_test", "n_train", *[F.round(c, 6).alias(c) for c in ("baseline", "actual", "error")])


@query("""WITH g AS (SELECT pitcher_id, sum(velo) AS s, count(velo) AS n FROM pitches WHERE velo IS NOT NULL GROUP BY 1), m AS (SELECT sum(s) / sum(n) AS mean, sum(n) AS n, count(*) AS k FROM g)
SELECT CAST(max(m.n) AS BIGINT) AS n, max(k) AS n_clusters, round(max(mean), 5) AS mean, round(CASE WHEN max(k) > 1 THEN sqrt(sum(power(g.s - g.n * mean, 2))) / max(m.n) ELSE 0 END, 5) AS se FROM g, m""")
def clustered_se(t):
    c = E.clustered_se(t("pitches"), "pitcher_id", "velo")
    return c.select("n", "n_clusters", F.round("mean", 5).alias("mean"), F.round("se", 5).alias("se"))


@query()
def cluster_bootstrap(t):
    """Interval of the mean velocity when pitchers are drawn again (rows only: its weights come from the engine's own hash)."""
    return E.cluster_bootstrap(t("pitches"), "pitcher_id", "velo")


@query("""WITH a AS (SELECT round(avg((events = 'strikeout')::INT), 6) AS real FROM pitches WHERE events IS NOT NULL), b AS (SELECT round(sum(w * k) / sum(w), 6) AS pool FROM (
SELECT count_strikes, count(*) AS w, avg((events = 'strikeout')::INT) AS k FROM pitches WHERE events IS NOT NULL GROUP BY 1)) SELECT real, pool, abs(real - pool) <= 0.005 AS ok FROM a, b""")
def label_check(t):
    """Two aggregates of the same rate that must agree."""
    by = t("pitches").filter("events is not null").groupBy("count_strikes").agg(F.count(F.lit(1)).alias("w"), F.count_if(F.col("events") == "strikeout").alias("s"))
    r = by.agg(F.round(F.sum("s") / F.sum("w"), 6).alias("real"), F.round(F.sum(F.col("w") * (F.col("s") / F.col("w"))) / F.sum("w"), 6).alias("pool"))
    return r.withColumn("ok", F.abs(F.col("real") - F.col("pool")) <= 0.005)


# --- live-feed semantics in batch form


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(t):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return t("events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL (k) HOUR, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events, (VALUES (0), (1), (2)) v(k) GROUP BY 1")
def sliding_counts(t):
    return t("events").groupBy(F.window(F.col("ts").cast("timestamp"), "3 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS s FROM events),
k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM k GROUP BY user_id, k""")
def session_counts(t):
    return t("events").groupBy(F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT user_id, event_type, count(*) AS n_seen, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY 1, 2")
def dedup_by_hash(t):
    """Content counts once; seeing it again moves its last sighting."""
    g = t("events").groupBy(C.digest(F.col("user_id"), F.col("event_type")).alias("digest")).agg(F.max("user_id").alias("user_id"), F.max("event_type").alias("event_type"), F.count(F.lit(1)).alias("n_seen"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return g.select("user_id", "event_type", "n_seen", F.date_format("a", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), F.date_format("b", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@query("""WITH s AS (SELECT user_id, min(ts) + INTERVAL 48 HOUR AS start FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT user_id, event_id FROM (SELECT e.user_id, e.event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts DESC, e.event_id DESC) AS rn FROM events e JOIN s USING (user_id) WHERE e.ts <= s.start + INTERVAL 15 MINUTE) WHERE rn = 1""")
def closing_with_grace(t):
    """The latest row of each key that is not later than its start plus 15 minutes."""
    e = t("events").select("user_id", "event_id", "ts", "event_type")
    starts = e.filter("event_type = 'signup'").groupBy("user_id").agg((F.min("ts") + F.expr("interval 48 hours")).alias("start"))
    ok = e.join(starts, "user_id").filter(F.col("ts") <= F.col("start") + F.expr("interval 15 minutes"))
    return ok.groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


@query("""SELECT event_id, user_id FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE event_type = 'purchase' AND before IS DISTINCT FROM 'purchase'""")
def edge_trigger(t):
    """Fires where a state begins, once."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t("events").select("event_id", "user_id", "event_type", F.lag("event_type").over(w).alias("before"))
    return e.filter((F.col("event_type") == "purchase") & ~F.col("before").eqNullSafe(F.lit("purchase"))).select("event_id", "user_id")


@query("""SELECT user_id, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS slot, arg_max(event_id, ROW(ts, event_id)) AS event_id FROM events GROUP BY 1, 2""")
def cadence_gate(t):
    """At most one row of a key in each slot: the last."""
    w = F.window(F.col("ts").cast("timestamp"), "6 hours")
    return t("events").groupBy("user_id", w.alias("w")).agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("slot"), "event_id")
