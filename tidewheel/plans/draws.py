"""Draws in context, the game machine's tables and results, on pitch data. Requests are a stated set: every pitch whose id is divisible by 50."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel.functions import columns as C
from tidewheel.operators import draws as D
from tidewheel.operators import races
from tidewheel.operators import relational as R
from tidewheel.operators import sampling as S
from tidewheel.operators import scoring as K
from tidewheel.operators import simulate
from tidewheel.plans.catalogue import Catalogue
from tidewheel.session import cut

CATALOGUE = Catalogue()
query, QUERIES, SQL = CATALOGUE.query, CATALOGUE.queries, CATALOGUE.sql
GEOMETRY = {"velo": 2.0, "ivb": 1.0, "hb": 1.0}


def u_sql(salt: str, *keys: str) -> str:
    return f"CAST(('0x' || substr(md5('{salt}|' || {' || chr(124) || '.join(keys)}), 1, 13)) AS BIGINT) / 4503599627370496.0"


def race_sql(salt: str, request: str, row: str, weight: str) -> str:
    return f"-ln(1 - {u_sql(salt, request, row)}) / ({weight})"


RECENCY_SQL = "CASE WHEN 2025 - {t}season <= 1 THEN 2.0::DOUBLE ELSE greatest(0.25::DOUBLE, 2.0::DOUBLE * pow(0.75::DOUBLE, 2025 - {t}season - 1)) END"
ASK_SQL = "SELECT * FROM pitches WHERE pitch_id % 50 = 0"
RAW_SQL = (
    RECENCY_SQL.format(t="p.") + " * CASE WHEN p.pitcher_id = q.pitcher_id THEN 1.0 ELSE 0.3 END * CASE WHEN p.stand = q.stand THEN 1.0 ELSE 0.5 END"
    " * exp(-(power(p.outs - q.outs, 2) + power(bit_count(p.runners_state) - bit_count(q.runners_state), 2)) / 4.0) * exp(-power(p.pitch_number - q.pitch_number, 2) / 18.0)"
)
PITCH_SQL = f"""q AS ({ASK_SQL}), met AS (SELECT q.pitch_id AS request_id, p.pitch_id, p.velo, p.ivb, p.hb, p.outcome_type, p.p_throws, p.count_balls, p.count_strikes, {RAW_SQL} AS raw
  FROM q JOIN pitches p ON p.p_throws = q.p_throws AND p.count_balls = q.count_balls AND p.count_strikes = q.count_strikes AND p.game_date < q.game_date),
drawn AS (SELECT request_id, arg_min(pitch_id, ROW({race_sql('pitch', 'request_id', 'pitch_id', 'raw')}, pitch_id)) AS drawn_pitch_id FROM met GROUP BY 1)"""


def _asked(t):
    return t("pitches").filter("pitch_id % 50 = 0").withColumnRenamed("pitch_id", "request_id")


CELL = ["p_throws", "count_balls", "count_strikes"]
SIDE = ["game_date", "pitcher_id", "stand", "outs", "on", "pitch_number"]


def _sides(t, pool=None):
    """Requests, and the pool with its recency, with what the raw product of weights reads."""
    on = F.bit_count("runners_state").alias("on")
    asked = _asked(t).select("request_id", *CELL, *[on if c == "on" else c for c in SIDE])
    return asked, (t("pitches") if pool is None else pool).select("*", on, C.recency_weight(F.col("season"), F.lit(2025)).alias("recency"))


#: The raw product of weights over rows that are older than the request.
RAW = {"same": {"pitcher_id": 0.3, "stand": 0.5}, "near": {"outs": 1 / 4.0, "on": 1 / 4.0, "pitch_number": 1 / 18.0}, "before": "game_date"}
_raw = races.Product(base=["recency"], **RAW)


@query(f"WITH {PITCH_SQL} SELECT * FROM drawn")
def pitch_draw(t):
    """Hand and count decide who may be drawn; recency, pitcher, side, base-out and fatigue how likely."""
    asked, pool = _sides(t)
    return races.race(asked, pool, CELL, "request_id", "pitch_id", _raw, _raw.asks, _raw.rows, ["pitch_id"], "pitch").withColumnRenamed("pitch_id", "drawn_pitch_id")


def _z(t):
    """Pitches with their geometry in units of its spread by hand."""
    p = t("pitches")
    return K.zscores(p.select("*", *[F.col(f).alias(f"z_{f}") for f in GEOMETRY]), [f"z_{f}" for f in GEOMETRY], ["p_throws"])


Z_SQL = ", ".join(f"CASE WHEN {f} IS NOT NULL THEN CASE WHEN stddev_pop({f}) OVER w > 0 THEN ({f} - avg({f}) OVER w) / stddev_pop({f}) OVER w ELSE 0 END END AS z_{f}" for f in GEOMETRY)
COMPLETE_SQL = " AND ".join(f"{{0}}z_{f} IS NOT NULL" for f in GEOMETRY)
KERNEL_SQL = "exp(-(" + " + ".join(f"{w} * power({{0}}z_{f} - {{1}}z_{f}, 2)" for f, w in GEOMETRY.items()) + f") / {2 * 0.5 * 0.5 * sum(GEOMETRY.values())})"
DENSITY_SQL = f"""z AS (SELECT *, {Z_SQL} FROM pitches WINDOW w AS (PARTITION BY p_throws)), c AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(CELL)} ORDER BY {u_sql('density', 'pitch_id')}, pitch_id) AS n FROM z WHERE {COMPLETE_SQL.format('')}),
d AS (SELECT c.pitch_id, {', '.join('c.' + x for x in CELL)}, avg({KERNEL_SQL.format('c.', 'r.')}) AS d FROM c JOIN c r ON {' AND '.join(f'c.{x} = r.{x}' for x in CELL)} AND r.n <= 64 GROUP BY ALL),
f AS (SELECT *, 0.05 * quantile_cont(d, 0.5) OVER (PARTITION BY {', '.join(CELL)}) AS floor FROM d), i AS (SELECT *, 1 / greatest(d, floor, 1e-30) AS i FROM f),
density AS (SELECT pitch_id, i / avg(i) OVER (PARTITION BY {', '.join(CELL)}) AS thin FROM i)"""


@query(f"WITH {DENSITY_SQL} SELECT p.pitch_id, round(coalesce(thin, 1), 5) AS thin FROM pitches p LEFT JOIN density USING (pitch_id)")
def result_density(t):
    """How thin the pool is around each row of its cell, from a bounded set of reference rows."""
    z = D.inverse_density(_z(t), CELL, "pitch_id", {f"z_{f}": w for f, w in GEOMETRY.items()}, 0.5, "thin", refs=64)
    return z.select("pitch_id", F.round("thin", 5).alias("thin"))


#: Likeness of the rows that may be drawn to the pitch that was; the result's weight: likeness over its mean, raw weight, thinness and the receiver's ratio.
NEAR_DRAWN = races.Gauss(like={(f"d_z_{f}", f"z_{f}"): w / (2 * 0.5 * 0.5 * sum(GEOMETRY.values())) for f, w in GEOMETRY.items()}, before="game_date", name="like")
_result = races.Product(base=["recency", "thinned"], **RAW, like=NEAR_DRAWN.like, over="mean")


@query(f"""WITH {PITCH_SQL}, {DENSITY_SQL}, like_ AS (SELECT m.*, coalesce(density.thin, 1) AS thin, CASE WHEN {COMPLETE_SQL.format('a.')} AND {COMPLETE_SQL.format('b.')} THEN {KERNEL_SQL.format('a.', 'b.')} END AS k
  FROM met m JOIN drawn USING (request_id) JOIN z a ON a.pitch_id = m.pitch_id JOIN z b ON b.pitch_id = drawn.drawn_pitch_id LEFT JOIN density ON density.pitch_id = m.pitch_id),
w AS (SELECT *, CASE WHEN k IS NOT NULL AND avg(k) OVER (PARTITION BY request_id) > 0 THEN k / avg(k) OVER (PARTITION BY request_id) ELSE 1 END * raw * thin * CASE WHEN outcome_type = 'called_strike' THEN 1.1 ELSE 1.0 END AS weight FROM like_)
SELECT request_id, arg_min(pitch_id, ROW({race_sql('result', 'request_id', 'pitch_id', 'weight')}, pitch_id)) AS result_pitch_id, arg_min(outcome_type, ROW({race_sql('result', 'request_id', 'pitch_id', 'weight')}, pitch_id)) AS outcome_type FROM w GROUP BY 1""")
def result_draw(t):
    """The result behind a drawn pitch: the same candidates, by likeness to that pitch, thinness of the pool and the receiver's ratio on strikes."""
    z = cut(D.inverse_density(_z(t), CELL, "pitch_id", {f"z_{f}": w for f, w in GEOMETRY.items()}, 0.5, "thin", refs=64).select("pitch_id", *CELL, "season", "runners_state", *[c for c in SIDE if c != "on"], *[f"z_{f}" for f in GEOMETRY], "thin", "outcome_type"))  # read six times
    asked, pool = _sides(t, z)
    zs = [f"z_{f}" for f in GEOMETRY]
    drawn = races.race(asked, pool, CELL, "request_id", "pitch_id", _raw, _raw.asks, _raw.rows, zs, "pitch").withColumnsRenamed({f: f"d_{f}" for f in zs})
    told = asked.join(cut(drawn), "request_id")
    n = races.means(told, pool, CELL, "request_id", "pitch_id", NEAR_DRAWN, NEAR_DRAWN.asks, NEAR_DRAWN.rows, ["like"])
    told = told.join(n.select("request_id", (F.col("s_like") / F.nullif("n_like", F.lit(0.0))).alias("mean")), "request_id")
    pool = pool.withColumn("thinned", F.col("thin") * F.when(F.col("outcome_type") == "called_strike", 1.1).otherwise(1.0))
    return races.race(told, pool, CELL, "request_id", "pitch_id", _result, _result.asks, _result.rows, ["pitch_id", "outcome_type"], "result").withColumnRenamed("pitch_id", "result_pitch_id")


def _like(q, p):
    """Likeness in velocity, and the same of the rows alone that fit the fence decision."""
    like = np.exp(-((p["velo"] / 5 - q["velo"] / 5) ** 2) / 2)
    fits = (q["decision"] > 1) | ((q["decision"] == 0) == (p["over"] == 1))
    return {"like": like, "fit_like": np.where(fits, like, np.nan), "fit": np.where(fits, 1.0, np.nan)}


def _batted(q, p):
    """Batter times likeness over its mean among the rows that are kept; a missing likeness, or a mean of 0, is exactly neutral."""
    f = _like(q, p)
    with np.errstate(divide="ignore", invalid="ignore"):
        like = np.where(~np.isnan(f["like"]) & (q["mean"] > 0), f["like"] / q["mean"], 1.0)
    return np.where((q["some"] == 0) | (f["fit"] == 1), np.where(p["batter_id"] == q["batter_id"], 1.0, 0.4) * like, 0.0)


FENCE_SQL = "CASE WHEN q.velo IS NULL THEN 3 WHEN q.velo * 4 >= 380 + 15 THEN 0 WHEN q.velo * 4 <= 380 - 15 THEN 1 ELSE 2 END"


@query(f"""WITH q AS (SELECT * FROM pitches WHERE pitch_id % 50 = 0), m AS (SELECT q.pitch_id AS request_id, p.pitch_id, p.events, {FENCE_SQL} AS decision, CASE WHEN p.velo IS NOT NULL AND q.velo IS NOT NULL THEN exp(-power((p.velo - q.velo) / 5, 2) / 2) END AS k,
  CASE WHEN p.batter_id = q.batter_id THEN 1.0 ELSE 0.4 END AS b FROM q JOIN pitches p ON p.runners_state = q.runners_state AND p.outs = q.outs AND p.outcome_type = 'in_play' AND p.events IS NOT NULL),
f AS (SELECT *, CASE decision WHEN 0 THEN events = 'home_run' WHEN 1 THEN events <> 'home_run' ELSE TRUE END AS fits FROM m), g AS (SELECT * FROM (SELECT *, bool_or(fits) OVER (PARTITION BY request_id) AS has_any FROM f) WHERE fits OR NOT has_any),
w AS (SELECT *, b * CASE WHEN k IS NOT NULL AND avg(k) OVER (PARTITION BY request_id) > 0 THEN k / avg(k) OVER (PARTITION BY request_id) ELSE 1 END AS weight FROM g)
SELECT request_id, max(decision) AS decision, arg_min(events, ROW({race_sql('field', 'request_id', 'pitch_id', 'weight')}, pitch_id)) AS event FROM w GROUP BY 1""")
def fielding_draw(t):
    """What becomes of a ball in play: rows of its base-out cell, first sorted by whether it clears the fence, weighed by batter and likeness."""
    pool = t("pitches").filter("outcome_type = 'in_play' and events is not null").select("pitch_id", "runners_state", "outs", "events", "velo", "batter_id")
    asked = _asked(t).select("request_id", "runners_state", "outs", "velo", "batter_id")
    decision = D.fence_decision(F.lit(True), F.col("velo") * 4, F.lit(380.0), 15.0)
    asked, pool, cell = asked.withColumn("decision", decision), pool.withColumn("over", F.col("events") == "home_run"), ["runners_state", "outs"]
    # A request that no row of its cell fits keeps all of them; the mean is that of the rows it keeps.
    n = races.means(asked, pool, cell, "request_id", "pitch_id", _like, ["velo", "decision"], ["velo", "over"], ["fit", "fit_like", "like"])
    some = F.col("n_fit") > 0
    mean = F.when(some, F.col("s_fit_like") / F.nullif("n_fit_like", F.lit(0.0))).otherwise(F.col("s_like") / F.nullif("n_like", F.lit(0.0)))
    told = asked.join(n.select("request_id", some.cast("int").alias("some"), mean.alias("mean")), "request_id")
    return races.race(told, pool, cell, "request_id", "pitch_id", _batted, ["velo", "batter_id", "decision", "some", "mean"], ["velo", "batter_id", "over"], ["events"], "field", keep=["decision"]).withColumnRenamed("events", "event")


STEAL_SQL = """q AS (SELECT * FROM pitches WHERE pitch_id % 50 = 0 AND runners_state & 3 = 1), p AS (SELECT *, outcome_type = 'foul' AS tried FROM pitches WHERE runners_state & 3 = 1)"""


@query(f"""WITH {STEAL_SQL}, m AS (SELECT q.pitch_id AS request_id, p.pitch_id, p.tried, exp(-power(p.score_diff - q.score_diff, 2) / 8) * CASE WHEN p.tried THEN 1.5 ELSE 1.0 END AS w
  FROM q JOIN p ON p.outs = q.outs AND p.count_balls = q.count_balls AND p.count_strikes = q.count_strikes)
SELECT request_id, arg_min(tried, ROW({race_sql('steal', 'request_id', 'pitch_id', 'w')}, pitch_id)) AS tried FROM m GROUP BY 1""")
def steal_draw(t):
    """Whether a runner goes: rows with the same open base, outs and count, by margin; aggression weighs only on rows that were tried."""
    opens = F.col("runners_state").bitwiseAND(3) == 1
    pool = t("pitches").filter(opens).select("pitch_id", "outs", "count_balls", "count_strikes", "score_diff", (F.col("outcome_type") == "foul").alias("tried"))
    asked = _asked(t).filter(opens).select("request_id", "outs", "count_balls", "count_strikes", "score_diff")
    weight = lambda q, p: np.exp(-((p["score_diff"] - q["score_diff"]) ** 2) / 8) * np.where(p["tried"] == 1, 1.5, 1.0)
    return races.race(asked, pool, ["outs", "count_balls", "count_strikes"], "request_id", "pitch_id", weight, ["score_diff"], ["score_diff", "tried"], ["tried"], "steal")


@query(f"""WITH q AS (SELECT * FROM pitches WHERE pitch_id % 50 = 0 AND runners_state > 0), p AS (SELECT *, outcome_type = 'ball' AND pitch_number = 1 AS thrown FROM pitches WHERE runners_state > 0),
m AS (SELECT q.pitch_id AS request_id, p.pitch_id, p.thrown, exp(-power(p.inning - q.inning, 2) / 18) AS w FROM q JOIN p ON p.outs = q.outs AND p.runners_state = q.runners_state AND p.p_throws = q.p_throws)
SELECT request_id, arg_min(thrown, ROW({race_sql('pickoff', 'request_id', 'pitch_id', 'w')}, pitch_id)) AS thrown FROM m GROUP BY 1""")
def pickoff_draw(t):
    """Whether a throw comes before the pitch, from rows with the same runners, outs and hand."""
    on = F.col("runners_state") > 0
    pool = t("pitches").filter(on).select("pitch_id", "outs", "runners_state", "p_throws", "inning", ((F.col("outcome_type") == "ball") & (F.col("pitch_number") == 1)).alias("thrown"))
    asked = _asked(t).filter(on).select("request_id", "outs", "runners_state", "p_throws", "inning")
    near = lambda q, p: np.exp(-((p["inning"] - q["inning"]) ** 2) / 18)
    return races.race(asked, pool, ["outs", "runners_state", "p_throws"], "request_id", "pitch_id", near, ["inning"], ["inning"], ["thrown"], "pickoff")


ADVANCE = ("z_velo", "z_ivb", "z_hb")


@query(f"""WITH z AS (SELECT *, {Z_SQL} FROM pitches WINDOW w AS (PARTITION BY p_throws)),
r AS (SELECT *, 'first_to_third' AS rule, events = 'force_out' AS is_out FROM z WHERE events IS NOT NULL AND runners_state & 1 = 1 UNION ALL SELECT *, 'second_to_home', events IN ('field_out', 'force_out') FROM z WHERE events IS NOT NULL AND (runners_state >> 1) & 1 = 1),
m AS (SELECT q.pitch_id AS request_id, q.rule, p.pitch_id, p.is_out, exp(-({' + '.join(f'power(p.{f} - q.{f}, 2)' for f in ADVANCE)}) / (2 * 1.0 * 3)) AS w FROM r q JOIN r p ON p.rule = q.rule AND p.outs = q.outs WHERE q.pitch_id % 50 = 0)
SELECT CAST(split_part(k, '/', 1) AS BIGINT) AS request_id, split_part(k, '/', 2) AS rule, arg_min(is_out, ROW({race_sql('advance', 'k', 'pitch_id', 'w')}, pitch_id)) AS is_out FROM (SELECT *, request_id || '/' || rule AS k FROM m WHERE w IS NOT NULL AND w > 0) GROUP BY k""")
def advancement_draw(t):
    """One pool for each kind of decision a ball in play opens; a Gaussian over features, its scale times their number."""
    one, two, _ = C.bases(F.col("runners_state"))
    e = F.col("events")
    rules = {"first_to_third": (one, {"is_out": e == "force_out"}), "second_to_home": (two, {"is_out": e.isin("field_out", "force_out")})}
    pool = R.rules_union(_z(t).filter("events is not null"), ["pitch_id", "outs", *ADVANCE], rules)
    asked = pool.filter("pitch_id % 50 = 0").select(F.concat_ws("/", "pitch_id", "rule").alias("k"), F.col("pitch_id").alias("request_id"), "rule", "outs", *ADVANCE)
    alike = lambda q, p: np.exp(-sum((p[f] - q[f]) ** 2 for f in ADVANCE) / (2 * 1.0 * len(ADVANCE)))
    return races.race(asked, pool, ["rule", "outs"], "k", "pitch_id", alike, ADVANCE, ADVANCE, ["is_out"], "advance", keep=["request_id", "rule"]).select("request_id", "rule", "is_out")


TURN_SQL = """a AS (SELECT game_pk, pitcher_id, at_bat_number, min(pitch_id) AS turn_id, count(*) AS n, arg_min(inning, pitch_number) AS inning FROM pitches GROUP BY 1, 2, 3),
b AS (SELECT *, sum(n) OVER w - n AS thrown, row_number() OVER w AS k, lead(1) OVER w IS NULL AS is_last, coalesce(inning <> lag(inning) OVER w, TRUE) AS new_half FROM a WINDOW w AS (PARTITION BY game_pk, pitcher_id ORDER BY at_bat_number)),
turns AS (SELECT turn_id, k, new_half, CAST(least(thrown // 15, 6) AS INTEGER) AS bucket, CAST((k - 1) // 9 + 1 AS INTEGER) AS tto, is_last FROM b)"""


def _turns(t):
    """Every at-bat a pitcher faces: pitches thrown before, times through the order, whether it opens a half-inning and whether it is their last."""
    a = t("pitches").groupBy("game_pk", "pitcher_id", "at_bat_number").agg(F.min("pitch_id").alias("turn_id"), F.count(F.lit(1)).alias("n"), F.min(F.struct("pitch_number", "inning"))["inning"].alias("inning"))
    w = Window.partitionBy("game_pk", "pitcher_id").orderBy("at_bat_number")
    thrown, k = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"), F.row_number().over(w)
    b = a.select("turn_id", F.floor(F.least(F.floor(thrown / 15), F.lit(6))).cast("int").alias("bucket"), (F.floor((k - 1) / 9) + 1).cast("int").alias("tto"), F.lead(F.lit(1)).over(w).isNull().alias("is_last"), F.coalesce(F.col("inning") != F.lag("inning").over(w), F.lit(True)).alias("new_half"))
    return b


@query(f"""WITH {TURN_SQL}, q AS (SELECT * FROM turns WHERE turn_id % 50 = 0), x AS (SELECT new_half, bucket, tto, count(*) AS n FROM turns GROUP BY ALL), y AS (SELECT bucket, tto, count(*) AS n FROM turns GROUP BY ALL), v AS (SELECT tto, count(*) AS n FROM turns GROUP BY ALL),
l AS (SELECT q.turn_id AS request_id, q.new_half, q.bucket, q.tto, CASE WHEN x.n >= 30 THEN 'half' WHEN y.n >= 30 THEN 'bucket' ELSE 'order' END AS level, CASE WHEN x.n >= 30 THEN x.n WHEN y.n >= 30 THEN y.n ELSE v.n END AS n_rows FROM q LEFT JOIN x USING (new_half, bucket, tto) LEFT JOIN y USING (bucket, tto) LEFT JOIN v USING (tto)),
m AS (SELECT l.*, p.turn_id, p.is_last FROM l JOIN turns p ON p.tto = l.tto AND (l.level = 'order' OR p.bucket = l.bucket) AND (l.level <> 'half' OR p.new_half = l.new_half))
SELECT request_id, max(level) AS level, max(n_rows) AS n_rows, arg_min(is_last, ROW({race_sql('change', 'request_id', 'turn_id', '1.0')}, turn_id)) AS drawn_is_last FROM m GROUP BY 1""")
def change_draw(t):
    """Whether a pitcher is taken out: the narrowest of three cells with 30 rows, which is reported, and a row of it."""
    pool = cut(_turns(t))  # read five times
    asked = pool.filter("turn_id % 50 = 0").select(F.col("turn_id").alias("request_id"), "new_half", "bucket", "tto")
    levels = [("half", ["new_half", "bucket", "tto"]), ("bucket", ["bucket", "tto"]), ("order", ["tto"])]
    return D.level_draw(asked, pool, levels, 30, "request_id", "turn_id", F.lit(1.0), ["is_last"], "change")


PEN_SQL = """g AS (SELECT game_pk, max(home_team_id) AS team FROM schedule_games WHERE home_team_id IS NOT NULL GROUP BY 1), d AS (SELECT p.game_pk, max(p.game_date) AS day, max(team) AS team, max(season) AS season, pitcher_id, count(*) AS n, avg(velo) AS velo, max(p_throws) AS hand FROM pitches p JOIN g USING (game_pk) GROUP BY p.game_pk, pitcher_id),
games AS (SELECT game_pk, max(day) AS day, max(team) AS team, max(season) AS season FROM d GROUP BY 1),
c AS (SELECT a.game_pk, d.pitcher_id, date_diff('day', max(d.day), max(a.day)) AS rest, sum(d.n) FILTER (WHERE d.day >= a.day - 3) AS recent, avg(d.velo) AS stuff, max(d.hand) AS hand FROM games a JOIN d ON d.team = a.team AND d.season = a.season AND d.day < a.day AND d.day >= a.day - 60 GROUP BY 1, 2)"""


def _pen(t):
    """For every game, the pitchers seen at the same home team in the 60 days before: rest, recent load, stuff and hand."""
    teams = t("schedule_games").filter("home_team_id is not null").groupBy("game_pk").agg(F.max("home_team_id").alias("team"))
    d = t("pitches").join(teams, "game_pk").groupBy("game_pk", "pitcher_id").agg(F.max("game_date").alias("day"), F.max("team").alias("team"), F.max("season").alias("season"), F.count(F.lit(1)).alias("n"), F.avg("velo").alias("velo"), F.max("p_throws").alias("hand"))
    games = d.groupBy("game_pk").agg(F.max("day").alias("on"), F.max("team").alias("team"), F.max("season").alias("season"))
    past = games.join(d.drop("game_pk"), ["team", "season"]).filter("day < on and day >= date_sub(on, 60)")
    pen = past.groupBy("game_pk", "pitcher_id").agg(F.datediff(F.max("on"), F.max("day")).alias("rest"), F.sum(F.when(F.col("day") >= F.date_sub("on", 3), F.col("n"))).alias("recent"), F.avg("velo").alias("stuff"), F.max("hand").alias("hand"))
    return d, pen


@query(f"""WITH {PEN_SQL}, f AS (SELECT *, exp(stuff / 10.0) AS f_stuff, least(rest, 5) * 1.0 AS f_rest, 1 / (1 + coalesce(recent, 0) / 20.0) AS f_recent, CASE hand WHEN 'L' THEN 0.8 ELSE 1.0 END AS f_hand FROM c),
n AS (SELECT *, coalesce(f_stuff / nullif(avg(f_stuff) OVER w, 0), 1) * coalesce(f_rest / nullif(avg(f_rest) OVER w, 0), 1) * coalesce(f_recent / nullif(avg(f_recent) OVER w, 0), 1) * coalesce(f_hand / nullif(avg(f_hand) OVER w, 0), 1) AS weight FROM f WINDOW w AS (PARTITION BY game_pk))
SELECT game_pk, count(*) AS n_candidates, arg_min(pitcher_id, ROW({race_sql('reliever', 'game_pk', 'pitcher_id', 'weight')}, pitcher_id)) AS pitcher_id FROM n WHERE weight > 0 GROUP BY 1""")
def reliever_draw(t):
    """Who comes in: a weighted choice among the available, each factor scaled to mean 1 among them, a missing fact neutral."""
    _, pen = _pen(t)
    factors = {"stuff_": F.exp(F.col("stuff") / 10.0), "rest_": F.least("rest", F.lit(5)) * 1.0, "recent_": 1 / (1 + F.coalesce("recent", F.lit(0)) / 20.0), "hand_": F.when(F.col("hand") == "L", 0.8).otherwise(1.0)}
    w = D.normalised(pen, ["game_pk"], factors)
    weight = F.col("stuff_") * F.col("rest_") * F.col("recent_") * F.col("hand_")
    n = w.filter(weight > 0).groupBy("game_pk").agg(F.count(F.lit(1)).alias("n_candidates"))
    return D.race(w, "game_pk", "pitcher_id", weight, ["pitcher_id"], "reliever").join(n, "game_pk").select("game_pk", "n_candidates", "pitcher_id")


@query(f"WITH {PEN_SQL}, u AS (SELECT c.game_pk, c.pitcher_id, EXISTS (SELECT 1 FROM d WHERE d.game_pk = c.game_pk AND d.pitcher_id = c.pitcher_id) AS used FROM c) SELECT pitcher_id, count(*) FILTER (WHERE used) AS n_used, count(*) FILTER (WHERE NOT used) AS n_held, round(count(*) FILTER (WHERE used) / count(*), 6) AS usage FROM u GROUP BY 1")
def reliever_usage(t):
    """Used against available but held: an anti-join inside an aggregate, as one outer join with a mark."""
    d, pen = _pen(t)
    u = pen.select("game_pk", "pitcher_id").join(d.select("game_pk", "pitcher_id", F.lit(True).alias("used")), ["game_pk", "pitcher_id"], "left")
    used = F.col("used").isNotNull()
    return u.groupBy("pitcher_id").agg(F.count_if(used).alias("n_used"), F.count_if(~used).alias("n_held"), F.round(F.count_if(used) / F.count(F.lit(1)), 6).alias("usage"))


@query(f"""WITH c AS (SELECT runners_state AS b, least(outs, 2) AS o, count(*) FILTER (WHERE pitch_number = 1) AS n, count(*) FILTER (WHERE events = 'walk') AS k FROM pitches GROUP BY 1, 2), q AS (SELECT pitch_id, runners_state AS b, least(outs, 2) AS o FROM pitches WHERE pitch_number = 1)
SELECT q.pitch_id, round(k / nullif(greatest(n, k), 0), 6) AS rate, {u_sql('walk', 'q.pitch_id')} < k / nullif(greatest(n, k), 0) AS walked FROM q JOIN c USING (b, o)""")
def bernoulli_by_cell(t):
    """A coin with the rate of each situation's cell."""
    cell = [F.col("runners_state").alias("b"), F.least("outs", F.lit(2)).alias("o")]
    rates = t("pitches").groupBy(*cell).agg(F.count_if(F.col("pitch_number") == 1).alias("n"), F.count_if(F.col("events") == "walk").alias("k")).select("b", "o", C.ratio(F.col("k"), F.greatest("n", "k")).alias("rate"))
    q = t("pitches").filter("pitch_number = 1").select("pitch_id", *cell)
    return q.join(rates, ["b", "o"]).select("pitch_id", F.round("rate", 6).alias("rate"), (C.hashed_uniform(F.col("pitch_id"), salt="walk") < F.col("rate")).alias("walked"))


@query("""WITH b AS (SELECT batter_id, season, k_rate FROM (SELECT *, row_number() OVER (PARTITION BY batter_id, season ORDER BY asof_date DESC, updated_at DESC, metric_id DESC) AS rn FROM batter_season_metrics WHERE asof_date IS NOT NULL) WHERE rn = 1),
s AS (SELECT q.batter_id AS actor, q.season, b.batter_id, exp(-power(q.k_rate - b.k_rate, 2) / 0.005) AS score FROM b q JOIN b USING (season) WHERE q.batter_id % 50 = 0 AND q.k_rate IS NOT NULL AND b.k_rate IS NOT NULL),
g AS (SELECT actor, season, p.pitch_id, s.score FROM (SELECT DISTINCT actor, season FROM s) a JOIN pitches p USING (season) LEFT JOIN s USING (actor, season, batter_id))
SELECT actor, season, count(*) AS n, count(score) AS n_scored, round(sum(coalesce(score, m)), 4) AS total FROM (SELECT *, avg(score) OVER (PARTITION BY actor, season) AS m FROM g) GROUP BY 1, 2""")
def matrix_gather(t):
    """An actor's row of the score matrix laid onto all pool rows; unscored rows weigh the mean of the scored. The pool folds to its players first."""
    from tidewheel.plans.modelling import batters

    b = batters(t).select("batter_id", "season", "k_rate").filter("k_rate is not null")
    q = b.filter("batter_id % 50 = 0").select(F.col("batter_id").alias("actor"), "season", F.col("k_rate").alias("q"))
    s = q.join(b, "season").select("actor", "season", "batter_id", F.exp(-F.pow(F.col("q") - F.col("k_rate"), F.lit(2)) / 0.005).alias("score"))
    pool = t("pitches").groupBy("season", "batter_id").agg(F.count(F.lit(1)).alias("n"))
    g = q.select("actor", "season").join(pool, "season").join(s, ["actor", "season", "batter_id"], "left")
    a = g.groupBy("actor", "season").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("score").isNotNull(), F.col("n"))), F.lit(0)).alias("n_scored"), F.sum(F.col("score") * F.col("n")).alias("s"))
    return a.select("actor", "season", "n", "n_scored", F.round(F.col("s") * F.col("n") / F.nullif("n_scored", F.lit(0)), 4).alias("total"))


RE_SQL = """f AS (SELECT game_pk, inning, at_bat_number, arg_min(runners_state, ROW(pitch_number, pitch_id)) AS b, arg_min(outs, ROW(pitch_number, pitch_id)) AS o, max(events) AS e FROM pitches GROUP BY 1, 2, 3),
v AS (SELECT b, o, avg(CASE e WHEN 'single' THEN 1 WHEN 'double' THEN 2 WHEN 'triple' THEN 3 WHEN 'home_run' THEN 4 ELSE 0 END) AS value FROM f WHERE e IS NOT NULL GROUP BY 1, 2)"""


@query(f"""WITH {RE_SQL}, n AS (SELECT *, lead(b) OVER w AS b2, lead(o) OVER w AS o2 FROM f WHERE e IS NOT NULL WINDOW w AS (PARTITION BY game_pk, inning ORDER BY at_bat_number))
SELECT n.e AS event, count(*) AS n, round(avg(coalesce(y.value, 0) - x.value + CASE n.e WHEN 'home_run' THEN 1 + bit_count(n.b) ELSE 0 END), 6) AS run_value FROM n JOIN v x ON x.b = n.b AND x.o = n.o LEFT JOIN v y ON y.b = n.b2 AND y.o = n.o2 GROUP BY 1""")
def run_values(t):
    """Change of expectancy and runs of every event: two look-ups in the 24-state table."""
    f = t("pitches").groupBy("game_pk", "inning", "at_bat_number").agg(F.min(F.struct("pitch_number", "pitch_id", "runners_state", "outs")).alias("f"), F.max("events").alias("e")).filter("e is not null").select("game_pk", "inning", "at_bat_number", F.col("f.runners_state").alias("b"), F.col("f.outs").alias("o"), "e")
    gained = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in C.TOTAL_BASES.items() for x in kv]), F.col("e")), F.lit(0))
    v = f.groupBy("b", "o").agg(F.avg(gained).alias("value"))
    w = Window.partitionBy("game_pk", "inning").orderBy("at_bat_number")
    n = f.select("b", "o", "e", F.lead("b").over(w).alias("b2"), F.lead("o").over(w).alias("o2"))
    n = n.join(v, ["b", "o"]).join(v.select(F.col("b").alias("b2"), F.col("o").alias("o2"), F.col("value").alias("after")), ["b2", "o2"], "left")
    runs = F.when(F.col("e") == "home_run", 1 + F.bit_count("b")).otherwise(0)
    return n.groupBy(F.col("e").alias("event")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("after", F.lit(0.0)) - F.col("value") + runs), 6).alias("run_value"))


@query("""SELECT * FROM (WITH RECURSIVE o AS (SELECT game_pk, at_bat_number, outcome_type AS x, row_number() OVER (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number, pitch_id) AS i FROM pitches),
m AS (SELECT game_pk, at_bat_number, 0 AS i, 0 AS b, 0 AS s, FALSE AS over FROM o WHERE i = 1 UNION ALL SELECT m.game_pk, m.at_bat_number, m.i + 1,
  CASE WHEN m.over THEN b ELSE least(4, b + (x = 'ball')::INT) END, CASE WHEN m.over THEN s ELSE least(3, s + (x IN ('swinging_strike', 'called_strike') OR (x = 'foul' AND s < 2))::INT) END,
  m.over OR x IN ('in_play', 'hit_by_pitch') OR b + (x = 'ball')::INT >= 4 OR s + (x IN ('swinging_strike', 'called_strike') OR (x = 'foul' AND s < 2))::INT >= 3 FROM m JOIN o ON o.game_pk = m.game_pk AND o.at_bat_number = m.at_bat_number AND o.i = m.i + 1)
SELECT game_pk, at_bat_number, arg_max(b, i) AS balls, arg_max(s, i) AS strikes, arg_max(over, i) AS over FROM m GROUP BY 1, 2)""")
def count_machine_fold(t):
    """Count after every at-bat's pitches, folded over their ordered outcomes."""
    a = t("pitches").groupBy("game_pk", "at_bat_number").agg(F.transform(F.sort_array(F.collect_list(F.struct("pitch_number", "pitch_id", "outcome_type"))), lambda x: x["outcome_type"]).alias("o"))
    return a.select("game_pk", "at_bat_number", S.fold_counts(F.col("o")).alias("c")).select("game_pk", "at_bat_number", "c.balls", "c.strikes", "c.over")


@query()
def simulate_games(t):
    """Whole games from the pool: pitches by count, events of balls in play, extra innings and walk-offs; all iterations of a task step at once."""
    p = t("pitches")
    pitch = p.filter("outcome_type is not null").groupBy("count_balls", "count_strikes", "outcome_type").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 12 counts by the outcome codes
    balls = p.filter("outcome_type = 'in_play' and events is not null").groupBy("events").agg(F.count(F.lit(1)).alias("n")).collect()  # a few event codes
    rates: dict = {}
    for r in pitch:
        rates.setdefault((r["count_balls"], r["count_strikes"]), {})[r["outcome_type"]] = r["n"]
    return simulate.games(t("region").sparkSession, rates, {r["events"]: r["n"] for r in balls}, 2000)
