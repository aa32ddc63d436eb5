"""Draws in context, verdicts, change points, matching and transport against plain versions; NULLs, ties and empty tables."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import field as P
from tidewheel.operators import draws as D
from tidewheel.operators import evaluate as E
from tidewheel.operators import games as G
from tidewheel.operators import matching as M
from tidewheel.operators import relational as R
from tidewheel.operators import scoring as K
from tidewheel.operators import simulate


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_race_is_in_proportion(spark):
    """Rows are drawn as often as they weigh; weights that are no numbers are never drawn."""
    nan = float("nan")
    pool = spark.createDataFrame([(i, "c", w) for i, w in enumerate([1.0, 3.0, 0.0, None, nan, -1.0])] + [(9, None, 1.0)], "i int, cell string, w double")
    asked = spark.createDataFrame([(n, "c") for n in range(4000)] + [(5000, None), (5001, "none")], "r int, cell string")
    got = D.race(D.candidates(asked, pool, ["cell"], "r"), "r", "p_i", F.col("p_w"), ["p_i"], "t").groupBy("p_i").count().collect()
    n = {r.p_i: r["count"] for r in got}
    assert set(n) == {0, 1} and sum(n.values()) == 4000 and abs(n[1] / 4000 - 0.75) < 0.03
    assert D.race(D.candidates(asked.limit(0), pool, ["cell"], "r"), "r", "p_i", F.col("p_w"), ["p_i"], "t").count() == 0


def test_normalised(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, None), (2, 0.0)], "r int, f double")
    assert rows(D.normalised(df, ["r"], {"g": F.col("f")}).select("r", "f", "g")) == sorted([(1, 2.0, 2 / 3), (1, 4.0, 4 / 3), (1, None, 1.0), (2, 0.0, 1.0)], key=repr)


def test_inverse_density(spark):
    rng = np.random.default_rng(0)
    x = np.append(rng.normal(0, 1, 60), [8.0])
    df = spark.createDataFrame([(i, "c", float(v)) for i, v in enumerate(x)] + [(100, "c", None), (101, "d", 1.0)], "i int, cell string, x double")
    got = {r.i: r.thin for r in D.inverse_density(df, ["cell"], "i", {"x": 2.0}, 0.5, "thin").collect()}
    dens = np.exp(-2 * (x[:, None] - x[None]) ** 2 / (2 * 0.25 * 2)).mean(1)
    want = 1 / np.maximum(dens, 0.05 * np.median(dens))
    assert [got[i] for i in range(61)] == pytest.approx((want / want.mean()).tolist()) and got[100] == got[101] == 1.0


def test_fence(spark):
    df = spark.createDataFrame([(1, True, 400.0, 380.0), (2, True, 360.0, 380.0), (3, True, 385.0, 380.0), (4, False, 500.0, 380.0), (5, None, 1.0, 1.0), (6, True, None, 380.0), (7, True, 395.0, 380.0)], "i int, air boolean, carry double, fence double")
    assert rows(df.select("i", D.fence_decision(F.col("air"), F.col("carry"), F.col("fence"), 15.0))) == [(1, 0), (2, 1), (3, 2), (4, 1), (5, 3), (6, 3), (7, 0)]
    met = spark.createDataFrame([(1, 0, True), (1, 0, False), (2, 1, True), (2, 1, False), (3, 2, True), (3, 2, None), (4, 0, False), (4, 0, None)], "r int, d int, over boolean")
    assert rows(D.fence_filter(met, "r", "d", "over")) == sorted([(1, 0, True), (2, 1, False), (3, 2, True), (3, 2, None), (4, 0, False), (4, 0, None)], key=repr)


def test_level_draw(spark):
    pool = spark.createDataFrame([(i, "a", i % 2) for i in range(10)] + [(20, "b", 0)], "i int, x string, y int")
    asked = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "z", 0), (4, "z", 7)], "r int, x string, y int")
    got = {r.r: (r.level, r.n_rows, r.drawn_i) for r in D.level_draw(asked, pool, [("both", ["x", "y"]), ("y", ["y"])], 3, "r", "i", F.lit(1.0), ["i"], "t").collect()}
    assert got[1][:2] == ("both", 5) and got[1][2] in (0, 2, 4, 6, 8) and got[2][:2] == ("y", 6) and got[3][0] == "y" and got[4] == ("y", 0, None)


def plain_decisions(plays):
    final = plays[-1][4]
    if final == 0:
        return None
    win = "home" if final > 0 else "away"
    lead = [p[4] if win == "home" else -p[4] for p in plays]
    at = max((i for i, x in enumerate(lead) if x <= 0), default=-1) + 1
    record = lambda own, i: next((p[2] for p in reversed(plays[: i + 1]) if (p[1] == win) == own), None)
    mine = [p for p in plays if p[1] == win]
    order = list(dict.fromkeys(p[2] for p in mine))
    outs = {a: sum(p[3] for p in mine if p[2] == a) for a in order}
    first = next((p[2] for p in plays if p[1] != win), None)
    winner, loser = record(True, at), record(False, at)
    winner = winner if winner is not None else (order[0] if order else None)
    loser = loser if loser is not None else first
    if order and winner == order[0] and outs[winner] < 15:
        best = max(order[1:], key=lambda a: (outs[a], -order.index(a)), default=None)
        winner = best if best is not None and outs[best] > 0 else winner
    finisher = record(True, len(plays) - 1)
    close = any(record(True, i) == finisher and 0 < x <= 3 for i, x in enumerate(lead))
    return winner, loser, finisher if finisher is not None and finisher != winner and close else None


def test_decisions(spark):
    games, data = {}, []
    for g in range(60):
        rng = np.random.default_rng(g)
        diff, plays = 0, []
        for n in range(int(rng.integers(1, 30))):
            side = "home" if (n // 6) % 2 == 0 else "away"
            diff += int(rng.integers(-2, 3)) * int(rng.random() < 0.2)
            plays.append((n, side, int(rng.integers(1, 4)) + (10 if side == "home" else 20), int(rng.integers(0, 4)), diff))
        games[g] = plain_decisions(plays)
        data += [(g, *p) for p in plays]
    df = spark.createDataFrame(data, "game int, play int, side string, arm int, outs int, diff int")
    got = {r.game: (r.winner_id, r.loser_id, r.saver_id) for r in G.decisions(df, "game", "play", "side", "arm", "outs", "diff").collect()}
    assert got == {g: v for g, v in games.items() if v is not None}
    assert G.decisions(df.limit(0), "game", "play", "side", "arm", "outs", "diff").count() == 0


def test_change_points(spark):
    rng = np.random.default_rng(3)
    level = {2018: 100, 2019: 100, 2020: 120, 2021: 120, 2022: 90}
    data = [(v, s, y, float(level[y] if v == 1 and s == 0 else 100) + float(rng.normal(0, 0.5))) for v in (1, 2) for s in (0, 1) for y in level for _ in range(12)] + [(1, None, 2018, 1.0), (3, 0, 2018, None)]
    df = spark.createDataFrame(data, "venue int, sector int, season int, x double")
    got = [tuple(r) for r in G.change_points(df, "venue", "sector", "season", "x", 0.1, 5, 8.0).collect()]
    assert sorted(got) == [(1, 2019, 2020, [0]), (1, 2021, 2022, [0])]
    assert G.change_points(df.limit(0), "venue", "sector", "season", "x", 0.1, 5, 8.0).count() == 0


def test_matching(spark):
    at = lambda h, d=1: dt.datetime(2024, 5, d) + dt.timedelta(hours=h)
    e = spark.createDataFrame([(1, "A", "B", at(18)), (2, "A", "B", at(23.5)), (3, "C", "D", at(10)), (4, "E", "F", at(10)), (5, "A", None, at(10)), (6, "A", "B", None), (7, "G", "H", at(23.9))], "ev int, h string, a string, b timestamp")
    g = spark.createDataFrame([(10, "A", "B", at(17)), (11, "A", "B", at(23)), (12, "C", "D", at(18)), (13, "E", "F", at(15)), (14, "E", "F", at(20)), (15, "G", "H", at(0.5, 2)), (15, "G", "H", at(0.5, 2))], "gm int, h string, a string, s timestamp")
    got = M.nearest_in_time(e, g, ["h", "a"], "ev", "gm", "b", "s")
    assert sorted((r.ev, r.gm, r.rule) for r in got.collect()) == [(1, 10, "near"), (2, 11, "near"), (3, 12, "single"), (7, 15, "near")]
    both = spark.createDataFrame([(1, 10, 60.0, "near"), (2, 10, 30.0, "near")], "ev int, gm int, gap_seconds double, rule string")
    assert [(r.ev, r.gm) for r in M.one_each(both, "ev", "gm").collect()] == [(2, 10)]


def test_exact_transport():
    """No assignment of equal masses is cheaper, and the greedy one is never."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 6))
        cost = rng.random((n, n))
        best = min(cost[np.arange(n), list(p)].mean() for p in itertools.permutations(range(n)))
        assert K.exact_transport(cost, np.ones(n), np.ones(n)) == pytest.approx(best)
        a, b = rng.random(n) + 0.1, rng.random(n + 2) + 0.1
        wide = rng.random((n, n + 2))
        assert K.exact_transport(wide, a, b) <= K.greedy_transport(wide, a.copy(), b.copy()) + 1e-9


def test_mixture_distance_with_covariances(spark):
    one = lambda m, c: ([1.0], [m], [[float(x) for row in c for x in row]])
    a, b = one([0.0, 0.0], np.eye(2)), one([3.0, 4.0], 4 * np.eye(2))
    df = spark.createDataFrame([(1, 2, *a, *b)], "a long, b long, wa array<double>, ma array<array<double>>, ca array<array<double>>, wb array<double>, mb array<array<double>>, cb array<array<double>>")
    assert K.mixture_distances(df, exact=True).collect()[0].w2 == pytest.approx(np.sqrt(25 + 2))


def test_merge_and_symmetry(spark):
    c = spark.createDataFrame([(1, "g", 0.0, 100), (2, "g", 5.0, 100), (3, "g", 1.0, 3), (4, "g", 2.5, 3), (5, "h", 0.0, 3), (6, None, 0.0, 3)], "k int, grp string, x double, n int")
    assert rows(K.merge_small(c, "k", ["grp"], ["x"], "n", 30).select("k", "into_id")) == [(1, 1), (2, 2), (3, 1), (4, 1), (5, 5), (6, 6)]
    s = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.75), (1, 3, 0.1)], "a int, b int, s double")
    assert rows(K.symmetry(s, "a", "b", "s")) == [(1, 2, 0.5, 0.25)]


def test_labels_and_geometry(spark):
    df = spark.createDataFrame([(1, True, True, 3), (2, True, None, 2), (3, True, False, 0), (4, False, True, 3), (5, None, None, None)], "i int, was boolean, scored boolean, after int")
    assert rows(df.select("i", P.destination(F.col("was"), F.col("scored"), F.col("after")))) == [(1, 4), (2, 2), (3, 0), (4, None), (5, None)]
    slots = spark.createDataFrame([(7, 5, 7), (8, 5, 7), (None, 5, None)], "p int, a int, b int")
    assert rows(slots.select("p", P.position_of(F.col("p"), {2: F.col("a"), 3: F.col("b")}))) == sorted([(7, 3), (8, None), (None, None)], key=repr)
    one = spark.createDataFrame([(100.0, 30.0, -10.0, 100.0, None)], "v double, up double, down double, feet double, none double")
    got = one.select(P.hang_time(F.col("v"), F.col("up")), P.ground_time(F.col("v"), F.col("down"), F.col("feet")), P.ground_time(F.col("v"), F.col("down"), F.lit(5000.0)), P.throw_time(F.col("feet"), F.lit(0.0)), P.throw_time(F.col("feet"), F.col("v")), P.hang_time(F.col("none"), F.col("up"))).first()
    rise = 146.7 * np.sin(np.radians(30))
    along = 146.7 * np.cos(np.radians(10))
    assert list(got)[:2] == pytest.approx([(rise + np.sqrt(rise**2 + 2 * 32.174 * -2)) / 32.174 * 0.87, (along - np.sqrt(along**2 - 24 * 100)) / 12]) and got[2] is None and got[3] == 999.0 and got[4] == pytest.approx(100 / 146.7) and got[5] is None
    d = one.select(*[P.direction(F.lit(0), F.lit(0), F.lit(x), F.lit(y)) for x, y in ((0, 5), (0, -5), (6, 1), (-6, 1))], P.distance(F.lit(0), F.lit(0), F.lit(3), F.lit(4)), P.steal_label(F.lit(True), F.lit(False)), P.steal_label(F.lit(None), F.lit(True))).first()
    assert list(d) == ["in", "back", "right", "left", 5.0, "caught", None]


def test_relational_and_evaluation_edges(spark):
    stored = spark.createDataFrame([(1, "x", True), (2, "y", False), (2, "z", None)], "k int, v string, live boolean")
    arriving = spark.createDataFrame([(1, "X", True), (2, "Y", True)], "k int, v string, live boolean")
    assert rows(R.upsert_where(stored, arriving, ["k"], "live")) == sorted([(1, "X", True), (2, "Y", True), (2, "y", False), (2, "z", None)], key=repr)
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 5.0, 0.0), ("b", 6.0, 2.0), (None, 9.0, 9.0), ("b", None, 1.0)], "d string, x double, y double")
    assert rows(E.slope_with_dummies(df, "y", "x", "d")) == [(4, 2.0)]
    assert rows(E.slope_with_dummies(df.limit(0), "y", "x", "d")) == [(0, None)]


def test_machine():
    """Walks alone never end, so they raise; games end with a winner, and home does not bat on when ahead."""
    even = {(b, s): {"ball": 1.0, "called_strike": 1.2, "in_play": 1.0, "foul": 0.5} for b in range(4) for s in range(3)}
    m = simulate.Machine(even, {"single": 1.0, "home_run": 0.3, "field_out": 3.0})
    a = m.play(np.arange(300), 5)
    assert (a["home"] != a["away"]).all() and (a["innings"] >= 9).all() and a["pitches"].min() > 80
    assert m.play(np.array([7, 123]), 5).equals(a.iloc[[7, 123]].reset_index(drop=True))
    extra = a[a["innings"] > 9]
    assert len(extra) and (abs(extra["home"] - extra["away"]) >= 1).all()
    with pytest.raises(ValueError):
        simulate.Machine({(0, 0): {"foul": 1.0}}, {"field_out": 1.0})
    with pytest.raises(ValueError):
        simulate.Machine(even, {"single": 1.0})
