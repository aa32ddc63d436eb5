"""Races by blocks against brute force: odd ids, weights that are no numbers, ties, cells cut into many blocks; and no plan lists pairs."""

import hashlib
import math

import numpy as np
import pytest

from tidewheel.operators import digests, races
from tidewheel.plans import draws


def u(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / float(1 << 52)


def weigh(q, p):
    return np.where(p["x"] == 7, np.inf, np.exp(-((p["x"] - q["y"]) ** 2) / 8)) * np.where(p["tag"] == q["tag"], 1.0, 0.4)


def plain(asked, pool, salt):
    out = {}
    for r, cell, y, tag in asked:
        best = None
        for i, c, x, t in pool:
            if r is None or cell is None or cell != c or x is None or y is None or x == 7:
                continue
            w = math.exp(-((x - y) ** 2) / 8) * (1.0 if tag is not None and t == tag else 0.4)
            if w > 0:
                best = min(best or (math.inf, 0), (-math.log(1 - u(salt, r, i)) / w, i))
        if best:
            out[r] = best[1]
    return out


@pytest.mark.parametrize("size", [16, 100_000])
def test_race_by_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(races, "ROWS", size), monkeypatch.setattr(races, "ASKED", max(8, size // 4))
    rng = np.random.default_rng(1)
    x = lambda: None if rng.random() < 0.1 else float(rng.integers(0, 40))
    tag = lambda: [None, "a", "b"][rng.integers(0, 3)]
    pool = [(int(i), [None, "c", "c", "d"][rng.integers(0, 4)], x(), tag()) for i in [*range(-5, 200), 10**18, -(10**18)]] + [(5000, "e", 1e9, "a")]
    asked = [(f"{i}/r" if i % 7 else f"{i}/" + "long" * 12, [None, "c", "d"][rng.integers(0, 3)], x(), tag()) for i in range(60)] + [("e", "e", 1.0, "a"), ("none", "zz", 1.0, "a"), (None, "c", 1.0, "a")]
    df = races.race(spark.createDataFrame(asked, "r string, cell string, y double, tag string"), spark.createDataFrame(pool, "i long, cell string, x double, tag string"), ["cell"], "r", "i", weigh, ["y", "tag"], ["x", "tag"], ["i", "x"], "t", keep=["y"])
    got = df.collect()
    assert {g.r: g.i for g in got} == plain(asked, pool, "t") and len(got) > 20
    kept, own = {a[0]: a[2] for a in asked}, {p[0]: p[2] for p in pool}
    assert all(g.y == kept[g.r] and g.x == own[g.i] for g in got)


def test_tiles_of_one_request(monkeypatch):
    """Pairs that are given up after the first word of their hash cannot win; equal keys fall to the least id."""
    monkeypatch.setattr(digests, "TILE", 64)
    ids, heads = np.arange(90, 1200), [f"t|{r}|".encode() for r in range(8, 14)]
    rng = np.random.default_rng(2)
    w = rng.random(len(ids)) ** 3 * (rng.random(len(ids)) > 0.2)
    texts = np.array([str(i).encode() for i in ids])
    _, at = races.winners({"r": np.zeros(6)}, {"w": w}, np.array(heads), np.array([len(h) for h in heads]), texts, np.array([len(str(i)) for i in ids]), ids, lambda q, p: p["w"])
    assert [ids[k] for k in at] == [min((-math.log(1 - u("t", r, i)) / x, i) for i, x in zip(ids, w) if x > 0)[1] for r in range(8, 14)]
    _, at = races.winners({"r": np.zeros(6)}, {"w": np.full(len(ids), 5e-324)}, np.array(heads), np.array([len(h) for h in heads]), texts, np.array([len(str(i)) for i in ids]), ids, lambda q, p: p["w"])
    assert all(ids[at] == 90)  # all keys are infinite


@pytest.mark.parametrize("name", ["advancement_draw", "pickoff_draw", "change_draw", "pitch_draw", "steal_draw", "fielding_draw", "result_draw"])
def test_no_pairs_are_listed(spark, small, name):
    """The pairs of a cell are sorted or joined as rows nowhere: they went to disk."""
    plan = draws.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def product(q, p):
    """The weight of PRODUCT for one pair; 0 for a pair that does not count."""
    if None in (q["day"], p["day"], p["base"], q["x"], p["x"]) or not p["day"] < q["day"]:
        return 0.0
    w = p["base"] * (1.0 if q["who"] is not None and q["who"] == p["who"] else 0.3) * math.exp(-((p["x"] - q["x"]) ** 2) / 8)
    if None not in (p["z"], q["dz"], q["mean"]) and q["mean"] > 0:
        w *= math.exp(-2 * (p["z"] - q["dz"]) ** 2) / q["mean"]
    return w


PRODUCT = races.Product(base=["base"], same={"who": 0.3}, near={"x": 1 / 8}, before="day", like={("dz", "z"): 2.0}, over="mean")


@pytest.mark.parametrize("longer", [1, 4])
def test_race_in_the_jvm(spark, monkeypatch, longer):
    """NULLs, weights of 0 and far outliers, ids of many lengths (too long for one block of MD5 as well), more rows than a round has, cells in blocks."""
    monkeypatch.setattr(races, "ROWS", 700), monkeypatch.setattr(races, "LONGER", longer), monkeypatch.setattr(races, "TOGETHER", 7)
    rng = np.random.default_rng(3)
    some = lambda f, none=0.1: None if rng.random() < none else f()
    who, day, real = lambda: int(rng.integers(0, 3)), lambda: int(rng.integers(0, 50)), lambda: float(rng.normal())
    ids = [*range(-5, 2600), 10**18, -(10**18)]
    pool = [{"i": i, "cell": some(lambda: "cd"[int(rng.random() < 0.1)], 0.02), "base": some(lambda: float(rng.choice([0.0, 1e-60, 0.5, 1.0, 2.0]))), "who": some(who), "x": some(real) if i != 7 else 1e9, "z": some(real), "day": some(day, 0.05)} for i in ids]
    keys = [f"{k}/r" if k % 7 else f"{k}/" + "long" * 12 for k in range(40)]
    asked = [{"r": r, "cell": some(lambda: "cd"[int(rng.random() < 0.3)], 0.02), "who": some(who), "x": some(real), "dz": some(real), "mean": some(lambda: float(rng.choice([0.0, 0.2, 1e-9]))), "day": some(day)} for r in keys]
    want = {}
    for q in asked:
        keyed = [(-math.log(1 - u("t", q["r"], p["i"])) / w, p["i"]) for p in pool if q["cell"] and q["cell"] == p["cell"] and (w := product(q, p)) > 0]
        if keyed:
            want[q["r"]] = min(keyed)[1]
    ask_df = spark.createDataFrame([tuple(q.values()) for q in asked], "r string, cell string, who long, x double, dz double, mean double, day int")
    pool_df = spark.createDataFrame([tuple(p.values()) for p in pool], "i long, cell string, base double, who long, x double, z double, day int")
    df = races.race(ask_df, pool_df, ["cell"], "r", "i", PRODUCT, PRODUCT.asks, PRODUCT.rows, ["i", "x"], "t", keep=["day"])
    assert "tidewheel_pairs" in df._jdf.queryExecution().analyzed().toString()
    got = df.collect()
    assert {g.r: g.i for g in got} == want and len(want) > 20
    assert all(g.day == next(q["day"] for q in asked if q["r"] == g.r) and g.x == next(p["x"] for p in pool if p["i"] == g.i) for g in got)
    monkeypatch.setattr(races.pairs, "function", lambda spark: None)
    plain = races.race(ask_df, pool_df, ["cell"], "r", "i", PRODUCT, PRODUCT.asks, PRODUCT.rows, ["i", "x"], "t", keep=["day"])
    assert {g.r: g.i for g in plain.collect()} == want


def test_pitch_draw_hashes_in_the_jvm(spark, small):
    """Hashes in arrays took more time than there is."""
    assert "tidewheel_pairs" in draws.QUERIES["pitch_draw"](spark, small)._jdf.queryExecution().analyzed().toString()


def test_means_in_the_jvm(spark, monkeypatch):
    """Sums of likeness by rounds of the JVM are those of plain exponentials: NULLs, requests that no row is before, far rows, blocks."""
    monkeypatch.setattr(races, "ROWS", 700), monkeypatch.setattr(races, "TOGETHER", 7)
    rng = np.random.default_rng(4)
    some = lambda f: None if rng.random() < 0.1 else f()
    pool = [(i, "cd"[i % 9 == 0], some(lambda: float(rng.normal() * 3)), some(lambda: float(rng.normal())) if i != 9 else 1e6, some(lambda: int(rng.integers(0, 50)))) for i in range(4000)]
    asked = [(r, "cdz"[r % 3], some(lambda: float(rng.normal())), some(lambda: float(rng.normal())), some(lambda: int(rng.integers(0, 50)))) for r in range(40)]
    gauss = races.Gauss(like={("a", "x"): 1.0, ("b", "z"): 0.5}, before="day", name="like")
    asks, rows = spark.createDataFrame(asked, "r long, cell string, a double, b double, day int"), spark.createDataFrame(pool, "i long, cell string, x double, z double, day int")
    df = races.means(asks, rows, ["cell"], "r", "i", gauss, gauss.asks, gauss.rows, ["like"], keep=["cell"])
    assert "tidewheel_pairs" in df._jdf.queryExecution().analyzed().toString()
    got = {g.r: (g.cell, g.n_like, g.s_like) for g in df.collect()}
    assert len(got) == len(asked)
    for r, cell, a, b, day in asked:
        like = [math.exp(-((p[2] - a) ** 2) - 0.5 * (p[3] - b) ** 2) for p in pool if p[1] == cell and None not in (a, b, day, *p) and p[4] < day]
        assert got[r][:2] == (cell, len(like)) and math.isclose(got[r][2], math.fsum(like), rel_tol=1e-12)


def test_result_draw_hashes_in_the_jvm(spark, small):
    """Both races and the mean of all pairs."""
    plan = draws.QUERIES["result_draw"](spark, small)._jdf.queryExecution().analyzed().toString()
    assert plan.count("tidewheel_pairs") == 4  # named twice each; the first race is materialised before
