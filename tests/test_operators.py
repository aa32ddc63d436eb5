"""Small fixtures for operators beyond what the queries cover: ties, NULLs, empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import columns as C
from tidewheel.operators import evaluate as E
from tidewheel.operators import relational as R
from tidewheel.operators import sampling as S
from tidewheel.operators import scoring as K
from tidewheel.operators import simulate


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upserts(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert rows(R.upsert(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(R.insert_if_absent(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(R.update_from(old, new.withColumn("v", F.lit(None).cast("string")), ["k"], ["v"])) == [(1, "a"), (2, None)]
    assert rows(R.differences(old, new, ["k"])) == [(1, "left"), (2, "changed"), (3, "right")]
    assert rows(R.upsert(old.limit(0), new, ["k"])) == [(2, "B"), (3, "c")]


def test_nearest_row(spark):
    left = spark.createDataFrame([("g", 5), ("g", 1), ("h", 3), (None, 1)], "g string, at int")
    right = spark.createDataFrame([("g", 3, "x"), ("g", 7, "y"), ("k", 1, "z")], "g string, o int, tag string")
    assert rows(R.nearest_row(left, right, ["g"], "at", "o", ["tag"])) == sorted([("g", 5, 3, "x"), ("g", 1, 3, "x"), ("h", 3, None, None), (None, 1, None, None)], key=repr)


def test_leak_is_refused(spark):
    df = spark.createDataFrame([("2024-01-02",)], "d string").withColumn("d", F.to_date("d"))
    assert R.assert_no_leak(R.as_of(df, "d", "2024-01-02"), "d", "2024-01-02").count() == 1
    with pytest.raises(ValueError):
        R.assert_no_leak(df, "d", "2024-01-01")


def test_draw_matches_searchsorted(spark):
    rng = np.random.default_rng(3)
    pool = [(g, i, float(w)) for g in "ab" for i, w in enumerate(rng.random(40))] + [("a", 99, 0.0), ("a", 98, float("nan")), ("c", 1, 0.0), ("b", 97, None)]
    asks = [(n, g, float(u)) for n, (g, u) in enumerate([(g, u) for g in "abc" for u in [0.0, 0.999999, *rng.random(20)]])]
    got = S.draw(spark.createDataFrame(asks, "n int, g string, u double"), spark.createDataFrame(pool, "g string, i int, w double"), ["g"], ["i"], "w", "u", ["i"])
    want = {}
    for n, g, u in asks:
        own = [(i, w) for q, i, w in pool if q == g and w and w > 0]
        cdf = np.cumsum([w for _, w in own])
        want[n] = own[int(np.searchsorted(cdf, u * cdf[-1], "right"))][0] if own else None
    assert {r.n: r.drawn_i for r in got.collect()} == want


def test_widening(spark):
    pool = spark.createDataFrame([(1, 1)] * 3 + [(1, 2)] * 2 + [(2, 1)], "a int, b int")
    asks = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 3)], "a int, b int")
    got = S.widen(asks, pool, [("cell", ["a", "b"]), ("a", ["a"]), ("all", [])], 3)
    assert rows(got) == [(1, 1, "cell", 3), (1, 2, "a", 5), (2, 1, "all", 6), (3, 3, "all", 6)]


def plain_fold(outcomes):
    b = s = 0
    for o in outcomes:
        b, s = b + (o == "ball"), s + (o in ("swinging_strike", "called_strike") or (o == "foul" and s < 2))
        if b == 4 or s == 3 or o in ("in_play", "hit_by_pitch"):
            return b, s, True
    return b, s, False


def test_count_fold(spark):
    rng = np.random.default_rng(1)
    seqs = [list(rng.choice(["ball", "foul", "called_strike", "swinging_strike", "in_play"], n, p=[0.4, 0.3, 0.1, 0.1, 0.1])) for n in range(12) for _ in range(5)]
    df = spark.createDataFrame([(i, [str(x) for x in q]) for i, q in enumerate(seqs)], "i int, o array<string>").select("i", S.fold_counts(F.col("o")).alias("c"))
    assert [tuple(r.c) for r in df.orderBy("i").collect()] == [plain_fold(q) for q in seqs]


def test_count_chain():
    rates = {(b, s): {"ball": 0.5, "called_strike": 0.25, "foul": 0.25} for b in range(4) for s in range(3)}
    ends = S.count_chain(rates)
    assert sum(ends.values()) == pytest.approx(1)
    rng, walks, n = np.random.default_rng(0), 0, 40_000
    for _ in range(n):
        b = s = 0
        while b < 4 and s < 3:
            u = rng.random()
            b, s = b + (u < 0.5), s + (0.5 <= u < 0.75 or (u >= 0.75 and s < 2))
        walks += b == 4
    assert ends["walk"] == pytest.approx(walks / n, abs=0.01)
    with pytest.raises(ValueError):
        S.count_chain({**rates, (0, 2): {"foul": 1.0}})


def test_neutral_and_race(spark):
    df = spark.createDataFrame([(1, 4.0), (2, None), (3, 16.0)], "i int, s double")
    assert rows(S.mean_one(S.neutral_power(df, "s", 0.5, [], "f"), "s", [], "m").select("i", "f", "m")) == [(1, 2.0, 0.4), (2, 3.0, 1.0), (3, 4.0, 1.6)]
    assert df.select(S.race_keys(F.lit(2.0), F.lit(0.5)).alias("k")).first().k == pytest.approx(math.log(2) / 2)
    assert df.select(S.product(F.col("s"), F.lit(2.0)).alias("p")).orderBy("p").first().p == 2.0


def test_knn(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 3, (60, 3)).astype(float)
    table = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)] + [(0, [0.0, 0.0, 0.0])][:0] + [(90, None), (91, [float("nan")] * 3), (None, [0.0] * 3), (92, []), (93, [1.0])], "id long, v array<double>")
    got = K.knn(table, table.filter("id % 7 = 0"), "id", "v", 4)
    want = set()
    for q in range(0, 60, 7):
        best = sorted((float(np.sqrt(((v[q] - x) ** 2).sum())), i) for i, x in enumerate(v) if i != q)[:4]
        want |= {(q, i, k + 1) for k, (_, i) in enumerate(best)}
    assert {(r["query"], r.neighbour, r["rank"]) for r in got.collect()} == want
    assert K.knn(table, table.limit(0), "id", "v", 3).count() == 0


def test_mixture_distance():
    rng = np.random.default_rng(4)
    a, b = np.diag([1.0, 4.0]), np.diag([9.0, 1.0])
    assert K.bures2(np.zeros(2), a, np.array([3.0, 0.0]), b) == pytest.approx(9 + (1 - 3) ** 2 + (2 - 1) ** 2)
    assert K.bures2(np.ones(2), a, np.ones(2), a) == pytest.approx(0, abs=1e-9)
    cost = np.array([[1.0, 5.0], [2.0, 1.5]])
    assert K.greedy_transport(cost, np.array([0.7, 0.3]), np.array([0.5, 0.5])) == pytest.approx(0.5 * 1 + 0.3 * 1.5 + 0.2 * 5)
    x = np.concatenate([rng.normal(0, 1, (200, 2)), rng.normal(8, 1, (100, 2))])
    _, w, m, _ = K.fit_mixture(x, 2)
    assert sorted(w.round(2)) == pytest.approx([1 / 3, 2 / 3], abs=0.02)
    assert sorted(m[:, 0]) == pytest.approx([0, 8], abs=0.3)


def test_mixtures_of_large_groups(spark):
    """Groups above the bound of a task are fitted on all their rows too."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (900, 2)), rng.normal(9, 2, (300, 2))])
    rows = [(g, i, float(a), float(b)) for g in (1, None) for i, (a, b) in enumerate(x)] + [(2, i, float(a), float(b)) for i, (a, b) in enumerate(x[:100])] + [(1, 5000, None, 1.0)]
    df = spark.createDataFrame(rows, "g int, i int, a double, b double")
    whole, parts = ({(r.g, r.component): r for r in K.mixtures(df, ["g"], ["a", "b"], "i", rows_per_group=n).collect()} for n in (5000, 500))
    assert parts.keys() == whole.keys() == {(1, 0), (1, 1), (None, 0), (None, 1), (2, 0)}
    for k, r in parts.items():
        assert r.n_rows == whole[k].n_rows == (100 if k[0] == 2 else 1200)
        assert r.weight == pytest.approx(whole[k].weight, abs=1e-3)
        assert r.means == pytest.approx(whole[k].means, abs=0.02)


def test_state_machine(spark):
    assert simulate.step(0b101, 1, "single") == (0b011, 1, 1)
    assert simulate.step(0b111, 0, "walk") == (7, 0, 1)
    assert simulate.step(0b010, 0, "walk") == (3, 0, 0)
    assert simulate.step(0b011, 2, "home_run") == (0, 2, 3)
    assert simulate.step(0b011, 2, "field_out") == (3, 3, 0)
    rates = {"field_out": 0.7, "single": 0.2, "home_run": 0.1}
    a, b = rows(simulate.half_innings(spark, rates, 50)), rows(simulate.half_innings(spark, rates, 50).repartition(3))
    assert a == b and all(r[2] >= 3 for r in a)
    with pytest.raises(ValueError):
        simulate.half_innings(spark, {"single": 1.0}, 1)


def test_bootstrap_covers(spark):
    rng = np.random.default_rng(5)
    data = [(int(c), float(x)) for c in range(60) for x in rng.normal(rng.normal(10, 1), 0.1, 5)] + [(1, None)]
    r = E.cluster_bootstrap(spark.createDataFrame(data, "c int, x double"), "c", "x", 300).first()
    sd = np.std([np.mean([x for c, x in data if c == k and x is not None]) for k in range(60)], ddof=1) / math.sqrt(60)
    assert r.high - r.low == pytest.approx(2 * 1.96 * sd, rel=0.25) and r.low < r.mean < r.high
    one = E.cluster_bootstrap(spark.createDataFrame([(1, 2.0)], "c int, x double"), "c", "x", 20).first()
    assert (one.low, one.high) == (2.0, 2.0)


def test_chi2_and_map(spark):
    stat, dof, names = E.pooled_chi2([2, 9, 20, 6, 1, 0], [1, 8, 22, 6, 0.5, 0.5], list("012345"))
    assert (dof, names) == (2, ["1", "2", "3+"]) and stat == pytest.approx(4 / 9 + 4 / 22)
    f = E.reliability_map([0.2, 0.6, 0.4, float("nan")], [0.1, 0.5, 0.6, 1.0])
    df = spark.createDataFrame([(0.0,), (0.3,), (0.5,), (0.9,), (None,)], "x double")
    assert [r[0] if r[0] is None else round(r[0], 6) for r in df.select(f(F.col("x"))).collect()] == [0.1, 0.35, 0.6, 0.6, None]
    assert df.select(E.reliability_map([1], [1])(F.col("x"))).first()[0] == 0.0


def test_columns(spark):
    df = spark.createDataFrame([(1, None), (4, 0)], "a int, b int")
    assert rows(df.select(C.ratio(F.col("a"), F.col("b")))) == [(None,), (None,)]
    assert rows(df.select(C.any_of(F.col("b") == 0, F.lit(None)))) == [(False,), (True,)]
    assert rows(df.select(C.mixed_radix((F.col("a"), 5), (F.col("b"), 2)))) == [(8,), (None,)]
    assert df.select(C.hashed_uniform(F.col("a")).alias("u")).filter("u < 0 or u >= 1").count() == 0


@pytest.mark.parametrize("steps", [4, 10_000])
def test_exact_quantiles(spark, monkeypatch, steps):
    """Interpolated quantiles are numpy's, ranked as a whole or by brackets of a coarse sketch, whatever the ties."""
    from tidewheel.operators import quantiles

    monkeypatch.setattr(quantiles, "STEPS", steps)
    rng = np.random.default_rng(0)
    data = {"a": rng.normal(size=300), "b": np.repeat([1.0, 2.0, 2.0], 40), "c": np.array([7.0]), None: rng.integers(0, 9, 200).astype(float)}
    df = spark.createDataFrame([(g, float(x), "clash") for g, v in data.items() for x in v] + [("a", None, ""), ("d", None, ""), ("a", float("nan"), "")], "g string, x double, q0 string")
    qs = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {r.g: [r[f"q{i}"] for i in range(5)] for r in quantiles.exact(df, ["g"], F.col("x"), qs).collect()}
    assert set(got) == set(data)
    for g, v in data.items():
        assert got[g] == pytest.approx(np.quantile(v, qs).tolist())
    assert [tuple(r) for r in quantiles.exact(df.limit(0), [], F.col("x"), [0.5]).collect()] == [(0, None)]


def test_draw_in_many_cells(spark, monkeypatch):
    """Cut into many pieces, a line gives the rows that numpy finds in it."""
    monkeypatch.setattr(S, "STEP", 7)
    rng = np.random.default_rng(1)
    w = rng.random(90) * rng.integers(0, 2, 90) + np.where(np.arange(90) == 40, 30, 0)
    u = np.append(rng.random(120), [0.0, 0.999999])
    pool = spark.createDataFrame([("g", i, float(x)) for i, x in enumerate(w)], "g string, i int, w double")
    asks = spark.createDataFrame([(n, "g", float(x)) for n, x in enumerate(u)] + [(900, None, 0.5), (901, "none", 0.5), (902, "g", None)], "n int, g string, u double")
    got = {r.n: r.drawn_i for r in S.draw(asks, pool, ["g"], ["i"], "w", "u", ["i"]).collect()}
    cum = np.cumsum(w)
    assert got == {**{n: int(np.searchsorted(cum, x * cum[-1], "right")) for n, x in enumerate(u)}, 900: None, 901: None, 902: None}
