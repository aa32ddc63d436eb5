import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.llm import similar as S


@settings(max_examples=20, deadline=None)
@given(st.integers(2, 4), st.integers(1, 3))
def test_hilbert_keys_walk_the_grid(dims, bits):
    """Every cell once, and neighbours on the line are neighbours in space."""
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = S.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(side**dims))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def truth(ids, v, k):
    ids, out = np.array(list(ids)), set()
    for i, x in zip(ids, v):
        d = np.sqrt(((v - x) ** 2).sum(1))
        best = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k] if len(ids) < 200 else [j for j in np.lexsort((ids, d))[: k + 2 + int((d == 0).sum())] if ids[j] != i][:k]
        out |= {(int(i), int(ids[j]), n + 1) for n, j in enumerate(best)}
    return out


def found(spark, rows, k, curves=S.Curves()):
    df = spark.createDataFrame(rows, "vec_id long, x double, y double, neighbour string")
    return {(r.vec_id, r.neighbour, r["rank"]) for r in S.nearest(df, "vec_id", [F.col("x"), F.col("y")], k, curves).collect()}


def test_recall(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(0, 1, (1200, 2)), rng.normal(6, 0.01, (600, 2))])
    rows = [(i, float(x), float(y), "clash") for i, (x, y) in enumerate(v)]
    want = truth(range(len(v)), v, 5)
    got = found(spark, rows, 5, S.Curves(orderings=4, reach=8, block_rows=256))
    assert len(got & want) / len(want) >= 0.97 and len(got) == len(want)


def test_copies_ties_and_gaps(spark):
    nan = float("nan")
    rows = [(i, 1.0, 1.0, None) for i in range(1, 41)] + [(50, 2.0, 1.0, None), (51, 0.0, 1.0, None), (52, 1.0, 2.0, None)] + [(50, 2.0, 1.0, None), (60, None, 1.0, None), (61, nan, 1.0, None), (None, 1.0, 1.0, None), (62, float("inf"), 0.0, None)]
    good = {i: (x, y) for i, x, y, _ in rows if i is not None and x is not None and np.isfinite([x, y]).all()}
    assert found(spark, rows, 3) == truth(list(good), np.array(list(good.values())), 3)
    assert found(spark, rows[:1], 3) == set()
    assert found(spark, [(1, 0.0, 0.0, None), (2, -0.0, 3.0, None)], 3) == {(1, 2, 1), (2, 1, 1)}
    assert found(spark, [], 3) == set()


def scattered(kind):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 1, (1500, 2))
    if kind == "outlier":
        v[7, 0] = 1e9
    elif kind == "far":
        v[7] = 1e140, -1e140
    elif kind == "heavy tails":
        v = rng.standard_cauchy((1500, 2))
    elif kind == "dense third":
        v[:500] = 3 + rng.normal(0, 1e-7, (500, 2))
    elif kind == "few values":
        v = np.round(v * 3) + rng.integers(0, 2, (1500, 2)) * 1e-9
    return v


@pytest.mark.parametrize("kind", ["plain", "outlier", "far", "heavy tails", "dense third", "few values"])
def test_recall_whatever_the_spread(spark, kind):
    """Neither far points, nor tails, nor dense or equal places spoil the recall of the rest."""
    v = scattered(kind)
    want = truth(range(len(v)), v, 5)
    got = found(spark, [(i, float(x), float(y), "clash") for i, (x, y) in enumerate(v)], 5, S.Curves(block_rows=256))
    assert len(got & want) / len(want) >= 0.95 and len(got) == len(want)


def test_hot_vector_in_slices(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 10)
    v = np.concatenate([np.zeros((300, 2)), np.random.default_rng(2).normal(0, 1, (60, 2))])
    assert found(spark, [(i, float(x), float(y), "clash") for i, (x, y) in enumerate(v)], 3) == truth(range(len(v)), v, 3)
