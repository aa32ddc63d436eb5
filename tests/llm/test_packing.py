import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import packing as P


def plain_ffd(sizes, capacity):
    room, bins = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(capacity)
        room[b] -= sizes[i]
        bins[i] = b
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_first_fit_decreasing(sizes):
    bins, offsets = P.first_fit_decreasing(np.array(sizes, np.int64), 20)
    assert bins.tolist() == plain_ffd(sizes, 20)
    for b in set(bins.tolist()):
        spans = sorted((o, o + s) for o, s, x in zip(offsets.tolist(), sizes, bins.tolist()) if x == b)
        assert spans[0][0] == 0 and spans[-1][1] <= 20 and all(p[1] == q[0] for p, q in zip(spans, spans[1:]))


def test_pack(spark):
    rng = np.random.default_rng(1)
    n = rng.integers(0, 150, 500).tolist() + [1000, 2048, 4096, 100, 100, 0]
    out = P.pack(spark.createDataFrame([(i, int(x)) for i, x in enumerate(n)] + [(7, 40)], "doc_id long, n_tokens long"), capacity=100, group_docs=120).toPandas()
    placed = out[out.container.notna()]
    assert (placed.groupby("container").n_tokens.sum() <= 100).all()
    assert (placed.groupby("container").place.apply(sorted).map(lambda p: p == list(range(len(p))))).all()
    total = pd.Series(n).add(pd.Series({7: 40}), fill_value=0)
    assert (out.groupby("doc_id").n_tokens.sum() == total).all()
    pieces = placed.groupby("doc_id").size()
    assert all(pieces[i] == 1 for i, x in enumerate(n) if 0 < x <= 100 and i != 7)
    for _, g in placed[placed.doc_id.isin([500, 501, 502])].groupby("doc_id"):
        g = g.sort_values("doc_offset")
        assert (g.doc_offset.to_numpy()[1:] == np.cumsum(g.n_tokens.to_numpy())[:-1]).all()
    assert out[out.container.isna()].n_tokens.eq(0).all() and (out.container.isna().sum() == (total == 0).sum())


def test_documents(spark):
    rows = [(1, "some words here", "x"), (2, None, "y"), (3, "", "y"), (4, "word " * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string")
    out = P.packed_documents(df, "doc_id", "text").toPandas()
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == {1: 3, 2: 0, 3: 0, 4: 3001}
    assert P.packed_documents(df.limit(0), "doc_id", "text").count() == 0
