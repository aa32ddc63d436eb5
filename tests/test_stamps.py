"""Readings of stamps, and the search that chooses among them."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.operators import stamps as S

FEEDS = {"us": S.Convention("mdy", "ny"), "eu": S.Convention("dmy", "utc"), "park": S.Convention("mdy", "venue")}
CASES = [
    ("us", "2024-07-04 13:05:06", "2024-07-04 17:05:06.000000"), ("us", "2024-07-04T13:05:06.1234567Z", "2024-07-04 13:05:06.123456"), ("us", "2024-07-04t13:05z", "2024-07-04 13:05:00.000000"),
    ("us", "  2024-07-04 13:05:06,5\n", "2024-07-04 17:05:06.500000"), ("us", "07/04/2024 1:05 PM", "2024-07-04 17:05:00.000000"), ("eu", "04/07/2024 13:05:00", "2024-07-04 13:05:00.000000"), ("eu", "4/7/24 13:05", "2024-07-04 13:05:00.000000"),
    ("us", "Jul 4, 2024, 12:05 AM", "2024-07-04 04:05:00.000000"), ("us", "Jul 4, 2024 1:05 PM PT", "2024-07-04 20:05:00.000000"), ("us", "07/04/2024 1:05 PM EST", "2024-07-04 18:05:00.000000"), ("us", "Thu, 04 Jul 2024 13:05:00 GMT", "2024-07-04 13:05:00.000000"),
    ("us", "2024-07-04T13:05:06-05:00[America/Chicago]", "2024-07-04 18:05:06.000000"), ("us", "2024-07-04 13:05:06[Asia/Tokyo]", "2024-07-04 04:05:06.000000"), ("us", "2024-07-04 13:05:06 +0530", "2024-07-04 07:35:06.000000"),
    ("us", "20240704T130506Z", "2024-07-04 13:05:06.000000"), ("us", "1720098306", "2024-07-04 13:05:06.000000"), ("us", "1720098306123", "2024-07-04 13:05:06.123000"), ("us", "1720098306123456", "2024-07-04 13:05:06.123456"),
    ("us", "2024-11-03 01:30:00", "2024-11-03 05:30:00.000000"), ("us", "2024-03-10 02:30:00", "2024-03-10 07:30:00.000000"), ("park", "2024-07-04 13:05", "2024-07-04 19:05:00.000000"), ("park", "7:05 PM", "2024-07-05 01:05:00.000000"),
    ("us", "2024-02-30 10:00:00", None), ("us", "2024-07-04 24:00:00", None), ("us", "2024-07-04 10:60", None), ("us", "2024-07-04 10:00:60", None), ("us", "2024-07-04", None), ("us", "2024-07", None), ("us", "TBD", None), ("us", "", None), ("us", None, None),
    ("us", "13/04/2024 10:00", None), ("eu", "04/13/2024 10:00", None), ("us", "0:30 PM", None), ("us", "07/04/2024 13:05 PM", None), ("us", "2024-07-04 13:05 XYZ", None), ("us", "2024-07-04 13:05 +25:00", None), ("us", "25:61", None), ("us", "123456789", None),
    ("us", "1969-12-31 23:59:59.999999Z", "1969-12-31 23:59:59.999999"), ("us", "x" * 5000, None),
]


def chosen(spark, rows, conventions, default=S.Convention()):
    df = spark.createDataFrame([(i, f, t, "America/Denver", dt.date(2024, 7, 4), "clash") for i, (f, t) in enumerate(rows)], "i int, feed string, text string, tz string, day date, readings_ string")
    read = S.with_instant_readings(df, "text", "readings", "tz", "day")
    out = S.choose_readings(read, "feed", ["i"], "readings", conventions, default)
    return {r.i: (r.norm, r.read_order) for r in out.select("i", S.utc_text(F.col("read_at")).alias("norm"), "read_order").collect()}


def test_rules(spark):
    got = chosen(spark, [(f, t) for f, t, _ in CASES], FEEDS)
    assert {t: got.get(i, (None,))[0] for i, (_, t, _) in enumerate(CASES)} == {t: w for _, t, w in CASES}


def test_dates(spark):
    texts = ["2024-07-04", "20240704", "07/08/2024", "13/07/2024", "Jul 4, 2024", "2024-07-04T00:00:00", "2024-07-04T25:00:00", "2024-02-30", "TBD", "", None]
    df = S.with_date_readings(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "days")
    got = [[(x.ord, str(x.day)) for x in r.days] for r in df.orderBy("i").collect()]
    assert got == [[("", "2024-07-04")], [("", "2024-07-04")], [("mdy", "2024-07-08"), ("dmy", "2024-08-07")], [("dmy", "2024-07-13")], [("", "2024-07-04")], [("", "2024-07-04")], [], [], [], [], []]


def test_search_finds_the_order_of_a_source(spark):
    days = [dt.date(2024, 5, 1) + dt.timedelta(days=d) for d in range(60)]
    rows = [("a", d.strftime("%d/%m/%Y 10:00")) for d in days] + [("b", d.strftime("%m/%d/%Y 10:00")) for d in days]
    got = chosen(spark, rows, {}, S.Convention(None, "utc"))
    assert {i: o for i, (_, o) in got.items()} == {i: "dmy" if f == "a" else "mdy" for i, (f, _) in enumerate(rows)}
    assert chosen(spark, [], FEEDS) == {}


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 9), st.integers(0, 10_000), st.integers(1, 8))
def test_chunks_chain_to_the_whole(n, seed, cut_at):
    """Solving in pieces costs what the best path costs."""
    rng = np.random.default_rng(seed)
    k = len(S.STATES)
    cost, at = rng.choice([0.0, 1.0, np.inf], (n, k), p=[0.5, 0.2, 0.3]), rng.integers(0, 5, (n, k))
    cost[np.arange(n), rng.integers(0, k, n)] = 0.0

    def total(path):
        return sum(cost[i, s] for i, s in enumerate(path)) + sum(S._steps(at[i], at[i + 1])[path[i], path[i + 1]] for i in range(n - 1))

    whole = S._decode(cost, at, np.zeros(k), np.zeros(k))
    cuts = [0, min(cut_at, n - 1), n]
    pieces = [{"part": j, "source": "s", "matrix": S._transfer(cost[a:b], at[a:b]).ravel().tolist(), "first": at[a].tolist(), "last": at[b - 1].tolist()} for j, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    known = S._chain(pieces)
    path = np.concatenate([S._decode(cost[a:b], at[a:b], *map(np.asarray, known[j, "s"])) for j, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a])
    best = np.full(k, 0.0) + cost[0]
    for i in range(1, n):
        best = (best[:, None] + S._steps(at[i - 1], at[i])).min(0) + cost[i]
    assert total(whole) == pytest.approx(best.min())
    assert total(path) == pytest.approx(best.min())


def test_penalties_decide(monkeypatch):
    """Where a source declares no order, the path through its records tells the ambiguous values; without penalties it does not."""
    days = [dt.date(2024, 5, 1) + dt.timedelta(days=d) for d in range(40)]
    micros = lambda m, d: int(dt.datetime(2024, m, d, tzinfo=dt.timezone.utc).timestamp() * 1e6) if m <= 12 else S.NONE
    at = np.array([[micros(d.day, d.month) if o == "mdy" else micros(d.month, d.day) for o, _ in S.STATES] for d in days])
    cost = S._costs("a", at, {"a": S.Convention(None, "utc", strict=False)}, S.Convention())
    orders = lambda: {S.STATES[s][0] for s in S._decode(cost, at, np.zeros(S.K), np.zeros(S.K))}
    assert orders() == {"dmy"}
    monkeypatch.setattr(S, "SWITCHES", S.SWITCHES * 0)
    monkeypatch.setitem(S.PENALTY, "back", 0.0)
    assert orders() == {"mdy", "dmy"}


def test_soft_conventions_are_checked(spark):
    """A stamp that only reads against its feed's rule is read, and then found to break it; its neighbours keep theirs."""
    rows = [("us", "04/03/2024 10:00"), ("us", "13/04/2024 10:00"), ("us", "04/05/2024 10:00"), (None, "2024-04-05 10:00")]
    soft = {"us": S.Convention("mdy", "utc", strict=False)}
    assert [o for _, o in (v for _, v in sorted(chosen(spark, rows, soft).items()))][:3] == ["mdy", "dmy", "mdy"]
    df = spark.createDataFrame([("us", "mdy", "utc"), ("us", "dmy", "utc"), ("eu", "dmy", "ny"), (None, "dmy", "ny")], "f string, read_order string, read_zone string")
    assert [r[0] for r in df.select(S.as_declared(F.col("f"), soft)).collect()] == [True, False, True, True]


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 200), st.integers(0, 10_000))
def test_chunked_search_is_the_plain_one(n, seed):
    """The path through chunks side by side costs what one plain pass finds, and the matrix is the one of step-by-step folding."""
    rng = np.random.default_rng(seed)
    cost, at = rng.choice([0.0, 1.0, np.inf], (n, S.K), p=[0.4, 0.3, 0.3]), rng.integers(0, 5, (n, S.K))
    cost[np.arange(n), rng.integers(0, S.K, n)] = 0.0
    d = np.full((S.K, S.K), np.inf)
    np.fill_diagonal(d, cost[0])
    for i in range(1, n):
        d = (d[:, :, None] + S._steps(at[i - 1], at[i])[None]).min(1) + cost[i][None]
    assert np.array_equal(S._transfer(cost, at), d)
    path = S._decode(cost, at, np.zeros(S.K), np.zeros(S.K))
    total = sum(cost[i, s] for i, s in enumerate(path)) + sum(S._steps(at[i], at[i + 1])[path[i], path[i + 1]] for i in range(n - 1))
    assert total == pytest.approx(d.min())
