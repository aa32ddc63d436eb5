import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewheel.operators import history as H

D = lambda m, d: dt.date(2024, m, d)
SCHEMA = "k int, snap date, v int, w string, known int, valid_from string"


def versions(spark, rows):
    out = H.history(spark.createDataFrame(rows, SCHEMA), "k", "snap", "known", ["v", "w"], ["v"])
    return sorted((r.k, str(r.valid_from), str(r.valid_to), r.v, r.w) for r in out.collect())


def test_runs_gaps_and_corrections(spark):
    rows = [
        (1, D(1, 1), 5, "a", 1, "x"), (1, D(1, 15), 5, "a", 1, "x"), (1, D(1, 15), 6, "a", 0, "x"), (1, D(2, 1), None, "a", 9, "x"), (1, D(3, 1), 5, "a", 1, "x"), (1, D(3, 1), 5, "a", 1, "x"), (1, D(4, 1), 5, None, 1, "x"),
        (1, D(5, 1), 5, "a", 1, "x"), (None, D(1, 1), 5, "a", 1, "x"), (2, None, 5, "a", 1, "x"), (3, D(1, 1), None, "a", 1, "x"),
    ]
    assert versions(spark, rows) == [(1, "2024-01-01", "2024-04-01", 5, "a"), (1, "2024-04-01", "2024-05-01", 5, None), (1, "2024-05-01", "9999-12-31", 5, "a")]
    assert versions(spark, []) == []


def test_ties_are_settled_by_value(spark):
    rows = [(1, D(1, 1), 5, "a", 1, ""), (1, D(1, 1), 6, None, 1, "")]
    assert versions(spark, rows) == versions(spark, rows[::-1]) == [(1, "2024-01-01", "9999-12-31", 6, None)]


def test_hash_diff_keeps_columns_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("n", "n"), (None, None), ("a|v1:b", "c"), ("a", "v1:b|c")], "x string, y string")
    assert df.select(H.hash_diff(["x", "y"]).alias("h")).distinct().count() == 6


def test_rates_and_split(spark):
    s = H.counted_snapshots(spark.createDataFrame([(1, D(1, 1), 5, "a", 1, ""), (1, D(2, 1), 6, "a", 1, "")], SCHEMA), "k", "snap", "known", ["v", "w"], ["v"])
    rates = H.change_rates(s, "k", "snap", ["v", "w"])
    assert sorted(tuple(r) for r in rates.collect()) == [("v", 1, 1, 1.0), ("w", 1, 0, 0.0)]
    assert H.split_by_rate(rates, 0.5) == {"fast": ["v"], "slow": ["w"]}
    assert H.split_by_rate(H.change_rates(s.limit(0), "k", "snap", ["v"]), 0.5) == {"fast": [], "slow": ["v"]}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 5), st.integers(5, 6), st.sampled_from(["a", None]), st.integers(0, 3)), max_size=10), st.sampled_from([0.0, 0.4, 2.0]))
def test_split_history_is_history(spark, rows, threshold):
    df = spark.createDataFrame([(k, D(1, 1 + i), v, w, known, "") for k, i, v, w, known in rows], SCHEMA)
    args = ("k", "snap", "known", ["v", "w"], ["v"])
    assert sorted(map(tuple, H.split_history(df, *args, threshold=threshold).collect())) == sorted(map(tuple, H.history(df, *args).select("k", "valid_from", "valid_to").collect()))


def appended(spark, batches):
    make = lambda rows: spark.createDataFrame([(k, D(1, 1 + i), v, known) for k, i, v, known in rows], "k int, snap date, v int, known int")
    args = ("k", "snap", "known", ["v"])
    stored, seen = H.empty_store(make([]), *args)
    for rows in batches:
        new, log = H.append_changes(stored, seen, make(rows), *args)
        stored, seen = stored.unionByName(spark.createDataFrame(new.collect(), new.schema)), seen.unionByName(spark.createDataFrame(log.collect(), log.schema))
    return sorted(map(tuple, H.stored_periods(stored, "k", ["v"]).collect()))


def test_late_snapshot_splits_a_version(spark):
    got = appended(spark, [[(1, 0, 5, 0), (1, 10, 5, 0), (1, 20, 5, 0)], [(1, 5, 6, 0)]])
    assert [(str(a), v) for _, a, _, v in got] == [("2024-01-01", 5), ("2024-01-06", 6), ("2024-01-11", 5)]
    assert appended(spark, [[(1, 0, 5, 0), (1, 5, 6, 0), (1, 10, 5, 0)], [(1, 5, 5, 1)]]) == [(1, D(1, 1), dt.date(9999, 12, 31), 5)]
    assert appended(spark, [[(1, 0, 5, 0)], [(1, 0, 5, 0)], [(1, 0, 6, -1)]]) == [(1, D(1, 1), dt.date(9999, 12, 31), 5)]
    assert appended(spark, [[], [(2, 0, None, 0)], []]) == [(2, D(1, 1), dt.date(9999, 12, 31), None)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 4), st.integers(5, 6), st.integers(0, 2)), max_size=4), min_size=2, max_size=3))
def test_appending_in_any_order_is_a_rebuild(spark, batches):
    """Deliveries of one key, snapshot and moment are settled by hash in the store, so each has one value here."""
    once = {}
    batches = [[(k, i, once.setdefault((k, i, known), v), known) for k, i, v, known in rows] for rows in batches]
    every = spark.createDataFrame([(k, D(1, 1 + i), v, known) for rows in batches for k, i, v, known in rows], "k int, snap date, v int, known int")
    want = sorted((r.k, r.valid_from, r.valid_to, r.v) for r in H.history(every, "k", "snap", "known", ["v"], []).collect())
    assert appended(spark, batches) == want
