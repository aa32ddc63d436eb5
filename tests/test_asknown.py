import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewheel.operators.asknown import as_known_join

DAY = dt.date(2024, 1, 1)
FACT = st.tuples(st.integers(1, 2) | st.none(), st.integers(0, 90) | st.none(), st.integers(0, 95 * 24) | st.none(), st.integers(1, 50))
EVENT = st.tuples(st.integers(1, 2) | st.none(), st.integers(0, 95) | st.none())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(FACT, max_size=25), st.lists(EVENT, min_size=1, max_size=15))
def test_brute_force(spark, facts, events):
    f = [(p, DAY + dt.timedelta(a) if a is not None else None, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k) if k is not None else None, i) for p, a, k, i in facts]
    e = [(n, p, DAY + dt.timedelta(d) if d is not None else None) for n, (p, d) in enumerate(events)]
    df = as_known_join(spark.createDataFrame(e, "n int, p int, d date"), spark.createDataFrame(f, "p int, asof date, known timestamp_ntz, id long"), ["p"], "d", "asof", "known", "id")
    want = {}
    for n, p, d in e:
        ok = [(a, k, i) for q, a, k, i in f if p is not None and q == p and d is not None and a is not None and k is not None and a < d and k < dt.datetime.combine(d, dt.time())]
        want[n] = max(ok)[2] if ok else None
    assert {r.n: r.id for r in df.collect()} == want
