import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import console
from tidewheel.sources import files, sinks
from tidewheel.streaming import live


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_files(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(str(tmp_path / "t"))
    assert rows(files.table(spark, str(tmp_path / "t"), {"a": "bigint", "c": "double"})) == [(1, None)]
    assert rows(files.table(spark, str(tmp_path / "none"), {"a": "int"})) == []
    (tmp_path / "f.csv").write_text("Name,Rate,n,junk\nx,12.5%,\"1,200\",1\ny,--,oops,2\n")
    assert [tuple(r) for r in files.csv_rows(spark, str(tmp_path / "f.csv"), {"name": "string", "rate": "double", "n": "int", "gone": "date"}).orderBy("name").collect()] == [("x", 12.5, 1200, None, []), ("y", None, None, None, ["n"])]
    (tmp_path / "f.json").write_text('{"a": 1}\nnot json\n')
    assert rows(files.json_rows(spark, str(tmp_path / "f.json"), "a int")) == sorted([(1, None), (None, "not json")], key=repr)
    df = spark.createDataFrame([(2020,), (2022,), (2021,), (2022,)], "season int")
    assert rows(files.newest(df, "season", 2)) == [(2021,), (2022,), (2022,)]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "p")
    make = lambda data: spark.createDataFrame(data, "k int, v string, s int")
    sinks.upsert_table(spark, make([(1, "a", 1), (2, "b", 2)]), path, ["k", "s"], "s")
    before = set(os.listdir(f"{path}/s=2"))
    sinks.upsert_table(spark, make([(1, "A", 1), (3, "c", 1)]), path, ["k", "s"], "s")
    assert rows(spark.read.parquet(path).select("k", "v", "s")) == [(1, "A", 1), (2, "b", 2), (3, "c", 1)]
    assert set(os.listdir(f"{path}/s=2")) == before  # an untouched partition is not rewritten
    root = str(tmp_path / "v")
    for i in range(5):
        sinks.publish(make([(i, "x", 0)]), root)
    assert rows(sinks.current(spark, root)) == [(4, "x", 0)]
    assert len([d for d in os.listdir(root) if d.startswith("v")]) == 3


def test_paths_with_a_scheme(spark, tmp_path):
    """A path that names its file system is no other path."""
    make = lambda data: spark.createDataFrame(data, "k int, v string, s int")
    path = f"file://{tmp_path}/p"
    sinks.upsert_table(spark, make([(1, "a", 1), (2, "b", 1)]), path, ["k", "s"], "s")
    sinks.upsert_table(spark, make([(2, "B", 1)]), path, ["k", "s"], "s")
    assert rows(spark.read.parquet(path).select("k", "v")) == [(1, "a"), (2, "B")]
    sinks.publish(make([(1, "x", 0)]), f"file://{tmp_path}/v")
    sinks.publish(make([(2, "y", 0)]), f"file://{tmp_path}/v")
    assert rows(sinks.current(spark, f"file://{tmp_path}/v")) == [(2, "y", 0)]
    assert rows(files.table(spark, f"file://{tmp_path}/none", {"a": "int"})) == []


def test_more_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, None, "x"), (2, None, 2.5, None)], "k int, a double, b double, t string")
    assert rows(sinks.array_columns(sinks.array_rows(df, ["k"], ["a", "b"]), ["k"], ["a", "b"])) == [(1, 1.5, None), (2, None, 2.5)]
    assert rows(sinks.documents(df, "k", ["a", "t"])) == [(1, '{"a":1.5,"t":"x"}'), (2, "{}")]
    assert rows(sinks.create_table(df, "made", str(tmp_path / "db" / "made.parquet"))) == rows(spark.table("made")) == rows(df)
    assert files.attach(spark, str(tmp_path / "db"), "other") == ["other_made"] and spark.table("other_made").count() == 2
    sinks.ordered_export(df, str(tmp_path / "o"), ["k"])
    assert [r.k for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [1, 2]


def test_console(spark):
    spark.range(5).createOrReplaceTempView("five")
    a = console.run(spark, "SELECT id FROM five WHERE 'drop' <> ';' ORDER BY id;", ["five"], cap=3)
    assert ([r.id for r in a.rows], a.truncated) == ([0, 1, 2], True)
    assert console.run(spark, "WITH c AS (SELECT * FROM five) SELECT count(*) AS n FROM c", ["five"]).rows[0].n == 5
    spark.range(3).createOrReplaceTempView("secret")
    with pytest.raises(console.TimedOut):
        console.run(spark, "SELECT count(*) FROM five a, five b, range(100000000) c, range(1000) d WHERE a.id + c.id % 7 = hash(d.id)", ["five"], seconds=1.5)
    assert [r.id for r in console.sort_by(spark.table("five"), "id", ["id"], [], limit=2).collect()] == [4, 3]
    with pytest.raises(console.Refused):
        console.sort_by(spark.table("five"), "rand()", ["id"], [])
    for bad in ("WITH secret AS (SELECT * FROM secret) SELECT * FROM secret", "SELECT * FROM (WITH secret AS (SELECT 1 AS id) SELECT * FROM secret) a JOIN secret USING (id)", "DROP TABLE five", "SELECT 1; SELECT 2", "SELECT * FROM other", "", "SELECT 1 FROM five WHERE (", "INSERT INTO five VALUES (1)", "WITH c AS (SELECT 1) INSERT INTO five SELECT * FROM c", "SELECT java_method('java.lang.System', 'exit', 0)"):
        with pytest.raises(console.Refused):
            print(bad, console.check(spark, bad, ["five"]))


@pytest.fixture
def feed(spark, tmp_path):
    """Events in four files by time."""
    folder = str(tmp_path / "feed")
    data = [(i, f"2024-01-01 {i // 4:02d}:{15 * (i % 4):02d}:00", i % 3, "on" if i % 5 < 2 else "off") for i in range(40)]
    df = spark.createDataFrame(data, "id int, ts string, k int, state string").withColumn("ts", F.to_timestamp_ntz("ts"))
    for j in range(4):
        df.filter((F.col("id") >= 10 * j) & (F.col("id") < 10 * (j + 1))).coalesce(1).write.mode("append").parquet(folder)
    return folder, df


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windows_and_content(spark, feed):
    folder, df = feed
    stream = live.parquet_stream(spark, folder, df.schema, "ts")
    got = drain(spark, live.windowed(stream, "ts", "10 minutes", "1 hour", ["k"], F.count(F.lit(1)).alias("n")), "w", "complete")
    batch = df.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "k").count()
    assert rows(got.select(F.col("window.start").cast("string"), "k", "n")) == rows(batch.select(F.col("window.start").cast("string"), "k", "count"))
    stream = live.parquet_stream(spark, folder, df.schema, "ts")
    once = drain(spark, live.first_of_content(stream, "ts", "30 days", ["k", "state"]), "c")
    assert rows(once.select("k", "state")) == rows(df.select("k", "state").distinct())


def test_edges(spark, feed):
    folder, df = feed
    got = drain(spark, live.edges(live.parquet_stream(spark, folder, df.schema, "ts"), "k", "ts", "state", "on", "id"), "e")
    want, last = [], {}
    for r in df.orderBy("id").collect():
        if r.state == "on" and last.get(r.k) != "on":
            want.append((r.k, r.id))
        last[r.k] = r.state
    assert rows(got) == sorted(want, key=repr)


def test_upsert_sink(spark, feed, tmp_path):
    folder, df = feed
    live.upsert_sink(live.parquet_stream(spark, folder, df.schema, "ts"), str(tmp_path / "out"), ["k"], ["ts", "id"], str(tmp_path / "cp")).awaitTermination(120)
    assert rows(live.latest_batch(spark, str(tmp_path / "out"), "id int, ts timestamp, k int, state string").select("k", "id")) == [(0, 39), (1, 37), (2, 38)]


def test_closing(spark):
    r = spark.createDataFrame([("a", 1, "2024-01-01 10:00:00"), ("a", 2, "2024-01-01 10:14:00"), ("a", 3, "2024-01-01 10:16:00"), ("b", 4, "2024-01-01 09:00:00")], "k string, id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    starts = spark.createDataFrame([("a", "2024-01-01 10:00:00")], "k string, start string").withColumn("start", F.to_timestamp("start"))
    closed = live.closing(r, starts, "k", "ts", "start", "15 minutes", ["ts", "id"])
    assert [(x.k, x.id) for x in closed.collect()] == [("a", 2)]
    stored = spark.createDataFrame([("a", 1, "current"), ("b", 4, "closing")], "k string, id int, line_type string")
    fresh = spark.createDataFrame([("a", 2), ("b", 9)], "k string, id int")
    assert rows(live.promote(stored, fresh, "k")) == [("a", 2, "closing"), ("b", 4, "closing")]


def test_gates_histories_and_channels(spark, feed, tmp_path):
    folder, df = feed
    stream = lambda: live.parquet_stream(spark, folder, df.schema, "ts")
    data = df.orderBy("id").collect()
    want, until = [], {}
    for r in data:
        if r.k not in until or (r.ts - until[r.k]).total_seconds() >= 0:
            want.append((r.k, r.id))
            until[r.k] = r.ts + dt.timedelta(hours=2)
    assert rows(drain(spark, live.single_flight(stream(), "k", "ts", "id", 7200), "flight")) == sorted(want, key=repr)
    got = drain(spark, live.accumulated(stream().withColumn("v", F.col("id").cast("double")), "k", "ts", "id", "v", keep=3), "acc", "update")
    last = {r.k: (r.n, r.total, r.recent) for r in got.orderBy("n").collect()}
    assert last == {k: (len(i), float(sum(i)), i[-3:]) for k in range(3) for i in [[r.id for r in data if r.k == k]]}
    snapshots = spark.createDataFrame([(0, "a"), (1, "b")], "k int, what string")
    assert rows(drain(spark, live.refetched(stream(), snapshots, "k").groupBy("k", "what").count(), "fetch", "complete")) == [(0, "a", 14), (1, "b", 13)]
    live.publish_stream(stream(), "state", str(tmp_path / "pub"), str(tmp_path / "pub-cp")).awaitTermination(120)
    heard = drain(spark, live.subscribe(spark, str(tmp_path / "pub"), "id int, ts timestamp, k int, state string", "state", "on"), "sub")
    assert sorted(r.id for r in heard.collect()) == [r.id for r in data if r.state == "on"]
