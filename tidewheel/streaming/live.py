"""Live-feed semantics as Structured Streaming: windows, deduplication, edge triggers, closing values and an upsert sink."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewheel.functions.columns import digest
from tidewheel.operators.relational import top_per, upsert
from tidewheel.session import cut, ship
from tidewheel.sources import storage


def parquet_stream(spark: SparkSession, folder: str, schema, ts: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; `ts` becomes a timestamp with zone, which watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(stream: DataFrame, ts: str, late: str, length: str, keys: Sequence[str], *aggregates: Column, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows; rows later than `late` behind the newest are left out, and closed windows leave the state."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return stream.withWatermark(ts, late).groupBy(w.alias("window"), *keys).agg(*aggregates)


def sessions(stream: DataFrame, ts: str, late: str, gap: str, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(*aggregates)


def first_of_content(stream: DataFrame, ts: str, late: str, content: Sequence[str]) -> DataFrame:
    """Each content once within the watermark, by its digest: the state holds a digest and no rows."""
    return stream.withColumn("digest", digest(*[F.col(c) for c in content])).withWatermark(ts, late).dropDuplicatesWithinWatermark(["digest"])


def edges(stream: DataFrame, key: str, order: str, state: str, begins: str, event_id: str) -> DataFrame:
    """(key, event_id) where `state` turns to `begins`, exactly once for each turn; the state of a key is its last value.

    Rows of one micro-batch are taken in order of (`order`, `event_id`); a batch that is run again gives the same rows, since its state does.
    """
    ship(stream.sparkSession)

    def turn(group: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        last = kept.get[0] if kept.exists else None
        pdf = pd.concat(list(batches)).sort_values([order, event_id])
        before = pdf[state].shift()
        before.iloc[0] = last
        hit = pdf[(pdf[state] == begins) & (before != begins)]
        kept.update((pdf[state].iloc[-1],))
        yield pd.DataFrame({key: [group[0]] * len(hit), event_id: hit[event_id].to_numpy()})

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(turn, f"{key} {kinds[key]}, {event_id} {kinds[event_id]}", "last string", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(stream: DataFrame, path: str, keys: Sequence[str], newest: Sequence[str], checkpoint: str, buckets: int = 64, expire: Column | None = None) -> StreamingQuery:
    """Run the stream to its end into a table that holds the newest row of every key.

    Keys are dealt into `buckets` by hash; a batch reads and rewrites only the buckets that it has rows of, as a new version of each, and then
    names the versions that count in one small file. A repeated batch writes the same versions again. Rows for which `expire` holds leave the
    table whenever their bucket is written.
    """
    columns = stream.columns
    rest = [c for c in columns if c not in keys]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        best = cut(top_per(batch, keys, newest, rest).select(*columns, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("__bucket")))
        touched = [r[0] for r in best.select("__bucket").distinct().collect()]  # at most `buckets`
        state = _versions(spark, path, number)
        old = [f"{path}/batch-{state[str(b)]}/__bucket={b}" for b in touched if str(b) in state]
        both = best.select(*columns)
        if old:
            both = spark.read.schema(both.schema).parquet(*old).unionByName(both)
        kept = top_per(both, keys, newest, rest).select(*columns)
        kept = kept if expire is None else kept.filter(~F.coalesce(expire, F.lit(False)))
        placed = kept.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).repartition("__bucket")
        placed.write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/batch-{number}")
        full = set(storage.folders(spark, f"{path}/batch-{number}"))
        now = {b: n for b, n in state.items() if int(b) not in touched} | {str(b): number for b in touched if f"__bucket={b}" in full}
        storage.write_text(spark, f"{path}/state-{number}.json", json.dumps(now))
        for d in storage.folders(spark, path):  # versions that neither this state nor the one before it names
            n = int(d.rpartition("-")[2])
            if n < number and n not in set(now.values()) | set(state.values()):
                storage.remove(spark, f"{path}/{d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str, number: int) -> dict[str, int]:
    """Which batch wrote the version of each bucket that counts before batch `number`."""
    for n in range(number - 1, -1, -1):
        if storage.exists(spark, f"{path}/state-{n}.json"):
            return json.loads(storage.read_text(spark, f"{path}/state-{n}.json"))
    return {}


def latest_batch(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table that an upsert sink has written so far."""
    last = max((int(d.rpartition("-")[2]) for d in storage.folders(spark, path)), default=-1)
    state = _versions(spark, path, last + 1)
    paths = [f"{path}/batch-{n}/__bucket={b}" for b, n in sorted(state.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def closing(rows: DataFrame, starts: DataFrame, key: str, ts: str, start: str, grace: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key that is not later than its start plus `grace` (an interval text); keys without start have none."""
    ok = rows.join(starts.select(key, start), key).filter(F.col(ts) <= F.col(start) + F.expr(f"interval {grace}"))
    return top_per(ok, [key], order, [c for c in rows.columns if c not in (key, *order)])


def promote(stored: DataFrame, closed: DataFrame, key: str) -> DataFrame:
    """Mark the closing row of each key once: keys that have one keep it."""
    fresh = closed.join(stored.filter("line_type = 'closing'").select(key), key, "left_anti").withColumn("line_type", F.lit("closing"))
    return upsert(stored, fresh.select(*stored.columns), [key])


def single_flight(stream: DataFrame, key: str, ts: str, event_id: str, hold: float) -> DataFrame:
    """(key, event_id) of the signals that are let through: while one of a key is in flight, for `hold` seconds from its time, others of that
    key are dropped. With a short hold this is single flight, with a longer one a cooldown; the state of a key is one number.

    Rows of one micro-batch are taken in order of (`ts`, `event_id`); one older than what was let through last is dropped as well.
    """
    ship(stream.sparkSession)

    def gate(group: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        until = kept.get[0] if kept.exists else None
        pdf = pd.concat(list(batches)).sort_values([ts, event_id])
        out = []
        for at, i in zip(pdf[ts].astype("datetime64[us]").astype("int64").tolist(), pdf[event_id].tolist()):
            if until is None or at >= until:
                out.append(i)
                until = at + int(hold * 1_000_000)
        kept.update((until,))
        yield pd.DataFrame({key: [group[0]] * len(out), event_id: out})

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(gate, f"{key} {kinds[key]}, {event_id} {kinds[event_id]}", "until long", "append", GroupStateTimeout.NoTimeout)


def accumulated(stream: DataFrame, key: str, order: str, event_id: str, value: str, keep: int = 32) -> DataFrame:
    """(key, n, total, recent) as a history builds up: count and sum of all values so far, and the last `keep` event ids, once a micro-batch."""
    ship(stream.sparkSession)

    def add(group: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        n, total, recent = kept.get if kept.exists else (0, 0.0, [])
        pdf = pd.concat(list(batches)).sort_values([order, event_id])
        n, total, recent = n + len(pdf), total + float(pdf[value].sum()), [*recent, *(int(x) for x in pdf[event_id])][-keep:]
        kept.update((n, total, recent))
        yield pd.DataFrame({key: [group[0]], "n": [n], "total": [total], "recent": [recent]})

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(add, f"{key} {kinds[key]}, n long, total double, recent array<long>", "n long, total double, recent array<long>", "update", GroupStateTimeout.NoTimeout)


def refetched(signals: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """What a signal asks for: its key's row of a snapshot table, read anew in every micro-batch; the signal itself carries nothing on."""
    return signals.select(key).join(snapshots, key)


def publish_stream(stream: DataFrame, channel: str, root: str, checkpoint: str) -> StreamingQuery:
    """Run the stream to its end into one folder for each channel, which any number of readers may follow; each row is written once."""
    return stream.writeStream.format("parquet").partitionBy(channel).option("path", root).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribe(spark: SparkSession, root: str, schema, channel: str, name) -> DataFrame:
    """The rows of one channel as a stream, from the first on."""
    return spark.readStream.schema(schema).parquet(root).filter(F.col(channel) == name)
