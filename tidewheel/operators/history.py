"""History of changing attributes: insert-only satellites with lead-based end dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.session import cut

OPEN_END = "9999-12-31"


def hash_diff(columns: Sequence[str]) -> Column:
    """Digest of a satellite's attributes in which NULL differs from every text, and no shifting of values between columns collides."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.md5(F.concat_ws("|", *parts))


def counted_snapshots(df: DataFrame, key: str, snapshot: str, known_at: str, attributes: Sequence[str], required: Sequence[str]) -> DataFrame:
    """One row per (key, snapshot): among rows whose `required` attributes are all present, the one with the latest `known_at`.

    Equal `known_at` values are settled by the largest attribute tuple (NULL smallest), so repeated rows change nothing. Rows without key or
    snapshot are no evidence of any version and are left out. The aggregate combines map-side, so a hot key shrinks to its distinct
    snapshots before the shuffle; its size afterwards is bounded by the calendar, not by the rows delivered.
    """
    kept = df.filter(F.col(key).isNotNull() & F.col(snapshot).isNotNull())
    for c in required:
        kept = kept.filter(F.col(c).isNotNull())
    best = F.max(F.struct(F.col(known_at).alias("__known"), *[F.col(c) for c in attributes])).alias("__best")
    return kept.groupBy(key, snapshot).agg(best).select(key, snapshot, *[F.col(f"__best.{c}").alias(c) for c in attributes])


def change_rates(df: DataFrame, key: str, snapshot: str, attributes: Sequence[str]) -> DataFrame:
    """Per attribute, the share of consecutive snapshots of a key in which it changed: (attribute, n_steps, n_changes, rate).

    `df` has one row per (key, snapshot), as counted_snapshots returns it. The first snapshot of a key is no step. An empty table gives zero
    steps and a NULL rate.
    """
    w = Window.partitionBy(key).orderBy(snapshot)
    marks = df.select(F.lag(F.lit(1)).over(w).alias("__step"), *[(~F.col(c).eqNullSafe(F.lag(c).over(w))).alias(c) for c in attributes])
    sums = marks.filter("__step = 1").agg(F.count(F.lit(1)).alias("n_steps"), *[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in attributes])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).alias("n_changes")) for c in attributes])).alias("r")
    return sums.select("n_steps", rows).select("r.attribute", "n_steps", "r.n_changes", (F.col("r.n_changes") / F.expr("nullif(n_steps, 0)")).alias("rate"))


def split_by_rate(rates: DataFrame, threshold: float) -> dict[str, list[str]]:
    """Attribute groups 'fast' and 'slow' from the one-row-per-attribute table of change_rates (as small as the schema)."""
    groups: dict[str, list[str]] = {"fast": [], "slow": []}
    for row in sorted(rates.collect(), key=lambda r: r["attribute"]):
        groups["fast" if (row["rate"] or 0.0) >= threshold else "slow"].append(row["attribute"])
    return groups


def _versions(df: DataFrame, key: str, at: str) -> DataFrame:
    """Rows whose hash_diff differs from that of the row before them."""
    w = Window.partitionBy(key).orderBy(at)
    return df.withColumn("__prev", F.lag("hash_diff").over(w)).filter(~F.col("__prev").eqNullSafe(F.col("hash_diff"))).drop("__prev")


def satellite(snapshots: DataFrame, key: str, snapshot: str, attributes: Sequence[str]) -> DataFrame:
    """The insert-only satellite of one attribute group: (key, valid_from, hash_diff, attributes), a row only where the hash-diff changes."""
    return _versions(snapshots.select(key, F.col(snapshot).alias("valid_from"), *attributes).withColumn("hash_diff", hash_diff(attributes)), key, "valid_from")


def satellites(snapshots: DataFrame, key: str, snapshot: str, groups: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """One satellite per attribute group that has attributes; those that change at different rates do not repeat each other."""
    return {name: satellite(snapshots, key, snapshot, columns) for name, columns in groups.items() if columns}


def combined(sats: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(key, valid_from) wherever any of the satellites begins a version: the versions of all their attributes together."""
    starts = [s.select(key, "valid_from") for s in sats.values()]
    return reduce(lambda a, b: a.unionByName(b), starts).distinct() if len(starts) > 1 else starts[0]


def empty_store(snapshots: DataFrame, key: str, snapshot: str, known_at: str, attributes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A store without rows, of the types that append_changes returns."""
    sat, seen = _stamped(snapshots, key, snapshot, known_at, attributes)
    return sat.limit(0), seen.limit(0)


def _stamped(df: DataFrame, key: str, snapshot: str, known_at: str, attributes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    sat = df.select(key, F.col(snapshot).alias("valid_from"), F.col(known_at).alias("known_at"), *attributes).withColumn("hash_diff", hash_diff(attributes))
    return sat, sat.select(key, F.col("valid_from").alias("snapshot"), "known_at", "hash_diff")


def _later(rows: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """Of the rows of one key and date the one that became known last; equal moments go to the larger hash."""
    best = F.max(F.struct(F.col("known_at"), F.col("hash_diff"), *[F.col(c) for c in columns if c not in (key, at, "known_at", "hash_diff")])).alias("b")
    return rows.groupBy(key, at).agg(best).select(key, at, "b.*")


def append_changes(stored: DataFrame, seen: DataFrame, arriving: DataFrame, key: str, snapshot: str, known_at: str, attributes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to insert into the satellite, rows to insert into the tracking log) for arriving snapshots, in whatever order they come.

    `stored` is the satellite (key, valid_from, known_at, attributes, hash_diff), `seen` the tracking log (key, snapshot, known_at,
    hash_diff): the hash of every snapshot ever counted, which tells when a version was last confirmed. Of one key and snapshot the delivery
    that became known last counts, here and in stored_periods; a repeated one adds nothing. A snapshot gets a satellite row where it differs
    from the one before it, or corrects one that has a row; the snapshot behind a late one gets a row where it now begins a version that the
    store had not to tell apart. Nothing stored is ever changed, and only the keys that arrive are read. Appending in any order ends in the
    history that a rebuild from all snapshots has. Rows without key or snapshot are left out; empty input adds nothing.
    """
    ok = arriving.filter(F.col(key).isNotNull() & F.col(snapshot).isNotNull())
    full, log = _stamped(ok, key, snapshot, known_at, attributes)
    full, log = _later(full, key, "valid_from", attributes), _later(log, key, "snapshot", [])
    keys = log.select(key).distinct()
    old_log, old_sat = seen.join(keys, key, "left_semi"), stored.join(keys, key, "left_semi")
    merged = _later(old_log.select(key, "snapshot", "known_at", "hash_diff", F.lit(1).alias("old")).unionByName(log.select(key, "snapshot", "known_at", "hash_diff", F.lit(0).alias("old"))), key, "snapshot", ["old"])
    w = Window.partitionBy(key).orderBy("snapshot")
    rows_at = old_sat.select(key, F.col("valid_from").alias("snapshot"), F.lit(True).alias("has_row")).distinct()
    steps = merged.withColumn("prev", F.lag("hash_diff").over(w)).withColumn("prev_fresh", F.coalesce(F.lag("old").over(w) == 0, F.lit(False)))
    steps = steps.join(rows_at, [key, "snapshot"], "left").withColumn("has_row", F.coalesce("has_row", F.lit(False)))
    differs = ~F.col("prev").eqNullSafe(F.col("hash_diff"))
    own = (F.col("old") == 0) & (differs | F.col("has_row"))
    behind = (F.col("old") == 1) & F.col("prev_fresh") & differs & ~F.col("has_row")
    wanted = steps.filter(own | behind).select(key, F.col("snapshot").alias("valid_from"), "known_at", "hash_diff")
    # Attributes are looked up by their hash, which the store or the arriving rows hold.
    known = old_sat.select(key, "hash_diff", *attributes).unionByName(full.select(key, "hash_diff", *attributes)).dropDuplicates([key, "hash_diff"])
    new = wanted.join(known, [key, "hash_diff"]).select(key, "valid_from", "known_at", *attributes, "hash_diff")
    return new, log.join(old_log, [key, "snapshot", "known_at", "hash_diff"], "left_anti").select(key, "snapshot", "known_at", "hash_diff")


def stored_periods(stored: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """The end-dated view of a store that append_changes fills: late rows that turned out to begin no version drop out."""
    last = _later(stored, key, "valid_from", attributes)
    return periods(_versions(last, key, "valid_from"), key).select(key, "valid_from", "valid_to", *attributes)


def periods(sat: DataFrame, key: str) -> DataFrame:
    """The end-dated view of a satellite: valid_to is the next version's valid_from, or 9999-12-31."""
    w = Window.partitionBy(key).orderBy("valid_from")
    return sat.withColumn("valid_to", F.coalesce(F.lead("valid_from").over(w).cast("date"), F.lit(OPEN_END).cast("date")))


def history(df: DataFrame, key: str, snapshot: str, known_at: str, attributes: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Full history of `attributes` per key with valid_from and valid_to.

    Empty input gives no rows; a key whose snapshots all lack a required attribute has no version; repeated rows and extra columns change
    nothing.
    """
    return periods(satellite(counted_snapshots(df, key, snapshot, known_at, attributes, required), key, snapshot, attributes), key)


def split_history(df: DataFrame, key: str, snapshot: str, known_at: str, attributes: Sequence[str], required: Sequence[str], threshold: float = 0.02) -> DataFrame:
    """(key, valid_from, valid_to): the versions of `attributes` together, from one satellite for those that change often and one for the rest.

    The change rates are measured on all snapshots. A version begins wherever one of the satellites has a row, which is the same as where any
    attribute changes, so the split decides what is stored together and not the result.
    """
    snapshots = cut(counted_snapshots(df, key, snapshot, known_at, attributes, required))
    groups = split_by_rate(change_rates(snapshots, key, snapshot, attributes), threshold)
    return periods(combined(satellites(snapshots, key, snapshot, groups), key), key)
