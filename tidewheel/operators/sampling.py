"""Weighted draws: hard filter, product of weights, cumulative sum, inverse-CDF draw; and the ladder that widens a filter until enough rows are left."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.session import cut


def product(*factors: Column) -> Column:
    """Product of weights; a missing factor is neutral."""
    return reduce(lambda a, b: a * b, [F.coalesce(f.cast("double"), F.lit(1.0)) for f in factors])


#: Rows of one step of a running sum or draw; longer groups are cut into as many steps as they need.
STEP = 50_000


def with_group(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """`df` with aggregates of each row's group, by one partial aggregate that the rows look up; NULL is a group. No group meets in one task."""
    g = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()])
    if not by:
        return df.join(F.broadcast(g))
    g = g.select(*[F.col(c).alias(f"__{c}") for c in by], *aggregates)
    return df.join(g, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])).drop(*[f"__{c}" for c in by])


def neutral_power(df: DataFrame, score: str, power: float, over: Sequence[str], out: str) -> DataFrame:
    """`df` with score ** power as `out`; rows without a score weigh the mean of the scored rows of their group, 1 where none has one."""
    raised = F.when(F.col(score).isNotNull(), F.pow(F.col(score), F.lit(float(power))))
    return with_group(df, over, __mean=F.avg(raised)).withColumn(out, F.coalesce(raised, "__mean", F.lit(1.0))).drop("__mean")


def mean_one(df: DataFrame, kernel: str, over: Sequence[str], out: str) -> DataFrame:
    """`df` with a kernel scaled to mean 1 in its group as `out`; incomplete rows weigh exactly 1."""
    k = F.col(kernel)
    usable = k.isNotNull() & F.col("__mean").isNotNull() & (F.col("__mean") > 0)
    return with_group(df, over, __mean=F.avg(k)).withColumn(out, F.when(usable, k / F.col("__mean")).otherwise(1.0)).drop("__mean")


def cumulative(pool: DataFrame, group: Sequence[str], order: Sequence[str], weight: str) -> DataFrame:
    """Pool rows with cum_before, cum and total of their weights in their group, in the order given (make it total).

    Rows of weight 0, NULL, NaN, infinite or below 0 cannot be drawn and are left out. A group may hold any share of all rows: the rows are cut
    into even ranges of (group, order), each range is summed alone, and ranges are chained by their totals.
    """
    ok = pool.filter((F.col(weight) > 0) & ~F.isnan(F.col(weight)) & (F.col(weight) < F.lit(float("inf"))))
    placed = cut(ok.repartitionByRange(*group, *order).withColumn("__s", F.spark_partition_id()))
    sums = placed.groupBy(*group, "__s").agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*group)
    before = w.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__s").alias("__part"), F.coalesce(F.sum("__w").over(before), F.lit(0.0)).alias("__base"), F.sum("__w").over(w).alias("total"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group], F.col("__s") == F.col("__part"))
    inner = Window.partitionBy(*group, "__s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(sums, same).withColumn("cum", F.col("__base") + F.sum(weight).over(inner))
    return out.withColumn("cum_before", F.col("cum") - F.col(weight)).drop("__s", "__part", "__base", *[f"__{g}" for g in group])


def draw(requests: DataFrame, pool: DataFrame, group: Sequence[str], order: Sequence[str], weight: str, u: str, carry: Sequence[str]) -> DataFrame:
    """Every request (group, u in [0, 1)) with the columns `carry` of the pool row drawn: the first whose cumulative weight exceeds u x total.

    A request whose group has no drawable row gets NULLs: the caller's default applies; so does one with a NULL group or u. Pool rows and
    requests are laid out together on the line of cumulative shares, and a running step hands each request the row that ends next: linear in
    both, with a group's line cut into pieces of about STEP rows and requests.
    """
    c = cumulative(pool, group, order, weight)
    asked = requests.withColumn("__u", F.when(F.col(u).isNotNull(), F.greatest(F.lit(0.0), F.col(u))))
    sizes = c.groupBy(*group).agg(F.count(F.lit(1)).alias("__np"), F.max("total").alias("__total"))
    n_asked = asked.groupBy(*group).agg(F.count(F.lit(1)).alias("__nq"))
    cells = sizes.join(n_asked, list(group)).select(*group, "__total", F.ceil((F.col("__np") + F.col("__nq")) / STEP).cast("int").alias("__cells"))
    cell = lambda share: F.greatest(F.lit(0), F.least(F.floor(share * F.col("__cells")).cast("int"), F.col("__cells") - 1))
    row = F.struct(*[F.col(x).alias(f"c{i}") for i, x in enumerate(carry)])
    # A pool row stands in every cell that its stretch of the line touches, with some room for rounding.
    ends = c.join(cells, list(group)).select(*group, F.explode(F.sequence(cell(F.col("cum_before") / F.col("__total") - 1e-9), cell(F.col("cum") / F.col("__total") + 1e-9))).alias("__cell"), F.col("cum").alias("__at"), F.lit(1).alias("__kind"), row.alias("__row"))
    points = asked.join(cells, list(group), "left").select(*group, F.coalesce(cell(F.col("__u")), F.lit(0)).alias("__cell"), (F.col("__u") * F.col("__total")).alias("__at"), F.lit(0).alias("__kind"), F.struct(*requests.columns).alias("__request"))
    # Backwards: behind a request comes the pool row with the least cum above it; a row that ends at the very place does not count.
    line = Window.partitionBy(*group, "__cell").orderBy(F.col("__at").desc_nulls_last(), F.col("__kind").asc(), *([F.col("__row").desc()] if carry else [])).rowsBetween(Window.unboundedPreceding, 0)
    both = ends.unionByName(points, allowMissingColumns=True).withColumn("__hit", F.last("__row", ignorenulls=True).over(line)).filter("__kind = 0")
    hit = F.when(F.col("__at").isNotNull(), F.col("__hit"))
    return both.select("__request.*", *[hit[f"c{i}"].alias(f"drawn_{x}") for i, x in enumerate(carry)])


def widen(requests: DataFrame, pool: DataFrame, levels: Sequence[tuple[str, Sequence[str]]], least: int) -> DataFrame:
    """Requests with `level` and `n_rows`: the first of the levels (name, key columns), narrow to wide, whose cell has at least `least` rows.

    The widest level applies where none has. Cells are counted once from the narrowest level's counts, so the pool is scanned once; levels
    must have nested keys.
    """
    finest = levels[0][1]
    counts = pool.groupBy(*finest).agg(F.count(F.lit(1)).alias("__n"))
    out = requests
    for i, (_, keys) in enumerate(levels):
        n = counts.groupBy(*keys).agg(F.sum("__n").alias(f"__n{i}")) if keys else counts.agg(F.sum("__n").alias(f"__n{i}"))
        out = out.join(n, list(keys), "left") if keys else out.join(F.broadcast(n))
    level, rows = None, None
    for i, (name, _) in enumerate(levels):
        enough = F.coalesce(F.col(f"__n{i}"), F.lit(0)) >= least if i < len(levels) - 1 else F.lit(True)
        level = F.when(enough, name) if level is None else level.when(enough, name)
        rows = F.when(enough, F.coalesce(F.col(f"__n{i}"), F.lit(0))) if rows is None else rows.when(enough, F.coalesce(F.col(f"__n{i}"), F.lit(0)))
    return out.select(*requests.columns, level.alias("level"), rows.alias("n_rows"))


def race_keys(weight: Column, u: Column) -> Column:
    """Efraimidis-Spirakis keys: the rows of the k smallest keys are a weighted sample without replacement, by one top-k and no running sum."""
    return -F.log(F.lit(1.0) - u) / weight


def advance_count(balls: Column, strikes: Column, outcome: Column) -> Column:
    """The count after one pitch: struct (balls, strikes, over)."""
    b = balls + F.when(outcome == "ball", 1).otherwise(0)
    s = strikes + F.when(outcome.isin("swinging_strike", "called_strike"), 1).when((outcome == "foul") & (strikes < 2), 1).otherwise(0)
    over = (b >= 4) | (s >= 3) | outcome.isin("in_play", "hit_by_pitch")
    return F.struct(F.least(b, F.lit(4)).alias("balls"), F.least(s, F.lit(3)).alias("strikes"), over.alias("over"))


def fold_counts(outcomes: Column) -> Column:
    """The count after an ordered array of outcomes; nothing counts after the at-bat is over."""
    start = F.struct(F.lit(0).alias("balls"), F.lit(0).alias("strikes"), F.lit(False).alias("over"))
    return F.aggregate(outcomes, start, lambda a, x: F.when(a["over"], a).otherwise(advance_count(a["balls"], a["strikes"], x)))


def count_chain(rates: Mapping[tuple[int, int], Mapping[str, float]]) -> dict[str, float]:
    """Shares of at-bats that end in a walk, a strikeout, a ball in play or a hit batter, from outcome rates of the twelve counts.

    Two-strike fouls stay where they are: the other outcomes share their weight. A count with nothing but fouls raises. A 12-state chain is a
    driver-sized computation whatever the size of the data the rates come from.
    """
    at = {(b, s): 0.0 for b in range(4) for s in range(3)}
    at[0, 0] = 1.0
    end = dict.fromkeys(("walk", "strikeout", "in_play", "hit_by_pitch"), 0.0)
    for (b, s), mass in ((k, at[k]) for k in sorted(at, key=lambda k: (k[0] + k[1], k))):
        p = dict(rates.get((b, s), {}))
        if not p or not mass:
            continue
        if s == 2:
            stay = p.pop("foul", 0.0)
            if stay >= 1:
                raise ValueError(f"only fouls at {b}-{s}")
            p = {k: v / (1 - stay) for k, v in p.items()}
        for outcome, share in p.items():
            m = mass * share
            if outcome in ("in_play", "hit_by_pitch"):
                end[outcome] += m
            elif outcome == "ball":
                if b == 3:
                    end["walk"] += m
                else:
                    at[b + 1, s] += m
            elif s == 2:
                end["strikeout"] += m
            else:
                at[b, s + 1] += m
    return end
