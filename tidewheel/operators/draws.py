"""Draws whose weights depend on who asks: candidates by a hard filter, a product of weights, and a race of keys instead of a running sum.

Every request meets the pool rows of its cell. With weights w and independent uniform numbers u, the row with the least -ln(1 - u) / w wins
with probability in proportion to w; so a draw is one aggregate, and no request's candidates meet in one task. The aggregate of `race` sorts the
pairs it is given, so it is for few candidates a request; large pools are drawn from by `races.race`, which writes no pairs down.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.columns import hashed_uniform
from tidewheel.operators import quantiles, races
from tidewheel.operators.sampling import race_keys, widen, with_group
from tidewheel.session import cut


def gaussian(pairs: Mapping[str, tuple[Column, Column]], sigma: float, weights: Mapping[str, float] | None = None) -> Column:
    """exp(-sum w d^2 / (2 sigma^2 sum w)) over feature pairs, each already in units of its spread; NULL if any side is missing."""
    w = {k: float((weights or {}).get(k, 1.0)) for k in pairs}
    d2 = reduce(lambda a, b: a + b, [F.lit(w[k]) * (a - b) * (a - b) for k, (a, b) in pairs.items()])
    return F.exp(-d2 / F.lit(2 * sigma * sigma * sum(w.values())))


def candidates(requests: DataFrame, pool: DataFrame, cell: Sequence[str], request: str, asof: tuple[str, str] | None = None) -> DataFrame:
    """Every request with the pool rows of its cell: columns of the pool as `p_...`, those of the request under their names.

    `asof` (request's date, pool's date) leaves out rows that are not older. A NULL in a cell meets nothing.
    """
    other = pool.select(*[F.col(c).alias(c if c in cell else f"p_{c}") for c in pool.columns])
    met = requests.filter(F.col(request).isNotNull()).join(other, list(cell))
    return met if asof is None else met.filter(F.col(f"p_{asof[1]}") < F.col(asof[0]))


def race(met: DataFrame, request: str, row: str, weight: Column, carry: Sequence[str], salt: str) -> DataFrame:
    """(request, carry...) of the candidate drawn for each request; requests whose weights are all 0, NULL or not finite draw nothing."""
    w = weight.cast("double")
    ok = met.withColumn("__w", w).filter((F.col("__w") > 0) & ~F.isnan("__w") & (F.col("__w") < F.lit(float("inf"))))
    key = race_keys(F.col("__w"), hashed_uniform(F.col(request), F.col(row), salt=salt))
    best = F.min(F.struct(key.alias("key"), F.col(row).alias("row"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])).alias("b")
    return ok.groupBy(request).agg(best).select(request, *[F.col(f"b.c{i}").alias(c) for i, c in enumerate(carry)])


def normalised(met: DataFrame, by: Sequence[str], factors: Mapping[str, Column]) -> DataFrame:
    """`met` with each factor divided by its mean among the candidates of a group: a missing fact, or a mean of 0, is exactly neutral."""
    made = met.select("*", *[f.cast("double").alias(f"__f_{n}") for n, f in factors.items()])
    means = with_group(made, by, **{f"__m_{n}": F.avg(f"__f_{n}") for n in factors})
    one = lambda n: F.when(F.col(f"__f_{n}").isNotNull() & (F.col(f"__m_{n}") > 0), F.col(f"__f_{n}") / F.col(f"__m_{n}")).otherwise(1.0)
    return means.withColumns({n: one(n) for n in factors}).drop(*[f"__{k}_{n}" for k in "fm" for n in factors])


def inverse_density(pool: DataFrame, cell: Sequence[str], row: str, features: Mapping[str, float], sigma: float, out: str, power: float = 1.0, refs: int = 256) -> DataFrame:
    """`pool` with `out`: how thin the pool is around each row, scaled to mean 1 in its cell; rows without a feature weigh 1.

    Density is a row's mean kernel against the `refs` rows of its cell with the least hashes, a bounded set; it counts for at least 5 % of the
    cell's median, so a lone row gains twentyfold at most. `features` are columns in units of their spread, with their weights.
    """
    full = reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(f) for f in features])
    complete = pool.filter(full).withColumn("__h", hashed_uniform(F.col(row), salt="density"))
    # The least hashes of a cell: partial lists are cut to `refs` before they meet.
    from tidewheel.operators.relational import first_per

    scale = 2 * sigma * sigma * sum(features.values())
    kernel = lambda q, p: {"k": np.exp(-sum(w * (p[f] - q[f]) ** 2 for f, w in features.items()) / scale)}
    n = races.means(complete, first_per(complete, cell, ["__h", row], refs), cell, row, row, kernel, list(features), list(features), ["k"], keep=cell)
    dense = cut(n.select(*cell, row, (F.col("s_k") / F.col("n_k")).alias("__d")))  # read by the floor, its brackets and the scale
    floor = quantiles.exact(dense, cell, F.col("__d"), [0.5]).select(*cell, (F.col("q0") * 0.05).alias("__floor"))
    inverse = dense.join(floor, list(cell)).withColumn("__i", F.pow(F.greatest("__d", "__floor", F.lit(1e-30)), F.lit(-float(power))))
    scaled = with_group(inverse, cell, __m=F.avg("__i")).select(row, (F.col("__i") / F.col("__m")).alias(out))
    return pool.join(scaled, row, "left").withColumn(out, F.coalesce(out, F.lit(1.0)))


def fence_decision(air: Column, carry: Column, fence: Column, margin: float) -> Column:
    """0 over the fence, 1 short of it, 2 within the margin, 3 undecided; a ball that is not in the air is short, one of unknown kind undecided."""
    told = F.when(carry.isNull() | fence.isNull(), 3).when(carry >= fence + margin, 0).when(carry <= fence - margin, 1).otherwise(2)
    return F.when(air.isNull(), 3).when(~air, 1).otherwise(told)


def fence_filter(met: DataFrame, request: str, decision: str, over: str) -> DataFrame:
    """Candidates after the decision: only rows that went over (0) or did not (1); a request that would keep none keeps all of its rows."""
    d, hit = F.col(decision), F.coalesce(F.col(over), F.lit(False))
    fits = F.when(d == 0, hit).when(d == 1, ~hit).otherwise(True)
    return with_group(met.withColumn("__fits", fits), [request], __any=F.max("__fits")).filter(F.col("__fits") | ~F.col("__any")).drop("__fits", "__any")


def level_draw(requests: DataFrame, pool: DataFrame, levels: Sequence[tuple[str, Sequence[str]]], least: int, request: str, row: str, weight: Column, carry: Sequence[str], salt: str) -> DataFrame:
    """A draw from the first of the levels (name, key columns), narrow to wide, whose cell has `least` rows: (request, level, n_rows, carry...).

    The pool is tagged once for each level; `weight` is of its columns, as `p_...`. A request whose widest cell is empty raises nothing here and draws nothing: its n_rows is 0.
    """
    told = widen(requests, pool, levels, least)
    tag = lambda name, keys, df: F.to_json(F.struct(F.lit(name).alias("l"), *[df[k].cast("string").alias(k) for k in keys]), {"ignoreNullFields": "false"})
    rows = pool.select("*", F.explode(F.array(*[tag(n, k, pool) for n, k in levels])).alias("__cell"))
    cell = reduce(lambda a, b: a.when(told["level"] == b[0], tag(*b, told)), levels[1:], F.when(told["level"] == levels[0][0], tag(*levels[0], told)))
    rows = rows.select("*", *[F.col(c).alias(f"p_{c}") for c in pool.columns]).select("__cell", row, *[c for c in carry if c != row], weight.cast("double").alias("__w"))
    drawn = races.race(told.withColumn("__cell", cell), rows, ["__cell"], request, row, lambda q, p: p["__w"], [], ["__w"], carry, salt)
    drawn = drawn.select(F.col(request).alias("__r"), *[F.col(c).alias(f"drawn_{c}") for c in carry])
    return told.join(drawn, told[request] == F.col("__r"), "left").select(request, "level", "n_rows", *[f"drawn_{c}" for c in carry])
