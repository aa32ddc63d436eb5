"""Forecast evaluation and result distributions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def pmf(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, n, probability, cdf) of the values seen."""
    g = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    return g.withColumn("probability", F.col("n") / F.sum("n").over(w)).withColumn("cdf", F.sum("n").over(w.orderBy(value)) / F.sum("n").over(w))


def over_under_push(value: Column, line: Column) -> dict[str, Column]:
    """Aggregates: over is strictly above the line; a push needs a whole line."""
    whole = line == F.floor(line)
    n = F.count(value)
    share = lambda c: F.count_if(c) / F.nullif(n, F.lit(0)).cast("double")
    return {"p_over": share(value > line), "p_under": share(value < line), "p_push": share((value == line) & whole)}


def proportion_interval(p: Column, n: Column) -> tuple[Column, Column]:
    """Wald interval within [0, 1]."""
    half = F.lit(Z95) * F.sqrt(p * (1 - p) / n)
    return F.greatest(F.lit(0.0), p - half), F.least(F.lit(1.0), p + half)


def mean_interval(mean: Column, sd: Column, n: Column) -> tuple[Column, Column]:
    """Normal interval from the sample deviation; one value has no width."""
    half = F.coalesce(F.lit(Z95) * sd / F.sqrt(n), F.lit(0.0))
    return mean - half, mean + half


def reliability_bins(df: DataFrame, p: str, y: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, n, mean_p, mean_y): equal-width bins, half open, the last one closed, non-empty ones only."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(p).isNotNull() & ~F.isnan(p) & F.col(y).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def calibration_error(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, ece): mean gap weighted by bin size."""
    return bins.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def brier(p: Column, y: Column) -> Column:
    """Aggregate over the whole two-class vector, so between 0 and 2."""
    return F.avg(2 * (p - y) * (p - y))


def log_loss(p: Column, y: Column, eps: float = 1e-15) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1.0), F.when(y == 1, p).otherwise(1 - p)))
    return F.avg(-F.log(q))


def walk_forward(df: DataFrame, season: str, outcome: str) -> DataFrame:
    """(season, n_test, n_train, baseline, actual, error): each season predicted by the mean of all earlier ones.

    Seasons fold into sums first, and the expanding window goes over seasons, not rows.
    """
    s = df.filter(F.col(outcome).isNotNull()).groupBy(season).agg(F.count(F.lit(1)).alias("n_test"), F.sum(F.col(outcome).cast("double")).alias("__s"))
    w = Window.partitionBy().orderBy(season).rowsBetween(Window.unboundedPreceding, -1)
    out = s.withColumn("n_train", F.sum("n_test").over(w)).withColumn("baseline", F.sum("__s").over(w) / F.col("n_train")).withColumn("actual", F.col("__s") / F.col("n_test"))
    return out.filter("n_train > 0").select(season, "n_test", "n_train", "baseline", "actual", (F.col("baseline") - F.col("actual")).alias("error"))


def clustered_se(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """(n, n_clusters, mean, se): CR0 standard error of the mean; 0 for one cluster. Clusters fold to (sum, count) first."""
    g = df.filter(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("n_clusters"))
    dev = F.col("s") - F.col("n") * F.col("all_s") / F.col("all_n")
    out = g.join(F.broadcast(total)).groupBy("all_s", "all_n", "n_clusters").agg(F.sqrt(F.sum(dev * dev)).alias("d"))
    return out.select(F.col("all_n").alias("n"), "n_clusters", (F.col("all_s") / F.col("all_n")).alias("mean"), F.when(F.col("n_clusters") > 1, F.col("d") / F.col("all_n")).otherwise(0.0).alias("se"))


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, replicates: int = 200) -> DataFrame:
    """(n_clusters, mean, low, high): percentile interval of the mean when whole clusters are drawn again.

    Poisson weights from a hash of (replicate, cluster) make each replicate a single aggregate over (sum, count) of clusters; no cluster is
    gathered anywhere. Fewer than two clusters give a point.
    """
    g = df.filter(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    reps = g.select("s", "n", F.col(cluster).alias("c"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r"))
    u = (F.pmod(F.xxhash64("r", "c"), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    weight, mass = F.lit(0), 0.0
    for k in range(12):  # inverse CDF of Poisson(1)
        mass += math.exp(-1) / math.factorial(k)
        weight = weight + F.when(u > mass, 1).otherwise(0)
    means = reps.groupBy("r").agg((F.sum(F.col("s") * weight) / F.nullif(F.sum(F.col("n") * weight), F.lit(0))).alias("m"))
    q = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    total = g.agg(F.count(F.lit(1)).alias("n_clusters"), (F.sum("s") / F.sum("n")).alias("mean"))
    two = F.col("n_clusters") >= 2
    return total.join(q).select("n_clusters", "mean", F.when(two, F.col("q")[0]).otherwise(F.col("mean")).alias("low"), F.when(two, F.col("q")[1]).otherwise(F.col("mean")).alias("high"))


def slope_with_dummies(df: DataFrame, y: str, x: str, dummy: str) -> DataFrame:
    """(n, slope): least squares of y on x beside one dummy for each value of `dummy`, from the sums of each group; NULL without spread.

    Within-group deviations have the same slope, so no matrix of dummies is built. Rows with a NULL in any of the three do not count.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    g = df.filter(a.isNotNull() & b.isNotNull() & F.col(dummy).isNotNull()).groupBy(dummy).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(a, b).alias("c"), F.var_pop(a).alias("v"))
    s = g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("n") * F.col("c")).alias("c"), F.sum(F.col("n") * F.col("v")).alias("v"))
    return s.select("n", (F.col("c") / F.nullif("v", F.lit(0.0))).alias("slope"))


def market(home: Column, away: Column, total: float, spread: float) -> dict[str, Column]:
    """Aggregates over games: total over and under a line, either side, either side against a margin, and level games."""
    share = lambda c: F.avg(c.cast("int"))
    return {
        "p_total_over": share(home + away > total), "p_total_under": share(home + away < total), "p_home": share(home > away), "p_away": share(away > home),
        "p_home_cover": share(home - spread > away), "p_away_cover": share(away + spread > home), "p_level": share(home == away),
    }


def ablation(df: DataFrame, season: str, key: str, outcome: str, n0: float) -> DataFrame:
    """(season, n, brier_base, brier_model): error of predicting each season by the mean of all earlier ones, and by each key's own earlier
    record shrunk to it. Rows fold to sums by season and key first; seasons without a past are left out."""
    y = F.col(outcome).cast("double")
    s = df.filter(y.isNotNull()).groupBy(season, key).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("k"))
    past = lambda *by: Window.partitionBy(*by).orderBy(season).rangeBetween(Window.unboundedPreceding, -1)
    league = s.groupBy(season).agg(F.sum("n").alias("ln"), F.sum("k").alias("lk"))
    league = league.select(season, (F.sum("lk").over(past()) / F.sum("ln").over(past())).alias("base"))
    own = s.select(season, "n", "k", F.coalesce(F.sum("n").over(past(key)), F.lit(0)).alias("pn"), F.coalesce(F.sum("k").over(past(key)), F.lit(0.0)).alias("pk"))
    j = own.join(league.filter("base is not null"), season).withColumn("model", (F.col("pk") + n0 * F.col("base")) / (F.col("pn") + n0))
    error = lambda p: F.sum(F.col("k") * F.pow(1 - F.col(p), F.lit(2)) + (F.col("n") - F.col("k")) * F.pow(F.col(p), F.lit(2))) / F.sum("n")
    return j.groupBy(season).agg(F.sum("n").alias("n"), error("base").alias("brier_base"), error("model").alias("brier_model"))


def bonferroni(df: DataFrame, by: str, outcome: str, tests: int, alpha: float = 0.05, least: int = 30) -> DataFrame:
    """(by, n, z, differs): groups whose rate differs from that of all rows, at a level shared by `tests` tests and for `least` rows or more."""
    limit = NormalDist().inv_cdf(1 - alpha / tests / 2)
    g = df.filter(F.col(outcome).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("double")).alias("k"))
    whole = g.agg((F.sum("k") / F.sum("n")).alias("q"))
    z = (F.col("k") / F.col("n") - F.col("q")) / F.sqrt(F.nullif(F.col("q") * (1 - F.col("q")), F.lit(0.0)) / F.col("n"))
    return g.join(F.broadcast(whole)).select(by, "n", z.alias("z")).withColumn("differs", (F.col("n") >= least) & F.coalesce(F.abs("z") > limit, F.lit(False)))


def pooled_chi2(observed: Sequence[float], expected: Sequence[float], labels: Sequence[str], least: float = 5.0) -> tuple[float, int, list[str]]:
    """(statistic, degrees of freedom, labels) after merging the high tail inward, then the low end, until each bin expects `least`."""
    o, e, names = list(map(float, observed)), list(map(float, expected)), list(labels)
    while len(e) > 1 and e[-1] < least:
        e[-2:] = [e[-2] + e[-1]]
        o[-2:] = [o[-2] + o[-1]]
        names.pop()
        names[-1] = names[-1].rstrip("+") + "+"
    while len(e) > 1 and e[0] < least:
        e[:2] = [e[0] + e[1]]
        o[:2] = [o[0] + o[1]]
        names.pop(0)
    return sum((a - b) ** 2 / b for a, b in zip(o, e) if b > 0), max(len(e) - 1, 0), names


def reliability_map(x: Sequence[float], y: Sequence[float]):
    """A monotone piecewise-linear map through the points: NaNs dropped, running maximum, clamped at the ends; fewer than 2 points: identity."""
    points = sorted((a, b) for a, b in zip(x, y) if not (math.isnan(a) or math.isnan(b)))
    if len(points) < 2:
        return lambda column: column
    best, knots = -math.inf, []
    for a, b in points:
        best = max(best, b)
        if knots and knots[-1][0] == a:
            knots[-1] = (a, best)
        else:
            knots.append((a, best))

    def mapped(column: Column) -> Column:
        out = F.when(column <= knots[0][0], F.lit(knots[0][1]))
        for (a, fa), (b, fb) in zip(knots, knots[1:]):
            out = out.when(column <= b, F.lit(fa) + (column - F.lit(a)) * F.lit((fb - fa) / (b - a)))
        return out.otherwise(F.when(column.isNotNull(), F.lit(knots[-1][1])))

    return mapped
