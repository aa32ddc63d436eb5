"""Similarity scoring of profiles: z-scores, kernels, exact nearest neighbours of a stated query set, Gaussian mixtures and their distances."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.columns import rbf
from tidewheel.operators import quantiles
from tidewheel.session import cut, parallelism, ship

#: Query rows, and rows of the table, that are compared at once.
QUERY_BLOCK, TABLE_BLOCK = 1024, 16_384


def zscores(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), weights: Mapping[str, float] | None = None) -> DataFrame:
    """Population z-scores in place of the features, each within the groups of `by`; no spread gives 0, missing stays missing.

    Means and deviations are one small aggregate that the rows look up, so the rows themselves are not shuffled for them.
    """
    stats = df.groupBy(*by).agg(*[F.avg(f).alias(f"__m_{f}") for f in features], *[F.stddev_pop(f).alias(f"__s_{f}") for f in features])
    joined = df.join(stats, list(by), "left") if by else df.join(F.broadcast(stats))
    w = weights or {}
    z = {f: F.when(F.col(f).isNotNull(), F.when(F.col(f"__s_{f}") > 0, (F.col(f) - F.col(f"__m_{f}")) / F.col(f"__s_{f}")).otherwise(0.0) * F.lit(float(w.get(f, 1.0)))) for f in features}
    return joined.withColumns(z).drop(*[f"__{k}_{f}" for k in "ms" for f in features])


def pairs_within(df: DataFrame, block: Sequence[str], key: str) -> DataFrame:
    """Pairs a < b of the same block, every column twice (a_*, b_*). Give blocks that are bounded by nature: all pairs of a block come out."""
    a = df.select(*[F.col(c) if c in block else F.col(c).alias(f"a_{c}") for c in df.columns])
    b = df.select(*[F.col(c) if c in block else F.col(c).alias(f"b_{c}") for c in df.columns])
    return a.join(b, list(block)).filter(F.col(f"a_{key}") < F.col(f"b_{key}"))


def _packed(most: int):
    """Rows (id, v) to blocks of up to `most` vectors of one width, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(width: int) -> pa.RecordBatch:
            ids, v = zip(*held.pop(width))
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.stack(v).tobytes()], pa.binary())], names=["width", "ids", "v"])

        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy()
            flat, start = batch.column(1).flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)])
            for i, x in enumerate(batch.column(0).to_pylist()):
                rows = held.setdefault(int(size[i]), [])
                rows.append((x, flat[start[i] : start[i + 1]]))
                if len(rows) == most:
                    yield block(int(size[i]))
        for width in list(held):
            yield block(width)

    return run


def _nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, distance) of the k nearest rows of one block of the table for each query of one block."""
    near_id, near_d = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
    for lo in range(0, len(x), 2048):
        part, part_ids = x[lo : lo + 2048], ids[lo : lo + 2048]
        d = np.maximum((q * q).sum(1)[:, None] + (part * part).sum(1)[None] - 2 * q @ part.T, 0)
        d[q_ids[:, None] == part_ids[None]] = np.inf
        pre = min(4 * k + 16, len(part_ids))  # the fast form only preselects; distances are then computed directly
        top = np.argpartition(d, pre - 1, axis=1)[:, :pre]
        exact = np.sqrt(((q[:, None, :] - part[top]) ** 2).sum(2))
        exact[~np.isfinite(np.take_along_axis(d, top, 1))] = np.inf
        near_id, near_d = np.concatenate([near_id, part_ids[top]], 1), np.concatenate([near_d, exact], 1)
        order = np.lexsort((near_id, near_d), axis=1)[:, :k]
        near_id, near_d = np.take_along_axis(near_id, order, 1), np.take_along_axis(near_d, order, 1)
    r, c = np.nonzero(np.isfinite(near_d))
    return q_ids[r], near_id[r, c], near_d[r, c]


def knn(table: DataFrame, queries: DataFrame, key: str, vector: str, k: int, carry: Sequence[str] = ()) -> DataFrame:
    """(query, neighbour, distance, rank, carry of the neighbour): the exact k nearest rows of `table` for every row of `queries`, itself excluded.

    The query set is stated and meets the whole table block by block: for each pair of blocks the k best rows of each query are kept, and only
    those few are shuffled. Neither side passes through the driver. Equal distances go to the smaller key. Rows with a NULL key, or vectors that are NULL, empty, of another
    width or not finite, take no part; repeated keys count once.
    """
    spark = table.sparkSession
    ship(spark)
    clean = lambda d: d.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))).dropDuplicates([key])
    packed = lambda d, most: clean(d).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_packed(most), "width int, ids binary, v binary")
    spread = parallelism(spark)
    # Every block of queries meets every block of the table once; the table's blocks stay where they are dealt, the few queries go to all.
    blocks = packed(queries, QUERY_BLOCK).select(F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("at"), "width", F.col("ids").alias("q_ids"), F.col("v").alias("q"))
    data = packed(table, TABLE_BLOCK).withColumn("at", F.pmod(F.xxhash64("ids"), F.lit(spread)).cast("int"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, q_ids, q, ids, v in zip(*(batch.column(i).to_pylist() for i in range(5))):
                a, b, d = _nearest(np.frombuffer(q_ids, np.int64), np.frombuffer(q).reshape(-1, width), np.frombuffer(ids, np.int64), np.frombuffer(v).reshape(-1, width), k)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], names=["query", "neighbour", "distance"])

    met = blocks.join(data, ["at", "width"]).select("width", "q_ids", "q", "ids", "v")
    out = met.mapInArrow(best, "query long, neighbour long, distance double")
    w = Window.partitionBy("query").orderBy("distance", "neighbour")
    ranked = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    if carry:
        ranked = ranked.join(table.dropDuplicates([key]).select(F.col(key).cast("long").alias("neighbour"), *carry), "neighbour")
    return ranked.select("query", "neighbour", "distance", "rank", *carry)


def score_matrix(pairs: DataFrame, a: str, b: str, by: Sequence[str], weights: Mapping[str, float], sigma: float) -> DataFrame:
    """(a, b, by, score): a score matrix as a pair table, for pairs with the features of b and of a (as q_...). To keep it, write it."""
    return pairs.select(a, b, *by, rbf({c: F.col(f"q_{c}") for c in weights}, {c: F.col(c) for c in weights}, weights, sigma).alias("score"))


def symmetry(scores: DataFrame, a: str, b: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, lo, hi, first, gap): for pairs that are scored both ways, the score of the smaller id's row and how far the other one is from it."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    forward = F.col(a) < F.col(b)
    g = scores.groupBy(*by, lo.alias("lo"), hi.alias("hi")).agg(F.max(F.when(forward, F.col(score))).alias("first"), F.max(F.when(~forward, F.col(score))).alias("second"))
    return g.filter("first is not null and second is not null").select(*by, "lo", "hi", "first", F.abs(F.col("first") - F.col("second")).alias("gap"))


def merge_small(components: DataFrame, key: str, group: Sequence[str], features: Sequence[str], size: str, least: int) -> DataFrame:
    """Components with `into_id`: those of fewer than `least` rows name the nearest large component of their group, the smaller id on equal
    distance; large ones, and small ones of groups without any, name themselves. Groups hold a few components each."""
    small, large = components.filter(F.col(size) < least), components.filter(F.col(size) >= least)
    other = large.select(*group, F.col(key).alias("__into"), *[F.col(f).alias(f"__{f}") for f in features])
    d = reduce(lambda x, y: x + y, [F.pow(F.col(f) - F.col(f"__{f}"), F.lit(2)) for f in features])
    near = small.join(other, list(group)).groupBy(key).agg(F.min(F.struct(d.alias("d"), F.col("__into").alias("i")))["i"].alias("into_id"))
    return components.join(near, key, "left").withColumn("into_id", F.coalesce("into_id", key))


def outcome_shares(neighbours: DataFrame, label: str) -> DataFrame:
    """(query, label, share): classes among the neighbours of each query."""
    g = neighbours.groupBy("query", label).agg(F.count(F.lit(1)).alias("n"))
    return g.select("query", label, (F.col("n") / F.sum("n").over(Window.partitionBy("query"))).alias("share"))


def weighted_prediction(distance: Column, recency: Column, outcome: Column) -> Column:
    """Aggregate: mean outcome with weights recency / (1e-9 + distance); the plain mean where these are no use."""
    w = recency / (F.lit(1e-9) + distance)
    total = F.sum(w)
    return F.when((total > 0) & (total < F.lit(float("inf"))), F.sum(w * outcome) / total).otherwise(F.avg(outcome))


def concentration(scores: DataFrame, owner: str, own: str, weight: str) -> DataFrame:
    """(owner, own_share, own_share_weighted, ess_share): how far weights rest on an owner's own rows; unscored rows weigh 1."""
    w = F.coalesce(F.col(weight), F.lit(1.0))
    mine = F.col(own).cast("double")
    return scores.groupBy(owner).agg(F.avg(mine).alias("own_share"), (F.sum(w * mine) / F.sum(w)).alias("own_share_weighted"), (F.sum(w) * F.sum(w) / F.sum(w * w) / F.count(F.lit(1))).alias("ess_share"))


def sigma_for(distances: DataFrame, d2: str, target: float) -> DataFrame:
    """(median_d2, gamma, sigma) that give the median pair the score `target`; NULL where there is no spread."""
    fit = quantiles.exact(distances, [], F.col(d2), [0.5]).select(F.col("q0").alias("median_d2"))
    gamma = F.when(F.col("median_d2") > 0, -F.log(F.lit(target)) / F.col("median_d2"))
    return fit.withColumn("gamma", gamma).withColumn("sigma", F.sqrt(F.lit(0.5) / F.col("gamma")))


def reliability(df: DataFrame, key: str, season: str, features: Sequence[str]) -> DataFrame:
    """(feature, n_pairs, weight): correlation of consecutive seasons, clamped to [0.1, 1]; 0.5 for fewer than 5 pairs or no spread."""
    nxt = df.select(key, (F.col(season) - 1).alias(season), *[F.col(f).alias(f"__{f}") for f in features])
    j = df.select(key, season, *features).join(nxt, [key, season])
    both = lambda f: F.col(f).isNotNull() & F.col(f"__{f}").isNotNull()
    row = j.agg(*[F.count_if(both(f)).alias(f"n_{f}") for f in features], *[F.corr(F.when(both(f), F.col(f)), F.when(both(f), F.col(f"__{f}"))).alias(f"r_{f}") for f in features])
    one = lambda f: F.struct(F.lit(f).alias("feature"), F.col(f"n_{f}").alias("n_pairs"), F.when((F.col(f"n_{f}") < 5) | F.col(f"r_{f}").isNull() | F.isnan(f"r_{f}"), 0.5).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col(f"r_{f}")))).alias("weight"))
    return row.select(F.explode(F.array(*[one(f) for f in features])).alias("x")).select("x.*")


def prior_strength(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(n0, n_rows): median over features of within- to between-key variance, clamped to [5, 200]; 50 for fewer than 20 rows."""
    per = df.groupBy(key).agg(*[F.var_pop(f).alias(f"v_{f}") for f in features], *[F.avg(f).alias(f"m_{f}") for f in features], F.count(F.lit(1)).alias("__n"))
    row = per.agg(F.sum("__n").alias("n_rows"), *[(F.avg(f"v_{f}") / F.nullif(F.var_pop(f"m_{f}"), F.lit(0.0))).alias(f) for f in features])
    ratios = F.array_sort(F.array_compact(F.array(*features)))
    n = F.size(ratios)
    median = (F.try_element_at(ratios, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(ratios, F.floor((n + 2) / 2).cast("int"))) / 2
    return row.select(F.when((F.coalesce(F.col("n_rows"), F.lit(0)) < 20) | (n == 0), 50.0).otherwise(F.greatest(F.lit(5.0), F.least(F.lit(200.0), median))).alias("n0"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


# --- mixtures


def bures2(m1: np.ndarray, c1: np.ndarray, m2: np.ndarray, c2: np.ndarray) -> float:
    """Squared Bures-Wasserstein distance of two Gaussians, never below 0."""
    values, vectors = np.linalg.eigh(c1)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ c2 @ root), 0)).sum()
    return max(float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * cross), 0.0)


def greedy_transport(cost: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Cost of moving mass a to mass b when the cheapest lane is always filled first; masses are scaled to 1."""
    a, b, total = a / a.sum(), b / b.sum(), 0.0
    for i, j in zip(*np.unravel_index(np.argsort(cost, axis=None, kind="stable"), cost.shape)):
        move = min(a[i], b[j])
        total += move * cost[i, j]
        a[i] -= move
        b[j] -= move
    return total


def exact_transport(cost: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Least cost of moving mass a to mass b (scaled to 1 each), by shortest augmenting paths: exact, for the few components of mixtures."""
    n, m = cost.shape
    a, b, flow = a / a.sum(), b / b.sum(), np.zeros((n, m))
    for i in range(n):
        while a[i] > 1e-12:
            # Bellman-Ford over sources and sinks: a lane forward costs cost, back along a used lane gives it back.
            dist, via = np.full(n + m, np.inf), np.full(n + m, -1)
            dist[i] = 0.0
            for _ in range(n + m):
                ahead = dist[:n, None] + cost
                best = ahead.argmin(0)
                better = ahead[best, np.arange(m)] < dist[n:] - 1e-15
                dist[n:][better], via[n:][better] = ahead[best, np.arange(m)][better], best[better]
                back = np.where(flow > 1e-15, dist[None, n:] - cost, np.inf)
                best_back = back.argmin(1)
                better_back = back[np.arange(n), best_back] < dist[:n] - 1e-15
                dist[:n][better_back], via[:n][better_back] = back[np.arange(n), best_back][better_back], n + best_back[better_back]
                if not better.any() and not better_back.any():
                    break
            open_sinks = np.flatnonzero(b > 1e-15)
            if not len(open_sinks):
                break
            sink = n + open_sinks[dist[n:][open_sinks].argmin()]
            path, at = [sink], sink
            while at != i:
                at = int(via[at])
                path.append(at)
            path.reverse()
            move = min([a[i], b[sink - n], *[flow[v, u - n] for u, v in zip(path, path[1:]) if u >= n]])
            for u, v in zip(path, path[1:]):
                if u < n:
                    flow[u, v - n] += move
                else:
                    flow[v, u - n] -= move
            a[i] -= move
            b[sink - n] -= move
    return float((flow * cost).sum())


def mixture_distances(pairs: DataFrame, exact: bool = False) -> DataFrame:
    """(a, b, w2) for rows with a, b and the mixtures wa, ma, wb, mb: weights, and means as arrays of arrays.

    With the columns ca and cb (covariances as arrays of flat matrices) the cost between components is the Bures-Wasserstein one, without them
    that of unit covariances. Mass is moved cheapest lane first, or with `exact` at the least cost there is.
    """
    ship(pairs.sparkSession)
    move = exact_transport if exact else greedy_transport
    with_covariances = {"ca", "cb"} <= set(pairs.columns)
    if with_covariances:

        def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                w2 = []
                for wa, ma, ca, wb, mb, cb in zip(*(pdf[c] for c in ("wa", "ma", "ca", "wb", "mb", "cb"))):
                    d = len(ma[0])
                    cost = np.array([[bures2(np.asarray(x), np.asarray(cx).reshape(d, d), np.asarray(y), np.asarray(cy).reshape(d, d)) for y, cy in zip(mb, cb)] for x, cx in zip(ma, ca)])
                    w2.append(float(np.sqrt(move(cost, np.array(wa, float), np.array(wb, float)))))
                yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "w2": w2})

        return pairs.select("a", "b", "wa", "ma", "ca", "wb", "mb", "cb").mapInPandas(full, "a long, b long, w2 double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w2 = []
            for wa, ma, wb, mb in zip(pdf["wa"], pdf["ma"], pdf["wb"], pdf["mb"]):
                x, y = np.stack(ma), np.stack(mb)
                w2.append(float(np.sqrt(move(((x[:, None] - y[None]) ** 2).sum(2), np.array(wa, float), np.array(wb, float)))))
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "w2": w2})

    return pairs.select("a", "b", "wa", "ma", "wb", "mb").mapInPandas(run, "a long, b long, w2 double")


def fit_mixture(x: np.ndarray, k: int, seed: int = 42, starts: int = 3, rounds: int = 60) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihood, weights, means, covariances) of a full-covariance mixture by expectation-maximisation, best of several starts."""
    n, d = x.shape
    rng, best = np.random.default_rng(seed), None
    ridge = 1e-6 * np.eye(d) * max(float(x.var(0).mean()), 1e-9)
    for _ in range(1 if k == 1 else starts):
        means, w, covs = x[rng.choice(n, k, replace=False)], np.full(k, 1 / k), np.stack([np.cov(x.T, ddof=0).reshape(d, d) + ridge] * k)
        last = -np.inf
        for _ in range(rounds):  # all components at once
            root = np.linalg.cholesky(covs)
            z = np.linalg.inv(root) @ (x[None] - means[:, None]).transpose(0, 2, 1)
            scale = np.log(w) - np.log(np.diagonal(root, axis1=1, axis2=2)).sum(1) - 0.5 * d * np.log(2 * np.pi)
            logp = scale[:, None] - 0.5 * (z * z).sum(1)
            top = logp.max(0)
            share = np.exp(logp - top)
            total_share = share.sum(0)
            r, total = share / total_share, float((top + np.log(total_share)).sum())
            mass = r.sum(1) + 1e-9
            w, means = mass / mass.sum(), (r @ x) / mass[:, None]
            off = x[None] - means[:, None]
            covs = (off * r[:, :, None]).transpose(0, 2, 1) @ off / mass[:, None, None] + ridge
            if total - last < 1e-5 * n:
                break
            last = total
        if best is None or total > best[0]:
            best = (total, w, means, covs)
    return best


def _expect(x: np.ndarray, w: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """Log-likelihood, then of each component the mass, the sums and the outer products around its mean, as one row of numbers: rows add up."""
    d = x.shape[1]
    root = np.linalg.cholesky(covs)
    off = x[None] - means[:, None]
    z = np.linalg.inv(root) @ off.transpose(0, 2, 1)
    logp = (np.log(w) - np.log(np.diagonal(root, axis1=1, axis2=2)).sum(1) - 0.5 * d * np.log(2 * np.pi))[:, None] - 0.5 * (z * z).sum(1)
    top = logp.max(0)
    share = np.exp(logp - top)
    total = share.sum(0)
    r = share / total
    outer = (off * r[:, :, None]).transpose(0, 2, 1) @ off
    return np.concatenate([[(top + np.log(total)).sum()], r.sum(1), (r[:, :, None] * off).sum(1).ravel(), outer.ravel()])


def _maximise(sums: np.ndarray, k: int, means: np.ndarray, ridge: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihood, weights, means, covariances) from the summed rows of _expect."""
    d = means.shape[1]
    mass = sums[1 : 1 + k] + 1e-9
    shift = sums[1 + k : 1 + k + k * d].reshape(k, d) / mass[:, None]
    covs = sums[1 + k + k * d :].reshape(k, d, d) / mass[:, None, None] - shift[:, :, None] * shift[:, None] + ridge
    return float(sums[0]), mass / mass.sum(), means + shift, covs


def fit_large_mixtures(rows: DataFrame, seeds: Mapping[int, np.ndarray], most: int, starts: int = 3, rounds: int = 60) -> dict[int, tuple[int, tuple]]:
    """{g: (rows, fit)} with the best BIC among 1..most components, for rows (g, x) of groups too large for a task.

    Every round is one pass: the tasks add up the statistics of all fits that still move, and only these sums reach the driver. The first
    means are the group's rows in `seeds`; all else comes from all rows.
    """
    spark, d = rows.sparkSession, len(next(iter(seeds.values()))[0])

    def sums(models: dict[tuple, tuple]) -> dict[tuple, np.ndarray]:
        every = spark.sparkContext.broadcast(models)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[tuple, np.ndarray] = {}
            for pdf in batches:
                for g, part in pdf.groupby("g"):
                    x = np.stack(part["x"].to_numpy())
                    for m, (w, means, covs) in every.value.items():
                        if m[0] == g:
                            total[m] = total.get(m, 0) + np.append(_expect(x, w, means, covs), len(x))
            yield pd.DataFrame([(*m, j, v) for m, row in total.items() for j, v in enumerate(row)], columns=["g", "k", "s", "j", "v"]).astype({"g": "int64", "k": "int64", "s": "int64", "j": "int64", "v": "float64"})

        out: dict[tuple, np.ndarray] = {}
        parts = rows.mapInPandas(run, "g long, k long, s long, j long, v double")
        for r in sorted(parts.groupBy("g", "k", "s", "j").agg(F.sum("v").alias("v")).collect()):
            out.setdefault((r["g"], r["k"], r["s"]), []).append(r["v"])
        every.unpersist()
        return {m: np.array(v) for m, v in out.items()}

    unit = {(g, 1, 0): (np.ones(1), x[:1], np.eye(d)[None]) for g, x in seeds.items()}
    whole, live, best, n = sums(unit), {}, {}, {}
    ridge = {}
    for (g, _, _), row in whole.items():
        n[g] = int(row[-1])
        _, _, _, covs = _maximise(row[:-1], 1, seeds[g][:1], 0.0)
        ridge[g] = 1e-6 * np.eye(d) * max(float(np.trace(covs[0])) / d, 1e-9)
        rng = np.random.default_rng(42)
        for k in range(1, most + 1):
            for s in range(1 if k == 1 else starts):
                live[g, k, s] = (np.full(k, 1 / k), seeds[g][rng.choice(len(seeds[g]), k, replace=False)], np.stack([covs[0] + ridge[g]] * k))
    last: dict[tuple, float] = {}
    fits: dict[tuple, tuple] = {}
    for _ in range(rounds):
        for m, row in sums(live).items():
            fits[m] = _maximise(row[:-1], m[1], live[m][1], ridge[m[0]])
            live[m] = fits[m][1:]
            if fits[m][0] - last.get(m, -np.inf) < 1e-5 * n[m[0]]:
                del live[m]
            last[m] = fits[m][0]
        if not live:
            break
    for (g, k, _), f in sorted(fits.items(), key=lambda x: x[0]):
        bic = -2 * f[0] + _parameters(k, d) * np.log(n[g])
        if g not in best or bic < best[g][0]:
            best[g] = (bic, f)
    return {g: (n[g], f) for g, (_, f) in best.items()}


def _parameters(k: int, d: int) -> float:
    return k * (1 + d + d * (d + 1) / 2) - 1


def mixtures(df: DataFrame, group: Sequence[str], features: Sequence[str], key: str, most: int = 4, least_rows: int = 40, rows_per_group: int = 20_000) -> DataFrame:
    """(group, component, weight, n_rows, means) of the mixture with the best BIC among 1..most components, for groups of `least_rows` or more.

    All rows without missing features are used. Groups of up to rows_per_group rows are fitted in a task each; larger ones by passes over all
    their rows, which add up the statistics of a round where the rows are.
    """
    ship(df.sparkSession)
    ok = df.select(*group, key, *features).dropna(subset=list(features))
    types = dict(df.dtypes)
    schema = ", ".join(f"{g} {types[g]}" for g in group) + ", component int, weight double, n_rows long, means array<double>"
    columns = [*group, "component", "weight", "n_rows", "means"]

    def rows_of(names: Sequence, n: int, weights: np.ndarray, means: np.ndarray) -> list[list]:
        return [[*names, i, float(weights[j]), n, means[j].tolist()] for i, j in enumerate(np.argsort(-weights))]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(key)[list(features)].to_numpy(float)
        if len(x) < least_rows:
            return pd.DataFrame(columns=columns)
        scale = np.where(x.std(0) > 0, x.std(0), 1)
        best = None
        for k in range(1, most + 1):
            f = fit_mixture(x / scale, k)
            bic = -2 * f[0] + _parameters(k, x.shape[1]) * np.log(len(x))
            if best is None or bic < best[0]:
                best = (bic, f)
        _, (_, weights, means, _) = best
        return pd.DataFrame(rows_of([pdf[g].iloc[0] for g in group], len(x), weights, means * scale), columns=columns)

    spreads = [F.stddev_pop(F.col(f).cast("double")).alias(f"__s{i}") for i, f in enumerate(features)]
    large = ok.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), *spreads).filter((F.col("__n") > rows_per_group) & (F.col("__n") >= least_rows)).drop("__n").withColumn("__g", F.monotonically_increasing_id())
    large = cut(large)
    names = {r["__g"]: r for r in large.collect()}
    if not names:
        return ok.groupBy(*group).applyInPandas(fit, schema)
    same = [ok[g].eqNullSafe(large[g]) for g in group]
    small = ok.join(F.broadcast(large), same, "left_anti")
    scaled = F.array(*[F.col(f).cast("double") / F.when(F.col(f"__s{i}") > 0, F.col(f"__s{i}")).otherwise(1.0) for i, f in enumerate(features)])
    rows = cut(ok.join(F.broadcast(large), same).select(F.col("__g").alias("g"), F.xxhash64(key).alias("h"), ok[key].alias("key"), scaled.alias("x")))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("h", "key"))).filter(F.col("n") <= 64)
    seeds: dict[int, list] = {}
    for r in first.orderBy("g", "n").select("g", "x").collect():
        seeds.setdefault(r["g"], []).append(r["x"])
    found = []
    for g, (n, (_, weights, means, _)) in fit_large_mixtures(rows.select("g", "x"), {g: np.array(x) for g, x in seeds.items()}, most).items():
        scale = np.array([names[g][f"__s{i}"] or 1.0 for i in range(len(features))])
        found += rows_of([names[g][c] for c in group], n, weights, means * scale)
    return small.groupBy(*group).applyInPandas(fit, schema).unionByName(df.sparkSession.createDataFrame(found, schema))
