"""The k most similar vectors of every vector, by shifted space-filling curves.

Vectors are rotated, shifted and quantised several times over; each time their Hilbert keys put near vectors near each other on a line. The
line is cut into ranges, every range is sorted in its own task together with a margin of its neighbours, and each vector is compared with the
next few on either side. The best of all orderings are merged, and one more round compares every vector with its neighbours' neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.session import cut, ship

#: Vectors that many ids share: such a vector meets its list in slices of SLICE ids if it holds more than a MOST_HOT-th of all.
MOST_HOT, SLICE = 1024, 50_000


@dataclass(frozen=True)
class Curves:
    """How vectors are ordered and compared.

    `orderings` Hilbert orderings, `reach` next vectors on either side, `cells` cells of each line whose bounds come from a sample of at most
    `sample` keys an ordering (an index of the lines only: every vector is placed and compared). A range has about `block_rows` vectors and a
    cell more on either side. The sample also fits the scale of each coordinate. `dims` coordinates at most take part in a key; wider vectors are projected at random.
    """

    orderings: int = 8
    reach: int = 24
    sample: int = 20_000
    block_rows: int = 8_192
    bits: int = 31
    dims: int = 5
    seed: int = 7
    refine: int = 1


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index (as uint64) of integer points, one row each, with `bits` bits a coordinate: bit-plane transposition, all rows at once."""
    x = grid.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > 1:  # undo the excess turns, from the highest plane down
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= one
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


class Lines:
    """The orderings: of each a random rotation (or projection, for wide vectors), a map of every coordinate into [0, 1], a random shift, and
    the bounds of its cells; all of it fitted on a sample of points, and then applied to all points alike.

    A coordinate's map is half its place among the sampled values and half an even scale around their middle that far values enter by their
    logarithm. So neither single far points nor dense clusters decide how fine all the others are told apart.
    """

    LEVELS = np.linspace(0, 1, 1025)

    def __init__(self, sample: np.ndarray, width: int, curves: Curves, cells: int):
        rng = np.random.default_rng(curves.seed)
        keep = min(width, curves.dims)
        self.bits = min(curves.bits, 62 // max(keep, 1))
        self.frames = []
        for _ in range(curves.orderings):
            rotation, shift = np.linalg.qr(rng.standard_normal((width, width)))[0][:, :keep], rng.random(keep)
            y = sample @ rotation
            middle = np.median(y, axis=0) if len(y) else np.zeros(keep)
            spread = np.median(np.abs(y - middle), axis=0) if len(y) else np.ones(keep)
            spread = np.where(spread > 0, spread, np.maximum(np.abs(y - middle).max(0, initial=0), 1e-12))
            z = self._log(y, middle, spread)
            knots = np.quantile(z, self.LEVELS, axis=0) if len(y) else np.zeros((len(self.LEVELS), keep))
            low, high = knots[0], knots[-1]
            if len(y):  # the far tails of the sample do not stretch the scale
                low, high = np.quantile(z, [0.001, 0.999], axis=0)
                low, high = low - (high - low) / 4, high + (high - low) / 4
            self.frames.append((rotation, shift, middle, spread, knots, low, np.maximum(high - low, 1e-12)))
        keys = self.keys(sample)
        # Equal bounds stay: vectors of one key spread over the cells between them.
        self.edges = [np.quantile(keys[:, o], np.linspace(0, 1, cells + 1)[1:-1], method="lower") if len(sample) and cells > 1 else np.zeros(0, np.int64) for o in range(curves.orderings)]

    @staticmethod
    def _log(y: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(np.arcsinh((y - middle) / spread), -1500, 1500)

    def keys(self, points: np.ndarray) -> np.ndarray:
        """(n x orderings) int64 keys."""
        out = []
        for rotation, shift, middle, spread, knots, low, span in self.frames:
            z = self._log(points @ rotation, middle, spread)
            rank = np.stack([np.interp(z[:, j], knots[:, j], self.LEVELS) for j in range(z.shape[1])], 1)
            y = np.clip((z - low) / span, 0, 1) / 2 + rank / 2
            y = np.clip((y + shift) / 2, 0, 1)  # the shift moves the curve's seams
            cells = np.minimum((y * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1)
            out.append(hilbert_keys(cells, self.bits).astype(np.int64))
        return np.stack(out, 1) if len(points) else np.zeros((0, len(self.frames)), np.int64)

    def cells(self, o: int, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Cell of each vector on line o; those of one key go by their ids' hash, in the order in which they are compared."""
        left, right = np.searchsorted(self.edges[o], keys, "left"), np.searchsorted(self.edges[o], keys, "right")
        return left + np.minimum((spread_of(ids) * (right - left + 1)).astype(np.int64), right - left)


def spread_of(ids: np.ndarray) -> np.ndarray:
    """A hash of ids in [0, 1)."""
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _window_best(keys: np.ndarray, ids: np.ndarray, points: np.ndarray, reach: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, in key order, the (positions, distances) of the k nearest of the `reach` rows before and behind it."""
    n = len(keys)
    order = np.lexsort((ids, spread_of(ids), keys))
    p = points[order]
    reach = min(reach, n - 1)
    near, dist = np.full((n, 2 * reach), -1, np.int64), np.full((n, 2 * reach), np.inf)
    for j in range(1, reach + 1):
        with np.errstate(over="ignore"):
            d = np.sqrt(((p[j:] - p[:-j]) ** 2).sum(1))
        near[:-j, 2 * j - 2], dist[:-j, 2 * j - 2] = np.arange(j, n), d
        near[j:, 2 * j - 1], dist[j:, 2 * j - 1] = np.arange(n - j), d
    best = np.argsort(dist, axis=1, kind="stable")[:, :k]
    rows = np.arange(n)[:, None]
    out_near, out_dist = near[rows, best], dist[rows, best]
    back_near, back_dist = np.empty_like(out_near), np.empty_like(out_dist)
    back_near[order], back_dist[order] = np.where(out_near >= 0, order[np.maximum(out_near, 0)], -1), out_dist
    return back_near, back_dist


def _top(lists: DataFrame, k: int) -> DataFrame:
    """(a, near): the k best (d, b) of all lists of every a, equal distances to the smaller b. An a has few lists, each of a bounded length."""
    return lists.groupBy("a").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))


def distinct_points(df: DataFrame, vec_id: str, scaled: Sequence[Column], k: int) -> tuple[DataFrame, DataFrame]:
    """(points, members): each distinct vector once, with its k + 1 smallest ids, and every vec_id with its vector's smallest id.

    Equal vectors are one point, so any number of copies costs no comparison; the ranking of ids stops early on the map side.
    """
    v = F.array(*[c.cast("double") for c in scaled])
    ok = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e150)))
    # Zero has two signs that compare as equal: they are one value here.
    rows = df.filter(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter(ok).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    once = cut(rows.groupBy("id").agg(F.min("v").alias("v")))
    least = once.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    points = least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("a"), "v", "ids")
    return points, once


def nearest(df: DataFrame, vec_id: str, scaled: Sequence[Column], k: int, curves: Curves = Curves()) -> DataFrame:
    """(vec_id, neighbour, rank, distance): the k most similar other vectors of every vector, nearly always the true ones.

    `scaled` are the coordinates, already divided by their scales. Rows with a NULL id, or with a NULL, NaN or infinite coordinate (or one
    of 1e150 and more, whose square would be), take no part; of repeated ids the smallest vector counts. Equal distances go to the smaller id. A vector gets fewer rows only where fewer others
    exist; empty input gives no rows.
    """
    ship(df.sparkSession)
    points, once = distinct_points(df, vec_id, scaled, k)
    points = cut(points)
    width, n = len(scaled), points.count()
    # Cells of the lines: quantiles of a bounded sample of keys, about `reach` vectors or more in each.
    cells = int(max(1, min(n // max(2 * curves.reach, 1), curves.sample)))
    span = int(max(1, curves.block_rows * cells // max(n, 1)))
    share = min(1.0, curves.sample / max(n, 1))
    sampled = (points if share == 1.0 else points.sample(share, curves.seed)).select("v").toPandas()["v"]
    lines = Lines(np.stack(sampled.to_numpy()) if len(sampled) else np.zeros((0, width)), width, curves, cells)
    reach = curves.reach

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their range; those within one cell of another range go there too, marked as guests."""
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, width)
            keys = lines.keys(v)
            for o in range(keys.shape[1]):
                cell = lines.cells(o, keys[:, o], ids)
                for step in (0, -1, 1):
                    home, there = cell // span, (cell + step) // span
                    go = np.flatnonzero(np.ones(len(ids), bool) if step == 0 else (there != home) & (there >= 0))
                    if len(go):
                        offsets = pa.array(np.arange(len(go) + 1, dtype=np.int32) * width)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(go), o, np.int32)), pa.array(there[go]), pa.array(np.full(len(go), step != 0)), pa.array(keys[go, o]), pa.array(ids[go]), pa.ListArray.from_arrays(offsets, pa.array(v[go].ravel()))], names=["o", "block", "guest", "key", "a", "v"])

    def compare(rows: pa.Table) -> pa.Table:
        ids, v = rows.column("a").to_numpy(), rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width)
        home = np.flatnonzero(~rows.column("guest").to_numpy(zero_copy_only=False))
        if len(ids) < 2:
            home = home[:0]
            near, dist = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        else:
            near, dist = _window_best(rows.column("key").to_numpy(), ids, v, reach, k)
        near, dist = near[home], dist[home]
        some = (near >= 0) & np.isfinite(dist)
        offsets = pa.array(np.concatenate([[0], np.cumsum(some.sum(1))]).astype(np.int32))
        pairs = pa.StructArray.from_arrays([pa.array(dist[some]), pa.array(ids[near[some]])], names=["d", "b"])
        return pa.table({"a": pa.array(ids[home], pa.int64()), "near": pa.ListArray.from_arrays(offsets, pairs)})

    ranges = points.select("a", "v").mapInArrow(placed, "o int, block long, guest boolean, key long, a long, v array<double>")
    found = ranges.groupBy("o", "block").applyInArrow(compare, "a long, near array<struct<d:double,b:long>>")
    best = _top(found, k)
    for _ in range(curves.refine):
        best = _refined(cut(best), points, k)
    best = best.withColumnRenamed("a", "rep")
    # From distinct vectors back to ids: copies of a vector are each other's nearest, and bring their smallest ids into others' lists.
    ids_of = points.select(F.col("a").alias("b"), F.col("ids").alias("b_ids"))
    outside = best.select("rep", F.explode("near").alias("x")).select("rep", F.col("x.d").alias("d"), F.col("x.b").alias("b")).join(ids_of, "b").select("rep", F.transform("b_ids", lambda i: F.struct(F.col("d").alias("d"), i.alias("id"))).alias("c"))
    inside = points.select(F.col("a").alias("rep"), F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("id"))).alias("c"))
    lists = outside.unionByName(inside).groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("c"))), 1, k + 1).alias("c"))
    lists = lists.join(points.select(F.col("a").alias("rep"), "v"), "rep").select("v", "c")
    # A vector that holds a large share of all ids meets its list in slices.
    bound = max(n // MOST_HOT, SLICE)
    hot = once.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bound).select("v", F.ceil(F.col("n") / SLICE).alias("slices"))
    sliced = lambda df, salt: df.join(F.broadcast(hot), "v", "left").withColumn("slice", salt(F.coalesce("slices", F.lit(1))))
    lists = sliced(lists, lambda m: F.explode(F.sequence(F.lit(0).cast("long"), m - 1)))
    own = sliced(once, lambda m: F.pmod(F.xxhash64("id"), m)).join(lists.drop("slices"), ["v", "slice"]).select(F.col("id").alias(vec_id), F.slice(F.filter("c", lambda x: x["id"] != F.col("id")), 1, k).alias("c"))
    ranked = own.select(vec_id, F.posexplode("c").alias("rank", "x"))
    return ranked.select(vec_id, F.col("x.id").alias("neighbour"), (F.col("rank") + 1).alias("rank"), F.col("x.d").alias("distance"))


def _refined(best: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Lists after comparing each vector with those near its nearest.

    A vector's sources are its 2 k nearest among its own list and the vectors that list it, so no step grows past 4 k * k rows a vector.
    """
    links = best.select("a", F.explode("near").alias("x")).select("a", "x.d", "x.b")
    both = links.unionByName(links.select(F.col("b").alias("a"), "d", F.col("a").alias("b")))
    w = Window.partitionBy("a").orderBy("d", "b")
    sources = both.distinct().withColumn("n", F.row_number().over(w)).filter(F.col("n") <= 2 * k).drop("n")
    v = points.select("a", "v")
    near = sources.join(v.withColumnRenamed("a", "b").withColumnRenamed("v", "vb"), "b").groupBy("a").agg(F.collect_list(F.struct("b", "vb")).alias("c"))
    # Each vector asks its sources, at most 2 k, for theirs.
    offers = sources.select(F.col("a").alias("to"), F.col("b").alias("via")).join(near.withColumnRenamed("a", "via"), "via").join(v.select(F.col("a").alias("to"), "v"), "to")
    d = lambda p: F.sqrt(F.aggregate(F.zip_with("v", p, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, y: s + y))
    tried = offers.select(F.col("to").alias("a"), F.transform(F.filter("c", lambda x: x["b"] != F.col("to")), lambda x: F.struct(d(x["vb"]).alias("d"), x["b"].alias("b"))).alias("near"))
    return _top(best.select("a", "near").unionByName(tried), k)
