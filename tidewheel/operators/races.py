"""Races of requests against the pool rows of their cells, block by block: no list of pairs is written down, sorted or sent.

A pair exists only in arrays of a tile, so disk and shuffle are those of the two tables, and of one row for each request and block. Every pair is
weighed and, if its weight is above 0, hashed: the time is that of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.operators import digests, pairs

#: Pool rows of one block and requests that one task holds against it; larger cells are cut by hash into as many blocks as they need.
ROWS, ASKED = 32_768, 65_536
#: Blocks of a Product, whose rows are no more than texts and numbers to the JVM, are so many times as long; requests of one of its tasks.
LONGER, TOGETHER = 4, 8_192

Weigh = Callable[[dict, dict], np.ndarray]


@dataclass(frozen=True)
class Product:
    """A weight that is a product: `base` columns of the row, each of them not below 0; `other` (at most 1) for each of `same` that differs; Gaussians
    exp(-c (p - q)^2) of `near` columns; and the Gaussian of `like` (columns of request and row: c) over the request's `over`, neutral where
    it is missing or `over` is not above 0. Only rows whose `before` is less than the request's count.
    """

    base: Sequence[str]
    same: Mapping[str, float]
    near: Mapping[str, float]
    before: str
    like: Mapping[tuple[str, str], float] = field(default_factory=dict)
    over: str = ""

    @property
    def asks(self) -> list[str]:
        return list(dict.fromkeys([self.before, *self.same, *self.near, *[q for q, _ in self.like], *[c for c in [self.over] if c]]))

    @property
    def rows(self) -> list[str]:
        return list(dict.fromkeys([self.before, *self.same, *self.near, *self.base, *[p for _, p in self.like]]))

    def __call__(self, q: dict, p: dict) -> np.ndarray:
        w = 1.0
        for c in self.base:
            w = w * p[c]
        for c, other in self.same.items():
            w = w * np.where(p[c] == q[c], 1.0, other)
        w = w * np.exp(-sum(k * (p[c] - q[c]) ** 2 for c, k in self.near.items()))
        if self.like:
            with np.errstate(divide="ignore", invalid="ignore"):
                like = np.exp(-sum(k * (p[b] - q[a]) ** 2 for (a, b), k in self.like.items()))
                w = w * np.where(~np.isnan(like) & (q[self.over] > 0), like / q[self.over], 1.0)
        return np.where(p[self.before] < q[self.before], w, 0.0)

    def tasks(self, q: dict, p: dict, heads: np.ndarray, head_lengths: np.ndarray, texts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bytes | None]]:
        """(requests, rows, packed task for the JVM), by places; None for texts that its loops have no room for."""
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            at = at[np.argsort(p[self.before][at], kind="stable")]
            at = at[~np.isnan(p[self.before][at])]
            letters = texts[at].view(np.uint8).reshape(len(at), -1)[:, :length]
            for head in np.unique(head_lengths):
                asked = np.flatnonzero(head_lengths == head)
                first, end = int(head) // 4, (int(head) + int(length) + 3) // 4
                fits = head + length <= digests.BLOCK and end - first <= pairs.TOUCHED
                words = digests.words_of(letters, int(head), int(head + length)) if fits else []
                for i in range(0, len(asked), TOGETHER):
                    some = asked[i : i + TOGETHER]
                    yield some, at, self._task(q, p, heads[some], int(head), words, range(first, end), some, at, ids) if fits and len(at) else None

    def _task(self, q: dict, p: dict, heads: np.ndarray, head: int, words: list, touched: range, some: np.ndarray, at: np.ndarray, ids: np.ndarray) -> bytes:
        block = np.zeros((len(some), 64), np.uint8)
        block[:, :head] = heads.view(np.uint8).reshape(len(some), -1)[:, :head]
        rest = block.view("<u4") + np.array([0 if k in touched else words[k] for k in range(16)], np.uint32)
        row, ask = lambda cs: np.array([p[c][at] for c in cs], np.float64), lambda cs: np.array([q[c][some] for c in cs], np.float64).T
        day = q[self.before][some]
        upto = np.where(np.isnan(day), 0, np.searchsorted(p[self.before][at], day, "left")).astype(np.int32)
        base = np.ones(len(at))
        for c in self.base:
            base = base * p[c][at]
        with np.errstate(divide="ignore", over="ignore", under="ignore"):
            inv = np.where(base > 0, np.minimum(1 / base, 1e28), np.nan)
            inv = np.where(inv < 1e-37, 0, inv).astype(np.float32)  # a bound that is never too low
        ps, qs = [], []
        for c in self.same:
            a, b = p[c][at], q[c][some]
            code = np.unique(np.concatenate([a, b]), return_inverse=True)[1].astype(np.int32)
            ps.append(np.where(np.isnan(a), -1, code[: len(a)])), qs.append(np.where(np.isnan(b), -2, code[len(a) :]))
        over = q[self.over][some].astype(np.float64) if self.over else np.zeros(len(some))
        numbers = lambda xs: np.array(list(xs), np.float64)
        header = np.array([touched.start, len(touched), len(at), len(some), len(self.same), len(self.near), len(self.like)], np.int32)
        return pairs.pack(
            0, header, *[words[k] for k in touched], rest, upto, inv, base, np.array(ps, np.int32), np.array(qs, np.int32).T, numbers(self.same.values()), row(self.near), ask(self.near), numbers(self.near.values()),
            row([b for _, b in self.like]), ask([a for a, _ in self.like]), numbers(self.like.values()), over, ids[at].astype(np.int64),
        )


@dataclass(frozen=True)
class Gauss:
    """A fact, `name`: exp(-c (p - q)^2) over `like` columns (of request and row: c), of rows whose `before` is less than the request's."""

    like: Mapping[tuple[str, str], float]
    before: str
    name: str

    @property
    def asks(self) -> list[str]:
        return [self.before, *[a for a, _ in self.like]]

    @property
    def rows(self) -> list[str]:
        return [self.before, *[b for _, b in self.like]]

    def __call__(self, q: dict, p: dict) -> dict:
        like = np.exp(-sum(k * (p[b] - q[a]) ** 2 for (a, b), k in self.like.items()))
        return {self.name: np.where(p[self.before] < q[self.before], like, np.nan)}

    def tasks(self, q: dict, p: dict) -> Iterator[tuple[slice, np.ndarray, bytes]]:
        """(requests, how many rows each has, packed task for the JVM, whose answer is their sums)."""
        day, ps, qs = p[self.before], np.array([p[b] for _, b in self.like], np.float64), np.array([q[a] for a, _ in self.like], np.float64)
        at = np.flatnonzero(~np.isnan(ps).any(0) & ~np.isnan(day))
        at = at[np.argsort(day[at], kind="stable")]
        ps, c = ps[:, at], np.array(list(self.like.values()), np.float64)
        none = np.isnan(qs).any(0) | np.isnan(q[self.before])
        upto = np.where(none, 0, np.searchsorted(day[at], q[self.before], "left")).astype(np.int32)
        qs = np.where(none, 0.0, qs)
        ends = (ps.min(1), ps.max(1)) if len(at) else (np.zeros(len(c)),) * 2
        far = (c[:, None] * np.maximum(np.abs(qs - ends[0][:, None]), np.abs(qs - ends[1][:, None])) ** 2).sum(0)  # no exponent is above it
        for i in range(0, len(upto), TOGETHER):
            s = slice(i, i + TOGETHER)
            yield s, upto[s], pairs.pack(1, np.array([len(at), len(upto[s]), len(c)], np.int32), upto[s], ps, qs[:, s].T, c, far[s])


def _cut(df: DataFrame, cell: Sequence[str], size: int, out: str) -> DataFrame:
    """(cell, out) of the cells with more than `size` rows: how many blocks they need. Such cells are few, so the list is broadcast."""
    n = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > size)
    return F.broadcast(n.select(*cell, F.ceil(F.col("__n") / size).cast("int").alias(out)))


def _dealt(df: DataFrame, key: str, own: DataFrame, other: DataFrame, cell: Sequence[str], mine: str, theirs: str) -> DataFrame:
    """`df` with its own block by hash as `mine`, once for each block of the other side as `theirs`."""
    dealt = df.join(own, list(cell), "left").join(other, list(cell), "left")
    n = lambda c: F.coalesce(c, F.lit(1))
    dealt = dealt.withColumn(mine, F.pmod(F.xxhash64(key), n(F.col(f"__n{mine}"))).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), n(F.col(f"__n{theirs}")) - 1)))
    return dealt.drop(f"__n{mine}", f"__n{theirs}")


def blocks(requests: DataFrame, pool: DataFrame, cell: Sequence[str], request: str, row: str, work: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType, longer: int = 1) -> DataFrame:
    """The results of `work`(requests, rows) for every block of requests and rows of a cell. A NULL in a cell meets nothing."""
    full = " and ".join(f"`{c}` is not null" for c in cell)
    asked, rows = requests.filter(f"{full} and `{request}` is not null"), pool.filter(f"{full} and `{row}` is not null")
    row_cuts, ask_cuts = _cut(rows.select(*cell), cell, ROWS * longer, "__n__b"), _cut(asked.select(*cell), cell, ASKED, "__n__a")
    by = [*cell, "__b", "__a"]
    left = _dealt(asked, request, ask_cuts, row_cuts, cell, "__a", "__b").groupBy(*by)
    right = _dealt(rows, row, row_cuts, ask_cuts, cell, "__b", "__a")
    right = right.select(*[F.col(c).alias(f"p_{c}") for c in right.columns]).groupBy(*[f"p_{c}" for c in by])  # both sides may come of one table
    return left.cogroup(right).applyInArrow(lambda a, b: work(a, b.rename_columns([c[2:] for c in b.column_names])), schema)


def arrays(left: pa.Table, right: pa.Table, asks: Sequence[str], rows: Sequence[str]) -> tuple[dict, dict]:
    """Columns for a weight: numbers as they are, with NULL as NaN; texts as codes that both sides share."""
    codes = {}

    def one(column: pa.ChunkedArray) -> np.ndarray:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_large_string(kind):
            return np.array([np.nan if x is None else codes.setdefault(x, len(codes)) for x in column.to_pylist()], np.float64)
        if pa.types.is_date(kind):
            column = column.cast(pa.int32())
        if pa.types.is_boolean(column.type):
            column = column.cast(pa.int8())
        return column.to_numpy() if pa.types.is_int64(column.type) and not column.null_count else column.cast(pa.float64(), safe=False).to_numpy()

    return {c: one(left.column(c)) for c in asks}, {c: one(right.column(c)) for c in rows}


def _texts(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of a column of integers or texts, as they are written."""
    if not (pa.types.is_integer(column.type) or pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        raise ValueError(f"{column.type} has no text that engines agree on")
    b = column.cast(pa.string()).cast(pa.binary())
    lengths = pc.binary_length(b).to_numpy()
    return np.array(b.to_pylist(), f"S{max(1, lengths.max(initial=0))}"), lengths


def _alike(p: dict, n: int) -> tuple[dict, np.ndarray | None]:
    """The distinct combinations of the rows' columns with their places, where they are few: they are weighed once each."""
    code, size = np.zeros(n, np.int64), 1
    for v in p.values():
        u, inv = np.unique(v, return_inverse=True)
        size *= len(u)
        if size > n:
            code, inv2 = np.unique(code * len(u) + inv, return_inverse=True)
            code, size = inv2, len(code)
            if size > n // 8:
                return p, None
        else:
            code = code * len(u) + inv
    _, at, place = np.unique(code, return_index=True, return_inverse=True)
    return ({c: v[at] for c, v in p.items()}, place) if len(at) <= n // 8 else (p, None)


def _tile(heads: list[bytes], own: list, words: list, w: np.ndarray, ok: np.ndarray, ids, best: np.ndarray):
    """For the pairs of a tile: (requests, rows, keys) that may be the least of their request; all requests' heads have one length.

    The first 32 bits of a hash bound its key from below. Only pairs whose bound is not above the key of some pair of their request are hashed to the end.
    """
    ri, pi = np.nonzero(ok)
    if not len(ri):
        return ri, pi, np.empty(0)
    if len(heads) == 1:
        flat = w[0] if len(pi) == w.shape[1] else w[0][pi]
        take = (lambda x: x) if len(pi) == w.shape[1] else (lambda x: x[pi])
        mine = own[0]
        full = [take(x) + np.uint32(h) if isinstance(x, np.ndarray) and h else take(x) if isinstance(x, np.ndarray) else x + h for x, h in zip(words, mine)]
    else:
        flat = w[ri, pi]
        full = []
        for k, x in enumerate(words):
            h = np.array([o[k] for o in own], np.uint32)
            x = x[pi] if isinstance(x, np.ndarray) else x
            full.append((x + h[ri] if isinstance(x, np.ndarray) else h[ri] + np.uint32(x)) if h.any() else x)
    n = len(ri)
    state, first = digests.leading(full, n)
    # -ln(1 - u) >= u; the factor leaves room for its rounding.
    with np.errstate(over="ignore", divide="ignore"):
        low = first * (2.0**-32 * (1 - 1e-6)) / flat
        starts = np.flatnonzero(np.r_[True, ri[1:] != ri[:-1]]) if len(heads) > 1 else np.zeros(1, np.int64)
        least = np.full(len(heads), np.inf)
        least[ri[starts]] = np.minimum.reduceat(low, starts)
        key = lambda at: -np.log(1 - digests.uniform(full, state, first, at)) / flat[at]
        some = np.flatnonzero(low <= least[ri]) if len(heads) > 1 else np.array([low.argmin()])
        bound = best.copy()
        np.minimum.at(bound, ri[some], key(some))
        left = np.flatnonzero(low <= (bound[ri] if len(heads) > 1 else bound[0]))
        return ri[left], pi[left], key(left)


def winners(q: dict, p: dict, heads: np.ndarray, head_lengths: np.ndarray, texts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, weigh: Weigh) -> tuple[np.ndarray, np.ndarray]:
    """(key, row's place) of the least key of every request; place -1 where no weight is above 0. Equal keys fall to the least of `ids`."""
    best, at = np.full(len(heads), np.inf), np.full(len(heads), -1)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        few, place = _alike({c: v[rows] for c, v in p.items()}, len(rows))
        letters = texts[rows].view(np.uint8).reshape(len(rows), -1)[:, :length]
        for head in np.unique(head_lengths):
            asked = np.flatnonzero(head_lengths == head)
            fits = head + length <= digests.BLOCK
            words = digests.words_of(letters, int(head), int(head + length)) if fits else None
            step = max(1, digests.TILE // len(rows))
            for i in range(0, len(asked), step):
                some = asked[i : i + step]
                names = [bytes(x)[:head].ljust(head, b"\0") for x in heads[some]]
                own = [digests.head_words(x) for x in names] if fits else None
                mine = {c: v[some][:, None] for c, v in q.items()}
                wide = np.broadcast_to(weigh(mine, {c: v[None, :] for c, v in few.items()}), (len(some), len(rows) if place is None else len(next(iter(few.values())))))
                for j in range(0, len(rows), digests.TILE):
                    cut = slice(j, j + digests.TILE)
                    w = wide[:, cut] if place is None else wide[:, place[cut]]
                    ok = (w > 0) & (w < np.inf)
                    if fits:
                        ri, pi, key = _tile(names, own, [x[cut] if isinstance(x, np.ndarray) else x for x in words], w, ok, ids, best[some])
                    else:
                        ri, pi = np.nonzero(ok)
                        with np.errstate(over="ignore", divide="ignore"):
                            key = np.array([-np.log(1 - digests.plain(names[r] + letters[j + k].tobytes())) for r, k in zip(ri, pi)]) / w[ri, pi]
                    for r, k, x in zip(ri.tolist(), rows[j + pi].tolist(), key.tolist()):
                        s = some[r]
                        if at[s] < 0 or x < best[s] or (x == best[s] and ids[k] < ids[at[s]]):
                            best[s], at[s] = x, k
    return best, at


def race(requests: DataFrame, pool: DataFrame, cell: Sequence[str], request: str, row: str, weigh: Weigh, asks: Sequence[str], rows: Sequence[str], carry: Sequence[str], salt: str, keep: Sequence[str] = ()) -> DataFrame:
    """(request, keep..., carry...) of the pool row drawn for each request from its cell; requests whose weights are all 0, NULL or not finite draw nothing.

    As draws.race over draws.candidates, with the weight as a function of arrays: `weigh`(request columns `asks` as a column vector, pool columns
    `rows` as a row vector) gives the weights of a tile. `keep` are further columns of the request, the same wherever its id is.
    """
    asked = requests.select(*dict.fromkeys([request, *cell, *asks, *keep]))
    pooled = pool.select(*dict.fromkeys([row, *cell, *rows, *carry]))
    kind = {**{f"q_{f.name}": f.dataType for f in asked.schema}, **{f"p_{f.name}": f.dataType for f in pooled.schema}}
    names = {f"c{i}": c for i, c in enumerate(carry)}
    schema = T.StructType([T.StructField(request, kind[f"q_{request}"]), *[T.StructField(f"k{i}", kind[f"q_{c}"]) for i, c in enumerate(keep)], T.StructField("key", T.DoubleType()), T.StructField("row", kind[f"p_{row}"]), *[T.StructField(n, kind[f"p_{c}"]) for n, c in names.items()]])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = [request, *[f"k{i}" for i in range(len(keep))], "key", "row", *names]
        if left.num_rows and right.num_rows:
            q, p = arrays(left, right, asks, rows)
            heads, head_lengths = _texts(pc.binary_join_element_wise(pa.scalar(salt), left.column(request).cast(pa.string()), pa.scalar(""), pa.scalar("|")))
            texts, lengths = _texts(right.column(row))
            ids = right.column(row).to_numpy()
            key, at = winners(q, p or {"__": np.zeros(len(ids))}, heads, head_lengths, texts, lengths, ids, weigh)
        else:
            key, at = np.empty(0), np.empty(0, np.int64)
        won = np.flatnonzero(at >= 0)
        a, b = left.take(won), right.take(at[won])
        return pa.Table.from_arrays([a.column(request), *[a.column(c) for c in keep], pa.chunked_array([key[won]], pa.float64()), b.column(row), *[b.column(c) for c in carry]], names=columns)

    made = pairs.function(requests.sparkSession) if isinstance(weigh, Product) and kind[f"p_{row}"] == T.LongType() else None
    met = blocks(asked, pooled, cell, request, row, work, schema) if made is None else _in_jvm(asked, pooled, cell, request, row, weigh, asks, rows, list(names.values()), salt, keep, schema, made)
    best = F.min(F.struct("key", "row", *names, *[f"k{i}" for i in range(len(keep))])).alias("b")
    return met.groupBy(request).agg(best).select(request, *[F.col(f"b.k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"b.{n}").alias(c) for n, c in names.items()])


def _written(t: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def _in_jvm(asked: DataFrame, pooled: DataFrame, cell, request, row, weigh: Product, asks, rows, carry, salt, keep, schema: T.StructType, made) -> DataFrame:
    """The race of each block with its loops in the JVM: blocks are packed here, and what is found is looked up here again."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            q, p = arrays(left, right, asks, rows)
            heads, head_lengths = _texts(pc.binary_join_element_wise(pa.scalar(salt), left.column(request).cast(pa.string()), pa.scalar(""), pa.scalar("|")))
            texts, lengths = _texts(right.column(row))
            ids = right.column(row).to_numpy()
            for some, at, task in weigh.tasks(q, p, heads, head_lengths, texts, lengths, ids):
                done = None
                if task is None:
                    key, place = winners({c: v[some] for c, v in q.items()}, {c: v[at] for c, v in p.items()}, heads[some], head_lengths[some], texts[at], lengths[at], ids[at], weigh)
                    done = key.tobytes() + place.astype(np.int32).tobytes()
                out.append((_written(left.select(list(dict.fromkeys([request, *keep]))).take(some)), _written(right.select(list(dict.fromkeys([row, *carry]))).take(at)), task, done))
        return pa.table({n: pa.array([o[i] for o in out], pa.binary()) for i, n in enumerate(("asked", "rows", "task", "done"))})

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found in zip(*[batch.column(i) for i in range(3)]):
                a, b = pa.ipc.open_stream(a.as_buffer()).read_all(), pa.ipc.open_stream(b.as_buffer()).read_all()
                key = np.frombuffer(found.as_buffer(), np.float64, a.num_rows)
                at = np.frombuffer(found.as_buffer(), np.int32, a.num_rows, 8 * a.num_rows)
                won = np.flatnonzero(at >= 0)
                x, y = a.take(won), b.take(at[won])
                t = pa.Table.from_arrays([x.column(request), *[x.column(c) for c in keep], pa.chunked_array([key[won]], pa.float64()), y.column(row), *[y.column(c) for c in carry]], names=schema.names)
                yield from t.combine_chunks().to_batches()

    packed = blocks(asked, pooled, cell, request, row, work, T.StructType([T.StructField(n, T.BinaryType()) for n in ("asked", "rows", "task", "done")]), LONGER)
    return packed.select("asked", "rows", F.coalesce(made(F.col("task")), "done").alias("found")).mapInArrow(told, schema)


def means(requests: DataFrame, pool: DataFrame, cell: Sequence[str], request: str, row: str, facts: Callable[[dict, dict], dict], asks: Sequence[str], rows: Sequence[str], names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(request, keep..., n_..., s_... for each name): over the rows of its cell, how many of the fact's values are numbers, and their sum. No hash is made."""
    asked = requests.select(*dict.fromkeys([request, *cell, *asks, *keep]))
    pooled = pool.select(*dict.fromkeys([row, *cell, *rows]))
    fields = [f"{k}_{n}" for n in names for k in "ns"]
    schema = T.StructType([*[T.StructField(c, asked.schema[c].dataType) for c in (request, *keep)], *[T.StructField(f, T.DoubleType()) for f in fields]])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {f: np.zeros(left.num_rows) for f in fields}
        if right.num_rows:
            q, p = arrays(left, right, asks, rows)
            step = max(1, digests.TILE // right.num_rows)
            for i in range(0, left.num_rows, step):
                got = facts({c: v[i : i + step, None] for c, v in q.items()}, {c: v[None, :] for c, v in p.items()})
                for n in names:
                    there = ~np.isnan(got[n])
                    out[f"n_{n}"][i : i + step] = there.sum(1)
                    out[f"s_{n}"][i : i + step] = np.where(there, got[n], 0.0).sum(1)
        return pa.Table.from_arrays([*[left.column(c) for c in (request, *keep)], *[pa.chunked_array([out[f]], pa.float64()) for f in fields]], names=[request, *keep, *fields])

    def packed(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            out = [(_written(left.select(list(dict.fromkeys([request, *keep]))).slice(s.start, len(n))), n.astype(np.float64).tobytes(), task) for s, n, task in facts.tasks(*arrays(left, right, asks, rows))]
        return pa.table({n: pa.array([o[i] for o in out], pa.binary()) for i, n in enumerate(("asked", "n", "task"))})

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n, sums in zip(*[batch.column(i) for i in range(3)]):
                a = pa.ipc.open_stream(a.as_buffer()).read_all()
                numbers = [pa.chunked_array([np.frombuffer(x.as_buffer(), np.float64)]) for x in (n, sums)]
                yield from pa.Table.from_arrays([*[a.column(c) for c in (request, *keep)], *numbers], names=[request, *keep, *fields]).combine_chunks().to_batches()

    made = pairs.function(requests.sparkSession) if isinstance(facts, Gauss) else None
    if made is None:
        met = blocks(asked, pooled, cell, request, row, work, schema)
    else:
        met = blocks(asked, pooled, cell, request, row, packed, T.StructType([T.StructField(n, T.BinaryType()) for n in ("asked", "n", "task")]), LONGER)
        met = met.select("asked", "n", made(F.col("task")).alias("sums")).mapInArrow(told, schema)
    return met.groupBy(request, *keep).agg(*[F.sum(f).alias(f) for f in fields])
