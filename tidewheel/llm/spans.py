"""Long exact spans that records share, by suffix automata of reference shards.

Every text is sampled by winnowing: any span of `min_chars` contains, wherever it stands, the same rarest-hash windows. Only texts that have
such an anchor in common can share a span, and only around their shared anchors. The texts around shared anchors are dealt out to shards with
the texts they may match; each shard builds the suffix automata of its reference texts, streams the others through them for matching
statistics, and cuts out the maximal spans that are long enough. Automata read blocks of characters with content-defined bounds instead of
single characters; a match is then carried on character by character at both ends, so the result is exact.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.session import cut, parallelism, ship

MIN_CHARS = 240
#: Characters that are hashed at once, to bound a worker's memory; longer texts go through in overlapping pieces.
PIECE = 1 << 19
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_hashes(points: np.ndarray, width: int) -> np.ndarray:
    """Mixed polynomial hash of every window of `width` code points; equal windows have equal hashes in every text."""
    n = len(points)
    total = np.zeros(n + 1, np.uint64)
    size = 1 << max(10, (n + 1).bit_length())
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers(size, BASE)[:n], out=total[1:])
    x = (total[width:] - total[:-width]) * _powers(size, INVERSE)[: max(n - width + 1, 0)]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window, by doubling."""
    step, y = 1, x
    while step * 2 <= width:
        y = np.minimum(y[:-step], y[step:])
        step *= 2
    return np.minimum(y[: len(x) - width + 1], y[width - step : width - step + len(x) - width + 1]) if width > step else y


def sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    return ~sliding_min(~x, width)


def anchors_of(texts: list[str], min_chars: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, position, hash) of the anchors: the window hashes of half the span's length that are least among as many neighbours.

    A span of min_chars holds a whole set of neighbouring windows, whose least hash is an anchor in every text that has the span.
    """
    width = min_chars // 2
    among = min_chars - width + 1
    texts = [t if len(t) >= min_chars else "" for t in texts]
    start = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    whole = code_points("".join(texts))
    places, hashes = [], []
    lo = 0
    while lo + min_chars <= len(whole):
        hi = min(len(whole), lo + PIECE)
        x = window_hashes(whole[lo:hi], width)
        least = sliding_min(x, among)
        begin = lo + np.arange(len(least))
        doc = np.searchsorted(start, begin, "right") - 1
        least[begin + min_chars > start[doc + 1]] = 0  # these windows reach into the next text
        around = sliding_max(np.concatenate([np.zeros(among - 1, np.uint64), least, np.zeros(among - 1, np.uint64)]), among)
        at = np.flatnonzero(around == x)  # least in one of the windows around it
        places.append(at + lo)
        hashes.append(x[at])
        if hi == len(whole):
            break
        lo = hi - min_chars + 1
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    doc = np.searchsorted(start, at, "right") - 1
    return doc, at - start[doc], np.concatenate(hashes)[first].view(np.int64)


class Automaton:
    """Suffix automaton of a sequence of symbols, with the end of each state's first occurrence."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end, self.cloned = [-1], [0], [-1], [False]
        self._children: list[list[int]] | None = None
        self.symbols, self._by_follower = symbols, {}
        nxt, link, length, end, cloned = self.next, self.link, self.length, self.end, self.cloned
        last = 0
        for i, c in enumerate(symbols):
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            end.append(i)
            cloned.append(False)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    twin = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    end.append(end[q])
                    cloned.append(True)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur

    def ends(self, state: int) -> list[int]:
        """The ends of all occurrences of a state's strings."""
        if self._children is None:
            self._children = [[] for _ in self.next]
            for v in range(1, len(self.next)):
                self._children[self.link[v]].append(v)
        out, todo = [], [state]
        while todo:
            v = todo.pop()
            if not self.cloned[v]:
                out.append(self.end[v])
            todo.extend(self._children[v])
        return out

    def matches(self, symbols: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of every longest match that the next symbol cannot carry on: the peaks of the matching statistics."""
        nxt, link, length = self.next, self.link, self.length
        v = size = 0
        for i, c in enumerate(symbols):
            if c not in nxt[v]:
                if size:
                    yield i - 1, size, v
                while v and c not in nxt[v]:
                    v = link[v]
                    size = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                size += 1
        if size:
            yield len(symbols) - 1, size, v

    def occurrences(self, symbols: list[int], starts: list[int]) -> Iterator[tuple[int, list[int]]]:
        """(end, ends here): where symbols[starts[end] : end + 1] stands here and the next symbol does not carry the match on. Starts never fall."""
        nxt, link, length = self.next, self.link, self.length
        v = size = 0
        for i, (c, start) in enumerate(zip(symbols, starts)):
            while v and c not in nxt[v]:
                v = link[v]
                size = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                size += 1
            if size > i + 1 - start:
                size = max(i + 1 - start, 0)
                while v and length[link[v]] >= size:
                    v = link[v]
            if size and size == i + 1 - start:
                after = symbols[i + 1] if i + 1 < len(symbols) else None
                for symbol, ends in self._followers(v).items():
                    if symbol != after or symbol is None:
                        yield i, ends

    def _followers(self, state: int) -> dict[int | None, list[int]]:
        """The ends of a state's strings by the symbol behind them, None at the end of all."""
        if state not in self._by_follower:
            out: dict[int | None, list[int]] = {}
            for end in self.ends(state):
                out.setdefault(self.symbols[end + 1] if end + 1 < len(self.symbols) else None, []).append(end)
            self._by_follower[state] = out
        return self._by_follower[state]


def block_bounds(text: str, fine: bool = False) -> list[int]:
    """Cuts of a text into blocks of about 8 characters, each placed by the four characters before it; with `fine` every character is one."""
    n = len(text)
    if fine:
        return list(range(n + 1))
    c = code_points(text).astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for k, m in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)):
        h[k:] += c[: n - k] * np.uint64(m)
    h = (h * np.uint64(BASE)) >> np.uint64(61)
    cuts = np.flatnonzero(h[3:] == 0) + 4 if n > 3 else np.zeros(0, np.int64)
    return np.unique(np.concatenate([[0], cuts, [n]])).tolist()


class Reference:
    """One text's shared stretches with their automaton; pieces are (start in the text, characters)."""

    def __init__(self, pieces: list[tuple[int, str]], min_chars: int = MIN_CHARS):
        self.pieces, self.min_chars, self.forms = pieces, min_chars, {}

    def _form(self, fine: bool):
        if fine not in self.forms:
            ids: dict[str, int] = {}
            seq = _Blocks(self.pieces, fine, lambda b: ids.setdefault(b, len(ids)), odd=True)
            self.forms[fine] = ids, seq, Automaton(seq.symbols)
        return self.forms[fine]

    def spans(self, other: list[tuple[int, str]], one: bool = False) -> list[tuple[int, int, int]]:
        """(start here, start there, length) of the maximal spans of at least min_chars that `other` shares with the reference.

        With `one` the first that is found is enough.
        """
        ids, seq, automaton = self._form(False)
        theirs = _Blocks(other, False, lambda b: ids.get(b, -1))
        if max(seq.widest, theirs.widest) > self.min_chars // 3:  # a stretch without cuts: blocks would not do
            ids, seq, automaton = self._form(True)
            theirs = _Blocks(other, True, lambda b: ids.get(b, -1))
        found = set()
        for lo, hi, ends in self._peaks(automaton, theirs) if seq.fine else self._cores(automaton, theirs):
            for mine in ends:
                here = seq.bounds[mine][1] - (hi - lo)
                left, right = _extend(seq.text, here, here + hi - lo, theirs.text, lo, hi)
                if hi - lo + left + right >= self.min_chars:
                    found.add((seq.origin(here - left), theirs.origin(lo - left), hi - lo + left + right))
                    if one:
                        return list(found)
        return sorted(found)

    def _peaks(self, automaton: Automaton, theirs: _Blocks) -> Iterator[tuple[int, int, list[int]]]:
        """Character by character, the longest matches cover all that is shared."""
        for end, size, state in automaton.matches(theirs.symbols):
            lo, hi = theirs.bounds[end - size + 1][0], theirs.bounds[end][1]
            if hi - lo >= self.min_chars:
                yield lo, hi, automaton.ends(state)

    def _cores(self, automaton: Automaton, theirs: _Blocks) -> Iterator[tuple[int, int, list[int]]]:
        """All places of the shortest stretches of blocks that can belong to a span of min_chars.

        Such a span may go on in the blocks beside its whole ones, to the left up to four characters further, as a cut depends on these. So a
        longer match of blocks elsewhere in the reference may give a shorter span, and every place has to be extended.
        """
        begin = [lo for lo, _ in theirs.bounds]
        room = [hi for _, hi in theirs.bounds[1:]] + [hi for _, hi in theirs.bounds[-1:]]  # the end of the block behind
        starts = [max(bisect_right(begin, hi + 4 - self.min_chars), 0) for hi in room]
        for end, ends in automaton.occurrences(theirs.symbols, starts):
            yield begin[starts[end]], theirs.bounds[end][1], ends


class _Blocks:
    """Pieces as one text with breaks between them, cut into blocks; a break is a symbol that never matches: odd ones stand in the reference."""

    BREAK = "\U0010FFFF"

    def __init__(self, pieces: list[tuple[int, str]], fine: bool, symbol, odd: bool = False):
        self.text = self.BREAK.join(t for _, t in pieces)
        self.starts, self.symbols, self.bounds, self.widest = [], [], [], 0
        self.fine, at = fine, 0
        for k, (start, text) in enumerate(pieces):
            if k:
                self.symbols.append(-2 * k - odd)
                self.bounds.append((at, at + 1))
                at += 1
            self.starts.append((at, start))
            cuts = block_bounds(text, fine)
            for lo, hi in zip(cuts, cuts[1:]):
                self.symbols.append(symbol(text[lo:hi]))
                self.bounds.append((at + lo, at + hi))
                self.widest = max(self.widest, hi - lo)
            at += len(text)

    def origin(self, at: int) -> int:
        """Place in the whole text of a place in the joined pieces."""
        base, start = max((b for b in self.starts if b[0] <= at), key=lambda b: b[0])
        return start + at - base


def _extend(a: str, a_lo: int, a_hi: int, b: str, b_lo: int, b_hi: int) -> tuple[int, int]:
    """How many more characters agree to the left and to the right of equal stretches, up to a break."""
    left = right = 0
    stop, step = _Blocks.BREAK, 64
    while left + step <= min(a_lo, b_lo) and (part := a[a_lo - left - step : a_lo - left]) == b[b_lo - left - step : b_lo - left] and stop not in part:
        left += step
    while left < a_lo and left < b_lo and a[a_lo - left - 1] == b[b_lo - left - 1] != stop:
        left += 1
    while (part := a[a_hi + right : a_hi + right + step]) == b[b_hi + right : b_hi + right + step] and len(part) == step and stop not in part:
        right += step
    while a_hi + right < len(a) and b_hi + right < len(b) and a[a_hi + right] == b[b_hi + right] != stop:
        right += 1
    return left, right


def _anchor_rows(min_chars: int):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lo = 0
            while lo < len(ids):
                hi, size = lo, 0
                while hi < len(ids) and (hi == lo or size + len(texts[hi]) <= PIECE):
                    size += len(texts[hi])
                    hi += 1
                doc, at, h = anchors_of(texts[lo:hi], min_chars)
                offsets = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)), pa.int32())
                digest = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts[lo:hi]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi], pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(h, pa.int64()))],
                    names=["doc_id", "same", "at", "hash"],
                )
                lo = hi

    return run


def text_classes(docs: DataFrame, doc_id: str, text: str, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(anchors, members): anchors (doc_id, at, hash) of one document of each distinct text, and (doc_id, rep) of all documents.

    Only texts of min_chars or more can share a span; NULL, empty and shorter ones take no part. Repeated rows change nothing; doc_id names
    one text.
    """
    ship(docs.sparkSession)
    rows = docs.filter(F.col(doc_id).isNotNull() & (F.length(text) >= min_chars)).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = cut(rows.mapInArrow(_anchor_rows(min_chars), "doc_id long, same binary, at array<int>, hash array<long>"))
    reps = made.groupBy("same").agg(F.min("doc_id").alias("rep"))
    members = made.select("doc_id", "same").join(reps, "same").select("doc_id", "rep").distinct()
    own = made.join(reps.select(F.col("rep").alias("doc_id"), "same"), ["doc_id", "same"], "left_semi").dropDuplicates(["doc_id"])
    return own.select("doc_id", F.explode(F.arrays_zip("at", "hash")).alias("x")).select("doc_id", "x.at", "x.hash"), members


BITS = 1 << 23


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bits of the hashed ids, of fixed size whatever their number: a first sieve in front of a join."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS)) + 1
    rows = ids.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(BITS, bool)
    for r in rows:
        base = (r["bucket"] - 1) * 32768
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")[: BITS - base]
        out[base : base + len(bits)] = bits.astype(bool)
    return np.packbits(out)


def _piece_rows(min_chars: int):
    """Cuts the stretches around shared anchors out of whole texts: rows (doc_id, at, text) with the anchors' places to (doc_id, starts, texts)."""
    width = min_chars // 2
    among = min_chars - width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, texts = (batch.column(i).to_pylist() for i in range(3))
            starts, cuts = [], []
            for at, text in zip(places, texts):
                at = sorted(at)
                s, c, lo, hi = [], [], None, None
                for p in at:
                    a, b = max(0, p - among + 1), min(len(text), p + width + among - 1)
                    if lo is not None and a <= hi:
                        hi = max(hi, b)
                        continue
                    if lo is not None:
                        s.append(lo), c.append(text[lo:hi])
                    lo, hi = a, b
                s.append(lo), c.append(text[lo:hi])
                starts.append(s), cuts.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(cuts, pa.list_(pa.string()))], names=["doc_id", "starts", "texts"])

    return run


#: Partners that one task matches against one reference, and holders of an anchor that one task pairs; more are spread over several tasks.
PARTNERS = 256


def _stretches(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, places, pieces): text classes, the anchors (hash, doc_id, at) that several texts have, and the stretches of text around them."""
    anchors, members = text_classes(docs, doc_id, text, min_chars)
    shared = anchors.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("hash")
    places = cut(anchors.select("doc_id", "at", "hash").join(shared, "hash", "left_semi"))
    wanted = places.groupBy("doc_id").agg(F.collect_set("at").alias("at"))
    sieve = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select("doc_id")))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(sieve.value)
        for batch in batches:
            yield batch.filter(pa.array(bits[batch.column(2).to_numpy()] == 1)).select([0, 1])

    whole = docs.filter(F.col(doc_id).isNotNull() & (F.length(text) >= min_chars)).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    likely = whole.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).cast("int")).mapInArrow(sift, "doc_id long, text string")
    pieces = cut(likely.join(wanted, "doc_id").select("doc_id", "at", "text").mapInArrow(_piece_rows(min_chars), "doc_id long, starts array<int>, texts array<string>").dropDuplicates(["doc_id"]))
    return members, places, pieces


def _matched(pairs: DataFrame, pieces: DataFrame, min_chars: int, one: bool) -> DataFrame:
    """(a, b, a_start, b_start, length) of the spans that each pair (a, b) shares, found by streaming b through the automaton of a.

    The partners of a reference are dealt out by hash into shards of about PARTNERS, so a reference with any number of them is spread.
    """
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("shards"))
    slots = cut(pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shards")).cast("int").alias("slot")))
    partners = slots.join(pieces.withColumnRenamed("doc_id", "b"), "b").select("a", "slot", F.lit(1).alias("kind"), F.col("b").alias("doc"), "starts", "texts")
    references = slots.select("a", "slot").distinct().join(pieces.withColumnRenamed("doc_id", "a"), "a").select("a", "slot", F.lit(0).alias("kind"), F.col("a").alias("doc"), "starts", "texts")
    ordered = references.unionByName(partners).repartition(parallelism(pairs.sparkSession), "a", "slot").sortWithinPartitions("a", "slot", "kind", "doc")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reference, of = None, None
        for pdf in batches:
            out = []
            for a, slot, kind, doc, starts, texts in pdf.itertuples(index=False):
                pieces_of = list(zip([int(x) for x in starts], texts))
                if kind == 0:
                    reference, of = Reference(pieces_of, min_chars), (a, slot)
                elif of == (a, slot):
                    out.extend((a, doc, here, there, size) for here, there, size in reference.spans(pieces_of, one))
            yield pd.DataFrame(out, columns=["a", "b", "a_start", "b_start", "length"]).astype("int64")

    return ordered.mapInPandas(match, "a long, b long, a_start long, b_start long, length long")


def shared_spans(docs: DataFrame, doc_id: str, text: str, min_chars: int = MIN_CHARS, one: bool = False) -> tuple[DataFrame, DataFrame]:
    """(spans, members): spans (a, b, a_start, b_start, length) of at least min_chars that the texts a < b share, and (doc_id, rep).

    Spans are maximal and stand between representatives of distinct texts; members says which document has which text. Every pair that shares
    a span has at least one row, with `one` exactly one. Pairs are made anchor by anchor; the holders of an anchor that very many texts have
    are paired in blocks, so that no task gets all of them. An empty table, or one without long texts, gives no rows.
    """
    members, places, pieces = _stretches(docs, doc_id, text, min_chars)
    holders = places.select("hash", "doc_id").distinct()
    blocks = holders.groupBy("hash").agg(F.ceil(F.count(F.lit(1)) / (4 * PARTNERS)).alias("blocks"))
    dealt = cut(holders.join(blocks, "hash"))
    one_side = dealt.select("hash", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("block"), F.col("doc_id").alias("a"))
    other = dealt.select("hash", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("doc_id").alias("b"))
    pairs = one_side.join(other, ["hash", "block"]).filter("a < b").select("a", "b").distinct()
    return _matched(pairs, pieces, min_chars, one), members


def document_pairs(spans: DataFrame, members: DataFrame, copies: str = "all") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: the pairs of documents that share a span.

    Links between distinct texts hold for their copies too, and copies share everything. With `copies` "all" every pair of documents is written
    out; with "classes" the pairs of representatives, and each copy with its own representative, from which all others follow: this form
    grows with the documents and their links, not with the square of the copies.
    """
    links = spans.select("a", "b").distinct()
    ordered = lambda df: df.filter("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()
    if copies == "classes":
        return ordered(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(members.select(F.col("rep").alias("x"), F.col("doc_id").alias("y"))))
    x, y = members.select(F.col("rep").alias("a"), F.col("doc_id").alias("x")), members.select(F.col("rep").alias("b"), F.col("doc_id").alias("y"))
    across = links.join(x, "a").join(y, "b").select("x", "y")
    within = x.join(y.withColumnRenamed("b", "a"), "a").filter("x < y").select("x", "y")
    return ordered(across.unionByName(within))


def classes(spans: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links): every document of min_chars or more once, with the smallest document of its text, the documents of that text, and
    the other texts that share a span with it."""
    links = spans.select("a", "b").distinct()
    n = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    per = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n_copies")).join(n, "rep", "left")
    return members.join(per, "rep").select("doc_id", F.col("rep").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _window_rows(min_chars: int):
    """Two hashes of every stretch of min_chars characters in the pieces of a text, each once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, texts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                for lo_text in texts:
                    points = code_points(lo_text)
                    for lo in range(0, max(len(points) - min_chars + 1, 1), PIECE):
                        part = points[lo : lo + PIECE + min_chars - 1]
                        both = np.stack([window_hashes(part, min_chars), window_hashes(part ^ np.uint32(0x5A5A5A), min_chars)], 1) if len(part) >= min_chars else np.zeros((0, 2), np.uint64)
                        both = np.unique(both, axis=0).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.full(len(both), doc, np.int64))], names=["h", "g", "doc_id"])

    return run


def coverage(docs: DataFrame, doc_id: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_chars, shared_chars, n_spans) of every document with an id: how many of its characters stand in a span shared with another.

    Coverage needs no pairs of all texts that share a span. Every stretch of min_chars characters that several texts have names one of them
    (the smallest, or for that one the largest), and a text is matched with those that its stretches name: as many pairs at most as it has
    such stretches, whatever the number of texts that have them. n_spans counts the places of the spans so found. A copy of another document is shared as a whole. Texts that are NULL or too short share nothing.
    """
    members, _, pieces = _stretches(docs, doc_id, text, min_chars)
    windows = pieces.mapInArrow(_window_rows(min_chars), "h long, g long, doc_id long")  # cheaper to hash twice than to keep
    shared = windows.groupBy("h", "g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    partner = F.when(F.col("doc_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    pairs = windows.join(shared, ["h", "g"]).select(partner.alias("a"), F.col("doc_id").alias("b")).distinct()
    spans = _matched(pairs, pieces, min_chars, False)
    # The second text's places are complete.
    ends = spans.select(F.col("b").alias("rep"), F.col("b_start").alias("s"), (F.col("b_start") + F.col("length")).alias("e")).distinct()
    w = Window.partitionBy("rep").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    added = ends.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("new", F.greatest(F.lit(0), F.col("e") - F.greatest("s", "before")))
    by_text = added.groupBy("rep").agg(F.sum("new").alias("covered"), F.count(F.lit(1)).alias("spans"))
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    sizes = docs.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.length(text), F.lit(0))).cast("long").alias("n_chars"))
    every = sizes.join(members, "doc_id", "left").join(by_text, "rep", "left").join(copies, "rep", "left")
    shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return every.select(F.col("doc_id").alias(doc_id), "n_chars", shared.cast("long").alias("shared_chars"), F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"))
