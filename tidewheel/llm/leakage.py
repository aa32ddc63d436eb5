"""Evaluation texts leaking into training text, by latent semantic retrieval.

Texts become passages of a few words each. Passages are TF-IDF vectors over the evaluation set's vocabulary, with document frequencies of the
whole corpus; a distributed randomised SVD of the corpus passages gives a latent space. Passages near an evaluation passage there are
candidates, and a longest common run, a longest common subsequence and a check of the item's rare words decide.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.session import cut, ship

WORD = re.compile(r"[^\W_]+")
#: Evaluation passages that are compared at once, to bound a worker's memory.
STEP = 1024


@dataclass(frozen=True)
class Retrieval:
    """Passages of `window` words every `stride` words, of which at least `known` (in a row, with `in_a_row`; without it, as many as the overlap
    needs) are words of the evaluation set; `rank` latent dimensions from `rounds` rounds of subspace iteration; candidates have as many
    common words as the run or subsequence needs, or with in_a_row a latent cosine of at least `cosine`; without it there is no latent space."""

    window: int = 16
    stride: int = 4
    known: int = 12
    in_a_row: bool = True
    rank: int = 192
    rounds: int = 2
    cosine: float = 0.25
    seed: int = 5
    #: Without in_a_row: least share of an item passage's words in the common subsequence, of its words by rarity, and least length of such a passage.
    overlap: float = 0.0
    facts: float = 0.0
    least_words: int = 0
    #: Items, and words of items, whose vocabulary and passages travel to the tasks at once; more are searched for in several blocks.
    block_items: int = 4096
    block_words: int = 200_000

    @property
    def reach(self) -> int:
        """Words of a document's passage. Without in_a_row it is so wide that any `window` words of a text lie whole in one passage."""
        return self.window if self.in_a_row else self.window + self.stride - 1


@lru_cache(maxsize=1)
def _format_characters() -> re.Pattern:
    chars = [c for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"]
    return re.compile("[" + "".join(re.escape(chr(c)) for c in chars) + "]")


def words_of(text: str | None) -> list[str]:
    """Longest runs of letters and digits after NFKC, removal of format characters and lower-casing; NULL has none."""
    if not text:
        return []
    if not text.isascii():
        text = _format_characters().sub("", unicodedata.normalize("NFKC", text))
    return WORD.findall(text.lower())


def passage_starts(ids: np.ndarray, r: Retrieval) -> np.ndarray:
    """Starts of the passages that can hold what is searched for. The last passage of a text may be shorter than the window.

    A run of `known` words lies within the window that starts at the last multiple of the stride before it, so with in_a_row the passages
    returned hold every such run, and a window without one cannot.
    """
    n = len(ids)
    if n < r.known:
        return np.zeros(0, np.int64)
    inside = np.concatenate([[0], np.cumsum(ids >= 0)])
    if r.in_a_row:
        begins = np.flatnonzero(inside[r.known :] - inside[: -r.known] == r.known)
        return np.unique(begins // r.stride) * r.stride
    starts = np.arange(0, max(n - r.known, 0) + 1, r.stride)
    return starts[inside[np.minimum(starts + r.reach, n)] - inside[starts] >= r.known]


def grid(ids: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """(passages x window) word ids; -1 for words outside of the vocabulary, -2 behind the end."""
    padded = np.concatenate([ids, np.full(window, -2, ids.dtype)])
    return padded[starts[:, None] + np.arange(window)]


def vectors(g: np.ndarray, idf: np.ndarray, basis: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Latent vectors of passages, divided by the length of their TF-IDF vectors over the known words."""
    w, y = _weights(g, idf) if w is None else w, np.zeros((len(g), basis.shape[1]), np.float32)
    for j in range(g.shape[1]):
        y += w[:, j : j + 1] * basis[np.maximum(g[:, j], 0)]
    return y


def _weights(g: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weight of each word place, so that a passage has length 1: repeated words add up, unknown ones weigh nothing."""
    of = lambda ids: np.where(ids >= 0, idf[np.maximum(ids, 0)], np.float32(0))
    words = np.sort(g, axis=1).T.copy()
    weights = of(words)
    square, run = np.zeros(len(g), np.float32), np.zeros(len(g), np.float32)
    for j in range(len(words)):  # equal words stand together: a run of weight r that grows by w adds (r + w)^2 - r^2
        run = run * (words[j] == words[j - 1]) if j else run
        square += weights[j] * (2 * run + weights[j])
        run = run + weights[j]
    return of(g) / np.sqrt(np.maximum(square, 1e-12))[:, None]


def common_run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest run of equal known words in a row, pair by pair."""
    a, b = a.astype(np.int16 if a.max(initial=0) < 32767 else np.int32).T.copy(), b.astype(np.int16 if b.max(initial=0) < 32767 else np.int32).T.copy()
    known = b >= 0
    best, run = np.zeros(a.shape[1], np.int8), np.zeros((len(b) + 1, a.shape[1]), np.int8)
    for word in a:  # row j + 1 of `run`: the run that ends with this word of a and word j of b
        run[1:] = (run[:-1] + np.int8(1)) * ((word[None] == b) & known)
        np.maximum(best, run.max(0), out=best)
    return best.astype(np.int32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of known words, pair by pair."""
    row = np.zeros((len(a), b.shape[1] + 1), np.int32)
    for i in range(a.shape[1]):
        equal, new = (a[:, i : i + 1] == b) & (b >= 0), np.zeros_like(row)
        take = np.where(equal, row[:, :-1] + 1, row[:, 1:])
        for j in range(b.shape[1]):
            new[:, j + 1] = np.maximum(take[:, j], new[:, j])
        row = new
    return row[:, -1]


def _places(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each passage in order, and how often each stands before its place there."""
    words = np.sort(g, axis=1)
    before = np.zeros(words.shape, np.int64)
    for j in range(1, words.shape[1]):
        before[:, j] = (before[:, j - 1] + 1) * (words[:, j] == words[:, j - 1])
    return words, before


def _run_hashes(g: np.ndarray, known: int) -> np.ndarray:
    """Hash of every run of `known` words of each passage; equal runs have equal hashes."""
    n = max(g.shape[1] - known + 1, 0)
    h = np.zeros((len(g), n), np.uint64)
    for j in range(known if n else 0):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (g[:, j : j + n] + 3).astype(np.uint64)
    return h


class Common:
    """Counts the words that passages share with evaluation passages, repeated ones as often as both have them.

    No common run or subsequence is longer than this count, so a pair that is left out for it cannot pass.
    """

    def __init__(self, passages: np.ndarray, size: int):
        words, before = _places(passages)
        known = words >= 0
        self.most = int(before[known].max(initial=0)) + 1
        keys, row = np.unique((words * self.most + before)[known], return_inverse=True)
        self.row = np.zeros(size * self.most + 1, np.int64)  # row 0 is for what no passage has
        self.row[keys] = 1 + np.arange(len(keys))
        self.has = np.zeros((len(keys) + 1, len(passages)), np.int8 if passages.shape[1] < 128 else np.int16)
        self.has[1 + row, np.nonzero(known)[0]] = 1

    def count(self, g: np.ndarray) -> np.ndarray:
        words, before = _places(g)
        rows = self.row[np.where((words >= 0) & (before < self.most), words * self.most + before, -1)]
        total = np.zeros((len(g), self.has.shape[1]), self.has.dtype)
        for j in range(g.shape[1]):
            total += self.has[rows[:, j]]
        return total


class Exam:
    """The evaluation items of one block: vocabulary, word ids, passages."""

    def __init__(self, items: list[tuple[int, list[str]]], r: Retrieval):
        self.vocabulary: dict[str, int] = {}
        self.items = [(i, np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], np.int64)) for i, w in items]
        own = Retrieval(**{**r.__dict__, "in_a_row": True, "known": min([r.known, *(len(w) for _, w in self.items if len(w))])})
        rows, owner = [np.zeros((0, r.window), np.int64)], []
        for k, (_, ids) in enumerate(self.items):
            starts = passage_starts(ids, own)
            rows.append(grid(ids, starts, r.window))
            owner += [k] * len(starts)
        self.grid, self.owner = np.concatenate(rows), np.array(owner, np.int64)
        words = (self.grid >= 0).sum(1)
        #: Common words without which a passage cannot be met.
        self.least = np.full(len(words), r.known) if r.in_a_row else np.where(words >= r.least_words, np.maximum(np.ceil(r.overlap * words), 1), r.window + 1).astype(np.int64)


def _read_passages(exam: Exam, r: Retrieval):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, at, ids) of passages; at the end one row without doc_id: numbers of tiles, and of tiles that hold each word."""
        size, get = len(exam.vocabulary), exam.vocabulary.get
        seen, tiles = np.zeros(size, np.int64), 0
        for batch in batches:
            docs, places, grids = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([get(w, -1) for w in words_of(text)], np.int64)
                tile = np.arange(len(ids)) // r.window
                tiles += int(tile[-1]) + 1 if len(ids) else 0
                known = ids >= 0
                seen += np.bincount(np.unique(tile[known] * size + ids[known]) % size, minlength=size) if size else 0
                starts = passage_starts(ids, r)
                if len(starts) and doc is not None:
                    docs.append(np.full(len(starts), doc)), places.append(starts), grids.append(grid(ids, starts, r.reach))
            if docs:
                yield _passage_batch(np.concatenate(docs), np.concatenate(places), np.concatenate(grids))
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([tiles], pa.int64()), pa.array([seen.tolist()], pa.list_(pa.int32()))], names=["doc_id", "at", "ids"])

    return run


def _passage_batch(docs: np.ndarray, places: np.ndarray, grids: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(grids) + 1) * grids.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(grids.ravel(), pa.int32()))], names=["doc_id", "at", "ids"])


def _grids(batch: pa.RecordBatch, window: int, step: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for lo in range(0, batch.num_rows, step):
        part = batch.slice(lo, step)
        yield part.column(0).to_numpy(), part.column(2).flatten().to_numpy().reshape(-1, window).astype(np.int64)


def idf_of(stats: DataFrame, size: int) -> np.ndarray:
    """Inverse document frequencies over all tiles of the corpus, scaled into [1, 2] so that common words of a leak still count."""
    total = stats.agg(F.sum("at")).first()[0] or 0
    rows = stats.select(F.posexplode("ids").alias("word", "n")).groupBy("word").agg(F.sum("n").alias("n")).collect() if size else []
    df = np.zeros(size)
    for row in rows:
        df[row["word"]] = row["n"]
    raw = np.log((total + 1) / (df + 1))
    top = np.log(total + 1) or 1.0
    return (1 + raw / max(top, 1e-9)).astype(np.float32)


def randomised_svd(passages: DataFrame, exam: Exam, idf: np.ndarray, r: Retrieval) -> np.ndarray:
    """(words x rank) orthonormal basis of the leading right singular vectors of the corpus passages, by subspace iteration.

    Each task folds its passages into one (words x columns) matrix A'(A Q); the matrices are summed in a tree of tasks, so the driver gets one
    however large the corpus is. The evaluation passages start the iteration together with random directions.
    """
    size = len(idf)
    rank = min(r.rank, size)
    rng = np.random.default_rng(r.seed)
    start = rng.standard_normal((size, rank)).astype(np.float32)
    q = np.linalg.qr(start)[0].astype(np.float32)
    for _ in range(r.rounds):

        def fold(batches: Iterator[pa.RecordBatch], q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, rank), np.float32)
            for batch in batches:
                for _, g in _grids(batch, r.reach, 2048):
                    _fold(g, idf, q, total)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

        parts = passages.mapInArrow(fold, "m binary")
        width = passages.rdd.getNumPartitions()
        while width > 1:
            width = -(-width // 16)
            parts = parts.repartition(width).mapInArrow(_sum_matrices(size, rank), "m binary")
        total = np.zeros((size, rank), np.float32)
        for row in parts.collect():
            total += np.frombuffer(bytes(row["m"]), np.float32).reshape(size, rank)
        mine = np.zeros((size, rank), np.float32)  # the evaluation passages weigh as much as the corpus, so that the space holds their directions
        for lo in range(0, len(exam.grid), 2048):
            _fold(exam.grid[lo : lo + 2048], idf, q, mine)
        total += mine * (np.linalg.norm(total) / max(float(np.linalg.norm(mine)), 1e-9) if total.any() else 1.0)
        q = np.linalg.qr(total + 1e-6 * start)[0].astype(np.float32)
    return q


def _fold(g: np.ndarray, idf: np.ndarray, q: np.ndarray, total: np.ndarray) -> None:
    """Add A'(A q) of the passages A to `total`."""
    w = _weights(g, idf)
    y = vectors(g, idf, q, w)
    keep = (g >= 0).ravel()
    word, row = g.ravel()[keep], np.repeat(np.arange(len(g)), g.shape[1])[keep]
    size = len(idf)
    if size <= 4096:  # a small vocabulary is cheaper as a dense matrix
        a = np.bincount(row * size + word, weights=w.ravel()[keep], minlength=len(g) * size).astype(np.float32).reshape(len(g), size)
        total += a.T @ y
        return
    order = np.argsort(word, kind="stable")
    word, terms = word[order], (w.ravel()[keep, None] * y[row])[order]
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
    if len(first):
        total[word[first]] += np.add.reduceat(terms, first, axis=0)


def _sum_matrices(size: int, rank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, rank), np.float32)
        for batch in batches:
            for m in batch.column(0).to_pylist():
                total += np.frombuffer(m, np.float32).reshape(size, rank)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    return run


def candidates(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, r: Retrieval = Retrieval()) -> DataFrame:
    """(doc_id, item_id, cosine, run, lcs, item_words, facts): the best figures of every document and item with a candidate passage.

    With in_a_row only pairs with a common run of `known` words come out, and lcs and facts are not looked into; without it the figures are the
    best among the passage pairs that meet overlap, least_words and facts, and cosine is that of the TF-IDF vectors.
    run is the longest common run of words, lcs the longest common subsequence within a passage, item_words the words of the item's passage
    that was met, facts the share of that passage's words, each counted by its rarity, that the document's passage has (1 where none is rare). Whole texts are read. NULL or blank texts and
    items, and rows without id, take no part; repeated rows change nothing; an empty side gives no rows. `items` is the evaluation set: its
    words, not the corpus, set the size of what is broadcast, in blocks of at most block_items.
    """
    rows = items.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    ship(docs.sparkSession)
    out = None
    for block in _blocks(((x["i"], words_of(x["t"])) for x in rows.orderBy("i", "t").toLocalIterator()), r):
        part = _block(docs, doc_id, text, block, r)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "cosine", "run", "lcs", "item_words", "facts")


def _blocks(items: Iterator[tuple[int, list[str]]], r: Retrieval) -> Iterator[list[tuple[int, list[str]]]]:
    """Items with words in blocks of at most block_items items and block_words words, or one item; one empty block if there are none."""
    block, size, given = [], 0, False
    for i, w in items:
        if not w:
            continue
        if block and (len(block) == r.block_items or size + len(w) > r.block_words):
            yield block
            block, size, given = [], 0, True
        block.append((i, w))
        size += len(w)
    if block or not given:
        yield block


def _block(docs: DataFrame, doc_id: str, text: str, known: list[tuple[int, list[str]]], r: Retrieval) -> DataFrame:
    exam = Exam(known, r)
    if not r.in_a_row:  # a document's passage with fewer evaluation words than any common subsequence needs cannot pass
        r = replace(r, known=int(exam.least.min(initial=r.known)))
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    made = cut(read.mapInArrow(_read_passages(exam, r), "doc_id long, at long, ids array<int>"))
    idf = idf_of(made.filter("doc_id is null"), len(exam.vocabulary))
    passages = made.filter("doc_id is not null")
    basis = randomised_svd(passages, exam, idf, r) if r.in_a_row else None
    wanted = vectors(exam.grid, idf, basis) if r.in_a_row else None
    numbers = np.array([i for i, _ in exam.items], np.int64)
    runs = np.unique(_run_hashes(exam.grid, r.known)) if r.in_a_row else None
    rare = np.maximum(idf.astype(float) - 1, 0)  # how rare each word is, from 0 to 1

    def judge(ids: np.ndarray, g: np.ndarray, p: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        """The passage pairs that pass: each one is judged before the best of a document and item is taken."""
        words = (exam.grid[q] >= 0).sum(1)
        if not r.in_a_row:
            lcs = common_subsequence(g[p], exam.grid[q])
            keep = (lcs >= r.overlap * words) & (words >= r.least_words)
            p, q, words, lcs = p[keep], q[keep], words[keep], lcs[keep]
        e = exam.grid[q]
        run = common_run(g[p], e)
        if r.in_a_row:  # the run decides alone
            keep, lcs, facts = run >= r.known, run, np.ones(len(run))
            cosine = np.zeros(len(run))
            cosine[keep] = (vectors(g[p[keep]], idf, basis) * wanted[q[keep]]).sum(1)
        else:
            rarity = np.where(e >= 0, rare[np.maximum(e, 0)], 0)
            equal = e[:, :, None] == g[p][:, None, :]
            facts = np.where(rarity.sum(1) > 0, (rarity * equal.any(2)).sum(1) / np.maximum(rarity.sum(1), 1e-9), 1.0)
            keep = facts >= r.facts
            cosine = np.einsum("pij,pi,pj->p", equal, _weights(e, idf), _weights(g[p], idf))  # unknown words weigh nothing
        p, q = p[keep], q[keep]
        return pd.DataFrame({"doc_id": ids[p], "item_id": numbers[exam.owner[q]], "cosine": cosine[keep].astype(float), "run": run[keep], "lcs": lcs[keep], "item_words": words[keep], "facts": facts[keep]})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            parts = [(ids, g, vectors(g, idf, basis) if r.in_a_row else None) for ids, g in _grids(batch, r.reach)]
            for lo in range(0, len(exam.grid), STEP):
                common = Common(exam.grid[lo : lo + STEP], len(idf))
                for ids, g, y in parts:
                    if r.in_a_row:
                        near = y @ wanted[lo : lo + STEP].T >= r.cosine
                        sure = np.flatnonzero(np.isin(_run_hashes(g, r.known), runs).any(1))  # passages with a run of some item
                        near[sure] |= common.count(g[sure]) >= exam.least[lo : lo + STEP]
                    else:
                        near = common.count(g) >= exam.least[lo : lo + STEP]
                    p, q = np.nonzero(near)
                    for a in range(0, len(p), 1 << 15):
                        found.append(judge(ids, g, p[a : a + (1 << 15)], lo + q[a : a + (1 << 15)]))
            if found:
                every = pd.concat(found, ignore_index=True).sort_values(["run", "lcs", "cosine"], kind="stable").drop_duplicates(["doc_id", "item_id"], keep="last")
                yield pa.RecordBatch.from_pandas(every.astype({"run": "int32", "lcs": "int32", "item_words": "int32"}), preserve_index=False)

    schema = "doc_id long, item_id long, cosine double, run int, lcs int, item_words int, facts double"
    best = F.max(F.struct("run", "lcs", "cosine", "item_words", "facts")).alias("x")
    return passages.mapInArrow(search, schema).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.cosine", "x.run", "x.lcs", "x.item_words", "x.facts")


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, words: int = 12) -> DataFrame:
    """(doc_id, item_id): documents and items that share `words` words in a row."""
    return candidates(docs, doc_id, text, items, item_id, item_text, Retrieval(known=words, window=words + 4)).filter(F.col("run") >= words).select(doc_id, item_id)


def paraphrases(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, overlap: float = 0.7, facts: float = 0.5) -> DataFrame:
    """Documents with a passage that keeps most of an item's passage in order, though not letter for letter.

    `overlap` is the least share of the item's words in the common subsequence, `facts` the least share of its words by rarity. A document's passages
    are wider than the items', so that it does not matter where a paraphrase begins. A latent cosine would depend on what stands around it in
    such a passage, so the count of common words, which no subsequence can exceed, picks the candidates.
    """
    r = Retrieval(window=24, stride=12, known=12, in_a_row=False, overlap=overlap, facts=facts, least_words=8)
    return candidates(docs, doc_id, text, items, item_id, item_text, r).select(doc_id, item_id, "run", "lcs", "item_words", F.round("facts", 4).alias("facts"))
