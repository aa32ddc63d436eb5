"""Filling containers of fixed capacity with documents: first-fit decreasing over a tournament tree, in randomised groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.tokens import DEFAULT, lengths
from tidewheel.session import ship

CAPACITY = 2048
#: Documents that are packed together. Larger groups waste a little less; each is one task's work and stays in its memory.
GROUP_DOCS = 50_000


class Tournament:
    """First-fit over bins in order of opening: a complete binary tree of the most room below each node."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (max(bins, 1) - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        """The first bin with room for `size`."""
        room, at = self.room, 1
        while at < self.leaves:
            at <<= 1
            if room[at] < size:
                at += 1
        return at - self.leaves

    def take(self, index: int, size: int) -> None:
        room, at = self.room, index + self.leaves
        room[at] -= size
        while at > 1:
            at >>= 1
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item; sizes are between 1 and capacity. Equal sizes are taken in the order given.

    Items of one size that fit into the same bin go there together, which gives the same filling as one by one.
    """
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return bins, offsets
    order = np.argsort(-sizes, kind="stable")
    ordered = sizes[order]
    starts = np.append(np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])), n)
    tree = Tournament(n, capacity)
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        size, at = int(ordered[lo]), lo
        while at < hi:
            b = tree.first(size)
            room = tree.room[b + tree.leaves]
            many = min(hi - at, room // size)
            items = order[at : at + many]
            bins[items] = b
            offsets[items] = capacity - room + size * np.arange(many)
            tree.take(b, size * many)
            at += many
    return bins, offsets


def document_lengths(docs: DataFrame, doc_id: str, text: str, tokenizer_path: str = DEFAULT) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; NULL and empty texts have 0."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = lengths(batch.column(1).to_pylist(), tokenizer_path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, "doc_id long, n_tokens long")


def pack(lengths_df: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, n_docs: int | None = None, seed: int = 11) -> DataFrame:
    """(container, place, doc_id, doc_offset, n_tokens, fill_offset) for every document of (doc_id, n_tokens).

    Only documents longer than a container are split: full containers first, their rest is packed like any other item. `place` numbers the
    pieces of a container from 0, `fill_offset` is where a piece starts in it, `doc_offset` where it starts in its document. Documents
    without tokens take no space: they come out with NULL container and 0 tokens. Repeated doc_ids are separate items. Groups are drawn by
    hash, so a hot source or length is spread over all of them; a group's size does not depend on the amount of data. An empty table gives an
    empty result.
    """
    ship(lengths_df.sparkSession)
    total = n_docs if n_docs is not None else lengths_df.count()
    groups = max(1, -(-total // group_docs))
    salted = lengths_df.withColumn("group", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable")
        ids, n, group = pdf["doc_id"].to_numpy(), pdf["n_tokens"].fillna(0).to_numpy(np.int64), int(pdf["group"].iloc[0])
        whole, rest = n // capacity, n % capacity
        full = np.repeat(np.arange(len(n)), whole)
        nth = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
        small = np.flatnonzero(rest)
        bins, offsets = first_fit_decreasing(rest[small], capacity)
        none = np.flatnonzero(n == 0)
        opened = int(bins.max()) + 1 if len(bins) else 0
        number = np.concatenate([bins, opened + np.arange(len(full)), np.full(len(none), -1)])
        out = pd.DataFrame({
            "bin": number, "doc_id": np.concatenate([ids[small], ids[full], ids[none]]), "doc_offset": np.concatenate([whole[small] * capacity, nth * capacity, np.zeros(len(none), np.int64)]),
            "n_tokens": np.concatenate([rest[small], np.full(len(full), capacity), np.zeros(len(none), np.int64)]), "fill_offset": np.concatenate([offsets, np.zeros(len(full) + len(none), np.int64)]),
        }).sort_values(["bin", "fill_offset", "doc_id"], kind="stable")
        out["place"] = out.groupby("bin").cumcount()
        out["container"] = [f"{group}-{b}" if b >= 0 else None for b in out["bin"]]
        return out[["container", "place", "doc_id", "doc_offset", "n_tokens", "fill_offset"]]

    return salted.groupBy("group").applyInPandas(fill, "container string, place long, doc_id long, doc_offset long, n_tokens long, fill_offset long")


def packed_documents(docs: DataFrame, doc_id: str, text: str, capacity: int = CAPACITY, tokenizer_path: str = DEFAULT, group_docs: int = GROUP_DOCS) -> DataFrame:
    """pack() over whole texts; the number of documents comes from counting ids, without reading a text."""
    return pack(document_lengths(docs, doc_id, text, tokenizer_path), capacity, group_docs, docs.select(doc_id).count())
