"""Deeply nested JSON records to linked flat tables, by vectorised structural indexing.

A batch of texts becomes one byte array. Quote, bracket and delimiter bitmaps give its structural tokens, prefix sums of the brackets their
nesting depth, and one stable sort by depth puts every token behind the bracket that holds it. Objects, their keys and their spans then come
from array look-ups; no text is parsed value by value.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.session import ship

QUOTE, BACK, LBRACE, RBRACE, LBRACK, RBRACK, COLON, COMMA = (ord(c) for c in '"\\{}[]:,')
#: Bytes of text that are indexed at once; a single longer text is indexed alone.
BATCH_BYTES = 4 << 20
NUMBER = re.compile(rb"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$")
SPACE = " \t\r\n"


def camel(name: str) -> str:
    """opening_line -> openingLine."""
    head, *rest = name.split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in rest)


@dataclass(frozen=True)
class Level:
    """One level of a nested document: objects named `node`, found under `key` of an object of `parent`.

    `listed` says that a list is usual, so that elements are numbered and a single object has position 0; a level without it adds nothing to
    the path. `attributes` are the scalar fields to bring out; names count in snake or camel case.
    """

    node: str
    parent: str | None
    key: str
    listed: bool = True
    attributes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Shape:
    """The levels of a document, parents first, and the keys of objects that may wrap the root level's list."""

    levels: tuple[Level, ...]
    wrappers: tuple[str, ...] = ()


def unwrap(text: str | None) -> str | None:
    """The document itself: outer white space and byte-order marks off, and documents written into JSON strings decoded.

    None where nothing is left or a string literal is broken.
    """
    while text is not None:
        text = text.strip(SPACE + "﻿")
        if not text.startswith('"'):
            return text or None
        try:
            text = json.loads(text)
        except ValueError:
            return None
        if not isinstance(text, str):
            return None
    return None


class Index:
    """Structural index of a list of texts: arrays over tokens (in text order) and over opening brackets ("openers")."""

    def __init__(self, texts: Sequence[bytes]):
        self.n = len(texts)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, self.n)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if self.n else np.zeros(0, np.uint8)
        self.ok = np.ones(self.n, bool)
        self._tokens()
        self._depths()
        self._grammar()

    def text_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, pos, "right") - 1

    def _tokens(self) -> None:
        b = self.buf
        wanted = np.zeros(256, bool)
        wanted[[QUOTE, LBRACE, RBRACE, LBRACK, RBRACK, COLON, COMMA]] = True
        pos = np.flatnonzero(wanted[b])
        back = np.flatnonzero(b == BACK)
        if len(back):  # a byte behind an odd run of backslashes is escaped
            first = np.concatenate([[True], np.diff(back) > 1])
            run = back - back[np.maximum.accumulate(np.where(first, np.arange(len(back)), 0))]
            escapers = back[run % 2 == 0]
            escaped = np.zeros(len(b) + 1, bool)
            escaped[escapers + 1] = True
            pos = pos[~escaped[pos]]
            self._escapes(escapers)
        rec = self.text_of(pos)
        quote = b[pos] == QUOTE
        count = np.cumsum(quote)
        first = np.searchsorted(pos, self.start[:-1])
        before = np.where(first > 0, count[first - 1], 0) if len(pos) else np.zeros(self.n, np.int64)
        inside = (count - before[rec]) % 2 == 1 if len(pos) else np.zeros(0, bool)
        total = np.diff(np.concatenate([before, [count[-1] if len(pos) else 0]]))
        self.ok &= total % 2 == 0
        control = np.flatnonzero(b < 0x20)
        control = control[control != self.start[1:][np.minimum(self.text_of(control), self.n - 1)] - 1] if len(control) else control
        if len(control) and len(pos):
            at = np.searchsorted(pos, control) - 1
            same = (at >= 0) & (rec[np.maximum(at, 0)] == self.text_of(control))
            self.ok[self.text_of(control[same & inside[np.maximum(at, 0)]])] = False
        keep = ~inside | quote
        self.pos, self.rec, self.opens_string = pos[keep], rec[keep], (quote & inside)[keep]
        self.kind = b[self.pos]

    def _escapes(self, escapers: np.ndarray) -> None:
        """A backslash must be followed by one of "\\/bfnrt or u and four hex digits."""
        b, n = self.buf, len(self.buf)
        after = b[np.minimum(escapers + 1, n - 1)]
        good = np.isin(after, np.frombuffer(b'"\\/bfnrtu', np.uint8))
        for k in range(2, 6):
            good &= (after != ord("u")) | np.isin(b[np.minimum(escapers + k, n - 1)], np.frombuffer(b"0123456789abcdefABCDEF", np.uint8))
        self.ok[self.text_of(escapers[~good])] = False

    def _depths(self) -> None:
        k = self.kind
        up, down = (k == LBRACE) | (k == LBRACK), (k == RBRACE) | (k == RBRACK)
        running = np.cumsum(up.astype(np.int64) - down)
        first = np.searchsorted(self.rec, np.arange(self.n))
        last = np.searchsorted(self.rec, np.arange(self.n), "right") - 1
        some = last >= first
        before = np.where(first > 0, running[np.maximum(first - 1, 0)], 0) if len(k) else np.zeros(self.n, np.int64)
        depth = running - before[self.rec] + down  # a closer counts at its opener's depth
        self.ok &= some
        if len(k):
            self.ok[some] &= running[last[some]] - before[some] == 0
            self.ok[self.rec[depth < 1]] = False
            self.ok[self.rec[up & (depth == 1) & (np.arange(len(k)) != first[self.rec])]] = False
        keep = self.ok[self.rec]
        self.pos, self.rec, self.kind, self.opens_string, self.depth = (x[keep] for x in (self.pos, self.rec, self.kind, self.opens_string, depth))
        k, n = self.kind, len(self.kind)
        # Behind a stable sort by depth every token follows the opener that holds it, and the last of each group is its closer.
        order = np.argsort(self.depth, kind="stable")
        up = ((k == LBRACE) | (k == LBRACK))[order]
        group = np.cumsum(up) - 1
        openers = order[up]
        self.holder = np.empty(n, np.int64)
        if n:
            self.holder[order] = openers[np.maximum(group, 0)]
            last_of = np.concatenate([np.flatnonzero(up)[1:], [n]]) - 1
            self.closer = np.full(n, -1, np.int64)
            self.closer[openers] = order[last_of]
            matched = k[openers] + 2 == k[np.maximum(self.closer[openers], 0)]
            self.ok[self.rec[openers[~matched]]] = False
        else:
            self.closer = np.zeros(0, np.int64)
        self.openers = np.sort(openers)
        # The holder of an opener as a value: the last opener one level up before it.
        big = n + 1
        keys = np.sort(self.depth[self.openers] * big + self.openers)
        at = np.searchsorted(keys, (self.depth[self.openers] - 1) * big + self.openers) - 1
        parent = np.where((self.depth[self.openers] > 1) & (at >= 0), keys[np.maximum(at, 0)] % big, -1) if n else np.zeros(0, np.int64)
        self.parent = np.full(n, -1, np.int64)
        self.parent[self.openers] = parent
        commas = np.sort(self.depth[k == COMMA] * big + np.flatnonzero(k == COMMA))
        at_depth = (self.depth[self.openers] - 1) * big
        self.position = np.zeros(n, np.int64)
        self.position[self.openers] = np.searchsorted(commas, at_depth + self.openers) - np.searchsorted(commas, at_depth + np.maximum(parent, 0))

    def _grammar(self) -> None:
        """Adjacent tokens must be ones that JSON allows next to each other, and scalars must be numbers, true, false or null."""
        b, k, n = self.buf, self.kind, len(self.kind)
        self.scalar, self.scalar_from, self.scalar_to = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not n:
            return
        solid = np.flatnonzero((b > 0x20) | ((b != 0x20) & (b != 9) & (b != 10) & (b != 13)))
        # Gaps between tokens outside of strings, with the last token's end of text as well.
        end = np.where(np.append(self.rec[1:] != self.rec[:-1], True), self.start[self.rec + 1], np.append(self.pos[1:], len(b)))
        lo, hi = np.searchsorted(solid, self.pos, "right"), np.searchsorted(solid, end)
        filled = (hi > lo) & ~self.opens_string
        first = np.append(True, self.rec[1:] != self.rec[:-1])
        lead = np.searchsorted(solid, self.pos[first]) > np.searchsorted(solid, self.start[self.rec[first]])
        self.ok[self.rec[first][lead]] = False  # something stands before the first token
        self.scalar = filled
        self.scalar_from = np.where(filled, solid[np.minimum(lo, len(solid) - 1)], 0)
        self.scalar_to = np.where(filled, solid[np.maximum(hi - 1, 0)] + 1, 0)
        value_end = np.zeros(n, bool)  # the token ends a value or key
        in_object = k[self.holder] == LBRACE
        opener, closer = (k == LBRACE) | (k == LBRACK), (k == RBRACE) | (k == RBRACK)
        closes_string = (k == QUOTE) & ~self.opens_string
        value_end = closer | closes_string
        nxt = np.append(np.arange(1, n), n - 1)
        follows = ~np.append(self.rec[1:] != self.rec[:-1], True)
        nk, nopens = k[nxt], self.opens_string[nxt]
        bad = np.zeros(n, bool)
        # Behind a value or key: comma, colon (keys only, below) or a closer; no scalar.
        bad |= value_end & filled
        bad |= value_end & follows & ~np.isin(nk, [COMMA, COLON, RBRACE, RBRACK])
        bad |= value_end & ~follows & (self.depth != 1)
        starts = np.isin(nk, [LBRACE, LBRACK]) | nopens
        is_list_opener, is_object_opener = k == LBRACK, k == LBRACE
        bad |= is_object_opener & (filled | ~(nopens | (nk == RBRACE)))
        bad |= is_list_opener & filled & ~np.isin(nk, [COMMA, RBRACK])
        bad |= is_list_opener & ~filled & ~(starts | (nk == RBRACK))
        comma, colon = k == COMMA, k == COLON
        bad |= comma & in_object & (filled | ~nopens)
        bad |= (comma & ~in_object | colon) & filled & ~np.isin(nk, [COMMA, RBRACE, RBRACK])
        bad |= (comma & ~in_object | colon) & ~filled & ~starts
        # A colon stands behind a string that itself stands behind a brace or a comma of an object; such a string has a colon behind it.
        p1, p2 = np.maximum(np.arange(n) - 1, 0), np.maximum(np.arange(n) - 2, 0)
        p3 = np.maximum(np.arange(n) - 3, 0)
        key_before = closes_string[p1] & self.opens_string[p2] & in_object & ((k[p3] == LBRACE) | ((k[p3] == COMMA) & (self.holder[p3] == self.holder)))
        bad |= colon & ~key_before
        is_key = closes_string & in_object & np.isin(k[p2], [LBRACE, COMMA]) & (self.holder[p2] == self.holder)
        bad |= is_key & (nk != COLON)
        self.ok[self.rec[bad]] = False
        self._scalars(np.flatnonzero(filled & self.ok[self.rec]))

    def _scalars(self, at: np.ndarray) -> None:
        lo, hi = self.scalar_from[at], self.scalar_to[at]
        for width in np.unique(hi - lo):  # one pass for each length of scalar, over distinct values
            mine = at[hi - lo == width]
            grid = np.ascontiguousarray(self.buf[self.scalar_from[mine][:, None] + np.arange(width)])
            seen, inverse = np.unique(grid.view(f"S{width}").ravel(), return_inverse=True)
            good = np.array([v in (b"true", b"false", b"null") or (len(v) == width and NUMBER.match(v) is not None) for v in seen.tolist()])
            self.ok[self.rec[mine[~good[inverse]]]] = False

    def keys(self, tokens: np.ndarray, names: Sequence[str]) -> np.ndarray:
        """For value tokens (openers, string openers or colons before a scalar): index in `names` of the key they stand under, or -1.

        `tokens` are the indices of the colons in front of the values.
        """
        found = np.full(len(tokens), -1, np.int64)
        is_colon = (tokens >= 3) & (self.kind[np.maximum(tokens, 0)] == COLON)
        t = np.where(is_colon, tokens, 3)
        lo, hi = self.pos[np.minimum(t - 2, len(self.pos) - 1)] + 1, self.pos[np.minimum(t - 1, len(self.pos) - 1)]
        size = hi - lo
        for code, name in enumerate(names):
            for form in {name, camel(name)}:
                raw = np.frombuffer(form.encode(), np.uint8)
                some = np.flatnonzero(is_colon & (size == len(raw)))
                if len(some):
                    hit = (self.buf[lo[some][:, None] + np.arange(len(raw))] == raw).all(1)
                    found[some[hit]] = code
        odd = np.flatnonzero(is_colon & (found < 0) & (size > 0))
        if len(odd) and (self.buf == BACK).any():  # keys with escapes are rare and read one by one
            slashes = np.flatnonzero(self.buf == BACK)
            odd = odd[np.searchsorted(slashes, hi[odd]) > np.searchsorted(slashes, lo[odd])]
            forms = {f: i for i, name in enumerate(names) for f in (name, camel(name))}
            for i in odd:
                found[i] = forms.get(json.loads(b'"' + self.buf[lo[i] : hi[i]].tobytes() + b'"'), -1)
        return found

    def values(self, colons: np.ndarray) -> list[str | None]:
        """The scalars behind colons: a string's characters, the letters of a number or literal; None for null, objects and lists."""
        nxt = np.minimum(colons + 1, len(self.kind) - 1)
        is_text = ~self.scalar[colons] & self.opens_string[nxt]
        lo = np.where(is_text, self.pos[nxt] + 1, self.scalar_from[colons])
        hi = np.where(is_text, self.pos[np.minimum(nxt + 1, len(self.pos) - 1)], self.scalar_to[colons])
        whole, out = self.buf.tobytes(), []
        for a, b, text, scalar in zip(lo.tolist(), hi.tolist(), is_text.tolist(), self.scalar[colons].tolist()):
            raw = whole[a:b]
            if text:
                out.append(json.loads(b'"' + raw + b'"') if b"\\" in raw else raw.decode())
            else:
                out.append(raw.decode() if scalar and raw != b"null" else None)
        return out


def _rows(index: Index, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(opener, level, holder object's opener or -1, path component) of every object of the shape; level indexes shape.levels."""
    names = [*dict.fromkeys([*(x.key for x in shape.levels), *shape.wrappers])]
    op = index.openers
    n = len(index.kind)
    code = np.full(n, -1, np.int64)
    code[op] = index.keys(op - 1, names)
    # Of a repeated key in one object the last value counts, be it a scalar, as JSON readers have it.
    colons = np.flatnonzero(index.kind == COLON)
    colon_code = index.keys(colons, names)
    colons, colon_code = colons[colon_code >= 0], colon_code[colon_code >= 0]
    pair = index.holder[colons] * len(names) + colon_code
    order = np.lexsort((colons, pair))
    over = np.zeros(n + 1, bool)
    over[colons[order[:-1][pair[order][1:] == pair[order][:-1]]]] = True
    code[op[over[op - 1]]] = -1
    # role: 2*level for an object, 2*level+1 for the list of a level; WRAP for a wrapper
    wrap = 2 * len(shape.levels)
    role = np.full(n, -1, np.int64)
    by_depth = op[np.argsort(index.depth[op], kind="stable")]
    bounds = np.searchsorted(index.depth[by_depth], np.arange(1, (index.depth[by_depth].max() if len(op) else 0) + 2))
    root = next(i for i, x in enumerate(shape.levels) if x.parent is None)
    # A document has one root list: what stands under the root's key counts, even null, and only objects without that key are looked through.
    told = np.zeros(n, bool)
    told[index.holder[colons[colon_code == names.index(shape.levels[root].key)]]] = True
    of_name = {x.node: i for i, x in enumerate(shape.levels)}
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        o = by_depth[lo:hi]
        is_list, parent = index.kind[o] == LBRACK, index.parent[o]
        above = np.where(parent >= 0, role[np.maximum(parent, 0)], -2)
        r = np.full(len(o), -1, np.int64)
        r[(above == -2) & ~is_list] = wrap
        r[(above == -2) & is_list] = 2 * root + 1
        for name in shape.wrappers:
            hit = (above == wrap) & (code[o] == names.index(name)) & ~told[np.maximum(parent, 0)]
            r[hit] = np.where(is_list[hit], 2 * root + 1, wrap)
        for i, level in enumerate(shape.levels):
            hit = (above == (wrap if level.parent is None else 2 * of_name[level.parent])) & (code[o] == names.index(level.key))
            if level.listed:
                r[hit] = np.where(is_list[hit], 2 * i + 1, 2 * i)
            else:
                r[hit & ~is_list] = 2 * i
            if level.listed:
                r[(above == 2 * i + 1) & ~is_list] = 2 * i
        role[o] = r
    objects = op[(role[op] >= 0) & (role[op] < wrap) & (role[op] % 2 == 0) & index.ok[index.rec[op]]]
    parent = index.parent[objects]
    listed = (parent >= 0) & (role[np.maximum(parent, 0)] % 2 == 1) & (role[np.maximum(parent, 0)] < wrap)
    holder = np.where(listed, index.parent[np.maximum(parent, 0)], parent)
    holder = np.where((holder >= 0) & (role[np.maximum(holder, 0)] < wrap), holder, -1)
    return objects, role[objects] // 2, holder, np.where(listed, index.position[objects], 0)


def linked(ids: Sequence[int], texts: Sequence[str | None], shape: Shape) -> pd.DataFrame:
    """Rows (id, node, node_path, parent_node, parent_path, attributes) of all objects of a batch of documents."""
    columns = ["id", "node", "node_path", "parent_node", "parent_path", "attributes"]
    docs = [unwrap(t) for t in texts]
    kept = [i for i, d in enumerate(docs) if d is not None]
    if not kept:
        return pd.DataFrame({c: [] for c in columns})
    index = Index([docs[i].encode("utf-8", "surrogatepass") for i in kept])
    objects, level, holder, component = _rows(index, shape)
    path = np.full(len(index.kind), "", object)
    label = np.full(len(index.kind), "", object)
    nodes = [x.node for x in shape.levels]
    for i, lv in enumerate(shape.levels):  # parents come first, so a level's paths only need the levels before it
        mine = np.flatnonzero(level == i)
        o, h = objects[mine], holder[mine]
        base = path[h] if lv.parent is not None else np.full(len(mine), "", object)
        if lv.listed:
            own = component[mine].astype(str).astype(object)
            path[o] = own if lv.parent is None else base + "." + own
        else:
            path[o] = base
        label[o] = lv.node
    fields = _fields(index, shape, objects, level)
    own = np.array(ids, object)[np.array(kept)[index.rec[objects]]]
    has = holder >= 0
    return pd.DataFrame({
        "id": own.astype(np.int64), "node": label[objects], "node_path": path[objects], "parent_node": np.where(has, label[np.maximum(holder, 0)], None),
        "parent_path": np.where(has, path[np.maximum(holder, 0)], None), "attributes": [fields.get(o, []) for o in objects.tolist()],
    })


def _fields(index: Index, shape: Shape, objects: np.ndarray, level: np.ndarray) -> dict[int, list[tuple[str, str | None]]]:
    """Scalar attributes of each object by its opener; JSON null is an attribute without value, a missing one does not appear."""
    wanted = [*dict.fromkeys(a for x in shape.levels for a in x.attributes)]
    of_level = np.full(len(index.kind), -1, np.int64)
    of_level[objects] = level
    if not wanted:
        return {}
    colons = np.flatnonzero(index.kind == COLON)
    colons = colons[of_level[index.holder[colons]] >= 0]
    code = index.keys(colons, wanted)
    allowed = np.array([[a in x.attributes for a in wanted] for x in shape.levels]).reshape(len(shape.levels), len(wanted))
    colons, code = colons[code >= 0], code[code >= 0]
    hit = allowed[of_level[index.holder[colons]], code]
    out: dict[int, dict[str, str | None]] = {}
    for holder, a, value in zip(index.holder[colons[hit]].tolist(), code[hit].tolist(), index.values(colons[hit])):
        out.setdefault(holder, {})[wanted[a]] = value
    return {k: list(v.items()) for k, v in out.items()}


def branch(shape: Shape, node: str) -> Shape:
    """The levels from the root down to `node`, with the attributes of `node` alone: what its flat table needs."""
    of_name, keep, at = {x.node: x for x in shape.levels}, [], node
    while at is not None:
        keep.append(at)
        at = of_name[at].parent
    return Shape(tuple(replace(x, attributes=x.attributes if x.node == node else ()) for x in shape.levels if x.node in keep), shape.wrappers)


def linked_rows(df: DataFrame, record_id: str, payload: str, shape: Shape, latest_by: str | None = None) -> DataFrame:
    """One row per object of each record's document: (<record_id>, node, node_path, parent_node, parent_path, attributes map).

    A record counts once: of several deliveries the one with the latest `latest_by` (then the largest payload) is read. Records whose payload
    is NULL, blank or no complete JSON document, and records without id, give no rows; an empty table gives an empty one. Extra columns are
    not read. Work is per record and needs no shuffle but the one that joins repeated deliveries.
    """
    ship(df.sparkSession)
    use = df.filter(F.col(record_id).isNotNull() & F.col(payload).isNotNull())
    order = F.struct(F.col(latest_by).alias("at"), F.col(payload).alias("p")) if latest_by else F.struct(F.lit(0).alias("at"), F.col(payload).alias("p"))
    once = use.groupBy(record_id).agg(F.max(order)["p"].alias("__payload")).select(F.col(record_id).cast("long").alias("id"), "__payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["__payload"].str.len().to_numpy()
            block = np.cumsum(size) // BATCH_BYTES
            for _, part in pdf.groupby(block, sort=False):
                rows = linked(part["id"].tolist(), part["__payload"].tolist(), shape)
                if len(rows):
                    yield rows

    schema = "id long, node string, node_path string, parent_node string, parent_path string, attributes array<struct<key:string,value:string>>"
    out = once.mapInPandas(_as_structs(run), schema)
    return out.select(F.col("id").alias(record_id), "node", "node_path", "parent_node", "parent_path", F.map_from_entries("attributes").alias("attributes"))


def _as_structs(run):
    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in run(batches):
            out["attributes"] = [[{"key": k, "value": v} for k, v in row] for row in out["attributes"]]
            yield out

    return wrapped


def flat_tables(rows: DataFrame, record_id: str, shape: Shape, types: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """One flat table per level: record id, own path, path of its parent's row, and the level's attributes, cast where `types` names a type.

    A level that is not listed has its parent's path for its own, and still names its parent. To write several tables, cut `rows` first, so
    that payloads are read once.

    A value that cannot be read as its type is NULL.
    """
    types = types or {}
    tables = {}
    for lv in shape.levels:
        fields = [F.col("attributes")[a].try_cast(types.get(a, "string")).alias(a) for a in lv.attributes]
        own = [F.col("node_path").alias(f"{lv.node}_path")]
        link = [F.col("parent_path").alias(f"{lv.parent}_path")] if lv.parent else []
        tables[lv.node] = rows.filter(F.col("node") == lv.node).select(record_id, *own, *link, *fields)
    return tables
