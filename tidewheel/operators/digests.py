"""MD5 of many short texts at once: the texts of a tile share their length, and each round runs over the whole tile in arrays of a cache's size."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np

#: Pairs of one tile: with this many, the arrays of a round stay in a core's cache.
TILE = 16_384
#: The longest text of one MD5 block; longer ones are hashed one by one.
BLOCK = 55

_M = 0xFFFFFFFF
_K = [int(abs(math.sin(i + 1)) * 2**32) & _M for i in range(64)]
_S = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_G = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _mix(r: int, b, c, d):
    if r == 0:
        return d ^ (b & (c ^ d))
    if r == 1:
        return c ^ (d & (b ^ c))
    return b ^ c ^ d if r == 2 else c ^ (b | (d ^ _M))


def _mix_into(r: int, b, c, d, f):
    """The same over arrays, without new ones."""
    one = (lambda op, x, y: op(x, y, out=f))
    if r == 0:
        one(np.bitwise_xor, c, d), one(np.bitwise_and, f, b), one(np.bitwise_xor, f, d)
    elif r == 1:
        one(np.bitwise_xor, b, c), one(np.bitwise_and, f, d), one(np.bitwise_xor, f, c)
    elif r == 2:
        one(np.bitwise_xor, b, c), one(np.bitwise_xor, f, d)
    else:
        one(np.bitwise_xor, d, np.uint32(_M)), one(np.bitwise_or, f, b), one(np.bitwise_xor, f, c)


def _rounds(words: Sequence, state, first: int, last: int, n: int):
    """Rounds first .. last - 1. Words and state are numbers where all texts agree, uint32 arrays of length n elsewhere."""
    a, b, c, d = state
    f = g = None
    for i in range(first, last):
        w, s = words[_G[i]], _S[i // 16][i % 4]
        if f is None and not any(isinstance(x, np.ndarray) for x in (a, b, c, d, w)):
            x = (a + _mix(i // 16, b, c, d) + _K[i] + w) & _M
            a, b, c, d = d, (b + (((x << s) | (x >> (32 - s))) & _M)) & _M, b, c
            continue
        if f is None:
            f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
            a, b, c, d = (np.array(x) if isinstance(x, np.ndarray) else np.full(n, x, np.uint32) for x in (a, b, c, d))
        _mix_into(i // 16, b, c, d, f)
        np.add(a, f, out=a)
        if isinstance(w, np.ndarray):
            np.add(a, w, out=a)
            np.add(a, np.uint32(_K[i]), out=a)
        else:
            np.add(a, np.uint32((_K[i] + w) & _M), out=a)
        np.left_shift(a, np.uint32(s), out=g)
        np.right_shift(a, np.uint32(32 - s), out=a)
        np.bitwise_or(a, g, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return a, b, c, d


def words_of(texts: np.ndarray, at: int, total: int) -> list:
    """The 16 words of one block that hold texts (n x length bytes) from byte `at` on, with padding for texts of `total` bytes; 0 where nothing of it lies."""
    n, length = texts.shape
    block = np.zeros((n, 64), np.uint8)
    block[:, at : at + length] = texts
    w = np.ascontiguousarray(block.view("<u4").T)
    touched = range(at // 4, (at + length + 3) // 4)
    end = {total // 4: 0x80 << (8 * (total % 4)), 14: total * 8}
    return [w[k] + np.uint32(end.get(k, 0)) if k in touched else end.get(k, 0) for k in range(16)]


def head_words(text: bytes) -> list[int]:
    return [int.from_bytes(text[4 * k : 4 * k + 4].ljust(4, b"\0"), "little") for k in range(16)]


def leading(words: Sequence, n: int):
    """(state, lower bound of u): the state after 61 rounds, which settle the first word and so the first 32 bits of the digest."""
    state = _rounds(words, _START, 0, 61, n)
    first = (state[1] + np.uint32(_START[0])).byteswap()
    return state, first


def uniform(words: Sequence, state, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The leading 13 hex digits of the digests at `at`, over 2 ** 52."""
    own = [w[at] if isinstance(w, np.ndarray) else w for w in words]
    _, b, _, _ = _rounds(own, tuple(x[at] for x in state), 61, 64, len(at))
    second = (b + np.uint32(_START[1])).byteswap()
    return ((first[at].astype(np.uint64) << np.uint64(20)) | (second >> np.uint32(12)).astype(np.uint64)).astype(np.float64) / float(1 << 52)


def plain(text: bytes) -> float:
    return int(hashlib.md5(text, usedforsecurity=False).hexdigest()[:13], 16) / float(1 << 52)
