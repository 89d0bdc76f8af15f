"""md5 draws by the array: what ``conv(substr(md5(prefix|rep|slot), 1, 8), 16, 10)`` is, for many replicates and slots at once.

A replicate of n units takes n digests, so resampling queries spend their time here. Messages of one block (55 bytes, all
that queries make) go through the 64 steps as numpy arrays, some 10 times faster than one by one; longer ones by hashlib.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

#: Messages that go through the steps together: their arrays stay in a core's cache.
TOGETHER = 8_192
_TURNS = [t for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in turns * 4]
_ADDED = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _digest(words: dict[int, np.ndarray], n: int, two: bool) -> np.ndarray:
    """The first word of the digest (uint32), or the first two as one uint64, of n messages: ``words`` are those that are not 0."""
    a, b, c, d = (np.full(n, s, np.uint32) for s in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64 if two else 61):  # the first word is done three steps before the end
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, np.uint32(_ADDED[i]), out=f)
        if _WORD[i] in words:
            np.add(f, words[_WORD[i]], out=f)
        np.left_shift(f, np.uint32(_TURNS[i]), out=g), np.right_shift(f, np.uint32(32 - _TURNS[i]), out=f), np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    if not two:
        return (b + np.uint32(_START[0])).byteswap()
    return ((a + np.uint32(_START[0])).byteswap().astype(np.uint64) << np.uint64(32)) | (b + np.uint32(_START[1])).byteswap()


def _in_parts(words: np.ndarray, bits: np.ndarray, two: bool) -> np.ndarray:
    """``words`` (words, messages) and the messages' bits, ``TOGETHER`` at a time."""
    n = words.shape[1]
    out = np.empty(n, np.uint64 if two else np.uint32)
    for at in range(0, n, TOGETHER):
        to = min(n, at + TOGETHER)
        out[at:to] = _digest({**{k: w[at:to] for k, w in enumerate(words)}, 14: bits[at:to]}, to - at, two)
    return out


@lru_cache(64)
def _digits(lo: int, hi: int) -> np.ndarray:
    """(digits, numbers): the ASCII digits of lo .. hi - 1, numbers of one length."""
    return np.array([np.arange(lo, hi) // 10**k % 10 + 48 for k in reversed(range(len(str(lo))))], np.uint32)


def _of_one_length(lo: int, hi: int):
    while lo < hi:
        to = min(hi, 10 ** len(str(lo)))
        yield lo, to
        lo = to


def heads(prefix: str, first: int, last: int, n: int, start: int = 0) -> np.ndarray:
    """(replicates first .. last - 1, slots start .. start + n - 1): the first 8 hex digits of md5(prefix|rep|slot), as numbers."""
    head = f"{prefix}|".encode()
    longest = len(head) + len(str(last - 1)) + 1 + len(str(start + n - 1))
    if longest > 55:
        return np.array([[int.from_bytes(hashlib.md5(head + b"%d|%d" % (r, s)).digest()[:4], "big") for s in range(start, start + n)] for r in range(first, last)], np.uint32).reshape(last - first, n)
    words = np.zeros((longest // 4 + 1, last - first, n), np.uint32)
    bits = np.empty((last - first, n), np.uint32)
    for r, r_to in _of_one_length(first, last):
        for s, s_to in _of_one_length(start, start + n):
            to = (slice(r - first, r_to - first), slice(s - start, s_to - start))
            text = [*((c, None) for c in head), *((d, 0) for d in _digits(r, r_to)), (124, None), *((d, 1) for d in _digits(s, s_to)), (128, None)]
            bits[to] = 8 * (len(text) - 1)
            for k in range(0, len(text), 4):
                fixed, of_rep, of_slot = 0, np.uint32(0), np.uint32(0)
                for j, (c, side) in enumerate(text[k : k + 4]):
                    if side is None:
                        fixed += int(c) << 8 * j
                    elif side == 0:
                        of_rep = of_rep + (c << np.uint32(8 * j))[:, None]
                    else:
                        of_slot = of_slot + (c << np.uint32(8 * j))[None]
                words[(k // 4, *to)] = of_rep + of_slot + np.uint32(fixed)
    return _in_parts(words.reshape(len(words), -1), bits.ravel(), False).reshape(last - first, n)


def picks(prefix: str, first: int, last: int, n: int, most: int = 262_144):
    """Yields (first replicate, (replicates, n) places below n) for blocks of replicates of about ``most`` draws."""
    step = max(1, most // max(n, 1))
    for at in range(first, last, step):
        to = min(last, at + step)
        yield at, (heads(prefix, at, to, n) % np.uint32(n)).astype(np.int64)


class Tails:
    """Fixed ends of messages: ``order(head)`` sorts them by md5(head + end), ties by place."""

    def __init__(self, ends: list[str]):
        self.ends = [e.encode() for e in ends]
        self.length = np.array([len(e) for e in self.ends])
        self.bytes = np.frombuffer(b"".join(e.ljust(self.length.max()) for e in self.ends), np.uint8).reshape(len(ends), -1)
        self.held: dict = {}

    def _words(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        if at not in self.held:
            n = len(self.ends)
            text = np.zeros((n, 4 * ((at + self.bytes.shape[1]) // 4 + 1)), np.uint8)
            text[:, at : at + self.bytes.shape[1]] = np.where(np.arange(self.bytes.shape[1]) < self.length[:, None], self.bytes, 0)
            text[np.arange(n), at + self.length] = 128
            self.held[at] = np.ascontiguousarray(text.view("<u4").T), (8 * (at + self.length)).astype(np.uint32)
        return self.held[at]

    def order(self, head: str) -> np.ndarray:
        head = head.encode()
        if len(head) + self.length.max() > 55:
            return np.array(sorted(range(len(self.ends)), key=lambda i: (hashlib.md5(head + self.ends[i]).digest(), i)))
        words, bits = self._words(len(head))
        start = np.frombuffer(head.ljust(4 * len(words), b"\0"), "<u4")
        keys = _in_parts(words + start[:, None], bits, True)
        found = np.argsort(keys, kind="stable")
        same = np.flatnonzero(keys[found[1:]] == keys[found[:-1]])
        if len(same):  # equal in 64 bits: by all 128
            found = np.array(sorted(found, key=lambda i: (hashlib.md5(head + self.ends[i]).digest(), i)))
        return found
