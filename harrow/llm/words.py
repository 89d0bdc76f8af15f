"""Words of many texts at once as numpy arrays: where they are and 64-bit hashes of them and of their runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of a list of texts. ``first[d]``..``first[d + 1]`` are the words of text d; ``hash`` has one value a word."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        data = [(t or "").encode("utf-8", "replace") for t in texts]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        buf = np.frombuffer(b"".join(data), np.uint8)
        if lower:
            buf = LOWER[buf]
        self.buf = buf
        inside = ~SPACE[buf]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        ends = np.cumsum(sizes)
        cut = (ends - sizes)[sizes > 0]
        begins[cut] |= inside[cut]  # words do not cross texts
        stops[ends[sizes > 0] - 1] |= inside[ends[sizes > 0] - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, np.concatenate([[0], ends]))
        n = len(self.start)
        if n:
            length = self.end - self.start
            at = np.arange(len(buf), dtype=np.int64)
            at -= np.repeat(self.start, np.diff(np.append(self.start, len(buf)))) if self.start[0] == 0 else np.concatenate(
                [np.zeros(self.start[0], np.int64), np.repeat(self.start, np.diff(np.append(self.start, len(buf))))])
            np.clip(at, 0, int(length.max()), out=at)
            value = (buf.astype(np.uint64) + np.uint64(1)) * powers(_P, int(length.max()) + 1)[at]
            value[~inside] = 0
            self.hash = mix(np.add.reduceat(value, self.start) + length.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.start)

    def runs(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; of no meaning where fewer follow in its text."""
        out = np.zeros(len(self), np.uint64)
        n = len(self)
        for j in range(min(k, n)):
            out[: n - j] = out[: n - j] * _C + self.hash[j:]
        return mix(out)

    def text(self, i: int, j: int) -> bytes:
        """Words i..j joined by one space."""
        return b" ".join(bytes(self.buf[a:b]) for a, b in zip(self.start[i:j], self.end[i:j]))


def chunks(texts: list, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Spans of a list of texts of about ``most`` characters each, or one text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the first minimum of x[i : i + w] for each i with a whole window."""
    span, at = 1, np.arange(len(x))
    while span < w:
        step = min(span, w - span)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(x[a] <= x[b], a, b)
        span += step
    return at
