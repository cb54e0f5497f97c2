"""Vectorised 64-bit hashes of pieces of a byte buffer, and an open-addressing table from such hashes to integers.

A piece's hash is a polynomial over its bytes modulo 2**64, taken as a difference of prefix sums, so that any set of
pieces of a buffer costs one pass over the buffer and one gather a piece. Multiplication by the inverse power makes it
independent of the place in the buffer.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.RandomState(20240229)
_BYTE = (_RNG.randint(0, 2**32, 256).astype(U) << U(32)) | _RNG.randint(0, 2**32, 256).astype(U) | U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, for buffers of up to n bytes."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        out = []
        for b in (_BASE, _BASE_INV):
            p = np.ones(1, U)
            while len(p) < size:
                p = np.concatenate([p, p * U(pow(b, len(p), 2**64))])
            out.append(p)
        _powers[:] = out
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def piece_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each buf[start:end]; equal pieces, equal hashes."""
    power, inverse = _grown(len(buf))
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h ^ ((ends - starts).astype(U) << U(48)))


class HashTable:
    """From uint64 keys to int64 values, by linear probing over arrays."""

    def __init__(self, capacity: int = 1 << 16):
        size = 1 << max(4, int(capacity * 2 - 1).bit_length())
        self.keys, self.vals, self.used, self.n = np.zeros(size, U), np.zeros(size, np.int64), np.zeros(size, bool), 0
        self.mask = U(size - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is absent."""
        at = (keys & self.mask).astype(np.int64)
        hit = self.used[at]
        same = hit & (self.keys[at] == keys)
        out = np.where(same, self.vals[at], -1)
        todo = np.flatnonzero(hit & ~same)
        while len(todo):
            at_t = (at[todo] + 1) & int(self.mask)
            at[todo] = at_t
            hit = self.used[at_t]
            same = hit & (self.keys[at_t] == keys[todo])
            out[todo[same]] = self.vals[at_t[same]]
            todo = todo[hit & ~same]
        return out

    def add(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """New distinct keys."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys[self.used], self.vals[self.used]
            self.__init__(2 * (self.n + len(keys)))
            self._place(*old)
        self._place(keys, vals)

    def _place(self, keys: np.ndarray, vals: np.ndarray) -> None:
        at, todo = (keys & self.mask).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = todo[~self.used[at[todo]]]
            _, first = np.unique(at[free], return_index=True)  # of keys that want one free place, one gets it
            won = free[first]
            self.keys[at[won]], self.vals[at[won]], self.used[at[won]] = keys[won], vals[won], True
            left = np.ones(len(keys), bool)
            left[won] = False
            todo = todo[left[todo]]
            at[todo] = (at[todo] + 1) & int(self.mask)
        self.n += len(keys)


def spans(lengths: np.ndarray) -> np.ndarray:
    """Offsets from lengths: 0, then running sums."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces data[start:start+length], one after another."""
    off = spans(lengths)
    idx = np.arange(off[-1]) + np.repeat(starts - off[:-1], lengths)
    return data[idx]


class Words:
    """The words of a list of texts: maximal runs of bytes that a table of 256 marks. A-Z is lower-cased first.

    starts, ends: places in buf; first: for each text its first word's number, and the total at the end; hash: of each word.
    """

    def __init__(self, texts: list[bytes], is_word: np.ndarray, separator: bytes = b" "):
        lower = separator.join([*texts, b""]).lower()  # bytes.lower() changes A-Z only
        self.buf = np.frombuffer(lower, np.uint8)
        inside = np.zeros(len(self.buf) + 2, np.int8)
        inside[1:-1] = is_word[self.buf]
        edge = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.starts, spans(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))))
        self.hash = piece_hashes(self.buf, self.starts, self.ends)


def byte_table(separators: str) -> np.ndarray:
    """True for the bytes that are not in a list of inclusive hexadecimal ranges, such as "20 09-0D"."""
    out = np.ones(256, bool)
    for part in separators.split():
        lo, _, hi = part.partition("-")
        out[int(lo, 16) : int(hi or lo, 16) + 1] = False
    return out


#: Words of `[^\x20\x09-\x0D]+`.
NOT_SPACE = byte_table("20 09-0D")


def pieces_of(texts: list[bytes], most: int = 2_000_000):
    """Ranges (i, j) of texts with about `most` bytes together, one text at least."""
    i = size = 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > most:
            yield i, j
            i, size = j, 0
        size += len(t) + 1
    if i < len(texts):
        yield i, len(texts)
