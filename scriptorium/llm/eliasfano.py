"""Elias-Fano coding of monotone numbers, over arrays that can be memory-mapped, and files that hold such arrays."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

U = np.uint64
_STEPS = tuple((n, U((1 << n) - 1)) for n in (32, 16, 8, 4, 2, 1))


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word."""
    at = np.zeros(len(words), U)
    words, k = words.copy(), k.astype(U)
    for n, mask in _STEPS:
        own = np.bitwise_count(words & mask).astype(U)
        upper = k >= own
        k = np.where(upper, k - own, k)
        words = np.where(upper, words >> U(n), words)
        at += np.where(upper, U(n), U(0))
    return at


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of so many bits each, one after the other, in 64-bit words, with a word to spare."""
    if not bits or not len(values):
        return np.zeros(2, U)
    shifts = np.arange(bits, dtype=U)
    parts = [np.packbits(((values[i : i + 65536, None] >> shifts) & U(1)).astype(np.uint8).ravel(), bitorder="little") for i in range(0, len(values), 65536)]
    raw = np.concatenate(parts)
    return np.concatenate([raw, np.zeros(-len(raw) % 8 + 16, np.uint8)]).view(U)


class EliasFano:
    """A sequence of distinct rising 64-bit numbers: low bits packed, high parts in unary, zeros counted word by word."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(U)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1) if n else 0
        places = (values >> U(bits)).astype(np.int64) + np.arange(n)
        size = ((top >> bits) + n + 2 + 63) // 64
        high = np.zeros(size, U)
        np.bitwise_or.at(high, places >> 6, U(1) << (places & 63).astype(U))
        ends = np.cumsum(64 - np.bitwise_count(high).astype(np.int64))
        return cls(n, bits, _pack(values & U((1 << bits) - 1), bits), high, np.concatenate([[0], ends]).astype(np.int64))

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.size": np.array([self.n, self.bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.zeros": self.zeros}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = (int(x) for x in arrays[f"{name}.size"])
        return cls(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.zeros"])

    def _starts(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the numbers of each high part start: place in the unary code, and how many numbers are before."""
        k = part.astype(np.int64) - 1  # the zero that ends the part before
        word = np.searchsorted(self.zeros, k, side="right") - 1
        word[k < 0] = 0
        place = (word << 6) + _select(~self.high[word], np.maximum(k - self.zeros[word], 0)).astype(np.int64)
        place[k < 0] = -1
        return place + 1, place - k

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        at = i.astype(np.int64) * self.bits
        word, shift = at >> 6, (at & 63).astype(U)
        value = self.low[word] >> shift
        over = shift + U(self.bits) > U(64)
        value = np.where(over, value | (self.low[word + 1] << np.where(over, U(64) - shift, U(0))), value)
        return value & U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at these places: the i-th set bit of the unary code gives the high part."""
        if not hasattr(self, "_ones"):
            self._ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        word = np.searchsorted(self._ones, i, side="right") - 1
        place = (word << 6) + _select(self.high[word], i - self._ones[word]).astype(np.int64)
        return ((place - i).astype(U) << U(self.bits)) | self._lows(i)

    def find(self, x: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each number, -1 where it isn't there; with first and end only places in that range of each are searched."""
        x = x.astype(U)
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        part, low = x >> U(self.bits), x & U((1 << self.bits) - 1)
        inside = np.flatnonzero(part < U(max(0, int(self.zeros[-1]) - 1)))
        low = low[inside]
        bit, at = self._starts(part[inside])
        for _ in range(3):  # most high parts have few numbers
            going = np.flatnonzero((self.high[bit >> 6] >> (bit & 63).astype(U)) & U(1))  # one: a number of this part
            inside, low, bit, at = inside[going], low[going], bit[going], at[going]
            here = self._lows(at)
            out[inside[here == low]] = at[here == low]
            on = np.flatnonzero(here < low)
            inside, low, bit, at = inside[on], low[on], bit[on] + 1, at[on] + 1
        stop = self._starts(part[inside] + U(1))[1]
        if first is not None:
            at, stop = np.maximum(at, first[inside]), np.minimum(stop, end[inside])
        while len(inside):  # the rest by halves
            on = np.flatnonzero(at < stop)
            inside, low, at, stop = inside[on], low[on], at[on], stop[on]
            middle = (at + stop) >> 1
            here = self._lows(middle)
            out[inside[here == low]] = middle[here == low]
            stop = np.where(here > low, middle, stop)
            at = np.where(here < low, middle + 1, at)
            on = np.flatnonzero(here != low)
            inside, low, at, stop = inside[on], low[on], at[on], stop[on]
        return out if first is None else np.where((out >= first) & (out < end), out, -1)

    def values(self) -> np.ndarray:
        """All numbers."""
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(U)
        return (high << U(self.bits)) | self._lows(np.arange(self.n))


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of arrays; it takes its name when it is whole, so that a task that runs again or twice does no harm."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (str(a.dtype), a.shape[0], at)
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 64))
    os.replace(part, path)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped."""
    raw = np.asarray(np.memmap(path, np.uint8, "r"))
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    base = 8 + n
    return {name: raw[base + at : base + at + size * np.dtype(kind).itemsize].view(kind) for name, (kind, size, at) in head.items()}
