"""Elias-Fano sequences over numpy arrays, with searches for many queries at once, and files that are memory-mapped.

A non-decreasing sequence of n values below u keeps the low log2(u / n) bits of each value packed, and the high bits as
a bit vector in which value i sets bit (high + i). A directory counts the ones before each 64-bit word, so the i-th one
or zero is found by one search in it and six halvings of a word.
"""

from __future__ import annotations

import json
import os
import tempfile
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import zstandard

_U = np.uint64
_ONE = _U(1)


#: For each byte and k: where its k-th set bit is.
_IN_BYTE = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    for _k, _at in enumerate(i for i in range(8) if _byte >> i & 1):
        _IN_BYTE[_byte, _k] = _at
_IN_BYTE = _IN_BYTE.ravel()


def _nth_one(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit (from 0) of each word: three halvings, then a table."""
    word, k, at = word.copy(), k.astype(np.uint8), np.zeros(len(word), np.uint8)
    for width in (32, 16, 8):
        low = np.bitwise_count(word & _U((1 << width) - 1))
        up = (k >= low).view(np.uint8)
        k -= low * up
        up *= np.uint8(width)
        at += up
        word >>= up
    at += _IN_BYTE[((word & _U(255)) << _U(3)).astype(np.int64) + (k & np.uint8(7))]
    return at.astype(np.int64)


class EliasFano:
    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high, self.before = n, bits, low, high, before
        self._zeros: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray, universe: int | None = None) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        u = max(int(universe or 0), int(v[-1]) + 1 if n else 1)
        bits = max(0, (u // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits:
            part = v & _U((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * _U(bits)
            word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero(shift + _U(bits) > _U(64))
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - shift[over]))
        ones = (v >> _U(bits)).astype(np.int64) + np.arange(n)
        size = ((u - 1) >> bits) + n + 2
        flat = np.zeros((size + 63) // 64 * 64, np.uint8)
        flat[ones] = 1
        high = np.packbits(flat, bitorder="little").view(np.uint64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))]).astype(np.uint32)
        return cls(n, bits, low, high, before)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"head": np.array([self.n, self.bits], np.int64), "low": self.low, "high": self.high, "before": self.before}

    @classmethod
    def read(cls, a: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = a[f"{name}.head"].tolist()
        return cls(n, bits, a[f"{name}.low"], a[f"{name}.high"], a[f"{name}.before"])

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * _U(self.bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        out = self.low[word] >> shift
        over = shift + _U(self.bits) > _U(64)
        if over.any():
            out[over] |= self.low[word[over] + 1] << (_U(64) - shift[over])
        return out & _U((1 << self.bits) - 1)

    def select1(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, i.astype(np.uint32), side="right") - 1
        return word * 64 + _nth_one(self.high[word], i - self.before[word])

    def select0(self, i: np.ndarray) -> np.ndarray:
        if self._zeros is None:
            self._zeros = np.arange(len(self.before), dtype=np.int64) * 64 - self.before
        word = np.minimum(np.searchsorted(self._zeros, i, side="right") - 1, len(self.high) - 1)
        return word * 64 + _nth_one(~self.high[word], i - self._zeros[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        if not len(i):
            return np.empty(0, np.int64)
        high = (self.select1(i) - i).astype(np.uint64)
        return ((high << _U(self.bits)) | self.low_bits(i)).astype(np.int64)

    def get_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places i and i + 1: the second bit mostly stands in the same word as the first."""
        if not len(i):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = self.select1(i)
        rest = self.high[at >> 6] >> (at & 63).astype(np.uint64) >> _ONE
        then = at + 1 + np.bitwise_count((rest & (~rest + _ONE)) - _ONE)
        far = np.flatnonzero(rest == 0)
        then[far] = self.select1(i[far] + 1)
        value = lambda p, k: (((p - k).astype(np.uint64) << _U(self.bits)) | self.low_bits(k)).astype(np.int64)
        return value(at, i), value(then, i + 1)

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places from and to which values have these high bits: from one zero to the next, mostly in the same word."""
        zero = np.where(high > 0, self.select0(np.maximum(high - 1, 0)), -1)
        at = zero + 1
        rest = ~self.high[at >> 6] >> (at & 63).astype(np.uint64)
        then = at + np.bitwise_count((rest & (~rest + _ONE)) - _ONE)
        far = np.flatnonzero(rest == 0)
        then[far] = self.select0(high[far])
        return at - high, then - high

    def find(self, values: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None, floor: np.ndarray | None = None, ceiling: np.ndarray | None = None) -> np.ndarray:
        """The place (within lo to hi) of each value, -1 where it is absent: the successor of the value, compared with it.

        Values between lo and hi are at least floor and below ceiling, if these are given. A bucket is searched by
        interpolation, as values within a range are spread evenly, and by halves if that doesn't end it soon.
        """
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        v = values.astype(np.int64)
        high = v >> self.bits
        ok = np.flatnonzero(high <= len(self.high) * 64 - self.n - 1)
        high = high[ok]
        start, end = self.bucket(high)
        begin = high << self.bits
        least, most = np.zeros(len(ok), np.int64), np.full(len(ok), 1 << self.bits)
        if lo is not None and hi is not None:
            start, end = np.maximum(start, lo[ok]), np.minimum(end, hi[ok])
        if floor is not None and ceiling is not None:
            least, most = np.maximum(floor[ok] - begin, 0), np.minimum(ceiling[ok] - begin, most)
        live = np.flatnonzero(start < end)
        from_, to, want, at = start[live], end[live], (v[ok] - begin)[live], ok[live]
        least, most = least[live], most[live]
        step = 0
        while len(at):
            if step % 6 < 5:
                mid = from_ + ((want - least) * ((to - from_) / (most - least))).astype(np.int64)
                mid = np.minimum(np.maximum(mid, from_), to - 1)
            else:
                mid = (from_ + to) >> 1
            step += 1
            here = self.low_bits(mid).astype(np.int64)
            hit = here == want
            out[at[hit]] = mid[hit]
            less = here < want
            from_, least = np.where(less, mid + 1, from_), np.where(less, here + 1, least)
            to, most = np.where(less, to, mid), np.where(less, most, here)
            more = np.flatnonzero((from_ < to) & ~hit & (least <= want) & (want < most))
            at, from_, to, want, least, most = at[more], from_[more], to[more], want[more], least[more], most[more]
        return out


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed bytes, byte plane after byte plane; sorted ones as differences."""
    v = values.astype(np.uint64)
    rising = bool(len(v) and (v[1:] >= v[:-1]).all())
    d = np.diff(v, prepend=_U(0)) if rising else v
    planes = max(1, -(-int(d.max()).bit_length() // 8)) if len(d) else 1
    whole = d.view(np.uint8).reshape(-1, 8)
    return bytes([rising, planes]) + zstandard.ZstdCompressor(level=1).compress(b"".join(whole[:, k].tobytes() for k in range(planes)))


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[2:]), np.uint8).reshape(data[1], -1)
    whole = np.zeros((raw.shape[1], 8), np.uint8)
    whole[:, : data[1]] = raw.T
    v = whole.view(np.uint64).ravel()
    return np.cumsum(v, dtype=np.uint64) if data[0] else v


def _plain(path: str) -> str | None:
    u = urlparse(path)
    return u.path if u.scheme in ("", "file") else None


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays as one file on shared storage; a file appears whole or not at all, so attempts of a task can repeat."""
    spec, at, parts = {}, 0, []
    for name, a in arrays.items():
        data = np.ascontiguousarray(a).tobytes()
        spec[name] = [at, len(a), a.dtype.str]
        parts += [data, b"\0" * (-len(data) % 8)]
        at += len(data) + -len(data) % 8
    head = json.dumps(spec).encode()
    head += b" " * (-len(head) % 8)
    whole = b"".join([len(head).to_bytes(8, "little"), head, *parts])
    if local := _plain(path):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        fd, name = tempfile.mkstemp(dir=os.path.dirname(local))
        with os.fdopen(fd, "wb") as f:
            f.write(whole)
        os.chmod(name, 0o644)
        os.replace(name, local)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    name = f"{inner}.{os.getpid()}.{os.urandom(4).hex()}"
    with store.open_output_stream(name) as f:
        f.write(whole)
    store.move(name, inner)


def _arrays(raw: np.ndarray) -> dict[str, np.ndarray]:
    size = int.from_bytes(raw[:8].tobytes(), "little")
    spec = json.loads(raw[8 : 8 + size].tobytes())
    begin = 8 + size
    return {k: raw[begin + at : begin + at + n * np.dtype(d).itemsize].view(d) for k, (at, n, d) in spec.items()}


#: Maps of files that a worker keeps: they take address space, not memory.
@lru_cache(8192)
def _mapped(path: str) -> dict[str, np.ndarray]:
    return _arrays(np.memmap(path, np.uint8, "r").view(np.ndarray))


#: Files of a store that can't be mapped, which a worker holds in memory.
@lru_cache(8)
def _held(path: str) -> dict[str, np.ndarray]:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as f:
        return _arrays(np.frombuffer(f.read(), np.uint8))


def read_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; from a store that can't be mapped, in memory, a few files at a time."""
    local = _plain(path)
    return _held(path) if local is None else _mapped(local)


@lru_cache(16384)
def _mapped_sequence(path: str, name: str) -> EliasFano:
    return EliasFano.read(read_arrays(path), name)


def sequence(path: str, name: str) -> EliasFano:
    """A sequence of a file."""
    return EliasFano.read(read_arrays(path), name) if _plain(path) is None else _mapped_sequence(path, name)
