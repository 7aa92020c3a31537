"""Words of many texts at once: boundaries and 64-bit hashes in numpy, without a Python object for each word.

A word is a longest run of bytes other than space and \\x09 to \\x0D, with A-Z lowered. Its hash is a polynomial over
random 64-bit values of its bytes, taken as a difference of running sums, and mixed. Two of n different words share a
hash with a chance of about n * n / 2 ** 65.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


with np.errstate(over="ignore"):
    _VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE) | _U(1)
    _LOWER = np.arange(256, dtype=np.uint8)
    _LOWER[65:91] += 32
    _VALUE = _VALUE[_LOWER]
    _IS_WORD = np.ones(256, np.int8)
    _IS_WORD[[32, 9, 10, 11, 12, 13]] = 0
    _INVERSE = _U(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]
#: Powers that are kept; for more bytes at once they are made for that call alone.
KEPT = 1 << 20


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1, at least, of the base and of its inverse."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    out = []
    for b in (_BASE, _INVERSE):
        x = np.full(max(n, KEPT), b)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    if n <= KEPT:
        _powers[:] = out
    return out[0], out[1]


@dataclass
class Words:
    hashes: np.ndarray  #: of all words, text after text
    offsets: np.ndarray  #: text i has the words offsets[i] to offsets[i + 1]
    starts: np.ndarray
    ends: np.ndarray
    sums: np.ndarray  #: running sums, for hashes of parts of words
    inverse: np.ndarray  #: powers of the inverse of the base

    def part(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from starts to ends."""
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def words(texts: list[str | None]) -> Words:
    """The words of each text; None has none."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    text_at = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(d) + 1 for d in data], out=text_at[1:])
    step = np.diff(_IS_WORD[buf], prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    powers, inverse = _power_tables(len(buf) + 1)
    np.cumsum(_VALUE[buf] * powers[: len(buf)], out=sums[1:])
    out = Words(np.empty(0, np.uint64), np.searchsorted(starts, text_at), starts, ends, sums, inverse)
    out.hashes = out.part(starts, ends)
    return out
