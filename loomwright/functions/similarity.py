"""Likeness of words, spelling and segmentation: what Spark's functions do not have, as Arrow UDFs."""

from __future__ import annotations

import difflib
import math
import re
from collections import deque
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Letters by which known words are looked up, and runs of so many that are remembered; by how much equal sums of costs may differ by rounding.
HEAD, HEADS_KEPT, ROUNDING = 4, 200_000, 1e-7
#: Places of texts of like length that are split side by side; texts that are too few for that are split one by one.
CELLS, FEW = 1 << 20, 12


@pandas_udf(T.DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 M / T: M characters in matching blocks, T characters in all."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def close_matches(word: Column, words: Sequence[str], k: int = 3, cutoff: float = 0.6) -> Column:
    """Up to k of the words, the likest first, that have a ratio of at least cutoff. words is a small list."""
    known = list(words)

    @pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        seen: dict[str, list[str]] = {}
        return s.map(lambda x: None if x is None else seen.setdefault(x, difflib.get_close_matches(x, known, k, cutoff)))

    return run(word)


def _edits(w: str) -> set[str]:
    letters = "abcdefghijklmnopqrstuvwxyz"
    cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return {a + b[1:] for a, b in cut if b} | {a + b[1] + b[0] + b[2:] for a, b in cut if len(b) > 1} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}


def corrected(word: str, counts: Mapping[str, int]) -> str:
    """The most frequent known word within two edits; fewer edits come first, then the alphabet."""
    if word in counts or not word:
        return word
    one = _edits(word)
    for found in ({w for w in one if w in counts}, {w for x in one for w in _edits(x) if w in counts}):
        if found:
            return min(found, key=lambda w: (-counts[w], w))
    return word


def correct_spelling(text: Column, counts: Mapping[str, int]) -> Column:
    """Each word of the text, corrected. counts: a dictionary of bounded size, sent with the function."""
    known = dict(counts)

    @pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}
        fix = lambda w: seen[w] if w in seen else seen.setdefault(w, corrected(w, known))
        return s.map(lambda x: None if x is None else " ".join(map(fix, x.split())))

    return run(text)


def word_splitter(counts: Mapping[str, int], total: int, longest: int) -> Callable[[str], list[str]]:
    """The likeliest words in a row that make up a text without spaces; an unknown one costs ten times as much a letter.

    Known words are found from where they start, by their first letters. An unknown word's cost grows by one a letter, so
    its best start is among those of least cost less place, which a queue holds for the last `longest` places; the costs of
    those that are equal but for rounding are compared as they are.
    """
    known = {w: math.log10(total / n) for w, n in counts.items() if 0 < len(w) <= longest}
    lengths: dict[str, set[int]] = {}
    for w in known:
        if len(w) > HEAD:
            lengths.setdefault(w[:HEAD], set()).add(len(w))
    heads = {h: sorted(s) for h, s in lengths.items()}
    unknown, slack = math.log10(total), 2 * (longest + 2) * ROUNDING
    seen: dict[str, tuple[list[tuple[int, float]], list[int]]] = {}

    def begun(head: str) -> tuple[list[tuple[int, float]], list[int]]:
        """Known words that a head begins with, as lengths and costs, and the lengths of longer ones."""
        if len(seen) > HEADS_KEPT:
            seen.clear()
        return seen.setdefault(head, ([(k, known[head[:k]]) for k in range(1, len(head) + 1) if head[:k] in known], heads.get(head, [])))

    def split(glued: str) -> list[str]:
        n = len(glued)
        best, came, gap, low = [math.inf] * (n + 1), [0] * (n + 1), [0.0] * (n + 1), deque([0])
        best[0] = here = 0.0
        for at in range(n + 1):
            if at:
                if low[0] < at - longest:
                    low.popleft()
                here = best[at]
                if gap[low[0]] + (at + unknown - 1) <= here + slack:
                    start, least = came[at], math.inf
                    for s in low:
                        g = gap[s]
                        if g > least + slack:
                            break
                        if g < least:
                            least = g
                        c = best[s] + (unknown + (at - s) - 1)
                        if (c < here or (c == here and s < start)) and glued[s:at] not in known:
                            here, start = c, s
                    best[at], came[at] = here, start
                gap[at] = here - at
                most = gap[at] + ROUNDING
                while low and gap[low[-1]] > most:
                    low.pop()
                low.append(at)
            head = glued[at : at + HEAD]
            words, longer = seen.get(head) or begun(head)
            for k, cost in words:
                if here + cost < best[at + k]:
                    best[at + k], came[at + k] = here + cost, at
            for k in longer:
                cost = known.get(glued[at : at + k])
                if cost is not None and at + k <= n and here + cost < best[at + k]:
                    best[at + k], came[at + k] = here + cost, at
        out, end = [], n
        while end:
            out.append(glued[came[end] : end])
            end = came[end]
        return out[::-1]

    return split


def split_words(glued: str, counts: Mapping[str, int], total: int, longest: int) -> list[str]:
    """One text split by word_splitter()."""
    return word_splitter(counts, total, longest)(glued)


class Prefixes:
    """The prefixes of some words as numbered nodes (0: the empty one), found for many texts at once by a table of (node, letter)."""

    def __init__(self, words: Mapping[str, float]) -> None:
        edges: dict[tuple[int, str], int] = {}
        ends: dict[int, float] = {}
        for w, cost in words.items():
            node = 0
            for c in w:
                node = edges.setdefault((node, c), len(edges) + 1)
            ends[node] = cost
        self.cost = np.full(len(edges) + 1, np.inf)
        self.cost[list(ends)] = list(ends.values())
        self.bits = max(len(edges) * 2, 2).bit_length()
        keys = np.array([(node << 21) | ord(c) for node, c in edges] or [0], np.int64)[: len(edges)]
        self.keys, self.next = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            done = self.keys[at] == keys[left]
            self.next[at[done]] = left[done] + 1
            left, at = left[~done], (at[~done] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def after(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The nodes one letter on; 0 where there is none."""
        keys = (nodes.astype(np.int64) << 21) | letters
        at, out = self._slot(keys), np.zeros(len(keys), np.int32)
        left = np.arange(len(keys))
        while len(left):
            got = self.keys[at]
            hit = got == keys[left]
            out[left[hit]] = self.next[at[hit]]
            more = ~hit & (got != -1)
            left, at = left[more], (at[more] + 1) & (len(self.keys) - 1)
        return out


def texts_splitter(counts: Mapping[str, int], total: int, longest: int) -> Callable[[Sequence[str]], list[list[str]]]:
    """word_splitter() of many texts: those of like length go side by side, a place at a time, with the same costs and ties."""
    known = {w: math.log10(total / n) for w, n in counts.items() if 0 < len(w) <= longest}
    prefixes, unknown, one = Prefixes(known), math.log10(total), word_splitter(counts, total, longest)

    def side_by_side(texts: list[str]) -> list[list[str]]:
        """texts: the longest first."""
        sizes = np.array([len(t) for t in texts])
        letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        line = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # known words: where they start, how long they are and what they cost
        at, node, found, rest = np.arange(len(letters)), np.zeros(len(letters), np.int32), [], np.repeat(sizes, sizes) - place
        for k in range(1, longest + 1):
            inside = rest[at] >= k
            at, node = at[inside], node[inside]
            node = prefixes.after(node, letters[at + k - 1])
            some = np.flatnonzero(node)
            at, node = at[some], node[some]
            if not len(at):
                break
            word = np.isfinite(prefixes.cost[node])
            found.append((place[at[word]], line[at[word]], np.full(int(word.sum()), k), prefixes.cost[node[word]]))
        start, owner, size, cost = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 4
        order = np.argsort(start, kind="stable")
        start, owner, size, cost = start[order], owner[order], size[order], cost[order]
        most, n = int(sizes[0]), len(texts)
        spans = np.searchsorted(start, np.arange(most + 1)).tolist() + [len(start)]
        open_ = np.searchsorted(-sizes, -np.arange(most + 1), side="right").tolist()  # texts that have the place
        best, came = np.full((most + 1, n), np.inf), np.zeros((most + 1, n), np.int32)
        best[0] = 0.0
        every, single = np.arange(n), np.zeros(n, bool)  # whether the letter before is a known word
        for e in range(most + 1):
            m = open_[e]
            if e:
                low = max(0, e - longest)
                guess = best[low:e, :m] + (unknown + np.arange(e - low, 0, -1) - 1)[:, None]
                guess[-1, single[:m]] = np.inf
                first = guess.argmin(0)
                least, from_ = guess[first, every[:m]], first + low
                take = (least < best[e, :m]) | ((least == best[e, :m]) & (from_ < came[e, :m]))
                best[e, :m][take], came[e, :m][take] = least[take], from_[take]
            a, b = spans[e], spans[e + 1]
            o, k = owner[a:b], size[a:b]
            single[:] = False
            single[o[k == 1]] = True
            if b > a:
                c = best[e, o] + cost[a:b]
                less = c < best[e + k, o]
                to, o = e + k[less], o[less]
                best[to, o], came[to, o] = c[less], e
        out = []
        for i, t in enumerate(texts):
            back, words, end = came[: len(t) + 1, i].tolist(), [], len(t)
            while end:
                words.append(t[back[end] : end])
                end = back[end]
            out.append(words[::-1])
        return out

    def split(texts: Sequence[str]) -> list[list[str]]:
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        out: list[list[str]] = [[]] * len(texts)
        while order:
            longest_text = len(texts[order[0]])
            if not longest_text:
                break
            some, order = order[: max(CELLS // (longest_text + 1), 1)], order[max(CELLS // (longest_text + 1), 1) :]
            part = [texts[i] for i in some]
            for i, words in zip(some, side_by_side(part) if len(part) >= FEW else map(one, part), strict=True):
                out[i] = words
        return out

    return split


def segment(text: Column, counts: Mapping[str, int]) -> Column:
    """Each run of letters and digits of the text, split into known words by their frequencies (a dictionary of bounded size)."""
    known = dict(counts)
    split = texts_splitter(known, max(sum(known.values()), 1), max([24, *map(len, known)]))
    other = re.compile(r"[\W_]+")

    @pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        texts = [None if x is None else [other.sub("", w) for w in x.lower().split()] for x in s]
        each = list(dict.fromkeys(w for ws in texts for w in ws or ()))
        seen = dict(zip(each, (" ".join(ws) for ws in split(each)), strict=True))
        return pd.Series([None if ws is None else " ".join(map(seen.__getitem__, ws)) for ws in texts], dtype=object)

    return run(F.coalesce(text, F.lit("")))
