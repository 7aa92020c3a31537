"""Packing of token sequences: Martello-Toth dominance reduction, then best fit over what remains.

The plan is made from the histogram of piece lengths, which has as many entries as a sequence has tokens, whatever the
input. The reduction takes an anchor length and asks whether one small set with it dominates every other feasible set
(then some optimal packing uses it, so it is fixed for good, as often as the counts allow):

* nothing fits beside the anchor: it stands alone;
* the largest length that fits fills the sequence exactly, or only one more can fit: that pair;
* no more than two can fit, and the largest that fits is at least as large as any two together: that pair;
* no more than two can fit, the largest that fits (a) and the largest beside both (b) leave no feasible pair whose
  smaller member exceeds b: that triple.

The rest is packed by best fit, longest first. Bins with the same contents are one group with a count, so the plan is
exactly that of best-fit decreasing over all pieces and its work is bounded by the capacity. Pieces then get their
place by rank within their length; ranks are counted over salted sub-groups, of n pieces of a length about the root of n
of as many pieces each, so neither the pieces of a length nor its sub-groups are many in one task.

Defined results: null text is empty text (one piece, the end token alone); a document longer than the capacity is cut
from its end into full pieces, so only the first piece may be shorter; rows that repeat an id are packed as documents of
their own; every piece has exactly one place and places are gapless; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.llm.bpe import PATTERN, Bpe, chunks, default_path
from loomwright.llm.common import arrow_batched, beside, only, stored, table, texts_of

CAPACITY, END_ID = 2048, 0
#: Runs of one kind of character (white space or not) from which on the segment tree encodes a text: the fast encoder's
#: time grows with the square of a piece. The ids are the same.
LONG_RUN = 20_000

#: A group of equal bins: how many, and (length, how often) in order of their offsets.
Group = tuple[int, tuple[tuple[int, int], ...]]


class FastEncoder:
    """tiktoken with the vocabulary of a tokenizer file; the ids are the same."""

    def __init__(self, path: str) -> None:
        import re

        import tiktoken

        self.own = Bpe(path)
        ranks = {self.own.token_bytes[i]: i for i in range(len(self.own.token_bytes)) if i not in self.own.special.values()}
        if (np.diff(self.own.made) <= 0).any():
            raise ValueError("ids don't follow the order of merges")
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.own.special)
        self.long_run = re.compile(r"\s{%d}|\S{%d}" % (LONG_RUN, LONG_RUN))

    def ids(self, text: str) -> np.ndarray:
        if len(text) > LONG_RUN and self.long_run.search(text):
            return np.frombuffer(self.own.encode([text])[0], "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


@lru_cache(2)
def encoder(path: str) -> FastEncoder:
    return FastEncoder(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of n ids."""
    first = n % capacity if n > capacity else n
    out = [(0, first)] if first else []
    return out + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document: piece, start, length and the CRC-32 of their ids."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b, text_col)
            for i, j in chunks(texts):
                rows: list[tuple[int, int, int, int, int]] = []
                for k in range(i, j):
                    ids = np.append(encoder(path).ids(texts[k]), np.array(END_ID, "<u4")).astype("<u4", copy=False)
                    rows += [(k, p, s, n, zlib.crc32(ids[s : s + n].tobytes())) for p, (s, n) in enumerate(cuts(len(ids), capacity))]
                at, *cols = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                cols[0] = cols[0].astype(np.int32)
                yield beside(b.column(id_col).take(pa.array(at)), dict(zip(("piece", "start", "length", "ids_crc32"), cols, strict=True)), id_col)

    src = only(docs, [id_col, text_col])
    return arrow_batched(src, run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Group], dict[int, int]]:
    """Bins that are fixed for good, and the lengths left."""
    left = np.zeros(capacity + 1, np.int64)
    for s, c in counts.items():
        left[s] += c
    fixed: list[Group] = []

    def largest(most: int, *taken: int) -> int:
        """The largest length up to `most` of which one is left beside those taken; 0 if none."""
        for s in np.flatnonzero(left[: max(most, 0) + 1])[::-1].tolist():
            if left[s] > taken.count(s):
                return s
        return 0

    def smallest(n: int, anchor: int) -> list[int]:
        out: list[int] = []
        for s in np.flatnonzero(left).tolist():
            out += [s] * int(min(n - len(out), left[s] - (s == anchor)))
            if len(out) >= n:
                break
        return out

    def fix(*sizes: int) -> None:
        need = Counter(sizes)
        times = min(int(left[s]) // n for s, n in need.items())
        for s, n in need.items():
            left[s] -= times * n
        fixed.append((times, tuple(sorted(need.items(), reverse=True))))

    for anchor in range(capacity, 0, -1):
        while left[anchor]:
            room = capacity - anchor
            low = smallest(3, anchor)
            fit = next((k for k in range(len(low), 0, -1) if sum(low[:k]) <= room), 0)
            if not fit:
                fix(anchor)
                continue
            a = largest(room, anchor)
            if fit == 1 or a == room:
                fix(anchor, a)
                continue
            if fit == 2 or len(low) < 3:
                pair = max((x + y for x in np.flatnonzero(left[: room + 1]).tolist() if left[x] > (x == anchor) for y in [largest(min(x, room - x), anchor, x)] if y), default=0)
                if a >= pair:
                    fix(anchor, a)
                    continue
                b = largest(room - a, anchor, a)
                if b and b >= largest(room // 2, anchor):
                    fix(anchor, a, b)
                    continue
            break
    return fixed, {s: int(left[s]) for s in np.flatnonzero(left).tolist()}


def best_fit(counts: dict[int, int], capacity: int) -> list[Group]:
    """Best fit, longest first, of all pieces: equal bins move as groups."""
    open_: list[list[Group]] = [[] for _ in range(capacity + 1)]
    for s in sorted(counts, reverse=True):
        c = counts[s]
        while c:
            room = next((r for r in range(s, capacity) if open_[r]), capacity)
            times, inside = open_[room].pop() if room < capacity or open_[room] else (-(-c // (capacity // s)), ())
            q = room // s
            whole = min(times, c // q)
            if whole:
                open_[room - q * s].append((whole, (*inside, (s, q))))
            c, times = c - whole * q, times - whole
            if times and c:
                open_[room - c * s].append((1, (*inside, (s, c))))
                c, times = 0, times - 1
            if times and (inside or room < capacity):
                open_[room].append((times, inside))
    return [g for groups in open_ for g in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def segments(groups: list[Group]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a bin, first sequence, offset): which ranks of a length go where."""
    at: Counter[int] = Counter()
    out, sequence = [], 0
    for times, inside in groups:
        offset = 0
        for s, q in inside:
            out.append((s, at[s], at[s] + q * times, q, sequence, offset))
            at[s] += q * times
            offset += q * s
        sequence += times
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """sequence_id and offset for each row of a stored table of pieces."""
    spark = cut.sparkSession
    lengths = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    schema = "length long, _from long, _to long, _q long, _sequence long, _offset long"
    places = spark.createDataFrame(segments(plan(lengths, capacity)), schema)  # bounded by the capacity
    groups = spark.createDataFrame([(s, math.isqrt(n - 1) + 1) for s, n in lengths.items()], "length long, _groups long")
    salted = cut.join(F.broadcast(groups), "length").withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), "_groups")).drop("_groups")
    sub = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = sub.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("_rank", rank).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    on = (ranked["length"] == places["length"]) & (ranked["_rank"] >= places["_from"]) & (ranked["_rank"] < places["_to"])
    nth = F.col("_rank") - F.col("_from")
    return ranked.join(F.broadcast(places), on).select(
        *[ranked[c] for c in cut.columns],
        (F.col("_sequence") + F.floor(nth / F.col("_q"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(nth, F.col("_q")) * ranked["length"]).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(stored(pieces(docs, path, capacity), "pieces"), capacity)


def op9_martello_toth_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
