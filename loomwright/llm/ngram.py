"""Scoring of texts with an n-gram model held in Elias-Fano tries.

The model is an interpolated trigram model with absolute discounting. Its levels are files in the shared folder, which
the workers map into memory: level 1 has the hashes of all words with exact cumulative counts; levels 2 and 3 have, for
all n-grams seen, those seen once too, monotone pointers from each context to its range of successors, the successors' ids
made monotone by the last value of the range before, and 8-bit codes of the smoothed log probabilities and of the
contexts' interpolation weights, with a code book for each file. An n-gram is looked up by a successor search for its id,
relative to its context's base, within the context's range.

A level is cut into files at equal steps of the cumulative count of (context, word), so a file's size does not depend
on how frequent a context is: the most frequent contexts run over many files. Counting goes level by level over the
whole training text: each task counts a part of the corpus, sends sorted, packed runs of n-grams to the files they
belong to, and these runs are merged there. A run of trigrams brings along the smoothed probabilities of the shorter
n-grams, which its task has just looked up, so nothing is looked up again when the level is written. What must be known
of each file of a level (a row for each FILE_BYTES of text) is an index file beside them, mapped like them: neither the
driver nor a broadcast holds it.

p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))
p(w | context) = max(c(context w) - D, 0) / c(context) + weight(context) p(w | shorter context),
where the weight is what remains to 1.

Defined results: null or empty text has the end token alone; rows with a null id are learned from; rows that repeat are
counted and scored as often; words unknown to the model get p1 with a count of 0; with nothing to learn from N and V
are 0 and each token has probability 1; texts of any length are whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.bpe import chunks
from loomwright.llm.common import arrow_batched, batched, beside, scratch_path, stored, table, texts_of
from loomwright.llm.elias_fano import EliasFano, pack, read_arrays, sequence, unpack, write_arrays
from loomwright.llm.tokens import words

DISCOUNT = 0.75
#: Bytes of text for each file of a level, the fewest files, entries that a counting task holds before it sends them.
FILE_BYTES, FEWEST_FILES, HELD = 32_000_000, 64, 2_000_000
#: Characters that are looked up at once (the more, the fewer n-grams are looked up twice), and rows sent at once.
TEXT_CHARS, ROWS_AT_ONCE = 4_000_000, 2000
#: Characters whose words are found at once: as many as the powers that are kept are for.
WORD_CHARS = 700_000
#: Steps of a natural logarithm in which runs carry probabilities: 16 bits reach down to exp(-32).
LOG_STEPS = 2048
#: Tasks that write a level, at most; each writes some files, one after the other.
WRITERS = 20_000
#: The end of a text, as the hash of a word; 64 bits that no word is expected to have.
END = np.uint64(0x5EED0FE2D0C0FFEE)


@dataclass
class Level:
    """Of each file: entries before it, counts before it, first and last context (level 2 and 3)."""

    first: np.ndarray
    total: np.ndarray
    low: np.ndarray
    high: np.ndarray
    split: np.ndarray  #: contexts at the ends of files
    split_weight: np.ndarray

    @property
    def n(self) -> int:
        return int(self.first[-1])

    @property
    def sum(self) -> int:
        return int(self.total[-1])


@lru_cache(64)
def index(path: str, order: int) -> Level:
    a = read_arrays(f"{path}/index{order}.ef")
    return Level(*(a[k] for k in ("first", "total", "low", "high", "split", "split_weight")))


@dataclass
class Model:
    path: str
    files: int
    docs: int = 0
    orders: int = 0

    @property
    def levels(self) -> list[Level]:
        return [index(self.path, k + 1) for k in range(self.orders)]

    @property
    def tokens(self) -> int:
        return self.levels[0].sum

    @property
    def vocabulary(self) -> int:
        return self.levels[0].n

    @property
    def start(self) -> int:
        """The id of the start of a text; not a token."""
        return self.vocabulary

    def p1(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1))

    def file(self, order: int, i: int) -> str:
        return f"{self.path}/level{order}/{i:06d}.ef"


def by_file(which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each file with the places of its queries."""
    order = np.argsort(which, kind="stable")
    edges = np.flatnonzero(np.diff(which[order], prepend=-1, append=-2))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(which[order[a]]), order[a:b]


def find_words(m: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id (-1 if unknown), count and count of all before, of each hash."""
    ids, count, before = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
    shift = np.uint64(64 - (m.files.bit_length() - 1))
    level = m.levels[0]
    for f, at in by_file((hashes >> shift).astype(np.int64)):
        if level.first[f + 1] == level.first[f]:
            continue
        i = sequence(m.file(1, f), "keys").find(hashes[at] & ((np.uint64(1) << shift) - np.uint64(1)))
        hit = i >= 0
        at, i = at[hit], i[hit]
        a, b = sequence(m.file(1, f), "cum").get_two(i)
        ids[at], before[at], count[at] = i + level.first[f], a + level.total[f], b - a
    return ids, count, before


def counts_of(m: Model, order: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count, and count of all before, of the entries of a level; the start of texts stands after all words."""
    count, before = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    level = m.levels[order - 1]
    for f, at in by_file(np.searchsorted(level.first, ids, side="right") - 1):
        if f >= len(level.first) - 1:
            count[at], before[at] = m.docs, level.sum
            continue
        a, b = sequence(m.file(order, f), "cum").get_two(ids[at] - level.first[f])
        before[at], count[at] = a + level.total[f], b - a
    return count, before


def file_of(m: Model, order: int, before: np.ndarray, count: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The file that has a word after a context, from the context's count and the count before it."""
    all_ = m.levels[order - 2].sum + (m.docs if order == 2 else 0)
    place = before + count * (word / (m.vocabulary + 1.0))
    return np.minimum((place * (m.files / max(all_, 1))).astype(np.int64), m.files - 1)


def find_grams(m: Model, order: int, parent: np.ndarray, word: np.ndarray, count: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in the level (-1 if absent) and probability of each word after its context (both known)."""
    place, p = np.full(len(parent), -1, np.int64), np.zeros(len(parent))
    level = m.levels[order - 1]
    for f, at in by_file(file_of(m, order, before, count, word)):
        if level.first[f + 1] == level.first[f]:
            continue
        at = at[(parent[at] >= level.low[f]) & (parent[at] <= level.high[f])]
        path, one = m.file(order, f), parent[at] - level.low[f]
        new = np.concatenate([[True], one[1:] != one[:-1]])[: len(one)]  # queries come sorted: once for each context
        pointers, ids = sequence(path, "pointers"), sequence(path, "ids")
        lo, hi = pointers.get_two(one[new])
        base = np.where(lo > 0, ids.get(np.maximum(lo - 1, 0)), -1)
        of = np.cumsum(new) - 1
        lo, hi, base = lo[of], hi[of], base[of]
        some = lo < hi
        at, lo, hi, base = at[some], lo[some], hi[some], base[some]
        i = ids.find(base + 1 + word[at], lo, hi, base + 1, base + 2 + m.vocabulary)
        hit = i >= 0
        a = read_arrays(path)
        place[at[hit]], p[at[hit]] = i[hit] + level.first[f], a["book"][a["code"][i[hit]]]
    return place, p


def weights(m: Model, order: int, parent: np.ndarray, count: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The interpolation weight of each context of a level."""
    out = np.ones(len(parent))
    level = m.levels[order - 1]
    for f, at in by_file(file_of(m, order, before, count, np.zeros(len(parent)))):
        if level.first[f + 1] == level.first[f]:
            continue
        at = at[(parent[at] >= level.low[f]) & (parent[at] <= level.high[f])]
        a = read_arrays(m.file(order, f))
        out[at] = a["weight_book"][a["weight"][parent[at] - level.low[f]]]
    if len(level.split):
        i = np.minimum(np.searchsorted(level.split, parent), len(level.split) - 1)
        out = np.where(level.split[i] == parent, level.split_weight[i], out)
    return out


@dataclass
class Text:
    """Tokens of some texts: for each the place of its word among the distinct ones, -1 for the start of a text."""

    word: np.ndarray
    is_start: np.ndarray
    ends: np.ndarray  #: end of each text in the arrays
    hashes: np.ndarray  #: distinct


def read_texts(texts: list[str]) -> Text:
    found = [(w.counts, w.hashes) for i, j in chunks(texts, WORD_CHARS) for w in [words(texts[i:j])]]
    counts, words_of = (np.concatenate([np.empty(0, t), *part]) for t, part in zip((np.int64, np.uint64), zip(*found, strict=True) if found else ((), ()), strict=True))
    size = counts + 2
    ends = np.cumsum(size)
    all_ = np.full(int(ends[-1]) if len(ends) else 0, END)
    is_start = np.zeros(len(all_), bool)
    is_start[ends - size] = True
    inner = ~is_start
    inner[ends - 1] = False
    all_[inner] = words_of
    hashes, word = np.unique(all_, return_inverse=True)
    return Text(np.where(is_start, -1, word), is_start, ends, hashes)


def distinct(p: np.ndarray, w: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, with the place of each given one among them."""
    if not len(p) or int(p.max()) < 2**62 // max(width, 1):
        key, back = np.unique(p * width + w, return_inverse=True)
        return key // max(width, 1), key % max(width, 1), back
    order = np.lexsort((w, p))
    p, w = p[order], w[order]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (w[1:] != w[:-1])])
    back = np.empty(len(p), np.int64)
    back[order] = np.cumsum(new) - 1
    return p[new], w[new], back


@dataclass
class Grams:
    """The tokens of some texts against levels 1 and 2."""

    ids: np.ndarray
    count: np.ndarray
    before: np.ndarray
    at: np.ndarray  #: places of tokens (not of starts)
    pair_of: np.ndarray  #: of each place the distinct pair that ends there, or -1
    a: np.ndarray
    b: np.ndarray
    a_count: np.ndarray
    a_before: np.ndarray


def level_one(m: Model, t: Text) -> Grams:
    ids, count, before = (np.append(x, y) for x, y in zip(find_words(m, t.hashes), (m.start, m.docs, m.tokens), strict=True))
    ids, count, before = ids[t.word], count[t.word], before[t.word]  # -1 is the start
    at = np.flatnonzero(~t.is_start)
    known = at[(ids[at] >= 0) & (ids[at - 1] >= 0)]
    a, b, back = distinct(ids[known - 1], ids[known], m.vocabulary + 1)
    pair_of = np.full(len(ids), -1, np.int64)
    pair_of[known] = back
    one = np.zeros(len(a), np.int64)
    one[back] = known
    return Grams(ids, count, before, at, pair_of, a, b, count[one - 1], before[one - 1])


class Runs:
    """Counts of a task (context, word, count, code of the shorter n-gram), sent as sorted runs for each file when too many are held."""

    def __init__(self, which: Callable) -> None:
        self.which, self.parts, self.held = which, [], 0

    def add(self, p: np.ndarray, w: np.ndarray, c: np.ndarray, s: np.ndarray) -> Iterator[pd.DataFrame]:
        self.parts.append((p, w, c.astype(np.int32), s.astype(np.uint16)))
        self.held += len(p)
        if self.held >= HELD:
            yield from self.send()

    def send(self) -> Iterator[pd.DataFrame]:
        if not self.held:
            return
        got = summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.parts, self.held = [], 0
        rows = [(f, *(pack(x[at]) for x in got)) for f, at in by_file(self.which(*got[:2]))]
        yield pd.DataFrame(rows, columns=["file", "p", "w", "c", "s"])


def summed(p: np.ndarray, w: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order with the sums of their counts."""
    width = int(w.max()) + 1 if len(w) else 1
    if width == 1:
        order = np.argsort(p, kind="stable")
    elif int(p.max()) < 2**62 // width:
        order = np.argsort(p.astype(np.int64) * width + w, kind="stable")
    else:
        order = np.lexsort((w, p))
    p, w, c, s = p[order], w[order], c[order], s[order]
    at = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (w[1:] != w[:-1])])) if len(p) else np.empty(0, np.int64)
    return p[at], w[at], np.add.reduceat(c, at) if len(p) else c, s[at]


RUN = "file long, p binary, w binary, c binary, s binary"
STATS = "file long, n long, total long, low long, low_sum double, high long, high_sum double"


def counted(train: DataFrame, model: Model) -> DataFrame:
    """Runs of the level that comes next."""
    order = model.orders + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if order == 1:
            shift = np.uint64(64 - (model.files.bit_length() - 1))
            runs = Runs(lambda p, w: (p >> shift).astype(np.int64))
        else:
            runs = Runs(lambda p, w: file_of(model, order, *spread(p, lambda x: counts_of(model, order - 1, x))[::-1], w))
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            for i, j in chunks(texts, TEXT_CHARS):
                t = read_texts(texts[i:j])
                if order == 1:
                    c = np.bincount(t.word[~t.is_start], minlength=len(t.hashes))
                    some = c > 0
                    none = np.zeros(int(some.sum()), np.int64)
                    yield from runs.add(t.hashes[some], none, c[some], none)
                    continue
                g = level_one(model, t)
                if order == 2:
                    yield from runs.add(g.a, g.b, np.bincount(g.pair_of[g.pair_of >= 0], minlength=len(g.a)), np.zeros(len(g.a), np.int64))
                    continue
                place, q = find_grams(model, 2, g.a, g.b, g.a_count, g.a_before)
                of = np.where(g.pair_of >= 0, np.append(place, -1)[g.pair_of], -1)
                third = g.at[(of[g.at] >= 0) & (of[g.at - 1] >= 0)]
                p, w, back = distinct(of[third - 1], g.ids[third], model.vocabulary + 1)
                shorter = np.zeros(len(p), np.int64)
                shorter[back] = np.minimum(np.rint(-np.log(q) * LOG_STEPS), 65535).astype(np.int64)[g.pair_of[third]]
                yield from runs.add(p, w, np.bincount(back, minlength=len(p)), shorter)
        yield from runs.send()

    return batched(train.select("text"), run, RUN, ROWS_AT_ONCE)


def spread(keys: np.ndarray, of: Callable) -> tuple[np.ndarray, ...]:
    """What `of` gives for sorted keys, asked once for each."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    back = np.cumsum(new) - 1
    return tuple(x[back] for x in of(keys[new]))


STAT_NAMES = ["file", "n", "total", "low", "low_sum", "high", "high_sum"]


def merged(runs: DataFrame, model: Model) -> DataFrame:
    """Merges the runs of each file, writes words whole and longer n-grams raw; a stored row for each file."""
    order, path, files = model.orders + 1, model.path, model.files

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = int(pdf["file"].iloc[0])
        p, w, c, s = summed(*(np.concatenate([unpack(x) for x in pdf[k]]).astype(np.uint64 if order == 1 and k == "p" else np.int64) for k in "pwcs"))
        if order == 1:
            shift = np.uint64(64 - (files.bit_length() - 1))
            mask = (np.uint64(1) << shift) - np.uint64(1)
            arrays = {f"keys.{k}": v for k, v in EliasFano.of(p & mask, int(mask) + 1).arrays().items()}
            arrays |= {f"cum.{k}": v for k, v in EliasFano.of(np.append(0, np.cumsum(c))).arrays().items()}
            write_arrays(f"{path}/level1/{f:06d}.ef", arrays)
            return pd.DataFrame([(f, len(p), c.sum(), 0, 0.0, 0, 0.0)], columns=STAT_NAMES)
        write_arrays(f"{path}/raw{order}/{f:06d}.ef", {k: np.frombuffer(pack(x), np.uint8) for k, x in zip("pwcs", (p, w, c, s), strict=True)})
        ends = (int(p[0]), int(p[-1]))
        left = [float((c - DISCOUNT)[p == e].sum()) for e in ends]
        return pd.DataFrame([(f, len(p), c.sum(), ends[0], left[0], ends[1], left[1])], columns=STAT_NAMES)

    return stored(runs.groupBy("file").applyInPandas(run, STATS), "files")


def book_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """256 logarithms at even steps, and the code of the nearest one for each value."""
    low, high = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
    book = np.linspace(low, high, 256)
    return book, np.rint((values - low) / max((high - low) / 255, 1e-12)).astype(np.uint8)


def write_index(stats: DataFrame, model: Model) -> None:
    """The index of a level from the rows of its files, which are few (one for each FILE_BYTES of text), by one task."""
    order = model.orders + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = pd.concat([pd.DataFrame({c: np.empty(0) for c in STAT_NAMES}), *batches])
        n, total = np.zeros(model.files, np.int64), np.zeros(model.files, np.int64)
        low, high = np.zeros(model.files, np.int64), np.full(model.files, -1, np.int64)
        f = r["file"].to_numpy(np.int64)
        n[f], total[f] = r["n"].to_numpy(np.int64), r["total"].to_numpy(np.int64)
        split, weight = np.empty(0, np.int64), np.empty(0)
        if order > 1 and len(f):
            low[f], high[f] = r["low"].to_numpy(np.int64), r["high"].to_numpy(np.int64)
            two = (r["high"] != r["low"]).to_numpy(bool)
            split, back = np.unique(np.concatenate([low[f], high[f][two]]), return_inverse=True)
            sums = np.bincount(back, np.concatenate([r["low_sum"].to_numpy(float), r["high_sum"].to_numpy(float)[two]]))
            weight = 1 - sums / np.maximum(counts_of(model, order - 1, split)[0], 1)
        arrays = {"first": np.append(0, np.cumsum(n)), "total": np.append(0, np.cumsum(total)), "low": low, "high": high, "split": split, "split_weight": weight}
        write_arrays(f"{model.path}/index{order}.ef", arrays)
        yield pd.DataFrame({"file": [order]})

    one = stats.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in stats.schema.fields]).where("file IS NOT NULL")
    stats.union(one).coalesce(1).mapInPandas(run, "file long").count()


def built(stats: DataFrame, model: Model) -> None:
    """Adds a level to the model: its index, and its files, which are written by tasks."""
    spark, order = stats.sparkSession, model.orders + 1
    write_index(stats, model)
    if order == 1:
        model.orders = 1
        return

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, level = model, index(model.path, order)
        for b in batches:
            for f in b["file"].tolist():
                raw = read_arrays(f"{m.path}/raw{order}/{f:06d}.ef")
                p, w, c, s = (unpack(raw[k].tobytes()).astype(np.int64) for k in "pwcs")
                first = int(p[0])
                parents = np.arange(first, int(p[-1]) + 1)
                pointers = np.searchsorted(p, np.append(parents, parents[-1] + 1))
                count = spread(p, lambda x: counts_of(m, order - 1, x))[0]
                of = p - first
                weight = 1 - np.bincount(of, c - DISCOUNT, minlength=len(parents)) / np.maximum(np.bincount(of, count, minlength=len(parents)) / np.maximum(np.diff(pointers), 1), 1)
                i = np.minimum(np.searchsorted(level.split, parents), len(level.split) - 1)
                weight = np.clip(np.where(level.split[i] == parents, level.split_weight[i], weight), 1e-6, 1)
                shorter = m.p1(counts_of(m, 1, w)[0]) if order == 2 else np.exp(-s / LOG_STEPS)
                prob = (c - DISCOUNT) / count + weight[of] * shorter
                last = np.full(len(parents), -1)  # the highest word of each context
                some = np.diff(pointers) > 0
                last[some] = w[pointers[1:][some] - 1]
                base = np.concatenate([[0], np.cumsum(last + 1)[:-1]])
                log_book, code = book_of(np.log(prob))
                weight_book, weight_code = book_of(np.log(weight))
                arrays = {"book": np.exp(log_book), "code": code, "weight_book": np.exp(weight_book), "weight": weight_code}
                for name, v in (("pointers", pointers), ("ids", base[of] + w), ("cum", np.append(0, np.cumsum(c)))):
                    arrays |= {f"{name}.{k}": x for k, x in EliasFano.of(v).arrays().items()}
                write_arrays(m.file(order, f), arrays)
                yield pd.DataFrame({"file": [f]})

    stats.select("file").repartition(min(model.files, WRITERS), "file").mapInPandas(run, "file long").count()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{model.path}/raw{order}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    model.orders = order


def train_model(train: DataFrame, orders: int = 3, path: str | None = None) -> Model:
    """A model of the column text."""
    spark = train.sparkSession
    size = train.agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes")).first()
    files = 1 << max(FEWEST_FILES - 1, int((size["bytes"] or 0) // FILE_BYTES)).bit_length()
    model = Model(path or scratch_path(spark, "ngram"), files, int(size["docs"]))
    for _ in range(orders):
        built(merged(counted(train, model), model), model)
    return model


def score_texts(m: Model, texts: list[str]) -> pd.DataFrame:
    """n_tokens, n_known, base_score and score of each text."""
    t = read_texts(texts)
    g = level_one(m, t)
    at = g.at
    if not m.tokens:
        zero = np.zeros(len(texts))
        return pd.DataFrame({"n_tokens": np.diff(t.ends, prepend=0) - 1, "n_known": zero.astype(np.int64), "base_score": zero, "score": zero})
    base = m.p1(np.where(g.ids >= 0, g.count, 0))
    p = base.copy()
    if len(m.levels) > 1:
        # contexts by distinct word
        known = g.ids[at - 1] >= 0
        one, back = np.unique(g.ids[at - 1][known], return_inverse=True)
        where = np.zeros(len(one), np.int64)
        where[back] = at[known] - 1
        w2 = np.ones(len(at))
        w2[known] = weights(m, 2, one, g.count[where], g.before[where])[back]
        place, q = find_grams(m, 2, g.a, g.b, g.a_count, g.a_before)
        pair = g.pair_of[at]
        of = np.where(pair >= 0, np.append(place, -1)[pair], -1)
        p[at] = np.where(of >= 0, np.append(q, 0)[pair], w2 * base[at])
        if len(m.levels) > 2:
            all_ = np.full(len(g.ids), -1, np.int64)
            all_[at] = of
            before = all_[at - 1]
            have = np.flatnonzero(before >= 0)
            ctx, w, back = distinct(before[have], np.where(g.ids[at[have]] >= 0, g.ids[at[have]], m.start), m.vocabulary + 1)
            count, cum = counts_of(m, 2, ctx)
            place3, q3 = find_grams(m, 3, ctx, w, count, cum)
            one, ctx_of = np.unique(ctx, return_inverse=True)
            where = np.zeros(len(one), np.int64)
            where[ctx_of] = np.arange(len(ctx))
            w3 = weights(m, 3, one, count[where], cum[where])[ctx_of]
            p[at[have]] = np.where(place3 >= 0, q3, 0)[back] + np.where(place3 >= 0, 0, w3)[back] * p[at[have]]
    n = np.diff(t.ends, prepend=0) - 1
    edges = np.concatenate([[0], np.cumsum(n)[:-1]])
    total = lambda x: np.add.reduceat(x, edges)  # noqa: E731  each text has a token
    return pd.DataFrame({"n_tokens": n, "n_known": total(((g.ids >= 0) & (g.count > 0))[at].astype(np.int64)), "base_score": total(np.log10(base[at])), "score": total(np.log10(p[at]))})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the scores and train_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b, "_text")
            for i, j in chunks(texts, TEXT_CHARS):
                out = score_texts(model, texts[i:j]).assign(train_tokens=model.tokens)
                yield beside(b.column("_id").slice(i, j - i), {c: out[c].to_numpy() for c in out}, id_col)

    own = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return arrow_batched(own, run, f"`{id_col}` {own.schema['_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double, train_tokens long", ROWS_AT_ONCE)


def held_out(id_col: str = "doc_id"):  # noqa: ANN201
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 5 == 1


def op1_elias_fano_ngram_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_model(docs.where(~held_out()).select("text"))
    out = score(docs, model).withColumn("held_out", held_out())
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
