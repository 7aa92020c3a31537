"""Clusterings for many numbers of clusters at once: each pass over the rows serves all of them.

Rows are vectors of some columns (array<double>); what a model keeps (centres, clustering features, mixture components) is
bounded by the numbers of clusters that are asked for and travels with the tasks. Sums are made by partition and added up
by key, so the driver sees a row for each cluster. Passes go over the distinct vectors, each with the number of its rows,
dealt out over all cores; what a pass makes has a row for each cluster of all clusterings and a column for each vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.storage import stored

#: Rows from which first centres are drawn; clustering features that are kept; rows that are worked on at once.
SAMPLE, FEATURES, AT_ONCE = 4096, 500, 2048
#: Vectors of a pass that are worked on at once (with all clusters they stay in a core's memory); the column of numbers of rows.
BLOCK, TIMES = 256, "_times"


def _vectors(b: pd.DataFrame, x: str) -> Iterator[np.ndarray]:
    for i in range(0, len(b), AT_ONCE):
        yield np.stack(b[x].iloc[i : i + AT_ONCE].to_numpy()).astype(float)


def places(df: DataFrame, x: str) -> DataFrame:
    """The distinct vectors with the number of their rows, dealt out over all cores however few files the rows came in."""
    return stored(df.groupBy(x).agg(F.count("*").alias(TIMES)).repartition(max(df.sparkSession.sparkContext.defaultParallelism, 2), x), "places")


def sums(df: DataFrame, x: str, of: Callable[..., np.ndarray], size: int, width: int) -> np.ndarray:
    """The sum over all rows of `of`, which gives an array of the given size and width for some vectors (of places(): and their numbers of rows)."""
    times = [TIMES] if TIMES in df.columns else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, width))
        for b in batches:
            for i in range(0, len(b), BLOCK):
                part = b.iloc[i : i + BLOCK]
                total += of(np.stack(part[x].to_numpy()).astype(float), *(part[t].to_numpy(float) for t in times))
        some = np.flatnonzero(total.any(axis=1))
        if len(some):  # a part without rows has no column of arrays
            yield pd.DataFrame({"key": some, "v": list(total[some])})

    parts = df.select(x, *times).mapInPandas(run, "key int, v array<double>").withColumn("v", array_to_vector("v"))
    out = np.zeros((size, width))
    for r in parts.groupBy("key").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("v")).collect():
        out[r["key"]] = r["v"]
    return out


def _nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * v @ centres.T).argmin(1)


def _by_label(labels: np.ndarray, offsets: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the values (a row each) by cluster of each clustering (a column of labels)."""
    out = np.zeros((size, values.shape[1]))
    keys = (labels + offsets).ravel()
    for j in range(values.shape[1]):
        out[:, j] = np.bincount(keys, np.repeat(values[:, j], labels.shape[1]), size)
    return out


def _starts(sizes: Sequence[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(int)


def _with_ones(v: np.ndarray, times: np.ndarray | float, *more: np.ndarray) -> np.ndarray:
    """Columns of ones, the vectors and more, as often as their rows."""
    return np.column_stack([np.ones(len(v)), v, *more]) * np.reshape(times, (-1, 1))


@dataclass
class KMeans:
    """Lloyd's algorithm from one sequence of first centres, drawn far from each other."""

    centres: list[np.ndarray]

    def labels(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([_nearest(v, c) for c in self.centres])

    @classmethod
    def fit(cls, df: DataFrame, id_col: str, x: str, ks: Sequence[int], seed: int, rounds: int = 50, tol: float = 1e-4, at: DataFrame | None = None) -> KMeans:
        at = places(df, x) if at is None else at
        first = df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(SAMPLE).select(x).collect()  # SAMPLE rows
        some, rnd = np.unique(np.array([r[0] for r in first], float).reshape(len(first), -1), axis=0), np.random.default_rng(seed)
        chosen = [int(rnd.integers(len(some)))]
        far = np.full(len(some), np.inf)
        while len(chosen) < min(max(ks), len(some)):
            far = np.minimum(far, ((some - some[chosen[-1]]) ** 2).sum(1))
            tries = rnd.choice(len(some), 2 + int(np.log(max(ks))), p=far / far.sum())
            chosen.append(int(min(tries, key=lambda t: np.minimum(far, ((some - some[t]) ** 2).sum(1)).sum())))
        model = cls([some[chosen[:k]] for k in ks])
        live = list(range(len(ks)))
        for _ in range(rounds):
            part = cls([model.centres[i] for i in live])
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in part.centres])])

            def of(v: np.ndarray, times: np.ndarray, part: KMeans = part, offsets: np.ndarray = offsets) -> np.ndarray:
                return _by_label(part.labels(v), offsets[:-1], _with_ones(v, times), int(offsets[-1]))

            got = sums(at, x, of, int(offsets[-1]), 1 + some.shape[1])
            moved = []
            for i, a, b in zip(live, offsets[:-1], offsets[1:], strict=True):
                n = got[a:b, :1]
                new = np.where(n > 0, got[a:b, 1:] / np.maximum(n, 1), model.centres[i])
                if ((new - model.centres[i]) ** 2).sum(1).max() > tol * tol:
                    moved.append(i)
                model.centres[i] = new
            live = moved
            if not live:
                break
        return model


def _absorb(n: np.ndarray, ls: np.ndarray, ss: np.ndarray, most: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Clustering features (count, sum, sum of squares) joined one after the other while the radius stays below the threshold.

    If more than `most` are left, the threshold grows and they are joined anew.
    """
    while True:
        c_n, c_ls, c_ss = np.zeros(most + 1), np.zeros((most + 1, ls.shape[1])), np.zeros(most + 1)
        m = 0
        for i in range(len(n)):
            if m:
                mean = c_ls[:m] / c_n[:m, None]
                j = int(((mean - ls[i] / n[i]) ** 2).sum(1).argmin())
                t_n, t_ls, t_ss = c_n[j] + n[i], c_ls[j] + ls[i], c_ss[j] + ss[i]
                if t_ss / t_n - (t_ls * t_ls).sum() / t_n**2 <= threshold**2:
                    c_n[j], c_ls[j], c_ss[j] = t_n, t_ls, t_ss
                    continue
            if m > most:
                break
            c_n[m], c_ls[m], c_ss[m] = n[i], ls[i], ss[i]
            m += 1
        else:
            if m <= most:
                return c_n[:m], c_ls[:m], c_ss[:m], threshold
        threshold *= 1.5


def _ward(points: np.ndarray) -> list[tuple[int, int]]:
    """The merges of an agglomeration by Ward's criterion, the cheapest first."""
    m = len(points)
    size, d = np.ones(m), ((points[:, None] - points[None]) ** 2).sum(2) / 2
    np.fill_diagonal(d, np.inf)
    out = []
    for _ in range(m - 1):
        a, b = sorted(np.unravel_index(d.argmin(), d.shape))
        out.append((int(a), int(b)))
        t = size[a] + size[b] + size
        new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / t
        d[a] = d[:, a] = new
        d[b] = d[:, b] = np.inf
        d[a, a] = np.inf
        size[a] += size[b]
    return out


@dataclass
class Birch:
    """Rows are gathered into clustering features, partition by partition and then over a tree; Ward's criterion joins those."""

    centroids: np.ndarray
    of: np.ndarray  #: label of each centroid, a column for each number of clusters

    def labels(self, v: np.ndarray) -> np.ndarray:
        return self.of[_nearest(v, self.centroids)]

    @staticmethod
    def features(df: DataFrame, x: str, known: DataFrame | None = None, threshold: float = 0.5, most: int = FEATURES, fan_in: int = 32) -> DataFrame:
        """n, ls, ss and threshold: at most `most` clustering features of the rows, merged with those known (the same table of earlier rows).

        The table is all that the model keeps of its rows: store it, and rows that come later are merged into it.
        """
        names = ["part", "n", "ls", "ss", "threshold"]

        def frame(part: int, got: tuple) -> pd.DataFrame:
            return pd.DataFrame({"part": part, "n": got[0], "ls": list(got[1]), "ss": got[2], "threshold": got[3]})[names]

        def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, part = None, 0
            for b in batches:
                part = int(b["part"].iloc[0]) if len(b) else part
                for v in _vectors(b, x):
                    new = (np.ones(len(v)), v, (v * v).sum(1))
                    both = new if held is None else tuple(np.concatenate([p, q]) for p, q in zip(held[:3], new, strict=True))
                    held = _absorb(*both, most, threshold if held is None else held[3])
            if held is not None:
                yield frame(part, held)

        def joined(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part", kind="stable")
            return frame(int(pdf["part"].iloc[0]), _absorb(pdf["n"].to_numpy(float), np.stack(pdf["ls"].to_numpy()), pdf["ss"].to_numpy(float), most, float(pdf["threshold"].max())))

        schema = "part int, n double, ls array<double>, ss double, threshold double"
        found = df.select(x, (F.spark_partition_id() + 1).alias("part")).mapInPandas(gathered, schema)
        if known is not None:  # they come before all new ones
            found = known.select(F.lit(0).alias("part"), "n", "ls", "ss", "threshold").union(found)
        found = stored(found, "features")
        parts = int(found.agg(F.max("part").alias("m")).first()["m"] or 0) + 1
        while True:
            found = stored(found.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).groupBy("part").applyInPandas(joined, schema), "features")
            parts = -(-parts // fan_in)
            if parts <= 1:
                return found.drop("part")

    @classmethod
    def of_features(cls, found: DataFrame, ks: Sequence[int]) -> Birch:
        """The model of a table of features."""
        rows = sorted(found.collect(), key=lambda r: list(np.array(r["ls"]) / r["n"]))  # `most` rows
        centroids = np.array([np.array(r["ls"]) / r["n"] for r in rows])
        parent, of, left, merges = list(range(len(rows))), {}, len(rows), iter(_ward(centroids))
        for k in sorted(set(ks), reverse=True):
            while left > k:
                a, b = next(merges)
                parent = [a if p == b else p for p in parent]
                left -= 1
            first = {p: i for i, p in enumerate(dict.fromkeys(parent))}
            of[k] = [first[p] for p in parent]
        return cls(centroids, np.column_stack([of[k] for k in ks]))

    @classmethod
    def fit(cls, df: DataFrame, id_col: str, x: str, ks: Sequence[int], seed: int) -> Birch:
        return cls.of_features(cls.features(df, x), ks)


def _digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(8):  # up to where the series holds
        low = x < 8
        out = np.where(low, out - 1 / x, out)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


@dataclass
class Mixture:
    """A variational mixture of normal distributions with full covariances and a Dirichlet process over their weights.

    It starts from the k-means clusters. For each number of components: means, Cholesky factors of the precisions, and
    the expected log weight and log determinant of each component.
    """

    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[np.ndarray]

    def scores(self, v: np.ndarray) -> np.ndarray:
        """A row for each component of all clusterings, a column for each vector."""
        means, factors, far = np.concatenate(self.means), np.concatenate(self.factors), 0.0
        across = np.ascontiguousarray(v.T)
        for e in range(v.shape[1]):
            y = factors[:, :, e] @ across - (means * factors[:, :, e]).sum(1)[:, None]
            far = far + y * y
        return np.concatenate(self.constants)[:, None] - 0.5 * far

    def labels(self, v: np.ndarray) -> np.ndarray:
        s, at = self.scores(v), _starts([len(m) for m in self.means])
        return np.column_stack([s[a:b].argmax(0) for a, b in zip(at[:-1], at[1:], strict=True)])

    @staticmethod
    def _stacked(r: np.ndarray, v: np.ndarray, times: np.ndarray | float) -> np.ndarray:
        """Sums of shares (a row for each component), of vectors and of their products; the last column is free."""
        outer = (v[:, :, None] * v[:, None, :]).reshape(len(v), -1)
        return r @ _with_ones(v, times, outer, np.zeros(len(v)))

    @classmethod
    def fit(cls, df: DataFrame, id_col: str, x: str, ks: Sequence[int], seed: int, rounds: int = 100, tol: float = 1e-3, at: DataFrame | None = None) -> Mixture:
        at = places(df, x) if at is None else at
        start = KMeans.fit(df, id_col, x, ks, seed, at=at)
        d = start.centres[0].shape[1]
        whole = sums(at, x, lambda v, times: Mixture._stacked(np.ones((1, len(v))), v, times), 1, 2 + d + d * d)[0]
        n = whole[0]
        mean0 = whole[1 : 1 + d] / n
        cov0 = (whole[1 + d : -1].reshape(d, d) - n * np.outer(mean0, mean0)) / max(n - 1, 1) + 1e-6 * np.eye(d)

        def updated(got: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            nk = got[:, 0] + 10 * np.finfo(float).eps
            xk = got[:, 1 : 1 + d] / nk[:, None]
            sk = got[:, 1 + d : -1].reshape(-1, d, d) / nk[:, None, None] - xk[:, :, None] * xk[:, None, :] + 1e-6 * np.eye(d)
            precision, dof = 1 + nk, d + nk
            means = (mean0 + nk[:, None] * xk) / precision[:, None]
            diff = xk - mean0
            cov = (cov0 + nk[:, None, None] * sk + (nk / precision)[:, None, None] * diff[:, :, None] * diff[:, None, :]) / dof[:, None, None]
            factors = np.linalg.cholesky(np.linalg.inv(cov))
            a, b = 1 + nk, 1 / len(nk) + np.append(np.cumsum(nk[::-1])[-2::-1], 0.0)
            log_a, log_b, log_both = _digamma(a), _digamma(b), _digamma(a + b)
            weight = log_a - log_both + np.append(0.0, np.cumsum(log_b - log_both)[:-1])
            spread = d * np.log(2.0) + _digamma(0.5 * (dof[:, None] - np.arange(d))).sum(1)
            log_det = np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(1)
            constants = weight + log_det - 0.5 * d * np.log(2 * np.pi) - 0.5 * d * np.log(dof) + 0.5 * (spread - d / precision)
            return means, factors, constants

        size = [len(c) for c in start.centres]
        offsets = _starts(size)

        def first(v: np.ndarray, times: np.ndarray) -> np.ndarray:
            labels = start.labels(v)
            return cls._stacked(np.concatenate([np.eye(k)[:, labels[:, i]] for i, k in enumerate(size)]), v, times)

        got = sums(at, x, first, int(offsets[-1]), 2 + d + d * d)
        made = [updated(got[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        model = cls(*(list(p) for p in zip(*made, strict=True)))
        live, before = list(range(len(ks))), [-np.inf] * len(ks)
        for _ in range(rounds):
            part = cls(*([p[i] for i in live] for p in (model.means, model.factors, model.constants)))
            many = [size[i] for i in live]
            spans = _starts(many)

            def of(v: np.ndarray, times: np.ndarray, part: Mixture = part, many: list[int] = many, first: np.ndarray = spans[:-1]) -> np.ndarray:
                s = part.scores(v)
                top = np.maximum.reduceat(s, first, axis=0)
                s = np.exp(s - np.repeat(top, many, axis=0))
                total = np.add.reduceat(s, first, axis=0)
                out = cls._stacked(s / np.repeat(total, many, axis=0), v, times)
                out[first, -1] = (top + np.log(total)) @ times
                return out

            got = sums(at, x, of, int(spans[-1]), 2 + d + d * d)
            left = []
            for i, a, b in zip(live, spans[:-1], spans[1:], strict=True):
                model.means[i], model.factors[i], model.constants[i] = updated(got[a:b])
                like = got[a, -1] / n
                if abs(like - before[i]) >= tol:
                    left.append(i)
                before[i] = like
            live = left
            if not live:
                break
        return model


@dataclass
class FuzzyMeans:
    """Centres with a membership of each row in each cluster; m is the weight of memberships."""

    centres: list[np.ndarray]
    m: float

    def every(self, v: np.ndarray) -> np.ndarray:
        """Memberships: a row for each cluster of all clusterings, a column for each vector."""
        centres, sizes, d = np.concatenate(self.centres), [len(c) for c in self.centres], 0.0
        for j, x in enumerate(np.ascontiguousarray(v.T)):
            gap = x - centres[:, j, None]
            d = d + gap * gap
        d = np.maximum(d, 1e-18)
        if self.m != 2:
            d = d ** (1 / (self.m - 1))
        return 1 / (d * np.repeat(np.add.reduceat(1 / d, _starts(sizes)[:-1], axis=0), sizes, axis=0))

    def memberships(self, v: np.ndarray, i: int) -> np.ndarray:
        return FuzzyMeans([self.centres[i]], self.m).every(v).T

    def labels(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([self.memberships(v, i).argmax(1) for i in range(len(self.centres))])

    @classmethod
    def fit(cls, df: DataFrame, id_col: str, x: str, ks: Sequence[int], seed: int, m: float = 2.0, error: float = 0.005, rounds: int = 1000, at: DataFrame | None = None) -> FuzzyMeans:
        at = places(df, x) if at is None else at
        first = df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(max(ks)).select(x).collect()  # the largest k rows
        some = np.array([r[0] for r in first], float)
        model = cls([some[:k] for k in ks], m)
        live = list(range(len(ks)))
        for _ in range(rounds):
            part = cls([model.centres[i] for i in live], m)
            offsets = _starts([len(c) for c in part.centres])

            def of(v: np.ndarray, times: np.ndarray, part: FuzzyMeans = part) -> np.ndarray:
                return part.every(v) ** m @ _with_ones(v, times)

            got = sums(at, x, of, int(offsets[-1]), 1 + some.shape[1])
            left = []
            for i, a, b in zip(live, offsets[:-1], offsets[1:], strict=True):
                new = got[a:b, 1:] / np.maximum(got[a:b, :1], 1e-18)
                if np.abs(new - model.centres[i]).max() >= error:
                    left.append(i)
                model.centres[i] = new
            live = left
            if not live:
                break
        return model

    def partition_entropy(self, df: DataFrame, x: str) -> list[float]:
        """The entropies (base 2) of the clusters' shares over all rows, added up and divided by log2 k."""
        offsets = _starts([len(c) for c in self.centres])

        def of(v: np.ndarray, times: np.ndarray | float = 1.0) -> np.ndarray:
            u = self.every(v)
            return np.stack([u, u * np.log2(np.maximum(u, 1e-300))], 2).transpose(0, 2, 1) @ (np.ones(len(v)) * times)

        got = sums(df, x, of, int(offsets[-1]), 2)
        each = np.log2(np.maximum(got[:, 0], 1e-300)) - got[:, 1] / np.maximum(got[:, 0], 1e-300)
        return [float(each[a:b].sum() / np.log2(max(b - a, 2))) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


KINDS = {"kmeans": KMeans, "birch": Birch, "gaussian": Mixture}


def fitted(df: DataFrame, id_col: str, x: str, kind: str, ks: Sequence[int], seed: int = 42, at: DataFrame | None = None) -> KMeans | Birch | Mixture:
    """A model of the rows. at: their places(), if they are there; Birch takes one row after the other."""
    return Birch.fit(df, id_col, x, list(ks), seed) if kind == "birch" else KINDS[kind].fit(df, id_col, x, list(ks), seed, at=at)


def labelled(df: DataFrame, id_col: str, x: str, model: KMeans | Birch | Mixture, which: int) -> DataFrame:
    """id and label by one of a model's clusterings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({id_col: b[id_col], "label": np.concatenate([model.labels(v)[:, which] for v in _vectors(b, x)]).astype(np.int32)})

    return df.select(id_col, x).mapInPandas(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, label int")


def indices(df: DataFrame, x: str, labels: Callable[[np.ndarray], np.ndarray], sizes: Sequence[int]) -> list[tuple[float, float, float]]:
    """Silhouette (of squared distances), Davies-Bouldin and Calinski-Harabasz of each clustering, in two passes.

    A row's mean squared distance to a cluster comes from the cluster's size, sum and sum of squares.
    """
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    size = int(offsets[-1])
    width = len(df.select(x).first()[0])
    one = sums(df, x, lambda v, times=1.0: _by_label(labels(v), offsets[:-1], _with_ones(v, times, (v * v).sum(1)), size), size, 2 + width)
    n, total, square = one[:, 0], one[:, 1:-1], one[:, -1]
    centre = total / np.maximum(n, 1)[:, None]
    mean_square = square / np.maximum(n, 1)

    def second(v: np.ndarray, times: np.ndarray | float = 1.0) -> np.ndarray:
        got, out = labels(v), np.zeros((size, 2))
        own2 = (v * v).sum(1)
        for c, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            at = got[:, c]
            mean = own2[:, None] + mean_square[a:b] - 2 * v @ centre[a:b].T
            mean[:, n[a:b] == 0] = np.inf
            k = n[a:b][at]
            inner = mean[np.arange(len(v)), at] * k / np.maximum(k - 1, 1)
            mean[np.arange(len(v)), at] = np.inf
            outer = mean.min(1)
            wide = np.maximum(np.maximum(inner, outer), 1e-300)
            s = np.where((k > 1) & np.isfinite(outer), (outer - inner) / wide, 0.0)
            s = np.where(np.isfinite(s), s, 0.0)
            gap = np.sqrt(np.maximum(((v - centre[a:b][at]) ** 2).sum(1), 0))
            for j, value in enumerate((s * times, gap * times)):
                out[a:b, j] = np.bincount(at, value, b - a)
        return out

    two = sums(df, x, second, size, 2)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        some = np.flatnonzero(n[a:b] > 0) + a
        rows, k = float(n[a:b].sum()), len(some)
        if k < 2:
            out.append((-1.0, np.inf, 0.0))
            continue
        spread = two[some, 1] / n[some]
        apart = np.sqrt(((centre[some][:, None] - centre[some][None]) ** 2).sum(2))
        np.fill_diagonal(apart, np.inf)
        db = float(((spread[:, None] + spread[None]) / np.maximum(apart, 1e-12)).max(1).mean())
        whole = total[a:b].sum(0) / rows
        between = float((n[some] * ((centre[some] - whole) ** 2).sum(1)).sum())
        within = float((square[some] - n[some] * (centre[some] ** 2).sum(1)).sum())
        out.append((float(two[a:b, 0].sum() / rows), db, between / max(within, 1e-12) * (rows - k) / (k - 1)))
    return out
