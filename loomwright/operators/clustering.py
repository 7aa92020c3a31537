"""Clustering of products and the consensus of several clusterings."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators import sweeps
from loomwright.operators.graph import connected
from loomwright.operators.joins import co_labelled, co_members
from loomwright.operators.ranking import min_max, with_totals
from loomwright.storage import stored
#: Components of a factor analysis that are looked at.
MOST_COMPONENTS = 19
#: Modes whose distances are looked at together; then the least one so far is stored with the rows.
MODES_A_TABLE = 8


def prepared(df: DataFrame, id_col: str, categories: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Sorted categories with NOT_APPLIED for null, then sorted numbers with the mean for null, scaled to 0..1."""
    categories, numbers = sorted(categories), sorted(numbers)
    df = df.select(id_col, *[F.coalesce(F.col(c), F.lit("NOT_APPLIED")).alias(c) for c in categories], *numbers)
    df = with_totals(df, **{f"_m{c}": F.avg(c) for c in numbers}).select(id_col, *categories, *[F.coalesce(F.col(c), F.col(f"_m{c}")).alias(c) for c in numbers])
    return min_max(df, {c: c for c in numbers}, 0.0, 1.0) if numbers else df


def famd(df: DataFrame, id_col: str, categories: Sequence[str], numbers: Sequence[str], k: int | None = None) -> DataFrame:
    """Coordinates on the first k axes of a factor analysis of mixed data; without k on as many as axes_to_keep() says.

    Numbers are standardised; a category's indicator is divided by the root of its share and centred. Categories are
    those of dimensions, so their levels are a short list.
    """
    df = stored(prepared(df, id_col, categories, numbers), "prepared")
    n = df.count()
    stats = df.agg(*[f(c).alias(f"{p}{c}") for c in numbers for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if numbers else {}
    parts = [(F.col(c) - F.lit(float(stats[f"m{c}"]))) / F.lit(float(stats[f"s{c}"]) or 1.0) for c in sorted(numbers)]
    if categories:
        level = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in sorted(categories)])).alias("x")
        for r in df.select(level).groupBy("x.c", "x.v").count().orderBy("c", "v").collect():  # levels of dimensions
            p = r["count"] / n
            parts.append(((F.col(r["c"]).cast("string") == r["v"]).cast("double") - F.lit(p)) / F.lit(math.sqrt(p)))
    x = df.select(id_col, array_to_vector(F.array(*parts)).alias("x"))
    model = PCA(k=min(k or MOST_COMPONENTS, len(parts)), inputCol="x", outputCol="y").fit(x)
    # the sign of an axis is free: its largest loading is made positive
    load = model.pc.toArray()
    sign = [float(np.sign(load[np.abs(load[:, j]).argmax(), j]) or 1.0) for j in range(load.shape[1])]
    kept = sign[: k or axes_to_keep(model.explainedVariance.toArray())]
    y = vector_to_array("y")
    return model.transform(x).select(id_col, F.array(*[y[j] * s for j, s in enumerate(kept)]).alias("coordinates"))


def axes_to_keep(explained: Sequence[float]) -> int:
    """How many axes to keep. explained: the shares of all axes that were asked for, the largest first.

    Of the first n axes (2 at least) those at or above the 70th percentile (nearest) would stay; n is where these hold most
    of what the n explain (ties: the largest n).
    """
    e = np.asarray(explained, float)
    best = (-1.0, 0, min(len(e), 1))
    for n in range(2, len(e) + 1):
        stay = e[:n] >= np.quantile(e[:n], 0.7, method="nearest")
        best = max(best, (float(e[:n][stay].sum() / max(e[:n].sum(), 1e-300)), n, int(stay.sum())))
    return best[2]


def _norm(v: np.ndarray) -> np.ndarray:
    span = v.max() - v.min()
    return (v - v.min()) / span if span else np.zeros(len(v))


def _scores(found: Sequence[tuple[float, float, float]]) -> np.ndarray:
    """The sum of the scaled indices of each clustering."""
    s, d, c = (np.array(v) for v in zip(*found, strict=True))
    worst = d[np.isfinite(d)].max() if np.isfinite(d).any() else 0.0
    return _norm(s) + 1 - _norm(np.where(np.isfinite(d), d, worst)) + _norm(c)


def _scored(df: DataFrame, id_col: str, x: str, kind: str, ks: Sequence[int]) -> tuple[DataFrame, object, list[tuple[int, float, float, float, float]]]:
    """The rows as a table, the model, and k with its indices and score for each clustering."""
    ks = list(ks)
    rows = stored(df.select(id_col, x), "vectors")
    at = sweeps.places(rows, x)
    model = sweeps.fitted(rows, id_col, x, kind, ks, at=at)
    found = sweeps.indices(at, x, model.labels, ks)
    return rows, model, [(k, *map(float, r), float(t)) for k, r, t in zip(ks, found, _scores(found), strict=True)]


def scores_of_k(df: DataFrame, id_col: str, x: str, kind: str, ks: Iterable[int]) -> DataFrame:
    """k, its indices and their sum: scaled silhouette, 1 less Davies-Bouldin, Calinski-Harabasz."""
    return df.sparkSession.createDataFrame(_scored(df, id_col, x, kind, ks)[2], "k int, silhouette double, davies_bouldin double, calinski_harabasz double, score double")


def select_and_label(df: DataFrame, id_col: str, x: str, kind: str, ks: Iterable[int]) -> DataFrame:
    """id and label by the k of the best score; all k share each pass over the rows."""
    rows, model, found = _scored(df, id_col, x, kind, ks)
    return sweeps.labelled(rows, id_col, x, model, int(np.argmax([r[-1] for r in found])))


def birch_session(df: DataFrame, id_col: str, x: str, ks: Iterable[int], known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """id and label of new rows by all rows so far, and the clustering features to keep for the next call.

    known: the features of earlier calls; their rows are not read again. The number of clusters is the one of the best
    score over the new rows.
    """
    ks = list(ks)
    rows = stored(df.select(id_col, x), "vectors")
    features = sweeps.Birch.features(rows, x, known)
    model = sweeps.Birch.of_features(features, ks)
    return sweeps.labelled(rows, id_col, x, model, int(np.argmax(_scores(sweeps.indices(rows, x, model.labels, ks))))), features


def fuzzy_c_means(df: DataFrame, id_col: str, x: str, ks: int | Sequence[int], m: float = 2.0, error: float = 0.005, iterations: int = 1000, seed: int = 42) -> DataFrame:
    """id, label (largest membership) and membership, by the k of the least scaled partition entropy."""
    ks = [ks] if isinstance(ks, int) else list(ks)
    rows = stored(df.select(id_col, x), "vectors")
    at = sweeps.places(rows, x)
    model = sweeps.FuzzyMeans.fit(rows, id_col, x, ks, seed, m, error, iterations, at)
    best = int(np.argmin(model.partition_entropy(at, x))) if len(ks) > 1 else 0

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                u = model.memberships(np.stack(b[x].to_numpy()), best)
                yield pd.DataFrame({id_col: b[id_col], "label": u.argmax(1).astype(np.int32), "membership": u.max(1).round(6)})

    return rows.mapInPandas(label, f"{id_col} {df.schema[id_col].dataType.simpleString()}, label int, membership double")


def combinations(filled: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The combinations of values that occur, with _c, their number of rows."""
    return stored(filled.groupBy(*columns).agg(F.count("*").alias("_c")), "combinations")


def first_modes(filled: DataFrame, columns: Sequence[str], most: int) -> list[tuple[str, ...]]:
    """Cao's first modes: the densest row, then rows that are dense and far from the modes so far; the first k serve for k.

    A row's density is the mean share of its values. Rows are looked at once for each combination of values that occurs.
    """
    return _first_modes(combinations(filled, columns), columns, most)


def _differing(columns: Sequence[str], mode: Sequence[str]) -> Column:
    """In how many columns a row differs from a mode."""
    return reduce(lambda a, b: a + b, [(F.col(c) != F.lit(v)).cast("int") for c, v in zip(columns, mode, strict=True)])


def _first_modes(kinds: DataFrame, columns: Sequence[str], most: int) -> list[tuple[str, ...]]:
    n, rows = kinds.agg(F.sum("_c")).first()[0] or 0, kinds
    for c in columns:
        rows = rows.join(kinds.groupBy(c).agg((F.sum("_c") / F.lit(n * len(columns))).alias(f"_d{c}")), c)
    rows = stored(rows.select(*columns, reduce(lambda a, b: a + b, [F.col(f"_d{c}") for c in columns]).alias("_d")), "densities")
    modes = [tuple(r[c] for c in columns) for r in rows.orderBy(F.desc("_d"), *columns).limit(1).collect()]
    far = F.lit(len(columns))  # the least number of columns in which a row differs from a mode
    while modes and len(modes) < most:
        far = F.least(far, _differing(columns, modes[-1]))
        if len(modes) % MODES_A_TABLE == 0:
            rows = stored(rows.select(*columns, "_d", far.alias("_far")), "densities")
            far = F.col("_far")
        r = rows.select(*columns, (far * F.col("_d")).alias("_f")).where("_f > 0").orderBy(F.desc("_f"), *columns).limit(1).collect()
        if not r:
            break
        modes.append(tuple(r[0][c] for c in columns))
    return modes


def _modes_pass(kinds: DataFrame, columns: Sequence[str], modes: list[list[tuple[str, ...]]]) -> tuple[list[float], dict[tuple[int, int], str]]:
    """The cost of each clustering, and the most frequent value of each column of each cluster (key, column); kinds are combinations()."""
    offsets = np.concatenate([[0], np.cumsum([len(m) for m in modes])]).astype(int)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            values, times, parts = b[list(columns)].to_numpy(str), b["_c"].to_numpy(np.int64), []
            for i, m in enumerate(modes):
                off = (values[:, None, :] != np.array(m, str)[None]).sum(2)
                at = off.argmin(1)
                parts.append(pd.DataFrame({"key": -1 - i, "column": -1, "value": "", "n": [int((off.min(1) * times).sum())]}))
                for j in range(len(columns)):
                    got = pd.Series(times).groupby([at + offsets[i], values[:, j]]).sum()
                    parts.append(pd.DataFrame({"key": got.index.get_level_values(0), "column": j, "value": got.index.get_level_values(1), "n": got.to_numpy()}))
            yield pd.concat(parts)[["key", "column", "value", "n"]]

    counts = kinds.select(*columns, "_c").mapInPandas(run, "key int, `column` int, value string, n long").groupBy("key", "column", "value").agg(F.sum("n").alias("n"))
    best = counts.groupBy("key", "column").agg(F.max_by(F.struct("value", "n"), F.struct("n", "value")).alias("b")).collect()  # a row for each cluster and column
    cost = [0.0] * len(modes)
    new = {}
    for r in best:
        if r["key"] < 0:
            cost[-1 - r["key"]] = float(r["b"]["n"])
        else:
            new[r["key"], r["column"]] = r["b"]["value"]
    return cost, new


def kmodes(df: DataFrame, id_col: str, columns: Sequence[str], ks: int | Sequence[int], rounds: int = 100, least: float = 10) -> DataFrame:
    """id, label and mismatches by k modes from Cao's first ones. Null is the value -1 while modes are made.

    Of several k the costs are looked at in turn until one changes by less than `least` (from the third on); of those looked
    at the one with the least cost counts. All k share each pass, which is over the combinations of values that occur and
    not over rows; modes are sum(ks) rows on the driver.
    """
    ks = [ks] if isinstance(ks, int) else list(ks)
    rows = stored(df.select(id_col, *[F.coalesce(F.col(c).cast("string"), F.lit("-1")).alias(c) for c in columns]), "rows")
    kinds = combinations(rows, columns)
    first = _first_modes(kinds, columns, max(ks))
    modes, cost = [first[:k] for k in ks], [math.inf] * len(ks)
    if not first:
        return rows.select(id_col, F.lit(0).alias("label"), F.lit(0).alias("mismatches")).limit(0)
    live = list(range(len(ks)))
    for _ in range(rounds):
        part = [modes[i] for i in live]
        now, new = _modes_pass(kinds, columns, part)
        at, left = 0, []
        for i, c in zip(live, now, strict=True):
            if c < cost[i]:
                left.append(i)
                cost[i], kept = c, modes[i]
                modes[i] = [tuple(new.get((at + j, p), v) for p, v in enumerate(m)) for j, m in enumerate(kept)]
            at += len(part[live.index(i)])
        live = left
        if not live:
            break
    seen = next((i + 1 for i in range(2, len(ks)) if abs(cost[i] - cost[i - 1]) < least), len(ks))
    chosen = modes[int(np.argmin(cost[:seen]))]
    best = F.array_min(F.array(*[F.struct(_differing(columns, m).alias("mismatches"), F.lit(j).alias("label")) for j, m in enumerate(chosen)]))
    return rows.join(kinds.select(*columns, best.alias("b")), list(columns)).select(id_col, "b.label", "b.mismatches")


def consensus(df: DataFrame, item: str, algorithm: str, label: str) -> DataFrame:
    """For pairs i < j that some algorithm puts together: the share of algorithms that do."""
    n = df.select(algorithm).distinct().count()
    return co_members(df, item, algorithm, label, n)


def rbf_distance(share: DataFrame, delta: float = 0.2) -> DataFrame:
    """exp(- share ** 2 / (2 delta ** 2)): small where the share is large. Pairs that are not listed have distance 1."""
    return share.withColumn("distance", F.exp(-F.col("share") * F.col("share") / (2 * delta * delta)))


def consensus_classes(df: DataFrame, item: str, algorithm: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Membership (item, class) and pairs of classes i < j that some algorithm puts together (share, n_i, n_j).

    Items with the same labels of all algorithms are one class, named by its smallest item; items of a class share all.
    So a label that all items have makes a row for each pair of combinations of labels, not of items.
    """
    tuples = df.where(F.col(label).isNotNull()).groupBy(item).agg(F.sort_array(F.collect_set(F.struct(F.col(algorithm).alias("a"), F.col(label).alias("l")))).alias("t"))  # a row for each algorithm
    named = stored(tuples.groupBy("t").agg(F.min(item).alias("class"), F.count("*").alias("n")), "classes")
    members = stored(tuples, "tuples").join(named.select("t", "class"), "t").select(item, "class")
    each = named.select("class", F.explode("t").alias("x")).select("class", F.col("x.a").alias("a"), F.col("x.l").alias("l"))
    n = df.select(algorithm).distinct().count()
    sizes = named.select(F.col("class").alias("i"), F.col("n").alias("n_i"))
    pairs = co_labelled(stored(each, "labels"), "class", "a", "l", n).join(sizes, "i").join(sizes.toDF("j", "n_j"), "j")
    return members, pairs.select("i", "j", "share", "n_i", "n_j")


def complete_linkage(near: DataFrame, items: DataFrame, item: str, threshold: float) -> DataFrame:
    """item and label (the smallest item of its cluster) by agglomeration with complete linkage below a threshold.

    near: i, j and distance; pairs that are not listed are too far. Of the pairs of clusters only those are kept whose
    items are all near each other, as no others can ever join. In each round all pairs of clusters that are each
    other's nearest join at once: with complete linkage no such pair can be parted by another, so the result is that of
    joining one pair after the other. Equal distances go by a hash of the two clusters' smallest items, so that many
    pairs find each other in a round. Nothing is gathered in a task or on the driver.
    """
    links = near.where(F.col("distance") < threshold).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.col("distance").alias("d")).where("a < b")
    links = stored(links.groupBy("a", "b").agg(F.max("d").alias("d")), "links")
    joined = [links.select("a", "b").limit(0)]
    while not links.isEmpty():
        order = F.struct("d", F.xxhash64("a", "b").alias("h"), "a", "b")
        ends = links.select(F.explode(F.array("a", "b")).alias("x"), order.alias("e"))
        best = ends.groupBy("x").agg(F.min("e").alias("e"))
        chosen = stored(best.groupBy("e").agg(F.count("*").alias("c")).where("c = 2").select("e.a", "e.b"), "chosen")
        joined.append(chosen)
        two = F.lit(2).alias("m")
        moved = stored(chosen.select(F.col("a").alias("x"), F.col("a").alias("y"), two).union(chosen.select(F.col("b").alias("x"), F.col("a").alias("y"), two)), "moved")
        on = links.join(moved.toDF("a", "a2", "m"), "a", "left").join(moved.toDF("b", "b2", "k"), "b", "left")
        new = on.select(F.coalesce("a2", "a").alias("p"), F.coalesce("b2", "b").alias("q"), "d", (F.coalesce("m", F.lit(1)) * F.coalesce("k", F.lit(1))).alias("need")).where("p <> q")
        both = new.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.max("d").alias("d"), F.count("*").alias("c"), F.max("need").alias("need"))
        links = stored(both.where("c = need").select("a", "b", "d"), "links")
    found = connected(stored(reduce(DataFrame.union, joined), "joined"), "a", "b")
    return items.join(found.select(F.col("node").alias(item), F.col("component").alias("label")), item, "left").select(item, F.coalesce("label", F.col(item)).cast("long").alias("label"))


def linked_items(labels: DataFrame, item: str, algorithm: str, label: str, delta: float, threshold: float) -> DataFrame:
    """item and label by complete linkage of the consensus of several clusterings, class by class.

    Items of a class are nearest to each other, so they join first and the rest is between classes.
    """
    members, pairs = consensus_classes(labels, item, algorithm, label)
    if math.exp(-1 / (2 * delta * delta)) >= threshold:
        return members.select(item, F.col(item).cast("long").alias("label"))
    found = complete_linkage(rbf_distance(pairs, delta), members.select("class").distinct(), "class", threshold)
    return members.join(found, "class").select(item, "label")
