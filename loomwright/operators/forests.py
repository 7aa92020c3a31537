"""Ratings, splits and random forests over item features.

The forests of all users grow together, level by level, as tables. A level is one aggregate by user, tree, node, feature
and bin, whatever a user has rated; windows over the bins of a node find its best split, and a join brings the rows to
its halves. So a user with a third of all ratings is no single task, and no model leaves the tables. Items of equal bins
(a cell) are one row; cells that a user has not rated go along with weight 0, so predictions need no pass of their own.

A row's weight in a tree is drawn by a hash (Poisson, as of draws with replacement), so every run gives the same trees.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.ranking import ordinal
from loomwright.storage import stored

#: The range of forests that are tried: trees and depth. Bins of a feature.
TREES, DEPTHS, BINS = (30, 40), (20, 32), 64
#: Trees whose draws stand side by side in a row.
SIDE = 8
#: Chances that a Poisson draw of mean 1 is at most 0, 1, 2 and so on.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9)]


def hash_bucket(key: str, n: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def split(df: DataFrame, key: str, one_in: int = 10) -> DataFrame:
    """test: whether a row is held out, by a hash of its key, so each run holds out the same rows."""
    return df.withColumn("test", hash_bucket(key, one_in) == 0)


def encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Codes from 0 in sorted order."""
    return df.join(ordinal(df.select(column).distinct(), [F.asc(column)], out, 0), column)


def matrix(df: DataFrame, user: str, item: str, value: str, items: Sequence[object], unrated: float) -> DataFrame:
    return df.groupBy(user).pivot(item, list(items)).agg(F.sum(value)).fillna(unrated)


def cuts(features: DataFrame, bins: int = BINS) -> list[list[float]]:
    """Bounds between the bins of each feature: between all values, or quantiles of what has more values than bins."""
    first = features.select("features").first()
    out = []
    for j in range(len(first[0]) if first else 0):
        v = features.select(F.col("features")[j].alias("v")).where("v IS NOT NULL")
        few = sorted(r["v"] for r in v.distinct().limit(bins + 1).collect())
        if len(few) > bins:
            few = sorted(set(v.agg(F.percentile_approx("v", [k / bins for k in range(bins)], 100_000).alias("q")).first()["q"]))
        out.append([(a + b) / 2 for a, b in itertools.pairwise(few)])
    return out


def binned(features: DataFrame, bounds: Sequence[Sequence[float]]) -> DataFrame:
    """item and cell: for each feature the number of bounds below its value; null is below all."""
    code = lambda j, b: F.size(F.filter(F.array(*[F.lit(float(c)) for c in b]), lambda c: F.coalesce(F.col("features")[j] > c, F.lit(False)))) if b else F.lit(0)
    return features.select("item", F.array(*[code(j, b) for j, b in enumerate(bounds)]).cast("array<int>").alias("cell"))


def uniform(user: str, item: str, tree: str | Column, seed: int) -> Column:
    """A number from 0 to 1 for a row and a tree."""
    return F.shiftrightunsigned(F.xxhash64(user, item, tree, F.lit(seed)), 11) / F.lit(float(2**53))


def poisson(u: Column) -> Column:
    """The Poisson draw that a number from 0 to 1 stands for: how many of the chances are below it."""
    return reduce(lambda out, k: out.when(u <= POISSON[k], float(k)), range(1, len(POISSON)), F.when(u <= POISSON[0], 0.0)).otherwise(float(len(POISSON)))


def drawn(user: str, item: str, tree: str, seed: int) -> Column:
    """How often a tree sees a row."""
    return poisson(uniform(user, item, tree, seed))


def grown(rows: DataFrame, depth: int) -> DataFrame:
    """The rows (user_id, cell, tree, w, wy: weight and weighted rating) with node, the leaf they reach; node 1 has the children 2 and 3.

    Of each node the split into two halves of least squared error; ties go to the first feature and the lowest bin.
    """
    key = ["user_id", "tree", "node"]
    active, leaves = rows.withColumn("node", F.lit(1).cast("long")), []
    for _ in range(depth):
        bins = active.where("w > 0").select(*key, "w", "wy", F.posexplode("cell").alias("f", "bin"))
        sums = bins.groupBy(*key, "f", "bin").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy")).repartition(*key)  # a row for each bin at most: windows and best need no more
        over = Window.partitionBy(*key, "f")
        below = over.orderBy("bin")
        cut = sums.select(*key, "f", "bin", *[F.sum(c).over(o).alias(f"{n}{c}") for n, o in (("l", below), ("a", over)) for c in ("w", "wy")]).where("aw - lw > 0.5")
        gain = F.expr("lwy * lwy / lw + (awy - lwy) * (awy - lwy) / (aw - lw) - awy * awy / aw")
        best = cut.groupBy(*key).agg(F.max(F.struct(F.round(gain, 9).alias("gain"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"))).alias("s")).where("s.gain > 0")
        splits = stored(best.select(*key, (-F.col("s.f")).alias("f"), (-F.col("s.bin")).alias("bin")), "splits")
        right = (F.get("cell", F.col("f")) > F.col("bin")).cast("long")
        step = active.join(splits, key, "left").select("user_id", "cell", "tree", "w", "wy", F.when(F.col("f").isNull(), F.col("node")).otherwise(2 * F.col("node") + right).alias("node"), F.col("f").isNull().alias("done"))
        step = stored(step, "level")
        leaves.append(step.where("done").drop("done"))
        active = step.where("NOT done").drop("done")
        if active.isEmpty():
            break
    return reduce(DataFrame.union, [*leaves, active])


def _level(node: str) -> Column:
    return F.length(F.bin(node)) - 1


def _at_depth() -> Column:
    """The node itself, or its ancestor at depth `depth` if it is deeper."""
    return F.expr("shiftright(node, greatest(0, length(bin(node)) - 1 - depth))")


def summed(rated: DataFrame, everyone: DataFrame, trees: int, seed: int, tuned: int) -> DataFrame:
    """user_id, cell, tree, w and wy of everyone (user_id, cell): how often a tree sees the cell's rows, and their ratings so often.

    Of the trees the first `tuned` don't see held-out ratings. A rating makes a row for SIDE trees, not for each; they are
    dealt out by item before that, as a table of few parts makes many rows. Hashes are columns before draws are made of them,
    and held-out rows are left out, not weighed: longer expressions make code that the virtual machine does not compile.
    """
    side = range(SIDE)
    first = F.explode(F.lit([*range(0, tuned, SIDE), *range(tuned, trees, SIDE)])).alias("first")
    each = rated.select("user_id", "item", "cell", "rating", "test").repartition("item").select("*", first).where(~F.col("test") | (F.col("first") >= tuned))
    each = each.select("user_id", "cell", "first", "rating", *[uniform("user_id", "item", F.col("first") + k, seed).alias(f"w{k}") for k in side])
    seen = each.select("user_id", "cell", "first", "rating", *[poisson(F.col(f"w{k}")).alias(f"w{k}") for k in side])
    none = everyone.select("user_id", "cell", first, F.lit(0.0).alias("rating"), *[F.lit(0.0).alias(f"w{k}") for k in side])  # all that is predicted
    sums = [F.struct((F.col("first") + k).alias("tree"), F.sum(f"w{k}").alias("w"), F.sum(F.col(f"w{k}") * F.col("rating")).alias("wy")) for k in side]
    out = seen.union(none).groupBy("user_id", "cell", "first").agg(F.array(*sums).alias("s")).select("user_id", "cell", "first", F.inline("s"))
    return out.where(F.col("tree") < F.when(F.col("first") < tuned, tuned).otherwise(trees)).drop("first")


def _rows(ratings: DataFrame, features: DataFrame, trees: int, seed: int, tuned: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What trees grow from, the cells of items, and the ratings with their cells."""
    items = stored(binned(features.where("features IS NOT NULL").repartition("item"), cuts(features)), "cells")
    given = stored(split(ratings, "item").join(items, "item", "left").select("user_id", "item", "rating", "test", "cell"), "rated")
    rated = given.where("rating IS NOT NULL AND cell IS NOT NULL")
    everyone = items.select("cell").distinct().crossJoin(F.broadcast(given.select("user_id").distinct()))
    return stored(summed(rated, everyone, trees, seed, tuned), "rows"), items, rated


def _valued(leaves: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """user_id, cell, tree and value: the mean rating of what a tree has seen in the leaf (at `depth` at most)."""
    at = leaves.withColumn("node", _at_depth())
    key = ["user_id", "tree", "node", *extra]
    value = stored(at.groupBy(*key).agg((F.sum("wy") / F.nullif(F.sum("w"), F.lit(0.0))).alias("value")), "values")
    return at.select(*key, "cell").join(value, key)


def _unrated(predicted: DataFrame, items: DataFrame, rated: DataFrame) -> DataFrame:
    """user_id, item and prediction from those of cells; a user whose trees have seen nothing gets the mean rating."""
    mean = rated.groupBy("user_id").agg(F.avg("rating").alias("mean"))
    out = predicted.join(items, "cell").join(rated.select("user_id", "item"), ["user_id", "item"], "left_anti").join(mean, "user_id", "left")
    return out.select("user_id", "item", F.round(F.coalesce("prediction", "mean"), 6).alias("prediction"))


def fixed_forest(ratings: DataFrame, features: DataFrame, trees: int = 80, depth: int = 20, seed: int = 42) -> DataFrame:
    """user_id, item and prediction for all that each user has not rated; features: item, features (array<double>).

    Rows without a rating or features are left out; users who have rated nothing that has features are, too.
    """
    rows, items, rated = _rows(ratings, features, trees, seed, 0)
    leaves = grown(rows, depth).withColumn("depth", F.lit(depth))
    return _unrated(_valued(leaves).groupBy("user_id", "cell").agg(F.avg("value").alias("prediction")), items, rated)


def tries_of(n: int) -> list[tuple[int, int]]:
    """Trees and depth of each forest that is tried; depths are spread evenly by their logarithm."""
    return [(TREES[0] + (7 * t) % (TREES[1] - TREES[0] + 1), round(DEPTHS[0] * (DEPTHS[1] / DEPTHS[0]) ** (t / max(n - 1, 1)))) for t in range(n)]


def held_out(rated: DataFrame) -> DataFrame:
    """user_id, cell, and k, m, v: number, mean and variance of its held-out ratings, from which follows the squared error of any p."""
    return rated.where("test").groupBy("user_id", "cell").agg(F.count("*").alias("k"), F.avg("rating").alias("m"), F.var_pop("rating").alias("v"))


def user_forests(ratings: DataFrame, features: DataFrame, tries: int = 10, seed: int = 42) -> DataFrame:
    """user_id, item and prediction over unrated items, for each user by the size of forest that fits a held-out tenth best.

    One forest of the largest size has all that are tried: fewer trees are its first ones, a lesser depth is its nodes up
    to there. The forests that predict have seen all ratings and grow beside it.
    """
    spark, most = ratings.sparkSession, max(TREES)
    options = tries_of(tries)
    rows, items, rated = _rows(ratings, features, 2 * most, seed, most)
    leaves = grown(rows, max(DEPTHS))
    deepest = leaves.agg(F.max(_level("node")).alias("d")).first()["d"] or 0  # deeper sizes are all alike
    sizes = spark.createDataFrame([(t, n, min(d, deepest)) for t, (n, d) in enumerate(options)], "t int, n int, depth int")
    depths = F.array(*[F.lit(d) for d in sorted({min(d, deepest) for _, d in options})])
    tests = held_out(rated)
    told = _valued(leaves.where(F.col("tree") < most).withColumn("depth", F.explode(depths)), ["depth"]).join(tests.select("user_id", "cell"), ["user_id", "cell"], "left_semi")
    guess = told.join(F.broadcast(sizes), "depth").where("tree < n").groupBy("user_id", "cell", "t").agg(F.avg("value").alias("p"))
    error = guess.join(tests, ["user_id", "cell"]).groupBy("user_id", "t").agg(F.expr("sum(k * ((p - m) * (p - m) + v)) / sum(CASE WHEN p IS NOT NULL THEN k END)").alias("e"))
    best = error.where("e IS NOT NULL").groupBy("user_id").agg(F.min(F.struct(F.round("e", 9).alias("e"), "t")).alias("b")).select("user_id", F.col("b.t").alias("t")).join(F.broadcast(sizes), "t")
    own = leaves.where(F.col("tree") >= most).join(stored(best, "best"), "user_id", "left")
    own = own.withColumn("n", F.coalesce("n", F.lit(most))).withColumn("depth", F.coalesce("depth", F.lit(DEPTHS[0]))).where(F.col("tree") - most < F.col("n"))
    predicted = _valued(own.select("user_id", "cell", "tree", "node", "w", "wy", "depth")).groupBy("user_id", "cell").agg(F.avg("value").alias("prediction"))
    return _unrated(predicted, items, rated)
