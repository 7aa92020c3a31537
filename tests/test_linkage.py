"""Complete linkage and consensus classes against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import clustering as C


def greedy(n, far, threshold, h):
    """Joins the nearest pair of clusters, one after the other; equal distances by the hash of their smallest items."""
    groups = {i: [i] for i in range(n)}
    d = dict(far)
    while True:
        best = min(((v, h[k], k) for k, v in d.items() if v < threshold), default=None)
        if best is None:
            return {i: min(g) for g in groups.values() for i in g}
        a, b = best[2]
        groups[a] += groups.pop(b)
        for c in groups:
            if c != a:
                one, two = (min(a, c), max(a, c)), (min(b, c), max(b, c))
                v = max(d.pop(one, 1.0), d.pop(two, 1.0))
                d[one] = v
        d.pop((a, b), None)


@pytest.mark.parametrize(("seed", "values", "n"), [(1, 1000, 40), (2, 4, 40), (3, 1, 30), (4, 6, 60)])
def test_equals_joining_one_pair_after_the_other(spark, seed, values, n):
    rng = np.random.default_rng(seed)
    far = {(i, j): float(rng.integers(0, values) / values * 0.5) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.9 if values > 1 else 0.7)}
    df = spark.createDataFrame([(i, j, d) if rng.random() < 0.5 else (j, i, d) for (i, j), d in far.items()], "i long, j long, distance double")
    every = spark.range(n).select(F.col("id").alias("a")).crossJoin(spark.range(n).select(F.col("id").alias("b"))).where("a < b")
    h = {(r["a"], r["b"]): r["h"] for r in every.select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    got = {r["item"]: r["label"] for r in C.complete_linkage(df, spark.range(n + 2).withColumnRenamed("id", "item"), "item", 0.4).collect()}
    assert got == greedy(n, far, 0.4, h) | {n: n, n + 1: n + 1}


def test_many_items_at_one_distance(spark):
    """A group of more items than any task would hold as a matrix of distances: rounds halve what is left."""
    n = 300
    df = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("j")).where("i < j").withColumn("distance", F.lit(0.1))
    got = C.complete_linkage(df, spark.range(n).withColumnRenamed("id", "item"), "item", 0.35)
    assert got.select("label").distinct().count() == 1


def labels(spark, rows):
    return spark.createDataFrame([(i, a, lab) for i, t in enumerate(rows) for a, lab in enumerate(t)], "item long, algorithm int, label int")


def test_classes_have_the_matrix_of_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(0, int(rng.integers(0, 3)), int(rng.integers(0, 2))) for _ in range(60)]  # one label holds all items
    df = labels(spark, rows)
    members, pairs = C.consensus_classes(df, "item", "algorithm", "label")
    of = {r["item"]: r["class"] for r in members.collect()}
    assert all((of[i] == of[j]) == (rows[i] == rows[j]) for i in range(60) for j in range(60)) and all(c == min(i for i in of if of[i] == c) for c in of.values())
    share = {(r["i"], r["j"]): r["share"] for r in pairs.collect()}
    assert len(share) <= 15  # 6 combinations of labels
    want = {(r["i"], r["j"]): r["share"] for r in C.consensus(df, "item", "algorithm", "label").collect()}
    for (i, j), s in want.items():
        assert s == (1.0 if of[i] == of[j] else share[min(of[i], of[j]), max(of[i], of[j])])
    assert {(r["i"], r["n_i"], r["j"], r["n_j"]) for r in pairs.collect()} == {(i, list(of.values()).count(i), j, list(of.values()).count(j)) for i, j in share}


def test_linkage_by_classes_equals_linkage_of_items(spark):
    rng = np.random.default_rng(6)
    rows = [tuple(int(v) for v in rng.integers(0, 3, 3)) for _ in range(50)]
    df = labels(spark, rows)
    got = {r["item"]: r["label"] for r in C.linked_items(df, "item", "algorithm", "label", 0.2, 0.35).collect()}
    assert all(got[i] == got[j] for i in got for j in got if rows[i] == rows[j]) and all(got[c] == c <= i for i, c in got.items())
    near = C.rbf_distance(C.consensus(df, "item", "algorithm", "label"))
    close = {(r["i"], r["j"]) for r in near.where("distance < 0.35").collect()}
    groups = {}
    for i, c in got.items():
        groups.setdefault(c, []).append(i)
    assert all((i, j) in close for g in groups.values() for i in g for j in g if i < j)  # all within the threshold
    assert not any(all((min(i, j), max(i, j)) in close for i in g for j in k) for a, g in groups.items() for b, k in groups.items() if a < b)  # none can join
    alone = C.linked_items(df, "item", "algorithm", "label", 0.2, 1e-9).collect()
    assert all(r["item"] == r["label"] for r in alone)
