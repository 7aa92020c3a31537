"""Passes of clusterings over distinct vectors, against plain passes over all rows."""

import numpy as np
from pyspark.sql import functions as F

from loomwright.operators import sweeps


def test_passes_go_over_distinct_vectors(spark):
    rows = spark.range(600).repartition(1).select("id", F.array((F.col("id") % 4).cast("double"), (F.col("id") % 3).cast("double")).alias("x"))
    at = sweeps.places(rows, "x")
    seen = spark.sparkContext.accumulator(0)

    def of(v, times):
        seen.add(len(v))
        return sweeps._with_ones(v, times).sum(0, keepdims=True)

    got = sweeps.sums(at, "x", of, 1, 3)
    assert got.tolist() == [[600.0, 900.0, 600.0]] and seen.value == 12
    assert at.rdd.getNumPartitions() > 1  # of a table that came in one part
    labels = lambda v: np.column_stack([(v[:, 0] > 1).astype(int), v[:, 1].astype(int)])
    np.testing.assert_allclose(sweeps.indices(at, "x", labels, [2, 3]), sweeps.indices(rows, "x", labels, [2, 3]), rtol=1e-12)


def test_memberships_and_scores_of_all_clusterings_at_once():
    rng, ks = np.random.default_rng(1), [2, 3, 5]
    v, centres = rng.normal(size=(50, 4)), [rng.normal(size=(k, 4)) for k in ks]
    for m in (2.0, 1.5):
        model = sweeps.FuzzyMeans(centres, m)
        want = []
        for c in centres:
            d = np.maximum(((v[:, None, :] - c[None]) ** 2).sum(2), 1e-18) ** (1 / (m - 1))
            want.append(1 / (d * (1 / d).sum(1, keepdims=True)))
        np.testing.assert_allclose(model.every(v).T, np.column_stack(want), rtol=1e-12)
        np.testing.assert_allclose(model.memberships(v, 1), want[1], rtol=1e-12)
    factors = [np.linalg.cholesky(np.stack([np.eye(4) + np.outer(c, c) for c in cs])) for cs in centres]
    constants = [rng.normal(size=k) for k in ks]
    model = sweeps.Mixture(centres, factors, constants)
    want = []
    for c, f, t in zip(centres, factors, constants, strict=True):
        y = np.einsum("nd,kde->kne", v, f) - np.einsum("kd,kde->ke", c, f)[:, None]
        want.append(t - 0.5 * (y * y).sum(2).T)
    np.testing.assert_allclose(model.scores(v).T, np.column_stack(want), rtol=1e-9, atol=1e-9)
    assert model.labels(v).tolist() == np.column_stack([w.argmax(1) for w in want]).tolist()
