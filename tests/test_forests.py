"""Forests that grow as tables, against plain trees of the same draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import forests as R


def data(spark, n=60, users=3, each=40, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.uniform(0, 100, n).round(2)]).astype(float)
    rated = [(u, int(i), float(np.round((x[i, 0] > 5) * 3 + (x[i, 1] > 40 + 10 * u) + rng.normal(0, 0.1), 3))) for u in range(users) for i in rng.permutation(n)[:each]]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, features array<double>")
    return spark.createDataFrame(rated, "user_id long, item long, rating double"), items, x, rated


def plain_tree(cells, y, w, depth):
    """A function from a cell to (values at depth 0, 1, ...) along its way."""
    def build(rows, level):
        value = sum(w[r] * y[r] for r in rows) / sum(w[r] for r in rows)
        best = None
        for f in range(len(cells[0])) if level < depth else ():
            for b in sorted({cells[r][f] for r in rows})[:-1]:
                parts = [[r for r in rows if (cells[r][f] > b) == side] for side in (False, True)]
                gain = sum(sum(w[r] * y[r] for r in p) ** 2 / sum(w[r] for r in p) for p in parts) - sum(w[r] * y[r] for r in rows) ** 2 / sum(w[r] for r in rows)
                if round(gain, 9) > 0 and (best is None or round(gain, 9) > best[0]):
                    best = round(gain, 9), f, b, parts
        return (value, None) if best is None else (value, (best[1], best[2], *[build(p, level + 1) for p in best[3]]))

    root = build([r for r in range(len(y)) if w[r] > 0], 0)

    def ask(cell):
        node, out = root, []
        while True:
            out.append(node[0])
            if node[1] is None:
                return out
            f, b, low, high = node[1]
            node = high if cell[f] > b else low

    return ask


def draws(spark, ratings, trees, seed=42):
    t = ratings.select("user_id", "item", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    return {(r["user_id"], r["item"], r["tree"]): r["w"] for r in t.withColumn("w", R.drawn("user_id", "item", "tree", seed)).collect()}


def test_fixed_forest_equals_plain_trees(spark):
    ratings, items, x, rated = data(spark)
    cell = {r["item"]: r["cell"] for r in R.binned(items, R.cuts(items)).collect()}
    w = draws(spark, ratings, 6)
    got = {(r["user_id"], r["item"]): r["prediction"] for r in R.fixed_forest(ratings, items, trees=6, depth=4).collect()}
    assert set(got) == {(u, i) for u in range(3) for i in range(60)} - {(u, i) for u, i, _ in rated}
    for u in range(3):
        mine = [(i, y) for v, i, y in rated if v == u]
        asks = [plain_tree([cell[i] for i, _ in mine], [y for _, y in mine], [w[u, i, t] for i, _ in mine], 4) for t in range(6)]
        for (v, i), p in got.items():
            if v == u:
                assert p == pytest.approx(np.mean([a(cell[i])[-1] for a in asks]), abs=2e-6)


def test_each_user_gets_the_size_that_fits_the_held_out_best(spark, monkeypatch):
    monkeypatch.setattr(R, "TREES", (2, 4))
    monkeypatch.setattr(R, "DEPTHS", (1, 4))
    ratings, items, x, rated = data(spark, seed=3)
    options = R.tries_of(3)
    assert len({d for _, d in options}) > 1
    cell = {r["item"]: r["cell"] for r in R.binned(items, R.cuts(items)).collect()}
    held = {r["item"] for r in R.split(items, "item").where("test").collect()}
    w = draws(spark, ratings, 8)
    got = {(r["user_id"], r["item"]): r["prediction"] for r in R.user_forests(ratings, items, tries=3).collect()}
    for u in range(3):
        mine = [(i, y) for v, i, y in rated if v == u]
        build = lambda t, rows: plain_tree([cell[i] for i, _ in mine], [y for _, y in mine], [w[u, i, t] * (i in rows) for i, _ in mine], 4)  # noqa: B023, E731
        tuned = [build(t, {i for i, _ in mine} - held) for t in range(4)]
        final = [build(t, {i for i, _ in mine}) for t in range(4, 8)]
        say = lambda asks, n, d, i: np.mean([a(cell[i])[: d + 1][-1] for a in asks[:n]])
        errors = [round(float(np.mean([(say(tuned, n, d, i) - y) ** 2 for i, y in mine if i in held])), 9) for n, d in options]
        n, d = options[int(np.argmin(errors))]
        for (v, i), p in got.items():
            if v == u:
                assert p == pytest.approx(say(final, n, d, i), abs=2e-6)


def test_full_forests_learn_what_users_like(spark):
    ratings, items, x, _ = data(spark, n=120, each=90, seed=5)
    got = R.user_forests(ratings, items).collect()
    assert len(got) == 3 * 30
    assert np.mean([abs(r["prediction"] - ((x[r["item"], 0] > 5) * 3 + (x[r["item"], 1] > 40 + 10 * r["user_id"]))) for r in got]) < 0.3


def test_odd_rows(spark):
    none = spark.createDataFrame([], "user_id long, item long, rating double")
    items = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, None), (4, [None])], "item long, features array<double>")
    assert R.fixed_forest(none, items, 2, 2).count() == 0
    one = spark.createDataFrame([(7, 1, 3.0), (8, 2, None)], "user_id long, item long, rating double")
    got = {(r["user_id"], r["item"]): r["prediction"] for r in R.fixed_forest(one, items, 3, 2).collect()}
    assert got[7, 2] == got[7, 4] == 3.0 and (7, 3) not in got and (7, 1) not in got


def test_no_task_holds_a_user(spark):
    """A level's sums are partial before they are exchanged, by node, feature and bin."""
    rows = spark.createDataFrame([(1, [k % 50, k % 7], 0, 1.0, float(k)) for k in range(1000)], "user_id long, cell array<int>, tree int, w double, wy double")
    leaves = R.grown(rows, 3)
    assert leaves.count() == 1000 and leaves.select("node").distinct().count() == 8


def test_draws_are_added_up_in_compiled_code_and_dealt_out(spark, tmp_path):
    """One row for many trees of a rating; the virtual machine compiles no method of more than 8000 bytes."""
    rated = [(u, i, [i % 5], float(i % 7), i % 4 == 0) for u in range(2) for i in range(60)]
    spark.createDataFrame(rated, "user_id long, item long, cell array<int>, rating double, test boolean").coalesce(1).write.parquet(str(tmp_path / "rated"))
    table = spark.read.parquet(str(tmp_path / "rated"))
    everyone = table.select("user_id", "cell").distinct().union(spark.createDataFrame([(0, [9])], "user_id long, cell array<int>"))
    out = R.summed(table, everyone, 21, 42, 11)  # neither number is a multiple of SIDE
    w, want = draws(spark, table, 21), {}
    for u, i, c, y, test in rated:
        for t in range(21):
            n = 0.0 if test and t < 11 else w[u, i, t]
            a, b = want.get((u, c[0], t), (0.0, 0.0))
            want[u, c[0], t] = a + n, b + n * y
    want |= {(0, 9, t): (0.0, 0.0) for t in range(21)}
    assert {(r["user_id"], r["cell"][0], r["tree"]): (r["w"], r["wy"]) for r in out.collect()} == want and out.count() == len(want)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = R.summed(table, everyone, 80, 42, 40)._jdf.queryExecution().debug().codegenToSeq()
        sizes = [stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000
    assert table.rdd.getNumPartitions() == 1 and "REPARTITION_BY_COL" in out._jdf.queryExecution().toString()


def test_held_out_ratings_of_a_cell_are_one_row(spark):
    y = [float(k % 11) / 4 for k in range(200)]
    rated = spark.createDataFrame([(3, [1, 2], v, k % 2 == 0) for k, v in enumerate(y)], "user_id long, cell array<int>, rating double, test boolean")
    (r,) = R.held_out(rated).collect()
    assert r["k"] == 100 and (1.7 - r["m"]) ** 2 + r["v"] == pytest.approx(np.mean([(1.7 - v) ** 2 for v in y[::2]]), abs=1e-12)
