"""Semantics with values worked out by hand, and quirks that are pinned."""

import http.server
import io
import json
import math
import os
import re
import threading
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import images, similarity, tfidf
from loomwright.functions import metrics as M
from loomwright.functions import text as X
from loomwright.operators import clustering as C
from loomwright.operators import density
from loomwright.operators import names as names_of
from loomwright.operators import dml, graph, joins, predicates, ranking, sweeps
from loomwright.plans import annotate, recommend
from loomwright.sources import sheets, shops, social, tables, web
from loomwright.sources.fixed import COARSE_PALETTE, DETAILED_PALETTE, palette_frame
from loomwright.storage import recover_table, replace_table, scratch_path
from loomwright.streaming import history


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, "red dress"), (2, "red shirt"), (3, "Blue dress"), (4, None)], "id int, t string").where("id < 4")
    w = {(r["id"], r["term"]): round(r["weight"], 6) for r in tfidf.weights(df, "id", "t", ngrams=1).collect()}
    assert w == {(1, "red"): 0.707107, (1, "dress"): 0.707107, (2, "red"): 0.605349, (2, "shirt"): 0.795961, (3, "blue"): 0.795961, (3, "dress"): 0.605349}
    score = tfidf.query_score(df, "id", "t", ["red", "red", "none"], ngrams=1)
    assert {r["id"]: round(r["text_score"], 5) for r in score.collect()} == {1: 1.41421, 2: 1.2107}
    assert tfidf.weights(df.limit(0), "id", "t").count() == 0


def test_stop_words_go_before_bigrams(spark):
    df = spark.createDataFrame([("a fine the dress of wool",)], "t string")
    got = df.select(tfidf.terms(F.col("t"), ["the", "of"]).alias("x")).first()["x"]
    assert got == ["fine", "dress", "wool", "fine dress", "dress wool"]


def test_ordering_score(spark):
    df = spark.createDataFrame([(1, 1, 3), (2, 2, 2), (3, 3, 1), (4, 0, 0)], "id int, t int, r int")
    got = {r["id"]: r["ordering_score"] for r in recommend.ordering_score(recommend.rank_shares(df.where("id < 4"), "t", "r")).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {1: 2.407946, 2: 1.386294, 3: 2.407946}
    assert recommend.rank_shares(df, "t", "r").where("id = 4").first()["trend_factor"] is None
    one = ranking.min_max(spark.createDataFrame([(7.0,), (7.0,)], "x double"), {"x": "y"}, 0.1, 0.9)
    assert {-math.log(r["y"]) for r in one.collect()} == {-math.log(0.1)}


def test_final_score_leaves_the_ordering_out(spark):
    df = spark.createDataFrame([(0.1234, 9.0, 0.5)], "text_score double, ordering_score double, feedback_score double")
    assert recommend.final_score(df).first()["final_score"] == 0.623
    assert recommend.final_score(df, with_ordering=True).first()["final_score"] == 9.623


def test_linear_rank_and_permutation(spark):
    df = spark.createDataFrame([(i, 10 - i) for i in range(4)], "id int, at int")
    got = [round(r["s"], 6) for r in ranking.linear_rank_score(df, [F.desc("at")], "s").orderBy("id").collect()]
    assert got == [1, 0.833333, 0.666667, 0.5]
    assert ranking.linear_rank_score(df.limit(1), [F.desc("at")], "s").first()["s"] == 0.5
    x = spark.createDataFrame([(0, 3.0), (1, 1.0), (2, 2.0)], "id int, v double")
    p = ranking.argsort_permutation(x, [F.asc("v")], [F.asc("id")], "rank", "perm").orderBy("id").collect()
    assert [r["rank"] for r in p] == [2, 0, 1] and [r["perm"] for r in p] == list(np.argsort([3.0, 1.0, 2.0]))


def test_metrics(spark):
    e = spark.createDataFrame([(5.0, 4.5), (4.0, 2.5), (2.0, 3.5), (1.0, 1.0)], "t double, p double")
    r = M.errors(e, F.col("t"), F.col("p")).first()
    assert (r["rmse"], r["mae"]) == (1.089725, 0.875)
    c = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "t int, p int")
    assert tuple(M.classification(c, F.col("t") >= 1, F.col("p") >= 1).first()) == (0.5, 0.5, 0.5, 0.5)


def test_text_pipeline(spark):
    df = spark.createDataFrame([("Visit www.shop.com now! V-neck DRESSES, size 42, sooooo nice ünd für women",)], "t string")
    assert df.select(X.preprocess(F.col("t"), ["für", "fr"]).alias("x")).first()["x"] == "visit now neck dress size sooo nice nd woman"
    assert "man" not in X.stop_words(spark) and "via" in X.stop_words(spark)


def test_labels(spark):
    df = spark.createDataFrame([("maxi", "Length"), ("maxi", "Fit"), ("short", "Length"), ("short", "Sleeve"), ("Mao", "CollarDesign")], "l string, a string")
    assert [r["x"] for r in df.select(X.canonical_label(F.col("l"), F.col("a")).alias("x")).collect()] == ["LONG", "MAXI", "SHORT LENGTH", "SHORT", "MAO COLLAR"]
    p = spark.createDataFrame([(1, "nice dress", "a long sleeve, rounded round neck"), (2, "long dress", "round")], "oid int, headline string, metadata string")
    p = p.withColumn("metadata", F.regexp_replace("metadata", ",", " "))
    labels = spark.createDataFrame([("Length", "long"), ("NeckDesign", "rounded"), ("NeckDesign", "round")], "attr string, label string")
    got = {(r["oid"], r["attr"]): r["labels"] for r in annotate.annotated(p, labels, "oid", {"headline": 0, "metadata": 1}).collect()}
    assert got == {(1, "NeckDesign"): "ROUNDED", (2, "Length"): "LONG", (2, "NeckDesign"): "ROUND"}
    dim = spark.createDataFrame([(5, "Long")], "oid int, description string")
    products = spark.createDataFrame([(1, None), (2, None), (3, 9)], "oid int, length int")
    found = annotate.annotated(p, labels, "oid", {"headline": 0, "metadata": 1})
    assert rows(annotate.fill_missing(products, found, dim, "oid", "length", "Length"), "oid") == [(1, None), (2, 5), (3, 9)]


def test_words_alike(spark):
    df = spark.createDataFrame([("rounded", "round"), ("slim fit", "slim"), (None, "x")], "a string, b string")
    assert [r["x"] and round(r["x"], 6) for r in df.select(similarity.gestalt_ratio("a", "b").alias("x")).collect()] == [0.833333, 0.666667, None]
    one = spark.createDataFrame([("dres",)], "w string").select(similarity.close_matches(F.col("w"), ["dress", "dresses", "shirt"], 2).alias("x"))
    assert one.first()["x"] == ["dress", "dresses"]
    counts = {"dress": 9, "red": 5, "summer": 3}
    s = spark.createDataFrame([("redd dreess sumer zzzzzz",)], "t string")
    assert s.select(similarity.correct_spelling(F.col("t"), counts).alias("x")).first()["x"] == "red dress summer zzzzzz"
    g = spark.createDataFrame([("#summerreddress",)], "t string")
    assert g.select(similarity.segment(F.col("t"), counts).alias("x")).first()["x"] == "summer red dress"


def test_separators_and_prefixes(spark):
    df = spark.createDataFrame([("Red Top",)], "t string")
    assert df.select(X.multi_words(F.col("t")).alias("x")).first()["x"] == ["red", "p"] or df.select(X.multi_words(F.col("t")).alias("x")).first()["x"] == ["red", "p", ""]
    names = spark.createDataFrame([("", 0), ("re(d", 1), ("red", 2)], "n string, o int")
    assert names_of.first_prefix_match(df, names, "t", "n", "o").first()["n"] == "red"


def test_containment_is_by_whole_words(spark):
    docs = spark.createDataFrame([(1, "a round neck"), (2, "rounded"), (3, "neck round neck"), (4, None)], "id int, t string")
    labels = spark.createDataFrame([("round",), ("round neck",), ("",)], "l string")
    assert rows(joins.phrase_matches(docs, labels, "id", "t", "l"), "id", "l") == [(1, "round", 1), (1, "round neck", 1), (3, "round", 1), (3, "round neck", 1)]


def test_nearest_colour_ties_go_to_the_last(spark):
    df = spark.createDataFrame([(0, 0, 250), (127, 127, 127)], "red int, green int, blue int")
    got = [r["name"] for r in joins.nearest_colour(df, palette_frame(spark, COARSE_PALETTE)).collect()]
    assert got == ["blue", "tab:gray"]
    assert len(COARSE_PALETTE) == 27 and len(DETAILED_PALETTE) == 148
    tie = joins.nearest_colour(spark.createDataFrame([(0, 255, 255)], "red int, green int, blue int"), palette_frame(spark, DETAILED_PALETTE))
    assert tie.first()["name"] == "cyan"  # aqua is the same colour and stands before


def test_changes(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, None, 2)], "oid long, name string, n int")
    changes = spark.createDataFrame([(1, None), (3, "c")], "oid long, name string")
    assert rows(dml.update_by_key(t, changes, "oid"), "oid") == [(1, "a", 1), (2, "b", 1), (3, "c", 2)]
    assert rows(dml.update_by_key(t, changes, "oid", strict=True), "oid") == [(1, None, 1), (2, "b", 1), (3, "c", 2)]
    after, before = dml.update_first(t, {"n": 1}, {"name": F.lit("z")}, "oid")
    assert rows(after, "oid") == [(1, "z", 1), (2, "b", 1), (3, None, 2)] and before.count() == 2
    assert dml.update_first(t, {"n": 9}, {"name": F.lit("z")}, "oid")[0].where("name = 'z'").count() == 0
    new = spark.createDataFrame([("b", 5), ("d", 6), ("d", 4)], "name string, n int")
    assert rows(dml.insert_if_absent(t, new, ["name"], "oid", [F.col("n")]), "oid")[3:] == [(4, "d", 4)]
    seeds = spark.createDataFrame([(0, "A", 0), (0, "E", 0), (0, "e", 0)], "oid long, name string, n int")
    assert [r[1].lower() for r in rows(dml.seed(t, seeds, "name", "oid"), "oid")[3:]] == ["e"]
    assert rows(dml.reload(t, new.select("name").distinct(), "oid", [F.asc("name")]), "oid") == [(1, "b", None), (2, "d", None)]


def test_repeated_changes_and_null_keys(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, None, 1)], "oid long, name string, n int")
    changes = spark.createDataFrame([(1, "x", 5, 1), (1, None, 7, 2), (1, "w", 6, 0), (None, "z", 1, 1)], "oid long, name string, n int, at int")
    assert rows(dml.update_by_key(t, changes, "oid", order=[F.col("at")]), "oid") == [(1, "x", 7), (2, None, 1)]
    assert rows(dml.update_by_key(t, changes, "oid", strict=True, order=[F.col("at")]), "oid") == [(1, None, 7), (2, None, 1)]
    new = spark.createDataFrame([("a", 5), ("a", 4), (None, 8), (None, 9), ("c", 1), ("c", 2)], "name string, n int")
    assert rows(dml.upsert(t, new, ["name"], "oid", [F.col("name")], [F.col("n")]), "oid") == [(1, "a", 5), (2, None, 9), (3, "c", 2)]
    assert rows(dml.insert_if_absent(t, new, ["name"], "oid", [F.col("n")]), "oid") == [(1, "a", 1), (2, None, 1), (3, "c", 1)]


def test_a_crash_leaves_a_table(spark):
    path = scratch_path(spark, "t")
    spark.range(3).write.parquet(f"{path}.old")  # renamed away, and the new one not yet in its place
    recover_table(spark, path)
    assert spark.read.parquet(path).count() == 3
    spark.range(9).write.parquet(f"{path}.old")  # the new one is in its place
    recover_table(spark, path)
    assert spark.read.parquet(path).count() == 3 and not os.path.exists(path.removeprefix("file:") + ".old")


def test_a_batch_that_comes_again_gives_the_same_table(spark, tmp_path):
    path, source = scratch_path(spark, "dim"), f"{tmp_path}/in"
    spark.createDataFrame([(1, "a", 1)], "oid long, name string, n int").write.parquet(path)
    spark.createDataFrame([("a", 4), ("b", 2), ("b", 3)], "name string, n int").coalesce(1).write.parquet(source)
    for checkpoint in ("one", "two"):  # a lost checkpoint brings the same batch again
        stream = history.read_stream(spark, source, "name string, n int")
        history.upsert_stream(stream, path, ["name"], "oid", f"{tmp_path}/{checkpoint}", [F.col("n")]).awaitTermination()
        assert rows(spark.read.parquet(path), "oid") == [(1, "a", 4), (2, "b", 3)]


def test_diversity_leaves_pairs_that_are_0_out(spark):
    def of(vectors):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id int, x array<double>")
        return annotate.diversity(df, "id", "x").first()["diversity"]

    assert of([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]) == 0.293
    assert of([[1.0, 0.0], [0.0, 0.0], [2.0, 0.0]]) == 0.0
    assert of([[1.0, 0.0], [0.0, 1.0]]) is None


def test_replace_table(spark):
    path = scratch_path(spark, "t")
    spark.range(3).write.parquet(path)
    replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "x int, y string")
    assert df.where(predicates.matches({"y": "NULL", "x": None})).count() == 1
    assert df.where(predicates.matches({"x": float("nan")})).count() == 3
    assert predicates.infer_numbers(spark.createDataFrame([("1", "1"), (None, "x")], "a string, b string")).dtypes == [("a", "double"), ("b", "string")]
    f = spark.createDataFrame([(None, True), (0, False), (None, None), (-1, False)], "g int, i boolean")
    got = [tuple(r) for r in f.select(*predicates.interaction_state("g", "i")).collect()]
    assert got == [(True, True, False), (True, False, False), (False, False, True), (False, False, False)]


def test_ordinal_is_global(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    got = ranking.ordinal(df, [F.asc("k")], "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))
    assert ranking.ordinal(df.limit(0), [F.asc("k")], "n").count() == 0


def test_connected(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected(links, "a", "b").collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 51: 50}


def test_consensus_and_linkage(spark):
    labels = spark.createDataFrame([(i, a, int(l)) for i, row in enumerate(["000", "001", "012", "112"]) for a, l in enumerate(row)], "item long, algorithm int, label int")
    share = C.consensus(labels, "item", "algorithm", "label")
    assert {(r["i"], r["j"]): r["share"] for r in share.collect()} == {(0, 1): 0.667, (0, 2): 0.333, (1, 2): 0.333, (2, 3): 0.667}
    d = spark.createDataFrame([(0, 1, 1.0), (1, 2, 0.5), (2, 3, 0.0)], "i long, j long, share double")
    far = {(r["i"], r["j"]): r["distance"] for r in C.rbf_distance(d).collect()}
    assert [round(far[k], 9) for k in sorted(far)] == [3.727e-06, 0.043936934, 1.0]
    got = C.complete_linkage(C.rbf_distance(share), labels.select("item").distinct(), "item", 0.35)
    assert rows(got, "item") == [(0, 0), (1, 0), (2, 2), (3, 2)]


def test_dbscan(spark):
    pts = [(1, [0.0, 0.0]), (2, [0.5, 0.0]), (3, [0.0, 0.5]), (4, [1.3, 0.0]), (5, [9.0, 9.0])]
    got = dict(rows(density.dbscan(spark.createDataFrame(pts, "id long, x array<double>"), "id", "x", 1.0, 3), "id"))
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: -1}


def test_clusters_of_clear_groups(spark):
    rng = np.random.default_rng(0)
    data = [(int(g * 20 + i), (rng.normal(0, 0.2, 2) + [g * 5, 0]).tolist()) for g in range(3) for i in range(20)]
    df = spark.createDataFrame(data, "id long, x array<double>")
    for got in (C.select_and_label(df, "id", "x", "kmeans", range(2, 5)), C.fuzzy_c_means(df, "id", "x", 3)):
        label = {r["id"]: r["label"] for r in got.collect()}
        assert len({tuple(label[g * 20 + i] for i in range(20)) for g in range(3)}) == 3 and len(set(label.values())) == 3
    cats = spark.createDataFrame([(i, "ab"[i % 2], "xy"[i % 2], None) for i in range(30)], "id long, p string, q string, r string")
    got = C.kmodes(cats, "id", ["p", "q", "r"], 2)
    assert got.agg(F.sum("mismatches")).first()[0] == 0 and got.select("label").distinct().count() == 2
    axes = C.famd(cats.withColumn("n", F.col("id").cast("double")), "id", ["p", "q"], ["n"], 2).collect()
    assert len(axes) == 30 and all(len(r["coordinates"]) == 2 for r in axes)


def plain_indices(v, label):
    groups = {c: v[label == c] for c in set(label.tolist())}
    square = lambda a, b: ((a - b) ** 2).sum(-1)
    sil = []
    for i, c in enumerate(label.tolist()):
        if len(groups[c]) == 1:
            sil.append(0.0)
            continue
        a = square(groups[c], v[i]).sum() / (len(groups[c]) - 1)
        b = min(square(g, v[i]).mean() for o, g in groups.items() if o != c)
        sil.append((b - a) / max(a, b))
    mid = {c: g.mean(0) for c, g in groups.items()}
    wide = {c: np.sqrt(square(g, mid[c])).mean() for c, g in groups.items()}
    db = np.mean([max((wide[a] + wide[b]) / np.sqrt(square(mid[a], mid[b])) for b in groups if b != a) for a in groups])
    n, k = len(v), len(groups)
    between = sum(len(g) * square(mid[c], v.mean(0)) for c, g in groups.items())
    within = sum(square(g, mid[c]).sum() for c, g in groups.items())
    return np.mean(sil), db, between / within * (n - k) / (k - 1)


@pytest.mark.parametrize("kind", ["kmeans", "birch", "gaussian"])
def test_sweeps_find_groups_and_their_indices(spark, kind):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 0.3, (25, 2)) + [g * 4, g % 2] for g in range(4)] + [[[30.0, 30.0]]])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, x array<double>").repartition(3)
    ks = [2, 4, 5, 7]
    model = sweeps.fitted(df, "id", "x", kind, ks)
    labels = model.labels(v)
    for i, (got, k) in enumerate(zip(sweeps.indices(df, "x", model.labels, ks), ks, strict=True)):
        assert got == pytest.approx(plain_indices(v, labels[:, i]), rel=1e-6)
        assert dict(rows(sweeps.labelled(df, "id", "x", model, i), "id")) == dict(enumerate(labels[:, i].tolist()))
        assert labels[:, i].max() < k
    five = labels[:, 2]
    assert all(len(set(five[25 * g : 25 * g + 25].tolist())) == 1 for g in range(4))
    assert len(set(five.tolist())) == 5 or kind == "gaussian" and len(set(five.tolist())) >= 3  # the process may leave components empty


def test_features_stay_few():
    rng = np.random.default_rng(2)
    v = rng.normal(0, 5, (400, 2))
    n, ls, ss, t = sweeps._absorb(np.ones(400), v, (v * v).sum(1), 20, 0.1)
    assert len(n) <= 20 and t > 0.1 and n.sum() == 400 and np.allclose(ls.sum(0), v.sum(0)) and np.isclose(ss.sum(), (v * v).sum())
    assert np.allclose(sweeps._digamma(np.array([0.1, 1.0, 2.5, 30.0])), [-10.4237549404, -0.5772156649, 0.7031566406, 3.3844381326])


def test_fuzzy_means_choose_k(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 0.2, (30, 2)) + [g * 9, 0] for g in range(3)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, x array<double>")
    model = sweeps.FuzzyMeans.fit(df, "id", "x", [2, 3, 4], 42)
    want = []
    for i, k in enumerate((2, 3, 4)):
        share = model.memberships(v, i) / model.memberships(v, i).sum(0)
        want.append(float(-(share * np.log2(share)).sum() / np.log2(k)))
    assert model.partition_entropy(df, "x") == pytest.approx(want)
    got = C.fuzzy_c_means(df, "id", "x", [2, 3, 4]).collect()
    assert len({r["label"] for r in got}) <= (2, 3, 4)[int(np.argmin(want))]


def test_modes_start_dense_and_far_apart(spark):
    data = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), ("b", "z"), ("c", "z"), (None, "z")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id long, p string, q string")
    filled = df.fillna("-1")
    share = lambda r: sum(sum(o[j] == r[j] for o in data) for j in (0, 1)) / 14
    want = [max(sorted(set(data), key=str), key=share)]
    while len(want) < 4:
        far = lambda r: min(sum(a != b for a, b in zip(r, m, strict=True)) for m in want) * share(r)  # noqa: E731, B023
        want.append(max(sorted(set(data), key=lambda r: (r[0] or "-1", r[1])), key=far))
    assert C.first_modes(filled, ["p", "q"], 4) == [(a or "-1", b) for a, b in want]
    cats = spark.createDataFrame([(i, "abcd"[i % 4], "wxyz"[i % 4]) for i in range(80)], "id long, p string, q string")
    got = C.kmodes(cats, "id", ["p", "q"], range(2, 8))
    assert got.agg(F.sum("mismatches")).first()[0] == 0 and got.select("label").distinct().count() == 4


def test_diversity_without_pairs(spark):
    v = np.random.default_rng(1).normal(size=(30, 5))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = 1 - np.mean([(u[i] @ u[j]) for i in range(30) for j in range(i)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, x array<double>")
    assert annotate.diversity(df, "id", "x").first()["diversity"] == pytest.approx(want, abs=1e-3)


def test_pictures(spark):
    a = np.zeros((20, 30, 3), np.uint8)
    for k, c in enumerate([(250, 0, 0), (0, 250, 0), (0, 0, 250), (250, 250, 0), (9, 9, 9)]):
        a[:, k * 6 : (k + 1) * 6] = c
    a[:2, :6] = (9, 9, 9)
    assert (images.read_ppm(images.write_ppm(a)) == a).all() and images.read_ppm(b"no") is None
    assert images.read_ppm(b"P5 2 1 255 \x01\x02").tolist() == [[[1] * 3, [2] * 3]]
    top = images.dominant_colours(a)
    assert top[0] == (pytest.approx(132 / 600), (9, 9, 9)) and sum(s for s, _ in top) == pytest.approx(1)
    assert images.dominant_colours(a[:, :6]) == images.FAILED
    skin = np.full((40, 40, 3), (200, 140, 120), np.uint8)
    assert images.ycrcb_skin(skin).all() and images.rgb_skin(skin).all() and images.hsv_skin(skin).all()
    assert images.shows_skin(skin) and not images.shows_skin(a) and not images.not_skin(skin)[10:30, 10:30].any()
    assert images.to_hsv(np.array([[[0, 255, 0]]], np.uint8)).tolist() == [[[60, 255, 255]]]
    df = spark.createDataFrame([(1, images.write_ppm(a)), (2, b"bad"), (3, None)], "id long, p binary")
    got = images.extract_colours(df, "id", "p").where("id > 1").collect()
    assert len(got) == 10 and all(r["red"] == -1 for r in got)
    assert rows(images.classify(df, "id", "p", {"Fit": lambda x: 1}, {"Fit": {1: 7}}), "id") == [(1, 7), (2, None), (3, None)]
    crops = images.person_crops(df, "id", "p", lambda x: [(69, (0, 0, 4, 5)), (3, (0, 0, 1, 1))]).collect()
    assert len(crops) == 1 and images.read_ppm(bytes(crops[0]["picture"])).shape == (4, 5, 3)


def test_pages_that_lack_fields(spark):
    pages = spark.createDataFrame([("a", "<html></html>"), ("b", None), ("c", 'window.asos.pdp.config.product = {"name":"N","images":[]};')], "url string, html string")
    got = {r["url"]: r for r in shops.config_product(pages).collect()}
    assert got["a"]["title"] is None and got["a"]["metadata"] == "" and got["c"]["title"] == "N" and got["c"]["image"] is None
    assert shops.cache_search(pages).count() == shops.router_search(pages).count() == 0
    found = spark.createDataFrame([("a", 1), ("b", 2)], "url string, place int")
    assert rows(shops.new_articles(found, spark.createDataFrame([("a",)], "url string"), "url")) == [("b", 2)]
    both = shops.trend_and_reference(found, spark.createDataFrame([("b", 7)], "url string, place int"))
    assert rows(both, "url") == [("a", 1, 0), ("b", 2, 7)]
    price = shops.stock_price(spark.createDataFrame([(1, '[{"productPrice":{"current":{"value":9.5}}}]'), (2, "x")], "key int, body string"))
    assert rows(price, "key") == [(1, 9.5), (2, None)]


def test_fetch_tries_again(spark):
    def fetch(url):
        raise TimeoutError(url)

    urls = spark.createDataFrame([("a",), (None,)], "url string")
    assert rows(shops.fetch_pages(urls, fetch, retry=3), "tries") == [(None, None, 0, None), ("a", None, 2, None)]
    assert rows(shops.fetch_pages(urls.where("url = 'a'"), lambda u: u * 2)) == [("a", "aa", 1, "a")]


class _Shop(http.server.BaseHTTPRequestHandler):
    asked: dict = {}

    def do_GET(self):
        seen = self.asked[self.path] = self.asked.get(self.path, 0) + 1
        if self.path.startswith("/moved"):
            self.send_response(302)
            self.send_header("Location", "/page" if self.path == "/moved" else "/first-lost")
        elif self.path == "/slow":
            time.sleep(1.5)
            return
        else:
            lost = self.path == "/gone" or self.path == "/shaky" and seen == 1 or self.path == "/first-lost" and seen == 1
            self.send_response(503 if lost else 200)
            self.send_header("Content-Type", "text/html; charset=latin-1")
        self.end_headers()
        words = self.headers["User-Agent"], self.headers["Referer"].rsplit("/", 1)[1], self.headers.get("Cookie", "-"), "caf\u00e9"
        self.wfile.write("|".join(words).encode("latin-1"))

    def log_message(self, *_):
        pass


def test_client_of_shops(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Shop)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    site = f"http://127.0.0.1:{server.server_port}"
    client = web.WebClient(agents=["one", "two"], timeout=0.5, cookies={"/page": {"shop": "gr", "size": "m"}})
    try:
        urls = spark.createDataFrame([(f"{site}/{p}",) for p in ("page", "moved", "moved-lost", "shaky", "gone", "slow")] + [("file:///etc/hostname",)], "url string")
        got = {r["url"].rsplit("/", 1)[1]: r for r in shops.fetch_pages(urls.coalesce(1), client).collect()}
    finally:
        server.shutdown()
    assert got["page"]["html"] in ("one|page|shop=gr; size=m|café", "two|page|shop=gr; size=m|café") and got["page"]["tries"] == 1
    assert got["moved"]["final_url"] == f"{site}/page" and "|moved|" in got["moved"]["html"]
    assert got["moved-lost"]["final_url"] == f"{site}/first-lost" and got["moved-lost"]["tries"] == 1  # asked once more where it led to
    assert (got["shaky"]["tries"], got["gone"]["tries"], got["slow"]["tries"]) == (2, 2, 2)
    assert got["shaky"]["html"] and not got["gone"]["html"] and not got["slow"]["html"] and not got["hostname"]["html"]


def test_post_tokens(spark):
    posts = {
        "Loving my new dress :-) <3 #OOTD @the_shop!": ["Loving", "my", "new", "dress", ":-)", "<3", "#OOTD", "@the_shop", "!"],
        "see https://shop.example/a?b=1, or www.x.de": ["see", "https://shop.example/a?b=1,", "or", "www.x.de"],
        "soooooo nice....... it's a V-neck, size 10-12": ["sooo", "nice", "...", "it's", "a", "V-neck", ",", "size", "10-12"],
        "mail me@shop.co.uk --> <b>now</b>": ["mail", "me@shop.co.uk", "-->", "<b>", "now", "</b>"],
        "caf\u00e9 cr\u00e8me \U0001f457\U0001f457 don't_stop foo_": ["café", "crème", "\U0001f457", "\U0001f457", "don't_stop", "foo", "_"],
        "": [],
    }
    df = spark.createDataFrame([*[(p,) for p in posts], (None,)], "t string")
    got = {r["t"]: r["w"] for r in df.select("t", X.post_tokens(F.col("t")).alias("w")).collect()}
    assert got == {**posts, None: None}
    assert df.limit(3).select(X.post_tokens(F.col("t"), reduce_len=False).alias("w")).collect()[2]["w"][:2] == ["soooooo", "nice"]


def test_lemma_rules(spark):
    words = ["women", "men", "amen", "dress", "dresses", "boxes", "watches", "dishes", "ties", "parties", "skirts", "bus", "axis", "pass", "s", "", "buzzes", "shoe"]

    def plain(w):
        if w.endswith("men") and len(w) > 3:
            return w[:-2] + "an"
        if len(w) <= 3:
            return w
        if w.endswith("ies") and len(w) > 4:
            return w[:-3] + "y"
        if re.search("(ss|x|ch|sh|zz)es$", w):
            return w[:-2]
        return w if re.search("(ss|us|is)$", w) else re.sub("s$", "", w)

    df = spark.createDataFrame([*[(w,) for w in words], (None,)], "w string")
    assert {r["w"]: r["l"] for r in df.select("w", X.lemma(F.col("w")).alias("l")).collect()} == {**{w: plain(w) for w in words}, None: None}


def test_tile_requests(spark):
    page = """<div class="hidden jsOVModel" data-ovmodel='{"hitCount":30,"urlAjax":"https://x/y","params":{"q":"red dress","qold":"z"}}'></div>"""
    got = shops.tile_request(spark.createDataFrame([("u", page)], "url string, html string"), newest=True).first()
    assert got["hits"] == 30 and got["request"] == "https://x/y?q=red%20dress&srule=newest-products&start=0&sz=12&lazyloadFollowing=true&view=ajax"


def test_social_posts(spark, tmp_path):
    pin = lambda k, **more: {"type": "pin", "link": f"l{k}", "title": "t", "images": {"orig": {"url": f"i{k}"}}, **more}
    pages = [[pin(1), pin(2, is_promoted=True), pin(3, videos={"x": 1})], [pin(1), pin(4)], [], [], [], [pin(9)]]
    os.makedirs(tmp_path / "red")
    for i, p in enumerate(pages):
        (tmp_path / "red" / f"{i:03d}.json").write_text(json.dumps({"results": p}))
    assert social.read_posts(spark, f"file:{tmp_path}").collect() == social.read_posts(spark, str(tmp_path)).collect()
    got = social.read_posts(spark, str(tmp_path))
    assert [(r["term"], r["url"], r["image"]) for r in got.orderBy("url").collect()] == [("red", "l1", "i1"), ("red", "l4", "i4")]
    assert social.read_posts(spark, str(tmp_path), limit=1).count() == 1
    post = {"media": {"media_type": 1, "code": "c", "caption": {"text": "so #nice 2day"}, "taken_at": 5}}
    os.makedirs(tmp_path / "posts" / "t")
    (tmp_path / "posts" / "t" / "0.json").write_text(json.dumps({"data": {"recent": {"sections": [{"layout_content": {"medias": [post, {"media": {"media_type": 2}}]}}]}}}))
    one = social.letters_only(social.read_posts(spark, str(tmp_path / "posts"), "post")).first()
    assert (one["url"], one["description"], one["at"]) == ("c", "so nice day", 5)


def test_sheets(spark, tmp_path):
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>name</t></si><si><t>n</t></si><si><t>red</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>5</v></c></row><row r="3"><c r="B3"><v>6</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(out.getvalue())
    got = sheets.read_excel(spark, str(tmp_path / "b.xlsx"), "S", ["name", "n", "none"])
    assert rows(got, "n") == [("red", "5", None), (None, "6", None)]


def test_files_and_models(spark, tmp_path):
    (tmp_path / "w.txt").write_text("Red, blue,,red ,Red")
    assert sorted(r["word"] for r in tables.read_word_list(spark, str(tmp_path / "w.txt")).collect()) == ["Red", "blue", "red"]
    for n, t in (("rating-1", 1000), ("rating-2", 3000), ("other", 9000)):
        os.makedirs(tmp_path / "m" / n)
        os.utime(tmp_path / "m" / n, (t, t))
    assert tables.newest_model(spark, str(tmp_path / "m"), "rating").endswith("rating-2")
    assert tables.remove_model(spark, str(tmp_path / "m" / "rating-2")) and tables.newest_model(spark, str(tmp_path / "m"), "rating").endswith("rating-1")
    assert tables.newest_model(spark, str(tmp_path / "none"), "x") is None


def test_streams(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 10:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT)) AS ts, id % 3 AS user_id, CAST(id AS DOUBLE) AS rank FROM range(10)").write.parquet(str(tmp_path / "e"))
    s = history.read_stream(spark, str(tmp_path / "e"), "ts timestamp, user_id long, rank double")
    assert history.collected(history.first_seen(s, "ts", "user_id"), "seen_users").count() == 3
    w = history.collected(history.windowed_ranks(s, "ts", "user_id", "rank"), "ranks", "complete")
    assert {r["best"] for r in w.collect()} == {0.0, 1.0, 2.0}
    assert history.collected(history.sessions(s, "ts", "user_id"), "sess", "complete").count() == 3


def test_literal_rows(spark):
    dim = spark.createDataFrame([(7, "a", None), (3, None, 1)], "oid int, name string, more int")
    got = dml.insert_literals(dim, "oid", [{"name": "x"}, {"name": "x", "more": 2}])
    assert got.schema == dim.schema
    assert rows(got, "oid") == [(3, None, 1), (7, "a", None), (8, "x", None), (9, "x", 2)]
    assert rows(dml.insert_literals(dim.limit(0), "oid", [{}])) == [(1, None, None)]
    assert dml.insert_literals(dim, "oid", []) is dim
    with pytest.raises(ValueError, match="colour"):
        dml.insert_literals(dim, "oid", [{"colour": 1}])


def test_alike_labels_of_many_products(spark):
    labels = spark.createDataFrame([("Fit", "slim"), ("Fit", "slimm"), ("Fit", "loose")], "attr string, label string")
    texts = [(i, "slim slimm loose" if i % 2 else "loose slimm") for i in range(40)] + [(40, "nothing"), (41, None)]
    got = annotate.annotated(spark.createDataFrame(texts, "id int, t string"), labels, "id", {"t": 0})
    want = [(i, "Fit", "SLIM FIT,SLIMM,LOOSE" if i % 2 else "LOOSE,SLIMM") for i in range(40)]
    assert [(r["id"], r["attr"], r["labels"]) for r in got.orderBy("id").collect()] == want
    near = annotate.annotated(spark.createDataFrame(texts, "id int, t string"), labels.replace({"Fit": "Style"}), "id", {"t": 0})
    assert [r["labels"] for r in near.orderBy("id").collect()] == ["SLIM,LOOSE" if i % 2 else "LOOSE,SLIMM" for i in range(40)]


def test_rank_score_and_place_from_the_last(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 5), (4, None)], "id int, at int")
    got = ranking.linear_rank_score(df, [F.desc("at"), F.asc("id")], "score", from_last="place")
    assert rows(got.select("id", F.round("score", 4), "place")) == [(1, 0.8333, 2), (2, 1.0, 3), (3, 0.6667, 1), (4, 0.5, 0)]
    assert rows(ranking.linear_rank_score(df.limit(1), [F.desc("at")], "score", from_last="place").select("score", "place")) == [(0.5, 0)]
    assert ranking.linear_rank_score(df, [F.desc("at")], "score").columns == ["id", "at", "score"]


def test_terms_of_a_file_of_one_part_are_counted_side_by_side(spark, monkeypatch):
    written = []
    monkeypatch.setattr(tfidf, "stored", lambda df, name: written.append((name, df)) or df)
    text = "the red dress and the blue dress " * 3
    df = spark.createDataFrame([(i, f"{text}w{i}") for i in range(40)] + [(40, None)], "id long, t string").coalesce(1)
    w = tfidf.weights(df, "id", "t", ["the"], 2)
    tf = dict(written)["terms"]
    conf = "spark.sql.adaptive.enabled"
    spark.conf.set(conf, "false")
    try:
        assert tf.rdd.getNumPartitions() > 1
        assert tf._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # dealt out once, not again for the counts
    finally:
        spark.conf.set(conf, "true")
    assert {(r["term"], r["tf"]) for r in tf.where("id = 7").collect()} == {("red", 3), ("dress", 6), ("and", 3), ("blue", 3), ("w7", 1), ("red dress", 3), ("dress and", 3), ("and blue", 3), ("blue dress", 3), ("dress red", 2), ("dress w7", 1)}
    assert w.where("id = 40").count() == 0


def test_the_limit_of_a_search_page_is_read_once_a_page(spark):
    def page(n, limit):
        items = ",".join(f'{{"url":"{i}","image":"i","price":{i}.0,"reducedPrice":0.5,"isSale":false}}' for i in range(n))
        return f"{limit}<script>JSON.parse('{{\"router\":\"x\",\"search\":{{\"products\":[{items}]}}}}')</script>"

    pages = spark.createDataFrame([("a", page(9, '<progress max="4"></progress>')), ("b", page(9, "")), ("c", page(9, '<progress max="0"></progress>')), ("d", "x"), ("e", None), ("f", page(0, ""))], "url string, html string")
    found = shops.router_search(pages)
    assert sorted((r["page"], r["place"], r["price"]) for r in found.collect()) == [("a", i + 1, float(i)) for i in range(4)] + [("b", i + 1, float(i)) for i in range(9)]
    assert sorted((r["page"], r["place"]) for r in shops.router_search(pages, most=2).collect()) == [(p, i) for p in "ab" for i in (1, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan[: plan.index("Generate")]  # nothing looks at the page for each product
