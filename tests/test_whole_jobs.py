"""Queries of the library do the whole job: nothing is left out by its length or its place."""

from pyspark.sql import functions as F

import loomwright.plans.catalogue  # noqa: F401
from loomwright.functions import similarity
from loomwright.registry import QUERIES


def test_long_runs_are_segmented(spark):
    words = ["summer", "red", "dress"] * 400
    df = spark.createDataFrame([("".join(words),)], "t string")
    assert df.select(similarity.segment(F.col("t"), {"dress": 9, "red": 5, "summer": 3}).alias("x")).first()["x"].split() == words


def test_all_brands_are_matched(spark, tmp_path):
    brands = [f"brand{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    spark.createDataFrame(list(enumerate(brands)), "p_partkey int, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = dict(QUERIES["t09_fuzzy_top_k"](spark, str(tmp_path)).collect())
    assert all(got[i][0] == b for i, b in enumerate(brands))


def test_forests_are_of_all_users_and_full_size(spark, tmp_path, monkeypatch):
    from loomwright.plans import models

    parts = [(i, i % 50, 900.0 + i) for i in range(40)]
    spark.createDataFrame(parts, "p_partkey int, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    lines = [((i * 7 + u) % 40, u, float(1 + (i + u) % 50)) for u in range(10) for i in range(20)]
    spark.createDataFrame(lines, "l_partkey int, l_suppkey int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    asked = []
    made = spark.createDataFrame([(1, 1, 1.0)], "user_id int, item int, prediction double")
    for f in ("user_forests", "fixed_forest"):
        monkeypatch.setattr(models.R, f, lambda r, f, **k: asked.append(({x[0] for x in r.select("user_id").distinct().collect()}, k)) or made)
    QUERIES["m14_user_forests"](spark, str(tmp_path))
    QUERIES["m15_fixed_forest"](spark, str(tmp_path))
    models.forest_recommendation(spark, str(tmp_path))
    assert asked == [(set(range(10)), {})] * 3  # all users, the operators' own sizes


def test_recommendation_starts_from_search_words(spark):
    from loomwright.plans import annotate

    products = spark.createDataFrame([(1, "Red Dress", 3), (2, "red dress", 1), (3, "blue bolt", 1), (4, "red dresses", 2), (5, "RED DRESS", 2)], "item int, word string, grade int")
    kept = spark.createDataFrame([(8, 1, 0.9), (8, 2, 0.6), (8, 3, 0.8), (8, 4, 0.7), (9, 5, 0.5)], "user_id int, item int, prediction double")  # 8 has rated 5
    got = annotate.recommended_from_query(products, kept, "red dres", 2).collect()
    assert [tuple(r) for r in got] == [(8, 2, 0.6, 1), (8, 4, 0.7, 2), (8, 1, 0.9, 3), (9, 5, 0.5, 2)]


def test_clusterings_try_the_surveyed_range(spark, monkeypatch):
    from loomwright.plans import models

    asked = []
    monkeypatch.setattr(models, "vectors", lambda spark, d: None)
    for f in ("select_and_label", "scores_of_k"):
        monkeypatch.setattr(models.C, f, lambda df, i, x, kind, ks: asked.append((kind, list(ks))))
    monkeypatch.setattr(models.C, "fuzzy_c_means", lambda df, i, x, k: asked.append(list(k)))
    for name in ("m03_kmeans_selected", "m04_birch", "m07_gaussian_mixture", "m13_model_selection", "m05_fuzzy_c_means"):
        QUERIES[name](spark, "")
    whole = list(range(2, 31))
    assert asked == [("kmeans", whole), ("birch", whole), ("gaussian", whole), ("kmeans", whole), whole]


def test_pictures_of_a_file_of_one_part_are_made_side_by_side(spark, tmp_path):
    from loomwright.plans import media, pages

    spark.range(40).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    for made in (pages.pictures(spark, str(tmp_path)), media.pixel_pictures(spark, str(tmp_path))):
        used = made.select(F.spark_partition_id().alias("p"), "s_suppkey").collect()
        assert len({r["p"] for r in used}) > 1 and sorted(r["s_suppkey"] for r in used) == list(range(40))
