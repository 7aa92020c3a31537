"""Commands, adapters and saved models."""

import json

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector

from loomwright.__main__ import parser, run
from loomwright.sources import adapters


def test_recommend(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(["red dress", "red dresses sale", "blue shirt", "red shirt", "blue dress", "green hat"])], "oid long, metadata string").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([(i, i + 1, 6 - i) for i in range(6)], "oid long, reference_order int, trending_order int").write.parquet(f"{tmp_path}/h")
    run(spark, parser().parse_args(["recommend", "--products", f"{tmp_path}/p", "--history", f"{tmp_path}/h", "--term", "Red!", "--out", f"{tmp_path}/o"]))
    assert {r["oid"] for r in spark.read.parquet(f"{tmp_path}/o").collect()} == {0, 1, 3}


def test_annotate_and_consensus(spark, tmp_path):
    spark.createDataFrame([(1, "long dress", "slim")], "oid int, headline string, metadata string").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([("Length", "Long"), ("Fit", "SLIM")], "attr string, label string").write.parquet(f"{tmp_path}/l")
    run(spark, parser().parse_args(["annotate", "--products", f"{tmp_path}/p", "--labels", f"{tmp_path}/l", "--out", f"{tmp_path}/o"]))
    assert {(r["attr"], r["label"]) for r in spark.read.parquet(f"{tmp_path}/o").collect()} == {("Length", "LONG"), ("Fit", "SLIM FIT")}
    spark.createDataFrame([(i, a, i // 2) for i in range(4) for a in range(3)], "item long, algorithm int, label int").write.parquet(f"{tmp_path}/c")
    run(spark, parser().parse_args(["consensus", "--labels", f"{tmp_path}/c", "--out", f"{tmp_path}/k"]))
    assert {r["item"]: r["label"] for r in spark.read.parquet(f"{tmp_path}/k").collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_adapters(spark):
    assert adapters.adapter("Zal") is adapters.adapter("zalando") and adapters.adapter("") is None and adapters.adapter("none") is None
    pages = spark.createDataFrame([("u", "<html></html>")], "url string, html string")
    assert adapters.search_all({"asos": pages}, ["asos", "zalando"])["asos"].count() == 0


def test_models_are_found_by_name_and_time(spark, tmp_path):
    df = spark.createDataFrame([([0.0],), ([9.0],), ([20.0],)], "x array<double>").select(array_to_vector("x").alias("features"))
    for k in (2, 3):
        adapters.save_model(KMeans(k=k, seed=1).fit(df), str(tmp_path), "groups")
    assert len(adapters.load_newest(spark, str(tmp_path), "groups", KMeansModel.load).clusterCenters()) == 3
    assert adapters.load_newest(spark, str(tmp_path), "none", KMeansModel.load) is None


def test_crawl(spark, tmp_path):
    def page(url, keys):
        products = json.dumps({"router": "x", "search": {"products": [{"url": str(k), "image": f"i{k}", "price": 2.0 * k, "isSale": False} for k in keys]}})
        return url, f"<script>JSON.parse('{products}')</script>"

    site = "https://www.asos.com/uk/"
    spark.createDataFrame([page("p1", [3, 1]), page("p2", [2, 3])], "url string, html string").write.parquet(f"{tmp_path}/t")
    spark.createDataFrame([page("p1", [1, 2])], "url string, html string").write.parquet(f"{tmp_path}/r")
    spark.createDataFrame([(1, site + "1", 0.5), (2, "other", 7.0)], "oid long, url string, price double").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([], "oid long, product long, at timestamp, reference_order int, trend_order int, price double").write.parquet(f"{tmp_path}/h")
    args = ["crawl", "--adapter", "asos", "--trend", f"{tmp_path}/t", "--reference", f"{tmp_path}/r", "--products", f"{tmp_path}/p", "--history", f"{tmp_path}/h", "--out", f"{tmp_path}/o", "--at"]
    run(spark, parser().parse_args([*args, "2024-01-01 00:00:00"]))
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/p").collect()} == {(1, site + "1", 2.0), (2, "other", 7.0), (3, site + "2", 4.0), (4, site + "3", 6.0)}
    ranks = {(r["product"], r["trend_order"], r["reference_order"], r["price"]) for r in spark.read.parquet(f"{tmp_path}/h").collect()}
    assert ranks == {(4, 1, 0, 6.0), (1, 2, 1, 2.0), (3, 3, 2, 4.0)}
    run(spark, parser().parse_args([*args, "2024-01-02 00:00:00"]))
    assert spark.read.parquet(f"{tmp_path}/p").count() == 4 and spark.read.parquet(f"{tmp_path}/h").count() == 6


def test_recommend_with_feedback(spark, tmp_path):
    texts = ["red dress", "red dresses sale", "blue shirt", "red shirt", "blue dress", "green hat", "red dress red"]
    spark.createDataFrame(list(enumerate(texts)), "oid long, metadata string").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([(i, i + 1, 7 - i) for i in range(7)], "oid long, reference_order int, trending_order int").write.parquet(f"{tmp_path}/h")
    spark.createDataFrame([(0, 5, False), (2, 1, True), (3, 0, True)], "oid long, rating int, irrelevant boolean").write.parquet(f"{tmp_path}/f")
    run(spark, parser().parse_args(["recommend", "--products", f"{tmp_path}/p", "--history", f"{tmp_path}/h", "--term", "red", "--feedback", f"{tmp_path}/f", "--out", f"{tmp_path}/o"]))
    got = {r["oid"]: r for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    assert set(got) == {0, 1, 3, 6} and all(r["final_score"] == round(r["text_score"] + r["feedback_score"], 3) for r in got.values())
