"""Plans: what reaches the scan, and what must not be in them."""

import os

import pytest
from pyspark.sql import functions as F

from loomwright.operators import joins
from loomwright.operators.predicates import matches
from loomwright.registry import QUERIES, table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(table(spark, SF, "orders").where(matches({"o_orderstatus": "F"})).select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in p and "o_totalprice" not in p


def test_outer_join_with_a_filter_becomes_inner(spark):
    import loomwright.plans.catalogue  # noqa: F401

    p = plan(QUERIES["j02_filtered_outer"](spark, SF))
    assert "Inner" in p and "LeftOuter" not in p


def test_missing_rows_are_an_anti_join(spark):
    assert "LeftAnti" in plan(QUERIES["p22_missing_probe"](spark, SF))


def test_no_cartesian_products_in_the_flagship(spark):
    for name in ("x01_tfidf", "x03_text_score", "j11_whole_word_containment", "x17_diversity"):
        p = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in p and "PythonUDF" not in p and "Python" not in p


def test_texts_are_split_once(spark):
    for name in ("x01_tfidf", "x03_text_score"):
        p = plan(QUERIES[name](spark, SF))
        assert "regexp_extract_all" not in p and p.count("documents.parquet") <= 1  # terms are a table by now
    from loomwright.functions import tfidf

    df = spark.createDataFrame([(i, "red dress " + "of all " * 3 + str(i)) for i in range(50)], "id int, t string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(tfidf.weights(df, "id", "t"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = p[p.index("SortMergeJoin") :]
    assert join.count("Exchange hashpartitioning(term") == 2 and "HashAggregate" not in join  # both sides can be split


def test_no_window_over_the_whole_frame(spark):
    df = spark.range(100).withColumn("v", F.rand(1))
    from loomwright.operators.ranking import min_max

    assert "Window" not in plan(min_max(df, {"v": "s"}, 0.0, 1.0))


def test_phrases_are_an_equi_join(spark):
    docs = spark.createDataFrame([(1, "a b c")], "id int, t string")
    labels = spark.createDataFrame([("b c",)], "l string")
    p = plan(joins.phrase_matches(docs, labels, "id", "t", "l"))
    assert "SortMergeJoin" in p or "BroadcastHashJoin" in p or "ShuffledHashJoin" in p
