"""Pairs of items under one label against the plain join of rows, and without rows for pairs on the way."""

import random

import pytest
from pyspark.sql import functions as F

from loomwright.operators import joins as J


@pytest.mark.parametrize("block", [2, 512])
def test_pairs_equal_the_join_of_rows(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rnd = random.Random(4)
    rows = [(i, a, rnd.choice([None, 1, 2, 3])) for i in range(40) for a in range(3)] + [(3, 0, 1), (3, 0, 1), (None, 0, 1), (7, None, 2)]
    df = spark.createDataFrame(rows, "item long, a int, l int")
    want = sorted(map(tuple, J.co_labelled(df, "item", "a", "l", 3).collect()))
    assert sorted(map(tuple, J.co_members(df, "item", "a", "l", 3).collect())) == want
    mean, n = J.co_member_totals(df, "item", "a", "l", 3).first()
    assert n == len(want) and mean == pytest.approx(sum(s for _, _, s in want) / n)
    assert tuple(J.co_member_totals(df.where("item = 5"), "item", "a", "l", 3).first()) == (None, 0)
    assert J.co_members(df.where("item = 5"), "item", "a", "l", 3).count() == 0


def test_totals_make_no_pairs_of_items(spark):
    df = spark.range(300_000).select(F.col("id").alias("item"), F.lit(0).alias("a"), (F.col("id") % 3).alias("l"))
    assert tuple(J.co_member_totals(df, "item", "a", "l", 1).first()) == (1.0, 3 * 100_000 * 99_999 // 2)
