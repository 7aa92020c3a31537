"""The likest words against the standard library over all pairs, and pairs that share a component against all pairs."""

import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomwright.operators import fuzzy
from loomwright.plans import annotate


def words(spark, rows, name):
    return spark.createDataFrame([(w,) for w in rows], f"{name} string")


@pytest.mark.parametrize("cutoff", [0.6, 0.85, 0.3])
def test_equals_the_library_on_all_pairs(spark, cutoff):
    rnd = random.Random(3)
    make = lambda: "".join(rnd.choice("aabcdeé 🙂") for _ in range(rnd.randint(1, 12)))
    a, b = [make() for _ in range(60)], [make() for _ in range(150)]
    a += ["", "x", "widget", None]
    b += ["", "widgets", "widget", "wigdet", None, "widget"]
    got = {(r["term"], r["word"]): r["ratio"] for r in fuzzy.alike(words(spark, a, "t"), "t", words(spark, b, "w"), "w", cutoff).collect()}
    want = {(x, y): difflib.SequenceMatcher(None, y, x).ratio() for x in set(a) for y in set(b) if x and y}
    assert got == {k: v for k, v in want.items() if v >= cutoff}


def test_likest_equals_close_matches(spark):
    rnd = random.Random(4)
    known = sorted({"".join(rnd.choice("abcde") for _ in range(rnd.randint(3, 7))) for _ in range(120)})
    asked = ["".join(rnd.choice("abcde") for _ in range(5)) for _ in range(30)]
    got = {}
    for r in fuzzy.likest(words(spark, asked, "t"), "t", words(spark, known, "w"), "w", 3).orderBy("place").collect():
        got.setdefault(r["term"], []).append(r["word"])
    for x in asked:
        assert got.get(x, []) == difflib.get_close_matches(x, known, 3, 0.6)


def test_nothing_is_collected_and_nothing_crossed(spark):
    df = fuzzy.likest(words(spark, ["red widgets"], "t"), "t", words(spark, ["red widget", "blue bolt"], "w"), "w")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "red widget" not in plan
    assert fuzzy.likest(words(spark, [], "t"), "t", words(spark, ["a"], "w"), "w").count() == 0
    with pytest.raises(ValueError):
        fuzzy.alike(words(spark, [], "t"), "t", words(spark, [], "w"), "w", 0.0)


def brute_pairs(rows):
    return sum(bool(set(a) & set(b)) for a, b in itertools.combinations(rows, 2))


@pytest.mark.parametrize("most", [1, 2, 16])
def test_pairs_that_share_are_counted_without_pairs(spark, most):
    rnd = random.Random(most)
    rows = [sorted(rnd.sample(range(14), rnd.randint(1, 4))) for _ in range(150)] + [[99], [98], [98, 97], [1, 2, 3, 4, 5, 6]] + [[0, 1]] * 30
    patterns = spark.createDataFrame([(r,) for r in rows], "p array<int>").groupBy("p").agg(F.count("*").alias("c"))
    assert annotate.sharing_pairs(patterns, most).first()["pairs"] == brute_pairs(rows)
    assert annotate.sharing_pairs(patterns.limit(0)).first()["pairs"] == 0


def test_many_patterns(spark):
    rows = spark.range(20_000).select(F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(60)).cast("int")))).alias("p"))
    patterns = rows.groupBy("p").agg(F.count("*").alias("c"))
    got = annotate.sharing_pairs(patterns).first()["pairs"]
    one = {}
    for r in rows.collect():
        m = sum(1 << i for i in r["p"])
        one[m] = one.get(m, 0) + 1
    import numpy as np

    bits, c = np.array(list(one), np.uint64), np.array(list(one.values()), float)
    share = sum(c[i] * (c[((bits & bits[i]) > 0)].sum()) for i in range(len(bits)))
    assert got == (share - c.sum()) / 2
