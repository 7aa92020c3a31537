"""Spelling by the counts of a corpus against plain Python over all known words; and some smaller faults mended."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.functions.similarity import corrected
from loomwright.operators import clustering as C
from loomwright.operators import dml
from loomwright.operators import vocabulary as V


def neighbours(w, letters):
    cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return {w} | {a + b[1:] for a, b in cut if b} | {a + b[1] + b[0] + b[2:] for a, b in cut if len(b) > 1} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=5), st.text("abc", max_size=5))
def test_edits(a, b):
    seen, far = {a}, 0
    while b not in seen:
        seen, far = {y for x in seen for y in neighbours(x, "abc") if len(y) <= 6}, far + 1
    assert V.edits(a, b) == far


def test_corrections_equal_plain_python(spark):
    rnd = random.Random(2)
    known = {"".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 8))): rnd.randint(5, 9) for _ in range(80)}
    words = [*known, "x", "zzzzzzzzzzzz", "y" * 50_000, "", None]
    for w in known:
        for _ in range(3):
            x = w
            for _ in range(rnd.randint(1, 3)):
                x = rnd.choice(sorted(neighbours(x, "abcdefg")))
            words.append(x)
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["word"]: r["corrected"] for r in V.corrections(df, spark.createDataFrame(list(known.items()), "word string, n long")).collect()}
    for w in {w for w in words if w}:
        if len(w) < 30:
            assert got.get(w, w) == corrected(w, known), w
    assert not set(got) & set(known) and "y" * 50_000 not in got


def test_texts_are_spelt_as_the_corpus(spark):
    rows = [(i, "green dress green dress sumer") for i in range(5)] + [(9, "gren drses sumer qqqqqqq"), (10, ""), (11, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    words = F.split("t", " ")
    known = V.unigrams(df, words).where("n >= 5")
    assert {tuple(r) for r in known.collect()} == {("green", 10), ("dress", 10), ("sumer", 6)}
    got = {r["id"]: (r["corrected"], r["n_corrected"]) for r in V.corrected_texts(df, "id", words, known).collect()}
    assert got[9] == ("green dress sumer qqqqqqq", 2) and got[10] == ("", 0) and len(got) == 8
    assert V.dictionary(known, 2) == {"dress": 10, "green": 10}
    assert Counter(dict.fromkeys(got, 1)).total() == 8


def test_a_key_of_null_is_created_once(spark):
    target = spark.createDataFrame([(1, "x")], "oid long, name string")
    rows = spark.createDataFrame([(1, "y"), (2, None), (3, "x"), (4, None)], "n int, name string")
    grown, named = dml.get_or_create(target, rows, ["name"], "oid")
    keys = {r["name"]: r["oid"] for r in grown.collect()}
    assert len(keys) == 3 and {(r["n"], r["name"], r["oid"]) for r in named.collect()} == {(n, name, keys[name]) for n, name in ((1, "y"), (2, None), (3, "x"), (4, None))}


def test_axes_that_hold_most(spark):
    def plain(e):
        found = []
        for n in range(2, len(e) + 1):
            q = np.percentile(e[:n], 70, method="nearest")
            found.append((sum(x for x in e[:n] if x >= q) / sum(e[:n]), n, sum(x >= q for x in e[:n])))
        return max(found)[2]

    rng = np.random.default_rng(1)
    for _ in range(20):
        e = np.sort(rng.exponential(1, 12))[::-1]
        assert C.axes_to_keep(e) == plain(e)
    assert C.axes_to_keep([1.0]) == 1 and C.axes_to_keep([0.9, 0.1]) == 1
    df = spark.createDataFrame([(i, "ab"[i % 2], "xyz"[i % 3], float(i)) for i in range(60)], "id long, p string, q string, n double")
    every = C.famd(df, "id", ["p", "q"], ["n"], 6).orderBy("id").collect()
    some = C.famd(df, "id", ["p", "q"], ["n"]).orderBy("id").collect()
    k = len(some[0]["coordinates"])
    assert 1 <= k < 6 and all(r["coordinates"] == pytest.approx(e["coordinates"][:k], abs=1e-9) for r, e in zip(some, every, strict=True))
