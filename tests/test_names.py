"""Names in texts against plain Python, and Birch over several calls."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import clustering as C
from loomwright.operators import names as N
from loomwright.operators import sweeps


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("empty", [False, True])
def test_names_equal_plain_python(spark, empty):
    rnd = random.Random(1)
    make = lambda n: "".join(rnd.choice("abé🙂 ") for _ in range(n))
    texts = [(i % 50, make(rnd.randint(0, 40))) for i in range(80)] + [(1, None), (2, "A" * 3000 + "abab ab")]
    names = [(make(rnd.choice([1, 2, 3, 5, 7, 8, 9, 12])), rnd.randint(0, 30)) for _ in range(60)] + [(None, 99), ("zz", 98)] + [("", 5)] * empty
    names += [(t[3:15], 40 + i) for i, (_, t) in enumerate(texts) if t and len(t) > 20 and i % 7 == 0]
    df, known = frame(spark, texts, "id int, t string"), frame(spark, names, "n string, o int")
    got = sorted((r["id"], r["t"], r["n"]) for r in N.last_containing(df, known, "t", "n", "o").collect())
    want = [(i, t, max((o, n) for n, o in names if n is not None and n in t)[1]) for i, t in texts if t is not None and any(n is not None and n in t for n, _ in names)]
    assert got == sorted(want)
    lower = lambda s: s.strip(" ").lower()
    got = sorted((r["id"], r["t"], r["o"], r["n"]) for r in N.first_prefix_match(df, known, "t", "n", "o").collect())
    want = []
    for i, t in texts:
        hits = [(o, n) for n, o in names if n is not None and lower(n) and t is not None and lower(t).startswith(lower(n))]
        want += [(i, t, *min(hits))] if hits else []
    assert got == sorted(want)


def test_many_names_are_not_broadcast(spark):
    known = spark.range(100_000).select(F.concat(F.lit("name of "), F.format_string("%06d", "id")).alias("n"), F.col("id").alias("o"))
    df = spark.range(200).select("id", F.concat(F.lit("the name of "), F.format_string("%06d", F.col("id") * 7), F.lit(" here")).alias("t"))
    out = N.last_containing(df, known, "t", "n", "o")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Cross" not in plan
    assert {(r["id"], r["n"]) for r in out.where("id < 3").collect()} == {(i, f"name of {i * 7:06d}") for i in range(3)}
    none = spark.createDataFrame([], "n string, o long")
    assert N.last_containing(df, none, "t", "n", "o").count() == 0 and N.first_prefix_match(df, none, "t", "n", "o").count() == 0


def test_two_calls_of_birch_equal_one(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.2, (60, 2)) for c in ([0, 0], [6, 0], [0, 7])])
    order = rng.permutation(len(x))
    df = frame(spark, [(int(i), x[i].tolist()) for i in order], "id long, x array<double>")
    one = {r["id"]: r["label"] for r in C.select_and_label(df, "id", "x", "birch", range(2, 7)).collect()}
    first, known = C.birch_session(df.where("id % 2 = 0"), "id", "x", range(2, 7))
    second, both = C.birch_session(df.where("id % 2 = 1"), "id", "x", range(2, 7), known)
    labels = {r["id"]: r["label"] for r in second.collect()}
    same = lambda d, i, j: d[i] == d[j]
    assert all(same(labels, i, j) == same(one, i, j) for i in labels for j in labels)
    assert both.agg(F.sum("n")).first()[0] == len(x)  # rows of both calls, none read again
    total = np.sum([np.array(r["ls"]) for r in both.collect()], 0)
    assert total == pytest.approx(x.sum(0)) and both.agg(F.sum("ss")).first()[0] == pytest.approx((x * x).sum())
    t = both.first()["threshold"]
    for r in both.collect():
        n, ls = r["n"], np.array(r["ls"])
        assert r["ss"] / n - (ls @ ls) / n**2 <= t * t + 1e-9
    assert sweeps.Birch.features(df.where("id < 0"), "x", known).agg(F.sum("n")).first()[0] == known.agg(F.sum("n")).first()[0]
    assert first.count() == 90
