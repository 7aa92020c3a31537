"""How words meet by their remainders."""

import random

import pytest
from pyspark.sql import functions as F

from loomwright.operators import vocabulary as V


def test_remainders_are_not_broadcast(spark):
    known = spark.createDataFrame([("dress", 9), ("summer", 7)], "word string, n long")
    found = V.corrections(spark.createDataFrame([("dres",), ("sumer",)], "word string"), known)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("dres", "dress", 1), ("sumer", "summer", 1)}


def test_only_exchanged_letters_are_looked_at_in_python(spark, monkeypatch):
    """Pairs that Spark's own distance decides never reach edits(): here it may see the words with an exchange alone."""

    @F.pandas_udf("int")
    def strict(a, b):
        if any(sorted(x) != sorted(y) for x, y in zip(a, b, strict=True)):
            raise ValueError("a pair without exchanged letters")
        return a.map(lambda _: 1).astype("int32")

    monkeypatch.setattr(V, "_edits", strict)
    known = spark.createDataFrame([("dress", 9), ("summer", 7), ("winter", 5), ("sommer", 6)], "word string, n long")
    found = V.corrections(spark.createDataFrame([("dres",), ("drses",), ("sumer",), ("wntr",), ("wonders",)], "word string"), known)
    assert {tuple(r) for r in found.collect()} == {("dres", "dress", 1), ("drses", "dress", 1), ("sumer", "summer", 1), ("wntr", "winter", 2)}


@pytest.mark.parametrize("letters", ["ab", "abcd"])
def test_corrections_equal_a_look_at_all_pairs(spark, letters):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(160)})
    known = {w: rnd.randint(5, 8) for w in words[::4]}
    asked = [w for w in words if w not in known]
    want = {}
    for w in asked:
        m = min((V.edits(w, k), -n, k) for k, n in known.items())
        if m[0] <= 2:
            want[w] = (m[2], m[0])
    found = V.corrections(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame(list(known.items()), "word string, n long"))
    assert {r["word"]: (r["corrected"], r["distance"]) for r in found.collect()} == want
