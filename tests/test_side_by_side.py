"""Texts that are split side by side, against one by one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import similarity as S


@pytest.mark.parametrize("letters", ["ab", "abcde", "aé一\U0001d49c"])
def test_texts_side_by_side_are_split_as_one_by_one(monkeypatch, letters):
    rnd = random.Random(4)
    word = lambda most: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, most)))
    for cells in (1 << 20, 600):
        monkeypatch.setattr(S, "CELLS", cells)
        counts = {word(7): rnd.choice([1, 1, 2, 8, 30]) for _ in range(rnd.randint(1, 40))}
        total, longest = sum(counts.values()) + rnd.randint(0, 3), rnd.choice([3, 9, 24])
        texts = [word(60) for _ in range(120)] + ["", "zzz" + word(5), "z" * 70]
        one, many = S.word_splitter(counts, total, longest), S.texts_splitter(counts, total, longest)
        assert many(texts) == [one(t) for t in texts]
    assert many([]) == [] and many(["", ""]) == [[], []]


def test_the_cost_of_a_letter_does_not_go_through_python(monkeypatch):
    """No text of a large batch goes through the splitter that takes a letter at a time."""
    asked = []
    monkeypatch.setattr(S, "word_splitter", lambda *a: lambda t: asked.append(t))
    many = S.texts_splitter({"ab": 3, "c": 2}, 5, 24)
    assert many(["abc"] * 50 + ["cab"] * 50) == [["ab", "c"]] * 50 + [["c", "ab"]] * 50 and not asked


def test_prefixes_find_all_nodes():
    p = S.Prefixes({w: 1.0 for w in ("a", "ab", "abc", "b", "bca")})
    node = np.zeros(3, np.int32)
    for letters in ("abx", "bca", "cax"):
        node = p.after(node, np.array([ord(c) for c in letters]))
        if letters == "abx":
            assert (node > 0).tolist() == [True, True, False]
            node = node * (node > 0)
    assert p.cost[node].tolist() == [1.0, 1.0, np.inf]


def test_segment_leaves_nulls_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Red_dress reddress\nx-1")], "id int, t string")
    got = {r["id"]: r["s"] for r in df.select("id", S.segment(F.col("t"), {"red": 5, "dress": 4}).alias("s")).collect()}
    assert got == {1: "", 2: "", 3: "red dress red dress x 1"}
