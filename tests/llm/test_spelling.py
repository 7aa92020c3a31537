"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import spelling as S
from tests.llm.conftest import as_frame, odd_rows


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute(rows, length=6, count=5):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= length:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def check(spark, rows):
    got = [tuple(r) for r in S.variants(as_frame(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    return got


@pytest.mark.parametrize("plenty", [0, 5, 99])
def test_against_brute_force(spark, monkeypatch, plenty):
    monkeypatch.setattr(S, "PLENTY", plenty)
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(6, 9))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "abababab", "babababa"]
    words = []
    for w in base:
        words += [w] * rnd.choice([1, 30, 200])
        for _ in range(6):
            k = rnd.randrange(len(w))
            words += [rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abÀ÷") + w[k:], w[:k] + "b" + w[k + 1 :]])] * rnd.choice([1, 5, 6, 40])
    rnd.shuffle(words)
    rows = [(i, " ".join(w.upper() if rnd.random() < 0.2 else w for w in words[i * 50 : i * 50 + 50])) for i in range(-(-len(words) // 50))]
    got = check(spark, rows + rows[:3])
    assert sum(r[4] > 0 for r in got) > 20 and any(r[1] for r in got)


def test_chains_of_forms(spark):
    rows = [(1, " ".join(["abcdef"] * 5 + ["abcdeg"] * 40 + ["abcdhg"] * 300 + ["abcihg"] * 2000 + ["jbcihg"] * 15000))]
    root = {r[0]: r[2] for r in check(spark, rows)}
    assert root["abcdef"] == "jbcihg" or len(root) > 4  # a slip may change one word in this document


def test_odd_rows(spark):
    check(spark, odd_rows() * 6)
    check(spark, [(1, "x" * 100_000 + " " + "y" + "x" * 99_999)] * 6 + [(None, "Straßen straßen STRASSEN STRAßEN")] * 3 + [(2, None)])
    check(spark, [])
    with pytest.raises(ValueError):
        S.variants(as_frame(spark, []), length=3)


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=6, max_size=14), st.integers(0, 13), st.sampled_from(["drop", "add", "replace"]), st.sampled_from("abc"), st.permutations(range(9)))
def test_one_edit_leaves_a_rare_bigram_alone(word, at, kind, letter, order):
    k = at % len(word)
    other = {"drop": word[:k] + word[k + 1 :], "add": word[:k] + letter + word[k:], "replace": word[:k] + letter + word[k + 1 :]}[kind]
    if other == word or len(other) < 6:
        return
    rank = np.full(65536, 99)
    for r, (x, y) in zip(order, ((x, y) for x in "abc" for y in "abc"), strict=True):
        rank[ord(x) * 256 + ord(y)] = r
    ends = [{e for p in places for e in (("left", w[: p + 2]), ("right", w[p:]))} for w, places in zip((word, other), S.rarest([word, other], rank).tolist(), strict=True)]
    assert ends[0] & ends[1]


def test_a_word_of_a_third_of_all_rows_is_counted_before_the_exchange(spark):
    plan = S.vocabulary(as_frame(spark, odd_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Python" not in plan
