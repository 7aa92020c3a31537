"""Codes of vectors against brute force in Python integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, `_id` int, v int"


def brute(rows, rounds=V.ROUNDS):
    """(id, code, error, error of the label) of the rows kept, and the digest of the codebooks."""
    good = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(v) for _, v, _ in good]
    d = max(set(sizes), key=lambda s: (sizes.count(s), s), default=0)
    kept = [(i, [math.floor(Fraction(x) * 4096) for x in v], lab) for i, v, lab in good if len(v) == d]
    first = {}
    for i, v, _ in sorted((k for k in kept if k[0] is not None), key=lambda k: (k[0], k[1])):
        first.setdefault(i, v)
    if not first:
        return [], None
    start = [first[i] for i in sorted(first)[:16]]
    cut = [(p * d // 8, (p + 1) * d // 8) for p in range(8)]
    books = [[v[a:b] for v in start] for a, b in cut]
    near = lambda v, book: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            of = [near(v[a:b], books[p])[1] for _, v, _ in kept]
            for j in set(of):
                mine = [v[a:b] for (_, v, _), o in zip(kept, of, strict=True) if o == j]
                books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for i, v, lab in kept:
        best = [near(v[a:b], books[p]) for p, (a, b) in enumerate(cut)]
        out.append((i, "".join(f"{j:02x}" for _, j in best), sum(e for e, _ in best), lab))
    label = {}
    for _, _, e, lab in out:
        label[lab] = label.get(lab, 0) + e
    most = 2**63 - 1
    text = ",".join(str(x) for b in books for c in b for x in c)
    return sorted(((i, c, min(e, most), min(label[lab], most)) for i, c, e, lab in out), key=str), hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows):
    df = spark.createDataFrame([(i, v, lab, "mine", "mine", 1, 2) for i, v, lab in rows], SCHEMA)
    got = V.compress(df)[0].collect()
    want, digest = brute(rows)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str) == want
    assert {r["codebooks_sha256"] for r in got} <= {digest}


def vectors(n, d, rnd, scale=0.2):
    return [[float(np.float32(x)) for x in rnd.normal(0, scale, d)] for _ in range(n)]


def test_against_brute_force(spark):
    rnd = np.random.default_rng(1)
    v = vectors(150, 16, rnd)
    rows = [(i, x, None if i % 7 == 0 else i % 3) for i, x in enumerate(v)]
    rows += [(1000 + i, v[3], 1) for i in range(60)]  # a common vector
    rows += [(None, v[5], 2), (2, v[9], 2), (2, v[9], 2), (3, None, 1), (4, [], 1), (5, [1.0, None] * 8, 1), (6, [float("nan")] * 16, 0), (7, [float("inf")] + [0.0] * 15, 0), (8, [0.5] * 8, 1)]
    check(spark, rows)


def test_fewer_ids_than_entries_and_uneven_parts(spark):
    rnd = np.random.default_rng(2)
    check(spark, [(i, x, 0) for i, x in enumerate(vectors(5, 8, rnd))])
    check(spark, [(i, x, 0) for i, x in enumerate(vectors(30, 11, rnd))])
    check(spark, [(i, x, 0) for i, x in enumerate(vectors(30, 3, rnd))])
    check(spark, [(None, x, 0) for x in vectors(3, 8, rnd)])
    check(spark, [])


def test_numbers_of_any_size(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, x, i % 2) for i, x in enumerate(vectors(40, 8, rnd, 300.0))]
    rows += [(50 + i, x, 1) for i, x in enumerate(vectors(20, 8, rnd, 1e30))] + [(99, [3.4028234663852886e38] * 8, 1)]
    check(spark, rows)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 5), st.integers(1, 20), st.data())
def test_nearest(d, n, data):
    small = st.integers(-4, 4)  # many ties
    row = st.lists(small, min_size=d, max_size=d)
    x = np.array(data.draw(st.lists(row, min_size=n, max_size=n)), np.int64).reshape(n, d)
    k = data.draw(st.integers(1, 16))
    book = np.array(data.draw(st.lists(row, min_size=k, max_size=k)), np.int64).reshape(k, d)
    want = ((x[:, None] - book) ** 2).sum(2)
    for kind in (np.int64, object):
        code, dist = V.nearest(x.astype(kind), book.astype(kind))
        assert code.tolist() == want.argmin(1).tolist() and dist.tolist() == want.min(1).tolist()


def test_decoding(spark):
    rnd = np.random.default_rng(4)
    df = spark.createDataFrame([(i, x, 0, "", "", 1, 2) for i, x in enumerate(vectors(200, 16, rnd))], SCHEMA)
    rows = V.kept(df)
    books = V.fit(rows)
    got = V.decode(V.encode(rows, books), books).collect()
    assert len(got) == 200
    for r in got:
        off = sum((math.floor(x * 4096) - (y * 4096 - 0.5)) ** 2 for x, y in zip(r["embedding"], r["approximation"], strict=True))
        assert off == pytest.approx(int(r["error"]), rel=1e-6)
