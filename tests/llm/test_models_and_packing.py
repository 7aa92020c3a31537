"""Language models, toxicity, near-dedup, packing, WARC and the pipeline against brute force."""

import base64
import gzip
import hashlib
import itertools
import math
import os
import random
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.llm import components, elias_fano, minhash, ngram, packing, tokens, toxicity, warc
from loomwright.llm.common import stored
from loomwright.llm.queries import QUERIES, oracle
from tests.llm.conftest import as_frame, odd_rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=200), st.lists(st.integers(0, 2**40), max_size=30))
def test_elias_fano(values, others):
    v = np.sort(np.array(values, np.int64))
    e = elias_fano.EliasFano.of(v)
    assert (e.get(np.arange(len(v))) == v).all()
    if len(v) > 1:
        one, two = e.get_two(np.arange(len(v) - 1))
        assert (one == v[:-1]).all() and (two == v[1:]).all()
    ask = np.array(values + others, np.int64)
    at = e.find(ask)
    assert all((i >= 0) == (x in set(values)) and (i < 0 or v[i] == x) for i, x in zip(at.tolist(), ask.tolist(), strict=True))
    assert (elias_fano.unpack(elias_fano.pack(v)) == v).all()


def test_files_are_mapped_whole(tmp_path):
    e = elias_fano.EliasFano.of(np.arange(0, 900, 7))
    path = f"file://{tmp_path}/a/b.ef"
    for _ in range(2):  # an attempt that repeats
        elias_fano.write_arrays(path, {f"x.{k}": a for k, a in e.arrays().items()})
    got = elias_fano.EliasFano.read(elias_fano.read_arrays(path), "x")
    assert (got.get(np.arange(e.n)) == np.arange(0, 900, 7)).all()


def test_words_are_runs_of_other_bytes():
    texts = [t for _, t in odd_rows()]
    w = tokens.words(texts)
    want = [(t or "").encode().lower().split() for t in texts]
    assert w.counts.tolist() == [len(x) for x in want]
    flat = [x for t in want for x in t]
    assert len(set(zip(flat, w.hashes.tolist(), strict=True))) == len(set(flat)) == len(set(w.hashes.tolist()))


def model_rows():
    rnd = random.Random(3)
    vocabulary = [f"v{k}" for k in range(40)]
    return [(i, " ".join(rnd.choices(vocabulary, [1 / (k + 1) for k in range(40)], k=rnd.randint(0, 60)))) for i in range(150)] + odd_rows()


def brute_scores(rows, order=3):
    train = [(t or "").encode().lower().split() + [None] for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    c = [Counter() for _ in range(order)]
    for t in train:
        s = [0, *t]
        for n in range(order):
            c[n].update(tuple(s[k - n : k + 1]) for k in range(max(1, n), len(s)))
    context = Counter({(0,): len(train)}) + c[0]
    total, size = sum(c[0].values()), len(c[0])
    used = [defaultdict(float) for _ in range(order)]
    for n in range(1, order):
        for k, v in c[n].items():
            used[n][k[:-1]] += v - ngram.DISCOUNT

    def p(history, w):
        if not history:
            return (c[0][(w,)] + 0.5) / (total + 0.5 * (size + 1))
        n, shorter = len(history), p(history[1:], w)
        have = context[history] if n == 1 else c[n - 1][history]
        return shorter if not have else max(c[n][(*history, w)] - ngram.DISCOUNT, 0) / have + (1 - used[n][history] / have) * shorter

    out = []
    for i, t in rows:
        s = [0, *(t or "").encode().lower().split(), None]
        score = sum(math.log10(p(tuple(s[max(0, k - order + 1) : k]), s[k])) for k in range(1, len(s)))
        out.append((i, len(s) - 1, sum(c[0][(w,)] > 0 for w in s[1:]), total, sum(math.log10(p((), w)) for w in s[1:]), score))
    return out


def test_ngram_scores(spark, no_docs):
    rows = model_rows()
    df = as_frame(spark, rows)
    model = ngram.train_model(df.where(~ngram.held_out()).select("text"))
    got = ngram.score(df, model).collect()
    want = brute_scores(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], round(r[4], 6))
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4]) and g[5] == pytest.approx(w[5], rel=0.05, abs=0.1)
    empty = ngram.train_model(no_docs.select("text"))
    assert (empty.tokens, empty.vocabulary) == (0, 0)
    assert all(r["base_score"] == 0 and r["n_known"] == 0 for r in ngram.score(df, empty).collect())
    assert ngram.score(no_docs, model).count() == 0


def test_files_that_cannot_be_mapped_are_read(tmp_path, monkeypatch):
    e = elias_fano.EliasFano.of(np.arange(0, 900, 7))
    path = f"file://{tmp_path}/x.ef"
    elias_fano.write_arrays(path, {f"x.{k}": a for k, a in e.arrays().items()})
    monkeypatch.setattr(elias_fano, "_plain", lambda _: None)
    assert (elias_fano.sequence(path, "x").get(np.arange(e.n)) == np.arange(0, 900, 7)).all()


def test_packed_integers():
    for v in ([], [0], [5, 5, 7, 2**40], [9, 3, 2**63], list(range(0, 3000, 3))):
        assert elias_fano.unpack(elias_fano.pack(np.array(v, np.uint64))).tolist() == v


def test_found_where_values_crowd():
    rnd = np.random.default_rng(3)
    v = np.unique(np.concatenate([rnd.integers(0, 10**9, 500), 4 * 10**8 + np.arange(0, 3000, 2), rnd.integers(10**6, 10**6 + 4000, 900)]))
    e = elias_fano.EliasFano.of(v)
    asked = np.concatenate([v, v + 1, v - 1, [0, 2 * 10**9]])
    want = {int(x): k for k, x in enumerate(v)}
    assert e.find(asked).tolist() == [want.get(int(x), -1) for x in asked]
    lo, hi = np.full(len(asked), 100), np.full(len(asked), 1500)
    got = e.find(asked, lo, hi, np.full(len(asked), v[100]), np.full(len(asked), v[1499] + 1))
    assert got.tolist() == [k if 100 <= (k := want.get(int(x), -1)) < 1500 else -1 for x in asked]


def test_contexts_may_run_over_files(spark):
    rows = [(i, " ".join(f"the x{(i + k) % 90}" for k in range(30))) for i in range(120)]
    df = as_frame(spark, rows)
    model = ngram.train_model(df.where(~ngram.held_out()).select("text"))
    assert len(model.levels[1].split) > 1
    want = {r[0]: r[5] for r in brute_scores(rows)}
    for r in ngram.score(df, model).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=0.05)


def toxic_rows(n=500):
    rnd = random.Random(4)
    plain, bad = [f"word{k}" for k in range(300)], ["idiot", "scum", "nastyone", "nastytwo", "nastythree"]
    rows, labels = [], []
    for i in range(n):
        kind = i % 5
        w = rnd.choices(plain, k=rnd.randint(30, 80))
        if kind == 0:
            for _ in range(6):
                w[rnd.randrange(len(w))] = rnd.choice(bad)
        if kind == 1:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, int(kind != 1), int(kind == 0)))
    return rows, labels


def test_toxicity_learns_and_leaves_clean_texts(spark, sf_dir, docs, no_docs):
    rows, labels = toxic_rows()
    d = sf_dir(rows, [*labels, (1, None, None), (None, 1, 1)])
    got = {r["doc_id"]: r for r in QUERIES["op5_classifier_chain_toxicity"](spark, d).collect()}
    assert len(got) == len(rows)
    held = [i for i, _ in rows if not i % 3]
    assert np.mean([got[i]["is_toxic"] == (i % 5 == 0) for i in held]) > 0.97
    assert np.mean([got[i]["is_junk"] == (i % 5 == 1) for i in held]) > 0.97
    chain = toxicity.toxicity_chain(as_frame(spark, rows), toxicity.table_labels(spark, d), ["junk", "toxic"])
    out = toxicity.score(docs, chain)
    assert out.count() == len(odd_rows()) and not out.where("doc_id IN (4, 5) AND (is_toxic OR is_junk)").count()
    assert toxicity.score(no_docs, chain).count() == 0
    none = toxicity.toxicity_chain(docs, toxicity.table_labels(spark, d).limit(0), ["junk", "toxic"])
    assert not toxicity.score(docs, none).where("is_toxic").count()


def plain_fit(rows, before, y, weight):
    """Logistic regression by full-batch AdaGrad, feature by feature. rows: {feature: value}."""
    total = weight.sum()
    share = (weight * y).sum() / total
    w, e, b = defaultdict(float), np.zeros(before.shape[1]), math.log(share / (1 - share))
    g_w, g_e, g_b = defaultdict(lambda: 1e-8), np.full(before.shape[1], 1e-8), 1e-8
    for _ in range(toxicity.ROUNDS):
        d_w, d_e, d_b = {f: toxicity.DECAY * x for f, x in w.items()}, toxicity.DECAY * e, 0.0
        for x, z, t, u in zip(rows, before / 10, y, weight, strict=True):
            s = sum(w[f] * v for f, v in x.items()) + b + z @ e
            err = u * (1 / (1 + math.exp(-max(-30, min(30, s)))) - t) / total
            for f, v in x.items():
                d_w[f] = d_w.get(f, 0.0) + v * err
            d_e, d_b = d_e + z * err, d_b + err
        for f, d in d_w.items():
            g_w[f] += d * d
            w[f] -= toxicity.RATE * d / math.sqrt(g_w[f])
        g_e, g_b = g_e + d_e * d_e, g_b + d_b * d_b
        e, b = e - 0.2 * toxicity.RATE * d_e / np.sqrt(g_e), b - 0.2 * toxicity.RATE * d_b / math.sqrt(g_b)
    return lambda x, z: sum(w[f] * v for f, v in x.items()) + b + z @ e / 10


def test_chain_is_what_plain_loops_give(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "ENTRIES_AT_ONCE", 40)
    rnd = random.Random(3)
    bad, plain = ["scum", "idiot"], [f"w{k}" for k in range(12)]
    data = []
    for i in range(36):
        toxic, junk = i % 3 == 0, i % 4 == 0
        data.append((f"id{i:02d}", " ".join(rnd.choices(plain, k=6) + rnd.choices(bad, k=2 * toxic) + ["###"] * (2 * junk)), junk, toxic, 1.0 + i % 2))
    data[7] = (*data[7][:1], data[5][1], *data[7][2:])  # equal texts share a fold
    chain, oof = toxicity.fit_chain(spark.createDataFrame(data, "id string, text string, junk boolean, toxic boolean, weight double"), ["junk", "toxic"])
    x = toxicity.features([t for _, t, *_ in data])
    seen = Counter(x.col.tolist())
    rows = [{c: float(v) for c, v in zip(x.col[x.row == i].tolist(), x.value[x.row == i].tolist(), strict=True) if seen[c] > 1} for i in range(len(data))]
    fold = np.array([zlib.crc32(t.encode()) % toxicity.FOLDS for _, t, *_ in data])
    weight, before = np.array([r[4] for r in data]), np.zeros((len(data), 0))
    for c in range(2):
        y, out = np.array([float(r[2 + c]) for r in data]), np.zeros(len(data))
        for k in range(toxicity.FOLDS):
            odds = plain_fit(rows, before, y, np.where(fold == k, 0.0, weight))
            out[fold == k] = [odds(rows[i], before[i]) for i in np.flatnonzero(fold == k)]
        assert oof[:, c] == pytest.approx(out, rel=1e-3, abs=1e-3)
        whole, model = plain_fit(rows, before, y, weight), chain.models[c]
        assert model.log_odds(x, before) == pytest.approx([whole(r, z) for r, z in zip(rows, before, strict=True)], rel=1e-3, abs=1e-3)
        best = max((2 * (weight * y)[out > cut].sum() / (weight[out > cut].sum() + (weight * y).sum()), cut) for cut in out - 1e-9)[0]
        got = out > model.cut
        assert 2 * (weight * y)[got].sum() / (weight[got].sum() + (weight * y).sum()) == pytest.approx(best)
        before = np.column_stack([before, out])


def test_sample_is_bounded(spark):
    rows = [(f"x{i % 40}", f"text {i}") for i in range(400)] + [(None, "n")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"x{i}", i % 2 == 0, i % 4 == 0) for i in range(50)] * 2, "doc_id string, junk boolean, toxic boolean")
    got = toxicity.sample(docs, labels, ["junk", "toxic"], 5).collect()
    assert len({r["id"] for r in got}) == len(got) and max(Counter((r["junk"], r["toxic"]) for r in got).values()) <= 5
    assert all(r["weight"] == pytest.approx({(False, False): 25, (True, False): 12, (True, True): 13}[r["junk"], r["toxic"]] / 5) for r in got)


def brute_components(rows, k, threshold=80):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if a and b and 100 * len(a & b) >= threshold * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in rows}


def families():
    rnd = random.Random(8)
    rows, at = [], 0
    for _ in range(25):
        base = [f"t{rnd.randrange(5000)}" for _ in range(rnd.choice([3, 20, 60, 120]))]
        for _ in range(rnd.choice([1, 1, 2, 5, 30])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 4])):
                w[rnd.randrange(len(w))] = f"t{rnd.randrange(5000)}"
            rows.append((at, " ".join(w)))
            at += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "k"), [(128, 4), (5, 4), (5, 5)])
def test_near_duplicates(spark, monkeypatch, block, k):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = families()
    got = minhash.near_duplicates(as_frame(spark, rows), k=k).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, k)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_rows(spark, docs, no_docs):
    got = minhash.near_duplicates(docs, k=4).collect()
    assert len(got) == len(odd_rows())
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute_components(odd_rows(), 4)
    assert sorted(r["n_shingles"] for r in got if r["doc_id"] is None) == sorted([0, next(r["n_shingles"] for r in got if r["doc_id"] == 1)])
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert minhash.near_duplicates(no_docs, k=4).count() == 0


def test_linked_counts_whole_sets(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 3)
    rnd = np.random.default_rng(0)
    sets = [np.unique(rnd.integers(0, 30, n)).astype(np.uint64) for n in (1, 5, 20, 20, 25, 40, 40)]
    got = minhash.linked(sets, 50)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (100 * both >= 50 * (len(a) + len(b) - both))


@pytest.mark.parametrize("share", [1000, 8, 1])
def test_components(spark, monkeypatch, share):
    monkeypatch.setattr(components, "HOT_SHARE", share)
    rnd = random.Random(6)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    parent = {}
    for a, b in links:
        x, y = parent.setdefault(a, {a}), parent.setdefault(b, {b})
        if x is not y:
            x |= y
            for n in y:
                parent[n] = x
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: min(s) for n, s in parent.items() if len(s) > 1}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def best_packing(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.integers(5, 30), st.data())
def test_reduction_keeps_an_optimum(capacity, data):
    items = data.draw(st.lists(st.integers(1, capacity), max_size=9))
    counts = Counter(items)
    fixed, rest = packing.reduce_instance(dict(counts), capacity)
    left = sorted((s for s, c in rest.items() for _ in range(c)), reverse=True)
    best = best_packing(sorted(items, reverse=True), capacity)
    assert sum(t for t, _ in fixed) + best_packing(left, capacity) == best
    groups = packing.plan(dict(counts), capacity)
    held = Counter()
    for times, inside in groups:
        assert times > 0 and sum(s * q for s, q in inside) <= capacity
        for s, q in inside:
            held[s] += times * q
    assert held == counts


def plain_best_fit(items, capacity):
    bins = []
    for s in sorted(items, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= s]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_groups_are_best_fit(items):
    groups = packing.best_fit(dict(Counter(items)), 20)
    assert sorted(20 - sum(s * q for s, q in inside) for times, inside in groups for _ in range(times)) == plain_best_fit(items, 20)


def check_places(rows, want, capacity):
    """rows: the packed pieces; want: (id, ids) of each document."""
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter(
        (i, p, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for i, ids in want for p, (s, n) in enumerate(packing.cuts(len(ids), capacity))
    )
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def library_ids(rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.default_path())
    return [(i, [*lib.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]


def test_packing(spark, docs, no_docs):
    for capacity in (64, 2048):
        want = library_ids(odd_rows())
        n = check_places(packing.pack_documents(docs, capacity=capacity).collect(), want, capacity)
        assert n <= math.ceil(1.25 * sum(len(ids) for _, ids in want) / capacity) + 1
    assert packing.pack_documents(no_docs).count() == 0
    assert packing.cuts(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cuts(2048, 2048) == [(0, 2048)]


@pytest.mark.parametrize("run", [packing.LONG_RUN, 7])
def test_long_runs_use_the_tree(monkeypatch, run):
    monkeypatch.setattr(packing, "LONG_RUN", run)
    own = packing.FastEncoder(packing.default_path())
    for n in (run - 1, run, run + 1):
        text = "a" * n + " " * n + "b<|endoftext|>"
        assert own.ids(text).tolist() == library_ids([(1, text)])[0][1][:-1]


def test_groups_of_pieces_are_ranked_as_one(spark):
    rows = [(i, "word " * (i % 7 + 1)) for i in range(300)] + [(1000, "long " * 400)]
    cut = stored(packing.pieces(as_frame(spark, rows), capacity=64), "cut")
    want = library_ids(rows)
    lengths = Counter(n for _, ids in want for _, n in packing.cuts(len(ids), 64))
    assert check_places(packing.pack(cut, 64).collect(), want, 64) == sum(t for t, _ in packing.plan(dict(lengths), 64))


def test_texts_of_a_megabyte(spark, sf_dir):
    rnd = random.Random(12)
    words = [f"w{rnd.randrange(40000)}" for _ in range(200_000)]
    long = " ".join(words)
    other = " ".join(words[:100_000] + ["changed"] + words[100_001:])
    rows = [(1, long), (2, other), (3, long), (4, "\n".join(words)), (5, "x" * 1_200_000), (6, "short one")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(1, 7)]
    d = sf_dir(rows, [(i, q, int(t)) for i, q, t in labels], [(1, "u", "<p>" + "<br>x" * 300_000)])
    got = {name.split("_")[0]: {r[0]: r for r in query(spark, d).collect()} for name, query in QUERIES.items() if name.split("_")[0] not in ("op8", "op9")}
    ids = dict(library_ids(rows))
    for i, t in rows:
        assert got["op1"][i]["n_tokens"] == len(t.split()) + 1
        assert got["op2"][i]["keep_id"] == (3 if i == 1 else i)
        assert got["op3"][i]["n_tokens"] == len(ids[i]) - 1 and got["op3"][i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert got["op7"][i]["n_chars"] == len(t)
        assert got["op10"][i]["component_id"] == (1 if i < 5 else i)  # lines or words, the shingles are the same
        assert got["op13"][i]["n_email"] == 0 and got["op13"][i]["spans"] == ""
    assert got["op6"][3]["n_gone"] == got["op6"][2]["n_gone"] == 1 and got["op6"][4]["n_gone"] == 200_000 - len(set(words))
    check_places(QUERIES["op9_martello_toth_best_fit_packing"](spark, d).collect(), list(ids.items()), 2048)
    assert {len(r["block"]) for r in QUERIES["op8_warc_derivatives"](spark, d).where("record_type = 'conversion'").collect()} == {2 * 300_000 - 1}


PAGES = [
    (1, "http://a.example/x", "<html><head><title>T &amp; U</title><style>p{}</style></head><body><p>One<br>two</p><script>var a='</p>'</script><!-- no --><div>th&#233;</div></body></html>"),
    (2, "http://b.example", None),
    (3, None, ""),
    (None, "http://c.example", "plain < text"),
    (1, "http://a.example/x", "<p>again</p>"),
]


def test_warc(spark, sf_dir):
    d = sf_dir([], pages=PAGES)
    pages = spark.read.parquet(f"{d}/pages.parquet").withColumn("record_id", F.lit("clash"))
    responses = warc.responses(pages)
    source = {r["record_id"]: r for r in responses.collect()}
    got = warc.derive(responses).collect()
    assert len(source) == len(PAGES) and len(got) == 2 * len(PAGES)
    for r in got:
        s = source[r["refers_to"]]
        assert r["target_uri"] == s["target_uri"] and r["date"] == s["date"]
        assert r["headers"]["WARC-Refers-To"] == s["record_id"]
        assert r["headers"]["WARC-Source-Payload-Digest"] == s["headers"]["WARC-Payload-Digest"]
        data = r["block"].encode()
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode() and int(r["headers"]["Content-Length"]) == len(data)
    meta = {r["refers_to"]: r["block"] for r in got if r["record_type"] == "metadata"}
    text = {source[r["refers_to"]]["page_id"]: r["block"] for r in got if r["record_type"] == "conversion" and "again" not in r["block"]}
    assert text[1] == "T & U\nOne\ntwo\nthé" and text[2] == text[3] == "" and text[None] == "plain < text"
    for r in got:
        if r["record_type"] == "conversion":
            assert f"conversion-record-id: {r['record_id']}" in meta[r["refers_to"]]
            assert "source-http-content-type: text/html; charset=utf-8" in meta[r["refers_to"]]
    again = {(r["record_id"], r["block_digest"]) for r in warc.derive(warc.responses(pages)).collect()}
    assert again == {(r["record_id"], r["block_digest"]) for r in got}
    for r in warc.as_warc(responses).collect():
        head, _, rest = bytes(r["warc"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and rest == r["block"].encode() + b"\r\n\r\n"
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0
    assert QUERIES["op8_warc_derivatives"](spark, d).count() == 2 * len(PAGES)


class PlainText(HTMLParser):
    """The text of a page as the standard library's parser sees it."""

    ENDS = {"address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
    HIDDEN = {"script", "style", "noscript", "template", "svg"}

    def __init__(self):
        super().__init__()
        self.title, self.body, self.inside, self.hidden = "", "", False, 0

    def handle_starttag(self, tag, attrs):
        self.body += " " if tag in self.HIDDEN else ""
        self.hidden += tag in self.HIDDEN
        self.inside |= tag == "title"
        self.body += "\n" if tag in self.ENDS and not self.hidden else ""

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN
        self.inside &= tag != "title"
        self.body += "\n" if tag in self.ENDS and not self.hidden else ""

    def handle_comment(self, data):
        self.body += " "

    def handle_data(self, data):
        if self.inside:
            self.title += data
        elif not self.hidden:
            self.body += data


def squeezed(text):
    return [" ".join(x.split()) for x in text.split("\n") if x.split()]


def random_page(rnd):
    word = lambda: rnd.choice(["ab", "c &amp; d", "é", "1 &lt; 2", "x&#233;", "  y  "])

    def block(depth):
        kind = rnd.choice(["p", "div", "ul", "b", "i", "a", "comment", "script", "style", "svg", "template", "noscript", "text", "br"])
        inner = "".join(block(depth - 1) for _ in range(rnd.randint(0, 3))) if depth else word()
        attrs = rnd.choice(["", ' class="a>b"', " id='<x>'", " hidden"])
        if kind == "comment":
            return f"<!-- {word()} <p> -->"
        if kind in ("script", "style"):
            return f"<{kind}{attrs}>var a = '<p>x</p>';</{kind}>"
        if kind in ("svg", "template", "noscript"):
            return f"<{kind}{attrs}><p>{word()}</p></{kind}>"
        return {"text": word(), "br": "<br>"}.get(kind) or f"<{kind}{attrs}>{inner}</{kind}>"

    head = rnd.choice(["<head><meta charset='u'><title>T &amp; U</title></head>", "<head><title>T</title>", ""])
    return f"<!DOCTYPE html><html>{head}<body>{''.join(block(3) for _ in range(5))}</body></html>"


def test_plain_text_is_what_a_parser_sees():
    rnd = random.Random(7)
    pages = [random_page(rnd) for _ in range(300)]
    sample = "/root/testdata/sf0.001/pages.parquet"
    if os.path.exists(sample):
        pages += pd.read_parquet(sample)["html"].dropna().tolist()
    for page in pages:
        want = PlainText()
        want.feed(page)
        want.close()
        assert squeezed(warc.plain_text(page)) == squeezed(want.title) + squeezed(want.body), page


def test_pages_without_ends_keep_their_text():
    assert warc.plain_text("<head><title>T</title><body><p>All of the body</p>") == "T\nAll of the body"
    assert warc.plain_text("<p>a<template><p>b<svg><p>c<noscript>d") == "a\nb\nc\nd".replace("c\nd", "cd")
    assert warc.plain_text("<title>no end <p>text") == "no end\ntext"
    for piece in ("<!--", "<script", "<script>", "<svg>", "<template>", "<title>", "<title", "<p ", "<a href='", '<a "', "<head>", "</svg><svg>", "<", "<!-"):
        began = time.perf_counter()
        warc.plain_text(piece * 40000)
        assert time.perf_counter() - began < 3, piece


def test_warc_files_are_read(spark, sf_dir, tmp_path):
    d = sf_dir([], pages=PAGES)
    made = warc.responses(spark.read.parquet(f"{d}/pages.parquet"))
    rows = made.collect()
    whole = b"".join(warc.serialise(r.asDict() | {"headers": r["headers"]}) for r in rows)
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.serialise(r.asDict())) for r in rows))
    (tmp_path / "c.warc").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "d.warc").write_bytes(b"")
    paths = [str(tmp_path / f) for f in ("a.warc", "b.warc.gz", "c.warc", "d.warc")]
    got = warc.read_warc(spark, paths)
    fields = ["record_type", "record_id", "refers_to", "target_uri", "date", "headers", "block", "block_digest"]
    by = defaultdict(list)
    for r in got.orderBy("source", "at").collect():
        by[r["source"]].append(tuple(r[f] for f in fields))
    want = [tuple(r[f] for f in fields) for r in rows]
    assert by[paths[0]] == by[paths[1]] == want and by[paths[2]] == want[: len(by[paths[2]])] and len(by[paths[2]]) < len(want) and paths[3] not in by
    derived = {(r["record_id"], r["block_digest"]) for r in warc.derive(got.where(F.col("source") == paths[1]), "source").collect()}
    assert derived == {(r["record_id"], r["block_digest"]) for r in warc.derive(made).collect()}


def test_queries_have_their_columns(spark, sf_dir):
    rows, labels = toxic_rows(60)
    d = sf_dir(rows + odd_rows(), labels, PAGES)
    need = {
        "op1": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op2": "doc_id keep_id group_size kept text_sha256",
        "op3": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op7": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op9": "doc_id piece start length ids_crc32 sequence_id offset",
        "op10": "doc_id n_shingles component_id kept",
        "op11": "vec_id code error label_error codebooks_sha256",
        "op12": "word form root n n_near form_n",
        "op13": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    }
    for name, query in QUERIES.items():
        out = query(spark, d)
        assert set(need.get(name.split("_")[0], "").split()) <= set(out.columns), name
        if name.split("_")[0] == "op11":
            assert out.count() == 40
        elif name.split("_")[0] not in ("op8", "op9", "op12"):
            assert out.count() == len(rows) + len(odd_rows()), name
    assert set(oracle()) <= set(QUERIES)
