"""Dedup, sharding, BPE, fingerprints and lines against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwright.llm import bpe, exact_dedup, line_dedup, sharding, winnowing
from loomwright.llm.common import salt
from tests.llm.conftest import as_frame, odd_rows


def test_exact_groups_of_a_growing_tree(spark, docs, monkeypatch):
    assert exact_dedup.fanout_for(0, 3) == exact_dedup.fanout_for(64 * exact_dedup.ROWS_A_LEAF, 3) == 4
    assert exact_dedup.fanout_for(64 * exact_dedup.ROWS_A_LEAF + 1, 3) == 5
    assert exact_dedup.fanout_for(10**10, 3) ** 3 * exact_dedup.ROWS_A_LEAF >= 10**10
    plain = sorted(map(str, exact_dedup.exact_groups(docs).collect()))
    monkeypatch.setattr(exact_dedup, "fanout_for", lambda rows, levels: 9 + 0 * rows)
    assert sorted(map(str, exact_dedup.exact_groups(docs).collect())) == plain
    assert sorted(map(str, exact_dedup.exact_groups(docs, fanout=2, levels=1).collect())) == plain


def test_exact_groups(spark, docs, no_docs):
    for keep in ("max", "min"):
        got = exact_dedup.exact_groups(docs, keep=keep).collect()
        assert len(got) == len(odd_rows())
        by = defaultdict(list)
        for i, t in odd_rows():
            by[t or ""].append(i)
        want = sorted((hashlib.sha256((t or "").encode()).digest(), i or 0, i is None, (max if keep == "max" else min)((x for x in by[t or ""] if x is not None), default=None), len(by[t or ""])) for i, t in odd_rows())
        assert sorted((bytes(r["digest"]), r["id"] or 0, r["id"] is None, r["keep_id"], r["group_size"]) for r in got) == want
        assert all(r["kept"] == (r["id"] == r["keep_id"]) for r in got)
    assert exact_dedup.exact_groups(no_docs).count() == 0


def test_every_round_merges_sorted_runs(spark, docs):
    rows = exact_dedup.digests(docs, "doc_id", "text").withColumn("leaf", salt(64, "id"))
    runs = exact_dedup.leaf_runs(rows, "max")
    before = runs._jdf.queryExecution().executedPlan().toString().count("HashAggregate")
    for _ in range(3):
        runs = exact_dedup.merge_round(runs, "max", 4)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [node") == plan.count("Window [") == 3 and plan.count("Aggregate") == before
    assert plan.count("Exchange hashpartitioning(") == 4  # the leaves' and one a round


def test_digests_that_collide_are_told_apart(spark):
    rows = [(i, f"text {i % 7}" + "x" * (i % 3)) for i in range(100)]
    got = {r["id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(as_frame(spark, rows), keep="min", digest_bytes=0).collect()}
    same = defaultdict(list)
    for i, t in rows:
        same[t].append(i)
    assert got == {i: (min(same[t]), len(same[t])) for i, t in rows}


def test_lookup_table_is_the_claiming_of_slots():
    names, size = sharding.shard_names(7), 101
    lists = []
    for n in names:
        offset, step = sharding.preference(n, size)
        lists.append([(offset + step * k) % size for k in range(size)])
    owner, turn = {}, 0
    while len(owner) < size:
        j = turn % len(names)
        owner[next(s for s in lists[j] if s not in owner)] = j
        turn += 1
    table = sharding.lookup_table(names, size)
    assert table.tolist() == [owner[s] for s in range(size)]
    assert np.bincount(table).max() - np.bincount(table).min() <= 1
    fewer = sharding.lookup_table(names[:-1], size)
    assert np.mean((table != fewer)[table != 6]) < 0.35  # most of what stays, stays put
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_placement(spark, docs, no_docs, tmp_path):
    got = sharding.place_rows(docs.withColumn("shard", F.lit("clash"))).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["shard"] < sharding.N_SHARDS for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] == 8}) == 1
    assert sharding.place_rows(no_docs).count() == 0
    sharding.write_shards(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(odd_rows())


def test_bpe_equals_the_library(spark, docs, no_docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    rnd = random.Random(2)
    letters = " \t\n\r\x0b\x1c\x85 　abcABC'stré½²中文🙂́.,!_09\x00"
    texts = [t or "" for _, t in odd_rows()] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(500)] + ["ab" * 700, " " * 900 + "x", "<|endoftext|>a<|endoftext|><|endoftext|> b"]
    own = bpe.Bpe(bpe.default_path())
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = own.encode([t])[0]
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
        assert own.decode(ids) == lib.decode(e.ids, skip_special_tokens=False)
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip_digests(docs).collect()}
    want = set()
    for i, t in odd_rows():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    back = bpe.decode_frame(bpe.encode_frame(docs))
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for _, t in odd_rows())
    assert bpe.round_trip_digests(no_docs).count() == 0


def test_long_and_short_pieces_merge_alike():
    own = bpe.Bpe(bpe.default_path())
    rnd = random.Random(1)
    for n in (2, 3, 17, 60, 130, bpe.WIDE - 1, bpe.WIDE, bpe.WIDE + 1, bpe.WIDE + 2):
        piece = "".join(rnd.choice("theinrgan") for _ in range(n)).encode()
        assert own.merge_all([piece])[0] == own.merge_one(piece).tobytes()


def brute_fingerprint(text):
    """(position, hash) of the chosen runs, by a rolling hash and a look at each window."""
    k, whole = winnowing.K, 2**64 - 1
    value = lambda x: xxhash.xxh64(x.encode(), seed=42).intdigest()
    if not text:
        return []
    if len(text) < k:
        return [(0, value(text) >> 33)]
    v = [value(c) for c in text]
    sums = [0]
    for c in v[:k]:
        sums[0] = sums[0] << 1 & whole ^ c
    for i in range(len(v) - k):
        sums.append((sums[-1] ^ v[i] << k - 1 & whole) << 1 & whole ^ v[i + k])
    h = [x >> 33 for x in sums]
    out = []
    for s in range(max(1, len(h) - winnowing.WINDOW + 1)):
        at = min(range(s, min(s + winnowing.WINDOW, len(h))), key=lambda i: (h[i], -i))
        if not out or out[-1] != (at, h[at]):
            out.append((at, h[at]))
    return out


def jaccard(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def winnowing_texts():
    rnd = random.Random(8)
    letters = "abcdefgh ijk\n漢字🙂é\u2028"
    n = winnowing.BLOCK
    texts = ["".join(rnd.choices(letters, k=size)) for size in [0, 1, 15, 16, 17, 46, 47, 48, 49, 90, 140, 200, 500, n - 1, n, n + 1, n + 45, n + 46, n + 47, 2 * n, 2 * n + 30, 3 * n + 5]]
    return texts + ["a" * 1000, "ab" * 300, "x", texts[-1], "漢" * 47 + texts[9]]


def test_winnowing(spark, docs, no_docs):
    rows = [(i, t) for i, t in odd_rows() if i is not None] + [(100 + i, t) for i, t in enumerate(winnowing_texts())]
    got = {r["doc_id"]: [tuple(x) for x in r["fingerprint"]] for r in winnowing.fingerprints(as_frame(spark, rows)).collect()}
    for i, t in rows:
        assert got[i] == brute_fingerprint(t or ""), i
    assert winnowing.fingerprints(no_docs).count() == 0


def test_equal_hashes_choose_the_rightmost(spark):
    f = winnowing.fingerprints(as_frame(spark, [(1, "a" * 300)])).first()["fingerprint"]
    assert [p for p, _ in f] == list(range(winnowing.WINDOW - 1, 300 - winnowing.K + 1))


def test_an_unspaced_passage_is_found_at_any_offset(spark):
    rnd = random.Random(4)
    passage = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(winnowing.SPAN))
    rows = [(i, "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(60 + i)) + passage + "尾" * i) for i in range(9)]
    found = [{h for _, h in r["fingerprint"]} for r in winnowing.fingerprints(as_frame(spark, rows)).collect()]
    assert all(a & b for a in found for b in found)


def test_edits(spark, docs, no_docs):
    rows = [(i, t) for i, t in odd_rows() if i is not None and i != 8]
    rnd = random.Random(1)
    rows += [(100 + i, t) for i, t in enumerate(rnd.sample(winnowing_texts() * 2, 54))]
    got = {r["doc_id"]: r for r in winnowing.compare_with_edits(as_frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        own, new, other = map(brute_fingerprint, (t, edited, after))
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, want in (("fingerprint", own), ("edited_fingerprint", new)):
            entries = ",".join(str(h << 31 | winnowing.LAST - p) for p, h in want)
            assert got[i][name] == hashlib.sha256(entries.encode()).hexdigest(), (i, name)
        assert got[i]["near_edited"] == pytest.approx(jaccard(own, new)) and got[i]["near_next"] == pytest.approx(jaccard(own, other))
    assert winnowing.compare_with_edits(docs).count() == len(odd_rows())
    assert winnowing.compare_with_edits(no_docs).count() == 0
    one = winnowing.compare_with_edits(as_frame(spark, [(5, "a b c")])).first()
    assert one["near_next"] == 1


def test_rows_of_one_id_are_spread(spark):
    rows = [(None, f"t{i}") for i in range(400)] + [(i, f"u{i}") for i in range(50)]
    df = as_frame(spark, rows).select(F.coalesce("doc_id", F.lit(-1)).alias("key"), F.xxhash64("text").alias("tie"), "text")
    got = {r["text"]: r["next_text"] for r in winnowing.with_next(df, ["text"]).collect()}
    order = [r["text"] for r in df.orderBy(F.desc("key"), "tie").collect()]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


def brute_lines(rows, near=line_dedup.NEAR_WORDS, least=line_dedup.MIN_WORDS):
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                left, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, left + (x != y))
        return d[-1]

    lines = []
    for i, t in sorted(rows):
        for no, raw in enumerate(t.split("\n")):
            w = [x for x in re.split(r"[\x20\x09-\x0D]+", raw) if x]
            if len(w) >= least:
                lines.append((i, no, w))
    gone = defaultdict(list)
    for k, (i, no, w) in enumerate(lines):
        if any(v == w or len(w) >= near and len(v) >= near and abs(len(v) - len(w)) < 2 and distance(v, w) <= 1 for _, _, v in lines[:k]):
            gone[i].append(no)
    return gone


def test_lines(spark, docs, no_docs):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(12)]
    rows, pool = [], []
    for i in range(40):
        lines = []
        for _ in range(rnd.randint(1, 6)):
            w = [rnd.choice(words) for _ in range(rnd.choice([2, 5, 9, 10, 11, 15, 16, 17, 32]))]
            if pool and rnd.random() < 0.6:
                w = list(rnd.choice(pool))
                for _ in range(rnd.randint(0, 2)):
                    k = rnd.randrange(len(w) + 1)
                    kind = rnd.randrange(3)
                    w[k : k + (kind != 0)] = [] if kind == 2 else [rnd.choice(words)]
            pool.append(w)
            lines.append(rnd.choice([" ", "  ", "\t"]).join(w))
        rows.append((i, "\n".join(lines)))
    # near means within one word of any earlier line, whether that line stays or not
    want = brute_lines(rows)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(as_frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i]["gone_lines"] == want[i], i
        assert got[i]["text"] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i])
    # keys of a few bits collide: lines go on to the next of their key until one is near
    for bits in (0, 3):
        few = {r["doc_id"]: r["gone_lines"] for r in line_dedup.dedup_lines(as_frame(spark, rows), key_bits=bits).collect()}
        assert few == {i: want[i] for i, _ in rows}, bits
    clash = as_frame(spark, rows).withColumnsRenamed({"id": "__id", "key": "tie", "set": "gone", "line": "rest"})
    out = line_dedup.dedup_lines(clash).orderBy("doc_id").collect()
    assert [r["gone_lines"] for r in out] == [want[i] for i, _ in rows]
    assert all((r["__id"], r["tie"], r["gone"], r["rest"]) == (7, "z", "y", "x") for r in out)
    out = line_dedup.dedup_lines(docs)
    assert out.count() == len(odd_rows()) and set(docs.columns) <= set(out.columns)
    assert out.where("doc_id = 4").first()["text"] is None
    assert line_dedup.dedup_lines(no_docs).count() == 0
