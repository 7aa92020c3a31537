"""Near-duplicates by circulant MinHash, banding, and verification on full shingle sets.

A document's set has the hashes of its distinct k-word shingles. Two permutations of the 32-bit universe make the whole
signature: the first breaks up any order of the elements, the second, shifted circularly by one more for each
coordinate, is looked up for each of them; a coordinate is the smallest value over the set. Documents whose signatures
agree in a whole band of ROWS coordinates are candidates. At the threshold a pair is missed by all BANDS bands with a
chance below 3e-9; it does not matter for the result whether a pair is found in one band or in many.

Documents with the same set are one class with its smallest id; only classes go on. From the bands:

1. each class is joined with the smallest class of each of its buckets, and these stars make families;
2. families of up to BLOCK classes are verified whole, each in one task, over all pairs of full sets;
3. larger families are cut into blocks by bucket centre and salt, so no task holds more than a few blocks whatever the
   family's size. Each block is verified whole; the classes with most links in their blocks then are compared with all
   blocks, which joins what belongs together;
4. what is left of a larger family are pairs that share a bucket, are of different blocks, and are still apart. For
   each pair of blocks that has some, the classes outside of their bucket's largest component are compared with the
   other block, in one task. Pairs of blocks are made, never pairs of classes, and no candidate is dropped.

Links are 100 * intersection >= threshold * union on the full sets. Components are found by star contraction.

Defined results: null or empty text has an empty set, is linked with nothing and kept; with fewer than k words the whole
sequence is one shingle; rows without an id have the size of their set and are kept, unlinked, with a null component; rows that repeat an id are one
document, so what one of them links the others share; an empty table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.bpe import chunks
from loomwright.llm.common import arrow_batched, batched, beside, salt, stored, table, texts_of
from loomwright.llm.components import components
from loomwright.llm.tokens import mix, words

BANDS, ROWS = 50, 5
#: Classes of a block; hubs of a larger family; salts of the way back from classes to rows; columns of a count at once.
BLOCK, HUBS, SALTS, COLUMNS = 128, 8, 64, 16384
_MULTIPLIERS = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles."""
    return [s for i, j in chunks([t or "" for t in texts]) for s in _sets(texts[i:j], k)]


def _sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    w = words(texts)
    h, n = w.hashes, len(w.hashes)
    odd = np.uint64(2) * np.arange(1, k + 1, dtype=np.uint64) + np.uint64(1)
    times = np.resize(_MULTIPLIERS, k) * odd
    grams = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        grams[: n - j] += h[j:] * times[j] if j else h * times[0]
    grams = mix(grams)
    out = []
    for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for x in h[a:b]:
                short = mix(np.array([short, x], np.uint64) * _MULTIPLIERS[:2]).sum()
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _permute(x: np.ndarray, spare: np.ndarray) -> None:
    """A fixed permutation of the 32-bit integers, in place."""
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if times:
            np.multiply(x, np.uint32(times), out=x)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """size coordinates for each set, none of them empty."""
    out = np.empty((len(sets), size), np.uint32)
    at = 0
    while at < len(sets):
        end, held = at, 0
        while end < len(sets) and (end == at or held + len(sets[end]) <= 32768):
            held += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        first = (x ^ (x >> np.uint64(32))).astype(np.uint32)
        spare, shifted = np.empty_like(first), np.empty_like(first)
        np.multiply(first, np.uint32(0x9E3779B1), out=first)  # the first permutation
        _permute(first, spare)
        begin = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : end - 1]])]).astype(np.int64)
        for c in range(size):
            np.add(first, np.uint32(c), out=shifted)  # the second, shifted by c
            _permute(shifted, spare)
            out[at:end, c] = np.minimum.reduceat(shifted, begin)
        at = end
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    s = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    for r in range(rows):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return acc.view(np.int64)


def described(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """id, n (size of the set), set (its digest) and the band keys of each row (columns id and text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b, "text")
            for i, j in chunks(texts):
                sets = shingle_sets(texts[i:j], k)
                full = [x for x, s in enumerate(sets) if len(s)]
                bands_of: list[np.ndarray] = [np.empty(0, np.int64)] * len(sets)
                for x, keys in zip(full, band_keys(signatures([sets[x] for x in full], bands * rows), bands, rows), strict=True):
                    bands_of[x] = keys
                made = {"n": np.array([len(s) for s in sets], np.int64), "set": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "bands": pa.array(bands_of, pa.list_(pa.int64()))}
                yield beside(b.column("id").slice(i, j - i), made, "id")

    return arrow_batched(docs.select("id", "text"), run, "id long, n long, set binary, bands array<long>")


def linked(sets: list[np.ndarray], threshold: int) -> np.ndarray:
    """Which pairs of sets are links: a matrix, from exact sizes of intersections."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1
    col, owner = np.cumsum(new & shared)[shared] - 1, owner[shared]
    common = np.zeros((m, m), np.float64)
    bounds = np.searchsorted(col, np.arange(0, (col[-1] + 1 if len(col) else 0) + COLUMNS, COLUMNS))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            first = int(col[a])
            have = np.zeros((m, int(col[b - 1]) - first + 1), np.float32)
            have[owner[a:b], col[a:b] - first] = 1
            common += have @ have.T
    common = np.rint(common).astype(np.int64)
    np.fill_diagonal(common, size)
    return 100 * common >= threshold * (size[:, None] + size[None, :] - common)


def _block(pdf: pd.DataFrame, k: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """ids of the block's rows and their links."""
    sets = shingle_sets(pdf["text"].tolist(), k)
    keep = [i for i, s in enumerate(sets) if len(s)]
    ids = pdf["cid"].to_numpy()[keep]
    return ids, linked([sets[i] for i in keep], threshold) if keep else np.zeros((0, 0), bool)


def _labels(ids: np.ndarray, link: np.ndarray) -> np.ndarray:
    """The smallest id reachable from each."""
    label = ids.copy()
    while True:
        low = np.where(link, label[None, :], np.iinfo(np.int64).max).min(axis=1) if len(ids) else label
        if (low == label).all():
            return label
        label = low


def verified_blocks(rows: DataFrame, by: list[str], k: int, threshold: int, moved: bool = False) -> DataFrame:
    """For each block (the columns `by`) of classes (cid, text): cid, the smallest cid it reaches inside, its links.

    With moved only for the classes that reach a smaller one.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, link = _block(pdf, k, threshold)
        low, degree = _labels(ids, link), link.sum(axis=1) - 1 if len(ids) else ids
        some = low < ids if moved else np.ones(len(ids), bool)
        out = {c: np.full(int(some.sum()), pdf[c].iloc[0]) for c in by}
        return pd.DataFrame(out | {"cid": ids[some], "low": low[some], "degree": degree[some]})

    return rows.select(*by, "cid", "text").groupBy(*by).applyInPandas(run, ", ".join(f"{c} long" for c in by) + ", cid long, low long, degree long")


def near_links(classes: DataFrame, docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links (a, b) that make the components of the classes (cid, bands); docs has id and text."""
    banded = classes.select("cid", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("cid").alias("centre"), F.count("*").alias("size")).where("size > 1")
    buckets = stored(buckets, "buckets")
    stars = banded.join(buckets, "key").where("cid <> centre").select("cid", "centre").distinct()
    stars = stored(stars, "stars")
    families = components(stars, "cid", "centre").select(F.col("node").alias("cid"), F.col("component").alias("family"))
    near = stars.groupBy("cid").agg(F.min("centre").alias("centre"))
    members = families.join(near, "cid", "left").withColumn("centre", F.least("cid", F.coalesce("centre", "cid"))).withColumn("leaf", salt(SALTS, "cid"))
    size = families.groupBy("family").agg(F.count("*").alias("members"))
    centres = members.groupBy("family", "centre").agg(F.count("*").alias("around"))
    parts = centres.join(size, "family").select("family", "centre", "members", F.ceil(F.col("around") / BLOCK).alias("parts"))
    leaves = members.select("family", "centre", "leaf").distinct().join(parts, ["family", "centre"])  # a centre of many is joined in parts
    blocks = members.join(leaves, ["family", "centre", "leaf"]).select(
        "cid",
        "family",
        F.when(F.col("members") <= BLOCK, F.lit(0)).otherwise(F.xxhash64("centre", F.pmod(F.xxhash64("cid"), "parts"))).alias("block"),
        (F.col("members") > BLOCK).alias("large"),
    )
    blocks = stored(blocks, "blocks")
    texts = stored(blocks.join(docs, blocks["cid"] == docs["id"]).select("cid", "family", "block", "large", "text"), "texts")
    inside = stored(verified_blocks(texts, ["family", "block"], k, threshold), "inside")
    links = inside.where("low <> cid").select(F.col("cid").alias("a"), F.col("low").alias("b"))
    large = texts.where("large")
    if large.isEmpty():
        return links
    # the classes with most links in their blocks, against all blocks of their family
    hubs = inside.join(blocks.where("large").select("cid"), "cid", "left_semi").groupBy("family", F.pmod(F.xxhash64("cid"), F.lit(HUBS)).alias("_h")).agg(F.max_by("cid", F.struct("degree", -F.col("cid"))).alias("cid"))
    hub_texts = hubs.select("family", "cid").join(texts.select("cid", "text"), "cid")
    cut = large.select("family", "block").distinct()
    wide = large.select("family", "block", "cid", "text").union(cut.join(hub_texts, "family").select("family", "block", "cid", "text"))
    joined = stored(verified_blocks(wide, ["family", "block"], k, threshold, moved=True), "joined")
    links = stored(links.union(joined.where("low <> cid").select(F.col("cid").alias("a"), F.col("low").alias("b"))).distinct(), "known")
    # pairs of a bucket, of different blocks, that are still apart
    label = components(links).select(F.col("node").alias("cid"), F.col("component").alias("label"))
    apart = blocks.where("large").join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    at = stored(banded.join(apart, "cid").select("key", "cid", "block", "label"), "apart")
    counts = at.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    at = at.join(mixed.select("key", "main"), "key")
    few = at.where("label <> main")
    theirs = few.select("key", F.col("block").alias("bx")).distinct()
    pairs = stored(theirs.join(at.select("key", F.col("block").alias("by")).distinct(), "key").where("bx <> by").select("bx", "by").distinct(), "pairs")
    if pairs.isEmpty():
        return links
    held = texts.where("large").select("block", "cid", "text")
    left = pairs.join(held.join(few.select("cid").distinct(), "cid", "left_semi").withColumnRenamed("block", "bx"), "bx")
    right = pairs.join(held.withColumnRenamed("block", "by"), "by")
    rest = verified_blocks(left.select("bx", "by", "cid", "text").union(right.select("bx", "by", "cid", "text")), ["bx", "by"], k, threshold, moved=True)
    return links.union(rest.where("low <> cid").select(F.col("cid").alias("a"), F.col("low").alias("b")).distinct())


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: the id, n_shingles, component_id (the smallest id reachable), kept (the id is its component's)."""
    own = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    seen = stored(described(own, k, bands, rows).withColumn("leaf", salt(SALTS, "id")), "sets")
    full = seen.where("n > 0 AND id IS NOT NULL")
    classes = full.groupBy("set", "n", "bands").agg(F.min("id").alias("cid"))
    classes = stored(classes, "classes")
    label = components(near_links(classes, own, k, threshold), "a", "b")
    named = classes.join(label, F.col("cid") == F.col("node"), "left").select("set", F.coalesce("component", "cid").alias("component"))
    leaves = full.select("set", "leaf").distinct().join(named, "set")  # a set that many rows share is joined in parts
    part = seen.where("id IS NOT NULL").select("id", "n", "set", "leaf").join(leaves, ["set", "leaf"], "left")
    out = part.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    out = out.withColumn("kept", F.col(f"`{id_col}`") == F.col("component_id"))
    loose = seen.where("id IS NULL").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(loose)


def op10_circulant_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)
