"""Ids and extra columns pass through Python workers unaltered: 64-bit numbers beside a null in one batch."""

import pytest
from pyspark.sql import functions as F

from loomwright.llm import bpe, ngram, packing, toxicity

BIG = [2**53 + 1, 2**63 - 2, None, 5, -(2**53) - 1]


@pytest.fixture(scope="module")
def big(spark):
    rows = [(i, f"the text of number {k}", None if k % 2 else 2**53 + 1 + 2 * k) for k, i in enumerate(BIG)]
    return spark.createDataFrame(rows, "doc_id long, text string, more long").coalesce(1)


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=str)


def test_ids_beside_null(spark, big):
    want = sorted(BIG, key=str)
    assert ids(bpe.round_trip_digests(big)) == want
    assert ids(bpe.decode_frame(bpe.encode_frame(big))) == want
    assert ids(packing.pieces(big)) == want
    assert ids(ngram.score(big, ngram.train_model(big.select("text")))) == want


def test_extra_columns_beside_null(spark, big):
    labels = spark.createDataFrame([(5, True), (2**53 + 1, False)], "doc_id long, toxic boolean")
    got = toxicity.score(big, toxicity.toxicity_chain(big, labels, ["toxic"]))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select("doc_id", "text", "more").collect()), key=key) == sorted(map(tuple, big.collect()), key=key)


def test_places_of_repeated_ids(spark):
    rows = [(7, "word " * (2000 + k)) for k in range(6)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("sequence_id", "offset").collect()
    ends = {}
    for r in got:
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= packing.CAPACITY for n in ends.values())
    assert F is not None
