"""The stages of the pipeline, each on its own input."""

import random

import pytest

from loomwright.llm.common import stored
from tests.llm.conftest import as_frame, odd_rows
from tests.llm.test_models_and_packing import check_places, library_ids, toxic_rows

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir):
    rnd = random.Random(2)
    rows, labels = toxic_rows(900)
    clean = [i for i, _ in rows if i % 5 in (2, 3, 4)]
    passage = " ".join(f"p{rnd.randrange(900)}" for _ in range(60))
    some = dict(rows)
    rows += [(1000 + i, some[c] + "\n" + passage) for i, c in enumerate(clean[:5])]  # copies with a shared passage
    text = [f"q{rnd.randrange(900)}" for _ in range(100)]
    rows += [(2000, " ".join(text)), (2001, " ".join(text[:50] + ["changed"] + text[51:]))]
    d = sf_dir(rows, labels)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "minhash_near_dedup", "best_fit_packing"]
    stages = dict(corpus_pipeline.STAGES)
    one = stored(stages["toxicity"](spark, docs, d), "one")
    assert one.columns == docs.columns
    left = {r["doc_id"] for r in one.collect()}
    assert len([i for i in left if i < 900 and i % 5 == 0]) <= 6 and len(set(clean) - left) <= 3
    clean = [i for i in clean if i in left]
    two = stages["line_dedup"](spark, one, d)
    assert two.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in two.collect()}
    assert set(clean) <= set(kept) and all(kept[i] == some[i] for i in clean)
    assert sum(passage in t for t in kept.values()) == 1 and kept[1000] == passage
    assert not {1001, 1002, 1003, 1004} & set(kept)
    three = stages["minhash_near_dedup"](spark, one, d)
    ids = {r["doc_id"] for r in three.collect()}
    assert three.columns == docs.columns and 2000 in ids and 2001 not in ids and set(clean) <= ids
    check_places(stages["best_fit_packing"](spark, one, d).collect(), library_ids([(r["doc_id"], r["text"]) for r in one.collect()]), 2048)
    assert corpus_pipeline.run(spark, d).count()


def test_odd_rows(spark, sf_dir):
    d = sf_dir(odd_rows())
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        rows = out.collect()
        assert {4, 5, 6} <= {r["doc_id"] for r in rows}, name
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            assert sum(r["doc_id"] is None and r["text"] is None for r in rows) == 1
        nothing = stage(spark, as_frame(spark, []), d)
        assert nothing.count() == 0, name


def test_documents_without_a_word_left_go(spark, sf_dir):
    d = sf_dir([(1, "alpha\nbeta"), (2, "alpha\n\n\nbeta"), (3, "alpha\n\t\nbeta"), (4, "alpha\n\u3000\nbeta"), (5, "\n\n")])
    out = dict(corpus_pipeline.STAGES)["line_dedup"](spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    assert {r["doc_id"] for r in out.collect()} == {1, 4, 5}  # U+3000 is a character of words


def test_columns_with_names_of_its_own(spark, sf_dir):
    rows, labels = toxic_rows(200)
    d = sf_dir(rows, labels)
    names = {"lang": "__id", "source": "p_toxic", "id": "__gone", "line": "is_junk", "set": "gone", "key": "tie"}
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumnsRenamed(names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all((r["__id"], r["p_toxic"], r["__gone"], r["is_junk"], r["gone"], r["tie"]) == ("en", "src0", 7, "x", "y", "z") for r in got), name
    assert dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, docs, d).count() >= len(rows)
