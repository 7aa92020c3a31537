import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, line string, `set` string, key string"


def as_frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(i, t, "en", "src0", None if t is None else len(t), 7, "x", "y", "z") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    """Null and empty texts, null ids, repeated rows, ties, very long words and texts."""
    rnd = random.Random(5)
    vocabulary = ["alpha", "beta", "Gamma", "délta", "eps　ilon", "zeta,", "eta.", "theta", "iota", "kappa", "<|endoftext|>"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base = text(60)
    near = base.replace("alpha", "omega", 1)
    rows = [(1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "one two"), (8, "one two"), (9, "x" * 5000), (10, text(4000))]
    rows += [(None, base), (None, None), (11, "tab\tand\x0bvertical\r\nline"), (12, base + "\n" + text(12)), (-3, text(30)), (13, "🙂   é")]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return as_frame(spark, odd_rows())


@pytest.fixture(scope="session")
def no_docs(spark):
    return as_frame(spark, [])


@pytest.fixture()
def sf_dir(spark, tmp_path):
    """A folder of tables from rows of documents, and labels, pages; 40 embeddings are always there."""

    def make(rows, labels=(), pages=()):
        as_frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame(list(pages), "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
        vectors = [(i, [float((i * (k + 3)) % 17) / 17 for k in range(16)], i % 3) for i in range(40)]
        spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
        return str(tmp_path)

    return make
