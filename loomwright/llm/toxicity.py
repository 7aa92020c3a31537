"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other. Each has a logistic model over hashed features of the text (words and
the first four and six bytes of words; log counts, scaled to unit length) and over the log-odds of the categories before
it. Those are out-of-fold predictions while training: a model that has not seen the document gives them, as it will be
when new documents are scored. A category's cut is the one of the best F1 over its out-of-fold predictions.

Models are fitted on a bounded sample of labelled rows: at most `rows_a_stratum` ids of each combination of labels, first
by a hash of the id, one row for each id, weighted by what they stand for. Tasks make the features of whole texts, one
task lays them out as one file in the shared folder, and the models of all folds are fitted side by side, each by a task
that maps the file; the driver sees weights and log-odds, never texts. A fold is a hash of the text, so equal texts share
one and no model has seen what it predicts. Scoring reads every whole text once, without a shuffle; the models are
broadcast and their size is fixed by FEATURE_BITS.

The tables label two categories: junk (quality 0) and toxic. The chain takes any list of label columns.

Defined results: null or empty text has no features, gets the prior log-odds and no flag; rows with a null label or id
are not learned from; ids may be numbers or texts; of labels that contradict each other for an id the worse counts, of
rows that repeat an id one is learned from; a category without examples of both kinds has probability 0; rows with equal
text get equal scores, repeated rows stay repeated; an empty table gives no rows; the pipeline stage keeps all columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.bpe import chunks
from loomwright.llm.common import arrow_batched, batched, beside, scratch_path, stored, table, texts_of
from loomwright.llm.elias_fano import read_arrays, write_arrays
from loomwright.llm.tokens import words

#: Bits of a feature's index within its kind; byte lengths of the kinds, 0 for the whole word.
FEATURE_BITS, KINDS = 18, (0, 4, 6)
ROWS_A_STRATUM, FOLDS, ROUNDS, RATE, DECAY = 2000, 3, 110, 1.5, 1e-5
#: Entries of the sample that a step of fitting looks at together, and tasks that make its features.
ENTRIES_AT_ONCE, SAMPLE_TASKS = 250_000, 32
N_FEATURES = len(KINDS) << FEATURE_BITS


@dataclass
class Sparse:
    """Features of n rows: row, column and value of each entry."""

    n: int
    row: np.ndarray
    col: np.ndarray
    value: np.ndarray


def features(texts: list[str | None]) -> Sparse:
    w = words(texts)
    row = np.repeat(np.arange(len(texts)), w.counts)
    keys = []
    for j, size in enumerate(KINDS):
        h = w.part(w.starts, np.minimum(w.starts + size, w.ends)) if size else w.hashes
        keys.append(row * N_FEATURES + (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64) + (j << FEATURE_BITS))
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    row, col, value = key // N_FEATURES, key % N_FEATURES, np.log1p(count)
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(texts)))
    return Sparse(len(texts), row, col, (value / norm[row]).astype(np.float32))


@dataclass
class Linear:
    bias: float
    weights: np.ndarray
    earlier: np.ndarray
    cut: float = field(default=np.inf)

    def log_odds(self, x: Sparse, before: np.ndarray) -> np.ndarray:
        s = np.bincount(x.row, x.value * self.weights[x.col], minlength=x.n) + self.bias
        return np.clip(s + before @ self.earlier, -30, 30)


def fit(parts: list[Sparse], before: np.ndarray, y: np.ndarray, weight: np.ndarray, n_features: int) -> Linear:
    """Logistic regression by full-batch AdaGrad, part by part; rows of weight 0 don't count."""
    total = weight.sum()
    share = float((weight * y).sum() / max(total, 1e-9))
    model = Linear(0.0, np.zeros(n_features, np.float32), np.zeros(before.shape[1]))
    if not 0 < share < 1:
        model.bias = -30.0 if share == 0 else 30.0
        return model
    model.bias = np.log(share / (1 - share))
    scaled = before / 10  # log-odds are at most 30
    g_w, g_e, g_b = np.full(n_features, 1e-8), np.full(before.shape[1], 1e-8), 1e-8
    ends = np.cumsum([p.n for p in parts])
    for _ in range(ROUNDS):
        d, e, b = DECAY * model.weights.astype(float), DECAY * model.earlier, 0.0
        for p, end in zip(parts, ends.tolist(), strict=True):
            rows = slice(end - p.n, end)
            if not weight[rows].any():
                continue
            s = np.bincount(p.row, p.value * model.weights[p.col], minlength=p.n) + model.bias + scaled[rows] @ model.earlier
            err = weight[rows] * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[rows]) / total
            d += np.bincount(p.col, p.value * err.astype(np.float32)[p.row], minlength=n_features)
            e = e + scaled[rows].T @ err
            b += float(err.sum())
        g_w += d * d
        model.weights -= (RATE * d / np.sqrt(g_w)).astype(np.float32)
        g_e += e * e
        model.earlier -= 0.2 * RATE * e / np.sqrt(g_e)
        g_b += b * b
        model.bias -= 0.2 * RATE * b / np.sqrt(g_b)
    model.earlier /= 10
    return model


def best_cut(log_odds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut of the best F1, halfway to the next lower score."""
    order = np.argsort(-log_odds, kind="stable")
    hit = np.cumsum((weight * y)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * y).sum())
    k = int(f1.argmax())
    s = log_odds[order]
    return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]

    def log_odds(self, x: Sparse) -> np.ndarray:
        out = np.zeros((x.n, 0))
        for m in self.models:
            out = np.column_stack([out, m.log_odds(x, out)])
        return out


def laid_out(path: str) -> tuple[list[Sparse], dict[str, np.ndarray]]:
    """The sample's features in parts of about ENTRIES_AT_ONCE entries, and the arrays of its file."""
    a = read_arrays(path)
    ends, parts, at = a["ends"], [], 0
    while at < len(ends):
        begin = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begin + ENTRIES_AT_ONCE, side="right")))
        row = np.repeat(np.arange(to - at, dtype=np.uint16 if to - at < 2**16 else np.int32), np.diff(ends[at:to], prepend=begin))
        parts.append(Sparse(to - at, row, a["col"][begin : ends[to - 1]], a["value"][begin : ends[to - 1]]))
        at = to
    return parts, a


def lay_out(sampled: DataFrame, label_cols: list[str], path: str) -> int:
    """Writes the features of the sampled rows (id, text, labels, weight) as one file; how many rows there are."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            for i, j in chunks(texts):
                x = features(texts[i:j])
                ends = np.cumsum(np.bincount(x.row, minlength=x.n)).tolist()
                out = b.iloc[i:j].drop(columns=["text"])
                out["fold"] = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % FOLDS for t in texts[i:j]]
                out["col"] = [x.col[p:q].astype(np.int32).tobytes() for p, q in zip([0, *ends], ends, strict=False)]
                out["value"] = [x.value[p:q].tobytes() for p, q in zip([0, *ends], ends, strict=False)]
                yield out

    labels = ", ".join(f"`{c}` boolean" for c in label_cols)
    rows = stored(batched(sampled.repartition(SAMPLE_TASKS, "id"), made, f"id string, {labels}, weight double, fold int, col binary, value binary"), "sample")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(batches)).sort_values("id", ignore_index=True)
        col, value = (np.frombuffer(b"".join(got[c]), d) for c, d in (("col", np.int32), ("value", np.float32)))
        owner = np.repeat(np.arange(len(got)), [len(x) // 4 for x in got["col"]])
        shared = (np.bincount(col, minlength=N_FEATURES) > 1)[col]  # what one row has alone teaches nothing of others
        common, col = np.unique(col[shared], return_inverse=True)
        arrays = {"ends": np.cumsum(np.bincount(owner[shared], minlength=len(got))), "col": col.astype(np.int32), "value": value[shared], "common": common.astype(np.int64)}
        arrays |= {"weight": got["weight"].to_numpy(float), "fold": got["fold"].to_numpy(np.int64), "labels": got[label_cols].to_numpy(bool).astype(np.uint8).ravel()}
        write_arrays(path, arrays)
        yield pd.DataFrame({"n": [len(got)]})

    n = rows.coalesce(1).mapInPandas(whole, "n long").collect() if not rows.isEmpty() else []  # one task: the sample is bounded
    return int(n[0]["n"]) if n else 0


def fit_category(spark: SparkSession, path: str, c: int, before: np.ndarray, categories: int) -> tuple[Linear, np.ndarray]:
    """The model of a category after those whose out-of-fold log-odds are `before`, and its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for fold in (f for b in batches for f in b["id"].tolist()):
            parts, a = laid_out(path)
            y = a["labels"].reshape(-1, categories)[:, c].astype(float)
            n = len(a["common"])
            model = fit(parts, before, y, np.where(a["fold"] == fold, 0, a["weight"]), n)
            ends = np.cumsum([p.n for p in parts]).tolist()
            held = np.zeros(0)
            if fold < FOLDS:
                odds = np.concatenate([model.log_odds(p, before[e - p.n : e]) for p, e in zip(parts, ends, strict=True)])
                held = odds[a["fold"] == fold]
            full = np.zeros(N_FEATURES, np.float32)
            full[a["common"]] = model.weights
            yield pd.DataFrame([(fold, model.bias, model.earlier.tobytes(), full.tobytes() if fold == FOLDS else b"", held.astype(float).tobytes())], columns=["fold", "bias", "earlier", "weights", "held"])

    got = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInPandas(run, "fold long, bias double, earlier binary, weights binary, held binary").collect()  # FOLDS + 1 rows
    a = read_arrays(path)
    oof = np.zeros(len(a["fold"]))
    for r in got:
        if r["fold"] < FOLDS:
            oof[a["fold"] == r["fold"]] = np.frombuffer(bytes(r["held"]))
        else:
            model = Linear(r["bias"], np.frombuffer(bytes(r["weights"]), np.float32), np.frombuffer(bytes(r["earlier"])))
    y = a["labels"].reshape(-1, categories)[:, c].astype(float)
    model.cut = best_cut(oof, y, a["weight"]) if 0 < y.sum() < len(y) else np.inf
    return model, oof


def fit_chain(sampled: DataFrame, categories: list[str]) -> tuple[Chain, np.ndarray]:
    """The chain, and the out-of-fold log-odds of the sampled rows in order of their ids."""
    spark = sampled.sparkSession
    path = scratch_path(spark, "toxicity") + ".ef"
    n = lay_out(sampled, categories, path)
    if not n:
        return Chain(categories, [Linear(-30.0, np.zeros(N_FEATURES, np.float32), np.zeros(c)) for c in range(len(categories))]), np.zeros((0, len(categories)))
    before, models = np.zeros((n, 0)), []
    for c in range(len(categories)):
        model, oof = fit_category(spark, path, c, before, len(categories))
        models.append(model)
        before = np.column_stack([before, oof])
    return Chain(categories, models), before


def sample(docs: DataFrame, labels: DataFrame, label_cols: list[str], rows_a_stratum: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled rows for fitting (id, text, labels, weight): rows_a_stratum ids of each combination of labels at most."""
    spark = docs.sparkSession
    named = labels.select(F.col(f"`{id_col}`").cast("string").alias("id"), *[F.col(f"`{c}`").cast("boolean").alias(c) for c in label_cols]).dropna()
    named = named.groupBy("id").agg(*[F.max(c).alias(c) for c in label_cols])
    sizes = named.groupBy(*label_cols).count().collect()  # 2 ** categories rows at most
    parts = []
    for s in sizes:
        hit = named.where(" AND ".join(f"{'' if s[c] else 'NOT '}`{c}`" for c in label_cols))
        parts += [(*r, s["count"] / min(s["count"], rows_a_stratum)) for r in hit.orderBy(F.xxhash64("id"), "id").limit(rows_a_stratum).collect()]
    chosen = spark.createDataFrame(parts, ", ".join(["id string", *[f"`{c}` boolean" for c in label_cols], "weight double"]))
    own = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = own.join(F.broadcast(chosen), "id")  # 2 ** categories * rows_a_stratum ids at most
    return found.groupBy("id", *label_cols, "weight").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "text", *label_cols, "weight")


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """docs with p_<category> and is_<category> for each category of the chain; such columns of its own are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    added = [f"p_{c}" for c in chain.categories] + [f"is_{c}" for c in chain.categories]
    docs = docs.drop(*added)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.DoubleType() if c[0] == "p" else T.BooleanType()) for c in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        for b in batches:
            texts = texts_of(b, text_col)
            for i, j in chunks(texts):
                odds, full = chain.log_odds(features(texts[i:j])), np.array([bool(t) for t in texts[i:j]])
                made = {f"p_{c}": 1 / (1 + np.exp(-odds[:, k])) for k, c in enumerate(chain.categories)}
                made |= {f"is_{c}": (odds[:, k] > chain.models[k].cut) & full for k, c in enumerate(chain.categories)}
                yield beside(b.slice(i, j - i), made)

    return arrow_batched(docs, run, schema)


def table_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("junk"), (F.col("toxic") == 1).alias("toxic"))


def toxicity_chain(docs: DataFrame, labels: DataFrame, categories: list[str], rows_a_stratum: int = ROWS_A_STRATUM) -> Chain:
    return fit_chain(sample(docs, labels, categories, rows_a_stratum), categories)[0]


def op5_classifier_chain_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity_chain(docs, table_labels(spark, sf_dir), ["junk", "toxic"])
    return score(docs, chain).select("doc_id", "p_junk", "p_toxic", "is_junk", "is_toxic")
