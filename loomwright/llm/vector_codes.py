"""Vector codes: product quantisation whose nearest entries come from partial-distance search.

A vector becomes integers floor(4096 * x), cut into 8 parts; each part is coded by the nearest of its codebook's 16
entries. Dimensions are looked at in descending variance of the codebook, as the distances that decide grow fastest
there. A first entry, the nearest in the first dimension, gives each vector of a block a complete distance; then entry
after entry adds up dimension by dimension for all vectors of the block at once, and a mask drops a vector from an
entry as soon as its sum strictly exceeds the vector's best complete distance. Equal distances therefore stay to the
end, and the lower index wins. All sums are integers, so the order of rows, blocks and tasks changes nothing.

Codebooks are fitted over all rows: each round is one pass in which a task keeps the count and the sum of each entry
(whatever its rows), sends them in pieces of 32 bits, and Spark adds the pieces up; the driver sees one row for each
entry, component and piece. Codebooks are the only thing that is sent to tasks, and their size depends on the length of
a vector alone.

Defined results: a vector that is null, empty or of another length than most (ties: the longest), or that holds null or
a component that is not finite, is left out; a length that 8 does not divide is cut as evenly as can be (some parts may
be empty and have code 0); of rows that repeat one of the first ids the smallest vector starts the codebook, all are
coded; rows with a null id are coded but start none; fewer than 16 ids start fewer entries; numbers of any size are
exact (beyond 64 bits as Python integers) and an error above 2 ** 63 - 1 is given as that; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import arrow_batched, beside, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors that are searched side by side.
BLOCK = 4096
MOST = 2**63 - 1

#: For each part its entries, as integers.
Books = list[np.ndarray]


def limit(d: int) -> int:
    """Integers up to this have squared distances over d dimensions within 64 bits."""
    return math.isqrt(2**61 // max(d, 1)) // 2


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of each component, exactly: 64-bit integers or, where distances need more, Python ones."""
    x = x.astype(np.float64, copy=False)
    if not x.size or np.abs(x).max() < limit(x.shape[1]) // SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    whole = np.vectorize(lambda v: int(v) * SCALE if abs(v) >= 2.0**52 else math.floor(v * SCALE), otypes=[object])
    return whole(x)


def bounds(d: int) -> list[tuple[int, int]]:
    """Begin and end of each part of a vector."""
    return [(p * d // PARTS, (p + 1) * d // PARTS) for p in range(PARTS)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry nearest to each row; ties go to the lower index."""
    n, d = x.shape
    code = np.zeros(n, np.int64)
    if not d or not n:
        return code, np.zeros(n, np.int64)
    if object in (x.dtype, book.dtype):
        x, book = x.astype(object), book.astype(object)
    spread = len(book) * (book * book).sum(0) - book.sum(0) ** 2  # variances, times a constant
    order = np.argsort(-spread, kind="stable")
    cols, book = np.ascontiguousarray(x.T[order]), book[:, order]
    code = np.abs(cols[0][:, None] - book[:, 0]).argmin(1)
    first, off = code.copy(), cols - book[code].T
    best = (off * off).sum(0)
    for j in range(len(book)):
        at = np.flatnonzero(first != j)
        total = np.zeros(len(at), best.dtype)
        for i in range(d):
            off = cols[i][at] - book[j, i]
            total = total + off * off
            live = np.asarray(total <= best[at], bool)
            if not live.all():
                at, total = at[live], total[live]
                if not len(at):
                    break
        better = np.asarray((total < best[at]) | ((total == best[at]) & (j < code[at])), bool)
        best[at[better]], code[at[better]] = total[better], j
    return code, best


def is_whole(vector: Column) -> Column:
    """The vector and all of its components are there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def kept(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vectors can be coded: all of one length."""
    v = F.col(f"`{vector_col}`")
    some = df.where(is_whole(v) & (F.size(v) > 0))
    length = some.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return some.where(F.size(v) == (length["d"] if length else 0))


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """The vectors of a batch, row by row."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def first_entries(rows: DataFrame, id_col: str, vector_col: str) -> Books:
    """The codebooks to start with: the parts of the vectors of the smallest ids."""
    own = rows.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{vector_col}`").alias("v")).where("i IS NOT NULL")
    low = [r["i"] for r in own.select("i").distinct().orderBy("i").limit(ENTRIES).collect()]
    got = own.where(F.col("i").isin(low)).groupBy("i").agg(F.min("v").alias("v")).orderBy("i").collect()  # ENTRIES rows at most
    if not got:
        return []
    x = integers(np.array([r["v"] for r in got], np.float64))
    return [x[:, a:b] for a, b in bounds(x.shape[1])]


def _pieces(values: list[int]) -> Iterator[tuple[int, int, int]]:
    """(place, power, piece): each value is the sum of its pieces times 2 ** (32 * power)."""
    for i, v in enumerate(values):
        k = 0
        while not -(2**31) <= v < 2**31:
            yield i, k, v & 0xFFFFFFFF
            v, k = v >> 32, k + 1
        if v:
            yield i, k, v


def improved(rows: DataFrame, books: Books, vector_col: str) -> Books:
    """The codebooks after one round: assign every part, then replace entries by the floors of their means."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(books)
    shapes = [b.shape for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        count = [np.zeros(k, object) for k, _ in shapes]
        total = [np.zeros(s, object) for s in shapes]
        for b in batches:
            x = integers(matrix(b, "v"))
            for p, (lo, hi) in enumerate(bounds(x.shape[1])):
                code = nearest(x[:, lo:hi], books[p])[0]
                count[p] += np.bincount(code, minlength=len(books[p])).astype(object)
                for j in np.unique(code).tolist():
                    total[p][j] += x[code == j, lo:hi].sum(0)
        flat = [int(v) for c, t in zip(count, total, strict=True) for v in [*c, *t.ravel()]]
        if any(flat):
            at, power, piece = zip(*_pieces(flat), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(power, pa.int32()), pa.array(piece, pa.int64())], names=["at", "power", "piece"])

    sums = arrow_batched(rows.select(F.col(f"`{vector_col}`").alias("v")), run, "at int, power int, piece long", BLOCK)
    added = [0] * sum(k + k * d for k, d in shapes)
    for r in sums.groupBy("at", "power").agg(F.sum("piece").alias("s")).collect():  # entries times components
        added[r["at"]] += r["s"] << (32 * r["power"])
    out, at = [], 0
    for b, (k, d) in zip(books, shapes, strict=True):
        count, total = added[at : at + k], np.array(added[at + k : at + k + k * d], object).reshape(k, d)
        at += k + k * d
        new = np.array([[t // c for t in row] if c else old.tolist() for c, row, old in zip(count, total, b, strict=True)], object).reshape(k, d)
        small = not new.size or max(map(abs, new.ravel())) <= limit(d)
        out.append(new.astype(np.int64) if small else new)
    return out


def fit(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = ROUNDS) -> Books:
    """Codebooks of the kept rows; none without rows that have an id."""
    books = first_entries(rows, id_col, vector_col)
    for _ in range(rounds if books else 0):
        books = improved(rows, books, vector_col)
    return books


def digest(books: Books) -> str:
    """SHA-256 of all entries' components, by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for b in books for row in b.tolist() for v in row).encode()).hexdigest()


def encode(rows: DataFrame, books: Books, vector_col: str = "embedding") -> DataFrame:
    """rows with code (two hex digits for each part) and error, the squared distance; such columns of their own go."""
    rows = rows.drop("code", "error")
    sent = rows.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([*rows.schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for b in batches:
            x = integers(matrix(b, vector_col))
            codes, error = np.zeros((b.num_rows, PARTS), np.uint8), np.zeros(b.num_rows, object)
            for p, (lo, hi) in enumerate(bounds(x.shape[1])):
                codes[:, p], dist = nearest(x[:, lo:hi], books[p])
                error = error + dist
            yield beside(b, {"code": [bytes(c).hex() for c in codes], "error": pa.array([min(int(e), MOST) for e in error], pa.int64())})

    return arrow_batched(rows if books else rows.limit(0), run, schema, BLOCK)


def decode(coded: DataFrame, books: Books, code_col: str = "code") -> DataFrame:
    """coded with approximation: the middles of the cells that the entries of its code stand for."""
    entries = [F.array(*[F.array(*[F.lit((float(v) + 0.5) / SCALE) for v in row]) for row in b.tolist()]) for b in books]
    at = lambda p: F.conv(F.substring(f"`{code_col}`", 2 * p + 1, 2), 16, 10).cast("int") + 1
    return coded.withColumn("approximation", F.concat(*[F.element_at(e, at(p)) for p, e in enumerate(entries)]))


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Books]:
    """Codes, errors and errors by label of all rows that can be coded, and the codebooks."""
    rows = kept(df, vector_col)
    books = fit(rows, id_col, vector_col)
    own = rows.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_label"), F.col(f"`{vector_col}`").alias("_v"))
    coded = stored(encode(own, books, "_v").drop("_v"), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST)).cast("long")
    by_label = stored(coded.groupBy(F.col("_label").alias("_of")).agg(total.alias("label_error")), "label_errors")
    out = coded.join(by_label, F.col("_label").eqNullSafe(F.col("_of")))
    return out.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")), books


def op11_partial_distance_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))[0]


def _round_sql(r: int) -> str:
    """Assignment by the codebooks b<r>, and the codebooks after it."""
    distance = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"""a{r} AS MATERIALIZED (SELECT i, p, any_value(v) AS v, min(struct_pack(d := d, j := j)) AS best FROM (SELECT i, p, v, j, CAST({distance} AS BIGINT) AS d FROM parts JOIN b{r} USING (p)) GROUP BY i, p),
b{r + 1} AS MATERIALIZED (SELECT p, j, coalesce(m, c) AS c FROM b{r} LEFT JOIN (SELECT p, j, list(m ORDER BY k) AS m FROM (SELECT p, best.j AS j, k, CAST(floor(sum(v[k]) / count(*)) AS BIGINT) AS m FROM a{r}, unnest(range(1, len(v) + 1)) AS u(k) GROUP BY 1, 2, 3) GROUP BY p, j) USING (p, j))"""


def op11_sql() -> str:
    """The same by SQL, without partial distances."""
    rounds = ",\n".join(_round_sql(r) for r in range(ROUNDS + 1))
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS x FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (SELECT i, p, x[p * len(x) // {PARTS} + 1:(p + 1) * len(x) // {PARTS}] AS v FROM kept, range({PARTS}) AS t(p)),
b0 AS MATERIALIZED (SELECT p, j, v AS c FROM parts JOIN (SELECT i, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (i)),
{rounds},
codes AS (SELECT i, string_agg(printf('%02x', best.j), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) FROM b{ROUNDS}) AS codebooks_sha256 FROM kept JOIN codes USING (i)"""
