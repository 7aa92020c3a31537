"""What several operators of this subpackage share: inputs, scratch tables on shared storage, salting."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.storage import scratch_path, scratch_root, stored

__all__ = ["BATCH_ROWS", "SPACE", "WORD", "arrow_batched", "batched", "beside", "drop_scratch", "only", "salt", "scratch_path", "scratch_root", "stored", "table", "texts_of", "unused"]

#: Separators of words: the ASCII white space, and nothing else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a Python worker takes up at once.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_scratch(spark: SparkSession) -> None:
    """Removes the scratch tables of this application; results still being read need them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def batched(df: DataFrame, run: Callable, schema: str | T.StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """df.mapInPandas, where `run` sees at most `rows` rows at once. A 64-bit column with nulls must not pass through: pandas rounds it.

    A batch that Spark sends holds at most spark.sql.execution.arrow.maxRecordsPerBatch rows and about
    spark.sql.execution.arrow.maxBytesPerBatch bytes (one row may be longer), as the session has them.
    """

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), rows):
                yield b.iloc[i : i + rows].reset_index(drop=True)

    return df.mapInPandas(lambda batches: run(parts(batches)), schema)


def arrow_batched(df: DataFrame, run: Callable, schema: str | T.StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """df.mapInArrow, where `run` sees at most `rows` rows at once; columns that pass through keep every value and null."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)

    return df.mapInArrow(lambda batches: run(parts(batches)), schema)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a column; null is empty."""
    return [t if isinstance(t, str) else "" for t in batch.column(name).to_pylist()]


def beside(kept: pa.RecordBatch | pa.Array, made: dict[str, Sequence], name: str = "") -> pa.RecordBatch:
    """A batch of columns that pass through (or one, with its name), and made ones after them."""
    names, arrays = (list(kept.schema.names), list(kept.columns)) if isinstance(kept, pa.RecordBatch) else ([name], [kept])
    return pa.RecordBatch.from_arrays([*arrays, *[x if isinstance(x, pa.Array) else pa.array(x) for x in made.values()]], names=[*names, *made])


def salt(n: int, *by: Column | str) -> Column:
    """One of n salts, the same in each attempt of a task."""
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def only(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns alone: extra ones may have any name."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
