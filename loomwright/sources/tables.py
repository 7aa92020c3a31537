"""Tables, delimited files and other plain sources."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of an outer database; partitionColumn, lowerBound, upperBound and numPartitions split it."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", tasks: int = 8, **options: str) -> None:
    """Rows into a table of an outer database, over a bounded number of connections, in batches.

    Changes of known rows go the way the library's own do: update_by_key() or upsert() over what read_jdbc() gave, then
    mode "overwrite" with truncate, which keeps the table's definition; binary columns are bound as parameters.
    """
    made = {"truncate": "true", "batchsize": "5000"} | options
    df.coalesce(tasks).write.format("jdbc").mode(mode).options(url=url, dbtable=table, **made).save()


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def read_csv_dimension(lines: DataFrame, schema: str) -> DataFrame:
    """Dimension rows from a column `value` of CSV lines without a header."""
    return lines.select(F.from_csv("value", schema).alias("r")).select("r.*")


def word_list(lines: DataFrame) -> DataFrame:
    """The distinct words of a column `value` of comma-delimited lines."""
    return lines.select(F.explode(F.split("value", ",")).alias("word")).select(F.trim("word").alias("word")).where("word <> ''").distinct()


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    return word_list(spark.read.text(path))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole files: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """Writes a file below the folder for each row (name, content); gives name and bytes of those written.

    Tasks write, each file whole under another name first, so a task that runs twice leaves the same files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for b in batches:
            for name, content in zip(b["name"], b["content"], strict=True):
                at = f"{top}/{name}"
                store.create_dir(at.rpartition("/")[0], recursive=True)
                beside = f"{at.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as f:
                    f.write(bytes(content))
                store.move(beside, at)
            yield pd.DataFrame({"name": b["name"], "bytes": [len(c) for c in b["content"]]})

    return df.select("name", "content").mapInPandas(run, "name string, bytes long")


def newest_model(spark: SparkSession, folder: str, name: str) -> str | None:
    """The last changed entry of a folder whose name contains the given one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getModificationTime(), s.getPath().toString()) for s in (fs.listStatus(path) if fs.exists(path) else []) if name in s.getPath().getName()]
    return max(found)[1] if found else None


def remove_model(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
