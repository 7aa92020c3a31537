"""Placement of rows on shards through a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table (an offset and a step from a digest of its
name). The shards take turns: each claims the first free slot of its permutation, until none is free. So each shard
owns the same number of slots, give or take one, and the loss of a shard moves little but its own slots. The table
holds `table_size` rows whatever the input, so it is broadcast; a row's place is one digest and one lookup.

Defined results: a null key is placed as the empty text; equal keys share a shard; an empty table gives no rows; other
columns are kept by place_rows(), but for those named like its own, and left out by the query.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import only, table

N_SHARDS, TABLE_SIZE = 64, 8191


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(name: str, table_size: int) -> tuple[int, int]:
    """Offset and step of a shard's permutation of the slots."""
    digest = hashlib.md5(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % table_size, int.from_bytes(digest[8:], "big") % (table_size - 1) + 1


def lookup_table(names: list[str], table_size: int = TABLE_SIZE) -> np.ndarray:
    """For each slot, the index of the shard that claimed it."""
    if not is_prime(table_size):
        raise ValueError(f"{table_size} is not prime: some steps would not reach all slots")
    if not 0 < len(names) <= table_size or len(set(names)) < len(names):
        raise ValueError("there must be at least one shard, no more than slots, and no name twice")
    owner = np.full(table_size, -1, np.int32)
    at, step = map(list, zip(*(preference(x, table_size) for x in names), strict=True))
    for claimed in range(table_size):
        j = claimed % len(names)
        while owner[at[j]] >= 0:
            at[j] = (at[j] + step[j]) % table_size
        owner[at[j]] = j
    return owner


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def slot_of(key: Column | str, table_size: int = TABLE_SIZE) -> Column:
    """60 bits of the key's digest, modulo the table's size."""
    digest = F.md5(F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(table_size)).cast("int")


def place_rows(df: DataFrame, key: Column | str = "doc_id", names: list[str] | None = None, table_size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with its slot and the index of its shard; no shuffle."""
    owner = lookup_table(names or shard_names(N_SHARDS), table_size)
    rows = [(i, int(x)) for i, x in enumerate(owner)]
    lookup = df.sparkSession.createDataFrame(rows, f"`{slot_col}` int, `{shard_col}` int")
    return df.drop(slot_col, shard_col).withColumn(slot_col, slot_of(key, table_size)).join(F.broadcast(lookup), slot_col)


def write_shards(df: DataFrame, path: str, key: str = "doc_id", names: list[str] | None = None, table_size: int = TABLE_SIZE, rows_per_file: int = 1_000_000) -> None:
    """Writes a folder for each shard; its rows are split over as many tasks as their number asks for, by a salt of the row."""
    placed = place_rows(df, key, names, table_size)
    n = len(names or shard_names(N_SHARDS))
    each = max(1, -(-df.count() // (n * rows_per_file)))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`").cast("string") for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]), F.lit(each))
    placed.repartition(n * each, "shard", spread).write.mode("overwrite").partitionBy("shard").parquet(path)


def op4_permutation_table_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), ["doc_id"])
    return place_rows(docs).select("doc_id", "slot", "shard")


def op4_sql() -> str:
    """The same placement with the claimed slots as a literal list; tests hold the claiming against brute force."""
    owner = ", ".join(map(str, lookup_table(shard_names(N_SHARDS))))
    return f"""
    WITH s AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {TABLE_SIZE} AS INTEGER) AS slot FROM documents),
         t AS (SELECT [{owner}] AS owner)
    SELECT s.doc_id, s.slot, CAST(t.owner[s.slot + 1] AS INTEGER) AS shard FROM s, t"""
