"""Names of a dimension in texts, as a join.

A name is known by its first letters, SHOWN of them or all if it has fewer. A text emits what it has of that length at
each of its places (or at its start alone), as hashes; both meet by these, and what meets is verified. So each text is
looked at once, however many names there are, and no names are sent to all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.storage import stored

SHOWN = 8


def _known(names: DataFrame, name: Column, label: str, order: str) -> DataFrame:
    """o, n (the name as it is), p (what is looked for) and key; names that are null are left out."""
    own = names.select(F.col(order).alias("o"), F.col(label).alias("n"), name.alias("p")).where("p IS NOT NULL")
    size = F.least(F.char_length("p"), F.lit(SHOWN))
    return stored(own.withColumn("size", size).withColumn("key", F.xxhash64("size", F.expr(f"substring(p, 1, {SHOWN})"))), "names")


def _sizes(known: DataFrame) -> list[int]:
    return sorted(r["size"] for r in known.select("size").distinct().collect())  # SHOWN + 1 values at most


def _rows(df: DataFrame) -> DataFrame:
    """The rows with a number of their own, which stays as they are written."""
    return stored(df.withColumn("_row", F.monotonically_increasing_id()), "texts")


def last_containing(df: DataFrame, names: DataFrame, text: str, name: str, order: str) -> DataFrame:
    """Of the names that stand anywhere in a text, the last by order; texts without any are left out. An empty name stands in all texts."""
    known = _known(names, F.col(name), name, order)
    rows = _rows(df)
    chars = rows.where(F.col(text).isNotNull()).select("_row", F.col(text).alias("_t"), F.split(text, "").alias("c"))
    at = lambda n: F.transform(F.sequence(F.lit(1), F.size("c") - (n - 1)), lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice("c", i, n), "")))
    none = F.array().cast("array<bigint>")
    keys = [F.when(F.char_length("_t") >= n, at(n)).otherwise(none) if n else F.array(F.xxhash64(F.lit(0), F.lit(""))) for n in _sizes(known)]
    asks = chars.select("_row", "_t", F.explode(F.array_distinct(F.concat(none, *keys))).alias("key"))
    met = asks.join(known, "key").where(F.contains("_t", F.col("p")))
    best = met.groupBy("_row").agg(F.max(F.struct("o", "n")).alias("_hit"))
    return rows.join(best, "_row").select(*[f"`{c}`" for c in df.columns], F.col("_hit.n").alias(name))


def first_prefix_match(df: DataFrame, names: DataFrame, text: str, name: str, order: str) -> DataFrame:
    """Of the names that a text starts with, the first by order, without regard to case and outer spaces. Names are texts, not patterns; empty ones match nothing."""
    known = _known(names.where(F.trim(F.col(name)) != ""), F.lower(F.trim(F.col(name))), name, order)
    rows = _rows(df)
    own = rows.select("_row", F.lower(F.trim(F.col(text))).alias("_t")).where("_t <> ''")
    keys = [F.when(F.char_length("_t") >= n, F.xxhash64(F.lit(n), F.expr(f"substring(_t, 1, {n})"))) for n in _sizes(known)]
    asks = own.select("_row", "_t", F.explode(F.array_compact(F.array(F.lit(None).cast("bigint"), *keys))).alias("key"))
    met = asks.join(known, "key").where(F.startswith("_t", F.col("p")))
    best = met.groupBy("_row").agg(F.min(F.struct("o", "n")).alias("_hit"))
    return rows.join(best, "_row").select(*[f"`{c}`" for c in df.columns], F.col("_hit.n").alias(name), F.col("_hit.o").alias(order))
