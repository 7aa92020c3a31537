"""Ordinals, scaling and other things that look at the whole frame, without a window over all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.storage import stored


def ordinal(df: DataFrame, order: Sequence[Column], name: str, start: int = 1) -> DataFrame:
    """Places in a global order: rows are sorted by range, counted by range, and numbered within each."""
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "ordinal")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_id").alias("low")).collect()  # a row for each range
    before, rows = start, []
    for r in sorted(sizes, key=lambda r: r["_part"]):
        rows.append((r["_part"], before - r["low"]))
        before += r["n"]
    shift = df.sparkSession.createDataFrame(rows, "_part int, _shift long")
    return ranged.join(F.broadcast(shift), "_part").withColumn(name, F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """Aggregates of the whole frame beside each row: one row of totals, broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(k) for k, c in totals.items()])))


def min_max(df: DataFrame, columns: dict[str, str], low: float, high: float) -> DataFrame:
    """Columns scaled to low..high over the whole frame; a constant column is low."""
    totals = {f"_{i}{c}": f(c) for c in columns for i, f in (("lo", F.min), ("hi", F.max))}
    df = with_totals(df, **totals)
    for c, out in columns.items():
        span = F.col(f"_hi{c}") - F.col(f"_lo{c}")
        df = df.withColumn(out, F.when(F.col(c).isNotNull(), F.lit(low) + F.lit(high - low) * F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo{c}"), span), F.lit(0.0))))
    return df.drop(*totals)


def linear_rank_score(df: DataFrame, order: Sequence[Column], name: str, best: float = 1.0, worst: float = 0.5, from_last: str | None = None) -> DataFrame:
    """best for the first, worst for the last, evenly between; a lone row is worst. from_last: a column for the place counted from the last, which is 0."""
    df = with_totals(ordinal(df, order, "_rank"), _n=F.count("*"))
    df = df.withColumn(name, F.when(F.col("_n") == 1, F.lit(worst)).otherwise(F.lit(best) - F.lit(best - worst) * F.try_divide(F.col("_rank") - 1, F.col("_n") - 1)))
    return (df.withColumn(from_last, F.col("_n") - F.col("_rank")) if from_last else df).drop("_rank", "_n")


def top_by_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)


def argsort_permutation(df: DataFrame, order: Sequence[Column], arrival: Sequence[Column], rank: str, permutation: str) -> DataFrame:
    """rank: a row's place (from 0) in the order. permutation: the arrival place of the row whose rank is this row's arrival place."""
    both = ordinal(ordinal(df, arrival, "_at", 0), order, rank, 0)
    at = both.select(F.col(rank).alias("_at"), F.col("_at").alias(permutation))
    return both.join(at, "_at").drop("_at")


def relabel_by_first(df: DataFrame, label: str, order: str, out: str) -> DataFrame:
    """Labels numbered from 0 by where they first appear. There are as many rows to number as labels."""
    first = df.groupBy(label).agg(F.min(order).alias("_first"))
    return df.join(ordinal(first, [F.col("_first")], out, 0).drop("_first"), label)


def next_ids(df: DataFrame, table: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Rows with identities that continue those of the table."""
    last = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))
    return ordinal(df, order, key).crossJoin(F.broadcast(last)).withColumn(key, F.col(key) + F.col("_last")).drop("_last")
