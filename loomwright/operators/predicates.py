"""Projections and filters."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def project(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    """A list of columns, or "TOP n" for the first n rows with all columns."""
    if isinstance(columns, str):
        word, n = columns.split()
        if word.upper() != "TOP":
            raise ValueError(f"neither columns nor TOP n: {columns}")
        return df.limit(int(n))
    return df.select(*columns)


def matches(criteria: Mapping[str, object]) -> Column:
    """All of column = value. The text NULL asks for nulls; None and NaN ask for nothing."""
    tests = [F.col(c).isNull() if isinstance(v, str) and v == "NULL" else F.col(c) == F.lit(v) for c, v in criteria.items() if not (v is None or isinstance(v, float) and math.isnan(v))]
    return reduce(and_, tests, F.lit(True))


def any_null(columns: Sequence[str]) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in columns])


def all_null(columns: Sequence[str]) -> Column:
    return reduce(and_, [F.col(c).isNull() for c in columns])


def members(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), list(keys), "left_semi")


def non_members(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def interaction_state(grade: str, irrelevant: str) -> list[Column]:
    """seen, irrelevant and unseen of a row of feedback."""
    bad = F.coalesce(F.col(irrelevant), F.lit(False))
    return [(F.coalesce(F.col(grade) >= 0, F.lit(False)) | bad).alias("seen"), bad.alias("irrelevant"), (F.col(grade).isNull() & ~bad).alias("unseen")]


def rated(column: str, sentinel: float) -> Column:
    """Whether a value is a rating and not the mark for none."""
    return F.col(column).isNotNull() & (F.col(column) != F.lit(sentinel))


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that have no value at all, found in one pass."""
    has = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[f"`{c}`" for c in df.columns if has[c]])


def flags_on(df: DataFrame, keys: Sequence[str], flags: Sequence[str], name: str = "flag") -> DataFrame:
    """The names, lowered, of each row's flag columns that are true."""
    long = df.unpivot(list(keys), [F.col(c).cast("boolean").alias(c) for c in flags], name, "_on")
    return long.where("_on").select(*keys, F.lower(name).alias(name))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def infer_numbers(df: DataFrame) -> DataFrame:
    """Text columns as doubles where each value is a number; otherwise as they are."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS double)").isNull()).alias(c) for c in texts]).first()
    return df.withColumns({c: F.col(c).cast("double") for c in texts if not bad[c]})


def last_row(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.desc(key)).limit(1)
