"""Changes to tables as functions from tables to tables; storage.replace_table writes the result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators.predicates import matches
from loomwright.operators.ranking import next_ids


def insert(target: DataFrame, rows: DataFrame, key: str, order: Sequence[Column], owner: str | None = None) -> DataFrame:
    """The rows appended with new identities; CreatedBy and UpdatedBy are filled where the target has them."""
    if owner is not None:
        for c in ("CreatedBy", "UpdatedBy"):
            if c in target.columns and c not in rows.columns:
                rows = rows.withColumn(c, F.lit(owner))
    return target.unionByName(next_ids(rows, target, key, order), allowMissingColumns=True)


def insert_literals(target: DataFrame, key: str, rows: Sequence[Mapping[str, object]]) -> DataFrame:
    """The rows of a statement that spells them out, appended in its order with the identities that follow.

    Columns that a row lacks are null; columns that the target lacks are an error. There are as many as a program writes.
    """
    fields = [f for f in target.schema.fields if f.name != key]
    unknown = {c for r in rows for c in r} - {f.name for f in fields}
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    if not rows:
        return target
    kind, name = target.schema[key].dataType, lambda f: f"`{f.name}` {f.dataType.simpleString()}"
    made = target.sparkSession.createDataFrame([(i, *[r.get(f.name) for f in fields]) for i, r in enumerate(rows, 1)], ", ".join(["_nth long", *map(name, fields)]))
    last = target.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))
    new = made.crossJoin(F.broadcast(last)).withColumn(key, (F.col("_last") + F.col("_nth")).cast(kind))
    return target.unionByName(new.drop("_nth", "_last"))


def _absent(rows: DataFrame, target: DataFrame, unique: Sequence[str]) -> DataFrame:
    """The rows whose unique columns the target has not; null is a value like others."""
    known = target.select(*[F.col(u).alias(f"_k{i}") for i, u in enumerate(unique)])
    same = reduce(lambda a, b: a & b, [F.col(u).eqNullSafe(F.col(f"_k{i}")) for i, u in enumerate(unique)])
    return rows.join(known, same, "left_anti")


def insert_if_absent(target: DataFrame, rows: DataFrame, unique: Sequence[str], key: str, order: Sequence[Column]) -> DataFrame:
    """Rows whose unique columns (null included) the target has not yet; of several alike among them the first comes."""
    new = _absent(rows, target, unique)
    rest = [c for c in rows.columns if c not in unique]
    new = new.groupBy(*unique).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*unique, *[F.col("_r")[c].alias(c) for c in rest]) if rest else new.distinct()
    return target.unionByName(next_ids(new, target, key, [F.col(u) for u in unique]), allowMissingColumns=True)


def get_or_create(target: DataFrame, rows: DataFrame, unique: Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
    """The grown dimension, and the rows with its key; null is a value like others."""
    grown = insert_if_absent(target, rows.select(*unique).distinct(), unique, key, [F.col(u) for u in unique])
    named = grown.select(*[F.col(u).alias(f"_k{i}") for i, u in enumerate(unique)], key)
    same = reduce(lambda a, b: a & b, [F.col(u).eqNullSafe(F.col(f"_k{i}")) for i, u in enumerate(unique)])
    return grown, rows.join(named, same).drop(*[f"_k{i}" for i in range(len(unique))])


def update_first(target: DataFrame, criteria: Mapping[str, object], values: Mapping[str, Column], key: str, stamp: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Changes the match with the lowest key alone. Gives the new table and the matches as they were before."""
    hit = target.where(matches(criteria))
    first = hit.agg(F.min(key).alias("_first"))
    out = target.crossJoin(F.broadcast(first))
    values = dict(values) | ({stamp: F.current_timestamp()} if stamp else {})
    for c, v in values.items():
        out = out.withColumn(c, F.when(F.col(key) == F.col("_first"), v.cast(target.schema[c].dataType)).otherwise(F.col(c)))
    return out.drop("_first"), hit


def one_change(changes: DataFrame, unique: Sequence[str], order: Sequence[Column] = (), strict: bool = True) -> DataFrame:
    """A row for each key: the last change by the order, equal ones by their values. Without strict, the last value of each column that is not null."""
    named = [c for c in changes.columns if c not in unique]
    if not named:
        return changes.distinct()
    last = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c) for c in named])
    if strict:
        return changes.groupBy(*unique).agg(F.max_by(F.struct(*named), last).alias("_r")).select(*unique, *[F.col("_r")[c].alias(c) for c in named])
    return changes.groupBy(*unique).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), last)).alias(c) for c in named])


def update_by_key(target: DataFrame, changes: DataFrame, key: str, strict: bool = False, order: Sequence[Column] = ()) -> DataFrame:
    """Columns of the changes over those of the target. A null in the changes keeps the old value, or with strict sets null.

    Of changes that repeat a key the last by `order` counts (columns of the changes; those that the target has not are
    for the order only), so the table keeps its rows; a null key changes nothing.
    """
    changes = one_change(changes, [key], order, strict)
    named = [c for c in changes.columns if c != key and c in target.columns]
    new = changes.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in named])
    out = target.join(new, key, "left")
    for c in named:
        n = F.col(f"_new_{c}").cast(target.schema[c].dataType)
        out = out.withColumn(c, F.when(F.col("_hit"), n).otherwise(F.col(c)) if strict else F.coalesce(n, F.col(c)))
    return out.select(*target.columns)


def upsert(target: DataFrame, rows: DataFrame, unique: Sequence[str], key: str, order: Sequence[Column], last: Sequence[Column] = ()) -> DataFrame:
    """Known rows take the given values, unknown ones are appended with new identities, in `order`.

    Of rows that repeat their unique columns (null included) the last by `last` counts.
    """
    rows = one_change(rows, unique, last)
    named = [c for c in rows.columns if c not in unique]
    new = rows.select(*[F.col(u).alias(f"_k{i}") for i, u in enumerate(unique)], F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in named])
    out = target.join(new, reduce(lambda a, b: a & b, [F.col(u).eqNullSafe(F.col(f"_k{i}")) for i, u in enumerate(unique)]), "left")
    for c in named:
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)))
    return out.select(*target.columns).unionByName(next_ids(_absent(rows, target, unique), target, key, order), allowMissingColumns=True)


def seed(target: DataFrame, rows: DataFrame, name: str, key: str) -> DataFrame:
    """Rows of a dimension whose name, whatever its case, is new."""
    known = target.select(F.lower(name).alias("_n"))
    new = rows.withColumn("_n", F.lower(name)).join(known, "_n", "left_anti").dropDuplicates(["_n"]).drop("_n")
    return target.unionByName(next_ids(new.drop(key), target, key, [F.col(name)]), allowMissingColumns=True)


def reload(target: DataFrame, rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """All rows replaced, numbered anew from 1."""
    return insert(target.limit(0), rows, key, order).select(*target.columns)


def fill_sentinel(df: DataFrame, columns: Sequence[str], value: int = -1) -> DataFrame:
    return df.fillna(value, subset=list(columns))


def reset(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.lit(None).cast(df.schema[column].dataType))


def orphans(child: DataFrame, parent: DataFrame, foreign: str, key: str) -> DataFrame:
    """Rows whose foreign key has no parent: what a constraint would refuse."""
    return child.where(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias(foreign)), foreign, "left_anti")
