"""Log records as rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The levels of the log, with two of its own.
LEVELS = {"SKIPPED": -1, "COMPLETE": 0, "DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}


def log_rows(df: DataFrame, key: str, kind: Column, levels: Mapping[str, str], otherwise: str = "INFO") -> DataFrame:
    """key, log_type (the number of a level) and note for each record; the sink appends them."""
    code = F.create_map(*[x for k, v in levels.items() for x in (F.lit(k), F.lit(LEVELS[v]))])
    return df.select(F.col(key), F.coalesce(code[kind], F.lit(LEVELS[otherwise])).alias("log_type"), kind.alias("note"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
