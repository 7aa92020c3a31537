"""Tables that plans write on the way, in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors share.

    Where it is unset, a temporary one will do only if driver and executors are one process (local mode).
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root and sc._jsc.sc().getCheckpointDir().isDefined():
        root = sc._jsc.sc().getCheckpointDir().get()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomwright-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    return f"{root}/loomwright/{sc.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a written table: a short lineage, and the same rows each time it is read."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_table(df: DataFrame, path: str) -> None:
    """Writes df over the table it may have been read from: first beside it, then in its place.

    The old table keeps its rows under another name until the new one is there; if a crash comes between,
    recover_table() puts it back.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    recover_table(spark, path)
    beside, before = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old"
    df.write.parquet(beside)
    (at, fs), (new, _), (old, _) = (_file_system(spark, p) for p in (path, beside, before))
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"{path} could not be moved to {before}")
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise OSError(f"{beside} could not be moved to {path}")
    fs.delete(old, True)


def recover_table(spark: SparkSession, path: str) -> None:
    """After a crash within replace_table(): the old table is put back if the new one has not taken its place."""
    path = path.rstrip("/")
    (at, fs), (old, _) = (_file_system(spark, p) for p in (path, f"{path}.old"))
    if fs.exists(old):
        if fs.exists(at):
            fs.delete(old, True)
        elif not fs.rename(old, at):
            raise OSError(f"{path}.old could not be put back")
