"""Streams beside the batch plans: rank history, new products, feedback and the log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwright.operators.dml import upsert
from loomwright.operators.online import learn
from loomwright.storage import recover_table, replace_table


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_ranks(history: DataFrame, at: str, key: str, rank: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """The best and mean rank of a product by window; rows later than the watermark are left out."""
    return history.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), key).agg(F.min(rank).alias("best"), F.avg(rank).alias("mean"), F.count("*").alias("n"))


def first_seen(products: DataFrame, at: str, key: str, late: str = "2 days") -> DataFrame:
    """Each key once within the watermark."""
    return products.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), user).agg(F.count("*").alias("n"))


def upsert_stream(rows: DataFrame, path: str, unique: Sequence[str], key: str, checkpoint: str, last: Sequence[Column] = (), **trigger: object) -> StreamingQuery:
    """Each batch into the table at path: known keys take new values, others get identities.

    A batch that comes again after a crash gives the same table, as its keys are known by then and only the last batch
    can come again. Of rows of a batch that repeat a key the last by `last` counts.
    """

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        recover_table(spark, path)
        replace_table(upsert(spark.read.parquet(path), batch, list(unique), key, [F.col(u) for u in unique], last), path)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def feedback_stream(feedback: DataFrame, w: DataFrame, item: str, path: str, **trigger: object) -> StreamingQuery:
    """Each batch of feedback (user, seq, item, rating, irrelevant) into the session at path, which holds the checkpoint too.

    A batch's number is that of the version it makes, so one that comes again after a crash changes nothing.
    """
    each = lambda batch, n: learn(path, w, batch, item, n + 1)
    return feedback.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(**trigger or {"availableNow": True}).start()


def log_stream(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return records.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, as a table in memory: for small results and tests."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
