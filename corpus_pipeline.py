"""The corpus pipeline: toxicity, line dedup, near-dedup, packing.

Each stage takes the documents that its predecessor kept, as a table, and works on all of them; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import WORD, stored, table, unused
from loomwright.llm.line_dedup import dedup_lines
from loomwright.llm.minhash import near_duplicates
from loomwright.llm.packing import pack_documents
from loomwright.llm.toxicity import score, table_labels, toxicity_chain


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the chain flags as toxic. Null and empty texts are never flagged."""
    labels = table_labels(spark, sf_dir)
    more, taken = "", {c.lower() for c in docs.columns}
    while taken & {f"{kind}_{c}{more}" for kind in ("p", "is") for c in ("junk", "toxic")}:
        more += "_"
    names = [f"junk{more}", f"toxic{more}"]  # no column of docs has the name of a result
    chain = toxicity_chain(docs, labels.toDF("doc_id", *names), names)
    return score(docs, chain).where(f"NOT is_toxic{more}").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that stand in an earlier document or earlier in the same; documents that lose all their words go."""
    gone = unused(docs, "gone")
    out = dedup_lines(docs, gone_col=gone)
    left = out.where((F.size(gone) == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.size(gone) == 0, F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    Of rows that repeat an id all stay if their document does; rows without an id stay.
    """
    gone = near_duplicates(docs, k=5, threshold=80).where("NOT kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their place in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier chain nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
