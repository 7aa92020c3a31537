"""Exact duplicates by a tree of merges over sorted runs of digests, in DataFrame operations only.

Each document is a digest entry (SHA-256, with length and a second hash beside it as the check), its id and a leaf of the
tree (a salt of its id). The leaves' runs hold one entry for each digest: the id that stays and a count. In each round the
runs of `fanout` sibling nodes meet: their entries are exchanged by node and slice of the digest, and merged in the order
of their digests (the sort over the runs that arrive; what does not fit into memory is merged from sorted spills). Entries
of one digest then stand side by side, at most `fanout` of them, in the order of their identifiers, so one pass over the
merged run adds up their counts and keeps the last, which holds the largest (or smallest) identifier. Entries are the
same only if digest, length and second hash agree, at every level. After `levels` rounds the root's run is final, still
spread over slices of the digests. The way back goes through the leaves' entries, so that a text that a third of all rows
share is joined as fanout ** levels keys and not as one. The fan-out grows with the number of rows, so that such a key
stays within about ROWS_A_LEAF rows, while the rounds and what they exchange stay the same. Texts are read once: digests
are a table of their own.

Defined results: null text is empty text; rows with a null id are merged like others, are kept only if their group has
no other id, and never win; rows that repeat id and text are one document seen twice, so all of them carry the same
answer; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.llm.common import salt, stored, table

#: Slices of the digests by which the runs of a node are spread: hexadecimal digits.
SLICE_DIGITS = 4
#: Rows that a leaf is for; the fewest runs that meet in a round.
ROWS_A_LEAF, FANOUT = 1_000_000, 4
ENTRY = ["digest", "bytes", "check"]


def fanout_for(rows: int, levels: int, rows_a_leaf: int = ROWS_A_LEAF) -> int:
    """The fewest runs a round (FANOUT at least) with which `levels` rounds have leaves for so many rows."""
    fanout = FANOUT
    while fanout**levels * rows_a_leaf < rows:
        fanout += 1
    return fanout


def digests(docs: DataFrame, id_col: str, text_col: str, digest_bytes: int = 32) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    got = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    digest = F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, digest_bytes)
    return got.select("id", digest.alias("digest"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("check"))


def leaf_runs(rows: DataFrame, keep: str) -> DataFrame:
    """One entry for each leaf and verified digest; counted before anything is exchanged."""
    best = F.max("id") if keep == "max" else F.min("id")
    slice_of = F.substring(F.hex("digest"), 1, SLICE_DIGITS)
    return rows.groupBy(F.col("leaf").alias("node"), slice_of.alias("slice"), *ENTRY).agg(best.alias("keep_id"), F.count("*").alias("group_size"))


def merge_round(runs: DataFrame, keep: str, fanout: int) -> DataFrame:
    """The runs of the parents: the children's runs merged, one entry for each verified digest."""
    up = runs.withColumn("node", F.floor(F.col("node") / fanout).cast("int")).repartition("node", "slice")
    order = F.asc_nulls_first("keep_id") if keep == "max" else F.desc_nulls_first("keep_id")
    run = Window.partitionBy("node", "slice", *ENTRY).orderBy(order)
    both = up.withColumn("_sum", F.sum("group_size").over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_after", F.lead(F.lit(1)).over(run))
    return both.where("_after IS NULL").select("node", "slice", *ENTRY, "keep_id", F.col("_sum").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fanout: int | None = None, levels: int = 3, digest_bytes: int = 32) -> DataFrame:
    """For each row: id, digest, keep_id (the id that stays), group_size, kept. The fan-out follows the number of rows unless given."""
    rows = stored(digests(docs, id_col, text_col, digest_bytes), "digests")
    fanout = fanout or fanout_for(rows.count(), levels)  # counted by the footers of the table's files
    rows = rows.withColumn("leaf", salt(fanout**levels, "id"))
    leaves = leaf_runs(rows, keep)
    runs = leaves
    for _ in range(levels):
        runs = merge_round(runs, keep, fanout)
    root = runs.select(*ENTRY, "keep_id", "group_size")
    back = leaves.select(F.col("node").alias("leaf"), *ENTRY).join(root, ENTRY)
    out = rows.join(back, ["leaf", *ENTRY])
    return out.select("id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def op2_tree_merge_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_groups(table(spark, sf_dir, "documents"), keep="max")
    return got.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
