"""Connected components and spanning forests, by smallest labels, contraction and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.storage import stored


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and component (its smallest node) for each node with a link. Each round is written, so lineage stays short."""
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = stored(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        hop = label.select(F.col("a").alias("l"), F.col("l").alias("h"))
        new = label.join(near, "a").join(hop, "l", "left").select("a", F.least("l", "m", F.coalesce("h", "l")).alias("n"), "l")
        new = stored(new, "labels")
        if not new.where("n <> l").limit(1).count():
            return label.select(F.col("a").alias("node"), F.col("l").alias("component"))
        label = new.select("a", F.col("n").alias("l"))


def _top(pointers: DataFrame) -> DataFrame:
    """a and p: pointers (a to p, cycles of two at most) followed to the end; the smaller node of a cycle is its end."""
    back = pointers.select(F.col("a").alias("p"), F.col("p").alias("q"))
    now = stored(pointers.join(back, "p", "left").select("a", F.when((F.col("q") == F.col("a")) & (F.col("a") < F.col("p")), F.col("a")).otherwise(F.col("p")).alias("p")), "pointers")
    while True:
        hop = now.select(F.col("a").alias("p"), F.col("p").alias("q"))
        step = stored(now.join(hop, "p", "left").select("a", F.coalesce("q", "p").alias("q"), (F.coalesce("q", "p") != F.col("p")).alias("moved")), "pointers")
        now = step.select("a", F.col("q").alias("p"))
        if step.where("moved").isEmpty():
            return now


def spanning_forest(links: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """a < b and weight of the links of a spanning forest of least weight; ties go by (a, b), so it is the only one.

    Boruvka's rounds: every component takes its lightest link to another, what is linked is contracted, and links within
    a component go. The components at least halve each round. Each round is written; nothing reaches the driver.
    """
    ends = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(weight).alias("w")).where("a <> b")
    left = stored(ends.groupBy("a", "b").agg(F.min("w").alias("w")).select(F.col("a").alias("p"), F.col("b").alias("q"), F.struct("w", "a", "b").alias("e")), "links")
    taken = []
    while not left.isEmpty():
        both = left.union(left.select(F.col("q").alias("p"), F.col("p").alias("q"), "e"))
        best = stored(both.groupBy("p").agg(F.min(F.struct("e", "q")).alias("x")).select(F.col("p").alias("a"), F.col("x.q").alias("p"), "x.e"), "chosen")
        taken.append(best.select("e.*").distinct())
        top = _top(best.select("a", "p"))
        first = top.select(F.col("a").alias("p"), F.col("p").alias("p2"))
        second = top.select(F.col("a").alias("q"), F.col("p").alias("q2"))
        moved = left.join(first, "p", "left").join(second, "q", "left").select(F.coalesce("p2", "p").alias("p"), F.coalesce("q2", "q").alias("q"), "e").where("p <> q")
        # of links between the same two components only the lightest can be taken
        lightest = moved.groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.min("e").alias("e"))
        left = stored(lightest, "links")
    out = taken[0] if taken else left.select("e.*")
    for t in taken[1:]:
        out = out.union(t)
    return out.select("a", "b", F.col("w").alias(weight))
