"""Connected components of a table of links by alternating large-star and small-star steps.

Each step joins links with the smallest neighbour of each node and replaces them; the links end as stars around the
smallest node of each component. A node that has more than one in HOT_SHARE of all links meets its smallest neighbour by
a broadcast: there are at most HOT_SHARE such nodes, however many links there are. All others are joined by an exchange,
so no task of that holds more than its share. Every step is written to the shared folder, so lineage is short and a lost
executor costs one step. Links never reach the driver: only their count and checksum do.

Defined results: links are undirected, may repeat, and a link of a node with itself counts as nothing; null ends are
left out; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import stored

#: The most nodes that are broadcast.
HOT_SHARE = 1000


def _signature(links: DataFrame) -> tuple[int, int]:
    """Number and checksum of the links."""
    r = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return int(r["n"]), int(r["s"] or 0)


def _beside_smallest(links: DataFrame, total: int) -> DataFrame:
    """links (total rows) with m, the smallest b of each a."""
    by = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
    hot = by.where(F.col("c") * HOT_SHARE > total).select("a", F.col("m").alias("h"))  # HOT_SHARE rows at most
    marked = links.join(F.broadcast(hot), "a", "left")
    cold = marked.where("h IS NULL").select("a", "b").join(by.select("a", "m"), "a")
    return marked.where("h IS NOT NULL").select("a", "b", F.col("h").alias("m")).unionByName(cold)


def _large_star(links: DataFrame, total: int) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = _beside_smallest(both, 2 * total).where("b > a")
    return near.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b")


def _small_star(links: DataFrame, total: int) -> DataFrame:
    near = _beside_smallest(links, total)
    return near.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("l")).select("l.a", "l.b").where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node reachable) of each node that has a link."""
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    links = stored(links, "links")
    before = _signature(links)
    while before[0]:
        wide = stored(_large_star(links, before[0]), "wide")  # as many links as before
        links = stored(_small_star(wide, before[0]), "links")
        now = _signature(links)
        if now == before:
            break
        before = now
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
