"""The crawl of a shop's search, from its pages to the tables of products and of their ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.operators.dml import upsert
from loomwright.operators.ranking import next_ids
from loomwright.sources.adapters import adapter as named
from loomwright.sources.shops import trend_and_reference


def found_articles(trend: DataFrame, reference: DataFrame, adapter: str, most: int | None = None) -> DataFrame:
    """url, image, price, trend_order and reference_order of a search: by trend, with the place in the reference search.

    trend and reference: pages (url, html) of the two orders of the search, page after page by url. Of articles that
    come again the first place counts.
    """
    search = named(adapter)
    if search is None:
        raise ValueError(f"no source for {adapter!r}")

    def places(pages: DataFrame) -> DataFrame:
        got = search(pages)
        columns = [c for c in ("image", "price") if c in got.columns]
        # a page's places come after those of the pages before it
        sizes = got.groupBy("page").agg(F.max("place").alias("n"))
        first = sizes.alias("a").join(sizes.alias("b"), F.col("b.page") < F.col("a.page"), "left").groupBy(F.col("a.page").alias("page")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))  # a search has some dozens of pages
        ranked = got.join(F.broadcast(first), "page").withColumn("place", F.col("place") + F.col("before"))
        return ranked.where("url IS NOT NULL").groupBy("url").agg(*[F.min_by(c, "place").alias(c) for c in columns], F.min("place").cast("int").alias("place"))

    both = trend_and_reference(places(trend), places(reference))
    return both if most is None else both.where(F.col("trend_order") <= most)


def register(found: DataFrame, products: DataFrame, history: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Products (oid, url, ...) and history (oid, product, at, reference_order, trend_order, price) after a crawl.

    Known products keep their oid and take new values, others get one; each article gets a row of history.
    """
    values = [c for c in ("image", "price") if c in found.columns and c in products.columns]
    grown = upsert(products, found.select("url", *values), ["url"], "oid", [F.col("url")])
    rows = found.join(grown.select("url", F.col("oid").alias("product")), "url")
    price = F.col("price") if "price" in found.columns else F.lit(None)
    rows = rows.select("product", F.lit(at).cast("timestamp").alias("at"), "reference_order", "trend_order", price.cast("double").alias("price"))
    return grown, history.unionByName(next_ids(rows, history, "oid", [F.col("product")]), allowMissingColumns=True)
