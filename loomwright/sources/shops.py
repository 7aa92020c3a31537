"""Shop pages as frames: search results and product pages, from columns url and html.

Each field that a page lacks is null (the metadata is the empty text); a page that cannot be read loses no other page.
Results keep their place on the page, so the order of a search is a column and not an accident.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import absolute, strip_tags, without_query
from loomwright.operators.joins import lookup
from loomwright.sources.fixed import GENDER_WORDS
from loomwright.sources.web import Page, WebClient

Fetch = Callable[..., "str | Page | None"]
#: Addresses that a task asks for at once: pages of one batch wait for each other's answers, not for one another.
AT_ONCE = 8


def fetch_pages(urls: DataFrame, fetch: Fetch, retry: int = 3) -> DataFrame:
    """url, html, tries, final_url: pages through a client, as WebClient, or a function of an address that gives its text.

    retry = 3 means two tries. A page that stays away has null html and final_url and loses no other; OSErrors and missing
    answers are tried again, other errors end the job.
    """
    more = isinstance(fetch, WebClient)

    def one(url: str | None) -> tuple[str | None, str | None, int, str | None]:
        got, tries = None, 0
        while url is not None and got is None and tries < max(1, retry - 1):
            tries += 1
            try:
                got = fetch(url, tries) if more else fetch(url)
            except OSError:
                got = None
        page = Page(url, got) if isinstance(got, str) else got
        return (url, page.html, tries, page.url) if page else (url, None, tries, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for b in batches:
                yield pd.DataFrame(list(pool.map(one, b["url"])), columns=["url", "html", "tries", "final_url"])

    return urls.select("url").mapInPandas(run, "url string, html string, tries int, final_url string")


def gender(column: str, df: DataFrame, out: str = "gender") -> DataFrame:
    return lookup(df.withColumn(column, F.lower(column)), column, GENDER_WORDS, out)


def _inside(html: Column, mark: str, tag: str) -> Column:
    """The texts of the tags inside the first element whose class has the mark."""
    part = F.regexp_extract(html, rf'(?s)class="[^"]*{mark}[^"]*"[^>]*>(.*?)</div>', 1)
    return F.transform(F.regexp_extract_all(part, F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), 1), lambda t: F.trim(strip_tags(t)))


# --- a shop whose pages carry `window.asos.pdp.config.product` and a router state


def config_product(pages: DataFrame) -> DataFrame:
    """Product pages: url and the fields of the product."""
    schema = "id LONG, name STRING, productCode STRING, images ARRAY<STRUCT<url: STRING>>, gender STRING, brandName STRING, variants ARRAY<STRUCT<colour: STRING>>, productType STRUCT<name: STRING>"
    j = F.from_json(F.regexp_extract("html", r"window\.asos\.pdp\.config\.product = (\{.+\});", 1), schema)
    meta = F.concat(_inside(F.col("html"), "product-description", "li"), F.slice(_inside(F.col("html"), "about-me", "p"), 1, 1))
    df = pages.select("url", j.alias("j"), F.array_join(meta, " - ").alias("metadata"))
    df = df.select("url", F.col("j.name").alias("title"), F.col("j.productCode").alias("code"), F.get("j.images", F.lit(0))["url"].alias("image"), F.col("j.gender").alias("_g"), F.col("j.brandName").alias("brand"), F.get("j.variants", F.lit(0))["colour"].alias("color"), F.col("j.productType.name").alias("category"), F.col("j.id").alias("price_key"), "metadata")
    return gender("_g", df).drop("_g")


def stock_price(replies: DataFrame) -> DataFrame:
    """key and price from replies (key, body) of the price service."""
    return replies.select("key", F.get(F.from_json("body", "ARRAY<STRUCT<productPrice: STRUCT<current: STRUCT<value: DOUBLE>>>>"), F.lit(0))["productPrice"]["current"]["value"].alias("price"))


def router_search(pages: DataFrame, site: str = "https://www.asos.com/uk/", most: int | None = None) -> DataFrame:
    """Search pages: page, place (from 1), url, image, price (the reduced one in a sale)."""
    raw = F.replace(F.regexp_extract("html", r"JSON\.parse.+?(\{\\?\"router\\?\".+\})", 1), F.lit("\\"), F.lit(""))
    schema = "search STRUCT<products: ARRAY<STRUCT<url: STRING, image: STRING, price: DOUBLE, reducedPrice: DOUBLE, isSale: BOOLEAN>>>"
    most_ = F.regexp_extract("html", r'<progress[^>]*max="(\d+)"', 1).try_cast("int")
    # the limit cuts the list before its products become rows, or it would be looked for in the page again for each of them
    products = F.from_json(raw, schema)["search"]["products"]
    shown = F.slice(products, F.lit(1), F.greatest(F.lit(0), F.least(F.coalesce(most_, F.lit(2**31 - 1)), F.lit(2**31 - 1 if most is None else most))))
    df = pages.select(F.col("url").alias("page"), F.posexplode(shown).alias("_i", "p"))
    return df.select("page", (F.col("_i") + 1).alias("place"), F.concat(F.lit(site), "p.url").alias("url"), F.concat(F.lit("https://"), "p.image").alias("image"), F.when(F.col("p.isSale"), F.col("p.reducedPrice")).otherwise(F.col("p.price")).alias("price"))


# --- a shop whose lists come in steps of twelve tiles


def tile_request(pages: DataFrame, newest: bool, start: int = 0, step: int = 12) -> DataFrame:
    """page and the address of the first step of its list, from the model hidden in the page."""
    model = F.from_json(F.regexp_extract("html", r"class=\"[^\"]*hidden jsOVModel[^\"]*\"[^>]*data-ovmodel='([^']*)'", 1), "hitCount INT, urlAjax STRING, params MAP<STRING, STRING>")
    keep = F.map_filter(model["params"], lambda k, v: ~k.isin("qold", "autofilter"))
    parts = F.array_join(F.transform(F.map_entries(keep), lambda e: F.concat(e["key"], F.lit("="), F.replace(e["value"], F.lit(" "), F.lit("%20")), F.lit("&"))), "")
    rule = "srule=newest-products&" if newest else "srule=default&"
    return pages.select(F.col("url").alias("page"), model["hitCount"].alias("hits"), F.concat(model["urlAjax"], F.lit("?"), parts, F.lit(f"{rule}start={start}&sz={step}&lazyloadFollowing=true&view=ajax")).alias("request"))


def tile_search(replies: DataFrame, site: str = "https://www.soliver.eu") -> DataFrame:
    """Steps of a list: page, place, url, image, color, price; each from the first of its places that the tile has."""
    tiles = F.slice(F.split("html", r"<div class=\"[^\"]*js-ovgrid-item"), 2, 2**30)
    df = replies.select(F.col("url").alias("page"), F.posexplode(tiles).alias("_i", "t"))
    x = lambda p: F.nullif(F.regexp_extract("t", p, 1), F.lit(""))
    config = F.from_json(x(r"data-ovlistview-color-config='([^']*)'"), "colorName STRING, images ARRAY<STRUCT<absURL: STRING>>")
    picture = F.from_json(x(r"data-picture='([^']*)'"), "sources ARRAY<STRUCT<srcset: STRING>>")
    money = lambda c: F.replace(F.split(F.trim(c), " ")[0], F.lit(","), F.lit(".")).try_cast("double")
    prices = [money(x(p)) for p in (r'class="ta_price"[^>]*>([^<]*)<', r'class="ta_newPrice"[^>]*>([^<]*)<', r'data-maxprice="([^"]*)"')]
    return df.select(
        "page",
        (F.col("_i") + 1).alias("place"),
        without_query(absolute(x(r'js-ovlistview-productdetaillink"[^>]*href="([^"]*)"'), site)).alias("url"),
        without_query(F.coalesce(F.get(config["images"], F.lit(0))["absURL"], F.get(picture["sources"], F.lit(0))["srcset"])).alias("image"),
        config["colorName"].alias("color"),
        F.coalesce(*prices).alias("price"),
    )


def variant_product(replies: DataFrame) -> DataFrame:
    """Replies of the variant service: url and the fields of the product, the category from the end of its path."""
    schema = "product STRUCT<mainCategoryId: STRING, categoryPath: STRING, variantInfo: STRUCT<variationAttrData: STRUCT<color: STRUCT<displayValue: STRING>>, priceData: STRUCT<salePrice: STRUCT<value: DOUBLE>>, microdata: STRUCT<description: STRING, brand: STRING>>>"
    df = replies.select("url", F.from_json("body", schema)["product"].alias("p"))
    path = F.split("p.categoryPath", "/")
    df = df.select("url", F.col("p.variantInfo.microdata.description").alias("title"), F.col("p.variantInfo.microdata.brand").alias("brand"), F.col("p.variantInfo.variationAttrData.color.displayValue").alias("color"), F.col("p.variantInfo.priceData.salePrice.value").alias("price"), F.when(F.size(path) > 1, F.element_at(path, -2)).alias("category"), F.element_at(path, -1).alias("subcategory"), F.col("p.mainCategoryId").alias("_g"))
    return gender("_g", df).drop("_g")


# --- a shop whose pages carry a GraphQL cache

_MEDIA = "largeDefaultMedia: STRUCT<uri: STRING>, largeMedia: ARRAY<STRUCT<uri: STRING>>"
_ATTRIBUTES = "attributeSuperClusters: ARRAY<STRUCT<id: STRING, clusters: ARRAY<STRUCT<attributes: ARRAY<STRUCT<value: STRING>>>>>>"
_CACHE = f"""graphqlCache MAP<STRING, STRUCT<data: STRUCT<
 product: STRUCT<name: STRING, sku: STRING, uri: STRING, category: STRING, brand: STRUCT<name: STRING>, color: STRUCT<name: STRING>, primaryImage: STRING, displayPrice: STRUCT<current: STRUCT<amount: DOUBLE>>, {_MEDIA}, {_ATTRIBUTES}>,
 entity: STRUCT<silhouette: STRING, navigationTargetGroup: STRING>, collection: STRUCT<entities: STRUCT<totalCount: INT>>>>>"""


def _cache() -> Column:
    return F.map_values(F.from_json(F.regexp_extract("html", r"(?s)<script[^>]*re-data-el-hydrate[^>]*>(.*?)</script>", 1), _CACHE)["graphqlCache"])


def cache_search(pages: DataFrame) -> DataFrame:
    """Search pages: page, place, url, image, brand, title, code, price (cents / 100)."""
    found = F.filter(_cache(), lambda v: v["data"]["product"]["sku"].isNotNull())
    df = pages.select(F.col("url").alias("page"), F.posexplode(F.transform(found, lambda v: v["data"]["product"])).alias("_i", "p"))
    return df.select("page", (F.col("_i") + 1).alias("place"), F.col("p.uri").alias("url"), F.coalesce("p.largeDefaultMedia.uri", F.get("p.largeMedia", F.lit(0))["uri"]).alias("image"), F.col("p.brand.name").alias("brand"), F.col("p.name").alias("title"), F.col("p.sku").alias("code"), (F.col("p.displayPrice.current.amount") / 100).alias("price"))


def cache_product(pages: DataFrame) -> DataFrame:
    """Product pages: color, category, subcategory, gender and metadata (material, details, fit)."""
    df = pages.select("url", _cache().alias("c"))
    first = lambda test, field: F.get(F.filter("c", test), F.lit(0))["data"][field]
    df = df.select("url", first(lambda v: v["data"]["product"]["primaryImage"].isNotNull(), "product").alias("p"), first(lambda v: v["data"]["entity"]["silhouette"].isNotNull(), "entity").alias("e"), first(lambda v: v["data"]["product"]["attributeSuperClusters"].isNotNull(), "product")["attributeSuperClusters"].alias("a"))

    def values(name: str) -> Column:
        cluster = F.get(F.filter("a", lambda x: x["id"] == name), F.lit(0))["clusters"]
        return F.transform(F.get(cluster, F.lit(0))["attributes"], lambda x: x["value"])

    meta = F.concat(F.split(F.get(values("material_care"), F.lit(0)), ","), values("details"), values("size_fit"))
    df = df.select("url", F.col("p.color.name").alias("color"), F.col("e.silhouette").alias("category"), F.col("p.category").alias("subcategory"), F.col("e.navigationTargetGroup").alias("_g"), F.coalesce(F.array_join(meta, " "), F.lit("")).alias("metadata"))
    return gender("_g", df).drop("_g")


def new_articles(found: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Results that the product table has not yet."""
    return found.join(stored.select(key).distinct(), key, "left_anti")


def trend_and_reference(trend: DataFrame, reference: DataFrame) -> DataFrame:
    """Each result of the trend search with its place in the reference search, 0 if it is not there."""
    return trend.withColumnRenamed("place", "trend_order").join(reference.select("url", F.col("place").alias("reference_order")), "url", "left").fillna(0, subset=["reference_order"])


def navigation(pages: DataFrame, name: str = "cloth.+") -> DataFrame:
    """Category trees (a column tree of JSON): category and url of the children of nodes that are named so."""
    nodes = F.from_json("tree", "ARRAY<STRUCT<label: STRING, children: ARRAY<STRUCT<label: STRING, url: STRING>>>>")
    found = pages.select(F.explode(nodes).alias("n")).where(F.lower("n.label").rlike(name)).select(F.explode("n.children").alias("c"))
    return found.select(F.col("c.label").alias("category"), F.col("c.url").alias("url"))
