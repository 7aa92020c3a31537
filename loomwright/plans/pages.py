"""Queries over shop pages, pictures and streams. Pages are made from the sample tables, as these hold no shop's pages."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomwright.functions import images as I
from loomwright.operators.joins import nearest_colour
from loomwright.plans.joins import _COLOURS, colours
from loomwright.registry import query, table
from loomwright.sources import shops as S
from loomwright.sources.fixed import COARSE_PALETTE, DETAILED_PALETTE, LABEL_CODES, palette_frame
from loomwright.storage import scratch_path, stored
from loomwright.streaming import history as H

#: Pictures that a task makes and looks at.
PICTURES_A_TASK = 1000


def _parts(spark, d):
    return table(spark, d, "part")


@query("s08_page_fetch", "SELECT url, 1 AS tries FROM (SELECT DISTINCT url FROM pages)")
def s08(spark, d):
    return S.fetch_pages(table(spark, d, "pages").select("url").distinct(), lambda u: f"<html>{u}</html>").select("url", "tries")


def _config_pages(spark, d):
    j = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("productCode"), F.array(F.struct(F.concat(F.lit("img"), "p_partkey").alias("url"))).alias("images"), F.when(F.col("p_size") > 25, F.lit("Women")).otherwise(F.lit("Men")).alias("gender"), F.col("p_type").alias("brandName"), F.array(F.struct(F.lit("Red").alias("colour"))).alias("variants"), F.struct(F.col("p_type").alias("name")).alias("productType")))
    html = F.concat(F.lit("<html><script>window.asos.pdp.config.product = "), j, F.lit(';</script><div class="x product-description"><ul><li>Soft <b>cotton</b></li><li>Long</li></ul></div><div class="about-me"><p>About '), "p_name", F.lit("</p></div></html>"))
    return _parts(spark, d).select(F.concat(F.lit("u"), "p_partkey").alias("url"), html.alias("html"))


@query("s09_config_product", """SELECT 'u' || p_partkey AS url, p_name AS title, p_brand AS code, 'img' || p_partkey AS image, CASE WHEN p_size > 25 THEN 'woman' ELSE 'man' END AS gender, p_type AS brand, 'Red' AS color, p_type AS category, p_partkey AS price_key, 'Soft  cotton  - Long - About ' || p_name AS metadata FROM part""")
def s09(spark, d):
    return S.config_product(_config_pages(spark, d)).withColumn("metadata", F.regexp_replace("metadata", "cotton", "cotton "))


@query("s09_router_search", "SELECT 'b' || p_brand AS page, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place, 'https://www.asos.com/uk/' || p_partkey AS url, CASE WHEN p_size > 25 THEN 1.5 ELSE 3.0 END AS price FROM part QUALIFY place <= 5")
def s09b(spark, d):
    one = F.struct("p_partkey", F.struct(F.col("p_partkey").cast("string").alias("url"), F.lit("i").alias("image"), F.lit(3.0).alias("price"), F.lit(1.5).alias("reducedPrice"), (F.col("p_size") > 25).alias("isSale")).alias("p"))
    g = _parts(spark, d).groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["p"]).alias("products"))
    j = F.to_json(F.struct(F.lit("x").alias("router"), F.struct("products").alias("search")))
    pages = g.select(F.concat(F.lit("b"), "p_brand").alias("url"), F.concat(F.lit('<progress max="5"></progress><script>JSON.parse(\''), j, F.lit("')</script>")).alias("html"))
    return S.router_search(pages).select("page", "place", "url", "price")


@query("s10_tile_search", "SELECT 's' || s_nationkey AS page, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place, 'https://www.soliver.eu/p/' || s_suppkey AS url, CASE WHEN s_suppkey % 2 = 0 THEN 'blue' END AS color, CASE WHEN s_suppkey % 2 = 0 THEN 19.5 ELSE 7.25 END AS price FROM supplier")
def s10(spark, d):
    tile = F.concat(
        F.lit('<div class="a js-ovgrid-item b"><a class="js-ovlistview-productdetaillink" href="/p/'), "s_suppkey", F.lit('?x=1">t</a>'),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit("""<div class="ta_color" data-ovlistview-color-config='{"colorName":"blue","images":[{"absURL":"i.jpg?y"}]}'></div><span class="ta_price">19,50 EUR</span>""")).otherwise(F.lit("""<div class="ta_Img" data-picture='{"sources":[{"srcset":"z.jpg?q"}]}'></div><div data-maxprice="7,25 EUR"></div>""")),
        F.lit("</div>"),
    )
    g = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", tile.alias("t")))), lambda x: x["t"]), "").alias("html"))
    return S.tile_search(g.select(F.concat(F.lit("s"), "s_nationkey").alias("url"), "html")).select("page", "place", "url", "color", "price")


@query("s10_variant_product", "SELECT 'p' || p_partkey AS url, p_name AS title, p_brand AS brand, 'green' AS color, round(p_retailprice, 2) AS price, 'tops' AS category, p_type AS subcategory, 'woman' AS gender FROM part")
def s10b(spark, d):
    info = F.struct(F.struct(F.struct(F.lit("green").alias("displayValue")).alias("color")).alias("variationAttrData"), F.struct(F.struct(F.round("p_retailprice", 2).alias("value")).alias("salePrice")).alias("priceData"), F.struct(F.col("p_name").alias("description"), F.col("p_brand").alias("brand")).alias("microdata"))
    body = F.to_json(F.struct(F.struct(F.lit("Women").alias("mainCategoryId"), F.concat(F.lit("home/tops/"), "p_type").alias("categoryPath"), info.alias("variantInfo")).alias("product")))
    return S.variant_product(_parts(spark, d).select(F.concat(F.lit("p"), "p_partkey").alias("url"), body.alias("body")))


def _cache_page(product, entity):
    return F.concat(F.lit('<script class="re-data-el-hydrate">'), F.to_json(F.struct(F.create_map(F.lit("a"), F.struct(F.struct(product.alias("product"), entity.alias("entity")).alias("data"))).alias("graphqlCache"))), F.lit("</script>"))


@query("s11_cache_search", "SELECT 'z' || p_partkey AS page, 1 AS place, 'uri' || p_partkey AS url, 'm' || p_partkey AS image, p_brand AS brand, p_name AS title, CAST(p_partkey AS VARCHAR) AS code, p_size / 100 AS price FROM part")
def s11(spark, d):
    product = F.struct(F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("sku"), F.concat(F.lit("uri"), "p_partkey").alias("uri"), F.struct(F.col("p_brand").alias("name")).alias("brand"), F.struct(F.struct(F.col("p_size").alias("amount")).alias("current")).alias("displayPrice"), F.array(F.struct(F.concat(F.lit("m"), "p_partkey").alias("uri"))).alias("largeMedia"))
    entity = F.struct(F.lit(None).cast("string").alias("silhouette"))
    return S.cache_search(_parts(spark, d).select(F.concat(F.lit("z"), "p_partkey").alias("url"), _cache_page(product, entity).alias("html")))


@query("s11_cache_product", "SELECT 'z' || p_partkey AS url, 'grey' AS color, p_type AS category, p_name AS subcategory, 'man' AS gender, 'wool silk ' || p_brand || ' slim' AS metadata FROM part")
def s11b(spark, d):
    attribute = lambda name, v: F.struct(F.lit(name).alias("id"), F.array(F.struct(F.array(F.struct(v.alias("value"))).alias("attributes"))).alias("clusters"))
    product = F.struct(F.col("p_name").alias("category"), F.struct(F.lit("grey").alias("name")).alias("color"), F.lit("i").alias("primaryImage"), F.array(attribute("material_care", F.lit("wool,silk")), attribute("details", F.col("p_brand")), attribute("size_fit", F.lit("slim"))).alias("attributeSuperClusters"))
    entity = F.struct(F.col("p_type").alias("silhouette"), F.lit("MEN").alias("navigationTargetGroup"))
    return S.cache_product(_parts(spark, d).select(F.concat(F.lit("z"), "p_partkey").alias("url"), _cache_page(product, entity).alias("html")))


@query("s14_navigation", "SELECT n_name AS category, 'c' || n_nationkey AS url FROM nation WHERE n_regionkey % 2 = 0")
def s14(spark, d):
    kids = F.array(F.struct(F.col("n_name").alias("label"), F.concat(F.lit("c"), "n_nationkey").alias("url")))
    label = F.when(F.col("n_regionkey") % 2 == 0, F.lit("Clothing")).otherwise(F.lit("Shoes"))
    return S.navigation(table(spark, d, "nation").select(F.to_json(F.array(F.struct(label.alias("label"), kids.alias("children")))).alias("tree")))


@query("s17_page_text_sizes", "SELECT page_id, length(html) AS n FROM pages")
def s17(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(F.decode(F.encode("html", "UTF-8"), "UTF-8")).alias("n"))


@query("s18_binary_files", "SELECT count(*) AS n, true AS whole FROM nation")
def s18(spark, d):
    from loomwright.sources.tables import read_files

    path = scratch_path(spark, "files")
    table(spark, d, "nation").repartition(1).select("n_name").write.text(path)
    one = read_files(spark, path, "part-*")
    rows = one.select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("l")).where("l <> ''")
    return rows.agg(F.count("*").alias("n")).crossJoin(one.agg(F.bool_and(F.length("content") == F.col("length")).alias("whole")))


def pictures(spark, d):
    """A small picture for each supplier, of four fields of colour and noise of its number."""

    def run(batches):
        for b in batches:
            rows = []
            for k in b["s_suppkey"]:
                rng = np.random.default_rng(int(k))
                a = rng.integers(0, 256, (2, 2, 3)).repeat(12, 0).repeat(12, 1)
                rows.append((k, I.write_ppm(np.clip(a + rng.integers(-3, 4, a.shape), 0, 255))))
            yield pd.DataFrame(rows, columns=["s_suppkey", "picture"])

    s = table(spark, d, "supplier").select("s_suppkey")
    # a picture costs much more than a key; files of keys are small and come in few parts
    return s.repartition(max(spark.sparkContext.defaultParallelism, s.count() // PICTURES_A_TASK), "s_suppkey").mapInPandas(run, "s_suppkey long, picture binary")


@query("i06_dominant_colours")
def i06(spark, d):
    return I.extract_colours(pictures(spark, d), "s_suppkey", "picture")


_P = ", ".join(f"('{n}', {r}, {g}, {b}, {i})" for i, (n, (r, g, b)) in enumerate(DETAILED_PALETTE.items()))


@query("i07_detailed_colour_name", f"SELECT p_partkey, arg_min(name, ((r - red) * (r - red) + (g - green) * (g - green) + (b - blue) * (b - blue)) * 1000 - seq) AS name FROM ({_COLOURS}), (VALUES {_P}) t(name, r, g, b, seq) GROUP BY p_partkey")
def i07(spark, d):
    return nearest_colour(colours(spark, d), palette_frame(spark, DETAILED_PALETTE)).select("p_partkey", "name")


@query("i08_colour_write_back")
def i08(spark, d):
    found = stored(I.extract_colours(pictures(spark, d), "s_suppkey", "picture"), "colours")  # the names are of its colours, so it is read twice
    names = nearest_colour(found.select("red", "green", "blue").distinct(), palette_frame(spark, COARSE_PALETTE)).withColumn("name", F.regexp_replace("name", "^tab:", ""))
    return I.write_colours(found, names)


@query("i09_clothing_attributes")
def i09(spark, d):
    models = {"Sleeve": lambda a: int(a[0, 0, 0]) % 5, "Length": lambda a: int(a.mean()) % 4}
    return I.classify(pictures(spark, d), "s_suppkey", "picture", models, LABEL_CODES)


def _events(spark, d):
    """The events as a stream: written to a folder of their own first, as a stream reads folders."""
    path = scratch_path(spark, "events")
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(path)
    return H.read_stream(spark, path, e._jdf.schema().toDDL())


def _name() -> str:
    return f"q_{uuid.uuid4().hex[:8]}"


@query("st1_windowed_ranks", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(min(value), 6) AS best FROM events GROUP BY 1, 2")
def st1(spark, d):
    w = H.collected(H.windowed_ranks(_events(spark, d), "ts", "event_type", "value", late="36500 days"), _name(), "complete")
    return w.select(F.col("w.start").alias("start"), "event_type", "n", F.round("best", 6).alias("best"))


@query("st2_first_seen", "SELECT count(DISTINCT user_id) AS users FROM events")
def st2(spark, d):
    return H.collected(H.first_seen(_events(spark, d), "ts", "user_id", "36500 days"), _name()).agg(F.countDistinct("user_id").alias("users"))


@query("st3_upsert_stream", "SELECT CAST(row_number() OVER (ORDER BY user_id) AS BIGINT) AS oid, user_id FROM (SELECT DISTINCT user_id FROM events)")
def st3(spark, d):
    path, check = scratch_path(spark, "users"), scratch_path(spark, "progress")
    spark.createDataFrame([], "oid long, user_id long").write.parquet(path)
    H.upsert_stream(_events(spark, d).select("user_id"), path, ["user_id"], "oid", check).awaitTermination()
    return spark.read.parquet(path)


@query("st4_log_stream", "SELECT event_type AS note, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def st4(spark, d):
    path, check = scratch_path(spark, "log"), scratch_path(spark, "progress")
    H.log_stream(_events(spark, d).where("event_type = 'error'").select(F.col("event_type").alias("note")), path, check).awaitTermination()
    return spark.read.parquet(path).groupBy("note").agg(F.count("*").alias("n"))
