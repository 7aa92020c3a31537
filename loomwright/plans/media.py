"""Sources and sinks of files, pictures and models, over small files made from the tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import images as I
from loomwright.functions import tfidf as T
from loomwright.plans.recommend import _weights, products
from loomwright.plans.scalars import STOP
from loomwright.registry import query, table
from loomwright.sources import adapters, sheets, social, tables
from loomwright.storage import scratch_path

SIDE = 8


def _channels(k):
    """Red, green and blue of the pixels of the picture of a number."""
    i = np.arange(SIDE * SIDE)
    return np.stack([(k * 37 + i * 11) % 256, (k * 17 + i * 29) % 256, (k * 71 + i * 5) % 256], 1).astype(np.uint8).reshape(SIDE, SIDE, 3)


_PIXELS = f"SELECT s_suppkey, (s_suppkey * 37 + i * 11) % 256 AS r, (s_suppkey * 17 + i * 29) % 256 AS g, (s_suppkey * 71 + i * 5) % 256 AS b FROM supplier, range({SIDE * SIDE}) t(i)"


#: Pictures that a task makes and looks at.
PICTURES_A_TASK = 1000


def mapped(df: DataFrame, of, schema: str) -> DataFrame:
    """Rows of `of` for each row of df."""

    def run(batches):
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            yield pd.DataFrame([x for r in b.itertuples(index=False) for x in of(r)], columns=names)

    return df.mapInPandas(run, schema)


def suppliers(spark, d) -> DataFrame:
    """The keys that pictures are made from, dealt out, as files of keys come in few parts."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"))
    return s.repartition(max(spark.sparkContext.defaultParallelism, s.count() // PICTURES_A_TASK), "s_suppkey")


def pixel_pictures(spark, d) -> DataFrame:
    return mapped(suppliers(spark, d), lambda r: [(r.s_suppkey, I.write_ppm(_channels(int(r.s_suppkey))))], "s_suppkey long, picture binary")


@query("s03_direct_scan", "SELECT n_nationkey, n_name FROM nation")
def s03(spark, d):
    return tables.read_table(spark, f"{d}/nation.parquet", ["n_nationkey", "n_name"])


def workbook(rows: list[tuple[str, str]]) -> bytes:
    """A workbook of one sheet, for the reader."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda c, n, v: f'<c r="{c}{n}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    body = "".join(f'<row r="{n}">{cell("A", n, a)}{cell("B", n, b)}</row>' for n, (a, b) in enumerate([("code", "name"), *rows], 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Nations" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


@query("s06_excel_sheets", "SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name FROM nation")
def s06(spark, d):
    path = scratch_path(spark, "sheets")
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name"))).alias("rows"))
    books = mapped(rows, lambda r: [(f"{r.n_regionkey}.xlsx", workbook([tuple(x.values()) for x in r.rows]))], "name string, content binary")
    tables.write_files(books, path).count()
    return sheets.read_excel(spark, path, "Nations", ["code", "name"])


def _pages(spark, d, name: str, page) -> str:
    """Saved replies: a folder for each region, a page for each nation."""
    path = scratch_path(spark, name)
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", F.col("n_nationkey").cast("long").alias("n_nationkey"))
    named = both.select(F.concat("r_name", F.lit("/"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.lit(".json")).alias("name"), F.encode(F.to_json(page), "UTF-8").alias("content"))
    tables.write_files(named, path).count()
    return path


@query("s12_pins", "SELECT r_name AS term, 'https://p.example/' || n_nationkey AS url, n_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey")
def s12(spark, d):
    link = F.concat(F.lit("https://p.example/"), F.col("n_nationkey"))
    kept = F.struct(F.lit("pin").alias("type"), link.alias("link"), F.col("n_name").alias("title"))
    promoted = F.struct(F.lit("promoted").alias("type"), F.lit("https://ad.example").alias("link"), F.lit("ad").alias("title"))
    path = _pages(spark, d, "pins", F.struct(F.array(kept, promoted, kept).alias("results")))
    return social.read_posts(spark, path).select("term", "url", "title")


@query("s13_tagged_posts", "SELECT r_name AS term, 'n' || n_nationkey AS url, array_to_string(regexp_extract_all('new ' || n_name || ' x9 99', '[a-zA-Z]+'), ' ') AS description FROM nation JOIN region ON n_regionkey = r_regionkey")
def s13(spark, d):
    def post(kind):
        caption = F.struct(F.concat(F.lit("new "), "n_name", F.lit(" x9 99")).alias("text"))
        return F.struct(F.lit(kind).alias("media_type"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("code"), caption.alias("caption"))

    layout = F.struct(F.struct(F.array(post(2), post(1)).alias("medias")).alias("layout_content"))
    path = _pages(spark, d, "posts", F.struct(F.struct(F.struct(F.array(layout).alias("sections")).alias("recent")).alias("data")))
    return social.letters_only(social.read_posts(spark, path, "post")).select("term", "url", "description")


@query("s16_first_usable_picture", f"SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'photo' ELSE 'none' END AS source, CASE s_suppkey % 3 WHEN 0 THEN {SIDE} WHEN 1 THEN {SIDE} - 1 END AS height FROM supplier")
def s16(spark, d):
    def of(r):
        k = int(r.s_suppkey)
        whole, cut = I.write_ppm(_channels(k)), I.write_ppm(_channels(k)[1:])
        sources = {"image": whole if k % 3 == 0 else None, "address": b"no picture", "photo": cut if k % 3 < 2 else b"P6"}
        a = I.first_usable(list(sources.values()), I.read_ppm)
        name = next((n for n, s in sources.items() if s and I.read_ppm(s) is not None), "none")
        return [(k, name, None if a is None else a.shape[0])]

    return mapped(suppliers(spark, d), of, "s_suppkey long, source string, height long")


@query("s19_person_crops", f"SELECT s_suppkey, unnest([0, 1]) AS crop, unnest([3, {SIDE}]) AS height FROM supplier WHERE s_suppkey % 2 = 0")
def s19(spark, d):
    def detect(a):
        return [(69, (0, 0, 3, 4)), (1, (0, 0, 2, 2)), (69, (0, 0, SIDE, 2))] if a[0, 0, 0] % 2 == 0 else []

    crops = I.person_crops(pixel_pictures(spark, d), "s_suppkey", "picture", detect)
    return crops.select("s_suppkey", "crop", F.regexp_extract(F.decode(F.substring("picture", 1, 10), "ISO-8859-1"), r"P6\n\d+ (\d+)", 1).cast("int").alias("height"))


def _model(spark, d, k: int):
    part = table(spark, d, "part").select(array_to_vector(F.array(F.col("p_size").cast("double"))).alias("features"))
    return KMeans(k=k, seed=1, maxIter=2).fit(part)


@query("s20_newest_model", "SELECT 3 AS centres")
def s20(spark, d):
    folder = scratch_path(spark, "models")
    for k, name in ((2, "groups"), (3, "groups"), (4, "others")):
        adapters.save_model(_model(spark, d, k), folder, name)
    model = adapters.load_newest(spark, folder, "groups", KMeansModel.load)
    return spark.createDataFrame([(len(model.clusterCenters()),)], "centres int")


@query("w18_model_save_and_remove", "SELECT true AS saved, true AS removed")
def w18(spark, d):
    folder = scratch_path(spark, "models")
    path = adapters.save_model(_model(spark, d, 2), folder, "groups")
    saved = tables.newest_model(spark, folder, "groups") is not None
    tables.remove_model(spark, path)
    return spark.createDataFrame([(saved, tables.newest_model(spark, folder, "groups") is None)], "saved boolean, removed boolean")


@query("w19_picture_files", f"SELECT s_suppkey, sum(r + g + b)::BIGINT AS total FROM ({_PIXELS}) GROUP BY s_suppkey")
def w19(spark, d):
    path = scratch_path(spark, "pictures")
    named = pixel_pictures(spark, d).select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".ppm")).alias("name"), F.col("picture").alias("content"))
    tables.write_files(named, path).count()
    back = tables.read_files(spark, path, "*.ppm").select(F.regexp_extract("path", r"(\d+)\.ppm$", 1).cast("long").alias("s_suppkey"), "content")
    return mapped(back, lambda r: [(r.s_suppkey, int(I.read_ppm(bytes(r.content)).sum()))], "s_suppkey long, total long")


VOCABULARY = ["haus", "la", "of", "on"]


@query(
    "w17_dense_tfidf",
    f"WITH {_weights(2, 1.0)} SELECT oid, " + ", ".join(f"round(coalesce(sum(weight) FILTER (term = '{t}'), 0), 6) AS \"{t}\"" for t in VOCABULARY) + " FROM weight GROUP BY oid",
)
def w17(spark, d):
    path = scratch_path(spark, "dense")
    wide = T.dense_weights(products(spark, d), "oid", "metadata", VOCABULARY, STOP, 2, 2)
    wide.select("oid", *[F.round(t, 6).alias(t) for t in VOCABULARY]).write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="oid long, " + ", ".join(f"`{t}` double" for t in VOCABULARY), enforceSchema=True)


@query(
    "i01_skin_masks",
    f"""WITH p AS ({_PIXELS}), y AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS y, greatest(r, g, b) AS top, least(r, g, b) AS low FROM p),
 h AS (SELECT *, round((r - y) * 0.713 + 128) AS cr, round((b - y) * 0.564 + 128) AS cb, CASE WHEN top = low THEN 0 ELSE round(30 * CASE WHEN top = r THEN (CAST(g - b AS DOUBLE) / (top - low) + 6) % 6 WHEN top = g THEN CAST(b - r AS DOUBLE) / (top - low) + 2 ELSE CAST(r - g AS DOUBLE) / (top - low) + 4 END) END AS hue,
  CASE WHEN top = 0 THEN 0 ELSE round(CAST(top - low AS DOUBLE) / top * 255) END AS sat FROM y)
 SELECT s_suppkey, count(*) FILTER (hue BETWEEN 0 AND 25 AND sat BETWEEN 58 AND 173) AS hsv, count(*) FILTER (cr BETWEEN 133 AND 173 AND cb BETWEEN 80 AND 120) AS ycrcb,
 count(*) FILTER (r > g AND r > b AND r > g + 15 AND r >= 95 AND g >= 40 AND b >= 20) AS rgb FROM h GROUP BY s_suppkey""",
)
def i01(spark, d):
    def of(r):
        a = I.read_ppm(bytes(r.picture))
        return [(r.s_suppkey, *(int(f(a).sum()) for f in (I.hsv_skin, I.ycrcb_skin, I.rgb_skin)))]

    return mapped(pixel_pictures(spark, d), of, "s_suppkey long, hsv long, ycrcb long, rgb long")


def scenes(spark, d) -> DataFrame:
    """A square of skin, as wide as the number asks for, on a blue ground."""

    def of(r):
        k = int(r.s_suppkey)
        a = np.zeros((48, 48, 3), np.uint8)
        a[:] = (20, 40, 200)
        side = k % 5 * 9
        a[4 : 4 + side, 4 : 4 + side] = (224, 172, 140)
        return [(k, I.write_ppm(a))]

    return mapped(suppliers(spark, d), of, "s_suppkey long, picture binary")


#: A square keeps its side when it is eroded by five pixels, less four.
@query("i05_skin_gate", "SELECT s_suppkey, (s_suppkey % 5 * 9 - 4) * (s_suppkey % 5 * 9 - 4) > 400 AND s_suppkey % 5 > 0 AS shows FROM supplier")
def i05(spark, d):
    return mapped(scenes(spark, d), lambda r: [(r.s_suppkey, bool(I.shows_skin(I.read_ppm(bytes(r.picture)))))], "s_suppkey long, shows boolean")


@query("i02_skin_extraction")
def i02(spark, d):
    return mapped(scenes(spark, d), lambda r: [(r.s_suppkey, int(I.not_skin(I.read_ppm(bytes(r.picture))).sum()))], "s_suppkey long, left long")


#: Skin ends before the last five columns, whatever its size.
@query("i03_segmented_person", "SELECT s_suppkey, 24 * (43 - s_suppkey % 5) AS person, s_suppkey % 5 > 0 AS bare, 24 * 5 AS beyond FROM supplier")
def i03(spark, d):
    """Without skin the cloth is the person that a segmentation gives: here of a width that depends on the picture."""

    def of(r):
        a = I.read_ppm(bytes(r.picture))
        person = np.zeros(a.shape[:2])
        person[:24, int(r.s_suppkey) % 5 + 5 :] = 1
        cloth = I.cloth_mask(a, person)
        return [(r.s_suppkey, int(person.sum()), bool(cloth.sum() < person.sum()), int(cloth[:, 43:].sum()))]

    return mapped(scenes(spark, d), of, "s_suppkey long, person long, bare boolean, beyond long")


@query("i04_mask_combination")
def i04(spark, d):
    def of(r):
        a = I.read_ppm(bytes(r.picture))
        return [(r.s_suppkey, int(I.cloth_mask(a).sum()), int(I.cloth_mask(a, np.ones(a.shape[:2])).sum()))]

    return mapped(scenes(spark, d), of, "s_suppkey long, by_edges long, by_person long")


@query("i11_grey_pictures", f"SELECT s_suppkey, 3 * sum(r)::BIGINT AS total, {SIDE * SIDE * 3} AS values FROM ({_PIXELS}) GROUP BY s_suppkey")
def i11(spark, d):
    def of(r):
        grey = _channels(int(r.s_suppkey))[..., 0]
        a = I.read_ppm(b"P5\n%d %d\n255\n" % (SIDE, SIDE) + grey.tobytes())
        return [(r.s_suppkey, int(a.sum()), a.size)]

    return mapped(suppliers(spark, d), of, "s_suppkey long, total long, values int")
