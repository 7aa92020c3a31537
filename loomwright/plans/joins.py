"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import joins as J
from loomwright.operators.dml import get_or_create
from loomwright.operators.names import last_containing
from loomwright.operators.ranking import ordinal
from loomwright.registry import query, table
from loomwright.sources.fixed import COARSE_PALETTE, GENDER_WORDS, palette_frame


@query("j01_product_history", "SELECT p_partkey, l_orderkey, l_linenumber FROM part LEFT JOIN lineitem ON p_partkey = l_partkey")
def j01(spark, d):
    return table(spark, d, "part").join(table(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "l_orderkey", "l_linenumber")


@query("j02_filtered_outer", "SELECT p_partkey, l_orderkey FROM part LEFT JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity = 50")
def j02(spark, d):
    both = table(spark, d, "part").join(table(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return both.where("l_quantity = 50").select("p_partkey", "l_orderkey")


@query(
    "j03_star_join",
    """SELECT l_orderkey, l_linenumber, p_name AS l_partkey_text, s_name AS l_suppkey_text, o_orderstatus AS l_orderkey_text
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""",
)
def j03(spark, d):
    dims = {"l_orderkey": (table(spark, d, "orders"), "o_orderkey", "o_orderstatus"), "l_partkey": (table(spark, d, "part"), "p_partkey", "p_name"), "l_suppkey": (table(spark, d, "supplier"), "s_suppkey", "s_name")}
    fact = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return J.star(fact, dims).drop("l_partkey", "l_suppkey")


@query(
    "j04_text_key_star",
    """SELECT c_custkey, n_nationkey AS nation_oid, r_regionkey AS region_oid FROM (
 SELECT c_custkey, n_name AS a, r_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
LEFT JOIN nation ON a = n_name LEFT JOIN region ON b = r_name""",
)
def j04(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    wide = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    out = J.star(wide, {"nation": (n, "n_name", "n_nationkey"), "region": (r, "r_name", "r_regionkey")})
    return out.select("c_custkey", F.col("nation_text").alias("nation_oid"), F.col("region_text").alias("region_oid"))


@query("j05_product_result", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j05(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")


@query("j06_label_to_dimension", "SELECT c_custkey, n_nationkey FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN n_name END AS x FROM customer JOIN nation ON c_nationkey = n_nationkey) JOIN nation ON x = n_name")
def j06(spark, d):
    n = table(spark, d, "nation")
    x = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("n_name")).alias("n_name"))
    return x.join(n, "n_name").select("c_custkey", "n_nationkey")


@query(
    "j07_index_merges",
    """SELECT o_custkey AS idx, a.n AS orders, b.n AS urgent, round(c.s, 2) AS spent FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a
 JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) b USING (o_custkey)
 JOIN (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) c USING (o_custkey)""",
)
def j07(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "idx")
    a, b, c = o.groupBy("idx").agg(F.count("*").alias("orders")), o.where("o_orderpriority = '1-URGENT'").groupBy("idx").agg(F.count("*").alias("urgent")), o.groupBy("idx").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return a.join(b, "idx").join(c, "idx")


@query("j08_dictionary_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
def j08(spark, d):
    return J.lookup(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": 1, "O": 2}, "code").drop("o_orderstatus")


@query("j09_scatter_by_key", "SELECT d.doc_id, l.quality AS predicted FROM documents d LEFT JOIN (SELECT doc_id, quality FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id")
def j09(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("toxic = 1").select("doc_id", F.col("quality").alias("predicted")), "doc_id", "left")


@query("j10_containment_last_match", "SELECT p_partkey, max_by(w, o) AS w FROM part JOIN (VALUES ('a', 1), ('re', 2), ('in', 3), ('ed', 4)) t(w, o) ON contains(p_name, w) GROUP BY p_partkey")
def j10(spark, d):
    names = spark.createDataFrame([("a", 1), ("re", 2), ("in", 3), ("ed", 4)], "w string, o int")
    return last_containing(table(spark, d, "part").select("p_partkey", "p_name"), names, "p_name", "w", "o").drop("p_name")


@query(
    "j11_whole_word_containment",
    r"""SELECT doc_id, w AS label, len(string_split(trim(substr(t, 1, strpos(t, ' ' || w || ' '))), ' ')) - CASE WHEN trim(substr(t, 1, strpos(t, ' ' || w || ' '))) = '' THEN 1 ELSE 0 END AS pos
FROM (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[ \t\n\x0b\f\r]+', ' ', 'g')) || ' ' AS t FROM documents) JOIN (VALUES ('the'), ('of and'), ('is the'), ('con la'), ('und die')) v(w) ON contains(t, ' ' || w || ' ')""",
)
def j11(spark, d):
    labels = spark.createDataFrame([("the",), ("of and",), ("is the",), ("con la",), ("und die",)], "label string")
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return J.phrase_matches(docs, labels, "doc_id", "text", "label")


@query("j12_trend_reference", "SELECT a.p_partkey, a.p_size AS trend, coalesce(b.l_linenumber, 0) AS reference FROM part a LEFT JOIN (SELECT l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1) b ON p_partkey = l_partkey")
def j12(spark, d):
    ref = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_linenumber").alias("r"))
    return table(spark, d, "part").join(ref, "p_partkey", "left").select("p_partkey", F.col("p_size").alias("trend"), F.coalesce("r", F.lit(0)).alias("reference"))


@query("j13_semi_join_stop", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_tax = 0) ORDER BY p_partkey LIMIT 25")
def j13(spark, d):
    seen = table(spark, d, "lineitem").where("l_tax = 0").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(seen, "p_partkey", "left_semi").orderBy("p_partkey").limit(25).select("p_partkey")


@query("j14_new_articles", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part, supplier WHERE p_partkey = l.l_partkey AND s_suppkey = l.l_suppkey AND p_size > 25 AND s_acctbal > 0)")
def j14(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    parts, sups = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey")), table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    stored = li.select("l_partkey", "l_suppkey").distinct().join(parts, "l_partkey", "left_semi").join(sups, "l_suppkey", "left_semi")
    return li.join(stored, ["l_partkey", "l_suppkey"], "left_anti").select("l_orderkey", "l_partkey", "l_suppkey")


@query("j15_unrated_items", "SELECT n_nationkey AS user_id, r_regionkey AS item FROM nation, region EXCEPT SELECT n_nationkey, n_regionkey FROM nation")
def j15(spark, d):
    users, items = table(spark, d, "nation").select(F.col("n_nationkey").alias("user_id")), table(spark, d, "region").select(F.col("r_regionkey").alias("item"))
    rated = table(spark, d, "nation").select(F.col("n_nationkey").alias("user_id"), F.col("n_regionkey").alias("item"))
    return users.crossJoin(F.broadcast(items)).join(rated, ["user_id", "item"], "left_anti")  # all items of each user are the answer


@query("j16_pairs_in_list", "SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber")
def j16(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("a"))
    return g.select("l_orderkey", F.explode(F.expr("filter(flatten(transform(a, x -> transform(a, y -> struct(x AS i, y AS j)))), p -> p.i < p.j)")).alias("p")).select("l_orderkey", "p.i", "p.j")


#: Three clusterings of the suppliers: two by their numbers, one by nation.
_LABELS = "SELECT s_suppkey AS item, a.algorithm, CASE a.algorithm WHEN 0 THEN s_suppkey % 5 WHEN 1 THEN s_suppkey % 7 ELSE s_nationkey END AS label FROM supplier, (VALUES (0), (1), (2)) a(algorithm)"


def cluster_labels(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("item"), F.posexplode(F.array(F.col("s_suppkey") % 5, F.col("s_suppkey") % 7, F.col("s_nationkey"))).alias("algorithm", "label"))


@query("j17_co_membership", f"SELECT a.item AS i, b.item AS j, round(count(*) / 3, 3) AS share FROM ({_LABELS}) a JOIN ({_LABELS}) b ON a.algorithm = b.algorithm AND a.label = b.label AND a.item < b.item GROUP BY 1, 2")
def j17(spark, d):
    return J.co_members(cluster_labels(spark, d), "item", "algorithm", "label", 3)


_COLOURS = "SELECT p_partkey, CAST(p_partkey * 37 % 256 AS INTEGER) AS red, CAST(p_partkey * 91 % 256 AS INTEGER) AS green, CAST(p_size * 5 % 256 AS INTEGER) AS blue FROM part"


def colours(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 37 % 256).cast("int").alias("red"), (F.col("p_partkey") * 91 % 256).cast("int").alias("green"), (F.col("p_size") * 5 % 256).cast("int").alias("blue"))


_PALETTE = ", ".join(f"('{n}', {r}, {g}, {b}, {i})" for i, (n, (r, g, b)) in enumerate(COARSE_PALETTE.items()))


@query("j18_nearest_colour", f"SELECT p_partkey, arg_min(name, ((r - red) * (r - red) + (g - green) * (g - green) + (b - blue) * (b - blue)) * 1000 - seq) AS name FROM ({_COLOURS}), (VALUES {_PALETTE}) t(name, r, g, b, seq) GROUP BY p_partkey")
def j18(spark, d):
    return J.nearest_colour(colours(spark, d), palette_frame(spark, COARSE_PALETTE)).select("p_partkey", "name")


@query(
    "j19_cascading_lookup",
    """SELECT x.n_nationkey, coalesce(r.r_regionkey + 100, n2.n_nationkey) AS oid, CASE WHEN r.r_regionkey IS NOT NULL THEN 0 WHEN n2.n_nationkey IS NOT NULL THEN 1 END AS oid_step
FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'asia' ELSE 'none' END AS sub, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) END AS cat FROM nation) x
LEFT JOIN region r ON lower(r.r_name) = x.sub LEFT JOIN nation n2 ON lower(n2.n_name) = x.cat""",
)
def j19(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region").withColumn("oid", F.col("r_regionkey") + 100)
    x = n.select("n_nationkey", F.when(F.col("n_nationkey") % 4 == 0, F.lit("asia")).otherwise(F.lit("none")).alias("sub"), F.when(F.col("n_nationkey") % 3 == 0, F.lower("n_name")).alias("cat"))
    return J.first_found(x, [(r, "r_name", "oid"), (n.select("n_name", F.col("n_nationkey").alias("nk")), "n_name", "nk")], ["sub", "cat"], "oid").select("n_nationkey", "oid", "oid_step")


_BRANDS = "SELECT brand, row_number() OVER (ORDER BY known DESC, CASE WHEN known THEN brand END, brand) AS oid FROM (SELECT p_brand AS brand, p_brand < 'Brand#3' AS known FROM part GROUP BY p_brand)"


_SOME_BRANDS = "SELECT p_partkey, CASE WHEN p_size > 3 THEN p_brand END AS brand FROM part"
_GROWN = f"SELECT brand, row_number() OVER (ORDER BY CASE WHEN brand < 'Brand#3' THEN 0 ELSE 1 END, brand NULLS FIRST) AS oid FROM (SELECT DISTINCT brand FROM ({_SOME_BRANDS}))"


@query("j20_get_or_create", f"SELECT p_partkey, oid FROM ({_SOME_BRANDS}) p JOIN ({_GROWN}) g ON p.brand IS NOT DISTINCT FROM g.brand")
def j20(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 3, F.col("p_brand")).alias("brand"))
    dim = ordinal(p.select("brand").distinct().where("brand < 'Brand#3'"), [F.asc("brand")], "oid")
    return get_or_create(dim, p, ["brand"], "oid")[1].select("p_partkey", "oid")


_WORDS = ", ".join(f"('{w}', '{g}')" for w, g in GENDER_WORDS.items())


@query("j21_synonym_lookup", f"SELECT c_custkey, g AS gender FROM (SELECT c_custkey, ['men', 'Ladies', 'boys', 'nothing'][c_custkey % 4 + 1] AS w FROM customer) LEFT JOIN (VALUES {_WORDS}) t(x, g) ON lower(w) = x")
def j21(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.lower(F.get(F.array(*map(F.lit, ("men", "Ladies", "boys", "nothing"))), (F.col("c_custkey") % 4).cast("int"))).alias("w"))
    return J.lookup(c, "w", GENDER_WORDS, "gender").drop("w")


@query("j22_overlay", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'x' END, o_orderstatus) AS status, o_custkey AS cust FROM orders")
def j22(spark, d):
    o = table(spark, d, "orders")
    base = o.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"))
    return J.overlay(base, o.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lit("x")).alias("status")), "o_orderkey")
