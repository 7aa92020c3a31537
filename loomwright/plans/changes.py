"""Changes of tables: each query returns the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import dml as W
from loomwright.registry import query, table
from loomwright.storage import replace_table, scratch_path


def _nations(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("Oid"), F.col("n_name").alias("Description"), F.col("n_regionkey").alias("Ordering"))


_N = 'SELECT CAST(n_nationkey AS BIGINT) AS "Oid", n_name AS "Description", n_regionkey AS "Ordering" FROM nation'


@query("w01_insert", f"""SELECT "Oid", "Description", "Ordering", NULL AS "CreatedBy" FROM ({_N}) UNION ALL SELECT 24 + row_number() OVER (ORDER BY r_regionkey), r_name, r_regionkey, 'loader' FROM region""")
def w01(spark, d):
    t = _nations(spark, d).withColumn("CreatedBy", F.lit(None).cast("string"))
    new = table(spark, d, "region").select(F.col("r_name").alias("Description"), F.col("r_regionkey").alias("Ordering"))
    return W.insert(t, new, "Oid", [F.asc("Ordering")], owner="loader").select("Oid", "Description", "Ordering", "CreatedBy")


@query("w02_insert_if_absent", f"""SELECT * FROM ({_N}) UNION ALL SELECT 24 + row_number() OVER (ORDER BY x), x, 9 FROM
 (SELECT DISTINCT upper(r_name) AS x FROM region WHERE upper(r_name) NOT IN (SELECT n_name FROM nation))""")
def w02(spark, d):
    r = table(spark, d, "region").select(F.upper("r_name").alias("Description"), F.lit(9).alias("Ordering"))
    new = r.union(r).union(_nations(spark, d).select("Description", F.lit(9)))
    return W.insert_if_absent(_nations(spark, d), new, ["Description"], "Oid", [F.col("Ordering")])


@query("w03_update_first_match", f"""SELECT "Oid", CASE WHEN "Oid" = (SELECT min("Oid") FROM ({_N}) WHERE "Ordering" = 2) THEN 'changed' ELSE "Description" END AS "Description", "Ordering" FROM ({_N})""")
def w03(spark, d):
    return W.update_first(_nations(spark, d), {"Ordering": 2}, {"Description": F.lit("changed")}, "Oid")[0]


@query("w03_rows_before_update", f"""SELECT * FROM ({_N}) WHERE "Ordering" = 2""")
def w03b(spark, d):
    return W.update_first(_nations(spark, d), {"Ordering": 2}, {"Description": F.lit("changed")}, "Oid")[1]


_CHG = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' END AS seg, c_acctbal + 1 AS bal FROM customer WHERE c_custkey % 2 = 0"


def _changes(spark, d):
    """Two changes of each even customer; the second, which counts, has no segment for two in three."""
    c = table(spark, d, "customer").where("c_custkey % 2 = 0")
    first = c.select("c_custkey", F.lit("OLD").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"), F.lit(0).alias("seq"))
    return first.union(c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit("NEW")), F.col("c_acctbal") + 1, F.lit(1)))


@query("w04_batch_update", f"SELECT c.c_custkey, CASE WHEN x.c_custkey IS NULL THEN c.c_mktsegment ELSE coalesce(x.seg, 'OLD') END AS c_mktsegment, round(coalesce(x.bal, c.c_acctbal), 4) AS c_acctbal FROM customer c LEFT JOIN ({_CHG}) x ON c.c_custkey = x.c_custkey")
def w04(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return W.update_by_key(t, _changes(spark, d), "c_custkey", order=[F.col("seq")]).withColumn("c_acctbal", F.round("c_acctbal", 4))


@query("w04_batch_update_strict", f"SELECT c.c_custkey, CASE WHEN x.c_custkey IS NULL THEN c.c_mktsegment ELSE x.seg END AS c_mktsegment FROM customer c LEFT JOIN ({_CHG}) x ON c.c_custkey = x.c_custkey")
def w04b(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return W.update_by_key(t, _changes(spark, d).drop("c_acctbal"), "c_custkey", strict=True, order=[F.col("seq")])


@query("w05_update_from_table", "SELECT p_partkey, coalesce(x.q, p_size) AS p_size FROM part LEFT JOIN (SELECT l_partkey, CAST(max(l_linenumber) AS INTEGER) AS q FROM lineitem GROUP BY l_partkey) x ON p_partkey = l_partkey")
def w05(spark, d):
    new = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_linenumber").alias("p_size"))
    return W.update_by_key(table(spark, d, "part").select("p_partkey", "p_size"), new, "p_partkey")


@query("w06_reload_dimension", """SELECT row_number() OVER (ORDER BY c_mktsegment) AS "Oid", c_mktsegment AS "Description", CAST(NULL AS INTEGER) AS "Ordering" FROM (SELECT DISTINCT c_mktsegment FROM customer)""")
def w06(spark, d):
    new = table(spark, d, "customer").select(F.col("c_mktsegment").alias("Description")).distinct()
    return W.reload(_nations(spark, d), new, "Oid", [F.asc("Description")])


@query("w07_seed_dimension", f"""SELECT * FROM ({_N}) UNION ALL SELECT 24 + row_number() OVER (ORDER BY x), x, 0 FROM (SELECT DISTINCT lower(r_name) AS x FROM region WHERE lower(r_name) NOT IN (SELECT lower(n_name) FROM nation))""")
def w07(spark, d):
    new = _nations(spark, d).select(F.lower("Description").alias("Description")).union(table(spark, d, "region").select(F.lower("r_name")))
    return W.seed(_nations(spark, d), new.withColumn("Oid", F.lit(0)).withColumn("Ordering", F.lit(0)), "Description", "Oid")


@query("w08_insert_select_normalised", """SELECT o_orderkey AS "Oid", c_nationkey AS nation, n_regionkey AS region, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def w08(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left").select(F.col("o_orderkey").alias("Oid"), F.col("c_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("segment"))


@query("w09_null_to_sentinel", "SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def w09(spark, d):
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return W.fill_sentinel(both, ["quality", "toxic"])


@query("w10_literal_rows", "SELECT CAST(r_regionkey AS BIGINT) AS oid, r_name AS description FROM region UNION ALL SELECT i + (SELECT max(r_regionkey) FROM region), description FROM (VALUES (1, 'WOMAN'), (2, 'MAN'), (3, 'KIDS')) t(i, description)")
def w10(spark, d):
    """Rows that the statement spells out, after those of a dimension, with the keys that follow."""
    dim = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("oid"), F.col("r_name").alias("description"))
    return W.insert_literals(dim, "oid", [{"description": x} for x in ("WOMAN", "MAN", "KIDS")])


@query("w11_create_table", "SELECT n_nationkey, n_name FROM nation")
def w11(spark, d):
    path = scratch_path(spark, "created")
    table(spark, d, "nation").select("n_nationkey", "n_name").write.parquet(path)
    return spark.read.schema("n_nationkey INT, n_name STRING").parquet(path)


@query("w11_foreign_keys", "SELECT count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def w11b(spark, d):
    return W.orphans(table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal >= 0"), "o_custkey", "c_custkey").agg(F.count("*").alias("orphans"))


@query("w12_select_into", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def w12(spark, d):
    path = scratch_path(spark, "into")
    table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).write.parquet(path)
    return spark.read.parquet(path)


@query("w13_upsert", """SELECT CAST(n_nationkey AS BIGINT) AS "Oid", n_name AS "Description", CASE WHEN n_nationkey < 10 THEN 77 ELSE n_regionkey END AS "Ordering" FROM nation
 UNION ALL SELECT 24 + row_number() OVER (ORDER BY lower(r_name)), lower(r_name), 5 FROM region""")
def w13(spark, d):
    known = _nations(spark, d).where("Oid < 10").select("Description", F.lit(77).alias("Ordering"))
    new = known.union(table(spark, d, "region").select(F.lower("r_name"), F.lit(5)))
    new = new.union(new.withColumn("Ordering", F.col("Ordering") - 3))  # each comes twice; the larger one counts
    return W.upsert(_nations(spark, d), new, ["Description"], "Oid", [F.asc("Description")])


@query("w14_history_append", "SELECT l_partkey AS product, l_linenumber AS reference_order, count(*) AS n FROM lineitem GROUP BY 1, 2 UNION ALL SELECT p_partkey, 0, 1 FROM part")
def w14(spark, d):
    old = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("product"), F.col("l_linenumber").alias("reference_order")).agg(F.count("*").alias("n"))
    return old.unionByName(table(spark, d, "part").select(F.col("p_partkey").alias("product"), F.lit(0).alias("reference_order"), F.lit(1).cast("long").alias("n")))


@query("w15_result_write", "SELECT d.doc_id AS product, CASE WHEN l.doc_id IS NULL THEN round(d.n_chars / 1000, 3) ELSE l.quality END AS grade FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def w15(spark, d):
    first = table(spark, d, "documents").select(F.col("doc_id").alias("product"), F.round(F.col("n_chars") / 1000, 3).alias("grade"))
    return W.update_by_key(first, table(spark, d, "labels").select(F.col("doc_id").alias("product"), F.col("quality").cast("double").alias("grade")), "product")


@query("w16_csv_export", "SELECT n_nationkey, n_name FROM nation")
def w16(spark, d):
    path = scratch_path(spark, "csv")
    table(spark, d, "nation").select("n_nationkey", "n_name").write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="n_nationkey INT, n_name STRING")


@query("w20_log_levels", """SELECT event_id, CASE event_type WHEN 'error' THEN 40 WHEN 'purchase' THEN 0 WHEN 'signup' THEN -1 ELSE 20 END AS log_type, event_type AS note FROM events""")
def w20(spark, d):
    from loomwright.sources.logs import log_rows

    return log_rows(table(spark, d, "events"), "event_id", F.col("event_type"), {"error": "ERROR", "purchase": "COMPLETE", "signup": "SKIPPED"}).select("event_id", "log_type", "note")


@query("w21_feedback", """SELECT doc_id, quality, toxic, doc_id % 7 = 0 OR toxic = 1 AS irrelevant FROM labels""")
def w21(spark, d):
    t = table(spark, d, "labels").withColumn("irrelevant", F.col("toxic") == 1)
    given = table(spark, d, "labels").where("doc_id % 7 = 0").select("doc_id", F.lit(True).alias("irrelevant"))
    return W.update_by_key(t, given, "doc_id")


@query("w22_reset_column", "SELECT p_partkey, CAST(NULL AS INTEGER) AS p_size FROM part")
def w22(spark, d):
    return W.reset(table(spark, d, "part").select("p_partkey", "p_size"), "p_size")


@query("w23_replace_in_place", "SELECT s_suppkey, s_acctbal * 2 AS s_acctbal FROM supplier")
def w23(spark, d):
    path = scratch_path(spark, "replaced")
    table(spark, d, "supplier").select("s_suppkey", "s_acctbal").write.parquet(path)
    replace_table(spark.read.parquet(path).withColumn("s_acctbal", F.col("s_acctbal") * 2), path)
    return spark.read.parquet(path)
