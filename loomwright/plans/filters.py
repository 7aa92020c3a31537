"""Scans, projections, filters, sorts and set operations over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import predicates as P
from loomwright.operators.names import first_prefix_match
from loomwright.operators.ranking import ordinal, top_by_group
from loomwright.registry import query, table
from loomwright.sources.tables import read_csv_dimension, word_list


@query("s01_table_scan", "SELECT * FROM nation")
def s01(spark, d):
    return table(spark, d, "nation")


@query("s02_raw_sql", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def s02(spark, d):
    return spark.sql("SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY n_regionkey", nation=table(spark, d, "nation"))


@query("s04_csv_dimension", "SELECT n_nationkey AS \"Oid\", n_name AS \"Description\" FROM nation")
def s04(spark, d):
    lines = table(spark, d, "nation").select(F.concat_ws(",", "n_nationkey", F.concat(F.lit('"'), "n_name", F.lit('"'))).alias("value"))
    return read_csv_dimension(lines, "Oid INT, Description STRING")


@query("s05_column_scan", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def s05(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").where("c_acctbal > 0")


@query("s07_word_list", "SELECT DISTINCT trim(w) AS word FROM (SELECT unnest(string_split(string_agg(p_name, ','), ',')) AS w FROM part) WHERE trim(w) <> ''")
def s07(spark, d):
    return word_list(table(spark, d, "part").select(F.col("p_name").alias("value")))


@query("p01_projection", "SELECT p_partkey, p_brand, p_size FROM part")
def p01(spark, d):
    return P.project(table(spark, d, "part"), ["p_partkey", "p_brand", "p_size"])


@query("p02_top_n", "SELECT count(*) AS n FROM (SELECT * FROM part LIMIT 7)")
def p02(spark, d):
    return P.project(table(spark, d, "part"), "TOP 7").agg(F.count("*").alias("n"))


@query("p03_conjunctive_equality", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def p03(spark, d):
    return table(spark, d, "orders").where(P.matches({"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": None, "o_totalprice": float("nan")})).select("o_orderkey", "o_custkey")


@query("p03_null_criterion", "SELECT c.c_custkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL")
def p03b(spark, d):
    both = table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 450000"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.where(P.matches({"o_orderkey": "NULL"})).select("c_custkey")


@query("p04_key_disjunction", "SELECT * FROM supplier WHERE s_suppkey IN (1, 5, 9, 33)")
def p04(spark, d):
    return table(spark, d, "supplier").where(F.col("s_suppkey").isin(1, 5, 9, 33))


_GAPS = "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN l_returnflag END AS a, CASE WHEN l_discount > 0.05 THEN l_linestatus END AS b FROM lineitem"


def _gaps(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).alias("a"), F.when(F.col("l_discount") > 0.05, F.col("l_linestatus")).alias("b"))


@query("p05_any_null", f"SELECT * FROM ({_GAPS}) WHERE a IS NULL OR b IS NULL")
def p05(spark, d):
    return _gaps(spark, d).where(P.any_null(["a", "b"]))


@query("p06_all_null", f"SELECT * FROM ({_GAPS}) WHERE a IS NULL AND b IS NULL")
def p06(spark, d):
    return _gaps(spark, d).where(P.all_null(["a", "b"]))


@query("p07_drop_all_null_rows", f"SELECT * FROM ({_GAPS}) WHERE coalesce(a, b) IS NOT NULL")
def p07(spark, d):
    return _gaps(spark, d).where(~P.all_null(["a", "b"]))


@query("p08_positive_score", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def p08(spark, d):
    return table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_acctbal")


@query("p09_membership", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def p09(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return P.members(table(spark, d, "part"), big, ["p_partkey"]).select("p_partkey", "p_name")


@query("p10_non_membership", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def p10(spark, d):
    return P.non_members(table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


_FEEDBACK = """SELECT d.doc_id AS oid, CASE WHEN l.quality = 1 THEN l.doc_id % 6 END AS grade, l.toxic = 1 AS irrelevant
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def feedback(spark, d):
    """Feedback from the labels: a grade of 0 to 5 where the quality is good, irrelevant where toxic, else none."""
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return both.select(F.col("doc_id").alias("oid"), F.when(F.col("quality") == 1, F.col("doc_id") % 6).alias("grade"), (F.col("toxic") == 1).alias("irrelevant"))


@query("p11_interaction_split", f"""SELECT oid, coalesce(grade >= 0, false) OR coalesce(irrelevant, false) AS seen,
 coalesce(irrelevant, false) AS irrelevant, grade IS NULL AND NOT coalesce(irrelevant, false) AS unseen FROM ({_FEEDBACK})""")
def p11(spark, d):
    return feedback(spark, d).select("oid", *P.interaction_state("grade", "irrelevant"))


@query("p12_sentinel_split", "SELECT doc_id, r <> 2.5 AS rated, r >= 4 AS liked FROM (SELECT doc_id, CASE WHEN quality = 1 THEN doc_id % 6 ELSE 2.5 END AS r FROM labels)")
def p12(spark, d):
    r = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, F.col("doc_id") % 6).otherwise(F.lit(2.5)).alias("r"))
    return r.select("doc_id", P.rated("r", 2.5).alias("rated"), (F.col("r") >= 4).alias("liked"))


@query("p13_drop_null_grades", f"SELECT oid, grade FROM ({_FEEDBACK}) WHERE grade IS NOT NULL")
def p13(spark, d):
    return feedback(spark, d).dropna(subset=["grade"]).select("oid", "grade")


@query("p14_drop_null_columns", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def p14(spark, d):
    n = table(spark, d, "nation")
    return P.drop_null_columns(n.withColumn("empty", F.lit(None).cast("string")).withColumn("void", F.lit(None).cast("double")))


@query("p15_result_type", "SELECT event_id FROM events WHERE event_type = 'view' AND value IS NOT NULL AND user_id > 0")
def p15(spark, d):
    return table(spark, d, "events").where("event_type = 'view' AND value IS NOT NULL AND user_id > 0").select("event_id")


@query("p16_truthy_flags", """SELECT n_nationkey, lower(flag) AS flag FROM (
 SELECT n_nationkey, n_regionkey % 2 = 0 AS "Asos", n_regionkey > 1 AS "Zalando", n_nationkey < 5 AS "Pinterest" FROM nation)
 UNPIVOT (v FOR flag IN ("Asos", "Zalando", "Pinterest")) WHERE v""")
def p16(spark, d):
    wide = table(spark, d, "nation").select("n_nationkey", (F.col("n_regionkey") % 2 == 0).alias("Asos"), (F.col("n_regionkey") > 1).alias("Zalando"), (F.col("n_nationkey") < 5).alias("Pinterest"))
    return P.flags_on(wide, ["n_nationkey"], ["Asos", "Zalando", "Pinterest"])


@query("p17_full_match", "SELECT p_partkey FROM part WHERE regexp_full_match(lower(p_brand), 'brand#?[1-3]\\d*')")
def p17(spark, d):
    return table(spark, d, "part").where(F.lower("p_brand").rlike(r"^(?:brand#?[1-3]\d*)$")).select("p_partkey")


@query("p18_prefix_match", """SELECT p_partkey, min_by(n, o) AS n, min(o) AS o FROM part JOIN (VALUES ('', 0), ('Brand#1', 1), ('BRAND', 2), ('x', 3)) t(n, o)
 ON starts_with(lower(trim(p_brand)), lower(trim(n))) AND trim(n) <> '' GROUP BY p_partkey""")
def p18(spark, d):
    names = spark.createDataFrame([("", 0), ("Brand#1", 1), ("BRAND", 2), ("x", 3)], "n string, o int")
    return first_prefix_match(table(spark, d, "part").select("p_partkey", "p_brand"), names, "p_brand", "n", "o").select("p_partkey", "n", "o")


@query("p19_numeric_columns", "SELECT p_partkey, p_size, p_retailprice FROM part")
def p19(spark, d):
    p = table(spark, d, "part")
    return p.select(*P.numeric_columns(p))


@query("p20_rename_constant_drop", "SELECT 0 AS \"userId\", doc_id AS \"clothId\", quality AS \"grade\" FROM labels")
def p20(spark, d):
    return table(spark, d, "labels").withColumnsRenamed({"doc_id": "clothId", "quality": "grade"}).withColumn("userId", F.lit(0)).drop("toxic")


@query("p21_null_fill", f"""SELECT l_orderkey, l_linenumber, coalesce(a, 'NOT_APPLIED') AS a, coalesce(b, '') AS b FROM ({_GAPS})""")
def p21(spark, d):
    return _gaps(spark, d).fillna({"a": "NOT_APPLIED", "b": ""})


@query("p21_mean_fill", """SELECT c_custkey, round(coalesce(v, avg(v) OVER ()), 6) AS v FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer)""")
def p21b(spark, d):
    v = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v"))
    return v.crossJoin(F.broadcast(v.agg(F.avg("v").alias("m")))).select("c_custkey", F.round(F.coalesce("v", "m"), 6).alias("v"))


@query("p22_missing_probe", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def p22(spark, d):
    back = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(back, "p_partkey", "left_anti").select("p_partkey")


@query("p23_last_row", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def p23(spark, d):
    return P.last_row(table(spark, d, "orders"), "o_orderkey").select("o_orderkey")


@query("t01_sort_by_score", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer")
def t01(spark, d):
    return ordinal(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], "place").select("c_custkey", "place")


@query("t02_sort_ascending", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS place FROM supplier")
def t02(spark, d):
    return ordinal(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), [F.asc("s_acctbal"), F.asc("s_suppkey")], "place").select("s_suppkey", "place")


@query("t03_latest_of_user", "SELECT max(event_id) AS event_id FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def t03(spark, d):
    e = table(spark, d, "events")
    one = e.join(F.broadcast(e.agg(F.min("user_id").alias("user_id"))), "user_id")
    return one.orderBy(F.desc("event_id")).limit(1).select("event_id")


@query("t04_truncate", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT least(12, 250)")
def t04(spark, d):
    return table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(min(12, 250)).select("p_partkey")


@query("t05_show_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def t05(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("t06_sort_occurrences", "SELECT l_orderkey, string_agg(l_returnflag || ':' || l_linenumber, ',' ORDER BY l_returnflag, l_linenumber) AS labels FROM lineitem GROUP BY l_orderkey")
def t06(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_returnflag").alias("src"), F.col("l_linenumber").alias("pos")))).alias("a"))
    return g.select("l_orderkey", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["src"], x["pos"])), ",").alias("labels"))


@query("t07_top_one", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def t07(spark, d):
    return table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(1).select("p_partkey", "p_retailprice")


@query("t08_sorted_columns", "SELECT p_brand, p_name, p_partkey, p_retailprice, p_size, p_type FROM part")
def t08(spark, d):
    p = table(spark, d, "part")
    numbers = set(P.numeric_columns(p))
    return p.select(*sorted(set(p.columns) - numbers), *sorted(numbers))


@query("t10_first_of_list", "SELECT p_partkey, string_split(p_name, ' ')[1] AS first FROM part")
def t10(spark, d):
    return table(spark, d, "part").select("p_partkey", F.split("p_name", " ")[0].alias("first"))


@query("t11_top_k_by_group", "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def t11(spark, d):
    return top_by_group(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).drop("o_totalprice")


@query("u01_union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def u01(spark, d):
    n, r = table(spark, d, "nation").select(F.col("n_name").alias("name")), table(spark, d, "region").select(F.col("r_name").alias("name"))
    return n.unionByName(r).unionByName(n)


@query("u02_difference", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def u02(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, d, "supplier").where("s_acctbal < 0").select("s_nationkey"))


@query("u03_intersection", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def u03(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("u04_distinct_union", "SELECT lower(n_name) AS word FROM nation UNION SELECT lower(r_name) FROM region")
def u04(spark, d):
    return table(spark, d, "nation").select(F.lower("n_name").alias("word")).union(table(spark, d, "region").select(F.lower("r_name"))).distinct()


@query("u05_id_concatenation", "SELECT p_partkey AS oid FROM part WHERE p_size < 5 UNION ALL SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def u05(spark, d):
    return table(spark, d, "part").where("p_size < 5").select(F.col("p_partkey").alias("oid")).union(table(spark, d, "supplier").where("s_acctbal < 0").select("s_suppkey"))
