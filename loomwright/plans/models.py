"""Models: clustering, consensus, recommendation by forests, online feedback, and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import metrics as E
from loomwright.functions.tfidf import weights
from loomwright.operators import clustering as C
from loomwright.operators import density as D
from loomwright.operators import forests as R
from loomwright.operators import online as O
from loomwright.plans.joins import _LABELS, cluster_labels
from loomwright.registry import query, table
from loomwright.storage import scratch_path, stored

#: The numbers of clusters that are tried, and those of modes.
KS, MODES = range(2, 31), range(2, 75)
#: How near points of density clusterings are.
EPS = 1.0


def vectors(spark, d) -> DataFrame:
    """Products by their coordinates on the first axes of their mixed attributes."""
    return C.famd(mixed(spark, d), "id", ["brand", "kind"], ["size", "price"]).withColumnRenamed("coordinates", "x")


def mixed(spark, d) -> DataFrame:
    """Products with two categories and two numbers."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.substring_index("p_type", " ", 1).alias("kind"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))


@query("m01_famd")
def m01(spark, d):
    return C.famd(mixed(spark, d), "id", ["brand", "kind"], ["size", "price"]).select("id", F.transform("coordinates", lambda x: F.round(x, 4)).alias("coordinates"))


@query(
    "m02_attribute_selection",
    """SELECT id, brand, kind, round((size - min(size) OVER ()) / (max(size) OVER () - min(size) OVER ()), 6) AS size FROM (SELECT p_partkey AS id, coalesce(CASE WHEN p_size > 5 THEN p_brand END, 'NOT_APPLIED') AS brand, string_split(p_type, ' ')[1] AS kind, CAST(p_size AS DOUBLE) AS size FROM part)""",
)
def m02(spark, d):
    m = mixed(spark, d).withColumn("brand", F.when(F.col("size") > 5, F.col("brand")))
    return C.prepared(m, "id", ["brand", "kind"], ["size"]).withColumn("size", F.round("size", 6))


@query("m03_kmeans_selected")
def m03(spark, d):
    return C.select_and_label(vectors(spark, d), "id", "x", "kmeans", KS)


@query("m04_birch")
def m04(spark, d):
    return C.select_and_label(vectors(spark, d), "id", "x", "birch", KS)


@query("m04_birch_incremental")
def m04_more(spark, d):
    """A first call over three of four products, then the rest: its rows are labelled by what both have taught."""
    v = stored(vectors(spark, d), "vectors")
    features = C.birch_session(v.where("id % 4 <> 0"), "id", "x", KS)[1]
    return C.birch_session(v.where("id % 4 = 0"), "id", "x", KS, features)[0]


@query("m05_fuzzy_c_means")
def m05(spark, d):
    return C.fuzzy_c_means(vectors(spark, d), "id", "x", KS)


@query("m06_dbscan")
def m06(spark, d):
    return D.dbscan_selected(vectors(spark, d), "id", "x", EPS, KS)


@query("m06_optics")
def m06_optics(spark, d):
    return D.optics_selected(vectors(spark, d), "id", "x", EPS, 5, [EPS * c for c in (1.0, 0.6, 0.4, 0.25)])


@query("m07_gaussian_mixture")
def m07(spark, d):
    return C.select_and_label(vectors(spark, d), "id", "x", "gaussian", KS)


@query("m08_online_feedback")
def m08(spark, d):
    """Two calls of a session: each learns from the feedback of half of the labelled documents, for one of five users each."""
    docs = table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 5).cast("string").alias("user"))
    given = docs.join(table(spark, d, "labels"), "doc_id").select("user", F.col("doc_id").alias("seq"), "doc_id", F.col("quality").alias("rating"), (F.col("toxic") == 1).alias("irrelevant"))
    w, session = stored(weights(docs, "doc_id", "text", (), 1, 3, 0.95), "weights"), scratch_path(spark, "feedback")
    for half in (0, 1):
        state = O.learn(session, w, given.where(F.floor(F.col("doc_id") / 10) % 2 == half), "doc_id")
    return O.predicted(state, w, docs, "doc_id")


@query("m09_kmodes")
def m09(spark, d):
    m = mixed(spark, d).withColumn("size", (F.col("size") / 10).cast("int").cast("string"))
    return C.kmodes(m, "id", ["brand", "kind", "size"], MODES)


_PAIR = f"SELECT a.item AS i, b.item AS j, round(count(*) / 3, 3) AS share FROM ({_LABELS}) a JOIN ({_LABELS}) b ON a.algorithm = b.algorithm AND a.label = b.label AND a.item < b.item GROUP BY 1, 2"


@query("m10_consensus_matrix", _PAIR)
def m10(spark, d):
    return C.consensus(cluster_labels(spark, d), "item", "algorithm", "label")


@query("m11_rbf_distance", f"SELECT i, j, round(exp(-share * share / 0.08), 6) AS distance FROM ({_PAIR})")
def m11(spark, d):
    return C.rbf_distance(C.consensus(cluster_labels(spark, d), "item", "algorithm", "label"), 0.2).select("i", "j", F.round("distance", 6).alias("distance"))


_CLASSES = f"SELECT item, min(item) OVER (PARTITION BY t) AS class, count(*) OVER (PARTITION BY t) AS n, t FROM (SELECT item, list(label ORDER BY algorithm) AS t FROM ({_LABELS}) GROUP BY item)"


@query("m10_consensus_members", f"SELECT item, class FROM ({_CLASSES})")
def m10_members(spark, d):
    return C.consensus_classes(cluster_labels(spark, d), "item", "algorithm", "label")[0]


@query(
    "m10_consensus_classes",
    f"WITH c AS (SELECT DISTINCT class, n, t FROM ({_CLASSES})), s AS (SELECT a.class AS i, b.class AS j, a.n AS n_i, b.n AS n_j, len(list_filter(range(1, 4), lambda k: a.t[k] = b.t[k])) AS k FROM c a JOIN c b ON a.class < b.class) SELECT i, j, round(k / 3, 3) AS share, n_i, n_j FROM s WHERE k > 0",
)
def m10_classes(spark, d):
    return C.consensus_classes(cluster_labels(spark, d), "item", "algorithm", "label")[1]


@query("m12_agglomerative")
def m12(spark, d):
    return C.linked_items(cluster_labels(spark, d), "item", "algorithm", "label", 0.2, 0.35)


@query("m13_model_selection")
def m13(spark, d):
    return C.scores_of_k(vectors(spark, d), "id", "x", "kmeans", KS)


def ratings(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 10).alias("user_id"), F.col("l_partkey").alias("item")).agg(F.round(F.avg("l_quantity") / 10, 2).alias("rating"))


def item_features(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("item"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")).alias("features"))


@query("m14_user_forests")
def m14(spark, d):
    return R.user_forests(ratings(spark, d), item_features(spark, d))


@query("m15_fixed_forest")
def m15(spark, d):
    return R.fixed_forest(ratings(spark, d), item_features(spark, d))


def forest_recommendation(spark, d) -> DataFrame:
    """user_id, item and prediction of what each user has not rated and will like."""
    liked = ratings(spark, d).select("user_id", "item", (F.col("rating") >= 2.5).cast("double").alias("rating"))
    return R.fixed_forest(liked, item_features(spark, d)).where("prediction >= 0.5")


@query("m16_split", "SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 10 = 0 AS test FROM labels")
def m16(spark, d):
    return R.split(table(spark, d, "labels").select("doc_id"), "doc_id", 10).select("doc_id", "test")


@query("m17_label_encoding", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders")
def m17(spark, d):
    return R.encode(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code").drop("o_orderpriority")


@query("m18_user_item_matrix", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def m18(spark, d):
    return R.matrix(table(spark, d, "orders").withColumn("one", F.lit(1)), "o_custkey", "o_orderstatus", "one", ["F", "O", "P"], 0)


@query(
    "m19_metric_frame",
    """SELECT l_linenumber AS model, unnest(['rmse', 'mae']) AS metric, unnest([round(sqrt(avg(pow(l_quantity - 25, 2))), 6), round(avg(abs(l_quantity - 25)), 6)]) AS score FROM lineitem GROUP BY l_linenumber""",
)
def m19(spark, d):
    e = E.errors(table(spark, d, "lineitem").withColumnRenamed("l_linenumber", "model"), F.col("l_quantity"), F.lit(25), ["model"])
    return E.long_form(e, ["model"], ["rmse", "mae"])


