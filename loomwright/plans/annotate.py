"""Annotation of products from their texts, and features made of attributes."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import similarity as S
from loomwright.functions import text as X
from loomwright.operators.fuzzy import likest
from loomwright.operators.joins import phrase_matches
from loomwright.registry import query, table
from loomwright.storage import stored


def collapsed(df: DataFrame, key: str, texts: list[str], lists: dict[str, str]) -> DataFrame:
    """A row for each product: first texts by `seq`, and for each list column its values in the order of another."""
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(c) for c in texts]
    made = [F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v")))), lambda s: s["v"]).alias(c) for c, order in lists.items()]
    return df.groupBy(key).agg(*first, *made)


def product_words(df: DataFrame, key: str, columns: list[str], stop: list[str]) -> DataFrame:
    """The distinct preprocessed words of some columns, in alphabetical order."""
    text = X.preprocess(F.concat_ws(" ", *columns), stop)
    return df.select(key, F.array_join(F.array_sort(F.array_distinct(X.tokens(text))), " ").alias("words"))


def occurrences(df: DataFrame, labels: DataFrame, key: str, sources: dict[str, int]) -> DataFrame:
    """key, attr, label, pos, src: where labels (attr, label) stand as whole words in the text columns; src orders columns."""
    named = labels.select("attr", F.lower("label").alias("label")).distinct()
    return _placed(df, named.select("label").distinct(), key, sources).join(named, "label")


def _placed(df: DataFrame, labels: DataFrame, key: str, sources: dict[str, int]) -> DataFrame:
    """key, src, label and pos: all texts of a product are looked through in one pass."""
    texts = F.explode(F.array(*[F.struct(F.lit(n).alias("src"), F.lower(c).alias("t")) for c, n in sources.items()])).alias("x")
    each = df.select(key, texts).select(F.struct(key, "x.src").alias("at"), "x.t")
    return phrase_matches(each, labels, "at", "t", "label").select("at.*", "label", "pos")


def annotated(df: DataFrame, labels: DataFrame, key: str, sources: dict[str, int], alike: float = 0.8) -> DataFrame:
    """The labels of each attribute, headline first, without the later one of two that are alike.

    A length that is followed by SLEEVE in the same text is the sleeve's and does not count. A product has few labels,
    so pairs are made within its own list.
    """
    named = labels.select("attr", F.lower("label").alias("label")).distinct()
    sleeve = named.where((F.lower("attr") == "length") & ~F.col("label").rlike(r"\s")).select("label", F.concat("label", F.lit(" sleeve")).alias("run"))
    placed = stored(_placed(df.where(F.col(key).isNotNull()), named.select("label").union(sleeve.select("run")).distinct(), key, sources), "placed")
    bad = placed.withColumnRenamed("label", "run").join(sleeve, "run").select(key, "label", F.lit(True).alias("_bad")).distinct()
    found = placed.join(named, "label").join(bad, [key, "label"], "left").where("NOT (lower(attr) = 'length' AND coalesce(_bad, false))")
    found = found.withColumn("form", X.canonical_label(F.col("label"), F.col("attr")))
    by = stored(found.groupBy(key, "attr").agg(F.array_sort(F.collect_list(F.struct("src", "pos", "form"))).alias("all")), "labels")
    pairs = by.select(key, "attr", F.posexplode("all").alias("i", "a"), "all").select(key, "attr", F.col("a.form").alias("a"), "i", F.posexplode("all").alias("j", "b")).where("i < j").select(key, "attr", "a", F.col("b.form").alias("b"), F.col("j").alias("i"))
    # two forms are compared once, however many products have both
    same = stored(pairs.select("a", "b").distinct().where(S.gestalt_ratio("a", "b") >= alike), "alike")
    late = pairs.join(same, ["a", "b"]).select(key, "attr", "i").distinct()
    kept = by.select(key, "attr", F.posexplode("all").alias("i", "a")).join(late, [key, "attr", "i"], "left_anti")
    lists = kept.groupBy(key, "attr").agg(F.array_sort(F.collect_list(F.struct("i", F.col("a.form").alias("form")))).alias("l"))
    names = F.transform("l", lambda s: s["form"])
    return lists.select(key, "attr", F.array_join(names, ",").alias("labels"), F.get(names, F.lit(0)).alias("label"))


def fill_missing(products: DataFrame, found: DataFrame, dim: DataFrame, key: str, column: str, attr: str) -> DataFrame:
    """The dimension's key where the product has none and a label was found."""
    new = found.where(F.col("attr") == attr).join(dim.select(F.upper("description").alias("label"), F.col("oid").alias("_oid")), "label").groupBy(key).agg(F.min("_oid").alias("_oid"))
    return products.join(new, key, "left").withColumn(column, F.coalesce(column, "_oid")).drop("_oid")


def multi_hot(df: DataFrame, key: str, columns: list[str], separator: str | None = ",") -> DataFrame:
    """key, token, 1 in long form: the tokens of several columns; null is the token NAN. widen() makes columns of it."""
    parts = [X.multi_words(F.coalesce(F.col(c), F.lit("nan"))) if separator is None else F.transform(F.split(F.coalesce(F.col(c), F.lit("NAN")), separator), F.trim) for c in columns]
    return df.select(key, F.explode(F.array_distinct(F.concat(*parts))).alias("token")).where("token <> ''").withColumn("has", F.lit(1))


def widen(long: DataFrame, key: str, tokens: list[str]) -> DataFrame:
    """A 0/1 column for each of the given tokens."""
    return long.groupBy(key).pivot("token", tokens).agg(F.max("has")).fillna(0)


#: Components of a pattern whose subsets are counted; pairs with larger ones are found through what they share.
SUBSETS = 16


def disjoint_pairs(patterns: DataFrame) -> DataFrame:
    """n: the ordered pairs of rows that share nothing. patterns: p (distinct sets, as sorted arrays) and c (rows).

    By inclusion and exclusion: the pairs of rows that both have all of a set, added over all sets of an even number of
    components (the empty one too) and taken off over all others. A set's rows are counted once, so there are no pairs.
    """
    subsets = F.aggregate("p", F.array(F.array().cast("array<int>")), lambda a, x: F.concat(a, F.transform(a, lambda s: F.concat(s, F.array(x.cast("int"))))))
    counts = patterns.select("c", F.explode(subsets).alias("s")).groupBy("s").agg(F.sum("c").cast("decimal(19,0)").alias("c"))
    sign = F.when(F.size("s") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    return counts.agg(F.coalesce(F.sum((sign * F.col("c") * F.col("c")).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("n"))


def sharing_pairs(patterns: DataFrame, most: int = 0) -> DataFrame:
    """pairs: the pairs of different rows that share a component (one row). patterns: p (distinct, not empty) and c.

    Components that one row alone has are left out of the sets, as they are never shared. Sets of more than `most`
    components that are left meet others by what they share.
    """
    most = most or SUBSETS
    patterns = stored(patterns.select("p", "c"), "patterns")
    each = patterns.select("p", "c", F.explode("p").alias("i"))
    common = each.groupBy("i").agg(F.sum("c").alias("n")).where("n > 1").select("i")
    kept = each.join(common, "i").groupBy("p", "c").agg(F.sort_array(F.collect_set("i")).alias("q"))
    sets = patterns.join(kept, ["p", "c"], "left").groupBy(F.coalesce("q", F.array().cast("array<int>")).alias("p")).agg(F.sum("c").alias("c"))
    sets = stored(sets, "sets")
    small, large = sets.where(F.size("p") <= most), sets.where(F.size("p") > most)
    total = patterns.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("decimal(19,0)").alias("all"))
    among = small.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("decimal(19,0)").alias("few"), F.coalesce(F.sum(F.when(F.size("p") > 0, F.col("c"))), F.lit(0)).cast("decimal(19,0)").alias("own"))
    one = disjoint_pairs(small).crossJoin(F.broadcast(among)).crossJoin(F.broadcast(total))  # one row each
    # a row with nothing common is disjoint from itself too, by its set; all others share with themselves
    pairs = (F.col("few") * F.col("few") - F.col("n") - F.col("own")) / 2
    if not large.isEmpty():
        at = large.select("p", "c", F.explode("p").alias("i"))
        other = sets.select(F.col("p").alias("q"), F.col("c").alias("d"), F.explode("p").alias("i"))
        met = at.join(other, "i").where((F.size("q") <= most) | (F.col("p") < F.col("q"))).select("p", "q", "c", "d").distinct()
        across = met.agg(F.coalesce(F.sum((F.col("c") * F.col("d")).cast("decimal(38,0)")), F.lit(0)).alias("across"))
        within = large.agg(F.sum((F.col("c") * (F.col("c") - 1) / 2).cast("decimal(38,0)")).alias("within"))
        one, pairs = one.crossJoin(F.broadcast(across)).crossJoin(F.broadcast(within)), pairs + F.col("across") + F.col("within")
    return one.select(pairs.cast("double").alias("pairs"))


def diversity(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """1 less the mean of the cosines of all pairs that are not 0, to three places, for a list of recommendations.

    Each vector is made one of unit length; the sum of all cosines is the squared length of the sum of these vectors. A
    cosine is not 0 if two vectors have a component in common (features are not negative, so nothing cancels out, and
    real-valued ones do so with probability 0). Such pairs are counted by pattern, the set of a vector's components,
    without pairs of rows or of patterns. A vector of nothing has no cosine; without pairs the answer is null.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    some = vectors.select(id_col, vector, norm.alias("n")).where("n > 0")
    unit = some.select(id_col, F.posexplode(vector).alias("i", "x"), "n").select(id_col, "i", (F.col("x") / F.col("n")).alias("u"))
    total = unit.groupBy("i").agg(F.sum("u").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("all"))
    parts = F.filter(F.transform(vector, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    patterns = stored(some.groupBy(parts.alias("p")).agg(F.count("*").alias("c")), "patterns")
    width = patterns.agg(F.sum("c").alias("n"), F.count("*").alias("kinds")).first()
    # a component that all rows have makes every pair one that shares
    full = patterns.select("c", F.explode("p").alias("i")).groupBy("i").agg(F.sum("c").alias("n")).where(F.col("n") == (width["n"] or 0))
    n = width["n"] or 0
    pairs = sharing_pairs(patterns) if full.isEmpty() else patterns.sparkSession.createDataFrame([(n * (n - 1) / 2,)], "pairs double")
    one = total.crossJoin(F.broadcast(pairs))
    return one.select(F.round(1 - F.try_divide((F.col("all") - F.lit(n)) / 2, F.col("pairs")), 3).alias("diversity"))


LABELS = [("Length", "the"), ("Length", "and"), ("Fit", "of the"), ("Fit", "of"), ("Sleeve", "la"), ("Sleeve", "und"), ("NeckDesign", "in"), ("NeckDesign", "is")]


#: Pairs of label forms that are alike, by the standard library's measure.
_ALIKE = ", ".join(f"('{a}', '{b}')" for a in sorted({x.upper() for _, x in LABELS}) for b in sorted({x.upper() for _, x in LABELS}) if difflib.SequenceMatcher(None, a, b).ratio() >= 0.8)
_NAMED = ", ".join(f"('{a}', '{x}', '{x.upper()}')" for a, x in LABELS)


@query(
    "x09_label_annotation",
    rf"""WITH w AS (SELECT doc_id AS oid, src, list_filter(regexp_split_to_array(lower(t), '[ 	

]+'), lambda x: x <> '') AS w FROM
  (SELECT doc_id, 0 AS src, string_split(text, chr(10))[1] AS t FROM documents UNION ALL SELECT doc_id, 1, text FROM documents)),
 l(attr, label, form) AS (VALUES {_NAMED}), alike(a, b) AS (VALUES {_ALIKE}),
 two AS (SELECT oid, src, w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS r FROM w),
 bad AS (SELECT DISTINCT oid, label FROM two, l WHERE list_contains(r, label || ' sleeve')),
 hit AS (SELECT oid, attr, src, form, CASE WHEN contains(label, ' ') THEN list_position(r, label) ELSE list_position(w, label) END AS pos, l.label FROM two, l),
 good AS (SELECT oid, attr, src, form, pos FROM hit WHERE pos > 0 AND NOT (attr = 'Length' AND (oid, label) IN (SELECT oid, label FROM bad))),
 num AS (SELECT *, row_number() OVER (PARTITION BY oid, attr ORDER BY src, pos, form) AS i FROM good),
 kept AS (SELECT * FROM num n WHERE NOT EXISTS (SELECT 1 FROM num m JOIN alike ON m.form = a WHERE m.oid = n.oid AND m.attr = n.attr AND m.i < n.i AND n.form = b))
 SELECT oid, attr, string_agg(form, ',' ORDER BY i) AS labels, min_by(form, i) AS label FROM kept GROUP BY oid, attr""",
)
def x09(spark, d):
    labels = spark.createDataFrame(LABELS, "attr string, label string")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("oid"), F.substring_index("text", "\n", 1).alias("headline"), F.col("text").alias("metadata"))
    return annotated(docs, labels, "oid", {"headline": 0, "metadata": 1})


@query(
    "x09_label_positions",
    """SELECT p_partkey, label, min(i) - 1 AS pos FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS label, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part) WHERE label IN (SELECT DISTINCT lower(string_split(p_name, ' ')[1]) FROM part) GROUP BY 1, 2""",
)
def x09b(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    labels = p.select(F.lit("any").alias("attr"), F.split(F.lower("p_name"), " ")[0].alias("label")).distinct()
    return occurrences(p, labels, "p_partkey", {"p_name": 0}).select("p_partkey", "label", "pos")


@query("x10_product_words", "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(lower(p_mfgr), ' '))), ' ') AS words FROM (SELECT p_partkey, 'cotton dress ' || CASE WHEN p_size > 20 THEN 'large' ELSE 'small' END AS p_mfgr FROM part)")
def x10(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lit("Cotton DRESS!").alias("a"), F.when(F.col("p_size") > 20, F.lit("dresses of 12 large")).otherwise(F.lit("small, cotton")).alias("b"))
    return product_words(p, "p_partkey", ["a", "b"], ["of"])


@query("x10_collapse", "SELECT l_partkey, count(*) AS n, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_quantity, l_suppkey) AS sups FROM lineitem GROUP BY l_partkey")
def x10b(spark, d):
    li = table(spark, d, "lineitem").withColumn("seq", F.col("l_orderkey")).withColumn("one", F.lit("x"))
    c = collapsed(li, "l_partkey", ["one"], {"l_suppkey": "l_quantity"})
    return c.select("l_partkey", F.size("l_suppkey").cast("long").alias("n"), F.array_join(F.transform("l_suppkey", lambda x: x.cast("string")), ",").alias("sups"))


@query("x12_search_word_hot", "SELECT doc_id, CAST(contains(' ' || t || ' ', ' the ') AS INTEGER) AS the, CAST(contains(' ' || t || ' ', ' la ') AS INTEGER) AS la FROM (SELECT doc_id, regexp_replace(lower(text), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g') AS t FROM documents)")
def x12(spark, d):
    t = X.squeeze(F.lower("text"))
    return table(spark, d, "documents").select("doc_id", *[X.has_word(t, F.lit(w)).cast("int").alias(w) for w in ("the", "la")])


@query("x13_multi_hot", "SELECT p_partkey, CAST(p_brand = 'Brand#11' AS INTEGER) AS \"Brand#11\", CAST(p_brand = 'Brand#12' AS INTEGER) AS \"Brand#12\", CAST(p_size > 25 AS INTEGER) AS \"NAN\" FROM part")
def x13(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") <= 25, F.lit("small, x")).alias("size"))
    return widen(multi_hot(p, "p_partkey", ["p_brand", "size"]), "p_partkey", ["Brand#11", "Brand#12", "NAN"])


@query("x14_multi_hot_pattern", "SELECT p_partkey, token, 1 AS has FROM (SELECT DISTINCT p_partkey, unnest(regexp_split_to_array(lower(p_type), '/|,|to|and| |&|-')) AS token FROM part) WHERE token <> ''")
def x14(spark, d):
    return multi_hot(table(spark, d, "part"), "p_partkey", ["p_type"], None)


@query(
    "x17_diversity",
    "SELECT round(1 - avg(c), 3) AS diversity FROM (SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE c <> 0",
)
def x17(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return diversity(e, "vec_id", "embedding")


@query(
    "x17_diversity_of_attributes",
    """WITH v AS (SELECT p_partkey AS id, [CAST(p_size % 7 = k AS DOUBLE) FOR k IN [0, 1, 2, 3, 4]] || [CAST(contains(p_name, w) AS DOUBLE) FOR w IN ['red', 'blue', 'widget', 'steel']] AS x FROM part),
 s AS (SELECT * FROM v WHERE list_sum(x) > 0)
 SELECT round(1 - avg(c), 3) AS diversity FROM (SELECT list_cosine_similarity(a.x, b.x) AS c FROM s a JOIN s b ON a.id < b.id) WHERE c <> 0""",
)
def x17b(spark, d):
    size = [(F.col("p_size") % 7 == k).cast("double") for k in range(5)]
    words = [F.contains("p_name", F.lit(w)).cast("double") for w in ("red", "blue", "widget", "steel")]
    return diversity(table(spark, d, "part").select("p_partkey", F.array(*size, *words).alias("x")), "p_partkey", "x")


def recommended_from_query(products: DataFrame, predicted: DataFrame, term: str, k: int = 3) -> DataFrame:
    """user_id, item, prediction and grade of what a search recommends to each user, by system grade.

    products: item, word (its search words), grade. predicted: user_id, item and prediction of unrated items that a model
    keeps. The k likest of all search words stand for the term.
    """
    asked = products.sparkSession.createDataFrame([(term.lower(),)], "term string")
    found = likest(asked, "term", products.select(F.lower("word").alias("word")), "word", k).select("word")
    matched = products.withColumn("word", F.lower("word")).join(found, "word").select("item", "grade")
    return matched.join(predicted, "item").select("user_id", "item", "prediction", "grade").orderBy("user_id", "grade", "item")


@query("x18_recommend_from_query")
def x18(spark, d):
    from loomwright.plans.models import forest_recommendation

    grade = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.max("l_linenumber").alias("grade"))
    products = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("word")).join(grade, "item", "left")
    return recommended_from_query(products, forest_recommendation(spark, d), "red widgets")


@query("x21_feature_merge", "SELECT p_partkey, p_size, grade, CAST(p_size > 25 AS INTEGER) AS big FROM part JOIN (SELECT l_partkey, max(l_linenumber) AS grade FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def x21(spark, d):
    p = table(spark, d, "part")
    grade = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_linenumber").alias("grade"))
    return p.select("p_partkey", "p_size").join(grade, "p_partkey").join(p.select("p_partkey", (F.col("p_size") > 25).cast("int").alias("big")), "p_partkey")
