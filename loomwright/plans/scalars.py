"""Scalar functions on texts, JSON, dates and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions import similarity as S
from loomwright.functions import text as X
from loomwright.operators import vocabulary as V
from loomwright.operators.fuzzy import likest
from loomwright.plans.joins import _COLOURS, colours
from loomwright.registry import query, table
from loomwright.sources.fixed import LABEL_CODES
from loomwright.storage import stored

STOP = ["the", "and", "for", "that", "with", "was", "und", "der", "die", "que", "les", "des", "los", "las"]
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
_SPLIT = r"list_filter(regexp_split_to_array({}, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _q(name, sql, column):
    @query(name, f"SELECT doc_id, md5({sql}) AS digest FROM documents")
    def run(spark, d):
        return docs(spark, d).select("doc_id", F.md5(column(F.col("text")).cast("binary")).alias("digest"))


_P = r"[!-/:-@\[-^`{-~]+"
_q("f01_lower", "lower(text)", F.lower)
_q("f02_strip_urls", r"regexp_replace(text, '(www\S+)*(.\S+\.com)', '', 'g')", X.strip_urls)
_q("f03_strip_punctuation", f"regexp_replace(text, '{_P}', ' ', 'g')", X.strip_punctuation)
_q("f04_drop_short_words", f"array_to_string(list_filter({_SPLIT.format('text')}, lambda w: length(w) > 2), ' ')", X.drop_short)
_q("f05_drop_numbers", "regexp_replace(text, '([a-z]*[0-9]+[a-z]*)', '', 'g')", X.drop_numbers)
_q("f06_ascii_only", r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')", X.ascii_only)
_q("f07_squeeze", r"regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')", X.squeeze)
_q("f08_stop_words", f"array_to_string(list_filter({_SPLIT.format('text')}, lambda w: NOT list_contains({_STOP}, w)), ' ')", lambda t: X.drop_words(t, STOP))
_LEMMA = """CASE WHEN regexp_matches(w, 'men$') AND length(w) > 3 THEN regexp_replace(w, 'men$', 'man') WHEN length(w) <= 3 THEN w
 WHEN regexp_matches(w, 'ies$') AND length(w) > 4 THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(ss|x|ch|sh|zz)es$') THEN regexp_replace(w, 'es$', '')
 WHEN regexp_matches(w, '(ss|us|is)$') THEN w ELSE regexp_replace(w, 's$', '') END"""
_q("f11_noun_lemmas", f"array_to_string(list_transform({_SPLIT.format('text')}, lambda w: {_LEMMA}), ' ')", X.lemmatise)
_q("f12_lemmas_of_words", f"array_to_string(list_transform(string_split(lower(text), ' '), lambda w: {_LEMMA}), '+')", lambda t: F.array_join(F.transform(F.split(F.lower(t), " "), X.lemma), "+"))
_q("f20_split_join", "array_to_string(list_transform(string_split(text, ','), lambda w: replace(w, ' ', '_')), ' ')", lambda t: F.array_join(F.transform(F.split(t, ","), lambda w: F.replace(w, F.lit(" "), F.lit("_"))), " "))
_q("f21_unique_tokens", f"array_to_string(list_sort(list_distinct({_SPLIT.format('text')})), ' ')", lambda t: F.array_join(F.array_sort(F.array_distinct(X.tokens(t))), " "))
_q("f23_letters_only", "array_to_string(regexp_extract_all(text, '[a-zA-Z]+'), ' ')", lambda t: F.array_join(F.regexp_extract_all(t, F.lit("[a-zA-Z]+"), 0), " "))
_q("f24_folder_name", "replace(trim(regexp_replace(text, '[0-9]', '', 'g')), ' ', '')", X.folder_name)
_q("f33_unescape", "replace(replace(text, '''', '\\'''), '\\', '')", lambda t: F.replace(F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("\\"), F.lit("")))


def _shortened(x: str) -> str:
    """A text in which a character goes that repeats the three before it; ends of lines stay."""
    behind = ", ".join(f"list_concat(list_resize([]::VARCHAR[], {k}), string_split({x}, ''))" for k in range(4))
    same = "z[1] = z[2] AND z[1] = z[3] AND z[1] = z[4] AND unicode(z[1]) NOT IN (10, 13, 133, 8232, 8233)"
    return f"array_to_string(list_transform(list_filter(list_zip({behind}), lambda z: z[1] IS NOT NULL AND coalesce(NOT ({same}), true)), lambda z: z[1]), '')"


def _tokens_sql(x: str) -> str:
    return f"""regexp_extract_all({x}, '{X.POST_TOKEN.replace("'", "''")}')"""


@query("f10_shorten_runs", f"SELECT doc_id, {_shortened("regexp_replace(text, '([aeo])', '\\1\\1\\1\\1', 'g')")} AS text FROM documents")
def f10(spark, d):
    return docs(spark, d).select("doc_id", X.shorten_runs(F.regexp_replace("text", "([aeo])", "$1$1$1$1")).alias("text"))


@query("f10_post_tokens", f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_tokens_sql(_shortened('text'))} AS t FROM documents)")
def f10b(spark, d):
    t = docs(spark, d).select("doc_id", X.post_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


_CHAIN = "lower(text)"
for _f in (
    lambda x: rf"regexp_replace({x}, '(www\S+)*(.\S+\.com)', '', 'g')",
    lambda x: f"regexp_replace({x}, '{_P}', ' ', 'g')",
    lambda x: f"array_to_string(list_filter({_SPLIT.format(x)}, lambda w: length(w) > 2), ' ')",
    lambda x: f"regexp_replace({x}, '([a-z]*[0-9]+[a-z]*)', '', 'g')",
    lambda x: rf"regexp_replace({x}, '[^\x00-\x7F]', '', 'g')",
    lambda x: f"array_to_string(list_filter({_SPLIT.format(x)}, lambda w: NOT list_contains({_STOP}, w)), ' ')",
    *[lambda x, c=c: f"regexp_replace({x}, '{c}{{4,}}', '{c * 3}', 'g')" for c in "abcdefghijklmnopqrstuvwxyz_"],
    lambda x: f"array_to_string(list_transform({_tokens_sql(x)}, lambda w: {_LEMMA}), ' ')",
):
    _CHAIN = _f(_CHAIN)
_q("f13_text_pipeline", _CHAIN, lambda t: X.preprocess(t, STOP))


def letters(text) -> Column:
    """The words of a text: runs of letters, lowered."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


@query("f09_segmentation")
def f09(spark, d):
    """Texts without their spaces, split again by the counts of the corpus's own words."""
    counts = V.dictionary(V.unigrams(docs(spark, d), letters("text")))
    spread = docs(spark, d).repartition("doc_id")  # a letter costs much more than its way; files may come in few parts
    return spread.select("doc_id", S.segment(F.regexp_replace("text", " ", ""), counts).alias("words"))


@query("f14_spelling")
def f14(spark, d):
    """Words of fewer than five occurrences in the corpus are spelt as the frequent words near them."""
    known = stored(V.unigrams(docs(spark, d), letters("text")).where("n >= 5"), "known")
    return V.corrected_texts(docs(spark, d), "doc_id", letters("text"), known)


@query("f15_gestalt_ratio")
def f15(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(S.gestalt_ratio(F.lower("p_name"), F.lower("p_type")), 6).alias("ratio"))


@query("t09_fuzzy_top_k")
def t09(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.lower("p_brand").alias("brand"))
    found = likest(part, "brand", part, "brand", 3).groupBy("term").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("w"))  # three rows at most
    return part.join(found, F.col("brand") == F.col("term"), "left").select("p_partkey", F.coalesce(F.col("w.word"), F.array().cast("array<string>")).alias("close"))


@query("f16_whole_word", "SELECT doc_id, contains(' ' || text || ' ', ' the ') AS hit FROM documents")
def f16(spark, d):
    return docs(spark, d).select("doc_id", X.has_word(F.col("text"), F.lit("the")).alias("hit"))


@query("f17_first_position", "SELECT doc_id, strpos(text, 'an') - 1 AS pos FROM documents")
def f17(spark, d):
    return docs(spark, d).select("doc_id", X.position(F.col("text"), F.lit("an")).alias("pos"))


_LABELS = ("v-neck", "short", "knee", "maxi", "mao", "slim", "Polo", "off-shoulder")
_ATTRIBUTES = ("NeckDesign", "Length", "CollarDesign", "Fit")


@query(
    "f18_label_forms",
    f"""SELECT p_partkey, CASE WHEN attr = 'NeckDesign' AND label IN ('v-neck', 'off-shoulder') THEN replace(upper(label), '-', ' ') WHEN attr = 'Length' AND label IN ('short', 'knee') THEN upper(label) || ' LENGTH'
 WHEN attr = 'Length' AND label = 'maxi' THEN 'LONG' WHEN attr = 'CollarDesign' AND label IN ('mao', 'Polo') THEN upper(label) || ' COLLAR' WHEN attr = 'Fit' AND label = 'slim' THEN 'SLIM FIT' ELSE upper(label) END AS form
 FROM (SELECT p_partkey, ({list(_LABELS)})[p_partkey % {len(_LABELS)} + 1] AS label, ({list(_ATTRIBUTES)})[p_size % {len(_ATTRIBUTES)} + 1] AS attr FROM part)""",
)
def f18(spark, d):
    """Labels as a product's sellers write them: here one for each part, of one of four attributes."""
    nth = lambda of, n: F.get(F.array(*map(F.lit, of)), (n % len(of)).cast("int"))
    p = table(spark, d, "part").select("p_partkey", nth(_LABELS, F.col("p_partkey")).alias("label"), nth(_ATTRIBUTES, F.col("p_size")).alias("attr"))
    return p.select("p_partkey", X.canonical_label(F.col("label"), F.col("attr")).alias("form"))


@query("f19_next_token_guard", "SELECT doc_id, contains(' ' || array_to_string(string_split(lower(text), ' '), ' ') || ' ', ' of the ') AS guarded FROM documents")
def f19(spark, d):
    return docs(spark, d).select("doc_id", X.followed_by(F.split("text", " "), F.lit("of"), "the").alias("guarded"))


@query("f22_separators", "SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(regexp_split_to_array(lower(p_type || '/' || p_name), '/|,|to|and| |&|-')), lambda w: w <> '')), ';') AS parts FROM part")
def f22(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(X.multi_words(F.concat_ws("/", "p_type", "p_name"))), ";").alias("parts"))


@query("f24_third_slash", "SELECT page_id, array_to_string(string_split(url, '/')[1:3], '/') AS site FROM pages")
def f24(spark, d):
    return table(spark, d, "pages").select("page_id", X.third_slash(F.col("url")).alias("site"))


@query("f25_urls", r"SELECT page_id, regexp_replace(url, '\?[^?]*$', '') AS bare, 'https://x.example/s?q=' || replace('a b', ' ', '%20') AS search FROM pages")
def f25(spark, d):
    return table(spark, d, "pages").select("page_id", X.without_query(F.col("url")).alias("bare"), X.search_url("https://x.example/s?q=", F.lit(" a  b ")).alias("search"))


@query("f26_prices", "SELECT p_partkey, round(p_retailprice, 2) AS price, CASE WHEN p_size > 25 THEN round(p_retailprice, 2) / 100 ELSE round(p_retailprice, 2) END AS sale FROM part")
def f26(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", F.concat(F.lit("€ "), F.replace(F.round("p_retailprice", 2).cast("string"), F.lit("."), F.lit(","))).alias("t"))
    return p.withColumn("price", X.price(F.col("t"))).select("p_partkey", "price", F.when(F.col("p_size") > 25, F.col("price") / 100).otherwise(F.col("price")).alias("sale"))


@query("f27_strip_tags", "SELECT page_id, md5(regexp_replace(html, '<.+?>', ' ', 'g')) AS digest FROM pages")
def f27(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.strip_tags(F.col("html")).cast("binary")).alias("digest"))


@query("f27_title_of_page", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def f27b(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("f28_json_path", "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
def f28(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


@query("f29_json_filter_by_id", "SELECT event_id, 'v' || (event_id % 3) AS value FROM events")
def f29(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"a":[{"id":0,"v":"v0"},{"id":1,"v":"v1"},{"id":2,"v":"v2"}],"want":'), F.col("event_id") % 3, F.lit("}")).alias("j"))
    j = F.from_json("j", "a ARRAY<STRUCT<id: INT, v: STRING>>, want INT")
    return e.select("event_id", j.alias("j")).select("event_id", F.array_join(F.transform(F.filter("j.a", lambda x: x["id"] == F.col("j.want")), lambda x: x["v"]), " ").alias("value"))


@query("f30_path_from_end", "SELECT page_id, string_split(url, '/')[-2] AS category, string_split(url, '/')[-1] AS sub FROM pages")
def f30(spark, d):
    p = F.split("url", "/")
    return table(spark, d, "pages").select("page_id", F.element_at(p, -2).alias("category"), F.element_at(p, -1).alias("sub"))


@query("f31_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(epoch(o_orderdate) AS BIGINT) AS epoch FROM orders")
def f31(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    return o.select("o_orderkey", F.date_format("t", "yyyy-MM-dd").alias("day"), F.unix_timestamp("t").alias("epoch"))


@query("f32_utc_now", "SELECT true AS now_is_after")
def f32(spark, d):
    return table(spark, d, "orders").agg((F.max("o_orderdate").cast("timestamp") < F.current_timestamp()).alias("now_is_after"))


@query("f34_casts", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DOUBLE) AS f, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS bit, TRY_CAST(l_returnflag AS INTEGER) AS bad FROM lineitem")
def f34(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("double").alias("f"), (F.col("l_discount") > 0.05).cast("int").alias("bit"), F.col("l_returnflag").try_cast("int").alias("bad"))


@query("f35_maths", "SELECT p_partkey, round(-ln(p_size / 100), 6) AS a, round(exp(p_size / 50), 6) AS b, round(log2(p_size), 6) AS c, round(sqrt(p_size), 6) AS d FROM part")
def f35(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.round(-F.log(s / 100), 6).alias("a"), F.round(F.exp(s / 50), 6).alias("b"), F.round(F.log2(s.cast("double")), 6).alias("c"), F.round(F.sqrt(s), 6).alias("d"))


@query("f36_rank_share", "SELECT l_orderkey, l_linenumber, round(t / nullif(t + r, 0), 6) AS trend, round(r / nullif(t + r, 0), 6) AS reference FROM (SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS t, l_partkey % 3 AS r FROM lineitem)")
def f36(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).alias("t"), (F.col("l_partkey") % 3).alias("r"))
    return x.select("l_orderkey", "l_linenumber", *[F.round(F.try_divide(F.col(c), F.col("t") + F.col("r")), 6).alias(n) for c, n in (("t", "trend"), ("r", "reference"))])


@query("f37_rgb_distance", f"SELECT p_partkey, (red - 255) * (red - 255) + green * green + (blue - 10) * (blue - 10) AS far FROM ({_COLOURS})")
def f37(spark, d):
    return colours(spark, d).select("p_partkey", ((F.col("red") - 255) * (F.col("red") - 255) + F.col("green") * F.col("green") + (F.col("blue") - 10) * (F.col("blue") - 10)).alias("far"))


@query("f38_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'S' WHEN p_size < 30 THEN 'M' ELSE 'L' END AS size FROM part")
def f38(spark, d):
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") < 10, "S").when(F.col("p_size") < 30, "M").otherwise("L").alias("size"))


_CASES = " ".join(f"WHEN {k} THEN {v}" for k, v in LABEL_CODES["Sleeve"].items())


@query("f39_label_codes", f"SELECT p_partkey, CASE p_size % 6 {_CASES} END AS sleeve FROM part")
def f39(spark, d):
    from loomwright.operators.joins import lookup

    return lookup(table(spark, d, "part").select("p_partkey", (F.col("p_size") % 6).alias("c")), "c", LABEL_CODES["Sleeve"], "sleeve").drop("c")


@query("f40_type_inference", "SELECT CAST(n_nationkey AS DOUBLE) AS a, n_name AS b FROM nation")
def f40(spark, d):
    from loomwright.operators.predicates import infer_numbers

    return infer_numbers(table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("a"), F.col("n_name").alias("b")))


@query("f41_image_names", "SELECT o_orderkey, 'image' || (o_orderkey % 10) || '_' || strftime(o_orderdate, '%d%m%Y') || '.jpeg' AS file FROM orders")
def f41(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.image_name(F.col("o_orderkey") % 10, F.col("o_orderdate").cast("timestamp")).alias("file"))
