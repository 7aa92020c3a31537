"""Line dedup by a deletion-neighbourhood join over words, in DataFrame and SQL functions only.

A line is a sequence of words. Lines of MIN_WORDS words or more count, which are all but blank ones; those always stay. So
a line of unspaced text is one word and goes if it is an exact copy. A line goes if an equal one stands earlier (smaller id, then earlier in the text), or if it has
NEAR_WORDS words or more and an earlier line is within one word of it: one word replaced, added or left out.

Near lines are found by their deletion neighbourhoods. A line of n words emits n variants, each without one word, and
itself. Two lines are one replacement apart exactly if they share a variant with the word left out at the same place;
they are one insertion apart exactly if one is a variant of the other. So the earliest line of each (variant, place)
and of each variant decides for all the others, and no pairs of a group are made. The bound is one word for that reason:
lines that share a variant without two words need not be near each other, so a group would need all its pairs. The edit
distance of each line and the earliest one found for it is verified on their words. Where it does not hold, which takes
two variants of one 64-bit key, the line goes on to the next earliest of that key, until one holds or none is left.
Variants are keyed by hashes that come from running sums (without carry), so a line of any length emits them in linear
time.

Before that, lines that cannot have a near one are left out without loss: two lines within one word share their first
or their last h words, h being the power of two of the shorter one's half. A bitmap of fixed size keeps the other lines
of a document from being shuffled when the words of those that are left are fetched.

Defined results: null text stays null; a text keeps its remaining lines in order, joined by newlines; a document all of
whose lines go has the empty text; rows without an id come last in the order; equal lines of rows that repeat an id and
the whole text are one line seen twice, so they stand or go together; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.llm.common import SPACE, stored, table

MIN_WORDS, NEAR_WORDS = 1, 5
#: Bits of the keys of variants.
KEY_BITS = 64
#: Places of the bitmap that thins lines before they are shuffled: 8 MB, whatever the input.
BITS = 2**26


def _words(line: Column, odd: Column) -> Column:
    """The words of a line; only where white space other than spaces is about, by a pattern."""
    return F.array_remove(F.when(odd, F.split(line, SPACE + "+")).otherwise(F.split(line, " ")), "")


def _odd(text: str) -> Column:
    return F.col(text).contains("\t") | F.col(text).contains("\x0b") | F.col(text).contains("\f") | F.col(text).contains("\r")


def _half(n: str) -> str:
    """The largest power of two up to half of n."""
    return f"CAST(shiftleft(1, CAST(floor(log2({n} / 2)) AS int)) AS int)"


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tie (hash of the whole text), text."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"), text.alias("text"))


def counted_lines(rows: DataFrame, near_words: int, min_words: int) -> DataFrame:
    """Each line that counts: its place (id, tie, no), line (digest of its words), ends (keys of its ends)."""
    # the generator hands on the words of a line as a value; as an expression they would be split anew for each use
    split = F.transform(F.split("text", "\n"), lambda raw: _words(raw, F.col("odd")))
    lines = rows.withColumn("odd", _odd("text")).select("id", "tie", F.posexplode(split).alias("no", "w"))
    lines = lines.withColumn("n", F.size("w")).where(F.col("n") >= min_words)
    ends = []
    for shorter in ("n", "n - 1"):
        h = _half(f"({shorter})")
        ends += [f"xxhash64({h}, 0, slice(w, 1, {h}))", f"xxhash64({h}, 1, slice(w, n - {h} + 1, {h}))"]
    # most lengths have the same halves as the length before, and so the same ends
    same, both = f"array({', '.join(ends[:2])})", f"array({', '.join(ends)})"
    return lines.select(
        "id",
        "tie",
        "no",
        F.unhex(F.md5(F.array_join("w", " ").cast("binary"))).alias("line"),
        F.expr(f"CASE WHEN n < {near_words} THEN CAST(array() AS array<bigint>) WHEN {_half('n')} = {_half('(n - 1)')} THEN {same} ELSE {both} END").alias("ends"),
    )


def _candidates(distinct: DataFrame) -> DataFrame:
    """The lines (line, id, tie, no) that share one of their ends with another line; distinct: line, at, ends."""
    ends = distinct.select("line", "at", F.explode("ends").alias("end"))
    shared = ends.groupBy("end").agg(F.min(F.xxhash64("line")).alias("a"), F.max(F.xxhash64("line")).alias("b")).where("a < b").select("end")
    return ends.join(shared, "end", "left_semi").select("line", "at.*").distinct()


def _thinned(places: DataFrame, rows: DataFrame) -> DataFrame:
    """The lines (id, tie, no, raw, odd) of the rows that may stand at one of the places: others are told by a bitmap."""
    bit = F.pmod(F.xxhash64("id", "tie", "no"), F.lit(BITS)) + 1
    maps = places.select(bit.alias("v")).groupBy(F.expr("bitmap_bucket_number(v)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(v))").alias("map"))
    lines = rows.select("id", "tie", _odd("text").alias("odd"), F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    lines = lines.withColumn("v", bit).select("id", "tie", "no", "raw", "odd", F.expr("bitmap_bucket_number(v)").alias("bucket"), F.expr("CAST(bitmap_bit_position(v) AS int)").alias("at"))
    there = "shiftright(CAST(conv(hex(substring(map, shiftright(at, 3) + 1, 1)), 16, 10) AS int), at & 7) & 1"
    return lines.join(F.broadcast(maps), "bucket").where(f"({there}) = 1").select("id", "tie", "no", "raw", "odd")


def _verified(pairs: DataFrame, candidates: DataFrame, near_words: int) -> DataFrame:
    """pairs (at, e) with the line at `at`, and near: whether the words of the two are within one word."""
    both = pairs.join(candidates, "at").join(candidates.select(F.col("at").alias("e"), F.col("w").alias("v")), "e")
    prefix = F.array_position(F.zip_with("w", "v", lambda a, b: a.eqNullSafe(b)), False)
    suffix = F.array_position(F.zip_with(F.reverse("w"), F.reverse("v"), lambda a, b: a.eqNullSafe(b)), False)
    m, n = F.least(F.size("w"), F.size("v")), F.greatest(F.size("w"), F.size("v"))
    same = F.when(prefix == 0, m).otherwise(prefix - 1) + F.when(suffix == 0, m).otherwise(suffix - 1)
    return both.select("at", "e", "line", ((same >= n - 1) & (m >= near_words)).alias("near"))


def _near(candidates: DataFrame, near_words: int, key_bits: int = KEY_BITS) -> DataFrame:
    """Of candidates (line, at, w), the lines that have an earlier line within one word."""
    each = candidates.select("at", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    # a word's value where it stands, and where it stands once a word before it is gone
    each = each.select("at", "n", "i", F.xxhash64("word", "i").alias("f"), F.xxhash64("word", F.col("i") - 1).alias("g"))
    so_far, whole = Window.partitionBy("at").orderBy("i"), Window.partitionBy("at")
    after = F.bit_xor("g").over(whole).bitwiseXOR(F.bit_xor("g").over(so_far))
    mask = F.lit(2**key_bits - 1 if key_bits < 64 else -1).cast("bigint")
    variant = F.bit_xor("f").over(so_far).bitwiseXOR(F.col("f")).bitwiseXOR(after).bitwiseAND(mask)
    each = each.select("at", "n", "i", variant.alias("variant"), F.when(F.col("i") == 0, F.bit_xor("f").over(whole).bitwiseAND(mask)).alias("own"))
    # each variant with the place of the missing word; the line itself as one where none is missing (-1)
    keys = F.array_compact(F.array(F.struct(F.col("variant").alias("key"), (F.col("n") - 1).alias("n"), F.col("i").alias("i")), F.when(F.col("own").isNotNull(), F.struct(F.col("own").alias("key"), F.col("n").alias("n"), F.lit(-1).alias("i")))))
    keyed = stored(each.select("at", F.explode(keys).alias("k")).select("at", "k.*"), "variants")
    groups = keyed.groupBy("key", "n").agg(F.min(F.when(F.col("i") >= 0, F.col("at"))).alias("longer"), F.min(F.when(F.col("i") < 0, F.col("at"))).alias("own"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = stored(keyed.join(groups, ["key", "n"]), "met")
    replaced = met.where("i >= 0").groupBy("key", "n", "i").agg(F.min("at").alias("e"), F.count("*").alias("c")).where("c > 1").drop("c")
    # for each line of a group the earliest one of it, and the places of missing words that the earlier one may have
    one = met.join(replaced, ["key", "n", "i"]).select("at", "e", "key", "n", F.col("i").alias("low"), F.col("i").alias("high"))
    other = met.select("at", F.when(F.col("i") < 0, F.col("longer")).otherwise(F.col("own")).alias("e"), "key", "n", F.when(F.col("i") < 0, 0).otherwise(-1).alias("low"), F.when(F.col("i") < 0, F.lit(2**31 - 1)).otherwise(-1).alias("high"))
    found = one.union(other).where("e < at")
    checked = stored(_verified(found.groupBy("at").agg(F.min("e").alias("e")), candidates, near_words), "checked")
    near, failed = [checked.where("near")], checked.where("NOT near").select("at", F.col("e").alias("tried"))
    while not failed.isEmpty():  # keys that collide
        found = found.join(failed, "at")
        after = found.where("e = tried").join(met.select(F.col("at").alias("next"), "key", "n", "i"), ["key", "n"]).where("next > e AND next < at AND i BETWEEN low AND high")
        after = after.groupBy("at", "key", "n", "low", "high").agg(F.min("next").alias("e")).select("at", "e", "key", "n", "low", "high")
        found = stored(found.where("e <> tried").drop("tried").union(after), "found")
        checked = stored(_verified(found.groupBy("at").agg(F.min("e").alias("e")), candidates, near_words), "checked")
        near, failed = [*near, checked.where("near")], checked.where("NOT near").select("at", F.col("e").alias("tried"))
    return reduce(DataFrame.union, near).select("line").distinct()


def repeated_lines(rows: DataFrame, near_words: int = NEAR_WORDS, min_words: int = MIN_WORDS, key_bits: int = KEY_BITS) -> DataFrame:
    """id, tie and gone (numbers of the lines that go, from 0) of the documents (id, tie, text) that lose lines."""
    lines = stored(counted_lines(rows, near_words, min_words), "lines")
    # a line's ends go with it, so a line that many documents have is looked for once
    distinct = stored(lines.groupBy("line").agg(F.min(F.struct("id", "tie", "no")).alias("at"), F.count("*").alias("copies"), F.first("ends").alias("ends")), "distinct")
    places = stored(_candidates(distinct), "places")
    found = _thinned(places, rows).join(places, ["id", "tie", "no"])
    candidates = stored(found.select("line", F.struct("id", "tie", "no").alias("at"), _words(F.col("raw"), F.col("odd")).alias("w")), "candidates")
    near = _near(candidates, near_words, key_bits).withColumn("near", F.lit(True))
    verdict = distinct.join(near, "line", "left").where("copies > 1 OR near").select("line", F.col("at").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    verdict = stored(verdict, "verdict")  # a table, so that both sides of the join are exchanges and a hot line is split
    gone = lines.select("line", "id", "tie", "no").join(verdict, "line").where("near OR struct(id, tie, no) > first")
    return gone.groupBy("id", "tie").agg(F.array_sort(F.collect_set("no")).alias("gone"))


def dedup_lines(docs: DataFrame, near_words: int = NEAR_WORDS, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", gone_col: str = "gone_lines", key_bits: int = KEY_BITS) -> DataFrame:
    """docs with the text that stays, and gone_col: the numbers of the lines that went (a column of docs with that name is replaced)."""
    gone = repeated_lines(numbered(docs, id_col, text_col), near_words, min_words, key_bits)
    own = [c for c in docs.columns if c.lower() != gone_col.lower()]
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(2**63 - 1)).alias("id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"),
        text.alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in own if c != text_col] or [F.lit(0).alias("none")]).alias("rest"),
    )
    out = keyed.join(gone.hint("shuffle_hash"), ["id", "tie"], "left")
    numbers = F.array_except(F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1), F.col("gone"))
    kept = F.transform(F.array(F.split("text", "\n")), lambda lines: F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n"))[0]
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    columns = [left.alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in own]
    return out.select(*columns, F.coalesce("gone", F.array().cast("array<int>")).alias(gone_col))


def op6_deletion_neighbourhood_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n"))))
    return out.select("doc_id", "n_lines", F.size("gone_lines").alias("n_gone"), "gone_lines", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
