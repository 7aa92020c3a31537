"""The likest words of a dimension, as a join.

A word's letters, each with its number among equal ones, are a set; the ratio of two words is at most twice what these
sets share over the sum of their sizes. So a ratio of at least the cutoff needs sizes not too different and a share of
known size, and the rarest letters of both (all but those that may differ) have one in common. Only these are joined;
sizes and whole sets are checked next, and only what is left is compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.similarity import gestalt_ratio
from loomwright.storage import stored


def letters(word: str) -> Column:
    """The letters of a word, each with its number among equal ones."""
    return F.expr(f"transform(sort_array(split({word}, '')), (c, i) -> concat(c, i - array_position(sort_array(split({word}, '')), c) + 1))")


def _rarest(words: DataFrame, counts: DataFrame, cutoff: float) -> DataFrame:
    """word, set, n and each of the letters of which a word of a ratio of at least cutoff has one among its own."""
    n = F.size("set")
    least = F.ceil(F.lit(cutoff) / 2 * (n + F.ceil(F.lit(cutoff / (2 - cutoff)) * n - 1e-9)) - 1e-9)
    each = words.select("word", F.explode("set").alias("letter")).join(counts, "letter", "left")
    order = each.groupBy("word").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "letter"))).alias("o"))  # a word's letters
    return words.join(order, "word").select("word", "set", n.alias("n"), F.explode(F.slice("o", F.lit(1), (n - least + 1).cast("int"))).alias("l")).select("word", "set", "n", "l.letter")


def alike(asked: DataFrame, term: str, words: DataFrame, word: str, cutoff: float = 0.6) -> DataFrame:
    """term, word and ratio of all pairs whose ratio is at least cutoff. Null and empty ones are like nothing."""
    if not 0 < cutoff <= 1:
        raise ValueError("the cutoff is above 0 and at most 1")
    a = stored(asked.select(F.col(term).alias("word")).where("word <> ''").distinct().withColumn("set", letters("word")), "asked")
    b = stored(words.select(F.col(word).alias("word")).where("word <> ''").distinct().withColumn("set", letters("word")), "words")
    counts = stored(b.select(F.explode("set").alias("letter")).groupBy("letter").agg(F.count("*").alias("seen")), "letters")
    left = stored(_rarest(a, counts, cutoff), "left").toDF("term", "set_a", "n_a", "letter")
    right = stored(_rarest(b, counts, cutoff), "right")
    need = F.lit(cutoff) / 2 * (F.col("n_a") + F.col("n")) - 1e-9
    met = left.join(right, "letter").where((F.least("n_a", "n") >= need) & (F.size(F.array_intersect("set_a", "set")) >= need)).select("term", "word").distinct()
    return met.withColumn("ratio", gestalt_ratio("word", "term")).where(F.col("ratio") >= cutoff)


def likest(asked: DataFrame, term: str, words: DataFrame, word: str, k: int = 3, cutoff: float = 0.6) -> DataFrame:
    """term, word, ratio and place of the k likest words of each term; of equal ones the last in order comes first."""
    by = Window.partitionBy("term").orderBy(F.desc("ratio"), F.desc("word"))
    return alike(asked, term, words, word, cutoff).withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)
