"""Counts of words over a corpus, and spelling by them.

A word that the corpus does not know well becomes the known word that is fewest edits away (two at most: a letter
dropped, added, replaced, or two neighbours exchanged), then the most frequent, then the first in order. Words meet by
what is left of them without up to two letters: two words that are two edits apart have such a remainder in common. So
the join is one of hashes, and what meets is verified.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from loomwright.storage import stored

#: Edits that are looked for; letters of the longest word that is corrected (a word of n has n * n / 2 remainders).
EDITS, LONGEST = 2, 40


def unigrams(df: DataFrame, words: Column) -> DataFrame:
    """word and n over all rows. words: an array for each row; counted before anything is exchanged."""
    return df.select(F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def dictionary(counts: DataFrame, most: int = 100_000) -> dict[str, int]:
    """The most frequent words with their counts, for functions that take a dictionary: `most` of them at most."""
    return {r["word"]: r["n"] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()}


def edits(a: str, b: str) -> int:
    """The least number of edits from a to b (Damerau and Levenshtein's distance)."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, seen = [far, i], 0
        for j, y in enumerate(b, 1):
            k, same = last.get(y, 0), seen
            swap = d[k][same] + (i - k - 1) + 1 + (j - same - 1)
            row.append(min(d[i][j] + (x != y), row[j] + 1, d[i][j + 1] + 1, swap))
            seen = j if x == y else seen
        d.append(row)
        last[x] = i
    return d[-1][-1]


@pandas_udf(T.IntegerType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edits(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def remainders(word: str, most: int = EDITS) -> Column:
    """The word without up to `most` (1 or 2) letters, each once."""
    one = "transform(sequence(1, char_length({0})), i -> concat(substring({0}, 1, i - 1), substring({0}, i + 1)))"
    two = f", flatten(transform({one.format(word)}, w -> IF(w = '', array(w), {one.format('w')})))" if most > 1 else ""
    return F.expr(f"array_distinct(concat(array({word}), {one.format(word)}{two}))")


def _pairs(odd: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """word, letters, by, letters_by and n of words that have a remainder without up to `most` letters in common; some more than once."""
    asks = odd.select("word", "letters", F.explode(remainders("word", most)).alias("rest")).select("word", "letters", F.xxhash64("rest").alias("key"))
    told = known.select(F.col("word").alias("by"), F.col("letters").alias("letters_by"), "n", F.explode(remainders("word", most)).alias("rest")).select("by", "letters_by", "n", F.xxhash64("rest").alias("key"))
    # the rows of a word's remainders are many times its size, by which Spark would choose what to send to all tasks
    return asks.hint("merge").join(told.hint("merge"), "key").where(F.abs(F.char_length("word") - F.char_length("by")) <= most).drop("key")


def _nearest(odd: DataFrame, known: DataFrame, distance: int) -> DataFrame:
    """word, corrected and distance of words that are so far (1 or 2) from a known word, where no known one is nearer.

    Without letters that stand the other way round it is Levenshtein's distance, which Spark has. An exchange takes that
    two edits, and leaves the sorted letters as they are; only pairs that may have one are looked at by edits().
    """
    met = _pairs(odd, known, distance).withColumn("far", F.levenshtein("word", "by", 2 * distance)).where("far > 0")
    plain = met.where(F.col("far") <= distance)
    spare = 2 * (2 * distance - F.col("far"))  # one edit beside an exchange changes two of the sorted letters at most
    turned = met.where((F.col("far") > distance) & (F.levenshtein("letters", "letters_by") <= spare)).select("word", "by", "n").distinct()
    near = plain.select("word", "by", "n").union(turned.where(_edits("word", "by") <= distance))
    best = near.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("m"), "by")).alias("b"))
    return best.select("word", F.col("b.by").alias("corrected"), F.lit(distance).alias("distance"))


def corrections(words: DataFrame, known: DataFrame) -> DataFrame:
    """word, corrected and distance of the words (column word) that are not known but near to a known one (word, n).

    Words that have a known one a single edit away are done with few remainders; only the others ask for two.
    """
    short, letters = F.char_length("word").between(1, LONGEST), F.concat_ws("", F.sort_array(F.split("word", ""))).alias("letters")
    odd = stored(words.select("word").where(short).distinct().join(known.select("word"), "word", "left_anti").select("word", letters), "odd")
    known = stored(known.where(short).select("word", "n", letters), "known")
    first = stored(_nearest(odd, known, 1), "nearest")
    left = stored(odd.join(first.select("word"), "word", "left_anti"), "left")
    return first.union(_nearest(left, known, 2))


def corrected_texts(df: DataFrame, key: str, words: Column, known: DataFrame) -> DataFrame:
    """key, corrected (the row's words, corrected, in a row) and n_corrected. Keys are distinct and not null."""
    rows = stored(df.select(key, words.alias("w")), "words")
    each = rows.select(key, F.explode(F.array_distinct("w")).alias("word"))
    fixed = stored(corrections(each, known), "corrections")
    by = each.join(fixed, "word").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "corrected"))).alias("by"))  # a row's own words
    put = F.transform("w", lambda w: F.coalesce(F.col("by")[w], w))
    new = rows.join(by, key, "left").select(key, "w", put.alias("p"))  # looked up once
    return new.select(key, F.array_join("p", " ").alias("corrected"), F.size(F.filter(F.zip_with("p", "w", lambda p, w: p != w), lambda x: x)).alias("n_corrected"))
