"""Groups of spelling variants by a rare-first q-gram prefix filter.

Words are counted over the whole corpus, and so are their bigrams. Each word's positional bigrams are ordered by how
rare the bigram is; one edit changes two bigrams at most, so two words one edit apart share one of their three rarest,
at places that differ by one at most (taken in one order, the first that the edit leaves alone is among the three of
both). Only these three meet in the join. As the edit stands wholly before or after the bigram they share, either
everything up to its end or everything from its start is equal too: each bigram is sent under both, which keeps a common
bigram from bringing all its words together. Where that equal part is short, what is left of the word is halved: one of
its halves (of the shorter word's) is equal as well, so the bigram is sent with each. What meets within the limits of
position and length is verified by its edit distance.

A word's form is the most frequent word near it, if that is frequent enough; roots follow forms to the last, by doubling
the steps in each round (a form is RATIO times as frequent, so chains are short).

Defined results: null text has no words; a null id counts as empty text; only A-Z are lowered; repeated rows count each;
ties of frequency go to the word first in code-point order; words of any length and texts of any length are read whole;
an empty table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import arrow_batched, beside, stored, table

#: Letters of words; all are below U+0100.
LETTERS = "A-Za-zÀ-ÿ"
#: The shortest word, the fewest occurrences, how much more frequent a form is, one in how many has a letter dropped.
LENGTH, COUNT, RATIO, EVERY = 6, 5, 5, 199
#: Edits, letters of a gram, and the grams that decide: an edit changes Q of them.
EDITS, Q = 1, 2
RAREST = Q * EDITS + 1
WORDS_AT_ONCE = 10_000
#: Letters of an equal part from which on it is sent alone. The result is the same.
PLENTY = 5


def runs(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (as text) and run (lowered) of each maximal run of at least so many letters."""
    found = F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))
    own = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    return own.withColumn("run", F.translate("run", ascii_uppercase, ascii_lowercase))


def slipped(every: int = EVERY) -> Column:
    """The run, without one letter where `every` divides the hash of the id and the run."""
    return F.expr(
        f"""CASE WHEN crc32(encode(concat(id, ':', run), 'utf-8')) % {every} <> 0 THEN run ELSE
        concat(substring(run, 1, int(crc32(encode(concat(id, ':', run), 'utf-8')) % char_length(run))),
               substring(run, int(crc32(encode(concat(id, ':', run), 'utf-8')) % char_length(run)) + 2)) END"""
    )


def vocabulary(docs: DataFrame, length: int = LENGTH, count: int = COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n of the frequent words."""
    words = runs(docs, length, id_col, text_col).select(slipped().alias("word")).where(F.char_length("word") >= length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def bigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, owner and place of each bigram of the words."""
    data = [w.encode("latin-1") for w in words]
    buf = np.frombuffer(b"\0".join([*data, b""]), np.uint8).astype(np.int64)
    at = np.flatnonzero((buf[:-1] > 0) & (buf[1:] > 0)) if len(buf) else np.empty(0, np.int64)
    starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])])
    owner = np.searchsorted(starts, at, side="right") - 1
    return buf[at] * 256 + buf[at + 1], owner, at - starts[owner]


def bigram_ranks(words: DataFrame) -> np.ndarray:
    """For each bigram code its place in the order of frequencies, the rarest first: a table of 65536 entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, np.int64)
        for b in batches:
            total += np.bincount(bigrams(b.column("word").to_pylist())[0], minlength=65536)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    parts = arrow_batched(words.select("word"), run, "code long, n long", WORDS_AT_ONCE)
    n = np.zeros(65536, np.int64)
    for r in parts.groupBy("code").agg(F.sum("n").alias("n")).collect():  # pairs of letters at most
        n[r["code"]] = r["n"]
    rank = np.empty(65536, np.int64)
    rank[np.lexsort((np.arange(65536), n))] = np.arange(65536)
    return rank


def rarest(words: list[str], rank: np.ndarray) -> np.ndarray:
    """The places of the RAREST rarest bigrams of each word (of at least RAREST + 1 letters); ties go to the earlier place."""
    code, owner, place = bigrams(words)
    order = np.lexsort((place, rank[code], owner))
    first = np.searchsorted(owner[order], np.arange(len(words)))
    return place[order][first[:, None] + np.arange(RAREST)].astype(np.int32)


def meeting_keys() -> Column:
    """Hashes under which an end (side, half: the equal part, rest) is sent: alone, or with each half of the rest.

    Rests of two words differ by one letter at most; where the shorter has m, one edit leaves its first m / 2 letters or
    its last m - m / 2 alone. A word is the shorter or the longer one, so it sends the halves for both.
    """
    alone = F.array(F.xxhash64("side", "half"))
    halves = [F.expr(f"xxhash64(side, half, {m}, {part}, {text.format(m=m)})") for m in ("char_length(rest)", "greatest(char_length(rest) - 1, 0)") for part, text in ((0, "left(rest, int({m} div 2))"), (1, "right(rest, int({m} - {m} div 2))"))]
    return F.when(F.char_length("half") >= PLENTY, alone).otherwise(F.array_distinct(F.array(*halves)))


def near_words(words: DataFrame) -> DataFrame:
    """word, near and near_n for all words (a stored table of word and n) that are one edit apart, both ways."""
    sent = words.sparkSession.sparkContext.broadcast(bigram_ranks(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = rarest(b.column("word").to_pylist(), sent.value)
            yield beside(b, {"places": pa.array(list(places), pa.list_(pa.int32()))})

    placed = arrow_batched(words.select("word", "n"), run, "word string, n long, places array<int>", WORDS_AT_ONCE)
    left = F.struct(F.lit(0).alias("side"), F.expr("substring(word, 1, place + 2)").alias("half"), F.expr("substring(word, place + 3)").alias("rest"))
    right = F.struct(F.lit(1).alias("side"), F.expr("substring(word, place + 1)").alias("half"), F.expr("substring(word, 1, place)").alias("rest"))
    ends = placed.select("word", "n", F.explode("places").alias("place")).select("word", "n", "place", F.explode(F.array(left, right)).alias("e")).select("word", "n", "place", "e.*")
    keys = stored(ends.select("word", "n", "place", F.char_length("word").alias("size"), F.explode(meeting_keys()).alias("key")), "grams")
    a, b = (keys.toDF(*[f"{x}_{c}" for c in keys.columns]) for x in "ab")
    limits = "a_key = b_key AND a_word < b_word AND abs(a_place - b_place) <= 1 AND abs(a_size - b_size) <= 1 AND levenshtein(a_word, b_word, 1) = 1"
    pairs = a.join(b, F.expr(limits)).select("a_word", "a_n", "b_word", "b_n").distinct()
    both = F.array(F.struct(F.col("a_word").alias("word"), F.col("b_word").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b_word").alias("word"), F.col("a_word").alias("near"), F.col("a_n").alias("near_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the last that forms (word, form: no cycles) lead to."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("by"), F.col("root").alias("next"))
        step = stored(now.join(further, F.col("root") == F.col("by"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def variants(docs: DataFrame, length: int = LENGTH, count: int = COUNT, ratio: int = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of each frequent word."""
    if length <= RAREST:
        raise ValueError(f"words need more than {RAREST} letters")
    words = stored(vocabulary(docs, length, count, id_col, text_col), "vocabulary")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    found = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.m") >= ratio * F.col("n"), -F.col("best.m")))
    found = found.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
    found = stored(found, "forms")
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_rare_first_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def _crc_sql(text: str) -> str:
    """CRC-32 of a text of characters below U+0100: the register's step is linear, so its eight low bits count singly."""
    step = 0
    for i in range(8):
        c = 1 << i
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        step = f"xor({step}, {c} * ((xor(r, b) >> {i}) & 1))"
    parts = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))"
    return f"xor(list_reduce(list_prepend(4294967295, {parts}), lambda r, b: xor(r >> 8, {step})), 4294967295)"


OP12_SQL = f"""WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{{LENGTH},}}')), '{ascii_uppercase}', '{ascii_lowercase}') AS run FROM documents),
hashed AS (SELECT run, count(*) AS c, {_crc_sql("id || ':' || run")} AS h FROM runs GROUP BY id, run),
slips AS (SELECT CASE WHEN h % {EVERY} <> 0 THEN run ELSE substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) END AS word, c FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slips WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(c) >= {COUNT}),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
near AS MATERIALIZED (SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.v = b.v AND a.word <> b.word UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.v = w.word UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.v = w.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -n, near := near)) AS b FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= {RATIO} * w.n THEN b.near END AS form, CASE WHEN -b.m >= {RATIO} * w.n THEN CAST(-b.m AS BIGINT) END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS last, 0 AS k FROM forms UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON c.last = f.word WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, max_by(last, k) AS root FROM chain GROUP BY word) USING (word)"""
