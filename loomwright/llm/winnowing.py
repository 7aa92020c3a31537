"""Document fingerprints by winnowing, in DataFrame and SQL functions only.

Each character (code point) has a random value of 64 bits, and each run of K characters, one for each place of the
text, a rolling hash: the values of its characters, each shifted to the left by its distance from the end, added without
carry. When the run moves on by one character the value that leaves is taken out, the rest is shifted by one, and the new
value comes in; as SQL's functions over arrays can't carry such a sum along, the hashes of all places are made at once:
those of 2 m characters from two of m each, the first shifted by m, in log2(K) passes. The values are the same. The upper
31 bits, to which all characters of a run contribute, are the run's hash. Of each window of WINDOW such hashes the smallest
is chosen, of equal ones the rightmost; the minima of all windows come from log2(WINDOW) passes. The chosen hashes with
their positions are the fingerprint. So two texts that share K + WINDOW - 1 characters in a row share a chosen hash (the
match guarantee), and no run shorter than K characters can match. A chosen entry is one long: 31 bits of hash, then the
position counted down from 2 ** 31 - 1, so that the minimum of a window prefers the rightmost.

A text is worked on in blocks of BLOCK windows, which overlap by a window, so the arrays on the way are short however
long the text is. Of an edited text only the windows over the seam are new: from the entries of a text one can tell which
window chose each first, so those of its first windows are taken as they are.

The next document in descending id order is found without one global sort: ids are cut into ranges at approximate
quantiles, each range is a window partition of its own, and the first document of each range is also sent, as a guest,
to the range before it. An id that fills whole ranges is cut once more, by the hash of the text. The number of ranges
follows spark.sql.shuffle.partitions; texts are shuffled once.

Defined results: null text is empty text; an empty text has an empty fingerprint; with fewer than K characters the whole
text is hashed as one run, with fewer than WINDOW runs one is chosen; two empty fingerprints are alike (1), an empty and
another are not (0); equal texts have equal fingerprints; rows that repeat an id follow each other in the order of their
texts' hashes; a null id comes last; the next document of a lone document is itself; an empty table gives no rows; extra
columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.llm.common import table

#: Characters of a run and runs of a window: powers of two.
K, WINDOW = 16, 32
LAST = 2**31 - 1
#: Windows of a block of text.
BLOCK = 16384
#: Characters that a window spans.
SPAN = K + WINDOW - 1
#: Ranges of ids for each shuffle partition.
RANGES_A_PARTITION = 4


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value made once."""
    return F.transform(F.array(value), body)[0]


def _with_earlier(a: Column, by: int, f: Callable[[Column, Column], Column]) -> Column:
    """f of what stands `by` places before each element (null at the beginning) and the element."""
    return F.zip_with(F.concat(F.array(*[F.lit(None).cast("bigint")] * by), a), a, f)


def _sums(values: Column, width: int = 1) -> Column:
    """For each place the rolling hash of the K characters that end there; null for the first K - 1."""
    if width == K:
        return values
    return _let(_with_earlier(values, width, lambda a, b: F.shiftleft(a, width).bitwiseXOR(b)), lambda x: _sums(x, 2 * width))


def _minima(entries: Column, width: int = 1) -> Column:
    """For each place the least of the WINDOW entries that end there."""
    if width == WINDOW:
        return entries
    return _let(_with_earlier(entries, width, lambda a, b: F.least(a, b)), lambda x: _minima(x, 2 * width))


def _entry(sum_: Column, at: Column) -> Column:
    """Upper 31 bits of a sum, then the place, counted down."""
    return F.shiftrightunsigned(sum_, 2).bitwiseAND(F.lit(LAST << 31).cast("bigint")).bitwiseOR(at)


def _chosen(text: Column, offset: Column) -> Column:
    """The chosen entries of a block of text that begins at the offset."""
    values = F.transform(F.split(text, ""), lambda c: F.xxhash64(c))
    n = F.char_length(text)

    def of(low: Column) -> Column:
        entries = _let(_let(values, lambda v: _sums(v)), lambda s: F.transform(s, lambda x, i: _entry(x, low - i)))
        windows = F.greatest(n - (SPAN - 1), F.lit(1))
        return _let(entries, lambda e: F.array_distinct(F.slice(_minima(e), n - windows + 1, windows)))

    whole = F.array(_entry(F.xxhash64(text), F.lit(LAST).cast("bigint") - offset))
    return F.when(n < K, whole).otherwise(_let(F.lit(LAST + K - 1).cast("bigint") - offset, of))


def fingerprint(text: Column) -> Column:
    """The chosen entries (array<long>, by position) of a text."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def of(b: Column) -> Column:
        each = F.transform(
            b,
            lambda x, i: F.when((i > 0) & (F.char_length(x) < SPAN) & (i == F.size(b) - 1), F.array().cast("array<bigint>")).otherwise(
                _chosen(F.concat(x, F.coalesce(F.left(F.get(b, i + 1), F.lit(SPAN - 1)), F.lit(""))), i.cast("bigint") * BLOCK)
            ),
        )
        return F.when(F.size(b) == 1, F.get(each, F.lit(0))).otherwise(F.array_distinct(F.flatten(each)))

    none = F.array().cast("array<bigint>")
    return F.when(text == "", none).otherwise(_let(blocks, of))


def hashes(entries: str) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.expr(f"array_distinct(transform({entries}, x -> CAST(shiftright(x, 31) AS int)))")


def positions(entries: str) -> Column:
    """Position (of its first character) and hash of each chosen run."""
    return F.expr(f"transform({entries}, x -> named_struct('position', CAST({LAST} - (x & {LAST}) AS int), 'hash', CAST(shiftright(x, 31) AS int)))")


def as_digest(entries: str) -> Column:
    """SHA-256 of the positions and hashes."""
    return F.sha2(F.expr(f"array_join(transform({entries}, x -> CAST(x AS string)), ',')").cast("binary"), 256)


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two sets of hashes."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, and fingerprint: array of (position, hash)."""
    df = docs.select(F.col(f"`{id_col}`").alias("_id"), fingerprint(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("_f"))
    return df.select(F.col("_id").alias(id_col), positions("_f").alias("fingerprint"))


def first_windows(entries: str, windows: str) -> str:
    """SQL: the entries that the first so many windows of a text chose.

    An entry that is no larger than the one before it is chosen as soon as a window reaches it, any other as soon as
    the one before it has left the window.
    """
    pos, hash_ = (lambda x: f"({LAST} - ({x} & {LAST}))"), (lambda x: f"shiftright({x}, 31)")
    before = f"{entries}[i - 1]"
    since = f"CASE WHEN i = 0 THEN 0 WHEN {hash_('x')} <= {hash_(before)} THEN {pos('x')} - {WINDOW - 1} ELSE {pos(before)} + 1 END"
    return f"filter({entries}, (x, i) -> {since} < {windows})"


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """rows (key, tie and the carried columns) with next_<column> of the row that follows in descending key order."""
    spark = rows.sparkSession
    n = RANGES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = rows.select("key", "tie")
    quantiles = [i / n for i in range(1, n)]
    cuts = keys.agg(F.percentile_approx("key", quantiles, 20 * n).alias("q")).first()["q"] or []  # n numbers
    bounds = sorted(Counter(cuts).items())
    held = spark.createDataFrame([([x for x, _ in bounds], [m for _, m in bounds])], "_bounds array<bigint>, _parts array<int>")
    steps = max(1, n.bit_length() + 1)
    mid = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    search = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0).alias("lo"), F.size("_bounds").alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s)
        .when(F.get(F.col("_bounds"), mid(s)) <= F.col("key"), F.struct((mid(s) + 1).alias("lo"), s["hi"].alias("hi")))
        .otherwise(F.struct(s["lo"].alias("lo"), mid(s).alias("hi"))),
        lambda s: s["lo"],
    )
    # a key that is a bound several times fills ranges of its own: by the hash of the text
    parts = F.get(F.col("_parts"), F.col("_range") - 1)
    heavy = (F.get(F.col("_bounds"), F.col("_range") - 1) == F.col("key")) & (parts > 1)
    sub = F.when(heavy, F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * parts).cast("int")).otherwise(F.lit(-1))

    def ranged(df: DataFrame) -> DataFrame:
        return df.crossJoin(F.broadcast(held)).withColumn("_range", search).withColumn("_sub", sub).drop("_bounds", "_parts")

    tops = ranged(keys).groupBy("_range", "_sub").agg(F.min(F.struct(-F.col("key").cast("decimal(38,0)"), "tie", "key")).alias("t"))
    tops = tops.select("_range", "_sub", "t.key", "t.tie").orderBy(F.desc("_range"), "_sub").collect()  # 2 n rows at most
    above = [(b["key"], b["tie"], a["_range"], a["_sub"]) for b, a in zip(tops[1:] + tops[:1], tops, strict=True)]
    guests = spark.createDataFrame(above, "key bigint, tie bigint, _to_range int, _to_sub int")
    here, there = F.struct(F.col("_range").alias("r"), F.col("_sub").alias("s"), F.lit(0).alias("guest")), F.struct(F.col("_to_range").alias("r"), F.col("_to_sub").alias("s"), F.lit(1).alias("guest"))
    both = ranged(rows).join(F.broadcast(guests), ["key", "tie"], "left").withColumn("_at", F.explode(F.filter(F.array(here, there), lambda x: x["r"].isNotNull())))
    w = Window.partitionBy("_r", "_s").orderBy("_guest", F.desc("key"), "tie")
    both = both.select("key", "tie", *carried, F.col("_at.r").alias("_r"), F.col("_at.s").alias("_s"), F.col("_at.guest").alias("_guest"))
    for c in carried:
        both = both.withColumn(f"next_{c}", F.lead(c).over(w))
    return both.where("_guest = 0").drop("_r", "_s", "_guest")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint against that of its edited text and that of the next document."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(-(2**63))).alias("key"), F.xxhash64(text).alias("tie"), text.alias("text"))
    df = with_next(own.withColumn("own", fingerprint(F.col("text"))), ["id", "text", "own"])
    n = F.char_length("text")
    df = df.withColumn("n_chars", n).withColumn("cut", F.floor(n / 3).cast("int")).withColumn("left", F.col("n_chars") - F.col("cut"))
    df = df.withColumn("right", F.least("cut", F.char_length("next_text"))).withColumn("edited", F.concat(F.left("text", F.col("left")), F.left("next_text", F.col("cut"))))
    # the windows over the seam: the last characters of the part that stays, and the first of the part that comes
    seam = F.substring("edited", F.greatest(F.col("left") - (SPAN - 2), F.lit(1)), F.least(F.col("left"), F.lit(SPAN - 1)) + F.least(F.col("right"), F.lit(SPAN - 1)))
    over = F.when(F.char_length("seam") >= SPAN, _chosen(F.col("seam"), F.greatest(F.col("left") - (SPAN - 1), F.lit(0)).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    before = F.expr(f"CASE WHEN left >= {SPAN} THEN {first_windows('own', f'(left - {SPAN - 1})')} ELSE CAST(array() AS array<bigint>) END")
    after = F.expr(f"CASE WHEN right >= {SPAN} THEN transform({first_windows('next_own', f'(right - {SPAN - 1})')}, x -> x - left) ELSE CAST(array() AS array<bigint>) END")
    made = F.when(F.col("left") + F.col("right") < SPAN, fingerprint(F.col("edited"))).otherwise(F.array_distinct(F.concat(before, over, after)))
    df = df.withColumn("seam", seam).withColumn("changed", made).drop("text", "next_text", "seam")
    df = df.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    df = df.withColumn("hashes", hashes("own")).withColumn("next_hashes", hashes("next_own")).withColumn("edited_hashes", hashes("changed"))
    return df.select(
        F.col("id").alias(id_col),
        F.col("n_chars").cast("bigint").alias("n_chars"),
        "edited_sha256",
        as_digest("own").alias("fingerprint"),
        as_digest("changed").alias("edited_fingerprint"),
        likeness("hashes", "edited_hashes").alias("near_edited"),
        likeness("hashes", "next_hashes").alias("near_next"),
    )


def op7_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
