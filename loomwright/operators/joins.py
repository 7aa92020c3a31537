"""Joins that need more than a call of DataFrame.join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.storage import stored

#: Items of a block of a class; pairs of items that a task lists.
BLOCK, PAIRS_A_TASK = 512, 4_000_000


def star(fact: DataFrame, dims: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Left joins of a fact with dimensions: {foreign key: (dimension, its key, its text)} gives a column <foreign key>_text.

    Whether a dimension is broadcast is left to its size.
    """
    for foreign, (dim, key, text) in dims.items():
        fact = fact.join(dim.select(F.col(key).alias(foreign), F.col(text).alias(f"{foreign}_text")), foreign, "left")
    return fact


def lookup(df: DataFrame, column: str, values: Mapping[object, object], out: str) -> DataFrame:
    """A dictionary's value for each row, null if it has none."""
    pairs = [x for kv in values.items() for x in map(F.lit, kv)]
    return df.withColumn(out, F.create_map(*pairs)[F.col(column)] if pairs else F.lit(None))


def phrase_matches(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Which labels stand in which texts as whole words, and at which word: an equi-join on runs of words.

    A text emits its runs of the lengths that labels have, where a label's first word stands, so the work grows with the
    texts and not with texts times labels. First words and lengths of a dimension of labels travel as one row. Texts are
    dealt out before they are split, as files may come in few parts.
    """
    tokens = F.filter(F.split(F.col(text_col), r"\s+"), lambda w: w != "")
    named = labels.select(F.col(label_col), F.filter(F.split(F.col(label_col), r"\s+"), lambda w: w != "").alias("_w")).where(F.size("_w") > 0)
    named = named.select(label_col, F.array_join("_w", " ").alias("_run"), F.size("_w").alias("_n"), F.get("_w", F.lit(0)).alias("_f"))
    known = named.groupBy().agg(F.collect_set("_n").alias("_sizes"), F.collect_set("_f").alias("_firsts"))
    dealt = docs.select(id_col, text_col).repartition(id_col)
    own = dealt.select(id_col, tokens.alias("_t")).crossJoin(F.broadcast(known)).withColumn("_i", F.array_intersect("_t", "_firsts")).where(F.size("_i") > 0)
    at = F.filter(F.transform("_t", lambda w, i: F.when(F.array_contains("_i", w), i)), lambda i: i.isNotNull())
    runs = F.flatten(F.transform(at, lambda i: F.transform("_sizes", lambda n: F.struct(i.alias("pos"), n.alias("_n"), F.array_join(F.slice("_t", i + 1, n), " ").alias("_run")))))
    found = own.select(id_col, F.size("_t").alias("_s"), F.explode(runs).alias("_r")).where("_r.pos + _r._n <= _s").select(id_col, "_r.*")
    return found.join(named.drop("_f"), ["_run", "_n"]).groupBy(id_col, label_col).agg(F.min("pos").alias("pos"))


def nearest_colour(df: DataFrame, palette: DataFrame, rgb: Sequence[str] = ("red", "green", "blue"), out: str = "name") -> DataFrame:
    """The palette's colour at the least squared distance; of equal ones the last by its column `seq`.

    The palette (name, r, g, b, seq) is a fixed list of some dozens of names, so it travels as one array.
    """
    one = palette.agg(F.collect_list(F.struct("name", "r", "g", "b", "seq")).alias("_p"))
    r, g, b = (F.col(c) for c in rgb)

    def far(p: Column) -> Column:
        return (p["r"] - r) * (p["r"] - r) + (p["g"] - g) * (p["g"] - g) + (p["b"] - b) * (p["b"] - b)

    best = F.array_min(F.transform("_p", lambda p: F.struct(far(p).alias("d"), (-p["seq"]).alias("s"), p["name"].alias("name"))))
    return df.crossJoin(F.broadcast(one)).withColumn(out, best["name"]).drop("_p")


def first_found(df: DataFrame, steps: Sequence[tuple[DataFrame, str, str]], text: Sequence[str], out: str) -> DataFrame:
    """A cascade of lookups without regard to case: the key of the first step that knows its text, and which step."""
    for i, ((dim, name, key), t) in enumerate(zip(steps, text, strict=True)):
        known = dim.select(F.lower(name).alias(f"_t{i}"), F.col(key).alias(f"_k{i}")).groupBy(f"_t{i}").agg(F.min(f"_k{i}").alias(f"_k{i}"))
        df = df.withColumn(f"_t{i}", F.lower(t)).join(known, f"_t{i}", "left")
    keys = [f"_k{i}" for i in range(len(steps))]
    step = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(i)) for i, k in enumerate(keys)])
    return df.withColumn(out, F.coalesce(*keys)).withColumn(f"{out}_step", step).drop(*keys, *[f"_t{i}" for i in range(len(steps))])


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Fields of both; where both have a value that of `over` counts."""
    names = [c for c in dict.fromkeys([*base.columns, *over.columns]) if c != key]
    a, b = base.alias("a"), over.alias("b")
    pick = [F.coalesce(*[F.col(f"{s}.{c}") for s, df in (("b", over), ("a", base)) if c in df.columns]).alias(c) for c in names]
    return a.join(b, key, "left").select(key, *pick)


def label_classes(df: DataFrame, item: str, algorithm: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Membership (item, c, n) and pairs of classes c <= e that meet under a label: k (how often), n_c and n_e.

    Items with the same labels of the same algorithms, as often, are one class, named by its smallest item; n is its size.
    """
    rows = df.where(F.col(item).isNotNull() & F.col(algorithm).isNotNull() & F.col(label).isNotNull())
    tuples = stored(rows.groupBy(F.col(item).alias("item")).agg(F.sort_array(F.collect_list(F.struct(F.col(algorithm).alias("a"), F.col(label).alias("l")))).alias("t")), "tuples")  # a row for each algorithm
    named = stored(tuples.groupBy("t").agg(F.min("item").alias("c"), F.count("*").alias("n")), "classes")
    each = named.select("c", "n", F.explode("t").alias("x")).groupBy("c", "n", "x").agg(F.count("*").alias("m"))
    left, right = each.select("c", F.col("n").alias("n_c"), "x", "m"), each.select(F.col("c").alias("e"), F.col("n").alias("n_e"), "x", F.col("m").alias("m2"))
    pairs = left.join(right, "x").where("c <= e").groupBy("c", "e", "n_c", "n_e").agg(F.sum(F.col("m") * F.col("m2")).alias("k"))
    return tuples.join(named, "t").select("item", "c", "n"), stored(pairs, "class_pairs")


def _number_of_pairs() -> Column:
    return F.when(F.col("c") < F.col("e"), F.col("n_c") * F.col("n_e")).otherwise((F.col("n_c") * (F.col("n_c") - 1) / 2).cast("long"))


def co_members(df: DataFrame, item: str, algorithm: str, label: str, algorithms: int) -> DataFrame:
    """For pairs of items i < j: the share of the algorithms that put both under one label, to three places.

    Shares are counted for classes of items with the same labels. The pairs of items come from blocks of at most some
    hundreds of items (BLOCK, by hash), so no pair of items is exchanged and no label makes a large task.
    """
    members, pairs = label_classes(df, item, algorithm, label)
    blocks = members.groupBy("c", F.pmod(F.xxhash64("item"), F.ceil(F.col("n") / BLOCK)).alias("b")).agg(F.collect_list("item").alias("items"))
    blocks = stored(blocks, "blocks")
    share = F.round(F.col("k") / F.lit(algorithms), 3).alias("share")
    both = pairs.select("c", "e", share).join(blocks.toDF("c", "b", "p"), "c").join(blocks.toDF("e", "f", "q"), "e").where("c < e OR b <= f")
    total = pairs.agg(F.sum(_number_of_pairs())).first()[0] or 0
    dealt = both.repartition(1 + total // PAIRS_A_TASK, "c", "b", "e", "f")
    found = dealt.withColumn("i", F.explode("p")).withColumn("j", F.explode("q")).where("c < e OR b < f OR i < j")
    return found.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "share")


def co_member_totals(df: DataFrame, item: str, algorithm: str, label: str, algorithms: int) -> DataFrame:
    """mean_share and pairs: one row over the pairs that co_members() lists, from the sizes of classes."""
    pairs = label_classes(df, item, algorithm, label)[1]
    each = pairs.select(F.round(F.col("k") / F.lit(algorithms), 3).alias("share"), _number_of_pairs().alias("w")).where("w > 0")
    return each.agg((F.sum(F.col("share") * F.col("w")) / F.sum("w")).alias("mean_share"), F.coalesce(F.sum("w"), F.lit(0).cast("long")).alias("pairs"))


def co_labelled(df: DataFrame, item: str, algorithm: str, label: str, algorithms: int) -> DataFrame:
    """What co_members() lists, for items that all differ in their labels (classes)."""
    a = df.select(F.col(item).alias("i"), algorithm, label)
    b = df.select(F.col(item).alias("j"), algorithm, label)
    both = a.join(b, [algorithm, label]).where("i < j")
    return both.groupBy("i", "j").agg(F.round(F.count("*") / F.lit(algorithms), 3).alias("share"))
