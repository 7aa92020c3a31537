"""Sums by partition where partitions have no rows."""

import numpy as np
from pyspark.sql import functions as F

from loomwright.operators import clustering as C
from loomwright.operators import sweeps


def test_parts_without_rows_add_nothing(spark):
    rows = spark.range(40).repartition(1).select("id", F.array((F.col("id") % 2 * 9).cast("double"), (F.col("id") / 40).cast("double")).alias("x"))
    df = rows.union(rows.where("id < 0")).union(rows.where("id < -1"))
    got = sweeps.sums(df, "x", lambda v: np.column_stack([np.ones(len(v)), v]).sum(0, keepdims=True), 1, 3)
    assert got.tolist() == [[40.0, 180.0, 19.5]]
    assert sweeps.sums(df.where("id < 0"), "x", lambda v: v[:1], 1, 2).tolist() == [[0.0, 0.0]]
    assert C.fuzzy_c_means(df, "id", "x", [2, 3]).count() == 40
