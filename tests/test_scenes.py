"""Pictures of scenes: windows against plain loops, and tasks that the pictures are dealt out to."""

import numpy as np
import pytest

from loomwright.functions import images as I
from loomwright.plans import media


@pytest.mark.parametrize("size", [3, 5, 10])
def test_windows_equal_plain_loops(size):
    a = np.random.default_rng(size).integers(0, 3, (13, 17)) / 2
    before, after = size // 2, size - 1 - size // 2
    near = np.array([[np.pad(a, (before, after), mode="edge")[i : i + size, j : j + size] for j in range(17)] for i in range(13)])
    assert (I.blur(a, size) == near.mean((2, 3))).all()
    at = lambda i, j: a[max(i - before, 0) : i + after + 1, max(j - before, 0) : j + after + 1]
    assert (I.dilate(a, size) == [[at(i, j).max() for j in range(17)] for i in range(13)]).all()
    assert (I.erode(a, size) == [[at(i, j).min() for j in range(17)] for i in range(13)]).all()


def test_scenes_are_dealt_out(spark, tmp_path, monkeypatch):
    spark.range(1, 41).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(media, "PICTURES_A_TASK", 4)
    for of in (media.scenes, media.pixel_pictures, media.suppliers):
        out = of(spark, str(tmp_path))
        assert out.rdd.getNumPartitions() == 10 and out.count() == 40
