"""Pictures: skin masks, cloth masks and dominant colours, on RGB arrays in numpy.

Pictures come as bytes. PPM is read here; for other formats, and for models that find people or garments, a user gives
a function (decode, segment, classify), as the library brings neither image codecs nor trained networks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Decode = Callable[[bytes], np.ndarray | None]
FAILED = [(0.0, (-1, -1, -1))] * 5


def read_ppm(data: bytes) -> np.ndarray | None:
    """A binary grey or colour PPM as an array of height, width and three channels."""
    m = re.match(rb"P([56])\s+(\d+)\s+(\d+)\s+(\d+)\s", data or b"")
    if not m:
        return None
    kind, w, h = int(m[1]), int(m[2]), int(m[3])
    n = w * h * (3 if kind == 6 else 1)
    flat = np.frombuffer(data, np.uint8, n, m.end())
    return grey_to_rgb(flat.reshape(h, w)) if kind == 5 else flat.reshape(h, w, 3)


def grey_to_rgb(a: np.ndarray) -> np.ndarray:
    return np.repeat(a[:, :, None], 3, 2) if a.ndim == 2 else a


def write_ppm(a: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.astype(np.uint8).tobytes()


def first_usable(sources: Sequence[bytes | None], decode: Decode) -> np.ndarray | None:
    """The first of the sources (picture, its address, photo, sketch) that can be read."""
    return next((a for a in (decode(s) for s in sources if s) if a is not None), None)


def to_hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue 0..179, saturation and value 0..255."""
    x = rgb.astype(float)
    top, low = x.max(2), x.min(2)
    d = np.where(top == low, 1, top - low)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    hue = np.where(top == r, (g - b) / d % 6, np.where(top == g, (b - r) / d + 2, (r - g) / d + 4)) * 30
    return np.dstack([np.where(top == low, 0, hue), np.where(top == 0, 0, (top - low) / np.maximum(top, 1) * 255), top]).round()


def to_ycrcb(rgb: np.ndarray) -> np.ndarray:
    x = rgb.astype(float)
    y = x @ [0.299, 0.587, 0.114]
    return np.dstack([y, (x[..., 0] - y) * 0.713 + 128, (x[..., 2] - y) * 0.564 + 128]).round()


def _between(x: np.ndarray, low: Sequence[int], high: Sequence[int]) -> np.ndarray:
    return ((x >= low) & (x <= high)).all(2).astype(float)


# The bounds of skin in three colour spaces.
def hsv_skin(rgb: np.ndarray) -> np.ndarray:
    return _between(to_hsv(rgb), (0, 58, 0), (25, 173, 255))


def ycrcb_skin(rgb: np.ndarray) -> np.ndarray:
    return _between(to_ycrcb(rgb), (0, 133, 80), (255, 173, 120))


def rgb_skin(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., i].astype(int) for i in range(3))
    return ((r > g) & (r > b) & (r > g + 15) & (r >= 95) & (g >= 40) & (b >= 20)).astype(float)


def _windows(a: np.ndarray, size: int, fill: float, op: np.ufunc) -> np.ndarray:
    """op over all windows of size by size: first down, then across, which is the same for a sum, a largest or a least value."""
    before = size // 2
    a = np.pad(a, (before, size - 1 - before), mode="edge") if np.isnan(fill) else np.pad(a, (before, size - 1 - before), constant_values=fill)
    h, w = a.shape[0] - size + 1, a.shape[1] - size + 1
    down = reduce(op, [a[i : i + h] for i in range(size)])
    return reduce(op, [down[:, i : i + w] for i in range(size)])


def blur(a: np.ndarray, size: int) -> np.ndarray:
    return _windows(a, size, float("nan"), np.add) / (size * size)


def dilate(a: np.ndarray, size: int, times: int = 1) -> np.ndarray:
    for _ in range(times):
        a = _windows(a, size, -np.inf, np.maximum)
    return a


def erode(a: np.ndarray, size: int, times: int = 1) -> np.ndarray:
    for _ in range(times):
        a = _windows(a, size, np.inf, np.minimum)
    return a


def not_skin(rgb: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    """1 where there is no skin: the mean of two masks, blurred, widened, cut, closed and opened."""
    mask = dilate(blur((hsv_skin(rgb) + ycrcb_skin(rgb)) / 2, 10), 3, 3) > threshold
    closed = erode(dilate(mask.astype(float), 5), 5)
    return 1 - dilate(erode(closed, 5), 5)


def shows_skin(rgb: np.ndarray, pixels: int = 400) -> bool:
    """Whether enough skin is left after erosion to remove background and skin."""
    return erode(ycrcb_skin(rgb), 5).sum() > pixels


def edges(rgb: np.ndarray, low: float = 50) -> np.ndarray:
    g = rgb.astype(float) @ [0.299, 0.587, 0.114]
    dy, dx = np.gradient(g)
    return (np.hypot(dx, dy) > low / 4).astype(float)


def cloth_mask(rgb: np.ndarray, person: np.ndarray | None = None) -> np.ndarray:
    """Person without skin; without a person the surroundings of edges."""
    if person is not None and person.sum() > 0:
        return person.astype(float) * not_skin(rgb)
    near = dilate(edges(rgb), 5, 3)
    return near if near.sum() else np.ones(rgb.shape[:2])


def dominant_colours(pixels: np.ndarray, k: int = 5, rounds: int = 25) -> list[tuple[float, tuple[int, int, int]]]:
    """Shares and rounded centres of k means, the largest first. Starts are spread over the distinct colours by brightness."""
    distinct, count = np.unique(pixels.reshape(-1, 3), axis=0, return_counts=True)
    if len(distinct) < k:
        return FAILED
    order = np.argsort(distinct.astype(float) @ [0.299, 0.587, 0.114], kind="stable")
    centre = distinct[order[np.linspace(0, len(order) - 1, k).round().astype(int)]].astype(float)
    for _ in range(rounds):
        label = ((distinct[:, None].astype(float) - centre[None]) ** 2).sum(2).argmin(1)
        weight = np.bincount(label, count, minlength=k)
        new = np.stack([np.bincount(label, count * distinct[:, i], minlength=k) for i in range(3)], 1) / np.maximum(weight, 1)[:, None]
        new = np.where(weight[:, None] > 0, new, centre)
        if np.allclose(new, centre):
            break
        centre = new
    share = weight / weight.sum()
    return sorted(((float(s), tuple(int(round(x)) for x in c)) for s, c in zip(share, centre, strict=True) if s), reverse=True)


def extract_colours(pictures: DataFrame, key: str, column: str, decode: Decode = read_ppm, segment: Callable[[np.ndarray], np.ndarray] | None = None, k: int = 5) -> DataFrame:
    """key, ranking, percentage, red, green, blue: the colours of the cloth in each picture."""

    def one(data: bytes) -> list[tuple[float, tuple[int, int, int]]]:
        rgb = decode(bytes(data)) if data is not None else None
        if rgb is None:
            return FAILED
        if not shows_skin(rgb):
            return dominant_colours(rgb, k)
        mask = cloth_mask(rgb, segment(rgb) if segment else None)
        return dominant_colours(rgb[mask > 0], k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, r, round(s, 6), *c) for i, data in zip(b[key], b[column], strict=True) for r, (s, c) in enumerate(one(data), 1)]
            yield pd.DataFrame(rows, columns=[key, "ranking", "percentage", "red", "green", "blue"])

    return pictures.select(key, column).mapInPandas(run, f"{key} {pictures.schema[key].dataType.simpleString()}, ranking int, percentage double, red int, green int, blue int")


def classify(pictures: DataFrame, key: str, column: str, models: Mapping[str, Callable[[np.ndarray], int]], codes: Mapping[str, Mapping[int, int]], decode: Decode = read_ppm) -> DataFrame:
    """key and, for each model, the label's key of the class it gives; null for a picture that cannot be read."""
    names = list(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = [decode(bytes(d)) if d is not None else None for d in b[column]]
            out = {n: pd.array([None if a is None else codes[n].get(models[n](a)) for a in seen], dtype="Int64") for n in names}
            yield pd.DataFrame({key: b[key].to_numpy()} | out)

    return pictures.select(key, column).mapInPandas(run, f"{key} {pictures.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))


def person_crops(pages: DataFrame, key: str, column: str, detect: Callable[[np.ndarray], list[tuple[int, tuple[int, int, int, int]]]], decode: Decode = read_ppm, wanted: int = 69) -> DataFrame:
    """key, crop (from 0) and picture of the boxes (class, (top, left, bottom, right)) of the wanted class on each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, d in zip(b[key], b[column], strict=True):
                a = decode(bytes(d)) if d is not None else None
                boxes = [x for c, x in (detect(a) if a is not None else []) if c == wanted]
                rows += [(i, n, write_ppm(a[t:u, s:v])) for n, (t, s, u, v) in enumerate(boxes)]
            yield pd.DataFrame(rows, columns=[key, "crop", "picture"])

    return pages.select(key, column).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, crop int, picture binary")


def write_colours(colours: DataFrame, names: DataFrame) -> DataFrame:
    """The bridge rows: product, ranking, percentage and the name of the colour."""
    return colours.join(names, ["red", "green", "blue"], "left").where(F.col("red") >= 0)
