"""Images as rows, and their features by Arrow UDFs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.functions import image as im
from lodestar.sources.catalog import byte_values

FEATURES = "id string, w int, p long, d long, vec array<int>, vec_bp array<int>"
PIXELS = "id string, width int, height int, pixels binary"
#: Fixed value: how long a one-shot query waits for recognised text.
READ_MS = 4000


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(id, width, height, channels, data) of image files, bytes in BGR order; rows of files that can't be decoded have ok = false."""
    rows = spark.read.format("image").load(path).select("image.*")
    return rows.select(F.col("origin").alias("id"), "width", "height", F.col("nChannels").alias("channels"), "data", (F.col("height") > 0).alias("ok"))


def fault(width: Column, height: Column, channels: Column, data: Column) -> Column:
    """What is wrong with an image: `size` if a side isn't positive or is null, `bytes` if its bytes aren't as many as its pixels need or are null; null if nothing is."""
    need = width.cast("long") * height * channels
    sides = F.coalesce((width > 0) & (height > 0), F.lit(False))
    return F.when(~sides, "size").when(~F.coalesce(F.octet_length(data) == need, F.lit(False)), "bytes")


def sound(rows: DataFrame) -> DataFrame:
    """Images (id, width, height, channels, data) without a fault: what one task fails on would end the job for all."""
    return rows.where(fault(F.col("width"), F.col("height"), F.col("channels"), F.col("data")).isNull())


def _each(rows: DataFrame, schema: str, f: Callable[[str, np.ndarray], list[tuple]]) -> DataFrame:
    """f(id, image) for every row (id, width, height, channels, data); one batch of images at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [x for r in batch.itertuples() for x in f(r.id, im.gray(r.width, r.height, r.data, r.channels, bgr=True))]
            yield pd.DataFrame(out, columns=names)

    return rows.select("id", "width", "height", "channels", "data").mapInPandas(run, schema)


def window_features(rows: DataFrame, insets: tuple[float, ...] = (0.0,), most: int = 560, rectified: bool = False, full_size: bool = False) -> DataFrame:
    """(id, attempt, w, p, d, vec, vec_bp): features of the windows of each attempt, a crop of the image, shrunk to a width of `most`, or of its rectified quadrilateral, found before that if full_size."""

    def f(key: str, img: np.ndarray) -> list[tuple]:
        h, w = img.shape
        base = img if w <= most else im.resize(img, most, max(1, int(h * most / w + 0.5)))
        tries = [base] if not rectified else [base, im.try_rectify(img if full_size else base)]
        out, n = [], 0
        for b in tries:
            for share in insets:
                if b is not None:
                    for k, part in enumerate(im.windows(im.inset(b, share))):
                        p, d, v, bp = im.features(part)
                        out.append((key, n, k, p, d, list(v), list(bp)))
                n += 1
        return out

    return _each(rows, "id string, attempt int, w int, p long, d long, vec array<int>, vec_bp array<int>", f)


def resized(rows: DataFrame, width: int, height: int) -> DataFrame:
    """(id, values): the image shrunk or grown to a size, row by row."""
    return _each(rows, "id string, values array<double>", lambda key, img: [(key, im.resize(img, width, height).astype(float).ravel().tolist())])


def shapes(rows: DataFrame, level: float) -> DataFrame:
    """(image, shape, area, x0, y0, x1, y1): the 4-connected parts of each image that are brighter than level."""

    def f(key: str, img: np.ndarray) -> list[tuple]:
        return [(key, k, len(p), *(int(v) for v in (*p.min(0)[::-1], *p.max(0)[::-1]))) for k, p in enumerate(im.components(img > level))]

    return _each(rows, "image string, shape int, area int, x0 int, y0 int, x1 int, y1 int", f)


def inks(rows: DataFrame) -> DataFrame:
    """(id, pixels, ink): pixels of the strip where a line of text is looked for, and those that look like ink."""

    def f(key: str, img: np.ndarray) -> list[tuple]:
        ink = im.ink_mask(img)
        return [(key, int(ink.size), int(ink.sum()))]

    return _each(rows, "id string, pixels int, ink int", f)


def rectified(rows: DataFrame, step: int = 1) -> DataFrame:
    """(id, values): every step-th pixel, across and down, of the quadrilateral of each image that has one, seen from the front."""

    def f(key: str, img: np.ndarray) -> list[tuple]:
        flat = im.try_rectify(img)
        return [] if flat is None else [(key, flat[::step, ::step].astype(float).ravel().tolist())]

    return _each(rows, "id string, values array<double>", f)


def averaged(rows: DataFrame, by: str, most: int = 5) -> DataFrame:
    """(by, n, values): mean of the frames of a session, at most `most` of them by id, if there are three or more of one size.

    Sums of pixels are aggregated by position, so that no session's frames meet in one task.
    """
    last = F.row_number().over(W.partitionBy(by).orderBy(F.col("id").desc()))
    some = rows.select(by, "id", "width", "height", "data").withColumn("k", last).where(F.col("k") <= most)
    each = some.select(by, "width", "height", F.posexplode(byte_values(F.col("data"))).alias("pos", "v"))
    mean = each.groupBy(by, "width", "height", "pos").agg(F.count(F.lit(1)).alias("n"), (F.avg("v") / 255).alias("mean")).where("n >= 3")
    return mean.groupBy(by).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("m")).select(by, "n", F.transform("m", lambda s: s["mean"]).alias("values"))


def preview(gray: DataFrame) -> DataFrame:
    """(id, rgba): gray bytes (id, data) as RGBA bytes, alpha 255."""
    pixel = lambda h: F.concat(h, h, h, F.lit("FF"))
    two = F.regexp_extract_all(F.hex("data"), F.lit(".."), F.lit(0))
    return gray.select("id", F.unhex(F.array_join(F.transform(two, pixel), "")).alias("rgba"))


def quads(rows: DataFrame) -> DataFrame:
    """(id, found, corners): the corners x, y of each image's quadrilateral."""

    def f(key: str, img: np.ndarray) -> list[tuple]:
        q = im.detect_quad(img)
        return [(key, q is not None, [] if q is None else q.ravel().tolist())]

    return _each(rows, "id string, found boolean, corners array<double>", f)


def bands(rows: DataFrame) -> DataFrame:
    """(id, width, height, data): the line of text of each image that has one."""

    def f(key: str, img: np.ndarray) -> list[tuple]:
        b = im.zone_band(img)
        return [] if b is None else [(key, b.shape[1], b.shape[0], b.tobytes())]

    return _each(rows, "id string, width int, height int, data binary", f)


def within(text: Column, took_ms: Column, limit_ms: int = READ_MS) -> Column:
    """What a reading gave, null if it came after the time-out of a one-shot query."""
    return F.when(took_ms < limit_ms, text)
