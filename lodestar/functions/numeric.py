"""Rounding, clamping, bit and geometry expressions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The guide frame's aspect, its share of the width, and the most of the height it may take.
GUIDE_ASPECT, GUIDE_WIDTH, GUIDE_HEIGHT = 439 / 380, 0.85, 0.85


def half_even(x: Column) -> Column:
    """Nearest whole number, ties to even, never -0."""
    return F.rint(x) + F.lit(0.0)


def half_up(x: Column) -> Column:
    """Nearest whole number, ties toward plus infinity."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    """x within low..high; a NaN stays NaN."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(x < lit(low), lit(low)).when(F.isnan(x.cast("double")), x).when(x > lit(high), lit(high)).otherwise(x)


def percent(x: Column) -> Column:
    """Whole percents of a score, negative ones as 0."""
    return half_up(F.greatest(x, F.lit(0.0)) * 100).cast("int")


def hex_bits(text: Column) -> Column:
    """16 hexadecimal digits as the same 64 bits."""
    return F.conv(text, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Number of bits in which two 64-bit values differ."""
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(vector: Column) -> Column:
    """One bit for each of the first 64 components, 1 if it is positive."""
    bit = lambda acc, s: acc.bitwiseOR(s)
    marks = F.transform(F.slice(vector, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(marks, F.lit(0).cast("bigint"), bit)


def floor_percentile(values: Column, p: float) -> Column:
    """The element at floor(n * p), at most the last, of an array in order; null if empty."""
    n = F.size(values)
    return F.get(F.array_sort(values), F.least(n - 1, F.floor(n * F.lit(p)).cast("int")))


def fit_within(width: Column, height: Column, most: Column) -> Column:
    """(width, height) shrunk to a width of `most` at most, the height at least 1."""
    shrunk = F.struct(most.alias("width"), F.greatest(half_up(height.cast("double") * most / width), F.lit(1)).cast("int").alias("height"))
    return F.when(width <= most, F.struct(width.alias("width"), height.cast("int").alias("height"))).otherwise(shrunk)


def _positive(width: Column, height: Column, value: Column) -> Column:
    return F.when((width > 0) & (height > 0), value).otherwise(F.raise_error(F.lit("sizes must be positive")))


def guide_rect(width: Column, height: Column) -> Column:
    """The centred guide frame (x, y, width, height) of a container; raises for sizes that aren't positive."""
    by_width = width * F.lit(GUIDE_WIDTH)
    high = F.least(by_width / GUIDE_ASPECT, height * F.lit(GUIDE_HEIGHT))
    wide = F.when(by_width / GUIDE_ASPECT > height * GUIDE_HEIGHT, height * GUIDE_HEIGHT * GUIDE_ASPECT).otherwise(by_width)
    rect = F.struct(((width - wide) / 2).alias("x"), ((height - high) / 2).alias("y"), wide.alias("width"), high.alias("height"))
    return _positive(width, height, rect)


def cover_source_rect(video_w: Column, video_h: Column, box_w: Column, box_h: Column, guide: Column) -> Column:
    """Whole pixels of a video, shown so that it covers a box, that lie under the guide frame."""
    scale = F.greatest(box_w / video_w, box_h / video_h)
    x = clamp(half_up((guide["x"] - (box_w - video_w * scale) / 2) / scale).cast("int"), 0, video_w - 1)
    y = clamp(half_up((guide["y"] - (box_h - video_h * scale) / 2) / scale).cast("int"), 0, video_h - 1)
    w = clamp(half_up(guide["width"] / scale).cast("int"), 1, video_w - x)
    h = clamp(half_up(guide["height"] / scale).cast("int"), 1, video_h - y)
    return _positive(video_w, video_h, _positive(box_w, box_h, F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))))
