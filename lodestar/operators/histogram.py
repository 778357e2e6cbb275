"""Histogram thresholds, percentiles and shape filters as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.functions.numeric import clamp, floor_percentile
from lodestar.sources.shared import stored

BINS = 64
#: Groups whose ranges are broadcast, at most; each takes a few numbers.
BROADCAST_GROUPS = 100_000


def otsu(rows: DataFrame, group: str, value: str, low: float | None = 0.3, high: float | None = 0.8) -> DataFrame:
    """(group, threshold): the first of 64 bins that best splits values of 0..1 in two; clamped unless low is None."""
    bins = rows.select(group, clamp(F.floor(F.col(value) * BINS), 0, BINS - 1).cast("int").alias("bin")).groupBy(group, "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy(group).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(group)
    x = bins.withColumn("nb", F.sum("n").over(upto)).withColumn("sb", F.sum(F.col("n") * F.col("bin")).over(upto))
    x = x.withColumn("nt", F.sum("n").over(whole)).withColumn("st", F.sum(F.col("n") * F.col("bin")).over(whole))
    last = F.col("nb") == F.col("nt")  # nothing above: only counts, as the middle bin, where no other split exists
    gap = F.col("sb") / F.col("nb") - (F.col("st") - F.col("sb")) / F.nullif(F.col("nt") - F.col("nb"), F.lit(0))
    between = F.col("nb").cast("double") * (F.col("nt") - F.col("nb")) * gap * gap
    x = x.select(group, F.when(last, F.lit(-1.0)).otherwise(between).alias("between"), F.when(last, F.lit(BINS // 2)).otherwise(F.col("bin")).alias("bin"))
    best = x.groupBy(group).agg(F.max(F.struct("between", (-F.col("bin")).alias("first"))).alias("b"))
    cut = (-F.col("b.first") + 1) / float(BINS)
    return best.select(group, (cut if low is None else clamp(cut, low, high)).alias("threshold"))


def _range_holding(parts: Column, rank: Column) -> Column:
    """Of counted ranges (n, low, high, ...) in order, the one that holds the element of a rank, and the rank within it."""
    none = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at"), F.lit(0).cast("long").alias("rank"), F.lit(0).alias("i"))

    def step(s: Column, x: Column) -> Column:
        here = s["at"].isNull() & (s["seen"] + x["n"] > rank)
        return F.struct((s["seen"] + x["n"]).alias("seen"), F.when(here, s["i"]).otherwise(s["at"]).alias("at"), F.when(here, rank - s["seen"]).otherwise(s["rank"]).alias("rank"), (s["i"] + 1).alias("i"))

    return F.aggregate(parts, none, step)


def percentile(rows: DataFrame, group: str, value: str, p: float, ranges: int = 1024, few: int = 4096) -> DataFrame:
    """(group, percentile): the element at floor(n * p), at most the last, of each group's values in order, nulls left out.

    Found by counts alone: each pass counts a group's values in `ranges` ranges of equal width, before the shuffle, and
    goes on in the range that holds the rank; passes end when no range that is left holds more than `few` values or can
    be narrowed. Only of those ranges are the distinct values and their counts brought together. No group is sorted,
    whatever its size. Null is a group; NaN counts as the largest value.
    """
    data = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    state = data.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    state = stored(state.select("g", "n", "low", "high", F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)).cast("long")).alias("rank")), "percentile")
    most = 1.7e308
    place = lambda c: F.greatest(F.least(F.nanvl(F.col(c).cast("double"), F.lit(most)), F.lit(most)), F.lit(-most)) / 2
    width = place("high") - place("low")

    def held(state: DataFrame, groups: int) -> DataFrame:
        """The values of the ranges that are left."""
        left = (F.broadcast(state) if groups <= BROADCAST_GROUPS else state).withColumnRenamed("g", "_g")
        return data.join(left, F.col("g").eqNullSafe(F.col("_g")) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))

    while True:
        wide = (F.col("n") > few) & (width > 0)  # a pass narrows each of these: their least and greatest values part
        groups, open_ = state.agg(F.count(F.lit(1)), F.count_if(wide)).first()
        if not open_:
            break
        part = F.least(F.floor((place("v") - place("low")) / width * ranges), F.lit(ranges - 1)).cast("int")
        counts = held(state.where(wide), open_).groupBy("g", "rank", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        lists = counts.groupBy("g", "rank").agg(F.array_sort(F.collect_list(F.struct("part", "n", "low", "high"))).alias("parts"))
        found = lists.withColumn("f", _range_holding(F.col("parts"), F.col("rank"))).withColumn("x", F.get("parts", F.col("f.at")))
        state = stored(state.where(~wide).unionByName(found.select("g", "x.n", "x.low", "x.high", F.col("f.rank").alias("rank"))), "percentile")
    last = held(state.where("low <> high"), groups).groupBy("g", "rank", "v").agg(F.count(F.lit(1)).alias("n"))
    lists = last.groupBy("g", "rank").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("parts"))
    picked = lists.select("g", F.get("parts", _range_holding(F.col("parts"), F.col("rank"))["at"])["v"].alias("percentile"))
    return state.where("low = high").select("g", F.col("low").alias("percentile")).unionByName(picked).withColumnRenamed("g", group)


def glyphs(shapes: DataFrame, strip_width: str = "strip_w", strip_height: str = "strip_h") -> DataFrame:
    """Components (image, area, x0, y0, x1, y1) shaped like letters, of images with three or more of them."""
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    ok = (F.col("area") >= 12) & (h >= 0.08 * F.col(strip_height)) & (h <= 0.6 * F.col(strip_height)) & (w <= 3 * h) & (w <= 0.2 * F.col(strip_width))
    return shapes.where(ok).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("image"))).where("_n >= 3").drop("_n")


def text_line(shapes: DataFrame) -> DataFrame:
    """(image, n, x0, y0, x1, y1): the box of the glyphs on the middle line, if there are three or more."""
    x = shapes.withColumn("cy", (F.col("y0") + F.col("y1")) / 2).withColumn("h", F.col("y1") - F.col("y0") + 1)
    mid = x.groupBy("image").agg(floor_percentile(F.collect_list("cy"), 0.5).alias("my"), floor_percentile(F.collect_list("h"), 0.5).alias("mh"))
    on = x.join(mid, "image").where(F.abs(F.col("cy") - F.col("my")) < F.col("mh"))
    return on.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).where("n >= 3")


#: The margin around a text line, its least height, and its least width as a share of the strip's.
LINE_MARGIN, LINE_HEIGHT, LINE_SHARE = 4, 10, 0.1


def line_box(shapes: DataFrame, margin: int = LINE_MARGIN, least_height: int = LINE_HEIGHT, least_share: float = LINE_SHARE) -> DataFrame:
    """(image, n, x0, y0, x1, y1): text_line with a margin that ends at the strip's edges, if it is large enough to be read.

    shapes are glyphs with the size of their image's strip (strip_w, strip_h; the largest counts where they differ).
    """
    strips = shapes.groupBy("image").agg(F.max("strip_w").alias("sw"), F.max("strip_h").alias("sh"))
    low = lambda c: F.greatest(F.lit(0), F.col(c) - margin).alias(c)
    high = lambda c, edge: F.least(F.col(edge) - 1, F.col(c) + margin).alias(c)
    boxes = text_line(shapes).join(strips, "image").select("image", "n", low("x0"), low("y0"), high("x1", "sw"), high("y1", "sh"), "sw")
    enough = (F.col("y1") - F.col("y0") + 1 >= least_height) & (F.col("x1") - F.col("x0") + 1 >= least_share * F.col("sw"))
    return boxes.where(enough).drop("sw")
