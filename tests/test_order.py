"""Selection and numbering without a task that holds a whole group, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators.catalog_view import numbered
from lodestar.operators.histogram import percentile

RNG = random.Random(4)


def want(rows, p):
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    key = lambda v: (v != v, v)
    return {g: sorted(vs, key=key)[min(len(vs) - 1, math.floor(len(vs) * p))] for g, vs in groups.items()}


ROWS = {
    "double": [(g, RNG.gauss(0, 1) ** 3) for g in ("a", "b", None) for _ in range(300)] + [("one", 2.5), ("null", None), ("same", 7.0), ("same", 7.0)] + [("few", x) for x in (1.0, 2.0, float("nan"), float("inf"))],
    "long": [(g, RNG.choice([1, 5, 1 << 60, (1 << 60) + RNG.randrange(50), -(1 << 62)])) for g in ("a", "b") for _ in range(400)],
}


@pytest.mark.parametrize("kind", sorted(ROWS))
@pytest.mark.parametrize(("p", "ranges", "few"), [(0.8, 16, 20), (0.5, 64, 1), (1.0, 1024, 4096)])
def test_percentile(spark, kind, p, ranges, few):
    out = percentile(spark.createDataFrame(ROWS[kind], f"k string, x {kind}"), "k", "x", p, ranges, few)
    plan = out._jdf.queryExecution().toString()
    assert "Window" not in plan and out.columns == ["k", "percentile"]
    assert {r.k: str(r.percentile) for r in out.collect()} == {g: str(v) for g, v in want(ROWS[kind], p).items()}


def test_percentile_of_no_rows(spark):
    assert percentile(spark.createDataFrame([], "k string, x double"), "k", "x", 0.8).count() == 0


@pytest.mark.parametrize("n", [0, 1, 700])
def test_numbered(spark, n):
    rows = [(RNG.randrange(40), i) for i in range(n)]
    out = numbered(spark.createDataFrame(rows, "a long, b long"), ["a", "b"], "ord")
    assert "SinglePartition" not in out._jdf.queryExecution().toString() and "exchange" not in out._jdf.queryExecution().toString().lower()
    assert [tuple(r) for r in out.orderBy("ord").collect()] == [(a, b, k + 1) for k, (a, b) in enumerate(sorted(rows))]
    assert out.where(F.col("ord").isNull()).count() == 0


def test_line_box(spark):
    """The margin ends at the strip's edges; lines that are too low or too narrow are left out."""
    from lodestar.operators.histogram import line_box

    def line(image, x, step, y, h):
        return [(image, 20, x + k * step, y, x + k * step + 5, y + h - 1, 200, 40) for k in range(3)]

    rows = line(1, 1, 20, 2, 30) + line(2, 50, 20, 20, 1) + line(3, 90, 1, 10, 12) + line(4, 150, 22, 25, 14)
    shapes = spark.createDataFrame(rows, "image int, area int, x0 int, y0 int, x1 int, y1 int, strip_w int, strip_h int")
    assert sorted(map(tuple, line_box(shapes).collect())) == [(1, 3, 0, 0, 50, 35), (4, 3, 146, 21, 199, 39)]
    assert [r.image for r in line_box(shapes, margin=0).orderBy("image").collect()] == [1, 4]
    assert line_box(shapes.limit(0)).collect() == []
