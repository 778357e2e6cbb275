"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import discard, written

#: Links that a task takes together before the joins, and about how many it is given.
TOGETHER = 1 << 18
_KINDS = "lo long, hi long"


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number that links a[i] - b[i] lead to, for each of 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            return root


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lo, hi): of some links at a time, each node's link to the least one that they lead to."""
    have, rows = [], 0

    def out() -> pa.RecordBatch:
        lo, hi = (np.concatenate([b.column(c).to_numpy() for b in have]) for c in ("lo", "hi"))
        names, at = np.unique(np.concatenate([lo, hi]), return_inverse=True)
        root = roots(at[: len(lo)], at[len(lo) :], len(names))
        some = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[root[some]]), pa.array(names[some])], ["lo", "hi"])

    for batch in batches:
        have.append(batch)
        rows += len(batch)
        if rows >= TOGETHER:
            yield out()
            have, rows = [], 0
    if rows:
        yield out()


def _packed(links: DataFrame) -> DataFrame:
    """links of a written table, which is deleted, written with shorter paths: tasks take about TOGETHER links each, however
    many files the table has, so that the more links meet in a task the fewer steps of joins are left."""
    parts = max(1, -(-links.count() // TOGETHER))
    out = written(links.coalesce(parts).mapInArrow(_shortened, _KINDS), "links")
    discard(links)
    return out


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component), written: component is the smallest node reachable by links; nodes without links are absent. Nodes are longs.

    Alternating large-star and small-star steps: each step joins every node's neighbours to its smallest neighbour, so
    that diameters shrink by half; before each, tasks shorten the paths within a bounded number of their own links. The
    star of a hot node is an aggregate with map-side combine and a join that adaptive execution can split.
    Null ends and self-links are ignored. No link table reaches the driver, only whether one is not yet made of stars.
    """
    lo, hi = F.least(a, b).cast("long").alias("lo"), F.greatest(a, b).cast("long").alias("hi")
    some = links.where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`").select(lo, hi)
    edges = _packed(written(some.mapInArrow(_shortened, _KINDS), "links"))
    while True:
        ends = edges.select(F.col("hi").alias("n"), F.col("lo").alias("up")).union(edges.select(F.col("lo").alias("n"), F.lit(None).cast("long")))
        seen = ends.groupBy("n").agg(F.min("up").alias("l"), F.max("up").alias("m"), F.max(F.col("up").isNull()).alias("top"))
        if seen.where("l is not null and (l <> m or top)").isEmpty():
            break
        both = edges.union(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy("lo").agg(F.least("lo", F.min("hi")).alias("m"))
        large = both.join(least, "lo").where("hi > lo").select(F.col("m").alias("lo"), "hi").where("lo < hi")
        # small star: every node's smaller neighbours go to the smallest of them
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").select(F.col("m").alias("lo"), F.explode(F.array("hi", "lo")).alias("hi")).where("lo < hi")
        before, edges = edges, _packed(written(small.mapInArrow(_shortened, _KINDS), "links"))
        discard(before)
    found = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select("lo", "lo")).distinct()
    out = written(found, "components")
    discard(edges)
    return out
