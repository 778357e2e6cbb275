"""Product codes of vectors: each codebook a kd-tree that is sent to the tasks, entries moved by distributed whole-number sums."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import discard, sized_broadcast, table, written

#: Parts of a vector, entries of a codebook, rounds, and what components are multiplied with before they are floored.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows that a task codes at a time.
ROWS = 1 << 14
#: Labels that hold more than this share of all rows; there can't be more than its inverse.
HOT = 0.01


@dataclass(frozen=True)
class Node:
    """A box of a kd-tree: the least and greatest components of its entries, and its two halves, or its entries if it is a leaf."""

    low: np.ndarray
    high: np.ndarray
    halves: tuple[Node, Node] | None
    entries: np.ndarray


def kd_tree(book: np.ndarray, leaf: int = 2) -> Node:
    """A tree over the rows of book, cut at the median of the widest component; equal rows may lie on both sides."""

    def grow(some: np.ndarray) -> Node:
        low, high = book[some].min(0), book[some].max(0)
        if len(some) <= leaf:
            return Node(low, high, None, np.sort(some))
        axis = int((high - low).argmax())
        order = some[np.argsort(book[some, axis], kind="stable")]
        half = len(order) // 2
        return Node(low, high, (grow(order[:half]), grow(order[half:])), some)

    return grow(np.arange(len(book)))


def nearest(book: np.ndarray, tree: Node, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry nearest to each point, of equals the lowest index, all in whole numbers.

    Branch and bound over all points at once: a box is entered by the points that are no farther from it than from
    their best entry so far. Those just as far enter too, since it may hold an equal entry of lower index. Each point
    takes the nearer half first.
    """
    best = np.full(len(points), np.iinfo(np.int64).max)
    at = np.full(len(points), len(book))

    def bound(node: Node, some: np.ndarray) -> np.ndarray:
        x = points[some]
        out = np.maximum(np.maximum(node.low - x, x - node.high), 0)
        return (out * out).sum(1)

    def visit(node: Node, some: np.ndarray, least: np.ndarray) -> None:
        some = some[least <= best[some]]
        if not len(some):
            return
        if node.halves is None:
            for e in node.entries.tolist():
                off = points[some] - book[e]
                far = (off * off).sum(1)
                better = (far < best[some]) | ((far == best[some]) & (e < at[some]))
                best[some[better]], at[some[better]] = far[better], e
            return
        a, b = node.halves
        to_a, to_b = bound(a, some), bound(b, some)
        first = to_a <= to_b
        visit(a, some[first], to_a[first])
        visit(b, some, to_b)
        visit(a, some[~first], to_a[~first])

    visit(tree, np.arange(len(points)), np.zeros(len(points), np.int64))
    return at, best


def _ints(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): usable vectors with each component x as floor(4096 x)."""
    e = F.col("embedding")
    usable = e.isNotNull() & F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    v = F.transform(e, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.where(usable).select("vec_id", "label", v.alias("v"))


def _largest(dim: int) -> int:
    """The largest component whose squared distances, summed over a vector, stay within 63 bits."""
    return int((2.0**62 / max(dim, 1)) ** 0.5 / 2)


def first_books(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The codebooks to begin with: the parts of the `entries` smallest vec_ids, of rows of one id by their components; null ids come last."""
    some = [r.v for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    return np.split(np.array(some, np.int64), parts, axis=1)


def _sent(rows: DataFrame, books: list[np.ndarray]) -> Broadcast:
    """The codebooks and their trees, sent to the tasks: parts x entries x width numbers and as much again, whatever the number of vectors."""
    return rows.sparkSession.sparkContext.broadcast((books, [kd_tree(b) for b in books]))


def _partial_sums(sent: Broadcast) -> Callable:
    """For each task, the sums and counts of the parts nearest to each entry; no row per vector leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = sent.value
        sums = [np.zeros_like(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                for j, part in enumerate(np.split(_ints(batch.column("v").slice(at, ROWS)), len(books), axis=1)):
                    near, _ = nearest(books[j], trees[j], part)
                    np.add.at(sums[j], near, part)
                    counts[j] += np.bincount(near, minlength=len(books[j]))
        for j, count in enumerate(counts):
            used = np.flatnonzero(count)
            width = books[j].shape[1]
            cell = [np.full(len(used) * width, j), np.repeat(used, width), np.tile(np.arange(width), len(used)), sums[j][used].ravel(), np.repeat(count[used], width)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cell], ["part", "entry", "pos", "total", "n"])

    return run


def moved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every entry becomes the floored mean of the parts nearest to it; unused ones stay. The driver gets one row per component of an entry."""
    sent = _sent(rows, books)
    sums = rows.select("v").mapInArrow(_partial_sums(sent), "part long, entry long, pos long, total long, n long")
    total = F.sum(F.col("total").cast("decimal(38,0)"))
    out = [b.copy() for b in books]
    for r in sums.groupBy("part", "entry", "pos").agg(total.alias("total"), F.sum("n").alias("n")).collect():
        out[r.part][r.entry, r.pos] = int(r.total) // r.n
    sent.unpersist()
    return out


def coded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """rows (vec_id, label, v) as (vec_id, label, code, error)."""

    sent = _sent(rows, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = sent.value
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                near = [nearest(*x) for x in zip(books, trees, np.split(_ints(part.column("v")), len(books), axis=1), strict=True)]
                digits = np.stack([n for n, _ in near], 1).astype(np.uint8)
                codes = [row.tobytes().hex() for row in digits]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(codes, pa.string()), pa.array(sum(d for _, d in near))], ["vec_id", "label", "code", "error"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind('vec_id')}, label {kind('label')}, code string, error long")


def label_sums(rows: DataFrame, out: str) -> DataFrame:
    """rows with the sum of `error` over all rows of their label, nulls together.

    Sums are combined before the shuffle. They meet the rows by broadcast if their measured size allows; else those of
    labels with over HOT of all rows, 100 at most, are broadcast, and only the rows of other labels are shuffled.
    """
    sums = written(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias(out), F.count(F.lit(1)).alias("_n")), "labels")
    same: Column = F.col("label").eqNullSafe(F.col("_label"))
    total = sums.agg(F.sum("_n")).first()[0] or 0
    hot = F.col("_n") > HOT * total
    join = lambda left, right: left.join(right.drop("_n"), same).drop("_label")
    small = sized_broadcast(sums)
    if small is not sums:
        return join(rows, small)
    of_hot = F.broadcast(sums.where(hot))
    return join(rows, of_hot).unionByName(join(rows.join(of_hot, same, "left_anti"), sums.where(~hot)))


def product_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of the usable vectors, written, and the codebooks.

    Vectors that are null or hold null, NaN or infinite components are left out. All others must have one length, a
    multiple of `parts`, and components within the range in which squared distances are exact (about 2^27 for 64 of them
    once multiplied): else ValueError. An entry's index has two hex digits, so there are 256 entries at most. Fewer
    vectors than entries make smaller codebooks; no vector makes no row. Each round is one pass over the whole numbers,
    which are stored once; a task holds ROWS vectors, sums of the codebooks' size, and the codebooks with their trees.
    """
    if not 0 < entries <= 256:
        raise ValueError("codebooks have 1 to 256 entries")
    rows = written(whole_numbers(vectors), "whole")
    least, most, low, high, n = rows.agg(F.min(F.size("v")), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v")), F.count(F.lit(1))).first()
    if not n:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    if least != most or most % parts or not most:
        raise ValueError(f"vectors need one length, a multiple of {parts}; found {least} to {most}")
    if max(-low, high) > _largest(most):
        raise ValueError(f"components beyond {_largest(most) // SCALE} can't be coded exactly")
    books = reduce(lambda b, _: moved(rows, b), range(rounds), first_books(rows, parts, entries))
    out = written(coded(rows, books), "codes")
    discard(rows)
    return out, books


def books_text(books: list[np.ndarray]) -> str:
    """All numbers of the codebooks by part, entry and place, joined by commas."""
    return ",".join(str(x) for b in books for x in b.ravel().tolist())


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, as in product_codes(), with their errors' sums over equal labels. Rows of one vec_id stay rows; other columns are ignored."""
    rows, books = product_codes(table(spark, sf_dir, "embeddings"))
    name = hashlib.sha256(books_text(books).encode()).hexdigest()
    return label_sums(rows, "label_error").select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))


def _sql() -> str:
    """Six rounds of assignment and movement, each a query over the one before."""
    out = ["""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, j, v[j * (len(v) // 8) + 1 : (j + 1) * (len(v) // 8)] AS x FROM v, (SELECT unnest(range(0, 8)) AS j)),
b0 AS MATERIALIZED (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16))"""]  # fmt: skip
    near = """a{i} AS MATERIALIZED (SELECT vec_id, j, x, e, d FROM (SELECT vec_id, p.j, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b{i} b ON b.j = p.j)
  QUALIFY row_number() OVER (PARTITION BY vec_id, j ORDER BY d, e) = 1)"""
    move = """m{k} AS (SELECT j, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS y FROM a{i}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS i) GROUP BY j, e, i),
b{k} AS MATERIALIZED (SELECT b.j, b.e, coalesce(n.c, b.c) AS c FROM b{i} b LEFT JOIN (SELECT j, e, list(y ORDER BY i) AS c FROM m{k} GROUP BY j, e) n ON n.j = b.j AND n.e = b.e)"""
    for i in range(ROUNDS):
        out += [near.format(i=i), move.format(i=i, k=i + 1)]
    out.append(near.format(i=ROUNDS))
    done = f"""SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY j) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id"""
    name = f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, e)) FROM b{ROUNDS})"
    return ",\n".join(out) + f",\nr AS ({done})\nSELECT r.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {name} AS codebooks_sha256 FROM r JOIN v ON v.vec_id = r.vec_id"


SQL = _sql()
