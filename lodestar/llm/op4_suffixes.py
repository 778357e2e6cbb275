"""Suffix-array dedup with a logarithmic family of sorted suffix levels."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import discard, table, written
from lodestar.llm.repeats import GATHER, HELD, LAST_ID, Windows, copies, digested, named, once, packed, parts_for, portions, repeated, unpacked

#: Matches of 50 bytes. Suffixes start at sampled positions, one or more in any 50 bytes, and every match of 50 bytes
#: holds one such position with the 16 bytes after it: suffixes that are to match agree in as many bytes.
WINDOWS = Windows(50, 16, words=False)
#: Batches that the query adds, in the order of doc_id: two merge, and the third is scanned against them.
BATCHES = 3
#: Documents of the first batch from whose suffixes the ranges are cut, about.
RANGE_SAMPLE = 2000
#: A suffix: its first 16 bytes, the rk of its text, and 4 * place + 2 * met + aside, where place is the first window of the
#: run sampled there.
_NAMES = ("p1", "p2", "id", "at")
_KINDS = "p1 long, p2 long, id long, at long"
#: Suffixes travel and are stored in blocks, sorted by their bytes, one for each range that a task finds them in; those set
#: aside are blocks of their own, of (id, at), in no order.
_BLOCKS = "range int, aside boolean, block binary"
#: Suffixes of a block at most.
BLOCK = 1 << 16


def _heads(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 16 bytes from each position on as two numbers that sort as the bytes do."""
    out = []
    for k in (0, 8):
        head = np.zeros(len(at), np.uint64)
        for i in range(8):
            head = (head << np.uint64(8)) | raw[at + (k + i)]
        out.append((head ^ np.uint64(1 << 63)).view(np.int64))
    return out[0], out[1]


def _sampled(batches: Iterator[pa.RecordBatch], windows: Windows) -> Iterator[tuple[np.ndarray, ...]]:
    """_NAMES of the sampled suffixes of texts (rk, text), some texts at a time."""
    for batch in batches:
        ids = batch.column("rk").to_numpy()
        for p in portions(batch.column("text"), windows):
            runs = p.runs()
            yield (*_heads(np.frombuffer(p.text, np.uint8), runs.sample), ids[p.row[runs.text]], runs.place() * 4)


def _scanned(have: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sorted pieces brought into one order of suffixes and scanned: a suffix is met if one of another document agrees in
    all 16 bytes, or with one that is met. Of met suffixes with the same bytes the first stands for all from now on and the
    others are put aside; nothing is ordered by their bytes any more."""
    p1, p2, ids, at = (np.concatenate(c) for c in zip(*have, strict=True))
    order = np.lexsort((p2, p1))
    p1, p2, ids, at = p1[order], p2[order], ids[order], at[order]
    if not len(p1):
        return p1, p2, ids, at
    common = np.zeros(len(p1), bool)  # whether all 16 bytes agree with the suffix before
    common[1:] = ((p1[1:] ^ p1[:-1]) | (p2[1:] ^ p2[:-1])) == 0
    new = np.flatnonzero(~common)
    some = (np.minimum.reduceat(ids, new) != np.maximum.reduceat(ids, new)) | ((np.bitwise_or.reduceat(at, new) & 2) > 0)
    met = np.repeat(some, np.diff(np.append(new, len(p1))))
    return p1, p2, ids, at | (met * 2) | (met & common)


def _blocks(cols: tuple[np.ndarray, ...], cuts: np.ndarray) -> pa.RecordBatch:
    """_BLOCKS of scanned suffixes."""
    aside = (cols[3] & 1) > 0
    stays = [c[~aside] for c in cols]
    edges = [0, *np.searchsorted(stays[0], cuts, side="left").tolist(), len(stays[0])]
    ranges, blocks = [], []
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        for i in range(a, b, BLOCK):
            ranges.append(k)
            blocks.append(packed([c[i : min(i + BLOCK, b)] for c in stays]))
    ordered, rest = len(blocks), [c[aside] for c in cols[2:]]
    for i in range(0, len(rest[0]), BLOCK):
        ranges.append(int(rest[0][i] * 31 + (rest[1][i] >> 2)) % (len(cuts) + 1))
        blocks.append(packed([c[i : i + BLOCK] for c in rest]))
    kinds = [False] * ordered + [True] * (len(blocks) - ordered)
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(kinds, pa.bool_()), pa.array(blocks, pa.binary())], ["range", "aside", "block"])


def suffixes(texts: DataFrame, windows: Windows, edges: list[int]) -> DataFrame:
    """_BLOCKS of the sampled suffixes. Where a task finds suffixes of several documents with the same 16 bytes, all are met;
    the first stays to meet those of other tasks, and the others are put aside."""
    cuts = np.array(edges, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, rows = [], 0
        for cols in _sampled(batches, windows):
            have.append(cols)
            rows += len(cols[0])
            if rows >= GATHER:
                yield _blocks(_scanned(have), cuts)
                have, rows = [], 0
        if have:
            yield _blocks(_scanned(have), cuts)

    return texts.select("rk", "text").mapInArrow(run, _BLOCKS)


def range_edges(texts: DataFrame, windows: Windows, conf: str) -> list[int]:
    """Heads that cut the suffixes of a sample of the texts evenly, so that a range of some batches like this one is held by
    a task; all tables of a family are cut alike."""
    n, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = parts_for(size * 2 * BATCHES // (windows.size - windows.gram), conf)
    some = texts.where(F.pmod(F.xxhash64("rk"), F.lit(max(1, n // RANGE_SAMPLE))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _sampled(batches, windows):
            yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.float64))], ["p"])

    heads = some.select("rk", "text").mapInArrow(run, "p double")
    return [int(x) for x in heads.approxQuantile("p", [i / parts for i in range(1, parts)], min(0.001, 0.1 / parts))]


def _met_rows(cols: list[np.ndarray] | tuple[np.ndarray, ...]) -> pa.RecordBatch:
    ids, at = cols[-2:]
    some = (at & 2) > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(at[some] >> 2)], ["id", "place"])


def _scan(edges: list[int], *, met_only: bool) -> Callable:
    """A mapInArrow function over all _BLOCKS of a range: scans their suffixes in one order. Beyond HELD of them, those put
    aside are handed on at once. met_only: (id, place) of the met ones."""
    cuts = np.array(edges, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, rows, most = [], 0, HELD

        def out(cols: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return _met_rows(cols) if met_only else _blocks(cols, cuts)

        for batch in batches:
            aside = batch.column("aside").to_numpy(zero_copy_only=False)
            if aside.any():
                if met_only:
                    yield from (_met_rows(unpacked(block, 2)) for block in batch.column("block").filter(pa.array(aside)))
                else:
                    yield batch.filter(pa.array(aside))
            for block in batch.column("block").filter(pa.array(~aside)):
                have.append(tuple(unpacked(block, 4)))
                rows += len(have[-1][0])
                if rows > most:
                    cols = _scanned(have)
                    gone = (cols[3] & 1) > 0
                    yield out(tuple(c[gone] for c in cols))
                    have = [tuple(c[~gone] for c in cols)]
                    rows = len(have[0][0])
                    most = max(most, 2 * rows)
        if have:
            yield out(_scanned(have))

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes of _BLOCKS; those put aside have no bytes."""
    for batch in batches:
        for aside, block in zip(batch.column("aside").to_pylist(), batch.column("block"), strict=True):
            cols = unpacked(block, 2 if aside else 4)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in ([np.zeros_like(c) for c in cols] if aside else []) + cols], list(_NAMES))


def _met_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for aside, block in zip(batch.column("aside").to_pylist(), batch.column("block"), strict=True):
            yield _met_rows(unpacked(block, 2 if aside else 4))


class SuffixLevels:
    """Levels of sorted suffixes, each of twice as many batches as the next; a new batch merges with those of its own size.

    levels: (size, rows of the level); the blocks that they are stored as are kept by size."""

    def __init__(self, windows: Windows = WINDOWS):
        self.windows, self.levels, self.edges, self.across, self.blocks = windows, [], None, [], {}

    def add(self, texts: DataFrame, *, last: bool = False) -> None:
        """Merge-scan the suffixes of a batch (rk, text) with the levels: those of its own size become one with it, larger
        ones are scanned against it. Of the last batch only what is met is kept, and one pass meets all levels."""
        if self.edges is None:
            self.edges = range_edges(texts, self.windows, texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        new = suffixes(texts, self.windows, self.edges)
        if last:
            for blocks in self.blocks.values():
                new = new.union(blocks.where("not aside"))
            found = [self._merged(new, met_only=True), *[_met(blocks.where("aside")) for blocks in self.blocks.values()]]
            self.across.append(written(reduce(DataFrame.union, found), "met"))
            return
        size, due = 1, []
        while self.levels and self.levels[-1][0] == size:
            self.levels.pop()
            due.append(self.blocks.pop(size))
            size *= 2
        for blocks in self.blocks.values():
            self.across.append(written(self._merged(new.union(blocks.where("not aside")), met_only=True), "met"))
        for blocks in due:
            new = new.union(blocks.where("not aside"))
        level = written(reduce(DataFrame.union, [self._merged(new), *[blocks.where("aside") for blocks in due]]), "level")
        self.blocks[size] = level
        self.levels.append((size, level.mapInArrow(_rows, _KINDS)))
        discard(*due)

    def met(self) -> DataFrame:
        """(id, place) of all suffixes met in several documents so far, some of them twice."""
        return reduce(DataFrame.union, [_met(blocks) for blocks in self.blocks.values()] + self.across)

    def finished(self) -> DataFrame:
        """met(), written, after a last batch that met all levels, which are deleted."""
        discard(*self.blocks.values())
        self.levels, self.blocks = [], {}
        return self.met() if len(self.across) == 1 else written(self.met(), "met")

    def _merged(self, rows: DataFrame, *, met_only: bool = False) -> DataFrame:
        """The blocks of each range brought together and scanned once; met_only: (id, place) of the met ones only."""
        return rows.repartitionById(len(self.edges) + 1, "range").mapInArrow(_scan(self.edges, met_only=met_only), "id long, place long" if met_only else _BLOCKS)


def _met(blocks: DataFrame) -> DataFrame:
    """(id, place) of the met suffixes of blocks."""
    return blocks.mapInArrow(_met_of, "id long, place long")


def candidates(texts: DataFrame, windows: Windows = WINDOWS, batches: int = BATCHES) -> DataFrame:
    """(rk, place), written, of the suffixes met in several documents; the batches are added in the order of id, null ids with the last."""
    parts = [i / batches for i in range(1, batches)]
    known = texts.where(F.col("id") != LAST_ID).select("id")
    cuts = [min(int(x), LAST_ID) for x in known.approxQuantile("id", parts, 0.01)] if parts else []
    edges = [-(1 << 63), *sorted(set(cuts)), None]
    levels = SuffixLevels(windows)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        levels.add(texts.where(F.col("id") >= lo) if hi is None else texts.where((F.col("id") >= lo) & (F.col("id") < hi)), last=hi is None)
    return levels.finished().withColumnRenamed("id", "rk")


def _digest(text: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[int, int, int, str]:
    if len(stop) and stop[-1] == LAST_ID:
        n = len(text) if len(text) >= WINDOWS.size else 0
        start, stop = (np.array([0]), np.array([n])) if n else (start[:0], stop[:0])
    name, at = hashlib.sha256(), 0
    for a, b in zip(start.tolist(), stop.tolist(), strict=True):
        name.update(text[at:a])
        at = b
    name.update(text[at:])
    return len(text), int((stop - start).sum()), len(start), name.hexdigest()


def deduped(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs.

    A null text is empty; an empty table gives no rows; a null doc_id counts as the largest number; rows of one id don't
    match each other; of texts that occur twice or more all but those of the smallest id go as a whole if they have 50
    bytes; a text of any length is worked on in pieces. Strings are taken as equal by a 128-bit cryptographic digest.
    """
    docs = docs.select("doc_id", "text")
    known = copies(named(docs), earlier=True)
    first = once(named(docs), known)
    ranges = repeated(first, candidates(first, batches=batches), WINDOWS, earlier=True)
    columns = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")]
    return digested(docs, ranges, known, WINDOWS, _digest, columns)


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated bytes of all documents, as in deduped()."""
    return deduped(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, 200 * k AS o, substr(h, 400 * k + 1, 498) AS s, least(200, length(h) // 2 - 200 * k) AS n
      FROM (SELECT doc_id, h, unnest(range(0, length(h) // 400 + 1)) AS k FROM d)),
p AS (SELECT doc_id, o + j AS i, substr(s, 2 * j - 1, 2) AS b, CASE WHEN 2 * j + 98 <= length(s) THEN md5_number(substr(s, 2 * j - 1, 100)) END AS win
      FROM (SELECT doc_id, o, s, unnest(range(1, n + 1)) AS j FROM q)),
c AS (SELECT doc_id, i, b, CASE WHEN win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id THEN 1 ELSE 0 END AS rep FROM p),
m AS (SELECT doc_id, i, b, max(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM c),
s AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before FROM m),
k AS (SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (gone = 1 AND before = 0) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (gone = 0) AS kept
      FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
