"""Periodic runs of words: a harmonic grid of places for every period, and longest common extensions by prefix hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import flat_bytes, packets, table
from lodestar.llm.words import Prefix, word_hashes

#: A run has this many words at least, and this many times its period.
LEAST, TIMES = 24, 3
#: Pairs of a period and a grid point that are looked at together, about.
PAIRS = 1 << 19


@dataclass(frozen=True)
class Runs:
    """Maximal runs by text and start: words start..stop-1 of a text have the smallest period `period`."""

    text: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    period: np.ndarray


def _grids(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period q, place) of all grid points k * q of all texts with q up to a third of the text's words, some PAIRS
    at a time. Two whole periods follow each place within its text. Places are flat; n words have about n ln n of them."""
    sizes = np.diff(first)
    most = sizes // TIMES
    starts = np.concatenate([[0], np.cumsum(most)])
    done, total = 0, int(starts[-1])  # (text, period) pairs are numbered in the order of texts
    while done < total:
        span = np.arange(done, min(done + PAIRS, total))
        text = np.searchsorted(starts, span, side="right") - 1
        period = span - starts[text] + 1
        points = sizes[text] // period - 1
        ends = np.cumsum(points)
        stop = max(1, int(np.searchsorted(ends, PAIRS, side="right")))
        text, period, points, ends = text[:stop], period[:stop], points[:stop], ends[:stop]
        k = np.arange(int(ends[-1])) - np.repeat(ends - points, points)
        period, text = np.repeat(period, points), np.repeat(text, points)
        yield text, period, first[text] + k * period
        done += stop


def _extended(prefix: Prefix, a: np.ndarray, b: np.ndarray, most: np.ndarray, *, back: bool) -> np.ndarray:
    """How many symbols from places a and b on (or before them), `most` at most, are the same: one binary search for all pairs."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) >> 1
        same = prefix.of(a - mid, a) == prefix.of(b - mid, b) if back else prefix.of(a, a + mid) == prefix.of(b, b + mid)
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)


def grid_runs(sym: np.ndarray, first: np.ndarray, least: int = LEAST) -> Runs:
    """Runs of texts sym[first[i]:first[i + 1]] by equality of hashes.

    A run of period q and length max(least, 3 q) or more holds a grid point whose next q words recur q words on, if least
    is 24: its pair of places is extended both ways. Pairs that differ in their very first word or in the q words that
    would have to recur are left out before. Several grid points of a run give the same (start, stop); of those of several
    periods, multiples of the smallest, the smallest stays.
    """
    prefix, found = Prefix(sym), []
    for text, q, at in _grids(first):
        some = np.flatnonzero(sym[at] == sym[at + q])
        text, q, at = text[some], q[some], at[some]
        some = np.flatnonzero(prefix.of(at, at + q) == prefix.of(at + q, at + 2 * q))
        text, q, at = text[some], q[some], at[some]
        new = np.ones(len(at), bool)
        new[1:] = (text[1:] != text[:-1]) | (at[1:] != at[:-1] + q[:-1]) | (q[1:] != q[:-1])
        text, q, at = text[new], q[new], at[new]  # the grid points that follow are in the same run
        start = at - _extended(prefix, at, at + q, at - first[text], back=True)
        stop = at + q + _extended(prefix, at, at + q, first[text + 1] - at - q, back=False)
        long = np.flatnonzero(stop - start >= np.maximum(least, TIMES * q))
        both = np.unique(np.stack([start[long], stop[long], q[long], text[long]]), axis=1)
        found.append(both)
    rows = np.unique(np.concatenate(found, 1), axis=1) if found else np.empty((4, 0), np.int64)
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
    start, stop, q, text = rows[:, new]
    return Runs(text, start - first[text], stop - first[text], q)


def plain_runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, stop, period) of the runs of one text by comparing its very words, period by period."""
    names: dict = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(ids) // TIMES + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), (edge[1::2] + q).tolist(), strict=True):
            if b - a >= max(least, TIMES * q):
                found.setdefault((a, b), q)
    return sorted((a, b, q) for (a, b), q in found.items())


def _order(first: np.ndarray, crc: list[int | None]) -> np.ndarray:
    """Which word stands at each place once texts whose number says so have been made periodic."""
    order = np.arange(first[-1])
    for i, h in enumerate(crc):
        n = int(first[i + 1] - first[i])
        if h is None or h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        order[first[i] + a : first[i + 1]] = first[i] + a + np.arange(n - a) % p
    return order


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The (start, stop, period) of greatest length over period, then least start, then least period."""
    best = runs[0]
    for run in runs[1:]:
        more = (run[1] - run[0]) * best[2] - (best[1] - best[0]) * run[2]
        if more > 0 or (more == 0 and (run[0], run[2]) < (best[0], best[2])):
            best = run
    return best


def _portion(column: pa.Array, crc: list[int | None]) -> Iterator[tuple]:
    """The result of each text of an Arrow column, without its id."""
    raw, offsets = flat_bytes(column)
    sym, start, stop, text = word_hashes(raw, offsets)
    first = np.searchsorted(text, np.arange(len(offsets)))
    order = _order(first, crc)
    sym, start, stop = sym[order], start[order], stop[order]
    runs = grid_runs(sym, first)
    by = np.searchsorted(runs.text, np.arange(len(offsets))) if len(runs.text) else np.zeros(len(offsets), np.int64)
    whole = raw.tobytes()
    for i in range(len(offsets) - 1):
        words = [whole[a:b] for a, b in zip(start[first[i] : first[i + 1]].tolist(), stop[first[i] : first[i + 1]].tolist(), strict=True)]
        some = slice(by[i], by[i + 1])
        mine = list(zip(runs.start[some].tolist(), runs.stop[some].tolist(), runs.period[some].tolist(), strict=True))
        if not all(words[a : b - q] == words[a + q : b] for a, b, q in mine):
            mine = plain_runs(words)  # two different words, or stretches of them, had one hash
        keep = np.ones(len(words), bool)
        name = hashlib.sha256()
        for a, b, q in mine:
            keep[a + q : b] = False
            name.update(b"%d,%d,%d\n" % (a, b - a, q))
        left = b" ".join(words) if not mine else b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)
        a, b, q = _best(mine) if mine else (None, None, None)
        head = (a, b - a, q, 1000 * (b - a) // q) if mine else (None,) * 4
        yield len(mine), *head, name.hexdigest(), hashlib.sha256(left).hexdigest()


_COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256 and collapsed_sha256 of every row of docs.

    A run is a maximal stretch of words with smallest period q and max(24, 3 q) words or more. With planted, a tenth of
    the texts, by the crc32 of the doc_id, are made periodic before. Rows are worked on where they are read, without a
    shuffle. A null or empty text has no words and no run, whose four values are null; repeated rows stay; a null doc_id
    stays null and plants nothing; an empty table gives no rows; other columns are ignored. A text of n words takes about
    n ln n comparisons, PAIRS of them in memory at a time. Equal words and stretches are found by hash, and the words of
    each run are compared; a text where they differ is searched by its very words.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) if planted else F.lit(None).cast("long")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in packets(batch, "text"):
                part = batch.slice(a, b - a)
                columns = zip(*_portion(part.column("text"), part.column("crc").to_pylist()), strict=True)
                arrays = [pa.array(x, pa.string() if c.endswith("sha256") else pa.int64()) for c, x in zip(_COLUMNS, columns, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", *_COLUMNS])

    kinds = ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in _COLUMNS)
    return docs.select("doc_id", "text", crc.alias("crc")).mapInArrow(run, f"doc_id {kind}, {kinds}")


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, a tenth of them made periodic, as in periodic_runs()."""
    return periodic_runs(table(spark, sf_dir, "documents"), planted=True)
