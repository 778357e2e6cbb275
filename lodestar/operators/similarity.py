"""Two-stage nearest-neighbour identification as DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.functions.numeric import clamp

#: Rows that survive the coarse cut of a window, results of a query, and the confidence that counts.
COARSE, TOP, CONFIDENT = 48, 3, 0.6
#: Queries and catalogue meet in blocks of this size at most; copies of a catalogue take this much at most if its size allows.
BLOCK_BYTES, COPIES_BYTES = 64 << 20, 1 << 30
#: A slice of queries takes this much, and has so many windows, at most; pairs that a task holds beside its result; variants compared at a time.
SLICE_BYTES, SLICE_WINDOWS, PAIRS, TILE = 32 << 20, 50_000, 1 << 17, 1 << 16
#: The distance of a variant that isn't asked for; two hashes differ in 128 places at most.
GONE, FLAT = 255, 1e-9


def mean_vector(variants: DataFrame, vector: str = "vec") -> DataFrame:
    """(pos, mean): the element-wise mean of all vectors."""
    return variants.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def _mean_array(variants: DataFrame, vector: str) -> DataFrame:
    """One row with the mean vector as an array; as long as a vector, so its broadcast is bounded."""
    rows = mean_vector(variants, vector).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("m"))
    return rows.select(F.transform("m", lambda s: s["mean"]).alias("mean"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def with_units(rows: DataFrame, base: DataFrame, vector: str = "vec", out: str = "unit") -> DataFrame:
    """rows with `out`, the unit vector centred by the mean of base; each step a projection of its own, so nothing is computed twice."""
    shifted = rows.join(F.broadcast(_mean_array(base, vector))).withColumn("_s", F.zip_with(vector, "mean", lambda a, b: a.cast("double") - b))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    shifted = shifted.withColumn("_a", total(F.col("_s")) / F.size("_s")).withColumn("_c", F.transform("_s", lambda x: x - F.col("_a")))
    shifted = shifted.withColumn("_n", total(F.transform("_c", lambda x: x * x)))
    unit_ = F.transform("_c", lambda x: F.when(F.col("_n") > FLAT, x / F.sqrt("_n")).otherwise(0.0))
    return shifted.withColumn(out, unit_).drop("_s", "_a", "_c", "_n", "mean")


def _stacked(column: pa.Array, n: int) -> np.ndarray:
    """A list column as a matrix of n rows."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1)


def _bytes(rows: DataFrame, units: list[str]) -> Column:
    """About how many bytes a row of hashes and unit vectors takes."""
    return (32 + 8 * sum((F.size(F.col(c)) for c in units), F.lit(0))).cast("long")


def _codes(column: pa.Array) -> np.ndarray:
    """A number for each value, equal for equal ones; nulls are equal too."""
    if not pa.types.is_struct(column.type):
        return column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    code = column.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
    for field in column.flatten():
        code = np.unique(code * (len(column) + 1) + _codes(field), return_inverse=True)[1]
    return code


def _distances(hashes: list[np.ndarray], own: list[np.uint64], out: np.ndarray) -> np.ndarray:
    """Bits in which each variant differs from one window, in tiles that stay in the cache. A hash that all variants share is counted once."""
    bits, buffer = np.empty(min(TILE, len(out)), np.uint64), np.empty(min(TILE, len(out)), np.uint8)
    out[:] = sum(int(v[0] ^ o).bit_count() for v, o in zip(hashes, own, strict=True) if len(v) == 1)
    for v, o in zip(hashes, own, strict=True):
        for lo in range(0, len(out) if len(v) > 1 else 0, TILE):
            n = min(TILE, len(out) - lo)
            np.bitwise_xor(v[lo : lo + n], o, out=bits[:n])
            np.bitwise_count(bits[:n], out=buffer[:n])
            out[lo : lo + n] += buffer[:n]
    return out


def _closest(h: np.ndarray, past: list[np.ndarray], coarse: int, guess: int) -> tuple[np.ndarray, int]:
    """The places of the `coarse` least distances, ties by those of the windows before, latest first, then by place; and the largest of these distances.

    past ends with h; a distance of GONE is none. guess is where the search for that largest distance starts.
    """
    if len(h) > coarse:
        while guess < GONE - 1 and np.count_nonzero(h <= guess) < coarse:
            guess += 1
        while guess and np.count_nonzero(h < guess) >= coarse:
            guess -= 1
    else:
        guess = GONE - 1
    near = np.flatnonzero(h <= guess)
    return near[np.lexsort([x[near] for x in past])[:coarse]], guess


def _best(row: np.ndarray, entry: np.ndarray, ncc: np.ndarray, hd: np.ndarray, top: int) -> np.ndarray:
    """Places of the pairs that ranked() needs: each entry's best by correlation and distance, of a query's first top + 1 and those equal to the last."""
    last = np.where(np.isnan(ncc), -np.inf, -ncc)
    order = np.lexsort((hd, last, entry, row))
    row_, entry_ = row[order], entry[order]
    order = order[np.concatenate([[True], (row_[1:] != row_[:-1]) | (entry_[1:] != entry_[:-1])])]
    order = order[np.lexsort((hd[order], last[order], row[order]))]
    starts = np.flatnonzero(np.concatenate([[True], row[order][1:] != row[order][:-1]]))
    sizes = np.diff(np.append(starts, len(order)))
    end = order[np.repeat(starts + np.minimum(sizes - 1, top), sizes)]
    keep = (last[order] < last[end]) | (last[order] == last[end]) & (hd[order] <= hd[end])
    return order[keep]


def _nearest(units: list[str], other: bool, coarse: int, top: int | None) -> Callable:
    """The coarse cut of the windows of one slice of queries within one block of the catalogue, with correlations; with top, what ranked() needs of it.

    Queries are taken some at a time, so that no more than PAIRS pairs of a window and a variant, or one query's, are held beside the result.
    """

    names = {"qid": None, "w": None, "flat": None, "entry": None, "hd": pa.int32(), "key": pa.binary(), "ncc": pa.float64()}
    if top is not None:
        names = {"qid": None, "entry": None, "ncc": pa.float64(), "hamming": pa.int32()}

    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        asked, block = asked.combine_chunks(), block.combine_chunks()
        if not len(asked) or not len(block):
            return pa.Table.from_arrays([pa.array([], kind if kind is not None else (asked if c in ("qid", "w") else block).schema.field(c).type) for c, kind in names.items()], list(names))
        by_flat = np.argsort(block.column("flat").to_numpy(), kind="stable")
        flat, entry = block.column("flat").to_numpy()[by_flat], block.column("entry").combine_chunks()
        hashes = [block.column(c).to_numpy().view(np.uint64)[by_flat] for c in ("p", "d")]
        hashes = [v[:1] if (v == v[0]).all() else v for v in hashes]
        ids, w = asked.column("qid").combine_chunks(), asked.column("w").combine_chunks()
        codes, entries = _codes(ids), _codes(entry)
        line = np.lexsort((w.to_numpy(), codes))
        own = [asked.column(c).to_numpy().view(np.uint64)[line] for c in ("p", "d")]
        starts = np.append(np.flatnonzero(np.concatenate([[True], np.diff(codes[line]) != 0])), len(line))
        mine, theirs = ([_stacked(x.column(c).combine_chunks(), len(x)) for c in units] for x in (asked, block))
        parts, held, guesses = [], [], {}

        def flush() -> None:
            win, pick, hd = (np.concatenate(x) for x in list(zip(*held, strict=True))[:3])
            keys = [k for h in held for k in h[3]]
            win, pick = line[win], by_flat[pick]
            ncc = np.zeros(len(pick))
            for lo in range(0, len(pick) if units else 0, PAIRS // 8):
                some = slice(lo, lo + PAIRS // 8)
                ncc[some] = sum(np.einsum("ij,ij->i", m[win[some]], v[pick[some]]) for m, v in zip(mine, theirs, strict=True)) / len(units)
            if top is not None:
                kept = _best(codes[win], entries[pick], ncc, hd, top) if len(pick) else pick
                columns = [ids.take(pa.array(win[kept])), entry.take(pa.array(pick[kept])), pa.array(ncc[kept]), pa.array(hd[kept].astype(np.int32))]
            else:
                columns = [ids.take(pa.array(win)), w.take(pa.array(win)), block.column("flat").combine_chunks().take(pa.array(pick)), entry.take(pa.array(pick)), pa.array(hd.astype(np.int32)), pa.array(keys, pa.binary()), pa.array(ncc)]
            parts.append(pa.Table.from_arrays(columns, list(names)))
            held.clear()

        space = [np.empty(len(flat), np.uint8) for _ in range(int(np.diff(starts).max(initial=0)))]
        pairs = 0
        for q in range(len(starts) - 1):
            gone = np.searchsorted(flat, ids[int(line[starts[q]])].as_py() + np.arange(2)) if other else (0, 0)
            past: list[np.ndarray] = []
            for k, i in enumerate(range(starts[q], starts[q + 1])):
                h = _distances(hashes, [o[i] for o in own], space[k])
                h[gone[0] : gone[1]] = GONE
                past.append(h)
                near, guesses[k] = _closest(h, past, coarse, guesses.get(k, 16))
                keys = [] if top is not None else [r.tobytes() for r in np.stack([x[near] for x in reversed(past)], 1)]
                held.append((np.full(len(near), i), near, h[near], keys))
                pairs += len(near)
            if pairs >= PAIRS or q + 2 == len(starts):
                flush()
                pairs = 0
        return pa.concat_tables(parts)

    return run


def _shares(windows: DataFrame, rows: DataFrame, units: list[str], gate: str | None, copies: int) -> tuple[int, int]:
    """(slices, blocks) that queries and catalogue are dealt into, from their counts and sizes: SLICE_BYTES and SLICE_WINDOWS, and BLOCK_BYTES each at most, and
    otherwise as many slices as give every task of a shuffle something to do, while all copies of the catalogue take `copies` bytes. A slice
    of several gates is as many tasks."""
    n, total = rows.agg(F.count(F.lit(1)), F.sum(_bytes(rows, units))).first()
    if not n and gate is not None:
        return 1, 1
    if not n:
        raise ValueError("no catalogue entry is left to match")
    gates = F.lit(1) if gate is None else F.approx_count_distinct(gate)
    queries, count, asked, gates = windows.agg(F.approx_count_distinct("qid"), F.count(F.lit(1)), F.sum(_bytes(windows, units)), gates).first()
    blocks, tasks = -(-total // BLOCK_BYTES), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(-(-tasks // (blocks * max(gates, 1))), copies // total, queries)
    return max(-(-(asked or 0) // SLICE_BYTES), -(-count // SLICE_WINDOWS), wanted, 1), blocks


def _met(windows: DataFrame, variants: DataFrame, keep: Column | None, other: bool, coarse: int, gate: str | None, top: int | None = None, copies: int = COPIES_BYTES) -> tuple[DataFrame, bool]:
    """What _nearest gives of all slices and blocks, and whether a catalogue of several blocks has left each query with several cuts; then top is not heeded."""
    units = [c for c in ("unit", "unit_bp") if c in variants.columns and c in windows.columns]
    within = [] if gate is None else [gate]
    rows = (variants if keep is None else variants.where(keep)).select("flat", "entry", "p", "d", *units, *within)
    slices, blocks = _shares(windows, rows, units, gate, copies)
    top = top if blocks == 1 else None
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    own = [F.col(c).alias(c) for c in ("qid", "w", "p", "d", *units, *within)]  # columns of their own, as both sides may come from one table
    asked = windows.select(own).withColumn("slice", F.pmod(F.xxhash64("qid"), F.lit(slices))).withColumn("block", each(blocks))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("flat"), F.lit(blocks))).withColumn("slice", each(slices))
    kind = lambda df, c: f"{c} {df.schema[c].dataType.simpleString()}"
    kinds = [kind(windows, "qid"), kind(windows, "w"), "flat long", kind(variants, "entry"), "hd int, key binary, ncc double"]
    if top is not None:
        kinds = [kind(windows, "qid"), kind(variants, "entry"), "ncc double, hamming int"]
    cut = asked.groupBy(*within, "slice", "block").cogroup(dealt.groupBy(*within, "slice", "block")).applyInArrow(_nearest(units, other, coarse, top), ", ".join(kinds))
    return cut, blocks > 1


def candidates(windows: DataFrame, variants: DataFrame, *, keep: Column | None = None, other: bool = False, coarse: int = COARSE, gate: str | None = None) -> DataFrame:
    """(qid, w, flat, entry, hd, ncc): the coarse cut. windows: (qid, w, p, d, units); variants: (flat, entry, p, d, units).

    Each window keeps the `coarse` variants of least distance; ties go by the distances of the windows before it, latest
    first, then by flat. keep filters variants before the cut, and one that leaves none is an error; other leaves out the
    variant whose flat is the qid. gate names a column of both sides, the same for all windows of a query: a window only
    meets variants of its own value, and none if there are none. ncc is the mean correlation by the unit vectors, unit and unit_bp, that both sides have.
    Queries are dealt into slices and the catalogue into blocks, and each slice meets each block in one task: neither
    side passes through the driver, and no task holds more than a slice, a block and the slice's cut. Of several blocks
    the cuts are ranked together.
    """
    cut, several = _met(windows, variants, keep, other, coarse, gate)
    if several:
        order = W.partitionBy("qid", "w").orderBy("key", "flat")
        cut = cut.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= coarse).drop("rn")
    return cut.drop("key")


def best_entries(cut: DataFrame) -> DataFrame:
    """(qid, entry, ncc, hamming): each entry's best pair of window and variant, by correlation, then distance."""
    best = cut.groupBy("qid", "entry").agg(F.max(F.struct("ncc", (-F.col("hd")).alias("near"))).alias("b"))
    return best.select("qid", "entry", F.col("b.ncc").alias("ncc"), (-F.col("b.near")).alias("hamming"))


def confidence(first: Column, second: Column) -> Column:
    """From the best correlation and its margin over the next, 1 if there is none."""
    margin = F.when(second.isNull(), 1.0).otherwise(first - second)
    return F.when(first.isNull(), 0.0).otherwise(F.sqrt(clamp((first - 0.45) / 0.15, 0.0, 1.0) * clamp((margin - 0.02) / 0.04, 0.0, 1.0)))


def ranked(best: DataFrame, top: int = TOP) -> DataFrame:
    """(qid, rank, entry, ncc, hamming, confidence): the first `top` by correlation, distance, entry."""
    order = W.partitionBy("qid").orderBy(F.col("ncc").desc(), "hamming", "entry")
    rows = best.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("ncc").over(order))
    rows = rows.where(F.col("rank") <= max(top, 1))
    first = F.when(F.col("rank") == 1, confidence(F.col("ncc"), F.col("next")))
    return rows.withColumn("confidence", F.max(first).over(W.partitionBy("qid"))).drop("next")


def outcomes(ranks: DataFrame) -> DataFrame:
    """(qid, candidates, best, confidence, is_confident): one row per query that met any entry."""
    rows = ranks.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "entry", "ncc", "hamming"))).alias("candidates"), F.max("confidence").alias("confidence"))
    return rows.select("qid", "candidates", F.get("candidates", F.lit(0))["entry"].alias("best"), "confidence", (F.col("confidence") >= CONFIDENT).alias("is_confident"))


def match(windows: DataFrame, variants: DataFrame, *, keep: Column | None = None, other: bool = False, top: int = TOP, coarse: int = COARSE, gate: str | None = None, copies: int = COPIES_BYTES) -> DataFrame:
    """Ranks of every query; see candidates, best_entries and ranked. With a catalogue of one block, tasks hand on a query's best entries only.
    Copies of a catalogue whose size allows it take `copies` bytes at most."""
    cut, several = _met(windows, variants, keep, other, coarse, gate, max(top, 1), copies)
    if several:
        order = W.partitionBy("qid", "w").orderBy("key", "flat")
        cut = best_entries(cut.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= coarse))
    return ranked(cut, top)


def raw_ncc(a: Column, b: Column) -> Column:
    """Pearson correlation of two vectors as they are, 0 if either is flat; raises if their lengths differ."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("a", "b", "aa", "bb", "ab")])

    def add(s: Column, p: Column) -> Column:
        x, y = p["a"].cast("double"), p["b"].cast("double")
        return F.struct((s["a"] + x).alias("a"), (s["b"] + y).alias("b"), (s["aa"] + x * x).alias("aa"), (s["bb"] + y * y).alias("bb"), (s["ab"] + x * y).alias("ab"))

    def end(s: Column) -> Column:
        n = F.size(a)
        va, vb = s["aa"] - s["a"] * s["a"] / n, s["bb"] - s["b"] * s["b"] / n
        return F.when((va > FLAT) & (vb > FLAT), (s["ab"] - s["a"] * s["b"] / n) / F.sqrt(va * vb)).otherwise(0.0)

    value = F.aggregate(F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), zero, add, end)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in length")))
